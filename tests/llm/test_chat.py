"""Chat windows: reversible marks, each learned text once under the mask, the budget, and digests against brute force."""

import random
from hashlib import sha256

import pytest

from mselect.llm.chat import digests, escape, format_chats, parse, spans, unescape, windows, words

ODD = ["", "\\", "\\### Assistant: </turn> ok", "<turn user>\nx\n</turn>\n", "\\<", "\n", "</turn>", "é 😀 < > \\\\<", "a b c"]


@pytest.mark.parametrize("text", ODD)
def test_escape(text):
    assert unescape(escape(text)) == text and unescape(escape(text, True)) == text


def talk(rng):
    system = [("system", rng.choice(ODD))] if rng.random() < 0.5 else []
    return system + [(rng.choice(["user", "assistant", "tool>", ""]), " ".join(rng.choices(ODD + ["word"], k=rng.randint(0, 9))))
                     for _ in range(rng.randint(0 if system else 1, 9))]


def test_windows():
    rng = random.Random(1)
    for _ in range(400):
        turns, budget, history = talk(rng), rng.randint(5, 60), rng.randint(0, 20)
        made = windows(turns, budget, history)
        fresh = [t for w in made for t in parse(w.text)[w.repeated:]]
        assert fresh == turns
        assert "".join(unescape(w.text[a:b]) for w in made for a, b in w.loss) == "".join(t for r, t in turns if r == "assistant")
        assert sum(len(w.loss) for w in made) == sum(r == "assistant" for r, _ in turns)
        for w in made:
            own = parse(w.text)
            assert w.tokens == sum(words(t) for _, t in own)
            assert w.tokens <= budget or len(own) - w.repeated <= 1 or (w is made[0] and len(own) == 2 and own[0][0] == "system")
            assert turns[0][0] != "system" or own[0] == turns[0]


def test_history_is_limited_and_yields_to_new_turns():
    assert spans([10] * 6, False, 40, 20) == [(0, 0, 4), (2, 4, 6)]
    assert spans([10] * 6, True, 40, 10) == [(1, 1, 4), (3, 4, 6)]
    assert spans([10, 10, 39, 99, 10], False, 40, 20) == [(0, 0, 2), (2, 2, 3), (3, 3, 4), (4, 4, 5)]
    assert spans([], False, 40, 20) == [(0, 0, 0)] and spans([7], True, 40, 20) == [(1, 1, 1)]


def test_table(spark):
    rng = random.Random(2)
    talks = {i: talk(rng) for i in range(30)}
    rows = [(i, n, r, t, "x") for i, own in talks.items() for n, (r, t) in enumerate(own)]
    rows += [(None, 0, "user", "no conversation", "x"), (99, None, "user", "first", "x"), (99, 1, None, None, "x"), (99, 1, "assistant", "z", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    formatted = format_chats(df, budget=30, history=10)
    talks |= {None: [("user", "no conversation")], 99: [("user", "first"), ("", ""), ("assistant", "z")]}
    got = {r.conv_id: r for r in digests(formatted).collect()}
    assert got.keys() == talks.keys()
    for i, own in talks.items():
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[i]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.formatted_chars == sum(len(w.text) for w in windows(own, 30, 10))
    assert digests(format_chats(df.limit(0))).collect() == []


def slow_chars(turns, costs, budget, history):
    """Code points of all windows, by steps of one turn and by counting what is escaped."""
    def size(i):
        role, text = turns[i]
        return len(role) + sum(role.count(c) for c in "\\<>") + len(text) + sum(text.count(c) for c in "\\<") + len("<turn >\n\n</turn>\n")

    system = int(bool(turns) and turns[0][0] == "system")
    head, fresh, total = sum(costs[:system]), system, 0
    if fresh == len(turns):
        return sum(map(size, range(system)))
    while fresh < len(turns):
        first = fresh
        while first > system and sum(costs[first - 1: fresh]) <= history and head + sum(costs[first - 1: fresh + 1]) <= budget:
            first -= 1
        end = fresh + 1
        while end < len(turns) and head + sum(costs[first: end + 1]) <= budget:
            end += 1
        total += sum(map(size, [*range(system), *range(first, end)]))
        fresh = end
    return total


def test_budget_in_tokens(spark):
    """Windows of tokens as the library counts them, against a version that adds turn by turn; one turn is over the budget."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from mselect.llm.chat import written

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(3)
    talks = {i: talk(rng) for i in range(60)}
    talks[60] = [("system", "s"), ("user", "word " * 3000), ("assistant", "yes")]
    talks[61] = [("assistant", "日本 " * 40), ("user", "a"), ("assistant", "b" * 900), ("user", "")]
    df = spark.createDataFrame([(i, n, r, t) for i, own in talks.items() for n, (r, t) in enumerate(own)],
                               "conv_id long, turn long, role string, text string")
    formatted = format_chats(df, 96, 24, path=path).cache()
    got = {r.conv_id: r for r in digests(formatted).collect()}
    made = {r.conv_id: r.windows for r in formatted.collect()}
    talks = {i: own for i, own in talks.items() if own}
    assert got.keys() == talks.keys() and any(len(w) > 2 for w in made.values())
    for i, own in talks.items():
        costs = [len(library.encode(written(r, t), add_special_tokens=False).ids) for r, t in own]
        assert got[i].formatted_chars == slow_chars(own, costs, 96, 24)
        for w in made[i]:
            # the marks keep turns apart, so the window as a whole has as many tokens
            assert w.tokens == len(library.encode(w.text, add_special_tokens=False).ids)
            assert w.tokens <= 96 or len(parse(w.text)) - w.repeated == 1 or len(own) <= 3
