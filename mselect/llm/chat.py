"""Chat formatting in windows of a token budget, with a mask of the text to learn from.

A turn is written ``<turn ROLE>``, newline, text, newline, ``</turn>``, newline. In texts and roles a backslash goes before ``\\``, ``<`` and, in
roles, ``>``, so no text can look like a mark, and taking the backslashes away gives the text back.

Prefix sums of the turns' tokens choose the windows. A window begins with the system turn, if the conversation begins with one,
then repeats as many of the turns before as fit a history budget, then goes on with new turns as far as the whole budget goes. A turn is
never cut: one that is too long by itself makes a longer window. Only new turns of the learned roles are under the mask.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from hashlib import sha256
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mselect.llm.common import arrow_map
from mselect.llm.tokens import encoder

_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.)*)\n</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<", "\\<")
    return text.replace(">", "\\>") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def words(text: str) -> int:
    """The default measure of a turn: its words and four tokens of marks."""
    return len(text.split()) + 4


def written(role: str, text: str) -> str:
    """A turn as it stands in a window."""
    return f"<turn {escape(role, True)}>\n{escape(text)}\n</turn>\n"


def token_costs(turns: list[tuple[str, str]], path: str) -> list[int]:
    """The tokens of each written turn, marks included, by a tokenizer file."""
    return [len(ids) // 4 for ids in encoder(path).ids([written(role, text) for role, text in turns])]


class Window(NamedTuple):
    text: str
    repeated: int  # turns at the beginning that an earlier window has too
    loss: list[tuple[int, int]]  # code points under the mask
    tokens: int


def spans(costs: list[int], system: bool, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first, fresh, end) of each window: turns ``first`` to ``fresh`` are repeated, ``fresh`` to ``end`` are new."""
    sums = [0, *accumulate(costs)]
    least = int(system)
    room = budget - sums[least]
    out, fresh = [], least
    while fresh < len(costs):
        first = bisect_left(sums, sums[fresh] - history, least, fresh)
        first = min(fresh, max(first, bisect_left(sums, sums[fresh + 1] - room, least, fresh)))  # the new turn comes first
        end = max(fresh + 1, bisect_right(sums, sums[first] + room, fresh, len(sums)) - 1)
        out.append((first, fresh, end))
        fresh = end
    return out or [(least, least, least)]


def windows(turns: list[tuple[str, str]], budget: int = 512, history: int = 128, learned: tuple[str, ...] = ("assistant",),
            count: Callable[[str], int] = words, costs: list[int] | None = None) -> list[Window]:
    """The windows of one conversation of (role, text) turns, whose costs are ``costs`` or those that ``count`` gives their texts."""
    costs = [count(text) for _, text in turns] if costs is None else costs
    system = bool(turns) and turns[0][0] == "system"
    out = []
    for number, (first, fresh, end) in enumerate(spans(costs, system, budget, history)):
        shown = [*([0] if system else []), *range(first, end)]
        parts, loss, at = [], [], 0
        for i in shown:
            role, text = turns[i]
            head, body = f"<turn {escape(role, True)}>\n", escape(text)
            if i >= fresh and role in learned:
                loss.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, "\n</turn>\n"]
            at += len(head) + len(body) + 9
        repeated = fresh - first + int(system) if number else 0
        out.append(Window("".join(parts), repeated, loss, sum(costs[i] for i in shown)))
    return out


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window; fails if anything else is in it."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


_WINDOWS = "array<struct<text: string, repeated: int, loss: array<struct<start: int, end: int>>, tokens: int>>"


def format_chats(rows: DataFrame, budget: int = 512, history: int = 128, learned: tuple[str, ...] = ("assistant",),
                 count: Callable[[str], int] = words, path: str | None = None) -> DataFrame:
    """(conv_id, windows) of every conversation; ``rows`` has conv_id, turn, role, text.

    The budgets are tokens of the written turns by the tokenizer file ``path`` if there is one, else what ``count`` gives for texts.

    Turns go by turn, then role and text; repeated rows are repeated turns. A null text or role is empty, a null turn comes first, and rows with
    a null conv_id are one conversation. Other columns aren't read. A conversation is one cell: its windows follow from each
    other.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for turns in batch.column(1).to_pylist():
            said = [(t["role"], t["text"]) for t in turns]
            made = windows(said, budget, history, learned, count, token_costs(said, path) if path else None)
            out.append([{**w._asdict(), "loss": [{"start": a, "end": b} for a, b in w.loss]} for w in made])
        loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        cell = pa.list_(pa.struct([("text", pa.string()), ("repeated", pa.int32()), ("loss", loss), ("tokens", pa.int32())]))
        return {"conv_id": batch.column(0), "windows": pa.array(out, cell)}
    return arrow_map(whole.select("conv_id", "turns"), run, f"conv_id {kind}, windows {_WINDOWS}")


def digests(formatted: DataFrame) -> DataFrame:
    """What ``format_chats`` wrote, read back: turns without repeats, and the text under the mask, as counts and SHA-256."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")}
        for made in batch.column(1).to_pylist():
            turns = [t for w in made for t in parse(w["text"])[w["repeated"]:]]
            loss = "".join(unescape(w["text"][s["start"]: s["end"]]) for w in made for s in w["loss"])
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            for name, value in zip(out, (len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(),
                                         sum(len(w["text"]) for w in made), len(made))):
                out[name].append(value)
        return {"conv_id": batch.column(0), **out}
    return arrow_map(formatted.select("conv_id", "windows"), run, f"conv_id {kind}, n_turns long, turns_sha256 string, "
                     "loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
