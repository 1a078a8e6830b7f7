"""Configuration values as text: keys, labels, compile and fit parameters, and small unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mselect.functions.features import col

# Configuration fields and their types.
CONFIG_SCHEMA = "learning_rate DOUBLE, lambda_value DOUBLE, batch_size INT, model STRING"
CONFIG_FIELDS = ["learning_rate", "lambda_value", "batch_size", "model"]


def number_text(c: str | Column) -> Column:
    """A fraction as text: plain digits down to 0.0001, below that like 1e-05."""
    plain = col(c).cast("double").cast("string")
    digits = F.regexp_replace(F.regexp_extract(plain, r"^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(plain, r"E-(\d+)$", 1)
    return (
        F.when(~plain.contains("E-"), plain)
        .when(exponent == "4", F.concat(F.lit("0.000"), F.replace(digits, F.lit("."), F.lit(""))))
        .otherwise(F.concat(digits, F.lit("e-"), F.lpad(exponent, 2, "0")))
    )


def config_key(config: str | Column, fields: list[str] = CONFIG_FIELDS) -> Column:
    """``name:value`` pairs in name order, joined by ``|``, blanks turned into underscores."""
    c = col(config)
    parts = [F.concat(F.lit(f"{f}:"), _as_text(c, f)) for f in sorted(fields)]
    return F.replace(F.concat_ws("|", *parts), F.lit(" "), F.lit("_"))


def _as_text(c: Column, field: str) -> Column:
    if field in ("learning_rate", "lambda_value"):
        return number_text(c[field])
    return c[field].cast("string")


def parse_config_key(key: str | Column) -> Column:
    """Configuration struct from its key: batch size whole, model text, the rest floating."""
    m = F.str_to_map(col(key), F.lit(r"\|"), F.lit(":"))
    return F.struct(
        m["learning_rate"].cast("double").alias("learning_rate"),
        m["lambda_value"].cast("double").alias("lambda_value"),
        m["batch_size"].cast("int").alias("batch_size"),
        m["model"].alias("model"),
    )


def config_label(config: str | Column) -> Column:
    """``name:value`` pairs in the fixed field order, joined by commas."""
    c = col(config)
    return F.concat_ws(",", *[F.concat(F.lit(f"{f}:"), _as_text(c, f)) for f in CONFIG_FIELDS])


def fit_params(config: str | Column) -> Column:
    """Struct of the compile and fit parameters, each as JSON."""
    c = col(config)
    compile_ = F.to_json(F.struct(
        F.lit("categorical_crossentropy").alias("loss"),
        F.concat(F.lit("Adam(lr="), number_text(c["learning_rate"]), F.lit(")")).alias("optimizer"),
        F.array(F.lit("top_k_categorical_accuracy")).alias("metrics"),
    ))
    fit = F.to_json(F.struct(c["batch_size"].alias("batch_size"), F.lit(1).alias("epochs")))
    return F.struct(compile_.alias("compile_params"), fit.alias("fit_params"))


def error_rate(metric: str | Column) -> Column:
    return 1 - col(metric)


def to_hours(seconds: str | Column) -> Column:
    return col(seconds) / 3600


def machine_hours(seconds: str | Column, workers: int = 8, epochs: int = 1) -> Column:
    """Hours per worker and epoch."""
    return col(seconds) / (3600 * workers * epochs)
