"""Model architectures in JSON and weights as flat vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mselect.functions.features import col

_LAYER = "STRUCT<class_name: STRING, config: STRUCT<batch_input_shape: ARRAY<INT>, units: INT>>"


def arch_layers(arch: str | Column) -> Column:
    """The layer list of an architecture, whether ``config`` is the list itself or holds it under ``layers``."""
    c = col(arch)
    listed = F.from_json(c, f"config ARRAY<{_LAYER}>")["config"]
    nested = F.from_json(c, f"config STRUCT<layers: ARRAY<{_LAYER}>>")["config"]["layers"]
    is_list = F.startswith(F.ltrim(F.get_json_object(c, "$.config")), F.lit("["))
    layers = F.when(is_list, listed).otherwise(nested)
    return F.coalesce(layers, F.raise_error(F.lit("unreadable model architecture")).cast(f"ARRAY<{_LAYER}>"))


def arch_input_shape(arch: str | Column) -> Column:
    """Input shape of the first layer without the batch dimension."""
    shape = arch_layers(arch)[0]["config"]["batch_input_shape"]
    return F.coalesce(F.slice(shape, F.lit(2), F.greatest(F.size(shape) - 1, F.lit(0))),
                      F.raise_error(F.lit("no input shape in model architecture")).cast("array<int>"))


def num_classes(arch: str | Column) -> Column:
    """Units of the last layer that has any."""
    sized = F.filter(arch_layers(arch), lambda x: x["config"]["units"].isNotNull())
    return F.coalesce(F.try_element_at(sized, F.lit(-1))["config"]["units"],
                      F.raise_error(F.lit("no class count in model architecture")).cast("int"))


def layer_text(arch: str | Column) -> Column:
    """Readable list of the layers, dense layers with their size, arrows in between."""
    names = F.transform(arch_layers(arch), lambda x: F.when(
        x["class_name"] == "Dense", F.concat(F.lit("Dense["), x["config"]["units"].cast("string"), F.lit("]"))
    ).otherwise(x["class_name"]))
    return F.concat(F.lit("Model arch layers:\n"), F.array_join(names, "\n   |\n   V\n"), F.lit("\n"))


def flatten_weights(layers: str | Column, count: str | Column | None = None) -> Column:
    """Concatenate the layers' weights into one float vector, with the example count in front when given."""
    flat = F.flatten(col(layers)).cast("array<float>")
    return flat if count is None else F.concat(F.array(col(count).cast("float")), flat)


def unflatten_weights(flat: str | Column, shapes: str | Column) -> Column:
    """Cut a flat vector into layers of the given shapes; a total of another length is an error."""
    sizes = F.transform(col(shapes), lambda s: F.aggregate(s, F.lit(1), lambda a, v: a * v))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<array<float>>").alias("parts"))
    cut = F.aggregate(sizes, start, lambda acc, n: F.struct(
        (acc["at"] + n).alias("at"),
        F.concat(acc["parts"], F.array(F.slice(col(flat).cast("array<float>"), acc["at"], n))).alias("parts")))
    right = cut["at"] - 1 == F.size(col(flat))
    return F.when(right, cut["parts"]).otherwise(
        F.raise_error(F.lit("weights do not match the shapes")).cast("array<array<float>>"))
