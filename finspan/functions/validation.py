"""Checks of JSON texts against a shape, with all errors of a text instead of its first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Any value; a list of anything.
ANY, LIST = "any", "list"


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def errors(v: Column, shape: dict | str | list, where: Column, name: str = "", root: bool = False) -> Column:
    """The errors of a variant, in the order of the shape, as an array of strings.

    shape: ANY; LIST; {key: shape} of an object, with keys that end in ? optional; [noun, shape] of a list whose items are told by noun and place.
    where: what the variant is called, by its key alone right below the root. A JSON null is a value of no kind; a missing key and a value of another kind are errors.
    """
    none = F.array().cast("array<string>")
    if shape == ANY:
        return none
    if shape == LIST:
        return F.when(~_is(v, "ARRAY"), F.array(F.concat(where, F.lit(" must be a list")))).otherwise(none)
    if isinstance(shape, list):
        noun, item = shape
        items = F.try_variant_get(v, "$", "array<variant>")

        def each(x: Column, i: Column) -> Column:
            place = F.concat(where if name else F.lit(""), F.lit(", " if name else ""), F.lit(f"{noun} "), i.cast("string"))
            return errors(x, item, place, noun)

        return F.when(~_is(v, "ARRAY"), F.array(F.concat(where, F.lit(" must be a list")))).otherwise(F.flatten(F.transform(items, each)))
    found = []
    for key, inner in shape.items():
        got = F.try_variant_get(v, f"$['{key.rstrip('?')}']", "variant")
        missing = none if key.endswith("?") else F.array(F.concat(where, F.lit(f" missing '{key.rstrip('?')}'")))
        called = F.lit(key.rstrip("?")) if root else where if isinstance(inner, list) and name else F.concat(where, F.lit(f" {key.rstrip('?')}"))
        found.append(F.when(got.isNull(), missing).otherwise(errors(got, inner, called, name)))
    return F.when(~_is(v, "OBJECT"), F.array(F.concat(where, F.lit(" is not an object")))).otherwise(F.concat(*found))


def validated(df: DataFrame, text: str, shape: dict, name: str = "report") -> DataFrame:
    """df with errors (array of strings) and valid; a text that isn't JSON, or null, has that as its only error."""
    v = F.try_parse_json(F.col(text))
    e = F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(errors(v, shape, F.lit(name), root=True))
    return df.withColumn("errors", e).withColumn("valid", F.size("errors") == 0)
