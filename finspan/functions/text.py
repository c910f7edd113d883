"""Column expressions over text, labels and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """White space collapsed, ends trimmed; blank becomes null."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t != "", t)


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def domain(url: Column) -> Column:
    """Host of a URL without www, its last two labels; null without a host."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    parts = F.split(host, r"\.")
    return F.when(host != "", F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), "."))


def symbols(text: Column) -> Column:
    """Cash tags ($ABC) of a text, in order, repeated ones too."""
    return F.regexp_extract_all(text, F.lit(r"\$([A-Z]{1,5})\b"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def number(c: Column) -> Column:
    """Text as a double; what is none, and NaN, becomes null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def signed_percent(c: Column, digits: int = 2) -> Column:
    """+1.23% or a dash for null."""
    return F.coalesce(F.format_string(f"%+.{digits}f%%", c), F.lit("—"))


def tag_list(c: Column) -> Column:
    """Tags of a JSON list or a comma list: trimmed, without empty ones and without later repeats in any case."""
    parts = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
    tags = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(tags, lambda x, i: F.array_position(F.transform(tags, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def line_field(c: Column, name: str) -> Column:
    """What follows 'name: ' at the start of a line."""
    return F.regexp_extract(c, rf"(?m)^{name}: (.*)$", 1)


def answer_field(c: Column, name: str) -> Column:
    """A field of the JSON object in a model's answer, fenced or bare, with trailing commas mended; null without one."""
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.get_json_object(F.regexp_replace(body, r",\s*([}\]])", "$1"), f"$.{name}")


def canonical(tags: Column, aliases: dict[str, str]) -> Column:
    """Tags by their aliases, each once."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.array_distinct(F.transform(tags, lambda x: F.coalesce(F.element_at(table, x), x)))


def weighted_tokens(messages: DataFrame) -> DataFrame:
    """(conv_id, n_tokens, n_trained): weights of a conversation's characters are 1 where the assistant speaks, else 0."""
    m = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"), (F.col("role") == "assistant").alias("own")))).alias("m"))
    weights = F.flatten(F.transform("m", lambda x: F.array_repeat(x["own"].cast("int"), x["n"])))
    m = m.select("conv_id", weights.alias("w"))
    return m.select("conv_id", F.size("w").cast("bigint").alias("n_tokens"), F.aggregate("w", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("n_trained"))
