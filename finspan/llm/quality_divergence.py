"""Quality rules by the divergence of a document's histograms from those of its language.

Two histograms are taken of every document: of its characters by class, and of its words by the most common words
of its language (with one bin for all others). Each is held against the sum over all documents of the language by
the Jensen-Shannon distance. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.llm import common
from finspan.llm.common import SPACE_RE, written

#: Common words of a language: so many, of at most so many characters (as function words are), by documents that have them.
COMMON, LETTERS = 50, 6
#: Fewer words or characters than these are not judged by their histograms.
MIN_WORDS, MIN_CHARS = 40, 200
#: Largest divergence (squared distance, in bits) beyond what a sample of the document's size differs by.
MAX_CHARS, MAX_WORDS = 0.06, 0.03
CLASSES = ("lower", "upper", "digit", "symbol", "space", "other")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RE), "")


def _less(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def base_features(docs: DataFrame) -> DataFrame:
    """(row, doc_id, lang, text) -> row, doc_id, lang and the base counts, with the character classes.

    A null text counts as an empty one. A word in a repeated 5-word window counts once, however many such windows hold it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("row", "doc_id", "lang", text.alias("text"))
    d = d.withColumn("w", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "row",
        "doc_id",
        "lang",
        F.length("text").alias("chars"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        _less(F.col("text"), "[#*$%&|<>]+").alias("symbol"),
        _less(F.col("text"), r"\p{Lu}+").alias("upper"),
        _less(F.col("text"), r"\p{Ll}+").alias("lower"),
        _less(F.col("text"), "[0-9]+").alias("digit"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    d = d.withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).drop("lines")
    h = F.col("h")
    window = F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
    d = d.withColumn("v", F.when(F.size(h) > 5, window).otherwise(F.array().cast("array<bigint>"))).withColumn("n_words", F.size("h")).drop("h")
    some = F.size(F.array_distinct("v")) < F.size("v")
    d = d.withColumn("s", F.when(some, F.sort_array(F.transform("v", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("v")
    s = F.col("s")
    twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["x"] == x["x"]) | (F.get(s, j + 1)["x"] == x["x"]))
    d = d.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    p = F.col("p")
    gain = F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gain, F.lit(0), lambda a, x: a + x), F.lit(0))).drop("p")
    d = d.withColumn("space", F.col("chars") - F.col("word_chars"))
    return d.withColumn("other", F.col("chars") - F.col("lower") - F.col("upper") - F.col("digit") - F.col("symbol") - F.col("space"))


def js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays that each sum to one."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    return F.aggregate(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2), F.lit(0.0), lambda a, x: a + x)


def _share(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)).cast("double"))


def judge(docs: DataFrame) -> DataFrame:
    """Per row of docs (row, doc_id, text, lang; row distinct): row, doc_id, the base counts, js_chars, js_words (distances, null where not judged), base_failed, kept.

    A document without a language (null or empty) is held against every language's references and judged by those of the
    least divergence, of words first; only where no document has a language are the references those of all documents. An
    empty or null text has no words and fails the base rule. The plan of docs must give the same rows when it is run again.
    """
    docs = docs.select("row", "doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
    named = bool(docs.where("lang <> ''").select("lang").take(1))
    words = docs.select("row", "lang", words_of(F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("w"))
    short = F.explode(F.filter(F.array_distinct("w"), lambda x: (F.length(x) <= LETTERS) & x.rlike(r"^\p{L}+$")))
    df = (words.where("lang <> ''") if named else words).select("lang", short.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common_words = written(df.withColumn("nth", nth).where(F.col("nth") <= COMMON).select("lang", "word", "nth"), "common-words")
    if named:  # to documents without a language, all these words are told, numbered through
        any_word = common_words.select("word").distinct().select(F.lit("").alias("lang"), "word", F.row_number().over(Window.orderBy("word")).alias("nth"))
        common_words = written(common_words.union(any_word), "words-told")

    told = words.select("row", "lang", F.explode("w").alias("word")).join(F.broadcast(common_words), ["lang", "word"])  # COMMON rows a language
    told = told.groupBy("row", "nth").agg(F.count("*").alias("n")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("nth", "n"))).alias("m"))
    bins = F.transform(F.sequence(F.lit(1), F.lit(COMMON)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    full = base_features(docs).join(told, "row", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,bigint>")))
    full = full.withColumn("b", bins).withColumn("m", F.when(F.lit(named) & (F.col("lang") == ""), F.col("m")))
    full = full.withColumn("word_bins", F.concat("b", F.array(F.col("n_words") - F.aggregate("b", F.lit(0.0), lambda a, x: a + x)))).drop("b")
    full = written(full.withColumn("char_bins", F.array(*(F.col(c).cast("double") for c in CLASSES))), "features")

    sums = [F.sum(F.col("char_bins")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("word_bins")[i]).alias(f"w{i}") for i in range(COMMON + 1)]
    of_lang = full.where("lang <> ''") if named else full
    ref = of_lang.groupBy("lang").agg(*sums)
    c, w = F.array(*(f"c{i}" for i in range(len(CLASSES)))), F.array(*(f"w{i}" for i in range(COMMON + 1)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    ref = ref.select("lang", c.alias("c"), w.alias("w")).select("lang", _share(F.col("c"), total(F.col("c"))).alias("ref_chars"), _share(F.col("w"), total(F.col("w"))).alias("ref_words"))
    jc = lambda ref: F.when(F.col("chars") >= MIN_CHARS, F.greatest(F.lit(0.0), js(_share(F.col("char_bins"), F.col("chars")), ref)))
    jw = lambda bins, ref: F.when(F.col("n_words") >= MIN_WORDS, F.greatest(F.lit(0.0), js(_share(bins, F.col("n_words")), ref)))
    out = of_lang.join(ref, "lang").withColumn("jc", jc(F.col("ref_chars"))).withColumn("jw", jw(F.col("word_bins"), F.col("ref_words")))
    if named:
        told_as = common_words.where("lang = ''").select("word", F.col("nth").alias("told"))
        at = common_words.where("lang <> ''").join(F.broadcast(told_as), "word").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("nth", "told"))).alias("told"))
        at = F.broadcast(ref.join(at, "lang", "left").agg(F.collect_list(F.struct("lang", "told", "ref_chars", "ref_words")).alias("refs")))  # a row in all

        def from_language(r: Column) -> Column:
            b = F.transform(F.sequence(F.lit(1), F.lit(COMMON)), lambda i: F.coalesce(F.try_element_at("m", F.try_element_at(r["told"], i)), F.lit(0)).cast("double"))
            all_bins = F.concat(b, F.array(F.col("n_words") - F.aggregate(b, F.lit(0.0), lambda a, x: a + x)))
            return F.struct(jw(all_bins, r["ref_words"]).alias("jw"), jc(r["ref_chars"]).alias("jc"))

        least = full.where("lang = ''").crossJoin(at).withColumn("least", F.array_min(F.transform("refs", from_language)))
        least = least.withColumn("jc", F.col("least.jc")).withColumn("jw", F.col("least.jw"))
        names = ["row", "doc_id", "chars", "word_chars", "symbol", "n_dup_lines", "n_words", "n_repeat_words", "jc", "jw"]
        out = out.select(*names).union(least.select(*names))
    noise = lambda k, n: F.lit((k - 1) / 8 / 0.6931) / n  # noqa: E731  what a sample of n differs by, on average
    good = F.coalesce(F.col("jc") <= MAX_CHARS + noise(len(CLASSES), F.col("chars")), F.lit(True)) & F.coalesce(F.col("jw") <= MAX_WORDS + noise(COMMON + 1, F.col("n_words")), F.lit(True))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = [F.col(x).cast("bigint").alias(y) for x, y in (("n_words", "n_words"), ("word_chars", "word_chars"), ("symbol", "n_symbols"), ("n_dup_lines", "n_dup_lines"), ("n_repeat_words", "n_repeat_words"))]
    return out.select("row", "doc_id", *counts, F.sqrt("jc").alias("js_chars"), F.sqrt("jw").alias("js_words"), failed.alias("base_failed"), (~failed & good).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    bad = judge(rows.select(F.col("__row").alias("row"), "doc_id", "text", "lang")).where("not kept").select(F.col("row").alias("__row"))
    return common.by_row(rows, bad, "left_anti")


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("js_chars", 6).alias("js_chars"), F.round("js_words", 6).alias("js_words"))


QUERIES = {"op3_quality_divergence": op3_quality_divergence}
ORACLES: dict[str, str] = {}
