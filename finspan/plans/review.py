"""Text, label and review queries: extraction, canonical tags, training data and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.functions import text as T
from finspan.operators import selection as S
from finspan.plans.corpus import EVAL, evaluated
from finspan.plans.sqlbase import registry
from finspan.sources.panels import rounded, table

QUERIES, ORACLES, query = registry()


# scalar text


@query("SELECT doc_id, CASE WHEN length(t) > 180 THEN left(t, 180) || '...' ELSE t END AS preview FROM (SELECT doc_id, nullif(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), '') AS t FROM documents)")
def previews(spark, sf):
    """The first 180 characters of each text with its white space collapsed: the column is a preview by definition."""
    return table(spark, sf, "documents").select("doc_id", T.truncated(T.clean(F.col("text")), 180).alias("preview"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"kind\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS packed FROM events")
def json_round_trip(spark, sf):
    """A property out of JSON, and a struct into it."""
    k = F.from_json("props", "struct<k: bigint>")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("kind"), k.alias("k"))).alias("packed"))


@query(
    """WITH p AS (SELECT conv_id, turn, 'Ticker: ' || upper(role) || chr(10) || 'Name: turn ' || turn || chr(10) || text AS prompt FROM conversations)
SELECT conv_id, turn, regexp_extract(prompt, 'Ticker: ([A-Z]+)', 1) AS ticker, regexp_extract(prompt, 'Name: ([^\n]*)', 1) AS name FROM p"""
)
def labelled_lines(spark, sf):
    """Fields out of labelled lines of a prompt."""
    prompt = F.concat(F.lit("Ticker: "), F.upper("role"), F.lit("\nName: turn "), "turn", F.lit("\n"), "text")
    p = table(spark, sf, "conversations").select("conv_id", "turn", prompt.alias("prompt"))
    return p.select("conv_id", "turn", T.line_field(F.col("prompt"), "Ticker").alias("ticker"), T.line_field(F.col("prompt"), "Name").alias("name"))


@query(
    """WITH o AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || '{"label": "' || event_type || '"}' || chr(10) || '```' WHEN 1 THEN '{"label": "' || event_type || '",}' WHEN 2 THEN 'I think it is ' || event_type || '.' ELSE 'no idea' END AS out FROM events)
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN regexp_extract(out, '(click|view|purchase|error|signup)', 1) END AS label, CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'keyword' ELSE 'none' END AS how FROM o"""
)
def parsed_answers(spark, sf):
    """Labels out of model answers: fenced or bare JSON, trailing commas mended, else a keyword."""
    k, e = F.col("event_id") % 4, F.col("event_type")
    out = F.when(k == 0, F.concat(F.lit('```json\n{"label": "'), e, F.lit('"}\n```'))).when(k == 1, F.concat(F.lit('{"label": "'), e, F.lit('",}'))).when(k == 2, F.concat(F.lit("I think it is "), e, F.lit("."))).otherwise("no idea")
    words = ["click", "view", "purchase", "error", "signup"]
    answers = table(spark, sf, "events").select("event_id", out.alias("out"))
    got = answers.select("event_id", T.answer_field(F.col("out"), "label").alias("j"), F.nullif(F.regexp_extract("out", f"({'|'.join(words)})", 1), F.lit("")).alias("w"))
    return got.select("event_id", F.coalesce("j", "w").alias("label"), F.when(F.col("j").isNotNull(), "json").when(F.col("w").isNotNull(), "keyword").otherwise("none").alias("how"))


@query(
    r"""SELECT doc_id, len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '[^ \t\r\f\v]'))) AS n_prose, coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"""
)
def line_statistics(spark, sf):
    """Lines of each text, those with something on them and the longest."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    return d.select("doc_id", F.size("l").cast("bigint").alias("n_lines"), F.size(F.filter("l", lambda x: x.rlike(r"[^ \t\r\f\x0B]"))).cast("bigint").alias("n_prose"), F.coalesce(F.array_max(F.transform("l", lambda x: F.length(x))), F.lit(0)).cast("bigint").alias("longest"))


@query(r"SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<a [^>]*href=')) AS n_links FROM pages")
def page_facts(spark, sf):
    """Title and number of links of a page."""
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"<a [^>]*href="), F.lit(0))).cast("bigint").alias("n_links"))


@query(
    r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2)
SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM c) WHERE k <= 8"""
)
def top_words(spark, sf):
    """The eight most frequent words of a language, ties by name."""
    w = table(spark, sf, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    c = w.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return S.keep_top(c, ["lang"], 8, F.desc("n"), "word")


# tags

_TAG_TEXT = "CASE WHEN p_size % 3 = 0 THEN '[\"' || replace(p_name, ' ', '\", \"') || '\", \"US\"]' ELSE replace(p_name, ' ', ', ') || ', usa, , ' || upper(p_name) END"
#: Aliases of tags.
ALIASES = {"usa": "us", "cold": "cool", "widget": "gadget"}


def tag_texts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    as_json = F.concat(F.lit('["'), F.replace(name, F.lit(" "), F.lit('", "')), F.lit('", "US"]'))
    as_list = F.concat(F.replace(name, F.lit(" "), F.lit(", ")), F.lit(", usa, , "), F.upper(name))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 3 == 0, as_json).otherwise(as_list).alias("tags"))


@query(
    """WITH t AS (SELECT p_partkey AS key, string_split(p_name, ' ') AS w, p_size % 3 = 0 AS j, p_name FROM part), x AS (SELECT key, CASE WHEN j THEN list_concat(w, ['US']) ELSE list_concat(w, ['usa', upper(p_name)]) END AS a FROM t)
SELECT key, array_to_string(a, '|') AS tags FROM x"""
)
def parsed_tags(spark, sf):
    """Tags out of JSON or comma lists, without blanks and repeats in any case."""
    return tag_texts(spark, sf).select("key", F.array_join(T.tag_list(F.col("tags")), "|").alias("tags"))


@query(
    f"""WITH x AS (SELECT p_partkey AS key, list_concat(string_split(p_name, ' '), CASE WHEN p_size % 3 = 0 THEN ['us'] ELSE ['usa', p_name] END) AS a FROM part),
m AS (SELECT key, list_transform(a, lambda v: CASE v {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items())} ELSE v END) AS a FROM x) SELECT key, array_to_string(list_filter(a, lambda v: NOT contains(v, ' ')), '|') AS tags FROM m"""
)
def canonical_tags(spark, sf):
    """Tags in lower case, by their aliases, of one word each."""
    lowered = F.transform(T.tag_list(F.col("tags")), lambda x: F.lower(x))
    return tag_texts(spark, sf).select("key", F.array_join(F.filter(T.canonical(lowered, ALIASES), lambda x: ~F.contains(x, F.lit(" "))), "|").alias("tags"))


@query(
    """WITH t AS (SELECT p_type || '/' || p_size AS line, list_sort(list_distinct(list(w))) AS tags FROM (SELECT p_type, p_size, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1)
SELECT a.line AS a, b.line AS b, round(1.0 * len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))), 6) AS jaccard, a.tags = b.tags AS same FROM t a JOIN t b ON a.line < b.line"""
)
def tag_overlap(spark, sf):
    """Overlap of the tag sets of product lines (type and size): a small dimension."""
    w = table(spark, sf, "part").select(F.concat_ws("/", "p_type", "p_size").alias("line"), F.explode(F.split("p_name", " ")).alias("tag"))
    t = w.groupBy("line").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    j = t.select(F.col("line").alias("a"), F.col("tags").alias("x")).join(t.select(F.col("line").alias("b"), F.col("tags").alias("y")), F.col("a") < F.col("b"))
    return rounded(j.select("a", "b", T.jaccard(F.col("x"), F.col("y")).alias("jaccard"), (F.col("x") == F.col("y")).alias("same")))


# labels


@query(
    f"""WITH {EVAL} SELECT doc_id, CASE WHEN quality = predicted THEN 'exact' WHEN toxic = 0 AND predicted = 1 THEN 'partial' ELSE 'mismatch' END AS level FROM ev JOIN labels USING (doc_id, quality)"""
)
def agreement_levels(spark, sf):
    e = evaluated(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), ["doc_id", "quality"])
    same = F.col("quality") == F.col("predicted")
    return e.select("doc_id", F.when(same, "exact").when((F.col("toxic") == 0) & (F.col("predicted") == 1), "partial").otherwise("mismatch").alias("level"))


@query(
    f"""WITH {EVAL}, r AS (SELECT doc_id, lang, 'disagreement' AS part FROM ev WHERE quality <> predicted), c AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('11' || doc_id), doc_id) AS k FROM ev WHERE quality = predicted)
SELECT doc_id, lang, part FROM r UNION ALL SELECT doc_id, lang, 'control' FROM c WHERE k <= 10"""
)
def review_batch(spark, sf):
    """All disagreements and a control sample of ten agreements a language: the sampling operator."""
    e = evaluated(spark, sf)
    no = e.where("quality <> predicted").select("doc_id", "lang", F.lit("disagreement").alias("part"))
    yes = S.keep_top(e.where("quality = predicted").select("doc_id", "lang"), ["lang"], 10, F.md5(F.concat(F.lit("11"), "doc_id")), "doc_id")
    return no.union(yes.withColumn("part", F.lit("control")))


@query(
    """WITH e AS (SELECT doc_id, quality FROM labels WHERE doc_id % 10 = 3) SELECT l.doc_id, coalesce(1 - e.quality, l.quality) AS label, CASE WHEN e.doc_id IS NULL THEN 'model' ELSE 'expert' END AS origin FROM labels l LEFT JOIN e ON e.doc_id = l.doc_id"""
)
def expert_overlay(spark, sf):
    """Experts' labels over a model's; each key once on both sides, or the query fails."""
    base = table(spark, sf, "labels").select("doc_id", "quality")
    expert = base.where("doc_id % 10 = 3").select("doc_id", (1 - F.col("quality")).alias("expert"))
    j = S.join_one_to_one(base, expert, "doc_id", "left")
    return j.select("doc_id", F.coalesce("expert", "quality").alias("label"), F.when(F.col("expert").isNull(), "model").otherwise("expert").alias("origin"))


@query(f"WITH {EVAL} SELECT lang, source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_good, round(avg(quality), 6) AS rate FROM ev GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def label_statistics(spark, sf):
    e = evaluated(spark, sf).groupingSets([["lang", "source"], ["lang"], []], "lang", "source")
    return rounded(e.agg(F.count("*").alias("n"), F.sum("quality").alias("n_good"), F.avg("quality").alias("rate")))


@query(
    """WITH m AS (SELECT conv_id, list(text ORDER BY turn) AS t, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1)
SELECT conv_id, CAST(list_sum(list_transform(t, lambda x: length(x))) AS BIGINT) AS n_tokens, CAST(coalesce(list_sum(list_transform(list_zip(t, r), lambda x: CASE WHEN x[2] = 'assistant' THEN length(x[1]) ELSE 0 END)), 0) AS BIGINT) AS n_trained FROM m"""
)
def token_weights(spark, sf):
    """Characters as tokens with weight 1 where the assistant speaks: the counts of both."""
    return T.weighted_tokens(table(spark, sf, "conversations"))


@query("SELECT role, count(*) AS n, round(1.0 * count(*) / sum(count(*)) OVER (), 6) AS share, count(DISTINCT conv_id) AS n_conversations, round(avg(length(text)), 6) AS mean_length FROM conversations GROUP BY 1")
def role_counts(spark, sf):
    g = table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_conversations"), F.avg(F.length("text")).alias("mean_length"))
    return rounded(g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select("role", "n", (F.col("n") / F.col("total")).alias("share"), "n_conversations", "mean_length"))


# events as signals


@query(
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS value FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM d)
SELECT event_type, round(avg(n) FILTER (k <= 3) / nullif(avg(n) FILTER (k > 3), 0), 6) AS spike, round(100 * (max(CASE WHEN k = 1 THEN value END) / max(CASE WHEN k = 2 THEN value END) - 1), 6) AS move_1d, round(100 * (max(CASE WHEN k = 1 THEN value END) / max(CASE WHEN k = 6 THEN value END) - 1), 6) AS move_5d FROM k GROUP BY 1 HAVING count(*) >= 15"""
)
def volume_spikes(spark, sf):
    """Mean volume of the last three days over that before, and moves over one and five days."""
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    k = d.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day"))))
    at = lambda i: F.max(F.when(F.col("k") == i, F.col("value")))
    recent, prior = F.avg(F.when(F.col("k") <= 3, F.col("n"))), F.avg(F.when(F.col("k") > 3, F.col("n")))
    g = k.groupBy("event_type").agg(F.count("*").alias("rows"), F.try_divide(recent, prior).alias("spike"), (100 * (at(1) / at(2) - 1)).alias("move_1d"), (100 * (at(1) / at(6) - 1)).alias("move_5d"))
    return rounded(g.where("rows >= 15").drop("rows"))


@query(
    """WITH g AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, round(sum(value), 4) AS value FROM events GROUP BY 1)
SELECT user_id, concat_ws(', ', CASE WHEN n >= 5 THEN 'active' END, CASE WHEN kinds >= 3 THEN 'broad' END, CASE WHEN value > 250 THEN 'heavy' END) AS reasons FROM g"""
)
def qualification_reasons(spark, sf):
    """Why a user qualifies, as a list."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.round(F.sum("value"), 4).alias("value"))
    return g.select("user_id", F.concat_ws(", ", F.when(F.col("n") >= 5, "active"), F.when(F.col("kinds") >= 3, "broad"), F.when(F.col("value") > 250, "heavy")).alias("reasons"))


@query("SELECT day, notes FROM (SELECT CAST(ts AS DATE) AS day, left(string_agg(event_type || ' by ' || user_id, ' || ' ORDER BY ts, event_id), 1500) AS notes FROM events GROUP BY 1)")
def daily_notes(spark, sf):
    """A day's notes in order, joined and cut to 1500 characters: the length is the feature."""
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "ts", "event_id", F.concat("event_type", F.lit(" by "), "user_id").alias("note"))
    days = e.groupBy("day").agg(F.count("*")).select("day")
    nth = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))
    first = e.where("note is not null").withColumn("nth", nth).where("nth <= 300")  # with its separator a note has 8 characters at least
    g = first.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "note")))["note"].alias("notes"))
    g = days.join(g, "day", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    return g.select("day", F.left(F.array_join("notes", " || "), F.lit(1500)).alias("notes"))


@query("SELECT day, n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7)")
def latest_days(spark, sf):
    """The last seven days, ascending."""
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(7).orderBy("day")
