"""Universe, similarity, label, text and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finspan.functions import text as T
from finspan.operators import selection as S
from finspan.operators import similarity as V
from finspan.plans.sqlbase import registry
from finspan.sources import files, sinks
from finspan.sources.panels import rounded, table

QUERIES, ORACLES, query = registry()


SOURCES = """src AS (SELECT c_custkey AS key, c_name AS name, 'customer' AS source, c_acctbal AS value FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', s_acctbal FROM supplier
UNION ALL SELECT p_partkey, p_name, 'part', p_retailprice FROM part)"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(key, name, source, value): three tables in one form."""
    c = table(spark, sf, "customer").selectExpr("c_custkey as key", "c_name as name", "'customer' as source", "c_acctbal as value")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as key", "s_name as name", "'supplier' as source", "s_acctbal as value")
    p = table(spark, sf, "part").selectExpr("p_partkey as key", "p_name as name", "'part' as source", "p_retailprice as value")
    return c.unionByName(s).unionByName(p)


@query(f"WITH {SOURCES} SELECT source, name, key, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY value DESC, key) AS k FROM src) WHERE k = 1")
def union_dedup_sources(spark, sf):
    return rounded(S.keep_first(sources(spark, sf), ["source", "name"], F.desc("value"), "key").select("source", "name", "key", "value"))


SCORES = f"""{SOURCES}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM src), n AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM src),
scored AS (SELECT key, source, name, CAST(key % 7 AS BIGINT) AS tier, round(0.7 * (value - lo) / nullif(hi - lo, 0) + 0.3 / ln(1 + n), 9) AS score FROM n, e)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    s = sources(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("source")))
    s = S.min_max(s, "value")
    return s.select("key", "source", "name", (F.col("key") % 7).cast("bigint").alias("tier"), F.round(0.7 * F.col("value") + 0.3 / F.log1p("n"), 9).alias("score"))


@query(f"WITH {SCORES} SELECT key, source, tier, score FROM scored")
def selection_scores(spark, sf):
    return scored(spark, sf).select("key", "source", "tier", "score")


@query(
    f"""WITH {SCORES}, q(source, quota) AS (VALUES ('customer', 12), ('supplier', 4)), a AS (SELECT s.*, coalesce(row_number() OVER (PARTITION BY tier, s.source ORDER BY score DESC, s.source, key) <= quota, false) AS f FROM scored s LEFT JOIN q ON q.source = s.source),
b AS (SELECT *, 40 - count(*) FILTER (f) OVER (PARTITION BY tier) AS rest, row_number() OVER (PARTITION BY tier, f ORDER BY score DESC, source, key) AS k FROM a)
SELECT key, source, tier, score, CASE WHEN f THEN 'quota' ELSE 'fill' END AS stage FROM b WHERE f OR k <= rest"""
)
def quota_selection(spark, sf):
    chosen = S.quota_selection(scored(spark, sf), "tier", "source", [F.desc("score"), "source", "key"], 40, {"customer": 0.3, "supplier": 0.1})
    return chosen.select("key", "source", "tier", "score", "stage")


@query(
    f"""WITH {SCORES} SELECT key, source, tier, round((rank() OVER (PARTITION BY tier ORDER BY score) + (count(*) OVER (PARTITION BY tier, score) - 1) / 2.0) / count(*) OVER (PARTITION BY tier), 9) AS pct FROM scored"""
)
def rank_pct_in_tier(spark, sf):
    s = scored(spark, sf)
    return s.select("key", "source", "tier", F.round(S.rank_pct(s, "tier", "score"), 9).alias("pct"))


@query(f"WITH {SCORES}, o AS (SELECT name, source, row_number() OVER (PARTITION BY name ORDER BY score DESC, source, key) AS k FROM scored) SELECT name, max(CASE WHEN k = 1 THEN source END) AS source, count(*) - 1 AS n_collapsed FROM o GROUP BY 1")
def universe_collapse(spark, sf):
    """One row a name, with the source of its best row and the number of others."""
    k = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "source", "key"))
    return scored(spark, sf).withColumn("k", k).groupBy("name").agg(F.max(F.when(F.col("k") == 1, F.col("source"))).alias("source"), (F.count("*") - 1).alias("n_collapsed"))


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The query set, every vector whose id is divisible by 20, and all vectors."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return e.where("key % 20 = 0"), e


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id WHERE {COS} >= 0.3")
def pairwise_similarity(spark, sf):
    """Neighbours of the query set among all vectors: a cosine of 0.3 or more."""
    return rounded(V.search(*vectors(spark, sf), 0.3))


@query(f"SELECT a.vec_id, round(1 - avg(abs({COS})), 6) AS uniqueness FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1")
def uniqueness_score(spark, sf):
    return rounded(V.uniqueness(*vectors(spark, sf))).withColumnRenamed("key", "vec_id")


@query(
    r"""WITH m AS (SELECT doc_id, source, lower(unnest(regexp_extract_all(text, '(\p{Lu}\p{L}{2,4})\.', 1))) AS symbol FROM documents)
SELECT symbol, count(*) AS mentions, count(DISTINCT doc_id) AS n_docs, count(DISTINCT source) AS n_sources FROM m GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3"""
)
def candidate_mentions(spark, sf):
    """Short capitalised words at a sentence's end, as candidates, with their evidence."""
    m = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{L}{2,4})\."), F.lit(1))).alias("symbol")).withColumn("symbol", F.lower("symbol"))
    g = m.groupBy("symbol").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_sources"))
    return g.where("n_docs >= 3")


@query(
    r"""WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT domain, count(*) AS n FROM (SELECT CASE WHEN host <> '' THEN array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 1), len(string_split(host, '.'))), '.') END AS domain FROM h) GROUP BY 1"""
)
def url_domains(spark, sf):
    return table(spark, sf, "pages").select(T.domain(F.col("url")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


EVAL = "ev AS (SELECT d.doc_id, d.lang, d.source, l.quality, CASE WHEN d.n_chars >= 300 THEN 1 ELSE 0 END AS predicted FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, source, quality, predicted): labels next to a fixed rule's prediction."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "source", "quality", (F.col("n_chars") >= 300).cast("int").alias("predicted"))


@query(f"WITH {EVAL} SELECT coalesce(source, 'ALL') AS source, count(*) AS n, round(avg(CASE WHEN quality = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ev WHERE quality IS NOT NULL GROUP BY ROLLUP (source)")
def label_agreement(spark, sf):
    e = evaluated(spark, sf).where("quality is not null")
    return rounded(e.rollup("source").agg(F.count("*").alias("n"), F.avg((F.col("quality") == F.col("predicted")).cast("double")).alias("accuracy")).withColumn("source", F.coalesce("source", F.lit("ALL"))))


@query(
    f"""WITH {EVAL}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND predicted = 1) AS tp, count(*) FILTER (quality = 0 AND predicted = 1) AS fp, count(*) FILTER (quality = 1 AND predicted = 0) AS fn FROM ev GROUP BY 1)
SELECT lang, round(1.0 * tp / nullif(tp + fp, 0), 6) AS precision, round(1.0 * tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"""
)
def classifier_scores(spark, sf):
    e = evaluated(spark, sf)
    hit = lambda q, p: F.count_if((F.col("quality") == q) & (F.col("predicted") == p)).cast("double")
    c = e.groupBy("lang").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rounded(c.select("lang", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")))


@query(
    """WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS gold, [split_part(p_name, ' ', 1), CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE 'other' END] AS pred FROM part)
SELECT round(2.0 * sum(len(list_intersect(gold, pred))) / sum(len(list_distinct(gold)) + len(list_distinct(pred))), 6) AS micro_f1, round(avg(CASE WHEN list_sort(gold) = list_sort(pred) THEN 1.0 ELSE 0.0 END), 6) AS exact,
round(avg(1.0 * len(list_intersect(gold, pred)) / len(list_distinct(list_concat(gold, pred)))), 6) AS overlap FROM s"""
)
def micro_f1(spark, sf):
    """Scores of predicted tag sets against the names' words."""
    gold = F.split("p_name", " ")
    pred = F.array(gold[0], F.when(F.col("p_size") % 2 == 0, gold[1]).otherwise("other"))
    s = table(spark, sf, "part").select(gold.alias("gold"), pred.alias("pred"))
    both = F.size(F.array_intersect("gold", "pred"))
    n = F.size(F.array_distinct("gold")) + F.size(F.array_distinct("pred"))
    return rounded(s.agg((2.0 * F.sum(both) / F.sum(n)).alias("micro_f1"), F.avg((F.array_sort("gold") == F.array_sort("pred")).cast("double")).alias("exact"), F.avg(T.jaccard(F.col("gold"), F.col("pred"))).alias("overlap")))


@query(f"WITH {EVAL} SELECT CAST(quality AS VARCHAR) AS quality, CAST(predicted AS VARCHAR) AS predicted, grouping(quality) AS q_all, grouping(predicted) AS p_all, count(*) AS n FROM ev GROUP BY CUBE (quality, predicted)")
def confusion_cube(spark, sf):
    return evaluated(spark, sf).cube("quality", "predicted").agg(F.grouping("quality").cast("bigint").alias("q_all"), F.grouping("predicted").cast("bigint").alias("p_all"), F.count("*").alias("n")).withColumn("quality", F.col("quality").cast("string")).withColumn("predicted", F.col("predicted").cast("string"))


@query(
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7/' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN k <= floor(n * 0.85::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.85::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def stratified_split(spark, sf):
    return S.ordinal_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 7, (0.85, 0.10))


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS example, count(*) FILTER (role = 'assistant') AS n_targets FROM conversations GROUP BY 1")
def training_examples(spark, sf):
    """The messages of a conversation in order, as one example."""
    m = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    line = F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return m.select("conv_id", F.size("m").cast("bigint").alias("n_messages"), F.array_join(line, "\n").alias("example"), F.size(F.filter("m", lambda x: x["role"] == "assistant")).cast("bigint").alias("n_targets"))


@query(
    """WITH a AS (SELECT user_id, event_type, ts, value, event_id FROM events WHERE event_id % 3 <> 0), b AS (SELECT user_id, event_type, ts, value * 2 AS value, event_id FROM events WHERE event_id % 3 <> 1),
u AS (SELECT *, 0 AS g FROM a UNION ALL SELECT *, 1 AS g FROM b) SELECT event_id, user_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY g DESC) AS k FROM u) WHERE k = 1"""
)
def upsert_latest(spark, sf):
    """Old rows with those of a newer batch put over them, in a table that is written and read."""
    e = table(spark, sf, "events")
    old, new = e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1").withColumn("value", F.col("value") * 2)
    path = sinks.shared_folder(spark, "upserted")
    for batch in (old, new):
        sinks.upsert(batch, path, ["event_id"])
    return rounded(sinks.read(spark, path).select("event_id", "user_id", "value"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'old' ELSE 'new' END AS origin FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0")
def insert_if_absent(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    old, new = e.where("event_id % 3 <> 0").withColumn("origin", F.lit("old")), e.where("event_id % 2 = 0").withColumn("origin", F.lit("new"))
    path = sinks.shared_folder(spark, "inserted")
    for batch in (old, new):
        sinks.insert_absent(batch, path, ["event_id"])
    return spark.read.parquet(path)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, CASE WHEN day(CAST(ts AS DATE)) % 3 = 0 THEN 'replaced' ELSE 'first' END AS origin FROM events GROUP BY 1")
def replaced_days(spark, sf):
    """Days' snapshots, some written a second time in place of the first."""
    e = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    path = sinks.shared_folder(spark, "replaced")
    sinks.replace_partitions(e.withColumn("origin", F.lit("first")), path, "day")
    sinks.replace_partitions(e.where(F.dayofmonth("day") % 3 == 0).withColumn("origin", F.lit("replaced")), path, "day")
    return spark.read.parquet(path).select("day", "n", "origin")


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def jsonl_turns(spark, sf):
    """Turns written as lines of JSON and read back."""
    path = sinks.shared_folder(spark, "jsonl")
    turns = table(spark, sf, "conversations")
    sinks.write_jsonl(turns, path)
    return files.read_jsonl(spark, path, turns.schema).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retained_events(spark, sf):
    """Intraday rows of the last seven days; older ones go."""
    return sinks.retained(table(spark, sf, "events"), "ts", 7).select("event_id", "user_id")


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    g = table(spark, sf, "events").groupBy(F.window("ts", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "value")


@query("SELECT s + INTERVAL 1 HOUR * o AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR AS s FROM events), (VALUES (0), (1)) v(o) GROUP BY 1")
def events_sliding(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


@query("SELECT user_id, event_type, min(ts) AS first_ts, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY 1, 2")
def events_dedup(spark, sf):
    """First event of each user and type, with a property out of its JSON."""
    k = F.from_json("props", "struct<k: double>")["k"]
    return rounded(table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"), F.avg(k).alias("mean_k")))
