"""Small tables for the tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def save_docs(spark, path, rows, extra=""):
    """rows: (doc_id, text) or (doc_id, text, lang); written as documents.parquet under path."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        df = df.selectExpr("*", extra)
    df.coalesce(2).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
