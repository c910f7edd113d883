import collections
import math
import re

from finspan.llm import quality_divergence as qd
from tests.llm.helpers import SF, save_docs

SPACES = "[\x20\x09-\x0d]+"


def base(text):
    text = text or ""
    w = [x for x in re.split(SPACES, text) if x]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def js(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0
    return math.sqrt(max(0, sum((part(a, b) + part(b, a)) / 2 for a, b in zip(p, q))))


def distances(rows):
    """doc_id -> (distance of characters, of words), counted plainly."""
    words = {d: [x for x in re.split(SPACES, (t or "").lower()) if x] for d, t, _ in rows}
    df = collections.defaultdict(collections.Counter)
    for d, _, lang in rows:
        df[lang].update({w for w in words[d] if len(w) <= qd.LETTERS and w.isalpha()})
    top = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: qd.COMMON]] for k, c in df.items()}

    def chars(t):
        up = sum(c.isupper() for c in t)
        low = sum(c.islower() for c in t)
        dig, sym, sp = (len(re.findall(p, t)) for p in ("[0-9]", "[#*$%&|<>]", "[\x20\x09-\x0d]"))
        return [low, up, dig, sym, sp, len(t) - up - low - dig - sym - sp]

    bins = {}
    for d, t, lang in rows:
        c = collections.Counter(words[d])
        b = [c[w] for w in top[lang]] + [0] * (qd.COMMON - len(top[lang]))
        bins[d] = chars(t or ""), [*b, len(words[d]) - sum(b)]
    out = {}
    for d, t, lang in rows:
        r = []
        for i in (0, 1):
            total = [sum(x) for x in zip(*(bins[e][i] for e, _, k in rows if k == lang))]
            share = lambda x: [v / max(1, sum(x)) for v in x]
            r.append(js(share(bins[d][i]), share(total)))
        out[d] = r[0] if len(t or "") >= qd.MIN_CHARS else None, r[1] if len(words[d]) >= qd.MIN_WORDS else None
    return out


def check(rows, got):
    want = distances([(d, t, lang or "") for d, t, lang in {r[0]: r for r in rows}.values()])
    by = {}
    for r in got:
        by[r.doc_id] = r
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base({x[0]: x[1] for x in rows}[r.doc_id])
        assert not (r.base_failed and r.kept)
    return want, by


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"])
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    got = qd.judge(docs.selectExpr("doc_id as row", "doc_id", "text", "lang")).collect()
    want, by = check(rows, got)
    for d, (a, b) in want.items():
        for x, y in ((a, by[d].js_chars), (b, by[d].js_words)):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [by[d].kept for d, q in labels.items() if q == 1 and d in by]
    assert sum(good) / len(good) > 0.9


def test_edges(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", None), (3, " \n\t", "en"), (4, "a b c d e " * 4000, "en"), (5, "| # $ % & * < > " * 40, "en"), (6, "one two three four five six seven eight nine ten", None), (6, "one two three four five six seven eight nine ten", None)]
    rows += [(7, "x\n\nx\n y\nx", "de"), (8, "a b c d e a b c d e f", "en"), (None, "the cat sat", "en"), (9, "w " * 5, "en")]
    save_docs(spark, tmp_path, rows, "1 as kept")
    got = qd.op3_quality_divergence(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    check(rows, got)
    save_docs(spark, tmp_path / "none", [])
    assert qd.op3_quality_divergence(spark, str(tmp_path / "none")).count() == 0
    assert qd.keep_good(spark.read.parquet(f"{tmp_path}/documents.parquet")).columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]


def test_clean_documents_without_a_language_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").dropDuplicates(["doc_id"]).orderBy("doc_id").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    lost = [(d, t, lang if d % 4 else (None, "")[d % 8 // 4]) for d, t, lang in rows]
    judged = lambda x: {r.doc_id: r for r in qd.judge(spark.createDataFrame(x, "doc_id bigint, text string, lang string").selectExpr("doc_id as row", "*")).collect()}
    given, got = judged(rows), judged(lost)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [(d, lang) for d, _, lang in rows if d % 4 == 0 and given[d].kept and labels.get(d) != 0]
    assert len({lang for _, lang in clean}) == len({lang for _, _, lang in rows})
    assert [d for d, _ in clean if not got[d].kept] == [] and len(got) == len(rows)
    known = [r for r in lost if r[2]]
    for d, t, lang in lost:
        if not lang and given[d].js_words is not None:  # as one more document of a language, it would count in its reference
            w = [x for x in re.split(SPACES, t.lower()) if x]
            best = min((js(*reference(known, k, w)), k) for k in {r[2] for r in known})[0]
            assert abs(got[d].js_words - best) < 1e-6


def reference(rows, lang, w):
    """Shares of the language's common words, and the other words, in the words w and in all its rows."""
    docs = [[x for x in re.split(SPACES, (t or "").lower()) if x] for _, t, k in rows if k == lang]
    df = collections.Counter(x for d in docs for x in {x for x in d if len(x) <= qd.LETTERS and x.isalpha()})
    top = [x for x, _ in sorted(df.items(), key=lambda x: (-x[1], x[0].encode()))[: qd.COMMON]]
    out = []
    for words in (w, [x for d in docs for x in d]):
        c = collections.Counter(words)
        own = [c[x] for x in top]
        out.append([v / len(words) for v in [*own, *[0] * (qd.COMMON - len(top)), len(words) - sum(own)]])
    return out
