import collections
import math
import re
import zlib

import numpy as np
from finspan.llm import context_mixing as cm
from tests.llm.helpers import SF, save_docs


def base_of(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score), counted plainly."""
    split = {}
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        split[d] = [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]
    held = {d: d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d in split}
    c = collections.Counter()
    for d, _ in rows:
        if not held[d]:
            c.update(split[d])
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, w in split.items()}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, got = base_of(rows), cm.op6_context_mixing(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # log probabilities


def test_scores_do_not_depend_on_partitions_or_batches(spark, monkeypatch):
    monkeypatch.setattr(cm, "STREAM_BYTES", 200_000)  # several streams
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    keys = {"spark.sql.shuffle.partitions": "2", "spark.sql.execution.arrow.maxBytesPerBatch": "20000"}
    before = {k: spark.conf.get(k) for k in keys}

    def scores(docs):
        return sorted((r.doc_id, r.n_tokens, r.base_score, r.score) for r in cm.fit_and_score(docs, f"not ({cm.HELD_OUT})").collect())

    one = scores(docs)
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert scores(docs.repartition(7)) == one
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_twins_are_told_apart(spark):
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 7))
    common_words = [word() for _ in range(50)]
    text = lambda: " ".join(word() if r.random() < 0.3 else common_words[r.integers(50)] for _ in range(120))
    rows = [(i, text()) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x.score for x in cm.fit_and_score(docs, "true").collect()}
    assert max(got[i] for i in range(10, 60)) < min(got[i] for i in range(10))


def test_edges(spark, tmp_path):
    rows = [(1, None), (3, ""), (4, "the cat\x1csat\nthe  cat"), (5, "é" * 3000), (8, "x y " * 5000), (None, "the"), (9, "\n \t"), (10, "A" * 2000), (11, "q")]
    rows += [(i, "the cat and dog") for i in range(20, 40)]
    save_docs(spark, tmp_path, rows, "1 as score")
    want = base_of(rows)
    for r in cm.op6_context_mixing(spark, str(tmp_path)).collect():
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 and math.isfinite(r.score)
    save_docs(spark, tmp_path / "none", [])
    assert cm.op6_context_mixing(spark, str(tmp_path / "none")).count() == 0
    save_docs(spark, tmp_path / "untrained", [(None, "a b")])
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in cm.op6_context_mixing(spark, str(tmp_path / "untrained")).collect()] == [(3, 0, 0)]


def test_two_values_of_a_bit_sum_to_one():
    r = np.random.default_rng(1)
    m = cm.Mixer(1000, 3, 4)
    for _ in range(5):
        slots, gate, bit = r.integers(0, 1000, (3, 400)), r.integers(0, 4, 400), r.integers(0, 2, 400)
        a, known = m.predict(slots, gate, bit)
        b, _ = m.predict(slots, gate, 1 - bit)
        assert np.allclose(2.0**a + 2.0**b, 1)
        m.learn(known)


def test_spellings_of_a_prefix_sum_to_one():
    s = cm.Speller([b"the", b"cat", b"sat"] * 9)
    s.log2([b"mat", b"that", b"hat"] * 30, True)
    b = cm.bits_of([b"th" + bytes([x]) for x in range(256)], s.code)
    log2, _ = s.mixer.predict(b.slots, b.gate, b.bit)
    lengths, total = s.code[0], 0
    for sym in range(256):
        at = b.begin[sym] + lengths[ord("t")] + lengths[ord("h")]
        total += 2 ** log2[at : at + lengths[sym]].sum()
    assert abs(total - 1) < 1e-6


def plain(word, cls, sizes, n_learn_docs, code):
    """token_log2 by a loop over tokens and bits, with contexts kept as they are instead of hashed."""
    docs, at = [], 0
    for n in sizes:
        docs.append((word[at : at + n].tolist(), cls[at : at + n].tolist()))
        at += n
    batches, held = [], []
    for d, (w, _) in enumerate(docs):
        held.append(d)
        if sum(len(docs[x][0]) for x in held) >= cm.BATCH or d in (n_learn_docs - 1, len(docs) - 1):
            batches.append(held)
            held = []
    counts, weights, curve, ones, seen = {}, {}, {}, collections.Counter(), collections.Counter()
    last = [{} for _ in cm.GUESSES]  # context -> (word, whether the guess there was right)
    out = []
    for batch in batches:
        log = []
        bits = [[], []]
        for d in batch:
            w, k = docs[d]
            own = [{} for _ in cm.GUESSES]
            runs, fresh = [0] * len(cm.GUESSES), 0
            for i in range(len(w)):
                back = lambda n: w[i - n] + 1 if i >= n else 0  # noqa: E731, B023
                kind = lambda n: k[i - n] + 1 if i >= n else 0  # noqa: E731, B023
                share = (1 + min(6, round(12 * fresh / i)) if i else 0) * 4 + min(i // 32, 3)
                done, tried, cost = False, None, []
                for g, order in enumerate(cm.GUESSES):
                    ctx = tuple(back(n) for n in range(1, order + 1))
                    source = own[g].get(ctx) or last[g].get(ctx)
                    hit = source is not None and source[0] == w[i]
                    if source is not None and not done and source[0] != tried:
                        run = min(runs[g], 15)
                        before = source[1]
                        cost.append((g, ("g", g), 16 * g + run, hit, [run * 2 + before, (kind(1), run), (share, before), back(1), (source[0], run > 0)]))
                        done, tried = hit, source[0]
                    runs[g] = runs[g] + 1 if hit else 0
                    own[g][ctx] = (w[i], hit)
                if not done:
                    for n in range(code[0][k[i]]):
                        node = int(code[1][k[i], n])
                        cost.append((2, node, 32 + min(n, 31), bool(code[2][k[i], n]), [0, kind(1), (kind(1), kind(2)), share, back(1)]))
                fresh += k[i] == 0
                out.append(0.0)
                log += [(len(out) - 1, *x) for x in cost]
            if d < n_learn_docs:
                for g in range(len(cm.GUESSES)):
                    last[g].update(own[g])
        learn = batch[0] < n_learn_docs
        for step in range(3):
            todo, grads = [], collections.defaultdict(lambda: np.zeros((2, 6)))
            for token, s, what, gate, bit, contexts in log:
                if s == step:
                    keys = [(j, what, c) for j, c in enumerate(contexts)]
                    n = [counts.get(x, (0, 0)) for x in keys]
                    gate = gate * 3 + (sum(n[-1]) > 0.5) + (sum(n[-1]) > 8.5)
                    x = np.array([math.log((b + 0.2) / (a + 0.2)) for a, b in n] + [1.0])
                    z = float(np.clip(x @ weights.setdefault(gate, np.array([1.2 / 5] * 5 + [0.0])), -12, 12))
                    p = 1 / (1 + math.exp(-z))
                    cell = (gate, int(np.clip(np.rint((z + 8) * 2), 0, 32)))
                    t = 0.5 * seen[cell] / (seen[cell] + 400)
                    q = min(1 - 1e-6, max(1e-6, (1 - t) * p + t * (ones[cell] + 1e-3) / (seen[cell] + 2e-3)))
                    out[token] += math.log2(q if bit else 1 - q)
                    todo.append((keys, gate, bit, x, p, cell))
            if learn and todo:
                for keys, gate, bit, x, p, cell in todo:
                    for key in keys:
                        a, b = counts.get(key, (0, 0))
                        counts[key] = (a + (not bit), b + bit)
                    ones[cell] += bit
                    seen[cell] += 1
                    grads[gate] += [p * (1 - p) * x * x, (bit - p) * x]
                for gate in range(3 * 64):
                    curve[gate] = curve.get(gate, np.full(6, 30.0)) * 0.98
                for gate, (more, pull) in grads.items():
                    curve[gate] += more
                    weights[gate] = weights[gate] + np.clip(pull / curve[gate] / 3, -0.2, 0.2)
    return out


def test_tokens_equal_plain_loop(monkeypatch):
    monkeypatch.setattr(cm, "BATCH", 60)
    r = np.random.default_rng(5)
    sizes = np.array([40, 1, 25, 70, 30, 20, 33])
    word = r.integers(0, 12, sizes.sum())
    word[80:110] = word[5:35]
    cls = np.array([0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6, 6])[word]
    code = cm.prefix_code(np.bincount(cls, minlength=256))
    got, done = cm.token_log2(word, cls, sizes, 5, code)
    assert np.allclose(got, plain(word, cls, sizes, 5, code), atol=1e-3) and done.any()


def test_adapted_equals_plain_loop():
    r = np.random.default_rng(3)
    sizes = np.array([5, 1, 30, 7, *[12] * 9])
    word, log10 = r.integers(0, 5, sizes.sum()), -r.random(sizes.sum()) * 4 - 0.1
    before = np.array([sum(word[a:i] == word[i]) for a, n in zip(np.cumsum(sizes) - sizes, sizes) for i in range(a, a + n)])
    got, at = cm.adapted(log10, before, sizes), 0
    for n, g in zip(sizes, got):
        logit, seen, total = cm.OWN_BEGIN, collections.Counter(), 0.0
        for i in range(n):
            w, model = word[at + i], 10 ** log10[at + i]
            a, own = (1 / (1 + math.exp(-logit)), seen[w] / i) if i else (0, 0)
            p = a * own + (1 - a) * model
            logit += cm.OWN_RATE * a * (1 - a) * (own - model) / p if i else 0
            logit = min(8, max(-8, logit))
            seen[w] += 1
            total += math.log10(p)
        at += n
        assert abs(total - g) < 1e-9


def test_held_out_text_is_scored_by_the_documents_of_all_streams(spark, monkeypatch):
    monkeypatch.setattr(cm, "STREAM_BYTES", 500)  # about a stream for each document
    r = np.random.default_rng(4)
    vocabulary = [bytes(r.integers(97, 123, 6).astype(np.uint8)).decode() for _ in range(60)]
    learn_ids = [d for d in range(4000) if zlib.crc32(str(d).encode()) % 7 != 2][:60]
    held = next(d for d in range(4000) if zlib.crc32(str(d).encode()) % 7 == 2)
    text = " ".join(vocabulary)

    def score(others):
        rows = [(d, " ".join(r.permutation(vocabulary)) if n % 30 else others) for n, d in enumerate(learn_ids)] + [(held, text)]
        got = {x.doc_id: x for x in cm.fit_and_score(spark.createDataFrame(rows, "doc_id bigint, text string"), f"not ({cm.HELD_OUT})").collect()}
        return got[held].score, got[held].base_score

    known, base = score(text)  # two of sixty documents have its order, wherever they were dealt to
    shuffled, same = score(" ".join(vocabulary[::-1]))
    assert abs(base - same) < 1e-6 and known > 0.8 * shuffled and known > base


def _stream(k, docs, learn, leads):
    words = np.concatenate([np.append(cm.common.word_hashes(np.frombuffer(t, np.uint8))[0], cm.END_HASH) for t in docs])
    hashes = np.unique(words)
    return cm.Stream.of(k, docs, np.array(learn), hashes, np.full(len(hashes), 5), np.full(len(hashes), leads))


def test_what_streams_tell_adds_up_in_any_order():
    streams = [_stream(k, [b"the cat sat %d" % k, b"on the mat"] * 9, [True] * 18, k == 0) for k in range(3)]
    mass = np.zeros(256)
    mass[3] = 9
    code, spelling = cm.prefix_code(mass), cm.prefix_code(np.ones(256, int))
    tables = []
    for order in (streams, streams[::-1]):
        f = cm.Followers()
        for s in order:
            f.learn(s.stream, s.hashes[s.word], s.first)
        tables.append(f.table)
    assert (tables[0] == tables[1]).all()
    one = cm.Followers(tables[0])
    parts = [cm.learned(s, one, code, spelling) for s in streams]
    n = len(cm.new_mixer().told())
    total = sum(parts)
    whole = cm.new_mixer().take(total[:n])
    assert whole.counts.real.sum() + whole.counts.imag.sum() == sum(p[: 2 * len(whole.counts)].sum() for p in parts) > 0
    assert (sum(parts[::-1]) == total).all()
    own = cm.new_mixer()
    own.counts = (parts[1][: len(own.counts)] + 1j * parts[1][len(own.counts) : 2 * len(own.counts)]).astype(np.complex64)
    assert (whole.without(own.counts).counts == cm.new_mixer().take((parts[0] + parts[2])[:n]).counts).all()


def test_nothing_is_kept_by_word_or_by_document(spark, tmp_path, monkeypatch):
    """Rows for each word of a stream took more memory than an executor has."""
    monkeypatch.setattr(cm.common, "shared_dir", lambda _, what: f"{tmp_path}/{what}")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert cm.fit_and_score(docs, "true").count() == docs.count()
    assert {p.name: spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()} == {"token-streams": cm.LEAST_STREAMS, "word-counts": cm.LEAST_STREAMS}


TEXTS = [b"The cat\x1csat\n\tthe  cat", b"", b" \n", "É é z".encode(), b"x " * 40 + b"A" * 300, b"the cat"]


def test_streams_are_read_as_they_were_made(monkeypatch):
    made = cm.Stream.of(3, TEXTS, np.array([True] * 4 + [False] * 2))
    (read, ids), = cm.Stream.read([made.row([5, None, 7, 8, 9, 10])])
    assert ids == [5, None, 7, 8, 9, 10] and read.stream == 3 and read.spelt == made.spelt
    assert all((getattr(read, k) == getattr(made, k)).all() for k in ("learn", "n_bytes", "sizes", "word", "hashes", "ends"))
    low = [bytes(x + 32 if 65 <= x <= 90 else x for x in t) for t in TEXTS]
    words = [w for t in low for w in [*re.findall(rb"[^\x20\x09-\x0D]+", t), b"\n"]]
    assert read.spell(read.word) == words and made.n_bytes.tolist() == [len(t) for t in TEXTS]


def test_words_are_counted_over_streams():
    streams = [cm.Stream.of(k, [t + b" w%d" % k for t in TEXTS], np.array([True] * k + [False] * (6 - k))) for k in range(3)]
    rows = [r for s in streams for r in cm.words_by_range([s.row([0] * 6)], 6)]
    parts = cm.pa.Table.from_batches(rows).to_pandas()
    found = [cm.counted_words(cm.pa.Table.from_pandas(g, preserve_index=False)) for _, g in parts.groupby("part")]
    found = cm.pa.concat_tables(found).to_pandas()
    want = sum((collections.Counter(s.spell(s.word[: s.n_learn])) for s in streams), collections.Counter())
    first, mass, kinds = collections.Counter(), np.zeros(cm.CLASSES + 1), np.zeros(cm.CLASSES + 1)
    for s in streams:
        out = cm.whole_counts(cm.pa.Table.from_pandas(found[found.stream == s.stream], preserve_index=False)).to_pylist()[0]
        counts, leads = cm._unpacked(out["counts"], np.int64), cm._unpacked(out["leads"], bool)
        spelt = s.spell(np.arange(len(s.hashes)))
        assert counts.tolist() == [want[w] for w in spelt]
        own = set(s.spell(s.word[: s.n_learn]))
        first.update(w for w, x in zip(spelt, leads) if x)
        assert all(w in own or not want[w] for w, x in zip(spelt, leads) if x)
        mass, kinds = mass + out["mass"], kinds + out["kinds"]
    assert set(first.values()) == {1} and set(first) == {w for s in streams for w in s.spell(s.word)}
    assert mass.sum() == sum(want.values()) and kinds[1:].sum() == len(want) and kinds[0] == len(first) - len(want)


def test_many_bits_are_counted_as_batch_by_batch():
    r = np.random.default_rng(2)
    one, other = cm.Mixer(1000, 3, 4), cm.Mixer(1000, 3, 4)
    parts = [(r.integers(0, 300, (3, n)) + np.array([[0], [300], [600]]), r.integers(0, 2, n)) for n in (50, 1, 0, 200)]
    for slots, bit in parts:
        one.count(slots, bit)
    other.count_all([s for s, _ in parts], [b for _, b in parts])
    assert (one.counts == other.counts).all() and one.counts.any()


def test_adapted_is_the_same_however_few_go_on_alone(monkeypatch):
    r = np.random.default_rng(6)
    sizes = np.append(r.integers(1, 60, 40), [1, 300])
    log10, before = -r.random(sizes.sum()) * 400, r.integers(0, 2, sizes.sum())
    before[np.cumsum(sizes) - sizes] = 0
    got = []
    for few in (0, 1, 5, 30, 99):
        monkeypatch.setattr(cm, "FEW", few)
        got.append(cm.adapted(log10, before, sizes))
    assert all(np.allclose(x, got[0], rtol=1e-12) for x in got)
