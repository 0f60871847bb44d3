"""Quality, toxicity and language-model scores: held-out accuracy, brute force, odd rows."""

import collections
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxframe.llm import language_model as L
from voxframe.llm import quality, toxicity
from voxframe.llm.common import chunks
from voxframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, held_out string, p string, score string, token string"


def remainder(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def brute_base(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = collections.Counter(w for d, t in rows if remainder(d) != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((d, remainder(d) == 1, len(words), sum(counts[w] > 0 for w in words), n, base))
    return out


def check_base(got, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute_base(rows), key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] <= 0 and math.isfinite(g[6])


def test_language_model(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op9_language_model"](spark, SF).collect()
    check_base(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_tokens_are_joined_exactly(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "The of"), (None, None), (7, ""), (7, ""), (8, "\x1cnever\x85 seen"), (9, "word " * 60_000), (10, "ÉA éA")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    for common in (50, 1):
        check_base(L.score_documents(df, L.held_out(), common=common).collect(), rows)
    assert L.digest(df.limit(0)).collect() == []
    alone = L.digest(df.where("doc_id = 7")).collect()
    check_base(alone, [(7, ""), (7, "")] + [r for r in rows[:-5] if r[0] == 7])


def exact_scores(rows):
    """(doc_id, score): the model with every count looked up in whole tables, and only the levels rounded."""
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    singles, pairs, starts = collections.Counter(), collections.Counter(), 0
    for d, t in rows:
        if remainder(d) != 1:
            words = tokens(t)
            singles.update(words)
            pairs.update(zip(["<start>", *words], words))
            starts += 1
    level = lambda n: L._MEANS[L.level_of(np.array([n]))[0]] if n else 0.0
    whole = sum(singles.values()) + 0.5 * (len(singles) + 1)
    out = []
    for d, t in rows:
        score, before = 0.0, "<start>"
        for w in tokens(t):
            context = level(starts if before == "<start>" else singles[before])
            single = min((level(singles[w]) + 0.5) / whole, 1.0)
            score += math.log10((min(level(pairs[before, w]), context) + L.PRIOR * single) / (context + L.PRIOR))
            before = w
        out.append((d, score))
    return out


def test_scores_against_whole_tables(spark, monkeypatch):
    """Few false reads at the fill of production, and the same scores however many passes there are."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = dict(exact_scores(rows))
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    one = {r.doc_id: (r.score, r.n_tokens) for r in L.digest(df).collect()}
    apart = np.array([abs(one[d][0] - w) / one[d][1] for d, w in want.items()])
    assert apart.mean() < 0.01
    monkeypatch.setattr(L, "MAX_BITS", 100_000)
    several = {r.doc_id: r.score for r in L.digest(df).collect()}
    apart = np.array([abs(several[d] - w) / one[d][1] for d, w in want.items()])
    assert apart.mean() < 0.01


def test_filter_reads_what_was_counted(spark):
    keys = L.mixed(np.arange(1, 40_000, dtype=np.uint64), 4)
    counts = np.random.default_rng(1).zipf(1.6, len(keys)).clip(max=10**6)
    rows = np.empty(len(keys), dtype=L.ENTRY)
    rows["k"], rows["n"] = np.sort(keys), counts
    pieces = (rows["k"] >> np.uint64(60)).astype(int)
    halves = [rows[pieces == p] for p in np.unique(pieces)]
    packed = [(0, int(p), bytearray(part.tobytes())) for p, part in zip(np.unique(pieces), halves)]
    packed += [(0, 3, bytearray(halves[3].tobytes())), (1, 3, bytearray(halves[3].tobytes()))]  # a piece that comes in two parts
    merged = L.merge_counts(spark.createDataFrame(packed, "grp int, piece int, packed binary"))
    table = L.build_filter(merged, 0, 4)
    counts = np.where(pieces == 3, 2 * counts, counts)
    read, level = table.read_counts(rows["k"]), L.level_of(counts)
    assert (read >= L._MEANS[level]).all() and (read == L._MEANS[level]).mean() > 0.98
    absent = table.read_counts(L.mixed(np.arange(10**6, 10**6 + 200_000, dtype=np.uint64), 4))
    assert 0.007 < (absent > 0).mean() < 0.013  # as stated, with no room to spare
    assert len(table.table) * 8 < 1.01 * L.BITS_PER_ENTRY * level.sum() + 64 * 16
    assert L.level_of(np.array([1, 2, 3, 4, 1000])).tolist() == sorted(L.level_of(np.array([1, 2, 3, 4, 1000])).tolist())
    assert (L.level_of(np.arange(1, 10**5)) <= np.arange(1, 10**5)).all()


def test_counts_are_added_up_in_little_memory():
    held = []
    for seed in range(4):
        rows = np.empty(200_000, dtype=L.ENTRY)
        rows["k"] = np.unique(L.mixed(np.arange(300_000 * seed // 2, 300_000 * seed // 2 + 200_000, dtype=np.uint64), 4))
        rows["n"] = seed + 1
        held.append(rows)
    tracemalloc.start()
    got = L.added(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    everything = np.concatenate(held)
    keys, place = np.unique(everything["k"], return_inverse=True)
    assert (got["k"] == keys).all() and (got["n"] == np.bincount(place, everything["n"])).all()
    assert peak < 3 * everything.nbytes
    texts = pa.array(["x" * 300_000] * 12)
    assert [(at, len(part)) for at, part in chunks(texts, L.TEXT_BYTES)] == [(0, 3), (3, 3), (6, 3), (9, 3)]


def odd_rows(spark):
    rows = [(None, "some words"), (1, None), (1, ""), (1, ""), (2, "  \n"), (3, "$$$ &&& " * 20_000), (4, "\x00 é 😀")]
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA), rows


def test_quality(spark):
    got = QUERIES["op6_quality"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in got:
        assert r.held_out == (remainder(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    judged = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in judged]) > 0.88
    df, rows = odd_rows(spark)
    few = spark.createDataFrame([(1, 1, None), (None, 0, 0), (3, None, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for marks in (few, few.limit(0)):
        assert len(quality.digest(df, marks).collect()) == len(rows)
        assert len(toxicity.digest(df, marks).collect()) == len(rows)
    assert quality.digest(df.limit(0), few).collect() == []


def plain_subwords(texts, labels, epochs=2, rate=0.5, dim=4, seed=3):
    """The quality model trained step by step in plain Python; returns the probability of label 1 of a text."""
    random = np.random.default_rng(seed)
    table = random.uniform(-1, 1, (1 << quality.BUCKETS_LOG2, dim)).tolist()
    table = {b: [x / dim for x in row] for b, row in enumerate(table)}
    n, ones = len(labels), sum(labels)
    out = [[0.0, 0.0] for _ in range(dim)]
    bias = [math.log((n - ones + 1) / (n + 2)), math.log((ones + 1) / (n + 2))]

    def shares(text):
        counts = collections.Counter()
        for w in text.split():
            counts.update(quality.features([w])[1].tolist())
        total = sum(counts.values())
        return {b: c / total for b, c in counts.items()}

    def forward(share):
        mean = [sum(c * table[b][k] for b, c in share.items()) for k in range(dim)]
        logits = [sum(m * out[k][y] for k, m in enumerate(mean)) + bias[y] for y in (0, 1)]
        top = max(logits)
        e = [math.exp(v - top) for v in logits]
        return mean, [v / sum(e) for v in e]

    step, steps = 0, epochs * n
    for _ in range(epochs):
        for i in random.permutation(n).tolist():
            share, pace = shares(texts[i]), rate * (1 - step / steps)
            step += 1
            mean, p = forward(share)
            p[labels[i]] -= 1
            back = [out[k][0] * p[0] + out[k][1] * p[1] for k in range(dim)]
            for k in range(dim):
                for y in (0, 1):
                    out[k][y] -= pace * mean[k] * p[y]
            for y in (0, 1):
                bias[y] -= 0.1 * pace * p[y]
            for b, c in share.items():
                for k in range(dim):
                    table[b][k] -= pace * len(share) ** 0.5 * c * back[k]
    return lambda text: forward(shares(text))[1][1]


def test_quality_training_against_plain_steps():
    random = np.random.default_rng(5)
    good, bad = [f"word{i}" for i in range(12)], [f"j{i}nk" for i in range(12)]
    texts = [" ".join(random.choice(good if y else bad, 9)).encode() for y in (1, 0) * 10] + [b"", "é é x".encode()]
    labels = [1, 0] * 10 + [0, 1]
    weights = quality.fit(texts, labels, dim=4, epochs=2)
    score, plain = quality.scorer(weights)()(texts)["score"], plain_subwords(texts, labels)
    assert score.tolist() == pytest.approx([plain(t) for t in texts], abs=1e-9)
    assert (score[:20:2] > 0.5).all() and (score[1:20:2] < 0.5).all()


def plain_logistic(rows, extra, y, seed):
    """One link of the chain: AdaGrad steps with a lasso over dictionaries."""
    random, weights, grown = np.random.default_rng(seed), collections.defaultdict(float), collections.defaultdict(lambda: 1e-8)
    share = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    weights["offset"] = math.log(share / (1 - share))
    rare = min((1 - share) / share, 10.0) ** 0.5
    for _ in range(toxicity.EPOCHS):
        for i in random.permutation(len(rows)).tolist():
            x = {**rows[i], **{f"extra{k}": v for k, v in enumerate(extra[i])}, "offset": 1.0}
            logit = min(max(sum(v * weights[f] for f, v in x.items()), -30), 30)
            error = (1 / (1 + math.exp(-logit)) - y[i]) * (rare if y[i] else 1.0)
            for f, v in x.items():
                g = error * v
                grown[f] += g * g
                pace = toxicity.RATE / math.sqrt(grown[f])
                moved = weights[f] - pace * g
                if isinstance(f, int):
                    moved = math.copysign(max(abs(moved) - pace * toxicity.SPARSE, 0.0), moved)
                weights[f] = moved
    return weights


def test_toxicity_training_against_plain_steps():
    random = np.random.default_rng(6)
    texts = [" ".join(random.choice([f"word{i}" for i in range(30)], 8)).encode() for _ in range(40)]
    y = np.array([[int(b"word3 " in t + b" "), int(b"word7" in t)] for t in texts])
    rows = [dict(zip(b.tolist(), v.tolist())) for b, v in toxicity.texts_seen(texts)]
    first = toxicity.fit_linear(toxicity.texts_seen(texts), np.zeros((40, 0)), y[:, 0].astype(float), 4)
    want = plain_logistic(rows, [[]] * 40, y[:, 0].tolist(), 4)
    assert all(first[f] == pytest.approx(w, abs=1e-9) for f, w in want.items() if isinstance(f, int))
    assert first[-1] == pytest.approx(want["offset"], abs=1e-9)
    extra = random.random((40, 1))
    second = toxicity.fit_linear(toxicity.texts_seen(texts), extra, y[:, 1].astype(float), 5)
    want = plain_logistic(rows, extra.tolist(), y[:, 1].tolist(), 5)
    assert second[-2] == pytest.approx(want["extra0"], abs=1e-9) and second[-1] == pytest.approx(want["offset"], abs=1e-9)
    assert all(second[f] == pytest.approx(w, abs=1e-9) for f, w in want.items() if isinstance(f, int))


def test_word_cache_changes_nothing(spark, monkeypatch):
    from voxframe.llm import words

    weights = np.random.default_rng(0).standard_normal((1 << quality.BUCKETS_LOG2) + 1)
    texts = [b"a b c a", b"", "é x\ty".encode(), b"b c d e f"]
    want = quality.scorer(weights)()(texts)["score"]
    monkeypatch.setattr(words, "REMEMBERED", 2)
    score = quality.scorer(weights)()
    assert [score([t])["score"][0] for t in texts] == pytest.approx(want.tolist())
    buckets, share = quality.counted(b"a b c a")
    assert 1 / (1 + np.exp(-(share @ weights[buckets] + weights[-1]))) == pytest.approx(want[0])


def test_toxicity(spark):
    large = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    learn = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 0)
    known, told = {r.doc_id: r.toxic for r in labels.collect()}, {r.doc_id for r in learn.collect()}
    judged = [r for r in toxicity.digest(docs, learn).collect() if r.doc_id in known and r.doc_id not in told]
    assert np.mean([r.toxic == known[r.doc_id] for r in judged]) > 0.97
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op10_toxicity"](spark, SF).collect()
    assert len(got) == docs.count()
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.toxic}
    df, rows = odd_rows(spark)
    assert toxicity.drop_toxic(df, labels).columns == df.columns
    assert toxicity.drop_toxic(df.limit(0), labels).collect() == []


def test_chain_uses_earlier_categories():
    random = np.random.default_rng(2)
    first = random.random(300) < 0.5
    texts = [("apple " if f else "pear ").encode() + f"x{random.integers(40)}".encode() for f in first]
    models = toxicity.fit_chain(texts, np.stack([first, first], axis=1).astype(int))
    assert [len(m) - (1 << toxicity.BUCKETS_LOG2) for m in models] == [1, 2]
    found = toxicity.scorer(models)()(texts)
    assert ((found["p1"] > 0.5) == first).all() and models[1][-2] > 0
