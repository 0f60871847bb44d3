"""Benchmark passages against an edit table over all documents."""

import random

import numpy as np

from voxframe.llm import decontamination as D
from voxframe.llm.queries import QUERIES
from voxframe.llm.words import normal

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in map(normal, (text or "").encode().split()) if w]


def closest(item, text):
    """Least edits between the item and any run of words of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_search():
    random.seed(3)
    for _ in range(200):
        item = [random.randrange(6) for _ in range(random.randrange(1, 90))]
        text = [random.randrange(6) for _ in range(random.randrange(1, 60))]
        edits, start, end = D.search(item, text)
        assert edits == closest(item, text)
        assert 0 <= start <= end <= len(text)
        if start < end:
            assert closest(item, text[start:end]) == edits


def test_planted_edits(spark):
    """Passages with as many random edits as allowed are found, one edit more is not."""
    random.seed(11)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [random.choice(vocab) for _ in range(n)]
    items = [text(random.choice([3, 5, 8, 15, 25, 40, 59])) for _ in range(60)]

    def edited(item, n):
        item = list(item)
        for _ in range(n):
            at, what = random.randrange(len(item)), random.choice("sid")
            item[at:at + (what != "i")] = [] if what == "d" else [f"new{random.random()}"]
        return item

    docs, want = [], set()
    for i, item in enumerate(items):
        for k in range(4):
            passage = edited(item, D.allowed(len(item), D.SIMILARITY) if k else 0)
            doc = text(random.randrange(80)) + passage + text(random.randrange(80))
            docs.append((len(docs), " ".join(w.upper() + random.choice(["", ",", "."]) for w in doc), "x"))
            want.add((len(docs) - 1, i))
    docs += [(None, " ".join(items[0]), None), (500, None, None), (501, "", None), (502, " ... ", None), (503, " ".join(text(200_000)), None)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "--")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, hits string")
    got = D.digest(df, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert (None, 0) in found
    assert len(want & found) >= 0.99 * len(want)
    for d, i in found - want - {(None, 0)}:
        assert closest([normal(w.encode()) for w in items[i]], words(docs[d][1])) <= D.allowed(len(items[i]), D.SIMILARITY)
    for r in got:
        if r.doc_id is not None:
            part = words(docs[r.doc_id][1])[r.start_word:r.end_word]
            assert closest([w.encode() for w in items[r.item_id]], part) == r.edits <= D.allowed(len(items[r.item_id]), 0.8)
    clean = D.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d[0] for d in docs} - {d for d, _ in found}
    assert D.decontaminate(df.limit(0), bench).collect() == []
    assert D.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_recall_of_the_samples_alone():
    """Without the pieces: some window within the allowed shifts shares a sample with its item."""
    random.seed(5)
    index = D.Index([(i, " ".join(f"w{random.randrange(4000)}" for _ in range(random.choice([8, 15, 25, 40, 59])))) for i in range(150)])
    other = lambda n: [random.getrandbits(63) for _ in range(n)]
    met = 0
    for item, n, edits, samples in zip(index.items, index.sizes.tolist(), index.edits.tolist(), index.samples):
        passage = list(item)
        for _ in range(edits):
            at, what = random.randrange(len(passage)), random.choice("sid")
            passage[at:at + (what != "i")] = [] if what == "d" else other(1)
        line = np.array(other(20) + passage + other(100), dtype=np.uint64)
        windows = np.stack([line[20 + s:20 + s + n] for s in range(-edits, edits + 1)])
        met += bool((index.embed(windows, np.full(len(windows), n)) == samples).any())
    assert met >= 0.99 * 150


def test_items_that_repeat_side_by_side(spark):
    random.seed(12)
    vocab = [f"w{i}" for i in range(4000)]
    text = lambda n: [random.choice(vocab) for _ in range(n)]
    item = text(25)
    other = lambda n: [f"between{i}" for i in range(n)]
    changed = item[:9] + ["changed"] + item[10:]
    docs = [(0, item * 3), (1, item + other(6) + item), (2, item + changed + item), (3, text(30) + changed + other(1) + changed + text(30)), (4, item * 40)]
    df = spark.createDataFrame([(d, " ".join(t), "x") for d, t in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word, r.edits) for r in D.digest(df, bench).collect())
    want = [(0, 25 * i, 25 * i + 25, 0) for i in range(3)] + [(1, 0, 25, 0), (1, 31, 56, 0), (2, 0, 25, 0), (2, 25, 50, 1), (2, 50, 75, 0)]
    want += [(3, 30, 55, 1), (3, 56, 81, 1)] + [(4, 25 * i, 25 * i + 25, 0) for i in range(40)]
    assert got == want


def test_all_documents_against_brute_force(spark):
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {
        (d, i) for d, text in docs for i, item in items
        if len(set(item) & set(text)) and D.search(item, text)[0] <= D.allowed(len(item), D.SIMILARITY)
    }
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert want and got == want
