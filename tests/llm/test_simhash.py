"""SimHash near-duplicates against brute force."""

import random

import pytest
import xxhash

from voxframe.llm import simhash
from voxframe.llm.common import components
from voxframe.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, k1 string, fp string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """Smallest index reachable from each."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_segments_leave_no_pair_out():
    for radius in (1, 3, 4, 7):
        for parts in (2, 3, 4):
            found = simhash.segments(radius, parts)
            assert sum(w for _, w, _ in found) == 64
            assert sum(r + 1 for _, _, r in found) == radius + 1


def test_links_against_brute_force(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(40)] + [0, 1, 3, 7, 15, 31, (1 << 64) - 1]
    near = [p ^ sum(1 << b for b in random.sample(range(64), random.randrange(8))) for p in base for _ in range(4)]
    crowd = [base[0] ^ sum(1 << b for b in random.sample(range(64), 5)) for _ in range(300)]
    prints = sorted({simhash._signed(p) for p in base + near + crowd})
    got = {r.fp: r.root for r in simhash.link_fingerprints(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    want = brute_components(prints)
    assert len(got) == len(prints)
    assert [got[p] for p in prints] == [prints[i] for i in want]


def test_edge_cases(spark):
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(70_000))
    docs = [
        (5, "One two THREE four five", "en", "x", "y"), (3, "one two three  four\tfive", None, None, None),
        (None, "one two three four five", None, None, None), (9, None, None, None, None), (8, "", None, None, None),
        (8, " \n ", None, None, None), (7, long_text, None, None, None), (2, long_text, None, None, None),
        (11, "über Éa  x", "de", None, None), (11, "über Éa  x", "de", None, None), (12, "lone", None, None, None),
    ]
    df = spark.createDataFrame(docs, SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(docs)
    for r in got:
        texts = [d[1] for d in docs if d[0] == r.doc_id]
        assert r.fp in {simhash._signed(brute_print(t)) for t in texts}
    component = {r.doc_id: r.component_id for r in got}
    assert component == {5: 3, 3: 3, None: 3, 9: 8, 8: 8, 7: 2, 2: 2, 11: 11, 12: 12}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 8, 11, 12]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    assert simhash.drop_near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(None, 3), (4, None), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert got == {n: top(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    prints = [brute_print(t) for _, t in docs]
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, sf_dir).collect()}
    assert got == {d: (f"{p:016x}", docs[i][0]) for (d, _), p, i in zip(docs, prints, want)}
