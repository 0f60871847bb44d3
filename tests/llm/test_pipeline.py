"""The pipeline's stages, each against its operator's own test or a direct count."""

import collections

import corpus_pipeline as C

from voxframe.llm import decontamination, mixing, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    at, columns = docs, docs.columns
    for n, (name, stage) in enumerate(C.STAGES):
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{n}")
        got = spark.read.parquet(f"{tmp_path}/{n}")
        before, after = at.collect(), got.collect()
        ids = collections.Counter(r.doc_id for r in after)
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.digest(at, labels).collect() if r.toxic}
            want = collections.Counter(r.doc_id for r in before if r.doc_id not in bad)
        elif name == "simhash":
            want = collections.Counter({r.component_id: 1 for r in simhash.near_duplicates(at).collect()})
        elif name == "decontamination":
            bad = {r.doc_id for r in decontamination.digest(at, bench).collect()}
            want = collections.Counter(r.doc_id for r in before if r.doc_id not in bad)
        elif name == "mixing":
            want = collections.Counter({r.doc_id: r.copies for r in mixing.digest(at).collect() if r.copies})
        else:
            want = collections.Counter(r.doc_id for r in before)
            assert {r.shard for r in after} <= set(range(24))
            ids = collections.Counter(r.doc_id for r in after)
        assert ids == want and want
        if n < 4:
            assert got.columns == columns
            rows = collections.Counter(map(tuple, docs.collect()))
            assert set(map(tuple, after)) <= set(rows)
        at = got
    assert collections.Counter(map(tuple, C.run(spark, SF).drop("slot").collect())) == collections.Counter(map(tuple, at.drop("slot").collect()))
