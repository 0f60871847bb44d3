"""Every registered query against its SQL counterpart."""

import os

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = compare.spark_rows(queries()[name](spark, SF_DIR))
    assert got[1]
    if name in oracle_sql():
        assert compare.difference(got, compare.sql_rows(duck, oracle_sql()[name])) is None


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    corpus = {n for n in queries() if n == "pipeline" or n.startswith("op")}
    assert not set(queries()) - set(oracle_sql()) - corpus


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.loss == pytest.approx(r.alpha * r.ce + (1 - r.alpha) * r.kl, abs=2e-6)


def test_result_does_not_depend_on_partitioning(spark):
    want = None
    for n in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = {
            name: compare.spark_rows(queries()[name](spark, SF_DIR))
            for name in ("throughput", "full_shuffle", "kl_topk", "wer_by_model", "pad_batch")
        }
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
