"""What several operators share: cut lineage, Arrow maps, connected components.

Rows are told apart by a number of their own (`ROW`), never by doc_id, so NULL
and repeated ids and rows that repeat in full keep their own results. The number
is fixed by writing it to the shared folder before anything reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

ROW = "__row"
# White space between words: space and the characters 9 to 13
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/voxframe-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read from there.

    Ends the lineage: later steps, or the loss of an executor, never run the
    steps before again. Unlike after checkpoint(), the optimiser then knows the
    true size of what it reads. `clear_scratch` removes the files.
    """
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what `cut` wrote in this application; results not yet stored are then lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def identity(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Columns k1 and k2, 128 bits that tell documents apart by id and text; never NULL."""
    return (
        F.xxhash64(F.lit(0), F.col(doc_id), F.col(text)).alias("k1"),
        F.xxhash64(F.lit(1), F.col(text), F.col(doc_id)).alias("k2"),
    )


def numbered(df: DataFrame) -> DataFrame:
    """Rows with a number of their own, for a plan that is cut right after."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


CHUNK_BYTES = 4 << 20


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, whole texts as UTF-8, NULL as empty) in pieces of `size` bytes, or one text if that is larger."""
    texts = texts.cast(pa.large_binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, [t or b"" for t in texts.slice(at, upto - at).to_pylist()]
        at = upto


def map_texts(
    df: DataFrame, text: str, keep: list[str], make: Callable[[], Callable[[list[bytes]], dict]], schema: str,
    size: int = CHUNK_BYTES,
) -> DataFrame:
    """`keep` unchanged, and one value per text in each column of `schema`.

    `make` runs once in each task and gives the function from texts to columns. One
    map, no shuffle; memory is that of an Arrow batch and `size` bytes of texts.
    """
    names = [part.strip().split(" ")[0] for part in _columns(schema)]
    types = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at, texts in chunks(batch.column(0), size):
                made = fn(texts)
                columns = [pa.array(made[n], type=t) for n, t in zip(names, types)]
                kept = [c.slice(at, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *names])

    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(F.col(text).cast("string").alias("__text"), *keep).mapInArrow(apply, ", ".join([*kept, schema]))


def _columns(schema: str) -> list[str]:
    """The columns of a schema text, split at commas outside of brackets."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reached.

    Each round maps every node to the neighbour (or itself) that comes first in an
    order hashed anew, and contracts the edges by that map: a fixed share of the
    nodes vanishes on average, whatever the shape, and it ends when no edge is
    left. A hub with any share of the edges is a plain aggregate, and its join is
    split by Spark's skew join. Nothing goes to the driver but whether edges are
    left. NULL ends and loops are ignored.
    """
    both_ways = lambda df: df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = cut(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    roots, turn = None, 0
    while roots is None or not left.isEmpty():
        turn += 1
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))
        to = both_ways(left).groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("m"))
        to = cut(to.select("node", F.least("m", place("node"))["n"].alias("to")))
        if roots is None:
            roots = to.select("node", F.col("to").alias("root"))
        else:
            step = to.select(F.col("node").alias("root"), "to")
            roots = cut(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        first = to.select(F.col("node").alias("a"), F.col("to").alias("c"))
        second = to.select(F.col("node").alias("b"), F.col("to").alias("d"))
        left = cut(
            left.join(first, "a").join(second, "b").where("c <> d")
            .select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
        )
    smallest = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(smallest, "root").select("node", F.col("least").alias("root"))
