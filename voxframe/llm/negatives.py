"""Hard negatives by exact integer scores, with Four-Russians tables.

Dimensions stand in groups of eight. For each anchor a table holds the sums of all 256
subsets of a group's components. The candidates' components are cut into bit planes
(two's complement), and eight dimensions of a plane are one byte: an index into the
table. Looking up all groups of a plane and adding, then shifting from plane to plane,
gives the whole inner product.

Anchors and candidates lie in blocks of bounded size, and a block of anchors meets a
block of candidates in one task. The first pass meets only blocks that share a label
and finds the positives; the second one meets all blocks and finds the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import ROW, cut, numbered

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
ANCHORS = 256
CANDIDATES = 8192
GROUP = 8
STEP = 512
BLOCK_SCHEMA = (
    "block long, ids binary, nulls binary, rows binary, labels binary, n int, groups int, planes int, bits binary, "
    "distinct array<long>"
)


def prepared(rows: DataFrame, vec_id: str, embedding: str, label: str, changed_every: int, classes: int) -> DataFrame:
    """(ROW, vec_id, label, v) of the rows that take part: a label, and finite components without NULL.

    The label of every `changed_every`-th id becomes the next of `classes`. Rows with
    components so large that a score could leave a long take no part either:
    |component| * SCALE must stay below sqrt(2^62 / dimensions) (and 2^53, where doubles end).
    """
    bound = F.least(F.lit(2.0 ** 53), F.sqrt(F.lit(2.0 ** 62) / F.greatest(F.size("v"), F.lit(1)))) / SCALE
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound)
    moved = F.when(F.col("vec_id") % changed_every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    named = numbered(rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"),
        F.col(label).cast("long").alias("label"),
    ))
    good = named.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", fits))
    whole = F.transform("v", lambda x: F.floor(x * SCALE))
    return good.select(ROW, "vec_id", moved.alias("label"), whole.alias("v"))


def pack(values: np.ndarray, planes: int | None = None) -> tuple[int, np.ndarray]:
    """(planes, bytes[plane, group, row]) of whole numbers, two's complement; the last plane is the sign."""
    top = int(max(values.max(initial=0), -1 - values.min(initial=0)))
    planes = planes or top.bit_length() + 1
    n, dims = values.shape
    padded = np.zeros((n, -(-dims // GROUP) * GROUP), dtype=np.int64)
    padded[:, :dims] = values
    out = [np.packbits((padded >> b) & 1 == 1, axis=1, bitorder="little").T for b in range(planes)]
    return planes, np.ascontiguousarray(np.stack(out)).reshape(planes, padded.shape[1] // GROUP, n)


def unpack(bits: np.ndarray) -> np.ndarray:
    """The whole numbers of `pack`, row by row, with dimensions filled up to whole groups."""
    planes, groups, n = bits.shape
    out = np.zeros((n, groups * GROUP), dtype=np.int64)
    for b in range(planes):
        plane = np.unpackbits(np.ascontiguousarray(bits[b].T), axis=1, bitorder="little").astype(np.int64)
        out += plane * (-(1 << b) if b == planes - 1 else 1 << b)
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """[group, subset, anchor]: for each anchor the sums of all subsets of a group's eight components.

    32 bits where the sums of a whole plane are sure to fit, else 64.
    """
    n, dims = anchors.shape
    bound = int(np.abs(anchors).sum(axis=1).max(initial=0))
    kind = np.int32 if bound < 1 << 31 else np.int64
    tables = np.zeros((dims // GROUP, 1 << GROUP, n), dtype=kind)
    for g in range(dims // GROUP):
        for j in range(GROUP):
            tables[g, 1 << j:2 << j] = tables[g, :1 << j] + anchors[:, g * GROUP + j].astype(kind)
    return tables


def scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """[row, anchor]: exact inner products, by look-ups and shifts. Dimensions that one side lacks are zero."""
    planes, groups, n = bits.shape
    out = np.zeros((n, tables.shape[2]), dtype=np.int64)
    for at in range(0, n, STEP):  # parts that stay in the processor's cache
        total = out[at:at + STEP]
        for b in range(planes - 1, -1, -1):
            plane = np.zeros(total.shape, dtype=tables.dtype)
            for g in range(min(groups, len(tables))):
                plane += tables[g][bits[b, g, at:at + STEP]]
            total <<= 1
            if b == planes - 1:
                total -= plane
            else:
                total += plane
    return out


def blocks(rows: DataFrame, size: int, by_label: bool) -> DataFrame:
    """The rows packed in blocks of at most `size`, near in label if `by_label`; stored.

    Order and cuts come from (label, row), so a label of any share is spread over as many blocks as it fills.
    Within a block rows stand by vec_id (NULL last) and row.
    """
    n = rows.count()
    near = rows.repartitionByRange(max(1, -(-n // size)), "label", ROW) if by_label else rows
    ordered = near.select(F.spark_partition_id().cast("long").alias("part"), "*").sortWithinPartitions("label", ROW)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, made = [], 0, 0

        def block(part: pa.Table) -> pa.RecordBatch:
            columns = {c: part.column(c).combine_chunks() for c in part.column_names}
            ids, lone = columns["vec_id"].fill_null(0).to_numpy(), columns["vec_id"].is_null().to_numpy(zero_copy_only=False)
            row, label = columns[ROW].to_numpy(), columns["label"].to_numpy()
            order = np.lexsort((row, ids, lone))
            lists = columns["v"]
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            width = int(np.diff(ends).max(initial=0))
            values = np.zeros((len(ids), width), dtype=np.int64)
            places = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
            values[np.repeat(np.arange(len(ids)), np.diff(ends)), places] = lists.flatten().to_numpy()
            planes, bits = pack(values[order])
            number = (int(columns["part"][0].as_py()) << 31) + made
            flat = [number, ids[order].tobytes(), lone[order].tobytes(), row[order].tobytes(), label[order].tobytes(),
                    len(ids), bits.shape[1], planes, bits.tobytes(), np.unique(label).tolist()]
            types = [pa.int64(), *[pa.binary()] * 4, *[pa.int32()] * 3, pa.binary(), pa.list_(pa.int64())]
            names = [c.split(" ")[0] for c in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(flat, types)], names)

        for batch in batches:
            held.append(batch)
            count += len(batch)
            while count >= size:
                whole = pa.Table.from_batches(held)
                yield block(whole.slice(0, size))
                made += 1
                held, count = whole.slice(size).to_batches(), count - size
        if count:
            yield block(pa.Table.from_batches(held))

    return cut(ordered.select("part", ROW, "vec_id", "label", "v").mapInArrow(apply, BLOCK_SCHEMA))


def _read(row: dict, end: str) -> dict:
    """Arrays of one side of a pair of blocks."""
    take = lambda c, t: np.frombuffer(row[c + end], dtype=t)
    shape = (row["planes" + end], row["groups" + end], row["n" + end])
    return {"ids": take("ids", np.int64), "nulls": take("nulls", bool), "rows": take("rows", np.int64),
            "labels": take("labels", np.int64), "bits": take("bits", np.uint8).reshape(shape)}


def _first(got: np.ndarray, allowed: np.ndarray, take: int) -> Iterator[tuple[int, np.ndarray]]:
    """(anchor, rows) for each anchor: its `take` best allowed rows; rows of a block stand in the order of ties."""
    masked = np.where(allowed, got, np.iinfo(np.int64).min)
    if len(masked) > 4 * take:  # only what reaches the take-th best value can be among the first
        floor = np.partition(masked, len(masked) - take, axis=0)[len(masked) - take]
    else:
        floor = np.full(masked.shape[1], np.iinfo(np.int64).min)
    for a in range(masked.shape[1]):
        at = np.flatnonzero((masked[:, a] >= floor[a]) & allowed[:, a])
        yield a, at[np.argsort(-got[at, a], kind="stable")[:take]]


def _meet(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, more: list[str]) -> DataFrame:
    """Pairs (a, c) of block numbers with the contents of both blocks."""
    side = lambda df, key, extra: df.select(F.col("block").alias(key), *[
        F.col(c).alias(f"{c}_{key}") for c in ("ids", "nulls", "rows", "labels", "n", "groups", "planes", "bits", *extra)
    ])
    return pairs.join(side(anchors, "a", more), "a").join(side(candidates, "c", []), "c")


HIT_SCHEMA = "a long, arow long, anchor_id long, place int, vec_id long, row long, score long"


def _hits(found: list[tuple]) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in HIT_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*found)) if found else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names)


def _positives(take: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tables = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                anchors, other = _read(row, "_a"), _read(row, "_c")
                if last != row["a"]:
                    last, tables = row["a"], subset_sums(unpack(anchors["bits"]))
                got = scores(tables, other["bits"])
                allowed = other["labels"][:, None] == anchors["labels"][None, :]
                allowed &= other["rows"][:, None] != anchors["rows"][None, :]
                yield _hits([
                    (row["a"], int(anchors["rows"][a]), int(anchors["ids"][a]), 0,
                     None if other["nulls"][j] else int(other["ids"][j]), int(other["rows"][j]), int(got[j, a]))
                    for a, best in _first(got, allowed, take) for j in best
                ])

    return apply


def _negatives(take: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tables = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                anchors, other = _read(row, "_a"), _read(row, "_c")
                if last != row["a"]:
                    last, tables = row["a"], subset_sums(unpack(anchors["bits"]))
                got = scores(tables, other["bits"])
                apart = other["labels"][:, None] != anchors["labels"][None, :]
                place = {int(r): a for a, r in enumerate(anchors["rows"])}
                found = []
                for wanted in row["wanted_a"]:
                    a = place[wanted["arow"]]
                    column, apart_a = got[:, a], apart[:, a]
                    least = -(-wanted["score"] // 2)  # 50 p <= 100 n <= 95 p in whole numbers
                    most = 95 * wanted["score"] // 100
                    at = np.flatnonzero(apart_a & (column >= least) & (column <= most))
                    if len(at) > 8 * take:
                        edge = np.partition(column[at], len(at) - take)[len(at) - take]
                        at = at[column[at] >= edge]
                    for j in at[np.argsort(-column[at], kind="stable")[:take]]:
                        found.append((
                            row["a"], wanted["arow"], int(anchors["ids"][a]), wanted["place"],
                            None if other["nulls"][j] else int(other["ids"][j]), int(other["rows"][j]), int(column[j])
                        ))
                yield _hits(found)

    return apply


def _ranked(hits: DataFrame, keys: list[str], take: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def mine(
    embeddings: DataFrame, anchors_every: int = 50, changed_every: int = 7, classes: int = 10, positives: int = POSITIVES,
    negatives: int = NEGATIVES, anchor_block: int = ANCHORS, candidate_block: int = CANDIDATES,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are the rows whose id is divisible by `anchors_every`; scores are whole numbers, exact. Every
    anchor is compared with every row. Ties go by vec_id, a NULL id last, rows of equal ids by their place in the
    table; every one of repeated rows is a row of its own, as an anchor too. Vectors of different length
    are compared as if filled up with zeros; an empty vector scores 0. No rows for an empty table.

    A task holds one block of each side, its tables and its scores. What is shuffled is the blocks, once for
    every block they meet, and at most `positives * negatives` rows for each anchor and block of candidates.
    """
    rows = cut(prepared(embeddings, vec_id, embedding, label, changed_every, classes))
    chosen = rows.where(F.col("vec_id") % anchors_every == 0)
    candidates = blocks(rows, candidate_block, by_label=True)
    anchors = blocks(chosen, anchor_block, by_label=True)
    tasks = max(1, min(2048, anchors.count() * candidates.count()))
    labels = lambda df, key: df.select(F.col("block").alias(key), F.explode("distinct").alias("label"))
    sharing = labels(anchors, "a").join(labels(candidates, "c"), "label").select("a", "c").distinct()
    met = _meet(sharing.repartition(tasks, "a", "c"), anchors, candidates, [])
    best = cut(_ranked(met.mapInArrow(_positives(positives), HIT_SCHEMA), ["arow"], positives))
    place = F.struct("arow", F.col("rank").alias("place"), "score")
    wanted = best.groupBy("a").agg(F.collect_list(place).alias("wanted"))
    asked = anchors.join(wanted.withColumnRenamed("a", "block"), "block")
    cells = max(1, candidates.count())
    cell = F.pmod(F.xxhash64("block"), F.lit(cells))
    everywhere = asked.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"))
    grid = everywhere.join(candidates.select(F.col("block").alias("c"), cell.alias("cell")), "cell").select("a", "c")
    met = _meet(grid.repartition(tasks, "a", "c"), asked, candidates, ["wanted"])
    hard = _ranked(met.mapInArrow(_negatives(negatives), HIT_SCHEMA), ["arow", "place"], negatives)
    pairs = best.select("arow", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["arow", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
