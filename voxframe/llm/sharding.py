"""Shards of near equal size by histogram sort.

Documents are ordered by a hash of their text, then by a hash of their id, then by a hash of
their row's number. The shard boundaries are found without sorting: exact bytes are counted between
evenly spaced candidate keys over all partitions, each boundary's interval is
cut again at finer candidates, and so on until it holds one unit. Then every row
knows its shard, and the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import ROW, cut, numbered
from voxframe.operators.order import blocked_totals
from voxframe.session import whole_div

SHARDS = 24
TOLERANCE = 0.02
PROBES = 4096
BLOCKS_LOG2 = 10
KEY_BITS = 60
LOW, HIGH = -1, 1 << KEY_BITS
KEYS = ["k1", "k2", "k3"]


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Size, checksum and the two 60-bit keys; a NULL text has size 8, first key -1 and no checksum."""
    digits = lambda c: F.conv(F.substring(c, 1, KEY_BITS // 4), 16, 10).cast("long")
    text_hash = F.md5(F.col(text))
    keyed = docs.withColumn("__hash", text_hash)
    return keyed.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8,
        "text_crc32": F.crc32(F.col(text)),
        "k1": F.coalesce(digits(F.col("__hash")), F.lit(LOW)),
        "k2": digits(F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.coalesce("__hash", F.lit("-"))))),
    }).drop("__hash")


def _crossings(rows: DataFrame, key: str, wanted: list[tuple[int, int]], unit_bytes: int | None) -> list[tuple]:
    """For each (target, bytes before all rows): where its unit lies, found by refining probes.

    Returns (first key of the right side, None), or (None, (key, bytes before it))
    if the unit is a group of more than `unit_bytes` that has to be split inside.
    A unit lies right of a target if its middle does.
    """
    found: list[tuple | None] = [None] * len(wanted)
    places = [(LOW, HIGH, before) for _, before in wanted]
    while open_ := [i for i, f in enumerate(found) if f is None]:
        intervals = sorted({places[i] for i in open_})
        index, low, width = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
        for n, (a, b, _) in enumerate(intervals):
            inside = (F.col(key) >= a) & (F.col(key) < b)
            index, low = F.when(inside, n).otherwise(index), F.when(inside, a).otherwise(low)
            width = F.when(inside, -(-(b - a) // PROBES)).otherwise(width)
        counted = (
            rows.select("size", key, index.alias("n"), low.alias("low"), width.alias("width")).where("n IS NOT NULL")
            .groupBy("n", whole_div(F.col(key) - F.col("low"), F.col("width")).alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.min(key).alias("first"), F.max(key).alias("last"))
            .orderBy("n", "bin").collect()  # at most PROBES counts for each of the shards' boundaries
        )
        bins: dict[int, list] = {}
        for r in counted:
            bins.setdefault(r.n, []).append(r)
        for i in open_:
            target, before = wanted[i][0], places[i][2]
            for r in bins[intervals.index(places[i])]:
                if before + r.bytes >= target:
                    break
                before += r.bytes
            if r.first < r.last:
                places[i] = (r.first, r.last + 1, before)
            elif unit_bytes is not None and r.bytes > unit_bytes:
                found[i] = (None, (r.first, before))
            else:
                found[i] = (r.first + (2 * before + r.bytes < 2 * target), None)
    return found


def boundaries(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """The first (k1, k2, k3) of every shard but the first.

    Equal texts stay together unless their bytes exceed `tolerance` of a shard;
    only such a group is split, between documents, and a group of repeated rows of that size between
    rows. So a boundary is off by half a unit at most: half of `tolerance`, or half a row.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return [(HIGH, LOW, LOW)] * (shards - 1)
    unit, edges = int(tolerance * total / shards), [()] * (shards - 1)
    open_ = {(): [(n, -(-total * (n + 1) // shards), 0) for n in range(shards - 1)]}
    for depth, key in enumerate(KEYS):
        inner: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        for above, cuts in open_.items():
            of_group = rows
            for name, value in zip(KEYS, above):
                of_group = of_group.where(F.col(name) == value)
            found = _crossings(of_group, key, [(t, b) for _, t, b in cuts], unit if depth < len(KEYS) - 1 else None)
            for (n, target, _), (first, group) in zip(cuts, found):
                if group is None:
                    edges[n] = (*above, first, *[LOW] * (len(KEYS) - depth - 1))
                else:
                    inner.setdefault((*above, group[0]), []).append((n, target, group[1]))
        open_ = inner
    return edges


def shard_of(edges: list[tuple[int, ...]]) -> Column:
    """Number of boundaries at or below the row's keys."""
    if not edges:
        return F.lit(0)
    place = lambda values: F.struct(*[v.cast("long").alias(k) for k, v in zip(KEYS, values)])
    at = F.array(*[place([F.lit(v) for v in edge]) for edge in edges])
    return F.size(F.filter(at, lambda e: e <= place([F.col(k) for k in KEYS])))


def shard_documents(
    docs: DataFrame, keep: list[str], shards: int = SHARDS, tolerance: float = TOLERANCE,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """`keep` with size, text_crc32, shard and slot, one row for each document.

    Slots number the rows of a shard from 0 without gaps, along the third key;
    they are counted in blocks of it, so no task holds a shard or all rows that repeat. Rows equal in doc_id
    and text are told apart by their place in the input, so a run over rows dealt otherwise may give
    them, and the slots, to other rows. A NULL text counts as 8 bytes without a checksum. An empty table has no rows.
    `keep` may hold the text, which then moves with its row in that one exchange;
    the columns size, text_crc32, k1, k2, k3, shard, slot of the input are overwritten.
    """
    row_key = F.shiftrightunsigned(F.xxhash64(ROW, "k2"), 64 - KEY_BITS).alias("k3")
    named = numbered(sized(docs, doc_id, text).select(*dict.fromkeys([*keep, "size", "text_crc32", "k1", "k2"])))
    rows = cut(named.withColumn("k3", row_key).drop(ROW))
    placed = rows.withColumn("shard", shard_of(boundaries(rows, shards, tolerance)).cast("int"))
    block = F.shiftright("k3", KEY_BITS - BLOCKS_LOG2)
    slots = blocked_totals(placed, block, ["k3", "k2"], {"slot": F.lit(1).cast("long")}, ["shard"])
    return slots.withColumn("slot", F.col("slot") - 1).drop(*KEYS)


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    placed = shard_documents(docs, ["doc_id"], shards)
    law = [F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")]
    return placed.select("doc_id", "size", "text_crc32", law[0], "shard", "slot", law[1])
