"""SimHash near-duplicates by multi-index hashing.

Fingerprints are split into segments. Two fingerprints that differ in at most
`radius` bits differ in few bits of at least one segment, so each looks up the
small Hamming ball around its segments in a table of all segments, and what it
finds is verified over all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import components, cut, identity, map_texts

BITS = 64
WORDS = 4
RADIUS = 4
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits: each is 1 if it is set in over half the hashes of the word shingles."""
    spoken = text.lower().split()
    if not spoken:
        return 0
    joined = b" ".join(spoken)
    ends = np.cumsum([len(w) + 1 for w in spoken]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    width = min(words, len(spoken))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts, ends[width - 1:])], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """`keep` and `fp` (the 64 bits as a signed long) of every row; a NULL text counts as empty."""

    def prints(texts: list[bytes]) -> dict:
        return {"fp": np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_texts(docs, text, keep, lambda: prints, "fp long")


def segments(radius: int, parts: int) -> list[tuple[int, int, int]]:
    """(first bit, width, ball radius) of each segment.

    The radii r give sum(r + 1) = radius + 1: were every segment beyond its own
    radius, the whole would be beyond `radius`. A segment with radius -1 is not looked up.
    """
    out, first = [], 0
    for i in range(parts):
        width = (BITS * (i + 1)) // parts - first
        share = (radius + 1) // parts + (i < (radius + 1) % parts)
        out.append((first, width, share - 1))
        first += width
    return out


def ball(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with at most `radius` bits set."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _keys(fp: Column, radius: int, parts: int, around: bool) -> Column:
    """Segment numbers with values: of the fingerprint, or of the balls around its segments."""
    found = []
    for i, (first, width, reach) in enumerate(segments(radius, parts)):
        if reach >= 0:
            value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
            masks = ball(width, reach) if around else [0]
            found.append(F.array(*[value.bitwiseXOR(F.lit(m)) + F.lit(i << 40) for m in masks]))
    return F.concat(*found)


def _near(fps: DataFrame) -> DataFrame:
    """Some links: first and last of the fingerprints that agree outside of four bits.

    Any two of them are at most four bits apart, so no check is needed. Not
    complete; it joins the members of a crowded group, so that the search after
    it has only few links to return for them.
    """
    masks = [0xF << i for i in range(0, BITS, 4)]
    outside = F.array(*[
        F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(~m))).alias("rest"))
        for i, m in enumerate(masks)
    ])
    return (
        fps.select("fp", F.explode(outside).alias("o"))
        .groupBy("o.m", "o.rest").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("a < b").select("a", "b")
    )


def _signed(value: int) -> int:
    value &= (1 << BITS) - 1
    return value - (1 << BITS) if value >> (BITS - 1) else value


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, parts: int = 3) -> DataFrame:
    """(fp, root): the class of every distinct fingerprint, joined by links of at most `radius` bits.

    Complete: every pair within `radius` is met in some segment's table and verified
    over 64 bits inside the join, except pairs already known to be of one class.
    """
    fps = cut(fps.select("fp").where("fp IS NOT NULL").distinct())
    known = fps.select("fp", F.col("fp").alias("root"))
    if radius >= 4:
        first = components(_near(fps)).select(F.col("node").alias("fp"), "root")
        known = fps.join(first, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    known = cut(known)
    entries = known.select(
        F.explode(_keys(F.col("fp"), radius, parts, False)).alias("k"), F.col("fp").alias("fp2"), F.col("root").alias("b")
    )
    probes = known.select(F.explode(_keys(F.col("fp"), radius, parts, True)).alias("k"), "fp", F.col("root").alias("a"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    on = (probes.k == entries.k) & (F.col("fp") < F.col("fp2")) & (F.col("a") != F.col("b")) & (apart <= radius)
    joined = components(probes.join(entries, on).select("a", "b"))
    merged = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return known.join(merged, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, words: int = WORDS, parts: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, k1, k2, fp, root, component_id, kept), one row for each document.

    `component_id` is the smallest doc_id of the class, NULL if it has none; `kept`
    marks the document with that id (the same mark on rows that repeat in doc_id
    and text; k1 and k2 are the hashes that tell documents apart). Texts
    without words have fingerprint zero and are linked like any other. Equal
    fingerprints are one node of the graph, so a group of copies of any size is
    one aggregate. The texts are read once and not returned.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *identity(doc_id, text), F.col(text).alias("text"))
    rows = cut(with_fingerprint(rows, ["doc_id", "k1", "k2"], words=words))
    roots = cut(link_fingerprints(rows, radius, parts))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    firsts = rows.groupBy("fp").agg(first.alias("first"))
    classes = firsts.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
    by_print = roots.join(classes, "root").select("fp", "root", "first")
    return rows.join(by_print, "fp").select(
        "doc_id", "k1", "k2", "fp", "root", F.col("first.doc_id").alias("component_id"),
        ((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The given columns of one document of each class: that with the smallest doc_id.

    Of rows that repeat in doc_id and text one stays, whichever. One shuffle of the texts.
    """
    kept = near_duplicates(docs, radius, words).where("kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    k1, k2 = identity("doc_id", "text")
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    return keyed.join(kept.distinct(), ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")
