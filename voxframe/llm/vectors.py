"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits the vectors again and again at the median of a random projection;
vectors near the cut go to both sides (spill). Near vectors rarely part, and with
several trees hardly ever in all of them. Vectors are compared within leaves,
pairs are verified in double precision, and links are united.

Every vector carries the list of its leaves, so a pair counts only in the first leaf that both
share. A leaf gives the number of links of each of its vectors and the edges of a spanning forest of its
links, never the pairs themselves: what it gives grows with its vectors, however many of them are near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import components, cut

COSINE = 0.98
TREES = 5
LEAF_ROWS = 1_000
FIT_ROWS = 131_072
FIT_LEAF = 16
SPILL = 1.0
TILE = 8_192
STEP = 512
PAIRS = 1 << 19
SEED = 20


def margin(cosine: float, dim: int) -> float:
    """Half width of the spill: SPILL times the spread of a projected pair that is just near enough.

    A pair parts only if its projections differ by over twice this and lie on either side of the cut.
    """
    return SPILL * np.sqrt(max(2 - 2 * cosine, 0.0)) / np.sqrt(dim)


class Top:
    """A tree, fitted on a bounded sample of unit vectors: 2^depth - 1 directions and medians."""

    def __init__(self, sample: np.ndarray, depth: int, tree: int, spill: float):
        self.depth, self.spill = depth, spill
        random = np.random.default_rng([SEED, tree])
        self.ways = random.standard_normal(((1 << depth) - 1, sample.shape[1]))
        self.ways /= np.linalg.norm(self.ways, axis=1, keepdims=True)
        self.cuts = np.zeros(len(self.ways))
        node_of = np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            at = np.einsum("ij,ij->i", sample, self.ways[node_of])
            for node in range((1 << level) - 1, (2 << level) - 1):
                inside = at[node_of == node]
                self.cuts[node] = np.median(inside) if len(inside) else 0.0
            node_of = 2 * node_of + 1 + (at > self.cuts[node_of])

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves that each row falls into."""
        rows, nodes = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
        for _ in range(self.depth):
            at = np.einsum("ij,ij->i", unit[rows], self.ways[nodes]) - self.cuts[nodes]
            left, right = at <= self.spill, at >= -self.spill
            rows = np.concatenate([rows[left], rows[right]])
            nodes = np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        return rows, nodes


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def near_pairs(a: np.ndarray, b: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs with that cosine or more, in blocks of at most STEP rows of `a` and PAIRS pairs.

    All in double precision; what lies within 1e-9 of the limit is worked out again from the vectors as they are.
    """
    ua, ub = unit_rows(a), unit_rows(b)
    step = max(1, min(STEP, PAIRS // max(len(b), 1)))
    for at in range(0, len(a), step):
        alike = ua[at:at + step] @ ub.T
        i, j = np.nonzero(alike >= cosine - 1e-9)
        sure = alike[i, j] > cosine + 1e-9
        i += at
        x, y = a[i[~sure]], b[j[~sure]]
        near = sure.copy()
        near[~sure] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
        yield i[near], j[near]


def earlier_leaves(lists: list[np.ndarray], leaf: int) -> np.ndarray:
    """Bits of the leaves before `leaf` that two rows or more hold, one line of 64-bit words for each row."""
    sizes = np.array([len(x) for x in lists])
    row, held = np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.zeros(0, dtype=np.int64), *lists])
    row, held = row[held < leaf], held[held < leaf]
    names, place, count = np.unique(held, return_inverse=True, return_counts=True)
    bit = np.cumsum(count > 1) - 1
    shared = count[place] > 1
    row, bit = row[shared], bit[place[shared]]
    out = np.zeros((len(lists), -(-int((count > 1).sum()) // 64)), dtype=np.uint64)
    np.bitwise_or.at(out, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def leaf_links(
    vectors: np.ndarray, weights: np.ndarray, lists: list[np.ndarray], one: np.ndarray, two: np.ndarray, leaf: int, cosine: float
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(weight of the links of each row, edges of a spanning forest) between rows `one` and rows `two`, which are the same or apart.

    Links of rows that share an earlier leaf are left to that leaf.
    """
    earlier, same = earlier_leaves(lists, leaf), one is two
    total, group, edges = np.zeros(len(vectors), dtype=np.int64), np.arange(len(vectors)), []
    if earlier.size and (np.bitwise_and.reduce(earlier, axis=0) != 0).any():
        return total, edges  # all rows share an earlier leaf
    for i, j in near_pairs(vectors[one], vectors[two], cosine):
        i, j = one[i], two[j]
        if same:
            i, j = i[i < j], j[i < j]
        new = np.ones(len(i), dtype=bool)
        for word in range(earlier.shape[1]):
            new &= (earlier[i, word] & earlier[j, word]) == 0
        i, j = i[new], j[new]
        for row, weight in ((i, weights[j]), (j, weights[i])):  # sums below 2^53 are exact
            total += np.bincount(row, weight, len(total)).astype(np.int64)
        while len(i := i[apart := group[i] != group[j]]):  # join what is not joined yet, one link for each smaller group
            j = j[apart]
            low, high = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
            tops, at = np.unique(high, return_index=True)
            edges += zip(i[at].tolist(), j[at].tolist())
            onto = np.arange(len(vectors))
            onto[tops] = low[at]
            while (onto[onto] != onto).any():
                onto = onto[onto]
            group = onto[group]
    return total, edges


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def link_vectors(classes: DataFrame, cosine: float = COSINE, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """((node, others), (a, b)): the weight of the near classes of one label of each class, and edges that join them.

    `classes` has (node long, label, v array, copies long). The trees are fitted on at most FIT_ROWS vectors and
    sent to all tasks: 2^depth - 1 directions each, with FIT_LEAF fitted vectors a leaf at least. A leaf is compared in
    tiles of about TILE vectors, every two of them in a task of their own, so a leaf that spill keeps
    from shrinking, or that the sample is too small for, only takes more tasks. What a task gives is
    at most two rows for each of its vectors.
    """
    spark = classes.sparkSession
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n"))
    found = spark.createDataFrame([], "a long, b long, n long")
    for dim, largest in sorted((r.dim, r.n) for r in sizes.collect()):  # few lengths: one embedding model, one length
        rows = classes.where(F.size("v") == dim)
        total = rows.count()
        share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * FIT_ROWS / max(total, 1)) * (1 << 30)))
        depth = int(np.ceil(np.log2(max(largest / LEAF_ROWS, 1))))
        depth = min(depth, int(np.log2(max(min(total, FIT_ROWS) / FIT_LEAF, 1))))
        fitted = min(FIT_ROWS, FIT_LEAF << (depth + 4))
        sample = unit_rows(_stack(rows.where(share).orderBy(F.xxhash64("node")).limit(fitted).select("v").toPandas()["v"]).reshape(-1, dim))
        tops = [Top(sample, depth, t, margin(cosine, dim)) for t in range(trees)]

        def place(batches, tops=tops):
            for pdf in batches:
                unit, found = unit_rows(_stack(pdf["v"]).reshape(len(pdf), -1)), []
                for t, top in enumerate(tops):
                    at, leaf = top.leaves(unit)
                    found.append(np.stack([at, (np.int64(t) << 40) + leaf], axis=1))
                at, leaf = np.concatenate(found).T
                order = np.lexsort((leaf, at))
                yield pdf.assign(leaves=np.split(leaf[order], np.cumsum(np.bincount(at, minlength=len(pdf)))[:-1]))

        kept = f"node long, label {classes.schema['label'].dataType.simpleString()}, v {classes.schema['v'].dataType.simpleString()}, copies long"
        placed = cut(rows.select("node", "label", "v", "copies").mapInPandas(place, f"{kept}, leaves array<long>"))
        counted = placed.select("label", F.explode("leaves").alias("leaf")).groupBy("label", "leaf").agg(F.count(F.lit(1)).alias("n"))
        tiles = counted.select("label", "leaf", F.ceil(F.col("n") / F.lit(float(TILE))).cast("int").alias("parts"))
        tiled = placed.withColumn("leaf", F.explode("leaves")).join(tiles.where("parts > 1"), ["label", "leaf"], "left").na.fill(1, ["parts"])
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        tiled = tiled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        keys = ["label", "leaf", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]

        def compare(key, pdf):
            one = np.flatnonzero(pdf["own"] == key[2])
            two = one if key[2] == key[3] else np.flatnonzero(pdf["own"] == key[3])
            nodes = pdf["node"].to_numpy()
            total, edges = leaf_links(_stack(pdf["v"]), pdf["copies"].to_numpy(), pdf["leaves"].tolist(), one, two, int(key[1]), cosine)
            at = np.flatnonzero(total)
            ends = np.array(edges, dtype=np.int64).reshape(-1, 2)
            mates = pd.array([pd.NA] * len(at) + nodes[ends[:, 1]].tolist(), dtype="Int64")
            return pd.DataFrame({
                "a": np.concatenate([nodes[at], nodes[ends[:, 0]]]), "b": mates, "n": np.concatenate([total[at], np.zeros(len(ends), dtype=np.int64)]),
            })

        found = found.unionByName(tiled.groupBy(*keys).applyInPandas(compare, "a long, b long, n long"))
    found = cut(found)
    others = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    return others, found.where("b IS NOT NULL").select("a", "b")


def near_duplicates(
    rows: DataFrame, cosine: float = COSINE, trees: int = TREES, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each vector.

    Equal vectors of a label are one class, so copies are counted, not paired: a class
    is a node, and its size goes into the links of its neighbours. Vectors that are
    NULL, empty, zero or hold a NULL or a component that is not finite, and those without a
    label, link with nothing; vectors of different lengths neither. `component_id` is the smallest vec_id reached;
    repeated ids count as vectors of their own.
    """
    v = F.col(vector).cast("array<double>")
    sum_ = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x * x))
    linked = F.col(label).isNotNull() & F.coalesce(sum_ > 0, F.lit(False))
    whole = rows.select(
        F.col(vec_id).alias("vec_id"), F.when(linked, F.col(label)).alias("label"), F.when(linked, v).alias("v"),
        F.when(linked, F.xxhash64(F.lit(0), label, vector)).alias("h1"), F.when(linked, F.xxhash64(F.lit(1), label, vector)).alias("h2"),
    )
    whole = cut(whole)
    groups = whole.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    classes = cut(groups.withColumn("node", F.col("h1")))
    links, edges = link_vectors(classes.select("node", "label", "v", "copies"), cosine, trees)
    roots = cut(components(edges))
    known = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = cut(known.select("h1", "h2", "root", "first", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    found = known.join(smallest, "root").select("h1", "h2", "n_links", "component_id")
    alone = F.col("h1").isNull()
    joined = whole.select("vec_id", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
