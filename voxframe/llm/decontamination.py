"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, edit check.

A CGK walk reads a sequence with a pointer that moves or stays by a random bit of
the symbol under it, so two sequences at a small edit distance soon read the same
symbols again: edit distance becomes Hamming distance. Equal samples of the
embedding's places are an LSH for it. Windows of the size of an item are embedded
with the item's walks, and what shares a sample is checked by its exact edit
distance in words.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import map_texts
from voxframe.llm.words import Words, hashed, mixed, normal, shingled

SIMILARITY = 0.8
WALKS = 4
SAMPLES = 10
PLACES = 3
STRETCH = 3
PIECE = 4
FILTER_LOG2 = 22
BLOCK_BYTES = 16 << 20


def word_ids(text: str) -> np.ndarray:
    words = [normal(w) for w in text.encode().split()]
    return hashed([w for w in words if w])


def allowed(n: int, similarity: float) -> int:
    """Edits that leave `similarity` of n words."""
    return int(np.floor((1 - similarity) * n + 1e-9))


def search(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the place in `text` closest to `pattern`, the first on ties.

    Bit-parallel approximate search (Myers 1999): one word of the text moves a
    whole column of the distance table.
    """

    def ends(p: list[int], t: list[int], free: int) -> list[int]:
        bits: dict[int, int] = defaultdict(int)
        for i, w in enumerate(p):
            bits[w] |= 1 << i
        full, top = (1 << len(p)) - 1, 1 << (len(p) - 1)
        up, down, score, out = full, 0, len(p), []
        for w in t:
            eq = bits.get(w, 0)
            level = (((eq & up) + up) ^ up) | eq | down
            rise, fall = (down | ~(level | up)) & full, up & level
            score += bool(rise & top) - bool(fall & top)
            rise, fall = (rise << 1 | free) & full, (fall << 1) & full
            up, down = (fall | ~(level | rise)) & full, rise & level
            out.append(score)
        return out

    scores = ends(pattern, text, 0)
    best = min(scores)
    end = scores.index(best) + 1
    back = ends(pattern[::-1], text[:end][::-1], 1)
    return best, end - 1 - back.index(best), end


class Index:
    """Items of one block: their pieces, walks and samples. Its size is bounded by BLOCK_BYTES of texts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, seed: int = 7):
        self.similarity, self.seed = similarity, seed
        known = [(i, ids) for i, t in items if len(ids := word_ids(t or ""))]
        self.names, self.items = [i for i, _ in known], [ids for _, ids in known]
        self.sizes = np.array([len(ids) for ids in self.items], dtype=np.int64)
        self.edits = np.array([allowed(n, similarity) for n in self.sizes], dtype=np.int64)
        # A window within e edits of an item holds one of e + 1 pieces of it unchanged
        seeds = defaultdict(list)
        for k, (ids, e) in enumerate(zip(self.items, self.edits)):
            width = min(PIECE, len(ids) // (e + 1))
            grams = shingled(ids, width)
            for p in range(e + 1):
                at = p * len(ids) // (e + 1)
                seeds[width].append((int(grams[at]), k, at))
        self.seeds = {}
        for width, rows in seeds.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], dtype=np.uint64)
            found = np.zeros(1 << FILTER_LOG2, dtype=bool)
            found[hashes >> np.uint64(64 - FILTER_LOG2)] = True
            self.seeds[width] = (hashes, found, np.array([r[1:] for r in rows], dtype=np.int64))
        random = np.random.default_rng(seed)
        self.places = random.random((WALKS, SAMPLES, PLACES))
        if known:
            longest = int(self.sizes.max())
            padded = np.zeros((len(self.items), longest), dtype=np.uint64)
            for k, ids in enumerate(self.items):
                padded[k, :len(ids)] = ids
            self.samples = self.embed(padded, self.sizes)

    def embed(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(row, walk, sample): hash of the sampled places of the CGK embedding of each row's first `sizes` symbols."""
        out = np.zeros((len(rows), WALKS, SAMPLES), dtype=np.uint64)
        steps = STRETCH * int(sizes.max(initial=0))
        line = np.arange(len(rows))
        for walk in range(WALKS):
            at = np.zeros(len(rows), dtype=np.int64)
            read = np.zeros((len(rows), steps), dtype=np.uint64)
            for step in range(steps):
                inside = at < sizes
                symbol = np.where(inside, rows[line, np.minimum(at, rows.shape[1] - 1)], np.uint64(0))
                read[:, step] = symbol
                at += inside & (mixed(symbol, 1 + walk * 100_003 + step) >> np.uint64(63)).astype(bool)
            for sample in range(SAMPLES):
                for place in self.places[walk, sample]:
                    where = (place * STRETCH * sizes).astype(np.int64)
                    out[:, walk, sample] = out[:, walk, sample] * np.uint64(0x9E3779B97F4A7C15) + read[line, where]
        return out

    def hits(self, ids: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) in a run of words; start and end count along the run."""
        windows = []
        for width, (hashes, found, rows) in self.seeds.items():
            grams = shingled(ids, width)
            near = np.flatnonzero(found[grams >> np.uint64(64 - FILTER_LOG2)])
            near = near[text_of[near] == text_of[near + width - 1]]
            lo, hi = np.searchsorted(hashes, grams[near], "left"), np.searchsorted(hashes, grams[near], "right")
            times = hi - lo
            row = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at = np.repeat(near, times)
            item, offset = rows[row, 0], rows[row, 1]
            windows.append(np.stack([text_of[at], item, at - offset], axis=1))
        windows = np.unique(np.concatenate(windows), axis=0) if windows else np.zeros((0, 3), dtype=np.int64)
        if not len(windows):
            return []
        shifts = 2 * self.edits[windows[:, 1]] + 1
        spread = np.repeat(windows, shifts, axis=0)
        spread[:, 2] += np.arange(shifts.sum()) - np.repeat(np.cumsum(shifts) - shifts, shifts) - self.edits[spread[:, 1]]
        spread = np.unique(spread, axis=0)
        limits = np.searchsorted(text_of, np.arange(text_of[-1] + 2))
        passed = [self._alike(part, ids, limits) for part in np.array_split(spread, -(-len(spread) // 20_000))]
        return self._checked(np.concatenate(passed), ids, limits)

    def _alike(self, windows: np.ndarray, ids: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The windows that share a sample with their item."""
        text, item, start = windows.T
        first, last = np.maximum(start, limits[text]), limits[text + 1]
        sizes = np.minimum(self.sizes[item], last - first)
        reach = np.arange(int(self.sizes[item].max(initial=1)))
        rows = ids[np.minimum(first[:, None] + reach, len(ids) - 1)]
        rows = np.where(reach < sizes[:, None], rows, np.uint64(0))  # a window that ends with its text is filled up
        return windows[(self.embed(rows, self.sizes[item]) == self.samples[item]).any(axis=(1, 2))]

    def _checked(self, windows: np.ndarray, ids: np.ndarray, limits: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Every place: the best one of each region of windows, then those left and right of it, until none is within the edits."""
        out, at = [], 0
        while at < len(windows):
            text, item, first = windows[at]
            n, e = self.sizes[item], self.edits[item]
            upto = at + 1
            while upto < len(windows) and (windows[upto, :2] == windows[at, :2]).all() and windows[upto, 2] <= windows[upto - 1, 2] + n:
                upto += 1
            pattern, open_ = self.items[item].tolist(), [(max(first - e, limits[text]), min(windows[upto - 1, 2] + n + e, limits[text + 1]))]
            while open_:
                begin, stop = open_.pop()
                if stop - begin < n - e:
                    continue
                edits, start, end = search(pattern, ids[begin:stop].tolist())
                if edits <= e:
                    out.append((int(text), int(item), int(begin + start), int(begin + end), edits))
                    open_ += [(begin + end, stop), (begin, begin + start)]
            at = upto
        return sorted(out)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """(doc_id or `keep`, hits: array<struct<item_id, start, end, edits>>) of the documents that hold an item.

    A hit is a place at most (1 - similarity) times the item's words away from it
    in word edits; words are compared without case and outer punctuation, and
    `start`, `end` count the words that are more than punctuation. Copies of an
    item in one document are hits of their own, also where one follows the other at once; hits of an item do not overlap. The benchmark is taken in
    blocks of bounded size, each sent to all tasks, against all documents: one
    map for each block, no shuffle. Only windows that hold a piece of their item
    unchanged are embedded, which loses none within the edits allowed. NULL or empty texts and
    items match nothing; equal items are each reported.
    """
    keep = keep or [doc_id]
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    of_block = F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks))
    out = None
    for n in range(blocks):
        rows = benchmark.where(of_block == n).select(F.col(item_id).cast("long"), F.col(item_text)).collect()
        index = Index(sorted([tuple(r) for r in rows], key=str), similarity)

        def make(index=index):
            vocab = Words(lambda new: [hashed(k := [normal(w) for w in new]), np.array([bool(w) for w in k], dtype=bool)])

            def find(texts: list[bytes]) -> dict:
                places, lengths = vocab.places(texts)
                ids, said = (r[places] for r in vocab.rows)
                text_of = np.repeat(np.arange(len(lengths)), lengths)[said]
                ids = ids[said]
                found: list[list] = [[] for _ in texts]
                if len(ids):
                    firsts = np.searchsorted(text_of, np.arange(len(texts)))
                    for t, item, start, end, edits in index.hits(ids, text_of):
                        begin = int(firsts[t])
                        found[t].append({"item_id": index.names[item], "start": start - begin, "end": end - begin, "edits": edits})
                return {"hits": found}

            return find

        part = map_texts(docs, text, keep, make, "hits array<struct<item_id: long, start: int, end: int, edits: int>>")
        out = part if out is None else out.unionByName(part)
    return out.where(F.size("hits") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The given columns of the documents that hold no benchmark item, each row judged by its own text.

    Contaminated texts are few and known by 128-bit hashes, which are left out of
    the texts by an anti join.
    """
    h1, h2 = F.xxhash64(F.lit(0), "text").alias("__h1"), F.xxhash64(F.lit(1), "text").alias("__h2")
    keyed = docs.withColumns({"__h1": h1, "__h2": h2})
    found = find_passages(keyed, benchmark, similarity, keep=["__h1", "__h2"]).select("__h1", "__h2").distinct()
    return keyed.join(found, ["__h1", "__h2"], "left_anti").drop("__h1", "__h2")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits): every passage of a benchmark item in a document."""
    each = find_passages(docs, benchmark).select("doc_id", F.explode("hits").alias("h"))
    return each.select("doc_id", "h.item_id", F.col("h.start").alias("start_word"), F.col("h.end").alias("end_word"), "h.edits")
