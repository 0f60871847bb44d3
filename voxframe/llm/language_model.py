"""Language-model scores from a log-frequency Bloom filter.

The filter holds n-grams of all training texts with quantised counts: an n-gram of
level q is put in together with each of the levels 1 to q. A count is read by asking
for level after level until one is missing, so the filter never says less than
the true level, and rarely more. It is built in pieces by hash range, each as large as its entries
need for the stated error, and sent to all tasks. Where all pairs would make more than MAX_BITS, they
are dealt into groups by their first word, and one group's filter after the other is sent and asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import ROW, chunks, cut, map_texts, numbered
from voxframe.llm.words import Words, hashed, mixed

# Symbols that are no words
END, START = 0xE5D0E5D0E5D0E5D1, 0x57A757A757A757A7
BASE = 1.5
LEVELS = 64
PROBES = 4
ERROR = 0.01  # share of (n-gram, level) never put in that read as put in
BITS_PER_ENTRY = PROBES / -np.log(1 - ERROR ** (1 / PROBES))
MAX_BITS = 1 << 31  # of one group's pairs: 256 MB
PIECE_TOKENS = 1 << 21
ENTRY = np.dtype([("k", "<u8"), ("n", "<i8")])
SINGLE = -1  # the group of single tokens, which every pass needs
COMMON = 1 << 17
PRIOR = 4.0
GATHER = 2_000_000
TEXT_BYTES = 1 << 20  # texts worked on at once; a token takes some 30 times its bytes meanwhile
PARTS = 8


def _ids(words: list[bytes]) -> np.ndarray:
    return hashed([w.lower() for w in words])


def _tokens(vocab: Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the vocabulary or -1 for the end, text number, whether first) of all tokens, an end after each text."""
    places, lengths = vocab.places(texts)
    ends = np.cumsum(lengths + 1) - 1
    out = np.full(len(places) + len(texts), -1, dtype=np.int64)
    said = np.ones(len(out), dtype=bool)
    said[ends] = False
    out[said] = places
    first = np.zeros(len(out), dtype=bool)
    first[ends - lengths] = True
    return out, np.repeat(np.arange(len(texts)), lengths + 1), first


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(3) + mixed(token, 2), 5)


def single_keys(token: np.ndarray) -> np.ndarray:
    return mixed(token, 9)


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n): how often each token stands in the column `text`, by the hash of its word; the end is a token."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Words(lambda new: [_ids(new)])
        for batch in batches:
            parts = []
            for _, part in chunks(batch.column(0), TEXT_BYTES):
                places, _, _ = _tokens(vocab, part)
                parts.append(np.where(places < 0, np.uint64(END), np.append(vocab.rows[0], np.uint64(0))[places]))
            keys, n = _counted(parts)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["token", "n"])

    return texts.select("text").mapInArrow(apply, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def group_of(before: np.ndarray, groups: int) -> np.ndarray:
    """The pass in which pairs that begin with a token are asked."""
    return (mixed(before, 77) % np.uint64(groups)).astype(np.int64)


def gather_ngrams(texts: DataFrame, groups: int, pieces_log2: int) -> DataFrame:
    """(grp, piece, packed): all single tokens and pairs with their counts, by group and by range of the key's hash.

    Every Arrow batch sends one packed array of (key, count) for each piece, so that few
    large rows are shuffled; what is sent grows with the texts.
    """

    def packed(grp: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        found, n = _counted(parts)
        names, begins = np.unique((found >> np.uint64(64 - pieces_log2)).astype(np.int64), return_index=True)
        rows = np.empty(len(found), dtype=ENTRY)
        rows["k"], rows["n"] = found, n
        columns = [grp] * len(names), names, [r.tobytes() for r in np.split(rows, begins[1:])][:len(names)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["grp", "piece", "packed"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, held, size = Words(lambda new: [_ids(new)]), {}, 0
        for batch in batches:
            for _, part in chunks(batch.column(0), TEXT_BYTES):
                places, _, first = _tokens(vocab, part)
                tokens = np.where(places < 0, np.uint64(END), np.append(vocab.rows[0], np.uint64(0))[places])
                before = np.where(first, np.uint64(START), np.roll(tokens, 1))
                held.setdefault(SINGLE, []).extend([single_keys(tokens), single_keys(np.full(len(part), START, dtype=np.uint64))])
                keys, group = pair_keys(before, tokens), group_of(before, groups) if groups > 1 else None
                for g in range(groups):
                    held.setdefault(g, []).append(keys if group is None else keys[group == g])
                size += len(keys)
                if size > GATHER:
                    yield from (packed(grp, held.pop(grp)) for grp in [*held])
                    size = 0
        yield from (packed(grp, held.pop(grp)) for grp in [*held])

    return texts.select("text").mapInArrow(apply, "grp int, piece int, packed binary")


def level_of(n: np.ndarray) -> np.ndarray:
    """1 + the rounded-down logarithm of a count."""
    return np.minimum(1 + np.floor(np.log(np.maximum(n, 1)) / np.log(BASE) + 1e-9), LEVELS).astype(np.int64)


# What a level stands for: the middle of the whole counts in it
_MEANS = np.array([0.0] + [
    (np.ceil(BASE ** (q - 1) - 1e-6) + max(np.ceil(BASE ** (q - 1) - 1e-6), np.ceil(BASE ** q - 1e-6) - 1)) / 2
    for q in range(1, LEVELS + 1)
])


def bit_of(keys: np.ndarray, level: int, probe: int, size: np.ndarray) -> np.ndarray:
    """Bit of (key, level) for a probe, within a piece of `size` bits."""
    low = mixed(keys + np.uint64(0x9E3779B97F4A7C15 * level & (1 << 64) - 1), 31 + probe) >> np.uint64(32)
    return (low * size >> np.uint64(32)).astype(np.int64)


class Filter:
    """Bits of (key, level) in pieces by the key's highest bits; `sizes` are the bits of each piece."""

    def __init__(self, sizes: np.ndarray, pieces_log2: int):
        self.sizes, self.pieces_log2 = sizes.astype(np.uint64), pieces_log2
        self.firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.table = np.zeros(int(sizes.sum()) // 8, dtype=np.uint8)

    def read_counts(self, keys: np.ndarray) -> np.ndarray:
        """Estimated count of each key, 0 if it is not in the filter."""
        levels = np.zeros(len(keys), dtype=np.int64)
        alive = np.arange(len(keys))
        piece = (keys >> np.uint64(64 - self.pieces_log2)).astype(np.int64)
        first, size = self.firsts[piece], self.sizes[piece]
        for q in range(1, LEVELS + 1):
            for probe in range(PROBES):
                at = first[alive] + bit_of(keys[alive], q, probe, size[alive])
                alive = alive[(self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
            levels[alive] = q
        return _MEANS[levels]


def added(held: list[np.ndarray]) -> np.ndarray:
    """The entries of several arrays sorted by key as one such array, the counts of a key added up.

    It is made in PARTS ranges of the key one after the other, so that sorting takes the memory of one range.
    """
    low, high = min(int(h["k"][0]) for h in held), max(int(h["k"][-1]) for h in held)
    edges = np.array([low + (high - low) * part // PARTS for part in range(1, PARTS)], dtype=np.uint64)
    cuts = [[0, *np.searchsorted(h["k"], edges), len(h)] for h in held]
    out = []
    for part in range(PARTS):
        rows = np.concatenate([h[c[part]:c[part + 1]] for h, c in zip(held, cuts)])
        if len(rows):
            rows = rows[np.argsort(rows["k"], kind="stable")]
            keys, begins = np.unique(rows["k"], return_index=True)
            out.append(np.empty(len(keys), dtype=ENTRY))
            out[-1]["k"], out[-1]["n"] = keys, np.add.reduceat(rows["n"], begins)
    return np.concatenate(out)


def merge_counts(ngrams: DataFrame) -> DataFrame:
    """(grp, piece, entries, keys, levels): the distinct n-grams of each piece with the level of their whole count, stored.

    A task takes one piece after the other, and adds up what it holds of one whenever that has grown to PIECE_TOKENS.
    """

    def whole(at: tuple[int, int], held: list[np.ndarray]) -> pa.RecordBatch:
        rows = added(held)
        held.clear()
        levels = level_of(rows["n"])
        values = [at[0], at[1], int(levels.sum()), rows["k"].tobytes(), levels.astype(np.uint8).tobytes()]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["grp", "piece", "entries", "keys", "levels"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for batch in batches:
            for grp, piece, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (grp, piece) != last and held:
                    yield whole(last, held)
                    held, size = [], 0
                last = (grp, piece)
                held.append(np.frombuffer(row.as_py(), dtype=ENTRY))
                size += len(held[-1])
                if size > PIECE_TOKENS and len(held) > 1:
                    held = [added(held)]
                    size = len(held[0]) // 2
        if held:
            yield whole(last, held)

    sorted_ = ngrams.repartition("grp", "piece").sortWithinPartitions("grp", "piece")
    return cut(sorted_.mapInArrow(apply, "grp int, piece int, entries long, keys binary, levels binary"))


def build_filter(merged: DataFrame, group: int, pieces_log2: int) -> Filter:
    """One group's filter. Each piece is made in a task, with BITS_PER_ENTRY bits for each of its entries; only pieces reach the driver."""
    rows = merged.where(F.col("grp") == group)
    sizes = np.full(1 << pieces_log2, 64, dtype=np.int64)
    for r in rows.select("piece", "entries").toLocalIterator():
        sizes[r.piece] = 64 * -(-int(r.entries * BITS_PER_ENTRY) // 64)
    out = Filter(sizes, pieces_log2)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, keys, levels in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys, levels = np.frombuffer(keys, dtype="<u8"), np.frombuffer(levels, dtype=np.uint8)
                bits = np.zeros(sizes[piece], dtype=bool)
                for q in range(1, int(levels.max()) + 1):
                    kept = keys[levels >= q]
                    for probe in range(PROBES):
                        bits[bit_of(kept, q, probe, np.uint64(len(bits)))] = True
                packed = np.packbits(bits, bitorder="little").tobytes()
                yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "bits": [packed]})

    for r in rows.select("piece", "keys", "levels").mapInArrow(apply, "piece int, bits binary").toLocalIterator():
        at = out.firsts[r.piece] // 8
        out.table[at:at + len(r.bits)] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 1) -> Column:
    """Rows that the model does not learn from; a NULL id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == part, F.lit(False))


def score_documents(docs: DataFrame, held: Column, common: int = COMMON, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each document.

    `base_score` is exact: the counts of the `common` most frequent tokens are sent
    to all tasks, the few tokens that are none of them are joined with all counts.
    `score` is log10 of the filter's model: a pair's count over its first token's count,
    smoothed by PRIOR tokens of the single-token model, all counts read from the
    filters. They have room for all entries at ERROR false reads, whatever the size of the corpus: single tokens
    in one filter, pairs in as many groups as MAX_BITS asks for, each with a pass over the texts
    that adds what its pairs give. NULL texts count as
    empty (one end). Without training rows every count is 0, train_tokens too.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("text"))
    learn = rows.where(~F.col("held_out"))
    counts = cut(count_tokens(learn))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    pieces_log2 = int(np.clip(np.ceil(np.log2(max(total, 1) / PIECE_TOKENS)), 4, 24))
    groups = 1 + int(total * BITS_PER_ENTRY) // MAX_BITS  # the levels of a pair are at most its count, so entries are at most tokens
    merged = merge_counts(gather_ngrams(learn, groups, pieces_log2))
    singles = build_filter(merged, SINGLE, pieces_log2)
    top = counts.orderBy(F.col("n").desc(), "token").limit(common).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    tokens, numbers = tokens[order], top.column("n").to_numpy()[order]
    whole = total + 0.5 * (distinct + 1)
    numbered_rows = numbered(rows) if groups == 1 else cut(numbered(rows))

    def scored_pass(group: int) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((build_filter(merged, group, pieces_log2), singles, tokens, numbers))

        def make():
            pairs, singles, tokens, numbers = shared.value

            def looked_up(ids: np.ndarray) -> list[np.ndarray]:
                at = np.minimum(np.searchsorted(tokens, ids), max(len(tokens) - 1, 0))
                is_common = tokens[at] == ids if len(tokens) else np.zeros(len(ids), dtype=bool)
                exact = np.where(is_common, numbers[at] if len(tokens) else 0, 0)
                return [ids, is_common, np.log10((exact + 0.5) / whole), singles.read_counts(single_keys(ids))]

            end = looked_up(np.array([END], dtype=np.uint64))
            start_count = singles.read_counts(single_keys(np.array([START], dtype=np.uint64)))[0]
            vocab = Words(lambda new: looked_up(_ids(new)))

            def score(texts: list[bytes]) -> dict:
                places, text_of, first = _tokens(vocab, texts)
                ids, known, base, count = (np.append(r, e)[places] for r, e in zip(vocab.rows, end))
                before = np.where(first, np.uint64(START), np.roll(ids, 1))
                context = np.where(first, start_count, np.roll(count, 1))
                n = len(texts)
                mine = group_of(before, groups) == group if groups > 1 else np.ones(len(ids), dtype=bool)
                pair = np.minimum(pairs.read_counts(pair_keys(before[mine], ids[mine])), context[mine])
                single = np.minimum((count[mine] + 0.5) / whole, 1.0)
                model = np.log10((pair + PRIOR * single) / (context[mine] + PRIOR))
                part = {"score": np.bincount(text_of[mine], model, n)}
                if group:
                    return part
                rest = np.flatnonzero(~known)
                ends = np.searchsorted(text_of[rest], np.arange(n + 1))
                return {
                    **part, "n_tokens": np.bincount(text_of, minlength=n), "n_common": np.bincount(text_of, known, n).astype(np.int64),
                    "base_common": np.bincount(text_of, np.where(known, base, 0.0), n),
                    "rest": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[rest].view(np.int64))),
                }

            return score

        more = "" if group else ", n_tokens long, n_common long, base_common double, rest array<long>"
        out = cut(map_texts(numbered_rows, "text", [ROW] if group else [ROW, "doc_id", "held_out"], make, "score double" + more, TEXT_BYTES))
        shared.destroy()
        return out

    scored, *others = [scored_pass(g) for g in range(groups)]
    if others:
        added = reduce(DataFrame.unionByName, others).groupBy(ROW).agg(F.sum("score").alias("more"))
        scored = scored.join(added, ROW).withColumn("score", F.col("score") + F.col("more")).drop("more")
    log = lambda n: F.log10((n + F.lit(0.5)) / F.lit(float(whole)))
    rare = scored.select(ROW, F.explode("rest").alias("token")).groupBy(ROW, "token").agg(F.count(F.lit(1)).alias("times"))
    n = F.coalesce("n", F.lit(0))
    rare = rare.join(counts, "token", "left").groupBy(ROW).agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_rare"), F.sum(F.col("times") * log(n)).alias("base_rare"))
    return scored.join(rare, ROW, "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_common") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        "score",
    )


def digest(docs: DataFrame) -> DataFrame:
    return score_documents(docs, held_out())
