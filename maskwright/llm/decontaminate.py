"""Operator 10, benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For each benchmark item every document's windows of as many words are compared with it. A window's fingerprint is the
SimHash of its word shingles, repeated ones numbered, in 40 blocks of 16 bits. Fingerprints within RADIUS bits are found by multi-index hashing:
two fingerprints within the radius differ by at most RADIUS // BLOCKS = 2 bits in some block, so looking each block up
with up to two flipped bits misses none, and of unrelated fingerprints a share of 0.08 is met. Candidates are verified by
the exact weighted Jaccard similarity of shingle counts. At the least similarity, 0.8, two windows differ by 97 of the 640
bits on average with a standard deviation of 9, so the radius of 119 keeps more than 0.99 of them, and more of those
that are more alike.

Similarity s needs s (a + b) / (1 + s) common shingles between sets of a and b, so only windows in which as many positions
hold shingles of items of that size are fingerprinted: this skips nearly all text and loses nothing. Distinct item texts
are taken in blocks of bounded size, each broadcast; a task goes through the blocks for each part of its documents, so
documents are read once whatever the benchmark's size and no document is shuffled.

Edge cases: null or empty texts and items match nothing; an empty benchmark gives no rows; fewer words than a shingle form
one shingle; repeated rows and items are reported each; a null id is kept as null. Words are runs of bytes other than
ASCII white space, A-Z lower-cased, without ASCII punctuation at either end; words of punctuation alone are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.support import WordBlock, materialize, mix64, rolled, table, task_memory, word_blocks, worker_cache

#: Words of a shingle and the least weighted Jaccard similarity of a leak.
SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of the multi-index, of 16 bits each, and the largest Hamming distance searched.
BLOCKS = 40
RADIUS = 119
#: Bytes of distinct item texts in a block, which is broadcast (a longer item is a block of its own).
ITEM_BYTES = 8 << 20
#: Items whose ids are broadcast to name the leaked texts; with more, they are joined by a shuffle.
MAX_BROADCAST_ITEMS = 200_000
#: Bytes of documents that a task holds while it goes through several blocks of items.
HELD_BYTES = 32 << 20
#: Windows that are fingerprinted together.
WINDOWS = 1024

_BITS = 16 * BLOCKS
_LANES = [np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64)) for k in range(_BITS // 64)]
_FLIPS = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), k)], np.uint16)
_TRIM = np.zeros(256, bool)
_TRIM[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _trim_runs(block: WordBlock) -> None:
    """Like the loop below in one sweep over all bytes."""
    solid, here = ~_TRIM[block.data], np.arange(len(block.data), dtype=np.int64)
    after = np.minimum.accumulate(np.where(solid, here, len(here))[::-1])[::-1]  # the next byte that is not trimmed
    before = np.maximum.accumulate(np.where(solid, here, -1))  # the last one
    some = np.flatnonzero(block.start < block.end)
    block.start[some], block.end[some] = after[block.start[some]], before[block.end[some] - 1] + 1


def trimmed_words(block: WordBlock) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word without outer ASCII punctuation, index of each text's first word); bare punctuation is no word."""
    for side in ("head", "tail"):
        todo = np.arange(len(block.start))
        for _ in range(16):  # nearly all words end here; what is left is long runs of punctuation
            todo = todo[block.start[todo] < block.end[todo]]
            todo = todo[_TRIM[block.data[block.start[todo] if side == "head" else block.end[todo] - 1]]]
            if side == "head":
                block.start[todo] += 1
            else:
                block.end[todo] -= 1
            if not len(todo):
                break
        if len(todo):
            _trim_runs(block)
    keep = block.start < block.end
    block.word_at = np.concatenate(([0], np.cumsum(keep)))[block.word_at]
    block.start, block.end = block.start[keep], block.end[keep]
    return block.hashes(lower=True), block.word_at


def shingles(words: np.ndarray) -> np.ndarray:
    """Shingle hashes in text order; the whole sequence where there are fewer words than SHINGLE."""
    if len(words) >= SHINGLE or not len(words):
        return rolled(words, SHINGLE)
    return rolled(words, len(words)) ^ np.uint64(len(words))


def _bits(grams: np.ndarray) -> np.ndarray:
    """The hash bits of shingles, a row of 0 and 1 each."""
    lanes = np.stack([mix64(grams ^ lane) for lane in _LANES], axis=1)
    return np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")


def _count(grams: np.ndarray) -> np.ndarray:
    """For each bit the number of shingles that have it."""
    return sum((_bits(grams[k : k + 4096]).sum(axis=0, dtype=np.int64) for k in range(0, len(grams), 4096)), np.zeros(_BITS, np.int64))


def _packed(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes.astype(np.uint8), axis=-1, bitorder="little").view(np.uint16)


def numbered(grams: np.ndarray) -> np.ndarray:
    """Shingles with the later ones of equal ones told apart, so that the weighted similarity of counts is that of sets."""
    order = np.argsort(grams, kind="stable")
    same = np.concatenate(([False], grams[order][1:] == grams[order][:-1])) if len(grams) else np.zeros(0, bool)
    if not same.any():
        return grams
    here = np.arange(len(grams))
    rank = np.empty(len(grams), np.int64)
    rank[order] = here - np.maximum.accumulate(np.where(same, 0, here))
    return np.where(rank > 0, mix64(grams + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), grams)


def simhash(grams: np.ndarray) -> np.ndarray:
    """Sign of the summed bits of all shingles, numbered; BLOCKS numbers of 16 bits."""
    return _packed(2 * _count(numbered(grams)) > len(grams))


def window_simhashes(grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the windows of ``size`` shingles at ``starts``, in rising order, from the first window's counts and what
    enters and leaves; one by one where a shingle occurs twice."""
    first, span = int(starts[0]), int(starts[-1] - starts[0])
    if len(np.unique(grams[first : first + span + size])) < span + size:
        return np.stack([simhash(grams[a : a + size]) for a in starts.tolist()])
    moved = np.zeros((span + 1, _BITS), np.int32)
    np.cumsum(_bits(grams[first + size : first + size + span]).astype(np.int32) - _bits(grams[first : first + span]), axis=0, out=moved[1:])
    return _packed(2 * (_count(grams[first : first + size]) + moved[starts - first]) > size)


class MultiIndex:
    """All stored fingerprints within RADIUS bits of a query: one table a block, from block value to fingerprints."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.order = [np.argsort(prints[:, b], kind="stable") for b in range(BLOCKS)]
        self.at = [np.searchsorted(prints[o, b], np.arange((1 << 16) + 1)).astype(np.int32) for b, o in enumerate(self.order)]

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) pairs that are at most RADIUS // BLOCKS bits apart in some block."""
        found = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            probe = (queries[:, b, None] ^ _FLIPS).astype(np.int64)
            low, high = self.at[b][probe], self.at[b][probe + 1]
            query, flip = np.nonzero(high > low)
            low, size = low[query, flip], (high - low)[query, flip]
            after = np.cumsum(size)
            place = np.repeat(low - after + size, size) + np.arange(after[-1] if len(after) else 0)
            found.append(np.repeat(query, size) * len(self.prints) + self.order[b][place])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) pairs within RADIUS bits."""
        query, stored = self.candidates(queries)
        near = np.bitwise_count(queries[query] ^ self.prints[stored]).sum(axis=1, dtype=np.int64) <= RADIUS
        return query[near], stored[near]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of greatest counts of each shingle."""
    both, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x = np.bincount(at[: len(a)], minlength=len(both))
    y = np.bincount(at[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Benchmark:
    """Item texts of one block, grouped by their number of shingles and words."""

    def __init__(self, keys: list[str], texts: list[str]):
        self.keys: list[str] = []
        self.grams: list[np.ndarray] = []
        kinds: dict[tuple[int, int], int] = {}
        group_of = []
        for block in word_blocks(pa.array(texts, pa.string())):
            words, at = trimmed_words(block)
            for d in range(block.n_docs):
                grams = shingles(words[at[d] : at[d + 1]])
                if len(grams):
                    group_of.append(kinds.setdefault((len(grams), min(SHINGLE, int(at[d + 1] - at[d]))), len(kinds)))
                    self.keys.append(keys[block.first + d])
                    self.grams.append(grams)
        self.groups, self.group_of = list(kinds), np.array(group_of, np.int64)
        self.prints = np.stack([simhash(g) for g in self.grams]) if self.grams else np.zeros((0, BLOCKS), np.uint16)
        every = np.concatenate([*self.grams, np.zeros(0, np.uint64)])
        self.known, number = np.unique(every, return_inverse=True)
        # for each known shingle the groups whose items have it, one after the other
        pairs = np.unique(number * max(1, len(kinds)) + np.repeat(self.group_of, [len(g) for g in self.grams]))
        self.of = (pairs % max(1, len(kinds))).astype(np.int32)
        self.of_at = np.searchsorted(pairs // max(1, len(kinds)), np.arange(len(self.known) + 1)).astype(np.int32)
        self.short = sorted({span for _, span in self.groups if span < SHINGLE})
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self._index: MultiIndex | None = None

    @property
    def index(self) -> MultiIndex:
        if self._index is None:
            self._index = MultiIndex(self.prints)
        return self._index

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions whose shingle some item has, the numbers of these shingles)."""
        maybe = np.flatnonzero(self.flags[(grams >> np.uint64(44)).astype(np.int64)])
        if not len(self.known):
            return maybe[:0], maybe[:0]
        at = np.searchsorted(self.known, grams[maybe])
        at[at == len(self.known)] = 0
        same = self.known[at] == grams[maybe]
        return maybe[same], at[same]

    def _by_group(self, hits: np.ndarray, known: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
        """(group, positions that hold a shingle of one of its items, rising) of the groups with shingles of ``span`` words."""
        size = self.of_at[known + 1] - self.of_at[known]
        after = np.cumsum(size, dtype=np.int64)
        group = self.of[np.repeat(self.of_at[known] - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        at = np.repeat(hits, size)
        order = np.argsort(group, kind="stable")
        group, at = group[order], at[order]
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if self.groups[group[a]][1] == span:
                yield int(group[a]), at[a:b]

    def leaks(self, words: np.ndarray, grams: np.ndarray, hits: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the most similar window of each leaked item of one text, the first of several."""
        best: dict[int, tuple[float, int, int]] = {}
        for span in (SHINGLE, *self.short):
            if span != SHINGLE:
                grams = rolled(words, span) ^ np.uint64(span)
                hits, known = self.hits(grams)
            for group, found in self._by_group(hits, known, span):
                size = self.groups[group][0]
                width = min(size, len(grams))  # of a text shorter than the item, the whole text
                # similarity s needs s (size + width) / (1 + s) common shingles, so as many positions must be hits
                count = np.zeros(len(grams) + 1, np.int64)
                count[found + 1] = 1
                count = np.cumsum(count)
                starts = np.flatnonzero((count[width:] - count[:-width]) * (1 + SIMILARITY) >= SIMILARITY * (size + width) - 1e-9)
                while len(starts):
                    n = int(np.searchsorted(starts, starts[0] + WINDOWS))
                    some, starts = starts[:n], starts[n:]
                    query, stored = self.index.search(window_simhashes(grams, some, width))
                    own = self.group_of[stored] == group
                    for start, item in zip(some[query[own]].tolist(), stored[own].tolist(), strict=True):
                        similarity = weighted_jaccard(grams[start : start + width], self.grams[item])
                        if similarity >= SIMILARITY and (item not in best or similarity > best[item][0]):
                            best[item] = (similarity, start, width + span - 1)
        for item in sorted(best):
            similarity, start, length = best[item]
            yield item, start, length, similarity


def _document_leaks(bench: Benchmark, col: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
    for block in word_blocks(col):
        words, at = trimmed_words(block)
        grams = rolled(words, SHINGLE)
        hits, known = bench.hits(grams)
        near = np.searchsorted(hits, at)
        for d in range(block.n_docs):
            a, b = int(at[d]), int(at[d + 1])
            mine, which = hits[near[d] : near[d + 1]] - a, known[near[d] : near[d + 1]]
            inside = mine <= b - a - SHINGLE  # a shingle that runs into the next text is none
            if inside.any() or bench.short and b > a:
                for leak in bench.leaks(words[a:b], grams[a : max(a, b - SHINGLE + 1)], mine[inside], which[inside]):
                    yield block.first + d, *leak


def _key(text_col: str) -> Column:
    return F.md5(F.col(text_col).cast("binary"))


def item_blocks(benchmark: DataFrame, text_col: str = "text", most: int = ITEM_BYTES) -> Iterator[Benchmark]:
    """The distinct texts of the benchmark in blocks of at most ``most`` bytes, one at a time on the driver."""
    rows = benchmark.select(_key(text_col).alias("key"), F.col(text_col).alias("text")).filter("text <> ''")
    rows = materialize(rows.groupBy("key").agg(F.first("text").alias("text")), "items")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-2 * total // most)
    for part in range(parts):
        got, held, size = rows.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).orderBy("key").toLocalIterator(), [], 0
        for r in got:
            if held and size + len(r.text) > most:
                yield Benchmark([x.key for x in held], [x.text for x in held])
                held, size = [], 0
            held.append(r)
            size += len(r.text)
        if held:
            yield Benchmark([x.key for x in held], [x.text for x in held])


def _gathered(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have ``least`` bytes."""
    held, size = [], 0
    for batch in it:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _in_turn(blocks: list[Broadcast], it: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, str, int, int, float]]]]:
    """(documents, their leaks as (row, item key, first word, words, similarity)). Of several blocks, a worker holds one at a time."""
    worker_cache("decontaminate")
    with task_memory():
        for batch in _gathered(it, HELD_BYTES) if len(blocks) > 1 else it:
            found = []
            for held in blocks:
                bench = held.value
                found += [(row, bench.keys[item], *where) for row, item, *where in _document_leaks(bench, batch.column(column))]
                if len(blocks) > 1:
                    vars(held).pop("_value", None)  # loaded again from the worker's disk for the next documents
            yield batch, found


LEAK = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, start_word and n_words of the best window, similarity."""
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(benchmark)]
    if not blocks:
        return spark.createDataFrame([], LEAK)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _in_turn(blocks, it, 1):
            at, keys, start, length, similarity = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(similarity, pa.float64())],
                ["doc_id", "key", "start_word", "n_words", "similarity"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(batches, "doc_id long, key string, start_word long, n_words long, similarity double")
    items = benchmark.select(_key("text").alias("key"), F.col("item_id").cast("long").alias("item_id")).filter("key is not null")
    if benchmark.count() <= MAX_BROADCAST_ITEMS:
        items = F.broadcast(items)
    return found.join(items, "key").select("doc_id", "item_id", "start_word", "n_words", "similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no item leaks."""
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(benchmark)]
    if not blocks:
        return docs
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _in_turn(blocks, it, at):
            clean = np.ones(len(batch), bool)
            clean[[leak[0] for leak in found]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(batches, docs.schema)


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_benchmark_leaks": op10_benchmark_leaks}
