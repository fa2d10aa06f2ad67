"""Operator 8, packing by the sum-of-squares rule.

Documents become token ids and each task packs those it reads, online: a document longer than a window gives full
windows first, and its rest goes to the fill level that minimises the sum of squared counts of partially filled windows,
kept in an array indexed by level. What is still partially filled at the end of a task is cut to fill windows and the
last tail is cut at powers of two, so no sequence needs padding. No row is shuffled and no text leaves its task.

A task that runs again after a lost executor reads the same split in the same order and gives the same sequences;
``sequence_id`` holds the task's partition in its high bits.

Edge cases: a null or empty text is one piece holding only the end id; repeated rows are packed each on its own; a null
id passes through; an empty table gives no rows; other columns are not read. Words (runs of non-white bytes) are encoded
by themselves and joined, which equals encoding the whole text because the tokenizer's pre-tokens never cross white space;
so a very long text is looked up in parts, and no memory grows with a text but its ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.support import IS_SPACE, LOWER, WordBlock, mix64, string_buffers, table, task_memory, worker_cache

WINDOW = 4096
END_ID = 2
#: Units whose ids a worker keeps (about 45 bytes each); beyond, the half that was met longest ago is forgotten. Costs time, not results.
CACHED_UNITS = 500_000
#: Bytes of text that are looked up together; a longer text is cut between words.
BLOCK_BYTES = 1 << 19
#: Longer units are encoded each time they are met.
LONG_UNIT = 256

_TRAILING = b".,;:!?*#&%$|\"()"
_IS_TRAILING = np.zeros(256, bool)
_IS_TRAILING[list(_TRAILING)] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
#: Keeps the first n of eight bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Units:
    """The units of a block of words: runs of ASCII letters in lower case, the punctuation behind such a run, and all other words whole.

    The tokenizer's pattern never joins letters with what follows them, and it lower-cases, so the ids of a text are
    those of its units. ``key`` and ``check`` tell units apart by 128 bits; up to eight bytes they are exact.
    """

    def __init__(self, block: WordBlock):
        data, start, end = block.data, block.start.astype(np.int64), block.end.astype(np.int64)
        here = np.arange(len(data), dtype=np.int32)
        solid = np.maximum.accumulate(np.where(_IS_TRAILING[data], np.int32(-1), here)) if len(data) else here
        core_end = np.maximum(solid[end - 1].astype(np.int64) + 1, start)
        others = np.concatenate(([0], np.cumsum(~_IS_LETTER[data], dtype=np.int32)))
        plain = (core_end > start) & (others[core_end] == others[start])
        two = plain & (core_end < end)
        after = np.cumsum(1 + two)
        first = after - 1 - two
        n = int(after[-1]) if len(after) else 0
        self.start, self.end, self.plain = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        self.start[first], self.end[first], self.plain[first] = start, np.where(plain, core_end, end), plain
        self.start[first[two] + 1], self.end[first[two] + 1] = core_end[two], end[two]
        self.text_at = np.append(first, n)[block.word_at]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[start[plain]] += 1
        inside[core_end[plain]] -= 1
        self.data = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, LOWER[data], data)
        self.key, self.check = self._keys()

    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        size = self.end - self.start
        check = eight[self.start] & _FIRST[np.minimum(size, 8)]
        key = mix64(check ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        more, at = np.flatnonzero((size > 8) & (size <= LONG_UNIT)), 8
        while len(more):
            part = eight[self.start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]
            key[more] = mix64(key[more] ^ part)
            check[more] = mix64(check[more] * np.uint64(0xD6E8FEB86659FD93) + part)
            at += 8
            more = more[size[more] > at]
        return key, check


class IdTable:
    """ids of units, by key: sorted arrays and one pool of ids."""

    def __init__(self, most: int):
        self.most, self.round = most, 0
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, "<u4")

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Index of each unit, -1 where it is not known, -2 where another unit has its key."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        same = self.key[at] == key
        found = np.where(same, np.where(self.check[at] == check, at, -2), -1)
        self.met[found[found >= 0]] = self.round
        return found

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New units in the order of their keys, with all their ids and the number of each one's."""
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, ids))
        place = np.searchsorted(self.key, key)
        self.key, self.check = np.insert(self.key, place, key), np.insert(self.check, place, check)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, size.astype(np.int32))
        self.met = np.insert(self.met, place, np.int32(self.round))

    def trim(self) -> None:
        self.round += 1
        if len(self.key) > self.most:
            keep = np.sort(np.argsort(self.met, kind="stable")[len(self.key) - self.most // 2 :])
            self.pool = self.pool[spread(self.at[keep], self.size[keep])]
            self.key, self.check, self.size, self.met = (x[keep] for x in (self.key, self.check, self.size, self.met))
            self.at = np.cumsum(self.size, dtype=np.int64) - self.size


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``at[k]``, ``at[k] + 1``, ... of all runs, one after the other."""
    after = np.cumsum(size, dtype=np.int64)
    return np.repeat(at - after + size, size) + np.arange(after[-1] if len(after) else 0)


class WordEncoder:
    """ids of texts by a tokenizer whose pre-tokens lie within white-space separated words.

    The distinct units of a block are looked up together; unseen ones are encoded in one batch.
    """

    def __init__(self, path: str, most: int = CACHED_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_file(path), IdTable(most)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, number of ids of each)."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], "<u4"), np.fromiter(map(len, got), np.int64, len(got))

    def _runs(self, units: list[bytes], at_once: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """The same of runs of letters, many in one text: each is one pre-token, whose last id is the only one marked as a word's end."""
        groups = [units[k : k + at_once] for k in range(0, len(units), at_once)]
        pool, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            size = np.diff(stop, prepend=0)
            if len(stop) != len(group) or stop[-1] != len(ids):
                ids, size = self._each(group)  # a tokenizer that marks no ends, or a letter that it normalises away
            pool.append(ids)
            sizes.append(size)
        return np.concatenate(pool), np.concatenate(sizes)

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any units; letters that are not all ASCII are cut from the punctuation behind them."""
        cut = []
        for u in units:
            core = u.rstrip(_TRAILING)
            cut += [core, u[len(core) :]] if core and not core.isascii() and core.decode().isalpha() else [b"", u]
        cores, tails = cut[::2], cut[1::2]
        known: dict[bytes, np.ndarray] = {}
        for some, encode in ((cores, self._runs), (tails, self._each)):
            names = list({*some} - {b""})
            if names:
                ids, size = encode(names)
                stop = np.cumsum(size).tolist()
                known.update((x, ids[a:b]) for x, a, b in zip(names, [0, *stop], stop, strict=False))
        parts = [known[x] if x else np.zeros(0, "<u4") for x in cut]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate([np.zeros(0, "<u4"), *parts]), size[::2] + size[1::2]

    def block_ids(self, block: WordBlock) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, index of each text's first id and one more)."""
        units = Units(block)
        if not len(units.key):
            return np.zeros(0, "<u4"), np.zeros(len(block.doc_at), np.int64)
        order = np.argsort(units.key)
        new = np.concatenate(([True], units.key[order][1:] != units.key[order][:-1]))
        first = order[new]  # one unit of each key
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        key, check = units.key[first], units.check[first]
        found = self.table.find(key, check)
        raw = units.data.tobytes()
        text = lambda which: [raw[a:b] for a, b in zip(units.start[which].tolist(), units.end[which].tolist(), strict=True)]
        long = units.end - units.start > LONG_UNIT
        unseen = np.flatnonzero((found == -1) & ~long[first])
        if len(unseen):
            plain = units.plain[first[unseen]]
            for some, learn in ((unseen[plain], self._runs), (unseen[~plain], self._learn)):
                self.table.add(key[some], check[some], *learn(text(first[some])))
            found = self.table.find(key, check)
        # long units, and those that share a key with another, are encoded each by itself
        alone = np.flatnonzero(long | (found[kind] < 0) | (units.check != check[kind]))
        known = np.maximum(found, 0)
        pool = self.table.pool
        at, size = (self.table.at[known][kind], self.table.size[known][kind]) if len(self.table.key) else (np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int32))
        if len(alone):
            own, own_size = self._each(text(alone))
            at[alone], size[alone] = len(pool) + np.cumsum(own_size) - own_size, own_size
            pool = np.concatenate((pool, own))
        ids = pool[spread(at, size)]
        self.table.trim()
        return ids, np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[units.text_at]

    def encode(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text of a column, in order; null reads as empty."""
        data, off = string_buffers(col)
        row, n, held = 0, len(off) - 1, []
        while row < n:
            stop = max(row + 1, int(np.searchsorted(off, off[row] + BLOCK_BYTES, side="right")) - 1)
            if off[stop] - off[row] <= BLOCK_BYTES:
                ids, at = self.block_ids(WordBlock(row, data[off[row] : off[stop]], off[row : stop + 1] - off[row]))
                for k in range(stop - row):
                    yield row + k, ids[at[k] : at[k + 1]]
            else:  # one text longer than a block, in parts
                for part in _between_words(data[off[row] : off[stop]]):
                    held.append(self.block_ids(WordBlock(row, part, np.array([0, len(part)])))[0])
                yield row, np.concatenate(held)
                held.clear()
            row = stop


def _between_words(text: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about BLOCK_BYTES that end before white space (a longer word stays whole)."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + BLOCK_BYTES)
        while stop < len(text):
            space = np.flatnonzero(IS_SPACE[text[stop : stop + BLOCK_BYTES]])
            if len(space):
                stop += int(space[0])
                break
            stop = min(len(text), stop + BLOCK_BYTES)
        yield text[at:stop]
        at = stop


def worker_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary, so that the tasks of a worker share what it has learned."""
    kept = worker_cache("packing")
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


class SumOfSquares:
    """Online packing into windows by level counts. ``place`` returns (window, offset); a window closes when full."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # partially filled windows by level; both ends stay 0
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        # moving a window from level l to l + size changes the sum of squares by 2 (N[l + size] - N[l]) + 2, and by
        # less where an end of the move is not a partial level (a new window, or one that becomes full)
        w, n = self.window, self.count
        cost = 2 * (n[size:] - n[: w + 1 - size]) + 2
        cost[0] = 2 * n[size] + 1
        if size == w:
            cost[0] = 0
        else:
            cost[-1] = 1 - 2 * n[w - size]
            cost[1:][n[1 : w + 1 - size] == 0] = np.iinfo(np.int64).max
        level = int(cost.argmin())
        window = self.open[level].pop() if level else self.new()
        if level:
            n[level] -= 1
        if level + size < w:
            n[level + size] += 1
            self.open[level + size].append(window)
        return window, level


def _powers(total: int, most: int) -> Iterator[int]:
    while total:
        size = min(most, 1 << (total.bit_length() - 1))
        yield size
        total -= size


class TaskPacker:
    """Packs one task's documents; pieces are (doc row, start, length, window, offset, crc32)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.levels = window, SumOfSquares(window)
        self.partial: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def add(self, row: int, ids: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        start, w = 0, self.window
        while len(ids) - start >= w:
            yield self._piece(row, start, ids[start : start + w], self.levels.new(), 0)
            start += w
        if start < len(ids):
            window, offset = self.levels.place(len(ids) - start)
            held = self.partial.setdefault(window, [])
            held.append((row, start, ids[start:]))
            if offset + len(ids) - start == w:
                yield from self._close(window)

    def _piece(self, row: int, start: int, ids: np.ndarray, window: int, offset: int) -> tuple[int, int, int, int, int, int]:
        return row, start, len(ids), window, offset, zlib.crc32(ids.data)

    def _close(self, window: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        offset = 0
        for row, start, ids in self.partial.pop(window):
            yield self._piece(row, start, ids, window, offset)
            offset += len(ids)

    def finish(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Cut what partially filled windows hold into full windows and a tail of power-of-two lengths."""
        rest = [x for window in sorted(self.partial) for x in self.partial[window]]
        self.partial.clear()
        sizes = _powers(sum(len(ids) for _, _, ids in rest) % self.window, self.window)
        full = sum(len(ids) for _, _, ids in rest) // self.window
        room, offset, window = 0, 0, -1
        for row, start, ids in rest:
            while len(ids):
                if not room:
                    room, offset, window = (self.window if full > 0 else next(sizes)), 0, self.levels.new()
                    full -= 1
                part = ids[:room]
                yield self._piece(row, start, part, window, offset)
                start, offset, room, ids = start + len(part), offset + len(part), room - len(part), ids[len(part) :]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``with_ids`` adds the ids.

    ``tokenizer`` is the path of the vocabulary file on every executor; by default the installed public one.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer or default_tokenizer())
        packer = TaskPacker(window)
        end = np.array([end_id], "<u4")
        high = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[int | None, int, np.ndarray | None]] = {}  # row -> id, tokens, ids of documents not all written yet
        pending: dict[int, int] = {}
        rows: list[tuple] = []

        def put(pieces: Iterator[tuple[int, int, int, int, int, int]]) -> None:
            for row, start, length, w, offset, crc in pieces:
                doc, tokens, ids = held[row]
                rows.append((doc, start, length, crc, tokens, high | w, offset, ids[start : start + length].tolist() if ids is not None else None))
                pending[row] -= length
                if not pending[row]:
                    del held[row], pending[row]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            out = [pa.array(c, pa.int64()) for c in columns[:7]] + ([pa.array(columns[7], pa.list_(pa.int32()))] if with_ids else [])
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)

        n = 0
        with task_memory():
            for batch in it:
                ids_in = batch.column(0).to_pylist()
                for k, found in encoder.encode(batch.column(1)):
                    ids = np.concatenate((found, end))
                    held[n] = (ids_in[k], len(ids), ids if with_ids else None)
                    pending[n] = len(ids)
                    put(packer.add(n, ids))
                    n += 1
                    if len(rows) > 5000:
                        yield flush()
            put(packer.finish())
            yield flush()

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(batches, ", ".join(f"{c} long" for c in names) + ", ids array<int>" * with_ids)


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_sum_of_squares_packing": op8_sum_of_squares_packing}
