"""Shared helpers: table access, durable intermediate tables and vectorised tokenising of Arrow string columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.spans import let

#: The six ASCII white-space bytes: space, tab, newline, vertical tab, form feed, carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text handled at once; bounds the size of every numpy temporary (a single longer text is one block).
BLOCK_BYTES = 1 << 18

#: Rows and bytes of an Arrow batch while an intermediate table is written; a row may hold a whole text or shingle set.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the session's shared checkpoint folder: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named.

    Only a session of one process may go without: it gets a folder of its own. A cluster without one is an error, as
    executors do not see each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/maskwright/{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, jobs send Arrow batches of at most ``BATCH``, so that what a worker holds does not follow the rows' sizes."""
    before = {key: spark.conf.get(key) for key in BATCH}
    try:
        for key in BATCH:
            spark.conf.set(key, str(min(int(BATCH[key]), _count(before[key]))))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _count(value: str) -> int:
    """A setting of rows or bytes (with or without unit) as a number; none or not positive: no bound."""
    got = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", value.strip().lower())
    n = int(got[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[got[2]] if got else 0
    return n if n > 0 else 1 << 31


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: a lineage cut every executor can reach.

    Unlike ``checkpoint()`` the plan below runs once, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(text: Column, spans: Column) -> Column:
    """array<string>: the parts of a text at ``spans``, array<struct<start, end>>, rising and apart.

    Spans are taken in about sqrt(n) blocks, so that a long text is not walked from its start for each of them.
    """

    def cut(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x["s"]).cast("double"))).cast("int"), F.lit(1))
        blocks = F.sequence(F.lit(0), F.floor((F.size(x["s"]) - 1) / width).cast("int"))
        return F.flatten(F.transform(blocks, lambda b: let(F.struct(x["t"].alias("t"), F.slice(x["s"], b * width + 1, width).alias("s")), block)))

    def block(y: Column) -> Column:
        first = F.element_at(y["s"], 1)["start"].cast("int")
        part = F.substring(y["t"], first + 1, F.element_at(y["s"], -1)["end"].cast("int") - first)
        return let(F.struct(part.alias("t"), first.alias("first"), y["s"].alias("s")), lambda z: F.transform(z["s"], lambda w: F.substring(z["t"], (w["start"] - z["first"] + 1).cast("int"), (w["end"] - w["start"]).cast("int"))))

    return let(F.struct(text.alias("t"), spans.alias("s")), lambda x: F.when(F.size(x["s"]) > 0, cut(x)).otherwise(F.array().cast("array<string>")))


_owner: str | None = None
_cache: dict = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks; freed as soon as another operator's task asks for its own."""
    global _owner, _cache
    if _owner != owner:
        _owner, _cache = owner, {}
        gc.collect()
    return _cache


@contextlib.contextmanager
def task_memory() -> Iterator[None]:
    """Around a task's work: what it allocated goes back to the system when it ends, as workers outlive their tasks."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over Arrow batches that gives back its memory when it ends."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_memory():
            yield from batches(it)

    return run


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 3))
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if size > 4 * BLOCK_BYTES:  # serves one very long text; not kept
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


class WordBlock:
    """Words (runs of bytes other than ASCII white space) of a few consecutive texts.

    ``data`` holds the bytes of all texts, ``doc_at`` the byte offset of each text (one more at the end), ``start`` and
    ``end`` the bytes of each word and ``word_at`` the index of each text's first word (one more at the end).
    """

    def __init__(self, first: int, data: np.ndarray, doc_at: np.ndarray):
        self.first, self.data, self.doc_at = first, data, doc_at
        inside = ~IS_SPACE[data]
        starts, ends = inside.copy(), inside.copy()
        if len(data):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cut = doc_at[(doc_at > 0) & (doc_at < len(data))]
            starts[cut] = inside[cut]
            ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.word_at = np.searchsorted(self.start, doc_at)

    @property
    def n_docs(self) -> int:
        return len(self.doc_at) - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (ASCII letters lower-cased first if asked)."""
        data = LOWER[self.data] if lower else self.data
        power, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * inverse[self.start])


def word_blocks(col: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[WordBlock]:
    """Blocks of whole texts of about ``block_bytes`` bytes; every text of the column lies in exactly one."""
    data, off = string_buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + block_bytes, side="right")) - 1)
        yield WordBlock(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


_ROLL = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9E6C63D0876A9A47)]


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of every window of ``n`` (1 to 8) consecutive word hashes; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    h = words[:m] * _ROLL[0]
    for k in range(1, n):
        h ^= mix64(words[k : k + m] * _ROLL[k])
    return mix64(h)


def shingle_sets(block: WordBlock, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index in the column, sorted distinct shingle hashes) of each text, lower-cased; fewer words than ``n``: the whole sequence."""
    h = block.hashes(lower=True)
    grams, at = rolled(h, n), block.word_at
    for d in range(block.n_docs):
        a, b = at[d], at[d + 1]
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            if len(g) > 1:
                g = g[np.concatenate(([True], g[1:] != g[:-1]))]
        elif b > a:
            g = rolled(h[a:b], int(b - a))[:1] ^ np.uint64(b - a)
        else:
            g = np.zeros(0, np.uint64)
        yield block.first + d, g
