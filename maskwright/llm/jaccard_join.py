"""Operator 3, exact n-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance is a metric, so a pivot whose distance to two documents is known bounds the distance between them.
Unrelated texts are all at a distance of about 1 from each other and from any pivot, so pivots drawn at random would put
nearly every document on the same boundary. Pivots are therefore made where documents meet: documents within the radius
share one of their rarest shingles (the first ``n - ceil(t n) + 1`` in a common order), and of the documents that hold a
given rare shingle the least is the pivot. The steps:

1. One pass over whole texts gives each set's size, a 128-bit identity (equal sets collapse to one) and a parity bitmap,
   whose differing bits are a lower bound of the symmetric difference. The same pass finds frequent shingles.
2. A second pass emits (rare shingle, set). The least set of each shingle is a partial aggregate; a join gives each set the
   pivots of its regions, and Spark can split a shingle that very many sets hold.
3. Set and pivot are compared exactly where the bounds allow a link. What lies within the radius is linked: a group of
   near copies costs one comparison each, not one for each pair. A pivot of many sets is dealt in salted copies.
4. Regions that still hold several components are cut into rings of one radius by the distance to the pivot; each set
   also joins the next ring, since by the triangle inequality only neighbouring rings can hold a link. Rings join in
   blocks of bounded size, through the bitmaps first, and only pairs of different components that may link are compared
   exactly, most promising pair of two components first.

Nothing is estimated: bounds only exclude, and every link is found by comparing whole sets. Shingles are compared by
64-bit hashes. Results do not depend on the order of the shingles, which is chosen by frequency only to keep regions
small. No set of all documents, link or component reaches the driver.

Edge cases: a null or empty text has no shingles and is its own component; fewer words than ``n`` form one shingle;
repeated rows get the same component; a null id takes part, and a component of null ids alone has a null component id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.components import connected_components
from maskwright.llm.support import materialize, shingle_sets, table, trimmed, word_blocks, worker_cache

#: Bits of the hash by which frequent shingles are told apart when ordering, and how many such cells are kept at most.
CELL_BITS = 24
MAX_CELLS = 1 << 20
#: Shingles counted together in a task, and how often one must occur among them to be reported as frequent.
COUNT_WINDOW = 1 << 22
COUNT_LEAST = 4
#: Members of a block of a region; two blocks are compared in one go.
BLOCK = 256
#: Pairs of one pivot that meet in a task; with more, the pivot's set is copied.
STAR = 4096
#: Rows of a table of keys (at most 64 bytes each) that are broadcast; with more, the join that they are used in shuffles.
MAX_BROADCAST_IDS = 200_000

_CELL_MASK = np.uint64((1 << CELL_BITS) - 1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _identity(grams: np.ndarray, seed: int) -> tuple[int, int]:
    raw = hashlib.blake2b(grams.tobytes(), digest_size=16, key=seed.to_bytes(4, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def parity_bitmap(grams: np.ndarray) -> bytes:
    """For each cell the parity of the number of elements hashed to it; one to two cells an element."""
    bits = max(64, 1 << max(0, len(grams) - 1).bit_length())
    counts = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Lower bound of the symmetric difference of two sets given as (size, bits of the map, map as an integer)."""
    (na, ba, xa), (nb, bb, xb) = a, b
    while ba > bb:
        ba >>= 1
        xa = (xa & ((1 << ba) - 1)) ^ (xa >> ba)
    while bb > ba:
        bb >>= 1
        xb = (xb & ((1 << bb) - 1)) ^ (xb >> bb)
    return max(abs(na - nb), (xa ^ xb).bit_count())


def _bitmap(n: int, raw: bytes) -> tuple[int, int, int]:
    return n, 8 * len(raw), int.from_bytes(raw, "little")


class _Frequent:
    """Counts the cells of a task's shingles in windows; yields (cell, count) of those that occur often in one."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.held.append((grams & _CELL_MASK).astype(np.uint32))
        self.size += len(grams)
        if self.size >= COUNT_WINDOW:
            yield self.flush()

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        cells = np.concatenate([*self.held, np.zeros(0, np.uint32)])
        self.held, self.size = [], 0
        cells.sort()
        # a cell that occurs k times equals the one COUNT_LEAST - 1 places on k - COUNT_LEAST + 1 times
        apart = COUNT_LEAST - 1
        often, more = np.unique(cells[:-apart][cells[:-apart] == cells[apart:]], return_counts=True)
        return often.astype(np.int64), more + apart


def _first_pass(docs: DataFrame, n: int, seed: int) -> DataFrame:
    schema = "kind int, doc_id long, text_key long, n long, h1 long, h2 long, bitmap binary"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        frequent = _Frequent()

        def cells(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            cell, count = found
            void = pa.nulls(len(cell), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(cell), np.int32)), void, void, pa.array(count), pa.array(cell), void, pa.nulls(len(cell), pa.binary())], ["kind", "doc_id", "text_key", "n", "h1", "h2", "bitmap"]
            )

        for batch in it:
            size = np.zeros(len(batch), np.int64)
            ids, maps = np.zeros((len(batch), 2), np.int64), []
            for block in word_blocks(batch.column(2)):
                for d, grams in shingle_sets(block, n):
                    size[d], ids[d] = len(grams), _identity(grams, seed)
                    maps.append(parity_bitmap(grams))
                    for found in frequent.add(grams):
                        yield cells(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(batch), np.int32)), batch.column(0), batch.column(1), pa.array(size), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), pa.array(maps, pa.binary())],
                ["kind", "doc_id", "text_key", "n", "h1", "h2", "bitmap"],
            )
        yield cells(frequent.flush())

    return docs.mapInArrow(trimmed(batches), schema)


def _levels(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent cells and log2 of their counts, at most MAX_CELLS: levels are added from the most frequent down while they fit."""
    cells = first.filter("kind = 1").groupBy(F.col("h1").alias("cell")).agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level"))
    sizes = {level: count for level, count in cells.groupBy("level").count().collect()}
    least, total = 1 << 30, 0
    for level in sorted(sizes, reverse=True):
        if total + sizes[level] > MAX_CELLS:
            break
        total, least = total + sizes[level], level
    got = cells.filter(F.col("level") >= least).collect() if total else []
    return np.array([c for c, _ in got], np.int64), np.array([v for _, v in got], np.uint8)


def _prefixes(docs: DataFrame, n: int, num: int, den: int, seed: int, levels: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sig, sid): the rarest shingles of each set, as many as any set within the radius must share one of."""
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        cells, values = held.value
        level = np.zeros(1 << CELL_BITS, np.uint8)
        level[cells] = values
        seen: set[int] = set()
        for batch in it:
            sigs, sids, lengths = [], [], []
            for block in word_blocks(batch.column(0)):
                for _, grams in shingle_sets(block, n):
                    if not len(grams):
                        continue
                    sid = _identity(grams, seed)[0]
                    if sid in seen:
                        continue
                    if len(seen) < 2_000_000:
                        seen.add(sid)
                    keep = len(grams) + (-len(grams) * num // den) + 1
                    order = np.argsort(level[(grams & _CELL_MASK).astype(np.int64)], kind="stable")
                    sigs.append(grams[order[:keep]])
                    sids.append(sid)
                    lengths.append(keep)
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sigs))), pa.array(np.repeat(np.array(sids, np.int64), lengths))], ["sig", "sid"])

    found = materialize(docs.select("text").mapInArrow(trimmed(batches), "sig long, sid long"), "prefixes")
    held.destroy()
    return found


def _regions(prefixes: DataFrame) -> DataFrame:
    """(pivot, sid): each set and the least set of each rare shingle it holds, where they differ. A shingle of one set makes no region."""
    least = prefixes.groupBy("sig").agg(F.min("sid").alias("pivot"), F.max("sid").alias("last")).filter("pivot <> last").select("sig", "pivot")
    return prefixes.join(least, "sig").filter("sid <> pivot").select("pivot", "sid").distinct()


def _bounded(regions: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Adds the size ``n``, a lower bound ``low`` of the distance to the pivot, and whether a link is still possible (``may``).

    Sizes alone exclude most pairs; only the others are joined with the bitmaps.
    """
    sized = regions.join(sets.select("sid", "n"), "sid").join(sets.select(F.col("sid").alias("pivot"), F.col("n").alias("pn")), "pivot")
    sized = materialize(sized.withColumn("fit", F.least("n", "pn") * den >= F.greatest("n", "pn") * num), "sized")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        for batch in it:
            p, s, n, pn, b, pb = (c.to_pylist() for c in batch.columns)
            low, may = [], []
            for k in range(len(p)):
                diff = least_difference(_bitmap(n[k], b[k]), _bitmap(pn[k], pb[k]))
                total = n[k] + pn[k]
                low.append(2 * diff / (total + diff))
                may.append(diff * (den + num) <= total * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(low, pa.float64()), pa.array(may, pa.bool_())], ["pivot", "sid", "n", "low", "may"])

    member = sets.select("sid", "bitmap")
    pivot = sets.select(F.col("sid").alias("pivot"), F.col("bitmap").alias("pb"))
    rows = sized.filter("fit").join(member, "sid").join(pivot, "pivot").select("pivot", "sid", "n", "pn", "bitmap", "pb")
    near = rows.mapInArrow(trimmed(batches), "pivot long, sid long, n long, low double, may boolean")
    far = sized.filter("not fit").select("pivot", "sid", "n", (1 - F.least("n", "pn") / F.greatest("n", "pn")).alias("low"), F.lit(False).alias("may"))
    return near.unionByName(far)


def _sent(keys: DataFrame) -> DataFrame:
    """A table of keys, broadcast if it is small enough; else the join that it is used in shuffles."""
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST_IDS else keys


def _whole_sets(docs: DataFrame, n: int, seed: int, sids: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, grams) of the given sets, computed again from the texts of one document each."""
    wanted = sids.join(sets.select("sid", "rep"), "sid").select(F.col("rep").alias("rep"), F.col("sid").alias("wanted"))
    wanted = materialize(wanted, "wanted")
    ids = _sent(wanted.select("rep").distinct())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        for batch in it:
            sid, raw = [], []
            for block in word_blocks(batch.column(0)):
                for _, grams in shingle_sets(block, n):
                    sid.append(_identity(grams, seed)[0])
                    raw.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(raw, pa.binary())], ["sid", "grams"])

    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    found = texts.mapInArrow(trimmed(batches), "sid long, grams binary")
    # an id may be repeated with another text, and that one's set is not asked for; equal sets count once
    return found.join(wanted.select(F.col("wanted").alias("sid")).distinct(), "sid", "left_semi").dropDuplicates(["sid"])


def _verified(pairs: DataFrame, grams: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, distance, linked) of each pair, by whole sets."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        for batch in it:
            distance, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                gx, gy = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(gx, gy)
                at[at == len(gx)] = 0
                inter = int((gx[at] == gy).sum())
                union = len(gx) + len(gy) - inter
                distance.append(1 - inter / union)
                linked.append(den * inter >= num * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "distance", "linked"])

    hubs = _sent(materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts")).filter("salts > 1"), "hubs"))
    salts = F.coalesce("salts", F.lit(1))
    left = pairs.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    pivots = grams.select(F.col("sid").alias("a"), F.col("grams").alias("ga")).join(hubs, "a", "left").select("a", "ga", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rows = left.join(pivots, ["a", "salt"]).join(grams.select(F.col("sid").alias("b"), F.col("grams").alias("gb")), "b")
    return rows.select("a", "b", "ga", "gb").mapInArrow(trimmed(batches), "a long, b long, distance double, linked boolean")


CELL = ["pivot", "ring", "class"]


def _cells(members: DataFrame, num: int, den: int) -> DataFrame:
    """Members by cell (pivot, ring, class).

    ``members(pivot, sid, low, high, label)``: bounds of the distance to the pivot. A member joins every ring its bounds
    touch and the next one; sizes are cut likewise into classes one ratio wide. Any two members that may link share a
    cell, and the first ring and class that both are in is one of them.
    """
    # a little wider than they need to be, so that rounding cannot part two that may link
    radius, ratio = (den - num) / den * 1.0000001, math.log(den / num) * 1.0000001
    ring = members.withColumn("own_class", F.floor(F.log(F.col("n")) / ratio).cast("int"))
    ring = ring.withColumn("class", F.explode(F.array("own_class", F.col("own_class") + 1)))
    ring = ring.withColumn("own_ring", F.floor(F.col("low") / radius).cast("int"))
    return ring.withColumn("ring", F.explode(F.sequence("own_ring", (F.floor(F.col("high") / radius) + 1).cast("int"))))


def _cell_pairs(ring: DataFrame, sets: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """(pivot, ring, class, a, b, la, lb, low): pairs of different components that may link, from each cell.

    With ``best`` one pair of each two components in a cell, the most promising.
    The members of a cell are split into blocks by hash, and each two blocks are compared by bitmaps.
    """
    radius = (den - num) / den * 1.0000001
    # neither a ring of one component nor one in which only the pivot's own component is near needs comparing
    # a pair meets where the later of the two starts, so a cell in which none starts has nothing to compare
    size = ring.groupBy(*CELL).agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("own_ring").alias("r"), F.max("own_class").alias("c"))
    size = size.filter((F.col("l0") != F.col("l1")) & (F.col("r") == F.col("ring")) & (F.col("c") == F.col("class")))
    size = materialize(size.select(*CELL, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "cells")
    blocks = ring.join(_sent(size), CELL)  # members of a crowded cell need not meet for this
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
    rows = blocks.join(sets.select("sid", "bitmap"), "sid").select(*CELL, "bi", "bj", "own", "sid", "n", "bitmap", "low", "high", "label", "own_ring", "own_class")
    rows = rows.repartition(*CELL, "bi", "bj").sortWithinPartitions(*CELL, "bi", "bj")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        key, group, out = None, [], []

        def compare() -> None:
            *cell, bi, bj = key
            most: dict[tuple[int, int], tuple[float, int, int]] = {}
            for i, (own, sid, n, bits, low, high, label, r, c) in enumerate(group):
                for own2, sid2, n2, bits2, low2, high2, label2, r2, c2 in group[i + 1 :]:
                    if label == label2 or bi != bj and own == own2 or low - high2 > radius or low2 - high > radius:
                        continue
                    if max(r, r2) != cell[1] or max(c, c2) != cell[2]:
                        continue
                    if min(n, n2) * den < max(n, n2) * num:
                        continue
                    diff = least_difference(bits, bits2)
                    if diff * (den + num) > (n + n2) * (den - num):
                        continue
                    pair = (2 * diff / (n + n2 + diff), min(sid, sid2), max(sid, sid2))
                    two = (min(label, label2), max(label, label2))
                    if not best:
                        out.append((*cell, *two, *pair))
                    elif two not in most or pair < most[two]:
                        most[two] = pair
            out.extend((*cell, *two, *pair) for two, pair in most.items())

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            out.clear()
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*CELL, "la", "lb", "low", "a", "b"])

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != key:
                    if key is not None:
                        compare()
                    key, group = row[:5], []
                own, sid, n, raw, *bounds = row[5:]
                group.append((own, sid, n, _bitmap(n, raw), *bounds))
            if len(out) > 10_000:
                yield flush()
        if key is not None:
            compare()
        yield flush()

    return rows.mapInArrow(trimmed(batches), "pivot long, ring int, class int, la long, lb long, low double, a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    named = labels.select(F.col("node").alias(node), F.col("label").alias("_label"))
    return rows.join(named, node, "left").withColumn(out, F.coalesce("_label", F.col(node))).drop("_label")


def _merged(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Component labels after further links (a, b)."""
    edges = _labelled(_labelled(links, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    more = connected_components(edges, name).select(F.col("node").alias("label"), F.col("label").alias("next"))
    old = labels.join(more, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    new = more.select(F.col("label").alias("node"), F.col("next").alias("label")).join(labels.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new), f"{name}-merged")


def _link(docs: DataFrame, n: int, seed: int, num: int, den: int, pairs: DataFrame, sets: DataFrame, grams: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(labels, grams) after comparing further pairs exactly."""
    pairs = materialize(pairs, f"pairs-{name}")
    if pairs.isEmpty():
        return labels, grams
    extra = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct().join(grams.select("sid"), "sid", "left_anti")
    grams = grams.unionByName(materialize(_whole_sets(docs, n, seed, extra, sets), f"grams-{name}"))
    found = materialize(_verified(pairs, grams, num, den), f"checked-{name}")
    return _merged(labels, found.filter("linked").select("a", "b"), f"merge-{name}"), grams


def set_components(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): rows(doc_id, text_key, n, h1, h2) for each document, labels(node, label) for sets linked with others."""
    seed = 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    while True:
        first = materialize(_first_pass(docs, n, seed), "sets")
        rows = first.filter("kind = 0").drop("kind")
        sets = rows.filter("n > 0").groupBy(F.col("h1").alias("sid")).agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.min("h2").alias("h2"), F.max("h2").alias("h2b"))
        sets = materialize(sets, "distinct")
        if sets.filter("h2 <> h2b").isEmpty():
            break
        seed += 1  # two sets share 64 bits of their identity: choose other identities
    regions = materialize(_bounded(_regions(_prefixes(docs, n, num, den, seed, _levels(first))), sets, num, den), "regions")

    # pivots against the sets of their regions
    near = regions.filter("may").select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    wanted = near.select(F.col("a").alias("sid")).unionByName(near.select(F.col("b").alias("sid"))).distinct()
    grams = materialize(_whole_sets(docs, n, seed, wanted, sets), "grams")
    star = materialize(_verified(near, grams, num, den), "star")
    labels = connected_components(star.filter("linked"), "star")

    # what is left in regions of several components
    exact = star.select(F.col("a").alias("pivot"), F.col("b").alias("sid"), "distance")
    members = regions.join(exact, ["pivot", "sid"], "left").select("pivot", "sid", "n", F.coalesce("distance", "low").alias("low"), F.coalesce("distance", F.lit(1.0)).alias("high"))
    # first the most promising pair of each two components, whose links often join the others too; then all that remain
    ring = _cells(members, num, den)
    best = materialize(_cell_pairs(_labelled(ring, labels, "sid", "label"), sets, num, den, True), "best")
    labels, grams = _link(docs, n, seed, num, den, best.groupBy("la", "lb").agg(F.min(F.struct("low", "a", "b")).alias("p")).select("p.a", "p.b"), sets, grams, labels, "best")
    apart = _labelled(_labelled(best.drop("la", "lb"), labels, "a", "la"), labels, "b", "lb").filter("la <> lb")
    # a cell that gave a pair of components which are still apart is searched again, whole
    again = materialize(ring.join(_sent(materialize(apart.select(*CELL).distinct(), "apart")), CELL, "left_semi"), "again")
    if not again.isEmpty():
        rest = _cell_pairs(_labelled(again, labels, "sid", "label"), sets, num, den, False).select("a", "b").distinct()
        labels, _ = _link(docs, n, seed, num, den, rest, sets, grams, labels, "rest")
    return rows, labels


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), n_shingles, component (an opaque key) and component_id.

    Documents link when den * |x and y| >= num * |x or y| for their sets of distinct n-word shingles, lower-cased A-Z.
    ``component_id`` is the smallest doc_id reachable by links.
    """
    rows, labels = set_components(docs, n, num, den)
    keyed = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("h1")).alias("sid"))
    keyed = keyed.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("label", "sid").alias("component"))
    keyed = materialize(keyed, "labelled")
    # only components of several rows are joined back, so that one of very many rows need not meet in a task
    least = keyed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    least = materialize(least.select(F.col("component").alias("shared"), "least"), "least")
    both = keyed.join(_sent(least), F.col("component") == F.col("shared"), "left")
    return both.select("doc_id", "text_key", "n_shingles", "component", F.when(F.col("shared").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: the one of the smallest id, then of the smallest text hash,
    then the first by its columns as JSON.

    Documents without words are linked with nothing and stay.
    """
    found = jaccard_join(docs, n, num, den).filter("component is not null")
    chosen = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    groups = materialize(found.join(_sent(materialize(chosen.select("component", "best"), "best-rows")), "component"), "groups")
    key = F.struct("doc_id", "text_key")
    gone = groups.filter(~key.eqNullSafe(F.col("best"))).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    twice = groups.filter(key.eqNullSafe(F.col("best"))).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).count().filter("count > 1").drop("count")
    several = not twice.isEmpty()
    gone, twice = _sent(gone), _sent(twice)
    same = lambda keys: docs["doc_id"].cast("long").eqNullSafe(keys["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["_key"])
    if not several:
        return docs.join(gone, same(gone), "left_anti")
    both = _sent(gone.unionByName(twice))
    rest = docs.join(both, same(both), "left_anti")
    # rows equal in id and text but not in other columns: the one whose columns come first as JSON
    row = F.struct(*docs.columns)
    return rest.unionByName(docs.join(twice, same(twice), "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_jaccard_join": op3_jaccard_join}

ORACLES = {
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
one AS (SELECT x, y FROM shared JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
links AS (SELECT x, y FROM one UNION ALL SELECT y, x FROM one),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT a, y FROM reach JOIN links ON x = b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.r = d.r JOIN (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a) c ON c.a = d.r
"""
}
