"""Operator 4, sharding by extendible hashing.

Every row has a 64-bit hash; a shard is a prefix of its bits. From one shard of depth 0 on, only shards over the byte limit
split on one more bit, until each fits. The depths up to the one where an average shard fits are decided at once, from
the sizes of that depth's prefixes; rows are moved for it and for each depth below. Only (hash, bytes) pairs are shuffled,
never texts, and the driver sees counts alone.

Equal rows would share all bits, so the hash (64 bits of an md5) covers the id, the text's hash and the number of the copy
among equal rows: any shard of two or more rows can be split. A single row larger than the limit ends in a shard of its own,
flagged ``oversized``. A null or empty text has 0 bytes; a null id is a value like any other; an empty table gives no shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.support import materialize, table

#: Largest number of bytes of text in a shard, unless one row alone is larger.
SHARD_BYTES = 4 << 20
MAX_DEPTH = 60


def _prefix(hash_col: Column, depth: Column) -> Column:
    """The first ``depth`` bits of a hash, as text; the empty text at depth 0."""
    bits = F.lpad(F.bin(hash_col), 64, "0")
    return F.substring(bits, F.lit(1), depth)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, bytes, hash), one row per input row. Copies of a row are counted before the shuffle and numbered after it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("bytes"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("content"))
    counted = rows.groupBy("doc_id", "bytes", "content").agg(F.count(F.lit(1)).alias("n"))
    numbered = counted.select("doc_id", "bytes", "content", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "content", "copy")
    return numbered.select("doc_id", "bytes", F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, -10).cast("long").alias("hash"))


def _splits(size: str, rows: str, max_bytes: int) -> Column:
    return (F.col(size) > max_bytes) & (F.col(rows) > 1)


def least_depths(buckets: DataFrame, depth: int, max_bytes: int) -> DataFrame:
    """(bucket, at, shard_bytes, shard_rows): for each prefix of ``depth`` bits, the least depth whose prefix need not split, and that shard's size; none: no row."""
    levels = buckets.select("bucket", "bytes", "rows", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("at")).withColumn("prefix", F.substring("bucket", F.lit(1), F.col("at")))
    nodes = levels.groupBy("prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")).filter(~_splits("shard_bytes", "shard_rows", max_bytes))
    # halves of what fits fit as well, so the least depth is where splitting from depth 0 ends
    return levels.select("bucket", "at", "prefix").join(nodes, "prefix").groupBy("bucket").agg(F.min(F.struct("at", "shard_bytes", "shard_rows")).alias("least")).select("bucket", "least.*")


def assign_shards(docs: DataFrame, max_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, bytes, shard (its prefix bits), depth, shard_bytes, shard_rows, oversized."""
    open_rows = materialize(keyed_rows(docs, id_col, text_col), "keyed")
    total = open_rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = max(0, (max(1, total // max_bytes) - 1).bit_length())
    sized = open_rows.withColumn("bucket", _prefix(F.col("hash"), F.lit(depth)))
    buckets = materialize(sized.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "buckets")
    marked = materialize(sized.join(least_depths(buckets, depth, max_bytes), "bucket", "left"), f"depth-{depth}")
    done = marked.filter("at is not null").select(
        "doc_id", "bytes", F.substring("bucket", F.lit(1), F.col("at")).alias("shard"), F.col("at").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") > max_bytes).alias("oversized")
    )
    open_rows = marked.filter("at is null").select("doc_id", "bytes", "hash")
    while not open_rows.isEmpty():
        depth += 1
        sized = open_rows.withColumn("shard", _prefix(F.col("hash"), F.lit(depth)))
        shards = sized.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
        over = _splits("shard_bytes", "shard_rows", max_bytes) & F.lit(depth < MAX_DEPTH)
        marked = materialize(
            sized.join(shards, "shard").select("doc_id", "bytes", "hash", "shard", F.lit(depth).alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") > max_bytes).alias("oversized"), over.alias("split")), f"depth-{depth}"
        )
        done = done.unionByName(marked.filter("not split").drop("split", "hash"))
        open_rows = marked.filter("split").select("doc_id", "bytes", "hash")
    return done


def with_directory(shards: DataFrame) -> DataFrame:
    """``shards`` with ``global_depth``, the bits of the directory, and ``entries``, how many of its 2^global_depth
    entries point to the row's shard; entries of a half without rows belong to none."""
    deepest = shards.agg(F.max("depth").alias("global_depth"))  # one row
    return shards.crossJoin(F.broadcast(deepest)).withColumn("entries", F.expr("shiftleft(cast(1 as bigint), global_depth - depth)"))


def directory(shards: DataFrame) -> DataFrame:
    """The hash directory: one row per shard with its bits, depth, rows, bytes and number of entries."""
    return with_directory(shards.select("shard", "depth", "shard_bytes", "shard_rows", "oversized").distinct())


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_directory(assign_shards(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_extendible_shards": op4_extendible_shards}

_BITS = "array_to_string(list_transform(range(1, 17), lambda i: right(bin(strpos('0123456789abcdef', substr({h}, i, 1)) + 15), 4)), '')"
_SPLITS = f"(shard_bytes > {SHARD_BYTES} AND shard_rows > 1)"

ORACLES = {
    "op4_extendible_shards": f"""
WITH k AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, md5(coalesce(text, '')) AS content FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bytes, content) AS copy FROM k),
h AS (SELECT row_number() OVER () AS r, doc_id, bytes, {_BITS.format(h="md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || content || ':' || copy)")} AS bits FROM n),
l AS (SELECT r, doc_id, bytes, CAST(d AS INTEGER) AS depth, substr(bits, 1, d) AS shard FROM h, range({MAX_DEPTH + 1}) t(d)),
s AS (SELECT shard, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY shard),
f AS (SELECT l.r, min(depth) AS depth FROM l JOIN s USING (shard) WHERE NOT {_SPLITS} OR depth = {MAX_DEPTH} GROUP BY l.r)
SELECT doc_id, bytes, shard, depth, shard_bytes, shard_rows, shard_bytes > {SHARD_BYTES} AS oversized,
  max(depth) OVER () AS global_depth, CAST(1 AS BIGINT) << (max(depth) OVER () - depth) AS entries
FROM l JOIN f USING (r, depth) JOIN s USING (shard)
"""
}
