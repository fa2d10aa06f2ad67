"""Dataset engineering: log parsing, redaction, leakage-aware splits, deduplication, statistics and manifests."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.detectors import lists

# The layout of a log line, and what is redacted by what, in order.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)\s+\[(\w+)\]\s+([^:]+):\s+(.*)$"
REDACTIONS = (
    (r"(?i)\b(?:postgres|mysql|mongodb|redis)://[^\s']+", "[REDACTED-DB-URL]"),
    (r"(?i)(?:https?|ftp)://[^\s']+", "[REDACTED-URL]"),
    (r"(?i)\b(?:password|pwd|secret|token|key)\s*[:=]\s*([^\s';]+)", "[REDACTED-CRED]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED-IP]"),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[REDACTED-EMAIL]"),
    (r"\b(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32,64})\b", "[REDACTED-HASH]"),
)
SPLITS = ("train", "val", "test")


def parse_log(line: Column) -> Column:
    """struct<ts, level, category, message>; a line of another shape is all message."""
    part = lambda k: F.nullif(F.regexp_extract(line, LOG_LINE, k), F.lit(""))
    return F.struct(part(1).alias("ts"), part(2).alias("level"), part(3).alias("category"), F.when(line.rlike(LOG_LINE), F.regexp_extract(line, LOG_LINE, 4)).otherwise(line).alias("message"))


REDACTED = "struct<text:string,findings:array<struct<start:int,end:int,placeholder:string>>>"
_COMPILED = [(re.compile(pattern, re.A), placeholder) for pattern, placeholder in REDACTIONS]


def redacted(message: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Findings are places in the original; a replacement runs over what the ones before left, if its pattern hit the original."""
    out, found = message, []
    for rx, placeholder in _COMPILED:
        hits = [(*m.span(), placeholder) for m in rx.finditer(message)]
        if hits:
            out, found = rx.sub(lambda _, p=placeholder: p, out), found + hits
    return out, found


def redact(message: Column) -> tuple[Column, Column]:
    """(redacted message, findings as array<struct<start, end, placeholder>>), on Arrow batches; a null message has neither."""

    @F.arrow_udf(REDACTED)
    def done(messages: pa.Array) -> pa.Array:
        rows = [(None, []) if x is None else redacted(x) for x in messages.to_pylist()]
        fields = (("start", pa.int32()), ("end", pa.int32()), ("placeholder", pa.string()))
        return pa.StructArray.from_arrays([pa.array([r for r, _ in rows], pa.string()), lists([f for _, f in rows], fields)], ["text", "findings"])

    out = done(message)
    return out["text"], out["findings"]


def hash_split(key: Column) -> Column:
    """train, val or test by the md5 of a key modulo 100: below 15 test, below 30 val. The hash is a big-endian number."""
    half = lambda k: F.conv(F.substring(F.md5(key), k, 16), 16, 10).cast("decimal(20,0)") % 100
    bucket = (half(1) * 16 + half(17)) % 100  # 2^64 is 16 modulo 100
    return F.when(bucket < 15, "test").when(bucket < 30, "val").otherwise("train")


def dedup_across(records: DataFrame, tokens_col: str = "tokens", split_col: str = "split", order_col: str = "ord") -> DataFrame:
    """One record of each token sequence: of the first split it is in (train, val, test), then the first in order."""
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), F.col(split_col))
    by = Window.partitionBy(F.sha2(F.array_join(F.col(tokens_col), " "), 256)).orderBy(rank, order_col)
    return records.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def _is(tag: str) -> Callable[[Column], Column]:
    return lambda t: t == tag


def split_statistics(records: DataFrame) -> DataFrame:
    """Per split and in total (split null): records, tokens, average (two decimals, half to even), longest, shortest, and spans by type."""
    sized = records.select("split", F.size("tokens").alias("n"), *(F.size(F.filter("tags", _is(f"B-{k}"))).alias(k.lower()) for k in ("SECRET", "PII", "HOSTINFO", "NETWORK")))
    return sized.rollup("split").agg(
        F.count(F.lit(1)).alias("records"), F.sum("n").cast("long").alias("tokens"), F.bround(F.avg("n"), 2).alias("avg_tokens"), F.max("n").alias("max_tokens"), F.min("n").alias("min_tokens"),
        *(F.sum(k).cast("long").alias(k) for k in ("secret", "pii", "hostinfo", "network")),
    )


def family_distribution(records: DataFrame, family_col: str = "family") -> DataFrame:
    return records.groupBy(family_col).agg(F.count(F.lit(1)).alias("n"))


def truncation(records: DataFrame, limit: int = 128) -> DataFrame:
    return records.agg(F.max(F.size("tokens")).alias("longest"), F.count_if(F.size("tokens") > limit).alias("over"))


def split_report(records: DataFrame) -> DataFrame:
    """Per split: records, duplicates by token sequence, and the share of O tags in percent (two decimals)."""
    outside = F.size(F.filter("tags", lambda t: t == "O"))
    return records.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), (F.count(F.lit(1)) - F.countDistinct(F.sha2(F.array_join("tokens", " "), 256))).alias("duplicates"),
        F.bround(100.0 * F.sum(outside) / F.sum(F.size("tags")), 2).alias("outside_percent"),
    )


def manifest(records: DataFrame, id_col: str = "template_id") -> DataFrame:
    """Per split: records, number of templates and a digest that does not depend on the order of rows.

    The digest is the sum of both halves of each record's hash, so repeated records count and nothing is gathered."""
    line = F.sha2(F.to_json(F.struct("tokens", "tags")), 256)
    half = lambda k: F.sum(F.conv(F.substring(line, k, 16), 16, 10).cast("decimal(38,0)")).cast("string")
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct(id_col).alias("templates"), F.sha2(F.concat_ws(":", half(1), half(17)), 256).alias("digest"))


def template_ids(records: DataFrame, id_col: str = "template_id") -> DataFrame:
    """(split, template id) pairs: which templates each split draws on, as rows."""
    return records.select("split", id_col).distinct()


def merge_seeds(*tables: DataFrame) -> DataFrame:
    """Labelled samples (text, spans) of several sources as one table; columns go by name, missing ones are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def row_split(records: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """``records`` with ``split``: about 70, 15 and 15 in a hundred rows, by a hash of the key. A split that no row falls in gets all rows."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(100))
    split = records.withColumn("split", F.when(bucket < 70, "train").when(bucket < 85, "val").otherwise("test"))
    empty = split.agg(F.array_except(F.array(*map(F.lit, SPLITS)), F.collect_set("split")).alias("empty"))  # one row of at most three names
    every = records.crossJoin(F.broadcast(empty)).select(*records.columns, F.explode("empty").alias("split"))
    return split.unionByName(every)


def select_templates(table: DataFrame, family: str | None = None, split: str | None = None) -> DataFrame:
    """Templates (template_id, family, split, text) of a family, a split or both."""
    kept = table if family is None else table.filter(F.col("family") == family)
    return kept if split is None else kept.filter(F.col("split") == split)
