"""History store on Parquet: an append-only log of operations and latest-wins views.

An operation is (at, op, id, item columns...): insert, delete, pin or unpin. Items, search rows and settings are what the
log's operations leave; nothing is updated in place. A batch lies in a folder of its writer and its number: it is atomic,
written twice it is the same batch, and another writer's batch of the same number is another one. Clearing and expiring
log the deletes of the items that they find.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.search import matches, parse_query
from maskwright.settings import Settings

VERSION = 2
ITEM = ("id", "windows_id", "created_at", "content_type", "protection_state", "safe_text", "primary_category", "expires_at", "is_pinned")
LOGGED = (
    ("windows_id", "string"), ("created_at", "timestamp"), ("content_type", "string"), ("protection_state", "string"), ("safe_text", "string"), ("primary_category", "string"),
    ("expires_at", "timestamp"), ("is_pinned", "boolean"), ("search_text", "string"),
)
STATES = ("Normal", "Protected", "Expired", "ReplacementFailed")


def read_item(df: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Stored rows with defaults: null text is '', unknown states and categories are Normal."""
    known = lambda c, values: F.when(F.col(c).isin(*values), F.col(c)).otherwise("Normal")
    return df.withColumns({"safe_text": F.coalesce("safe_text", F.lit("")), "protection_state": known("protection_state", STATES), "primary_category": known("primary_category", categories), "is_pinned": F.coalesce(F.col("is_pinned"), F.lit(False))})


def recent(items: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Pinned first, then newest; the id breaks ties."""
    return items.orderBy(F.col("is_pinned").desc(), F.col("created_at").desc(), F.col("id")).offset(offset).limit(limit)


def get(items: DataFrame, item_id: str) -> DataFrame:
    return items.filter(F.col("id") == item_id)


def delete(items: DataFrame, search: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and search rows without the given ids."""
    return items.join(ids, "id", "left_anti"), search.join(ids.withColumnRenamed("id", "item_id"), "item_id", "left_anti")


def clear_unpinned(items: DataFrame, search: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = items.filter(~F.col("is_pinned")).select("id")
    return delete(items, search, gone)


def delete_expired(items: DataFrame, search: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Without items whose expiry has passed, pinned or not."""
    return delete(items, search, items.filter(F.col("expires_at") <= now).select("id"))


def set_pinned(items: DataFrame, item_id: str, pinned: bool) -> DataFrame:
    return items.withColumn("is_pinned", F.when(F.col("id") == item_id, F.lit(pinned)).otherwise(F.col("is_pinned")))


def search_items(items: DataFrame, search: DataFrame, raw: str) -> DataFrame:
    """Items whose search text has every term as a prefix; a blank query gives the recent items."""
    if not raw.strip():
        return recent(items)
    terms = parse_query(raw)
    hits = search.filter(matches(F.col("search_text"), terms)).select(F.col("item_id").alias("id"))
    return items.join(hits, "id", "left_semi")


def replay(log: DataFrame, order: tuple[str, ...] = ("seq",), columns: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """(id, columns, is_pinned) of the items that a log (order columns, op, id, columns) leaves: the last insert of an id that no
    later delete took, with the last pin or unpin after it. All partial aggregates; ``is_pinned`` may be among the columns."""
    seq = F.struct(*order)
    of = lambda *ops: F.col("op").isin(*ops)
    held = log.groupBy("id").agg(
        F.max(F.when(of("insert"), seq)).alias("_ins"), F.max(F.when(of("delete"), seq)).alias("_del"), F.max_by(F.struct(*columns), F.when(of("insert"), seq)).alias("_row"),
        F.max(F.when(of("pin", "unpin"), F.struct(seq.alias("at"), (F.col("op") == "pin").alias("pin")))).alias("_pin"),
    )
    live = held.filter(F.col("_ins").isNotNull() & (F.col("_del").isNull() | (F.col("_del") < F.col("_ins"))))
    own = F.coalesce(F.col("_row.is_pinned"), F.lit(False)) if "is_pinned" in columns else F.lit(False)
    pinned = F.when(F.col("_pin.at") > F.col("_ins"), F.col("_pin.pin")).otherwise(own)
    return live.select("id", *(F.col(f"_row.{c}").alias(c) for c in columns if c != "is_pinned"), pinned.alias("is_pinned"))


def migrate_v1(old: DataFrame) -> DataFrame:
    """First-version rows to the present layout; the search index of that version is not carried over."""
    return old.select(
        "id", "windows_id", "created_at", "content_type", F.when(F.col("is_sensitive") == 1, "Protected").otherwise("Normal").alias("protection_state"),
        F.col("masked_preview").alias("safe_text"), "primary_category", "expires_at", (F.col("is_pinned") == 1).alias("is_pinned"),
    )


def edit_list(values: Column, add: Column | None = None, remove: Column | None = None) -> Column:
    """A settings list with trimmed, distinct, non-blank values: one added at the end, one removed."""
    clean = F.filter(F.array_distinct(F.transform(values, lambda v: F.trim(v))), lambda v: v != "")
    if add is not None:
        clean = F.when(F.trim(add) != "", F.array_union(clean, F.array(F.trim(add)))).otherwise(clean)
    return F.array_remove(clean, F.trim(remove)) if remove is not None else clean


class HistoryStore:
    """Operations appended below a folder; ``items`` and ``search`` are views of what they leave."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def open(self) -> int:
        """Create the store or check its version; a newer version is refused."""
        if not self._exists("version"):
            self.spark.range(1).select(F.lit(VERSION).alias("version")).write.parquet(f"{self.path}/version")
        found = self.spark.read.parquet(f"{self.path}/version").agg(F.max("version")).first()[0]
        if found > VERSION:
            raise ValueError(f"store version {found} is newer than {VERSION}")
        return found

    def append(self, kind: str, rows: DataFrame, stream: str, batch_id: int) -> None:
        """Write one batch of a writer; writing the same batch of the same writer again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/stream={stream}/batch={batch_id}")

    def _log(self, op: str, rows: DataFrame, stream: str | None, batch_id: int) -> None:
        """Log an operation on each of the rows; only inserts hold more than the id."""
        columns = [F.col(c) if op == "insert" else F.lit(None).cast(t).alias(c) for c, t in LOGGED]
        self.append("log", rows.select(F.current_timestamp().alias("at"), F.lit(op).alias("op"), "id", *columns), stream or uuid.uuid4().hex, batch_id)

    def add(self, rows: DataFrame, batch_id: int = 0, stream: str | None = None) -> None:
        """Items with their search text. Without a name of the writer every call is a batch of its own."""
        self._log("insert", rows, stream, batch_id)

    def delete(self, ids: DataFrame, batch_id: int = 0, stream: str | None = None) -> None:
        self._log("delete", ids, stream, batch_id)

    def set_pinned(self, ids: DataFrame, pinned: bool, batch_id: int = 0, stream: str | None = None) -> None:
        self._log("pin" if pinned else "unpin", ids, stream, batch_id)

    def clear_unpinned(self, batch_id: int = 0, stream: str | None = None) -> None:
        self.delete(self.read("items").filter(~F.col("is_pinned")).select("id"), batch_id, stream)

    def expire(self, now: Column | None = None, batch_id: int = 0, stream: str | None = None) -> None:
        """The sweep: log the deletes of items whose expiry has passed, pinned or not."""
        self.delete(self.read("items").filter(F.col("expires_at") <= (F.current_timestamp() if now is None else now)).select("id"), batch_id, stream)

    def read(self, kind: str) -> DataFrame:
        """``items``, or ``search``: rows of live, normal items with a search text."""
        schema = f"at timestamp, op string, id string, {', '.join(f'{c} {t}' for c, t in LOGGED)}, stream string, batch long"
        log = self.spark.read.schema(schema).parquet(f"{self.path}/log") if self._exists("log") else self.spark.createDataFrame([], schema)
        rows = replay(log, ("at", "stream", "batch"), tuple(c for c, _ in LOGGED))
        if kind == "items":
            return rows.select(*ITEM)
        return rows.filter(~F.col("search_text").rlike(r"^\s*$") & (F.col("protection_state") == "Normal")).select(F.col("id").alias("item_id"), "search_text")

    def save_settings(self, settings: Settings, batch_id: int = 0, stream: str | None = None) -> None:
        row = self.spark.range(1).select(F.lit("privacy").alias("key"), F.lit(settings.to_json()).alias("json_value"), F.current_timestamp().alias("at"))
        self.append("settings", row, stream or uuid.uuid4().hex, batch_id)

    def load_settings(self) -> Settings:
        """The latest settings; missing or malformed ones read as the defaults."""
        if not self._exists("settings"):
            return Settings()
        rows = self.spark.read.parquet(f"{self.path}/settings").filter("key = 'privacy'")
        row = rows.agg(F.max_by("json_value", F.struct("at", "stream", "batch")).alias("v")).first()
        return Settings.from_json(row["v"])
