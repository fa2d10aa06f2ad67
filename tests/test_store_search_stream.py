import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from maskwright.functions.search import expression, matches, parse_query
from maskwright.operators import ingest as I
from maskwright.settings import Settings
from maskwright.sources import store as R
from maskwright.streaming.ingestion import ingest_stream, live_items, persist, without_own_writes

TEXTS = ["한국 여행", "tiếng Việt", "ёлка и ЙОД", "ΟΔΟΣ σοφός", "がんばる か\u3099", "e\u0301te\u0301 x\u0305y", "ſtrange µm ϕ", "İstanbul ǅ", "דָּבָר", "api key rotation", "foo-bar baz", "bar foo", "Café au lait", "straße 12", "snake_case name", "a b c", "", "déjà-vu 42nd"]
QUERIES = ["한국", "tiếng", "tieng", "ёлка", "елка", "йод", "οδοσ", "σοφος", "がんば", "か", "été", "ete", "x", "y", "strange", "μm", "φ", "istan", "ǆ", "דבר", "api key", "ap", "foo-bar", "foo-b", "-", "café", "cafe", 'a"b*', "strasse", "snake case", "snake_ca", "42", "deja vu", "b a", "caf lait"]


@pytest.mark.parametrize("raw", QUERIES)
def test_search_equals_sqlite(spark, raw):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(TEXTS)))
    expected = {r[0] for r in db.execute("SELECT rowid FROM f WHERE f MATCH ?", (expression(raw),))}
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    assert {r.id for r in df.filter(matches(F.col("t"), parse_query(raw))).collect()} == expected


PAYLOAD = "id string, windows_id string, content_type string, text string, write_ok boolean"


def payloads(spark):
    return spark.createDataFrame(
        [("1", "w1", "Text", "hello world", True), ("2", "w2", "Text", "my password=abc", True), ("3", "w3", "Text", "my password=abc", False), ("4", "w4", "Text", "  \n", True), ("5", "w5", "Image", None, True)], PAYLOAD
    )


def test_ingest_states(spark):
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    got = {r.id: r for r in I.ingest(payloads(spark), Settings(), now).collect()}
    assert [(got[k].protection_state, got[k].outcome) for k in "12345"] == [("Normal", "Success"), ("Protected", "Success"), ("ReplacementFailed", "ReplacementFailed"), ("Normal", "Ignored"), ("Normal", "Success")]
    assert got["2"].safe_text == "my password=***" and got["2"].expires_at == datetime(2024, 1, 1, 0, 15) and got["3"].expires_at is None
    assert got["1"].search_text == "hello world" and got["2"].search_text == "" and got["2"].windows_id is None


def test_store_round_trip(spark, tmp_path):
    store = R.HistoryStore(spark, str(tmp_path / "s"))
    assert store.open() == R.VERSION and store.load_settings() == Settings()
    rows = I.stored(I.ingest(payloads(spark), Settings(), F.current_timestamp()))
    assert store.read("items").count() == store.read("search").count() == 0
    store.add(rows, 0, "a")
    store.add(rows, 0, "a")  # the same batch again changes nothing
    assert store.read("items").count() == 4
    other = rows.withColumn("id", F.concat(F.lit("b"), "id"))
    store.add(other, 0, "b")  # another writer's batch of the same number
    assert store.read("items").count() == 8
    store.delete(other.select("id"))
    assert {r.id for r in store.read("items").collect()} == {"1", "2", "3", "5"}
    assert {r.id for r in R.search_items(store.read("items"), store.read("search"), "wor").collect()} == {"1"}
    store.save_settings(Settings())
    store.save_settings(Settings(mask_emails=False))
    assert not store.load_settings().mask_emails
    items, _ = R.clear_unpinned(R.set_pinned(store.read("items"), "1", True), store.read("search"))
    assert {r.id for r in items.collect()} == {"1"}
    store.expire(F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))
    assert {r.id for r in store.read("items").collect()} == {"1", "3", "5"}, "the protected item has expired"
    store.set_pinned(rows.select("id").filter("id = '1'"), True)
    store.clear_unpinned()
    left = store.read("items").collect()
    assert [(r.id, r.is_pinned) for r in left] == [("1", True)] and store.read("search").count() == 1
    store.add(rows.filter("id = '2'"))
    assert {r.id for r in store.read("items").collect()} == {"1", "2"}, "an id can come again after its delete"


def test_failed_store_is_an_outcome(spark, tmp_path):
    (tmp_path / "s").write_text("not a folder")
    out = persist(I.ingest(payloads(spark), Settings(), F.current_timestamp()), R.HistoryStore(spark, str(tmp_path / "s")), 0, "a")
    assert {r.id: r.outcome for r in out.collect()} == {"1": "PersistenceFailed", "2": "PersistenceFailed", "3": "PersistenceFailed", "4": "Ignored", "5": "PersistenceFailed"}


def test_newer_store_is_refused(spark, tmp_path):
    spark.range(1).select(F.lit(3).alias("version")).write.parquet(str(tmp_path / "s/version"))
    with pytest.raises(ValueError):
        R.HistoryStore(spark, str(tmp_path / "s")).open()


def test_stream_ingests(spark, tmp_path):
    store = R.HistoryStore(spark, str(tmp_path / "s"))
    store.open()
    payloads(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PAYLOAD).parquet(str(tmp_path / "in"))
    query = ingest_stream(stream, store, str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert live_items(store).count() == 4
    again = ingest_stream(stream, store, str(tmp_path / "c2")).trigger(availableNow=True).start()
    again.awaitTermination()
    folders = {p.name for p in (tmp_path / "s" / "log").iterdir() if not p.name.endswith("-sweep")}
    assert {f"stream={q.id}" for q in (query, again)} <= folders, "each query keeps its own history"
    assert "abc" not in " ".join(r.safe_text for r in store.read("items").collect())


def test_stream_drops_own_writes(spark, tmp_path):
    events = [("register", "a", 1), ("event", "a", 2), ("event", "a", 3), ("register", "b", 4), ("cancel", "b", 5), ("event", "b", 6), ("event", "c", 7), ("cancel", "d", 8), ("event", "d", 9)]
    spark.createDataFrame(events, "kind string, text string, seq long").write.parquet(str(tmp_path / "in"))
    stream = without_own_writes(spark.readStream.schema("kind string, text string, seq long").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.seq for r in spark.table("kept").collect()} == {3, 6, 7, 9}
