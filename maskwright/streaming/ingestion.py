"""Structured Streaming: ingestion in micro-batches, removal of own writes by keyed state, and the expiry sweep."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskwright.operators.ingest import ingest, stored
from maskwright.sources.store import HistoryStore


def without_own_writes(events: DataFrame) -> DataFrame:
    """Events (kind, text, seq) of a stream without own writes, as (text, seq).

    ``register`` expects one event of its text, ``cancel`` takes that back and ``event`` is swallowed while one is expected.
    The state of a text is one number.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        expected = state.get[0] if state.exists else 0
        out = []
        for kind, text, seq in rows[["kind", "text", "seq"]].itertuples(index=False):
            if kind == "register":
                expected += 1
            elif kind == "cancel":
                expected = max(0, expected - 1)
            elif expected:
                expected -= 1
            else:
                out.append((text, seq))
        if expected:
            state.update((expected,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["text", "seq"])

    keyed = events.select("kind", "text", "seq", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return keyed.groupBy("key").applyInPandasWithState(step, "text string, seq long", "expected long", "append", GroupStateTimeout.NoTimeout)


def persist(outcomes: DataFrame, store: HistoryStore, batch_id: int, stream: str) -> DataFrame:
    """Store what outcome rows keep; the outcomes, where the store fails with PersistenceFailed for the rows it was to keep."""
    try:
        store.add(stored(outcomes), batch_id, stream)
    except Exception:  # the failure is the outcome
        return outcomes.withColumn("outcome", F.when(F.col("outcome").isin("Ignored", "MaskingFailed"), F.col("outcome")).otherwise("PersistenceFailed"))
    return outcomes


def ingest_stream(payloads: DataFrame, store: HistoryStore, checkpoint: str) -> DataStreamWriter:
    """A writer that ingests each micro-batch into the store and then sweeps it.

    Settings are read once per batch. A batch's folder is named by the query's id, which its checkpoint keeps, and the
    batch id: a batch that is tried again replaces itself, and another query never replaces it. A store that fails stops the
    query, which takes the batch up again when restarted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.add(stored(ingest(batch, store.load_settings(), F.current_timestamp())), batch_id, stream)
        store.expire(batch_id=batch_id, stream=f"{stream}-sweep")

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_items(store: HistoryStore) -> DataFrame:
    """Items whose expiry has not passed: what a sweep would leave now."""
    return store.read("items").filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.current_timestamp()))
