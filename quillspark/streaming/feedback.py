"""The decision log as a stream: the parked set as keyed state, and examples merged once per batch.

Both give what the batch operators give on the same records, whatever is killed and started again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators import feedback, vectors
from quillspark.scratch import materialize
from quillspark.sources.store import merge_store, merged_batch, read_store
from quillspark.sources.readers import exists

PARKED = "original_filename string, parked boolean, ts string, note string, seq long"


def _latest(forget_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()  # it was not parked any more, and nothing has come for long
            return
        held = state.get if state.exists else None
        before, at = held, 0
        for b in batches:
            at = max([at, *(b["at"].astype("int64") // 1000)])
            for event, ts, note, seq in zip(b["event"], b["ts"], b["note"], b["seq"], strict=True):
                if held is None or seq > held[3]:
                    held = (event, None if pd.isna(ts) else ts, None if pd.isna(note) else note, int(seq))
        if held is None or held == before:
            return
        state.update(held)
        parked = held[0] == "parked"
        if forget_ms and not parked:
            state.setTimeoutTimestamp(max(int(at), state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame([(key[0], parked, *held[1:])], columns=["original_filename", "parked", "ts", "note", "seq"])

    return run


def parked_changes(log: DataFrame, *, forget_ms: int | None = None) -> DataFrame:
    """(original_filename, parked, ts, note, seq): a row whenever the latest park-related record of a file changes.

    A file's state is that record alone; it is kept as long as the file is parked.  Of files that are not, it is dropped
    when records are ``forget_ms`` later than its last, by ``ts``, where that is given; records that come that late are
    passed over."""
    relevant = log.where(F.col("event").isin(*feedback.PARK_EVENTS))
    at = F.coalesce(F.try_to_timestamp("ts"), F.current_timestamp()).alias("at")
    relevant = relevant.select("original_filename", "event", "ts", "note", "seq", at)
    if forget_ms:
        relevant = relevant.withWatermark("at", f"{forget_ms} milliseconds")
    timeout = GroupStateTimeout.EventTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    return relevant.groupBy("original_filename").applyInPandasWithState(_latest(forget_ms), PARKED, "event string, ts string, note string, seq long", "update", timeout)


def keep_parked(log: DataFrame, root: str, checkpoint: str, *, forget_ms: int | None = None) -> StreamingQuery:
    """Keep the last row of ``parked_changes`` of every file in a store (``sources.store``), until there is nothing new."""

    def write(batch: DataFrame, number: int) -> None:
        merge_store(materialize(batch, "parked"), root, key=("original_filename",), batch=(checkpoint, number))

    changes = parked_changes(log, forget_ms=forget_ms)
    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parked_now(spark, root: str) -> DataFrame:
    """(original_filename, ts, note, seq) of the files that are parked."""
    return read_store(spark, root).where("parked").select("original_filename", "ts", "note", "seq")


def keep_index(log: DataFrame, root: str, checkpoint: str, embed, model: str = "null", *, retry: str | None = None) -> StreamingQuery:
    """Embed the records of a log as they come and merge them into a store, each batch once.

    Records whose embedding fails are not stored; they are appended to ``retry`` (Parquet), if given, as a log of their
    own for a later run."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if merged_batch(spark, root, checkpoint) >= number:
            return
        records = materialize(batch, "records")
        keys = [*vectors.KEY]
        store = read_store(spark, root) if exists(spark, f"{root.rstrip('/')}/versions") else records.limit(0).select(*keys).withColumn("embedding", F.array().cast("array<float>"))
        fresh = records.join(store.select(*keys), keys, "left_anti")
        after, outcomes = vectors.indexed(fresh, store.limit(0), embed, model)
        if retry:  # before the merge: a batch that comes again writes its own part anew
            failed = fresh.join(outcomes.where("outcome = 'error'").select(*keys, "seq"), [*keys, "seq"], "left_semi")
            failed.write.mode("overwrite").parquet(f"{retry.rstrip('/')}/batch={number}")
        merge_store(after, root, batch=(checkpoint, number))

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
