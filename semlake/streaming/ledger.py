"""A cost ledger fed by a stream: each micro-batch is added exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.operators import records
from semlake.sources.store import Store

def start(deltas: DataFrame, store: Store, checkpoint: str, table: str = "ledger", **trigger):
    """deltas: a stream of (key, counters, finished, model, ts). A micro-batch is written as a delta of the ledger, in one commit
    with its number, so a batch that is run again after a crash adds nothing; deltas are folded by the store."""

    def add(batch: DataFrame, number: int) -> None:
        change = store.change()
        before = change.streams.get(checkpoint, -1)
        change.add(table, records.fold_costs(batch), checkpoint, number)
        if change.streams.get(checkpoint, -1) > before:
            change.commit()

    return deltas.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_costs(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Cost by key and window of event time, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.sum("cost_usd").alias("cost_usd"))
