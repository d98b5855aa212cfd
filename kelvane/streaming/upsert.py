"""A live view over a stream of operations: each micro-batch is one committed group.

Within a micro-batch the last operation of a key by (seq, op_idx) counts; between them, commit order. The batch's
number is published in the same manifest as its rows, so a batch that is delivered again, even after a failure between writing and
publishing, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import Delete, Put
from ..operators.live import latest
from ..sources.store import Store


def upsert(stream: DataFrame, store: Store, checkpoint: str, writer: str = "stream", per_group: int = 10_000, trigger: dict | None = None):
    """Starts the query. stream: (seq, op_idx, key, value, tombstone). Micro-batches of up to per_group keys
    are one commit through the driver; larger ones are written by the executors as one batch. Either way keys and values are
    checked alike and one manifest publishes rows and number."""
    def apply(batch: DataFrame, n: int) -> None:
        last = latest(batch).persist()
        try:
            rows = last.limit(per_group + 1).collect()
            if len(rows) > per_group:
                store.write_frame(last.select("key", "value", "tombstone"), token=(writer, n))
            else:
                store.commit_group([[Delete(bytes(r["key"])) if r["tombstone"] else Put(bytes(r["key"]), bytes(r["value"])) for r in sorted(rows, key=lambda r: (r["seq"], r["op_idx"]))]], token=(writer, n))
        finally:
            last.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
