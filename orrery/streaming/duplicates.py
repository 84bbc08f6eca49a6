"""Copies among files that arrive over time.

State is kept by what a file is (its size and digest): the key of the first
file seen with it.  Files that come later find it, whatever batch it came in;
the kept file never changes.  Where state has a time to live, a file that
comes after that is a first one again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAIRS = "keep {kind}, duplicate {kind}, sha256 string, size long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeepFirst(StatefulProcessor):
    """Pairs of the kept file and each later one of a key (size, digest)."""

    def __init__(self, kind: str, live_ms: int | None):
        self.kind, self.live_ms = kind, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", f"keep {self.kind}", self.live_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size, digest = key
        keep = self.kept.get()[0] if self.kept.exists() else None
        waiting = []  # keys of one batch, whose size the trigger bounds
        for batch in rows:
            waiting.append(batch["file"])
        arrived = pd.concat(waiting).sort_values(kind="stable")
        if keep is None:
            keep = arrived.iloc[0]
            keep = keep.item() if hasattr(keep, "item") else keep
            self.kept.update((keep,))
            arrived = arrived.iloc[1:]
        if len(arrived):
            yield pd.DataFrame({"keep": keep, "duplicate": arrived.to_numpy(), "sha256": digest, "size": size})

    def close(self) -> None:
        pass


def duplicates(stream: DataFrame, key: str, content: str, live_ms: int | None = None) -> DataFrame:
    """(keep, duplicate, sha256, size) of a stream of (key, content) rows; output mode append.

    Of the files of one batch with the same bytes the smallest key is kept, if
    none was before.  Rows without a key or content take no part; a key that
    comes again is a copy of itself only if its row comes again.  ``live_ms``
    bounds the state by the time since a kept file came; without it state
    grows by a row per distinct content.  The session needs the RocksDB state
    store (:func:`use_state_store`).
    """
    kind = dict(stream.dtypes)[key]
    sized = stream.where(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).alias("file"), F.octet_length(content).cast("long").alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    # contents end here: only keys, sizes and digests are shuffled
    grouped = sized.groupBy("size", "sha256")
    return grouped.transformWithStateInPandas(KeepFirst(kind, live_ms), PAIRS.format(kind=kind), "Append", "ProcessingTime" if live_ms else "None")


def use_state_store(spark) -> None:
    """Keyed state of any size needs a store on disk, with checkpoints in the stream's folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def run_batches(pairs: DataFrame, target: str, checkpoint: str) -> None:
    """Take in what is there, then stop; state and outputs go on from the checkpoint.  For streams without a time to live."""
    _writer(pairs, target, checkpoint).trigger(availableNow=True).start().awaitTermination()


def started(pairs: DataFrame, target: str, checkpoint: str, every: str):
    """A query that runs by the clock, as streams with a time to live need it."""
    return _writer(pairs, target, checkpoint).trigger(processingTime=every).start()


def _writer(pairs: DataFrame, target: str, checkpoint: str):
    return pairs.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
