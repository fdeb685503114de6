"""Streaming forms of the incremental passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.store import Store, merge_postings, merge_seen

MARK = "source string, external_id string, accepted boolean, seen_at timestamp"
KEY = ["source", "external_id"]


def first_seen(stream: DataFrame, delay: str = "1 day", time: str = "seen_at") -> DataFrame:
    """The first row of each (source, external_id) within the delay: state goes with the watermark, and a repeat that comes later than
    that counts as new. For evaluations that hold for good, see first_evaluations."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(KEY)


#: Keys lie in so many buckets of the state. Fixed: a checkpoint's keys are found by it.
BUCKETS = 4096
#: A bucket's list of batches is made one entry beyond so many.
MOST_ENTRIES = 64


class _First(StatefulProcessor):
    """Holds a bucket's keys, without a time limit: an entry a batch that brought new ones. So Python is called, and the state asked, once
    a bucket of a batch, and not once a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "source array<string>, external_id array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for f in rows:
            best = _first(f if best is None else pd.concat([best, f]))
        if best is None:
            return
        entries = list(self.known.get())
        seen = {k for e in entries for k in zip(e[0], e[1], strict=True)}
        fresh = best[[k not in seen for k in zip(best["source"], best["external_id"], strict=True)]]
        if len(fresh):
            self._add(fresh, entries)
            yield fresh[["source", "external_id", "accepted", "seen_at"]].reset_index(drop=True)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            self.known.appendList([_entry(initialState)])

    def _add(self, fresh: pd.DataFrame, entries: list) -> None:
        new = _entry(fresh)
        if len(entries) < MOST_ENTRIES:
            self.known.appendList([new])
        else:
            self.known.put([tuple([x for e in (*entries, new) for x in e[i]] for i in (0, 1))])

    def close(self) -> None:
        pass


def _entry(rows: pd.DataFrame) -> tuple[list[str], list[str]]:
    return rows["source"].tolist(), rows["external_id"].tolist()


def _first(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["seen_at", "accepted"]).drop_duplicates(KEY)


def _first_of_each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield _first(f)


def first_evaluations(stream: DataFrame, seen: DataFrame) -> DataFrame:
    """Evaluations (source, external_id, accepted, seen_at) of keys that were never evaluated before: not in the stream, however long
    ago, nor in `seen`, the relation with which the first start of the query begins.

    Of a batch's rows of one key the earliest counts (of equals, the rejected one). The state is the keys, in buckets by their hash: a batch
    reads the buckets in which its keys lie and appends its new keys to them. It grows with the keys and is never dropped, so the session
    needs the RocksDB state store, which keeps it on disk. A key's rows are thinned out before they are shuffled, so that a hot key doesn't
    fill a task. Null keys and times are left out. Checkpoints of the form before, a value a key, can't be gone on with.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    if not str(stream.sparkSession.conf.get(name, "")).endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {name} to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    whole = "source IS NOT NULL AND external_id IS NOT NULL AND seen_at IS NOT NULL"
    shape = [*KEY, F.coalesce("accepted", F.lit(False)).alias("accepted"), "seen_at"]
    thin = stream.where(whole).select(*shape).mapInPandas(_first_of_each, MARK)
    dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")).groupBy("bucket")
    return dealt(thin).transformWithStateInPandas(_First(), MARK, "Append", "None", dealt(seen.where(whole).select(*shape)))


def store_stream(stream: DataFrame, store: Store, checkpoint: str, name: str, relation: str = "postings", order: tuple[str, ...] = ("ordinal",)) -> StreamingQuery:
    """Merges each batch of postings (or seen marks) into the store. Only buckets in which keys of the batch lie are rewritten. The
    store knows the last batch of this name, so that a batch that is replayed after a crash is merged once."""

    def apply(batch: DataFrame, number: int) -> None:
        merge = merge_seen(order) if relation == "seen" else merge_postings(F.current_timestamp(), order)
        store.merge({relation: (batch, merge)}, stream=name, batch=number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
