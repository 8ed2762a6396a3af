"""Streams: apply in micro-batches, transaction assembly with state, and control."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators import replay, txn
from logloom.operators.checkpoint import CheckpointTable


class VersionedTable:
    """A table of live rows in a folder with one version a micro-batch.

    A batch writes a folder of its own and then names it in the list of
    versions; a repeated batch replaces its own version, so at-least-once
    delivery changes nothing. Parquet tables have no MERGE; the new version is
    the old one and the batch, folded by key.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        from pyspark.errors import AnalysisException

        try:
            return [r[0] for r in self.spark.read.schema("version long").parquet(f"{self.path}/versions").distinct().orderBy("version").collect()]
        except AnalysisException:
            return []

    def read(self, before: int | None = None) -> DataFrame | None:
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        if version not in self.versions():
            self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")


def apply_batch(table: VersionedTable, keys: list[str], values: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: whole documents over the table's last version before this batch."""

    def run(batch: DataFrame, number: int) -> None:
        logs = batch.dropDuplicates(["ts_t", "ts_i", "seq"])
        old = table.read(before=number)
        new = replay.last_state(logs, keys, values) if old is None else replay.snapshot_then_log(old, logs, keys, values)
        table.write(new, number)

    return run


def apply_stream(logs: DataFrame, table: VersionedTable, keys: list[str], values: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that applies a stream of logs; with ``available_now`` it stops at the present end (the exit point)."""
    writer = logs.writeStream.foreachBatch(apply_batch(table, keys, values)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


RELEASED = "txn_number long, pos int, op string, ns string, o string, ts_t long, ts_i long, release_t long, release_i long"
#: Groups of transactions that share a state; a state costs much more to call and store than a transaction.
BUCKETS = 4096


def release_stream(logs: DataFrame) -> DataFrame:
    """Operations of transactions as they commit, from a stream of envelope rows.

    A transaction's inner operations wait in state until it ends; a commit emits
    them in order and an abort drops them. There is no time-out: an open
    transaction stays until it ends. Transactions are dealt to ``BUCKETS`` states
    by the hash of (lsid, txn_number); a state holds its open ones only, and is
    written again by every micro-batch that brings it rows.
    """
    wanted = txn.classify(logs).filter("is_txn")
    inner = F.from_json(F.get_json_object("o", "$.applyOps"), txn.INNER)
    bucket = F.pmod(F.xxhash64("lsid", "txn_number"), F.lit(BUCKETS))
    rows = wanted.select(bucket.alias("bucket"), F.hex("lsid").alias("lsid"), "txn_number", "seq", "ts_t", "ts_i", "is_data", "is_final", "abort", F.to_json(inner).alias("inner"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        held = {(session, number): ops for session, number, ops in json.loads(state.get[0])} if state.exists else {}
        columns = ("ts_t", "ts_i", "seq", "lsid", "txn_number", "is_data", "is_final", "abort", "inner")
        rows_ = [row for frame in frames for row in zip(*[frame[c].tolist() for c in columns])]
        ended, out = set(), []
        for t, i, seq, session, number, is_data, is_final, abort, text in sorted(rows_, key=lambda r: r[:3]):
            own = (session, number)
            if own in ended:  # what follows an end in the same batch is dropped
                continue
            if is_data and isinstance(text, str):
                held.setdefault(own, []).extend((seq, k, x.get("op"), x.get("ns"), x.get("o"), t, i) for k, x in enumerate(json.loads(text)))
            if is_final:
                ended.add(own)
                ops = held.pop(own, [])
                if not abort:
                    out += [(number, n, *x[2:], t, i) for n, x in enumerate(sorted(ops, key=lambda x: (x[0], x[1])))]
        if held:
            state.update((json.dumps([(*own, ops) for own, ops in held.items()]),))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["txn_number", "pos", "op", "ns", "o", "ts_t", "ts_i", "release_t", "release_i"])

    return rows.groupBy("bucket").applyInPandasWithState(run, RELEASED, "open string", "append", GroupStateTimeout.NoTimeout)


def save_progress(table: CheckpointTable, name: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: moves the checkpoint to the newest timestamp seen, filtered rows included."""

    def run(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max(F.col("ts_t") * F.lit(1 << 32) + F.col("ts_i"))).first()[0]
        if newest is not None and newest > table.get(name):
            table.save(name, newest)

    return run


def pause_until(query: StreamingQuery, wanted: Callable[[], bool], every: float = 0.5, most: float = 60.0) -> bool:
    """Stops a query when ``wanted`` says so; True if it did within ``most`` seconds."""
    end = time.monotonic() + most
    while time.monotonic() < end and query.isActive:
        if wanted():
            query.stop()
            return True
        time.sleep(every)
    return False


def status(query: StreamingQuery) -> dict:
    """What the status pages show: rows, rates and offsets of the last progress."""
    last = query.lastProgress
    return {} if last is None else {"batch": last["batchId"], "rows": last["numInputRows"], "rows_per_second": last.get("processedRowsPerSecond"), "sources": [s["endOffset"] for s in last["sources"]]}


def lease(now: float, holder: str | None, beat: float, me: str, expiry: float = 15.0) -> str:
    """Who leads: the holder of the lease while its heartbeat is fresh, else whoever asks."""
    return holder if holder and now - beat <= expiry else me


def ticket(tokens: int, capacity: int, wanted: int) -> tuple[bool, int]:
    """Token bucket: whether ``wanted`` may pass, and the tokens left; ``capacity`` 0 is no limit."""
    return (True, tokens) if capacity == 0 else (tokens >= wanted, tokens - wanted if tokens >= wanted else tokens)
