"""Checkpoints: low watermarks, the choice of the sync mode, and their storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schema import CHECKPOINT


def low_watermark(workers: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, ckpt, error) from workers' (ack, unack), both packed timestamps.

    Idle workers, (0, 0), don't count. If all others have acknowledged everything
    the largest ack is safe; else the smallest ack of those with open work. A
    worker that has acknowledged more than it sent is an error, as is no or a zero
    candidate.
    """
    ack, unack = F.col("ack"), F.col("unack")
    idle, settled = (ack == 0) & (unack == 0), (ack == unack)
    behind, stray = unack > ack, (ack > unack) & (unack != 0)
    fresh = (ack > unack) & (unack == 0)
    one = workers.groupBy(*by) if by else workers.groupBy()
    out = one.agg(
        F.max(F.when(settled & ~idle, ack)).alias("done"), F.min(F.when(behind, ack)).alias("open"),
        F.coalesce(F.bool_or(behind | fresh), F.lit(False)).alias("busy"), F.coalesce(F.bool_or(stray), F.lit(False)).alias("stray"),
    )
    found = F.when(F.col("busy"), F.col("open")).otherwise(F.col("done"))
    error = F.when(F.col("stray"), "ack beyond unack").when(found.isNull(), "no candidates ack values found").when(found == 0, "smallest candidates is zero")
    return out.select(*by, F.when(error.isNull(), found).alias("ckpt"), error.alias("error"))


def sync_mode(nodes: DataFrame, ckpts: DataFrame, mode: str, start: int, direct: bool = True) -> DataFrame:
    """One row (mode, begin_ts, error) from ``nodes`` (replset, oldest, newest) and ``ckpts`` (name, ckpt, oplog_disk_queue).

    ``start`` is in seconds. A node needs the full copy if it has a checkpoint
    that its log no longer covers (and no disk queue), or none and either ``mode``
    is all or its log begins at or after the start. The rest is as the docstring of
    the columns: incr from the checkpoints if no node needs it, else all from the
    smallest newest timestamp, else an error if only incr was asked for or the sink
    isn't direct.
    """
    if mode not in ("all", "incr"):
        return nodes.sparkSession.range(1).select(F.lit(mode).alias("mode"), F.lit(0).cast("long").alias("begin_ts"), F.lit(None).cast("string").alias("error"))
    conf = start << 32
    both = nodes.join(ckpts.filter("ckpt > 1").select(F.col("name").alias("replset"), "ckpt", "oplog_disk_queue"), "replset", "left")
    without = F.lit(mode == "all") | (F.lit(conf > 1 << 32) & (F.col("oldest") >= conf))
    lost = (F.col("oldest") >= F.col("ckpt")) & (F.coalesce("oplog_disk_queue", F.lit("")) == "")
    full = F.when(F.col("ckpt").isNull(), without).otherwise(lost)
    one = both.agg(F.coalesce(F.bool_or(full), F.lit(False)).alias("full"), F.min("newest").alias("newest"), F.min(F.coalesce("ckpt", F.lit(conf))).alias("begin"))
    fails = F.col("full") & F.lit(mode == "incr" or not direct)
    return one.select(
        F.when(fails, F.lit(None)).when(F.col("full"), "all").otherwise("incr").alias("mode"),
        F.when(fails, F.lit(None)).when(F.col("full"), F.col("newest")).otherwise(F.col("begin")).alias("begin_ts"),
        F.when(fails, "start time illegal, can't run incr sync").alias("error"),
    )


def start_map(nodes: DataFrame, ckpts: DataFrame, start: int) -> DataFrame:
    """(replset, start_ts) for an incremental run: the checkpoint, else the configured start, 1 at least."""
    both = nodes.select("replset").join(ckpts.select(F.col("name").alias("replset"), "ckpt"), "replset", "left")
    return both.select("replset", F.coalesce("ckpt", F.greatest(F.lit(start << 32), F.lit(1))).cast("long").alias("start_ts"))


def advance(current: int, found: int | None) -> int:
    """Checkpoints only go forward."""
    return current if found is None else max(current, found)


class CheckpointTable:
    """Checkpoints in a folder of Parquet files. Every save adds a version; the newest by name counts, so a lost or repeated save does no harm."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(CHECKPOINT + ", saved long").parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], CHECKPOINT)
        last = rows.groupBy("name").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "saved"]), F.struct("ckpt", "saved")).alias("x"))
        return last.select("x.*")

    def get(self, name: str, start: int = 0) -> int:
        row = self.load().filter(F.col("name") == name).first()
        return row["ckpt"] if row else max(start << 32, 1)

    def save(self, name: str, ckpt: int, fetch_method: str = "oplog", disk_queue: str = "", finish_ts: int = 0, version: int = 2) -> None:
        saved = int(uuid.uuid1().time)
        self.spark.createDataFrame([(name, ckpt, version, fetch_method, disk_queue, finish_ts, saved)], CHECKPOINT + ", saved long").coalesce(1).write.mode("append").parquet(self.path)
