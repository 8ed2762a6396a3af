"""Barrier epochs and runs of equal operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

MAX_COUNT, MAX_BYTES = 1000, 12 << 20
#: Barriers that every task holds; with more of them epochs come from range-wise counts.
MAX_BARRIERS = 100_000
#: Rows of a range, and places from which the ranges' cuts are taken.
RANGE_ROWS, CUTS_FROM = 250_000, 8192


def with_n_below(frame: DataFrame, name: str, table: Column, value: Column, most: int) -> DataFrame:
    """``frame`` with ``name``: how many elements of ``table``, a sorted array of ``most`` at most, are below ``value``.

    A binary search, a projection for each step; ``table`` may be a scalar subquery, which no higher-order function takes.
    """
    out, at = frame.withColumn(name, F.lit(0)), F.col(name)
    for step in (1 << k for k in reversed(range(max(1, most).bit_length()))):
        out = out.withColumn(name, F.when(F.get(table, at + (step - 1)) < value, at + step).otherwise(at))
    return out


def barrier_epochs(logs: DataFrame, order: list[str], barrier: str = "is_barrier", max_barriers: int = MAX_BARRIERS) -> DataFrame:
    """``logs`` with ``epoch``: 2 k between barriers, 2 k + 1 for the k-th barrier itself.

    ``order`` names columns that order all rows. Rows that share the place of a
    barrier (a transaction's operations, all but the last of ``order`` equal)
    share its epoch. Only barriers are ordered globally; they are few, as each
    stops the flow. Their places are one sorted array, a scalar that every task
    holds once (as a joined column each row would copy it whole), in which every
    row finds its epoch by binary search; no window over all rows is needed. Beyond
    ``max_barriers`` places the same epochs come from counts by range. A null flag
    is no barrier.
    """
    place = F.struct(*order)
    places = logs.filter(barrier).select(place.alias("p")).distinct()
    n = places.limit(max_barriers + 1).count()
    if n > max_barriers:
        return _epochs_by_range(logs, order, barrier)
    table = places.agg(F.array_sort(F.collect_set("p"))).scalar()  # max_barriers at most
    rows = with_n_below(logs, "_below", table, place, n)
    return rows.withColumn("epoch", (2 * F.col("_below") + F.coalesce((F.get(table, F.col("_below")) == place).cast("int"), F.lit(0))).cast("long")).drop("_below")


def _epochs_by_range(logs: DataFrame, order: list[str], barrier: str) -> DataFrame:
    """Epochs for any number of barriers: counts by range of places, then one window along each range.

    Ranges are cut by the whole place, so that many rows may share its first
    part. Cuts come from about ``CUTS_FROM`` of the places, chosen by hash; they
    decide on the sizes of the ranges only.
    """
    place = F.struct(*order)
    n, n_places = logs.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*order))).first()
    parts = max(2, int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    some = logs.filter(F.pmod(F.xxhash64(*order), F.lit(max(1, n_places // CUTS_FROM))) == 0)
    chosen = some.agg(F.array_sort(F.collect_set(place)).alias("s"))
    cuts = chosen.select(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda k: F.get("s", F.floor(k * F.size("s") / parts).cast("int"))))
    rows = with_n_below(logs, "_part", cuts.scalar(), place, parts)
    counts = rows.filter(barrier).groupBy("_part").agg(F.count_distinct(place).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # every range, as one without barriers still has those before it
    every = logs.sparkSession.range(parts + 1).select(F.col("id").cast("int").alias("_part")).join(counts, "_part", "left")
    rows = rows.join(F.broadcast(every.select("_part", before.alias("_before"))), "_part")
    along = Window.partitionBy("_part").orderBy(*order)
    rows = rows.withColumns({"_at": F.max(F.coalesce(F.col(barrier), F.lit(False))).over(along.rangeBetween(Window.currentRow, Window.currentRow)), "_head": F.row_number().over(along) == F.rank().over(along)})
    upto = F.sum((F.col("_at") & F.col("_head")).cast("long")).over(along)  # one row counts for each barrier's place; rows of one place are peers
    return rows.withColumn("epoch", 2 * (F.col("_before") + upto) - F.col("_at").cast("long")).drop("_part", "_before", "_at", "_head")


def consecutive_runs(logs: DataFrame, worker: list[str], order: list[str], keys: list[str] = ("ns", "op"), max_count: int | None = None) -> DataFrame:
    """``logs`` with ``run``: a number that goes up by worker whenever a key changes, or a run reaches ``max_count``.

    A worker's batch is what a single task handles in order, so the window is bounded by it.
    """
    along = Window.partitionBy(*worker).orderBy(*order)
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.lag(k).over(along).eqNullSafe(F.col(k))
    out = logs.withColumn("_new", (changed | (F.row_number().over(along) == 1)).cast("long"))
    out = out.withColumn("run", F.sum("_new").over(along)).drop("_new")
    if max_count:
        within = F.floor((F.row_number().over(Window.partitionBy(*worker, "run").orderBy(*order)) - 1) / max_count)
        out = out.withColumn("chunk", within.cast("long"))
    return out


def last_of_batch(logs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last log of each worker's batch, which tells how far the worker is."""
    rest = [c for c in logs.columns if c not in by]
    return logs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def stable_by_ns(logs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``logs`` with ``place`` in the batch: by namespace and then in order, or only in order where a command leads the batch.

    Order across namespaces is given up there: replicas agree in the end.
    """
    leads = F.first("op").over(Window.partitionBy(*by).orderBy(*order)) == "c"
    rows = logs.withColumn("_group", F.when(leads, F.lit("")).otherwise(F.col("ns")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_group", *order)).cast("long")).drop("_group")


def grouped_by_size(logs: DataFrame, worker: str, order: list[str], size: str = "raw_size", max_count: int = MAX_COUNT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``logs`` with ``batch``: greedy groups of equal (ns, op) under a count and a byte cap.

    The cap depends on all sizes before it, so it is a fold over a worker's ordered
    rows. They stream through sorted partitions; nothing is gathered per worker.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple = (None, None, None)
        batch = count = held = 0
        for frame in frames:
            found = []
            for w, ns, op, n in zip(frame[worker], frame["ns"], frame["op"], frame[size]):
                if w != state[0]:
                    batch, count, held = 0, 0, 0
                elif (ns, op) != state[1:] or count >= max_count or held + n >= max_bytes:
                    batch, count, held = batch + 1, 0, 0
                state, count, held = (w, ns, op), count + 1, held + n
                found.append(batch)
            yield frame.assign(batch=found)

    schema = StructType([*logs.schema.fields, StructField("batch", LongType())])
    return logs.repartition(worker).sortWithinPartitions(worker, *order).mapInPandas(run, schema)


def collision_segments(logs: DataFrame, worker: str, order: list[str], key: str = "uk") -> DataFrame:
    """``logs`` with ``segment``: a new one begins where a unique key has been seen before in the current one.

    Keys are exact; rows without one never cut. Rows stream through sorted
    partitions; only the current segment's keys are held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, segment, seen = None, 0, set()
        for frame in frames:
            found = []
            for w, k in zip(frame[worker], frame[key]):
                if w != now:
                    now, segment, seen = w, 0, set()
                if not pd.isna(k):
                    if k in seen:
                        segment, seen = segment + 1, set()
                    seen.add(k)
                found.append(segment)
            yield frame.assign(segment=found)

    schema = StructType([*logs.schema.fields, StructField("segment", LongType())])
    return logs.repartition(worker).sortWithinPartitions(worker, *order).mapInPandas(run, schema)
