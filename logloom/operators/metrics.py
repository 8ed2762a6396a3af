"""Counters and gauges as aggregates over logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.epochs import RANGE_ROWS, with_n_below
from logloom.storage import settle


def count_by_ns_op(logs: DataFrame) -> DataFrame:
    return logs.groupBy("ns", "op").agg(F.count(F.lit(1)).alias("n"))


def top_namespaces(logs: DataFrame, k: int = 3) -> DataFrame:
    """(op, ns, n, rank) of the k namespaces with most logs of each kind; ties by name."""
    ranked = count_by_ns_op(logs).withColumn("rank", F.row_number().over(Window.partitionBy("op").orderBy(F.desc("n"), "ns")))
    return ranked.filter(F.col("rank") <= k).select("op", "ns", "n", "rank")


def totals(logs: DataFrame) -> DataFrame:
    """One row with the number of logs of each kind; other codes are unknown."""
    kinds = {"insert": "i", "update": "u", "delete": "d", "ddl": "c", "noop": "n"}
    return logs.agg(*[F.count_if(F.col("op") == v).alias(k) for k, v in kinds.items()], F.count_if(~F.col("op").isin(list(kinds.values()))).alias("unknown"))


def ts_bounds(nodes: DataFrame) -> DataFrame:
    """Largest and smallest of the nodes' newest and oldest timestamps."""
    return nodes.agg(F.max("newest").alias("biggest_new"), F.min("newest").alias("smallest_new"), F.max("oldest").alias("biggest_old"), F.min("oldest").alias("smallest_old"))


def per_second(logs: DataFrame, second: str = "ts_t", every: int = 1) -> DataFrame:
    """(second, n, total, delta): the success counter as it stands every so many seconds, and its change since the time before.

    There is a row for every tick from the first log to the last, also where no
    log came.
    """
    counts = logs.groupBy((F.floor(F.col(second) / every) * every).alias("second")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi = counts.agg(F.min("second"), F.max("second")).first()
    ticks = logs.sparkSession.range(lo or 0, (hi or 0) + 1 if hi is not None else 0, every).select(F.col("id").alias("second"))
    filled = ticks.join(counts, "second", "left").select("second", F.coalesce("n", F.lit(0)).alias("n"))
    total = running(filled, "second", "sum", "n", "total")
    return total.withColumn("delta", F.col("total") - F.coalesce(F.lag("total").over(Window.partitionBy(F.floor(F.col("second") / (every * 4096))).orderBy("second")), F.col("total") - F.col("n")))


def running(frame: DataFrame, order: str, kind: str, column: str, name: str, parts: int = 64) -> DataFrame:
    """A running sum, max or min over a whole-numbered order, by ranges: each range's total first, then rows within ranges.

    Only the ranges' totals meet in one task. Three steps read the rows, so they are
    settled first; there are at least ``parts`` ranges, and more for more rows.
    """
    frame = settle(frame)
    parts = max(parts, -(-frame.count() // RANGE_ROWS))
    cuts = frame.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)])).first()[0] or []
    table = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    rows = with_n_below(frame, "_part", table, F.col(order), parts)
    whole = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
    totals_ = rows.groupBy("_part").agg(whole(column).alias("_t")).withColumn("_before", whole("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_before")
    joined = rows.join(F.broadcast(totals_), "_part")  # one row a range
    within = whole(column).over(Window.partitionBy("_part").orderBy(order))
    final = F.coalesce(F.col("_before"), F.lit(0)) + within if kind == "sum" else (F.greatest if kind == "max" else F.least)(within, F.coalesce("_before", within))
    return joined.withColumn(name, final).drop("_part", "_before")


def running_max(logs: DataFrame, order: str, value: str) -> DataFrame:
    """``logs`` with ``gauge``: the largest value so far, which never falls."""
    return running(logs, order, "max", value, "gauge")


def moving_mean(logs: DataFrame, key: list[str], order: list[str], size: str) -> DataFrame:
    """(key, mean, largest): (mean + size) / 2 along the order, from 0.

    Rows stream through sorted partitions; one mean is held at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, mean, largest = None, 0.0, None
        for frame in frames:
            done = []
            for row in zip(*[frame[k] for k in key], frame[size]):
                *own, x = row
                if now is not None and own != now:
                    done.append((*now, mean, largest))
                if own != now:
                    now, mean, largest = own, 0.0, None
                mean, largest = (mean + x) / 2, x if largest is None else max(largest, x)
            yield pd.DataFrame(done, columns=[*key, "mean", "largest"])
        if now is not None:
            yield pd.DataFrame([(*now, mean, largest)], columns=[*key, "mean", "largest"])

    kinds = ", ".join(f"{k} {logs.schema[k].dataType.simpleString()}" for k in key)
    rows = logs.select(*key, *order, size).repartition(*key).sortWithinPartitions(*key, *order)
    return rows.mapInPandas(run, f"{kinds}, mean double, largest {logs.schema[size].dataType.simpleString()}")


def progress(collections: DataFrame) -> DataFrame:
    """(ns, done, total, percent) and one row with ns null for all: an empty collection is done."""
    share = lambda d, t: F.when(t == 0, 100.0).otherwise(F.round(100.0 * d / t, 2))
    each = collections.select("ns", "done", "total", share(F.col("done"), F.col("total")).alias("percent"))
    finished = F.count_if(F.col("done") >= F.col("total"))
    every = collections.agg(finished.alias("done"), F.count(F.lit(1)).alias("total")).select(F.lit(None).cast("string").alias("ns"), "done", "total", share(F.col("done"), F.col("total")).alias("percent"))
    return each.unionByName(every)


def checksums(logs: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """(by, checksum, bytes, n): exclusive-or of the entries' CRC-32, and their size."""
    data = F.col(raw).cast("binary")
    return logs.groupBy(*by).agg(F.bit_xor(F.crc32(data)).alias("checksum"), F.sum(F.length(data)).alias("bytes"), F.count(F.lit(1)).alias("n"))


def journal(logs: DataFrame, mode: int, key: Column) -> DataFrame:
    """Logs for the audit: none (0), one in a thousand by hash (1), all (2)."""
    return logs.limit(0) if mode == 0 else logs if mode == 2 else logs.filter(F.pmod(key, F.lit(1000)) == 0)


def has_duplicates(values: DataFrame, column: str) -> DataFrame:
    return values.agg((F.count(column) > F.count_distinct(column)).alias("has_duplicates"))


def table_ops(logs: DataFrame) -> DataFrame:
    """(ns, n) of the data operations."""
    return logs.filter(F.col("op").isin("i", "u", "d")).groupBy("ns").agg(F.count(F.lit(1)).alias("n"))
