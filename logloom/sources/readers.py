"""Readers of logs, change events and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.filters import drop_before
from logloom.schema import EVENT, OPLOG, known_columns


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", ckpt: int = 0, gid: str | None = None) -> DataFrame:
    """Log entries after the checkpoint (packed), of one group id if given; both reach the scan as filters."""
    rows = spark.read.format(fmt).schema(OPLOG).load(path)
    out = rows.filter(~drop_before(F.col("ts_t"), F.col("ts_i"), ckpt)) if ckpt > 0 else rows
    return out.filter(F.col("gid") == gid) if gid is not None else out


def stream_log(spark: SparkSession, path: str, fmt: str = "parquet", ckpt: int = 0, files_per_trigger: int = 64, schema: str = OPLOG) -> DataFrame:
    """The same from a growing folder. Offsets are kept by the query's checkpoint; the file limit is the back-pressure."""
    rows = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return rows.filter(~drop_before(F.col("ts_t"), F.col("ts_i"), ckpt)) if ckpt > 0 else rows


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", after: str | None = None, start: int | None = None, full_document: bool = False) -> DataFrame:
    """Change events after a resume token, or from a packed operation time on; without the looked-up document unless wanted."""
    rows = spark.read.format(fmt).schema(EVENT).load(path)
    if after is not None:
        rows = rows.filter(F.col("resume_token") > after)
    elif start is not None:
        rows = rows.filter(~drop_before(F.col("cluster_t"), F.col("cluster_i"), start - 1))
    # only updates look their document up; inserts and replacements carry it
    return rows if full_document else rows.withColumn("full_document", F.when(F.col("operation_type") != "update", F.col("full_document")))


def stream_events(spark: SparkSession, path: str, fmt: str = "parquet", start: int | None = None, full_document: bool = False, files_per_trigger: int = 64) -> DataFrame:
    """Change events from a growing folder. The query's checkpoint keeps the place, so a restart goes on behind the last event taken."""
    rows = spark.readStream.format(fmt).schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).load(path)
    if start is not None:
        rows = rows.filter(~drop_before(F.col("cluster_t"), F.col("cluster_i"), start - 1))
    return rows if full_document else rows.withColumn("full_document", F.when(F.col("operation_type") != "update", F.col("full_document")))


def read_kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True) -> DataFrame:
    """Messages of a topic from its earliest offset; needs Spark's Kafka package."""
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "true"}).load()


def reader(spark: SparkSession, method: str, path: str, **options) -> DataFrame:
    """By fetch method: ``oplog`` or ``change_stream``."""
    if method not in ("oplog", "change_stream"):
        raise ValueError(f"fetch method {method!r}")
    return read_log(spark, path, **options) if method == "oplog" else read_events(spark, path, **options)


def log_bounds(logs: DataFrame) -> DataFrame:
    """(oldest, newest) packed timestamps of a log."""
    ts = F.col("ts_t") * F.lit(1 << 32) + F.col("ts_i")
    return logs.agg(F.min(ts).alias("oldest"), F.max(ts).alias("newest"))


def check_start(logs: DataFrame, start: int) -> str:
    """``ok``, ``ahead`` (start beyond the newest entry; goes on and waits) or an error if the start has rolled off the log."""
    row = log_bounds(logs).first()
    if row["oldest"] is None:
        return "ok"
    if start > row["newest"]:
        return "ahead"
    if 1 < start < row["oldest"]:
        raise ValueError(f"start {start} is before the log's oldest entry {row['oldest']}: entries are lost")
    return "ok"


def read_snapshot(spark: SparkSession, path: str, where: Column | None = None, fmt: str = "parquet") -> DataFrame:
    rows = spark.read.format(fmt).load(path)
    return rows if where is None else rows.filter(where)


def split_bounds(frame: DataFrame, key: str, pieces: int) -> list:
    """Inner bounds of ``pieces`` ranges with about as many rows each."""
    cuts = frame.agg(F.percentile_approx(key, [k / pieces for k in range(1, pieces)] or [0.5], 10000)).first()[0] or []
    return sorted(set(cuts)) if pieces > 1 else []


def piece_of(key: Column, bounds: list) -> Column:
    """Number of the piece (bound, next bound] that a key lies in; the last is open."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < key)) if bounds else F.lit(0)


def pieces_for(size_bytes: int, threads: int, most: int = 8 << 30) -> int:
    """Number of pieces of a collection: one a thread, none above ``most`` bytes."""
    return max(1, threads, -(-size_bytes // most))


def namespaces(catalog: DataFrame, kinds: tuple[str, ...] = ("collection", "timeseries")) -> DataFrame:
    """(ns) of the collections in ``catalog`` (db, coll, kind), in order; system collections go."""
    rows = catalog.filter(F.col("kind").isin(*kinds) & ~F.startswith("coll", F.lit("system.")))
    return rows.select(F.concat_ws(".", "db", "coll").alias("ns")).distinct().orderBy("ns")


def envelope(rows: DataFrame) -> DataFrame:
    """Rows of any layout as log entries; unknown columns go, missing ones are null."""
    return known_columns(rows, OPLOG)


def parse_json_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log entries from JSON texts, with ``raw_size``."""
    return lines.select(F.from_json(column, OPLOG).alias("x"), F.length(F.col(column).cast("binary")).alias("_size")).select("x.*", "_size").withColumn("raw_size", F.col("_size")).drop("_size")
