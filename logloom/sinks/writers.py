"""Sinks: apply, Kafka, files, binary tunnel, drop; and the side tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logloom.functions import documents as D
from logloom.operators.filters import drop_ns
from logloom.operators.transforms import rename
from logloom.sources import tunnel_file

SINKS = ("direct", "kafka", "file", "mock", "rpc", "tcp")
MAX_MESSAGE = 18 << 20
#: Bytes of messages that are unpacked at once; a larger message goes alone.
SLICE_BYTES = 256 << 10


def json_text(logs: DataFrame, canonical: bool = False) -> DataFrame:
    """``logs`` with ``value``: the entry as JSON.

    Plain form writes numbers as they are and drops rows that hold NaN or
    infinity, which JSON can't say. Canonical form wraps longs and doubles by type.
    """
    fields = logs.schema.fields
    if not canonical:
        bad = [F.coalesce(F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf")), F.lit(False)) for f in fields if f.dataType.typeName() in ("double", "float")]
        keep = ~F.greatest(*[b.cast("int") for b in bad], F.lit(0), F.lit(0)).cast("boolean")
        return logs.filter(keep).withColumn("value", F.to_json(F.struct(*[f.name for f in fields])))

    def wrapped(f):
        c = F.col(f.name)
        kind = f.dataType.typeName()
        if kind == "long":
            return F.struct(c.cast("string").alias("$numberLong")).alias(f.name)
        if kind == "integer":
            return F.struct(c.cast("string").alias("$numberInt")).alias(f.name)
        if kind in ("double", "float"):
            text = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise(c.cast("string"))
            return F.struct(text.alias("$numberDouble")).alias(f.name)
        return c

    return logs.withColumn("value", F.to_json(F.struct(*[wrapped(f) for f in fields])))


def kafka_partition(worker: Column, n: int) -> Column:
    return F.pmod(worker, F.lit(n)).cast("int")


def kafka_rows(logs: DataFrame, n_partitions: int, canonical: bool = False) -> DataFrame:
    """(key, value, partition) for Spark's Kafka sink, one message a log; too large ones fail the job."""
    rows = json_text(logs, canonical)
    size = F.when(F.length("value") > MAX_MESSAGE, F.raise_error(F.lit("message above the size limit")).cast("string")).otherwise(F.col("value"))
    return rows.select(F.col("ns").alias("key"), size.alias("value"), kafka_partition(F.col("worker"), n_partitions).alias("partition"))


def message_batches(logs: DataFrame, by: str = "worker", value: str = "value", how: str = "none", max_count: int = 1024) -> DataFrame:
    """(shard, n, message binary): batches of up to ``max_count`` logs in the tunnel's encoding, in the order of the partition."""
    code = tunnel_file.COMPRESSORS[how]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[bytes]] = {}
        for frame in frames:
            out = []
            for shard, text in zip(frame["shard"], frame["log"]):
                logs_ = held.setdefault(shard, [])
                logs_.append(bytes(text))
                if len(logs_) >= max_count:
                    out.append((shard, len(logs_), tunnel_file.encode_message(held.pop(shard), 0, shard, code)))
            yield pd.DataFrame(out, columns=["shard", "n", "message"])
        rest = [(s, len(x), tunnel_file.encode_message(x, 0, s, code)) for s, x in sorted(held.items())]
        yield pd.DataFrame(rest, columns=["shard", "n", "message"])

    return logs.select(F.col(by).cast("long").alias("shard"), F.col(value).cast("binary").alias("log")).mapInPandas(run, "shard long, n long, message binary")


def apply_direct(logs: DataFrame, where: str, keys: list[str], values: list[str], version: int) -> None:
    """Applies logs of whole documents to the versioned table in a folder: the last write of a key counts, deletes remove, repeated runs of a version change nothing."""
    from logloom.streaming.apply import VersionedTable, apply_batch

    apply_batch(VersionedTable(logs.sparkSession, where), keys, values)(logs, version)


def write(logs: DataFrame, sink: str, where: str = "", mode: str = "append", **options) -> None:
    """Writes logs to a sink by name. ``direct`` applies them (``keys``, ``values``, ``version``); socket tunnels go by Kafka or files instead."""
    if sink == "mock":
        logs.write.format("noop").mode("overwrite").save()
    elif sink == "file":
        logs.write.mode(mode).format(options.get("format", "parquet")).save(where)
    elif sink == "direct":
        apply_direct(logs, where, options["keys"], options["values"], options["version"])
    elif sink == "kafka":
        kafka_rows(logs, options.get("partitions", 1), options.get("canonical", False)).write.format("kafka").option("kafka.bootstrap.servers", where).option("topic", options["topic"]).save()
    elif sink in SINKS:
        raise NotImplementedError(f"sink {sink}: a socket protocol has no place in a job; use kafka or file")
    else:
        raise ValueError(f"sink {sink!r}")


def write_conflicts(conflicts: DataFrame, where: str, to: str = "db") -> None:
    """Appends clashing inserts to the conflict table, by namespace, if ``to`` is db."""
    if to == "db":
        conflicts.write.mode("append").partitionBy("ns").parquet(where)


def shard_specs(specs: DataFrame, white: list[str] = (), black: list[str] = (), rules: list[tuple[str, str]] = ()) -> DataFrame:
    """(ns, key, is_unique) of collections to shard on the target, from (ns, key, is_unique, dropped): neither dropped nor filtered, renamed."""
    kept = specs.filter(~F.coalesce(F.col("dropped"), F.lit(False)) & ~drop_ns(F.col("ns"), list(white), list(black)))
    return kept.select(rename(F.col("ns"), list(rules)).alias("ns"), "key", "is_unique")


def prepare_target(exists: bool, drop: bool) -> str:
    """Write mode of a full copy: overwrite if existing collections are to be dropped, else append."""
    return "overwrite" if exists and drop else "append"


def valid_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shard, pos, log, ack-able) rows of whole messages, and the messages whose checksum fails.

    Messages are unpacked in slices of bounded bytes, as a batch may hold thousands of them.
    """
    most = SLICE_BYTES

    def check(data: bytes) -> str:
        found, tag, shard, how, logs = tunnel_file.decode_message(data)
        plain = [tunnel_file.decompress(x, how) for x in logs]
        ok = bool(tag & tunnel_file.PROBE) or tunnel_file.checksum(plain) == found
        return D.save({"ok": ok, "shard": shard, "logs": [x.decode("utf-8", "replace") for x in plain]})

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, start, held = batch.column(batch.schema.get_field_index("message")), 0, 0
            for end in range(1, len(data) + 1):
                held += len(data[end - 1].as_buffer())
                if held >= most or end == len(data):
                    part = batch.slice(start, end - start)
                    texts = pa.array([check(x.as_py()) for x in data.slice(start, end - start)], pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "_text"])
                    start, held = end, 0

    texts = messages.mapInArrow(run, StructType([*messages.schema.fields, StructField("_text", StringType())]))
    parsed = texts.withColumn("_x", F.from_json("_text", "ok boolean, shard long, logs array<string>")).drop("_text")
    good = parsed.filter("_x.ok").select(F.col("_x.shard").alias("shard"), F.posexplode("_x.logs").alias("pos", "log"))
    return good, parsed.filter("not _x.ok").drop("_x")
