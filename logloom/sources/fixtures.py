"""Logs, transactions and catalogs derived from the driver's tables, and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def oplog_from_events(events: DataFrame) -> DataFrame:
    """Flat log (seq, ts_t, ts_i, op, ns, id, x, k): one row an event."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "i").when(kind.isin("purchase", "click"), "u").when(kind == "error", "d").otherwise("n")
    return events.select(
        F.col("event_id").alias("seq"), F.unix_timestamp(F.date_trunc("second", "ts")).alias("ts_t"), F.col("event_id").alias("ts_i"), op.alias("op"),
        F.concat(F.lit("db"), F.col("user_id") % 3, F.lit(".c"), F.col("user_id") % 5).alias("ns"), F.col("user_id").alias("id"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def documents_log(events: DataFrame) -> DataFrame:
    """The same log in the envelope's form, with JSON documents: inserts and deletes by _id, updates as $set."""
    flat = oplog_from_events(events)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    by_id = F.concat(F.lit('{"_id":'), number("id"), F.lit("}"))
    insert = F.concat(F.lit('{"_id":'), number("id"), F.lit(',"k":'), number("k"), F.lit("}"))
    update = F.concat(F.lit('{"$set":{"k":'), number("k"), F.lit("}}"))
    o = F.when(F.col("op") == "i", insert).when(F.col("op") == "u", update).when(F.col("op") == "d", by_id).otherwise("{}")
    return flat.select("seq", "ts_t", "ts_i", "op", "ns", "id", o.alias("o"), F.when(F.col("op") == "u", by_id).alias("o2"), F.concat(F.lit("g"), F.col("id") % 4).alias("gid"))


def transactions(events: DataFrame) -> DataFrame:
    """Flat transaction entries (txn_number, pos, seq, id, x, outcome): five events each."""
    number = F.expr("event_id div 5")
    outcome = F.when(number % 4 == 0, "commit").when(number % 4 == 1, "prepare_commit").when(number % 4 == 2, "abort").otherwise("open")
    return events.select(number.alias("txn_number"), (F.col("event_id") % 5).alias("pos"), F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.col("value").alias("x"), outcome.alias("outcome"))


def transaction_log(events: DataFrame) -> DataFrame:
    """Envelope rows of those transactions: each event but the last is a partial entry of one insert, the last closes by outcome."""
    t = transactions(events)
    child = F.concat(F.lit('[{"op":"i","ns":"shop.orders","o":{"_id":'), F.col("seq").cast("string"), F.lit("}}]"))
    data = F.concat(F.lit('{"applyOps":'), child)
    last = (
        F.when(F.col("outcome") == "commit", F.concat(data, F.lit("}")))
        .when(F.col("outcome") == "prepare_commit", F.lit('{"commitTransaction":1}'))
        .when(F.col("outcome") == "abort", F.lit('{"abortTransaction":1}'))
        .otherwise(F.concat(data, F.lit(',"partialTxn":true}')))
    )
    prepared = (F.col("outcome") == "prepare_commit") & (F.col("pos") == 3)
    o = F.when(F.col("pos") == 4, last).when(prepared, F.concat(data, F.lit(',"prepare":true}'))).otherwise(F.concat(data, F.lit(',"partialTxn":true}')))
    return t.select(
        "seq", F.col("seq").alias("ts_t"), F.lit(0).cast("long").alias("ts_i"), F.lit("c").alias("op"), F.lit("admin.$cmd").alias("ns"), o.alias("o"), F.lit(None).cast("string").alias("o2"),
        F.lit("s1").cast("binary").alias("lsid"), F.col("txn_number").cast("long").alias("txn_number"), F.lit(None).cast("binary").alias("prev_optime"),
    )


def mock_log(spark: SparkSession, n: int, batch: int = 64) -> DataFrame:
    """Generated log: of each thousand one no-op, of each hundred a delete, of each three an update, else inserts."""
    r = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    op = F.when(r % 1000 == 0, "n").when(r % 100 == 0, "d").when(r % 3 == 0, "u").otherwise("i")
    return spark.range(n).select(F.col("id").alias("seq"), F.floor(F.col("id") / batch).alias("ts_t"), (F.col("id") % batch).alias("ts_i"), op.alias("op"), F.lit("mock.log").alias("ns"), F.concat(F.lit('{"_id":'), F.col("id").cast("string"), F.lit("}")).alias("o"))


def mock_stream(spark: SparkSession, rows_per_second: int = 64) -> DataFrame:
    """The same as an unbounded stream."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    r = F.pmod(F.xxhash64("value"), F.lit(1_000_000))
    op = F.when(r % 1000 == 0, "n").when(r % 100 == 0, "d").when(r % 3 == 0, "u").otherwise("i")
    return rate.select(F.col("value").alias("seq"), F.unix_timestamp("timestamp").alias("ts_t"), F.col("value").alias("ts_i"), op.alias("op"), F.lit("mock.log").alias("ns"), F.concat(F.lit('{"_id":'), F.col("value").cast("string"), F.lit("}")).alias("o"))


def user_documents(spark: SparkSession, n: int = 5000, collections: int = 16) -> DataFrame:
    """Generated user documents for load tests, with the columns that unique indexes cover."""
    return spark.range(n * collections).select(
        F.format_string("gen.users_%d", F.col("id") % collections).alias("ns"), F.floor(F.col("id") / collections).alias("user_id"),
        F.format_string("first-%d", F.col("id")).alias("first_name"), F.format_string("last-%d", F.col("id")).alias("last_name"), F.format_string("%011d", F.col("id")).alias("phone"),
        F.struct(F.md5(F.col("id").cast("string")).alias("col1"), F.format_string("c2-%d", F.col("id")).alias("col2")).alias("info"),
    )
