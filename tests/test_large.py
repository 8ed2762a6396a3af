"""Cases that only larger tables show."""

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.operators import epochs
from logloom.queries import QUERIES, SQL
from logloom.sinks import writers
from logloom.sources import fixtures
from logloom.streaming import apply


def events(spark, where, ids):
    """A table of events with the given ids, in the driver's columns."""
    rows = ids.select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 300_000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 1500).alias("user_id"),
        F.element_at(F.array(*[F.lit(k) for k in ("signup", "purchase", "click", "error", "view")]), (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 100).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    )
    rows.write.parquet(f"{where}/events.parquet")
    return str(where)


def agrees(spark, where, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{where}/events.parquet/*.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, where).select(columns).collect())) == sorted(want.fetchall())


def test_sizes_above_a_terabyte(spark, tmp_path):
    agrees(spark, events(spark, tmp_path, spark.range(131_000, 132_000)), "size_and_version")


def copies_no_table(frame):
    return "NestedLoop" not in frame._jdf.queryExecution().optimizedPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()


def test_rows_do_not_carry_the_barriers(spark, tmp_path):
    where = events(spark, tmp_path, spark.range(2000))
    assert copies_no_table(QUERIES["barrier_epochs"](spark, where))
    agrees(spark, where, "barrier_epochs")


def test_ranges_cut_within_equal_first_places(spark):
    rows = spark.range(3000).select(F.lit(7).alias("t"), (F.col("id") % 1000).alias("a"), F.when(F.col("id") % 7 == 3, True).alias("is_barrier"))
    by_range = epochs._epochs_by_range(rows, ["t", "a"], "is_barrier")
    near = epochs.barrier_epochs(rows, ["t", "a"])
    key = lambda f: sorted(map(tuple, f.select("a", "is_barrier", "epoch").fillna(False).collect()))
    assert key(by_range) == key(near)
    assert by_range.groupBy(F.spark_partition_id()).count().count() > 1


def test_tied_rows_do_not_carry_the_barriers(spark, tmp_path):
    where = events(spark, tmp_path, spark.range(2000))
    assert copies_no_table(QUERIES["barrier_epochs_ties"](spark, where))
    agrees(spark, where, "barrier_epochs_ties")


def test_running_reads_its_rows_once(spark, tmp_path):
    where = events(spark, tmp_path, spark.range(2000))
    frame = QUERIES["txn_release_order"](spark, where)
    assert "parquet" not in frame._jdf.queryExecution().optimizedPlan().toString()
    agrees(spark, where, "txn_release_order")


def test_classify_reads_a_document_once(spark, tmp_path):
    where = events(spark, tmp_path, spark.range(20))
    plan = QUERIES["txn_classify"](spark, where)._jdf.queryExecution().analyzed().toString()
    assert plan.count("json_object_keys") == 1


def test_open_transactions_share_states_across_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(apply, "BUCKETS", 8, raising=False)
    source = str(tmp_path / "in")
    for part in range(2):  # each transaction's five events come in two batches; the first holds all but the ends
        rows = spark.range(500).filter((F.col("id") % 5 >= 3) == bool(part))
        events(spark, tmp_path / str(part), rows)
        spark.read.parquet(f"{tmp_path}/{part}/events.parquet").coalesce(1).write.mode("append").parquet(source)
    logs = fixtures.transaction_log(spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source))
    out = str(tmp_path / "out")
    query = apply.release_stream(logs).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted((r.txn_number, r.pos, r.o, r.release_t) for r in spark.read.schema(apply.RELEASED).parquet(out).collect())
    want = [(n, p, '{"_id":%d}' % (5 * n + p), 5 * n + 4) for n in range(100) for p in range(5) if n % 4 == 0 or (n % 4 == 1 and p < 4)]
    assert found == want
    assert [p["batchId"] for p in query.recentProgress if p["numInputRows"]] == [0, 1]
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 8


def test_messages_are_checked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(writers, "SLICE_BYTES", 100, raising=False)
    logs = spark.range(0, 1000, 1, 1).select((F.col("id") % 3).alias("worker"), F.concat(F.lit("x"), "id").alias("value"))
    messages = writers.message_batches(logs, how="zlib", max_count=10)
    good, bad = writers.valid_messages(messages)
    assert sorted(r.log for r in good.collect()) == sorted(f"x{i}" for i in range(1000)) and bad.count() == 0
    broken = messages.withColumn("message", F.concat(F.lit(b"\x00\x00\x00\x00"), F.substring("message", 5, 1 << 20)))
    good, bad = writers.valid_messages(broken)
    assert good.count() == 0 and bad.columns == messages.columns and bad.count() == messages.count()
    assert "ArrowEvalPython" not in good._jdf.queryExecution().executedPlan().toString()  # which answers for a whole batch at once
