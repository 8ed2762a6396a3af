"""Whole plans: the full copy and the incremental run, assembled from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.config import Config
from logloom.functions import hashing
from logloom.functions import values as V
from logloom.functions.documents import get_field
from logloom.operators import commands, ddl, epochs, filters, orphan, replay, transforms, txn
from logloom.storage import settle


def full_copy(snapshot: DataFrame, config: Config, keys: list[str], chunks: DataFrame | None = None, chunk_keys: list[Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows of a snapshot (with ns) to write: filtered, without orphans, renamed, and one row a key.

    With the option to update duplicates the last row by ``order`` stays (by all
    columns where no order is given). Without it a repeated key fails the job.
    """
    ns = F.col("ns")
    out = snapshot.filter(~filters.chain(filters.drop_own_ns(ns, config.filter_pass_special_db), filters.drop_ns(ns, config.filter_namespace_white, config.filter_namespace_black)))
    if config.full_sync_executor_filter_orphan_document and chunks is not None:
        out = orphan.owned(out, chunks, chunk_keys or [F.col(k) for k in keys])
    out = out.withColumn("ns", transforms.rename(ns, transforms.parse_rules(config.transform_namespace)))
    rest = F.struct(*[c for c in out.columns if c not in ("ns", *keys)])
    last = F.max_by(rest, F.struct(*order)) if order else F.max(rest)
    one = out.groupBy("ns", *keys).agg(last.alias("_r"), F.count(F.lit(1)).alias("_n"))
    if not config.full_sync_executor_insert_on_dup_update:
        one = one.withColumn("_r", F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("duplicate key in "), F.col("ns")))))
    return one.select("ns", *keys, "_r.*")


def incremental(logs: DataFrame, config: Config) -> DataFrame:
    """Logs in the order in which they take effect, with epoch, worker and renamed namespaces.

    Filter, assemble transactions, rename, number the epochs between barriers,
    route. The filtered log and the released one are each read by several
    branches, so they are settled in shared storage once. Envelope columns that are missing count as null.
    """
    for name, kind in (("gid", "string"), ("o2", "string"), ("lsid", "binary"), ("txn_number", "long"), ("prev_optime", "binary"), ("from_migrate", "boolean")):
        if name not in logs.columns:
            logs = logs.withColumn(name, F.lit(None).cast(kind))
    kept = filters.filter_logs(filters.fail_on_migration(logs), config.incr_sync_oplog_gids, config.filter_namespace_white, config.filter_namespace_black, config.filter_pass_special_db, True)
    if not config.filter_ddl_enable:
        is_txn = txn.classify(kept)
        kept = is_txn.filter(F.col("is_txn") | ~commands.is_ddl(F.col("op"), F.col("ns"), F.col("o"))).select(kept.columns)
    released = txn.release(txn.classify(settle(kept)))
    if config.filter_oplog_gids:
        released = released.withColumn("gid", F.lit(""))
    renamed = transforms.rename_logs(released, transforms.parse_rules(config.transform_namespace), config.incr_sync_dbref)
    placed = epochs.barrier_epochs(settle(renamed), ["release_t", "release_i", "release_seq"])
    return placed.withColumn("worker", route(config))


def route(config: Config, any_unique: bool = False) -> Column:
    """Worker of a log by the configured shard key; barriers go to worker 0."""
    op, ns, n = F.col("op"), F.col("ns"), config.incr_sync_worker
    text = F.coalesce(get_field(F.col("o2"), "_id"), get_field(F.col("o"), "_id"))
    number = text.try_cast("bigint")
    hashed = hashing.id_hash(F.when(number.isNotNull(), "number").when(text.isNotNull(), "string"), text, number)
    hashed = F.when(text.isNotNull(), hashed)
    if config.incr_sync_shard_key == "auto":
        worker = hashing.worker_auto(any_unique, op, ns, hashed, n)
    elif config.incr_sync_shard_key == "id":
        worker = hashing.worker_by_id(op, ns, hashed, n)
    else:
        worker = hashing.worker_by_whitelist(op, ns, hashed, config.incr_sync_shard_by_object_id_whitelist, n)
    return F.when(F.col("is_barrier"), F.lit(0).cast("long")).otherwise(worker)


def replicated(logs: DataFrame, config: Config, snapshot: DataFrame | None = None) -> DataFrame:
    """(ns, id, doc) after a log over a snapshot (ns, doc JSON): the state that the target ends in."""
    ready = incremental(logs, config)
    order = ["release_t", "release_i", "release_seq", "pos"]
    live = ddl.without_dropped(ready, order)
    rows = live.withColumn("id", F.coalesce(get_field(F.col("o2"), "_id"), get_field(F.col("o"), "_id"))).select("ns", "id", "op", "o", "o2", *order)
    if snapshot is not None:
        first = {k: F.lit(-1).cast(rows.schema[k].dataType) for k in order}
        rows = snapshot.select("ns", get_field(F.col("doc"), "_id").alias("id"), F.lit("i").alias("op"), F.col("doc").alias("o"), F.lit(None).cast("string").alias("o2"), *[v.alias(k) for k, v in first.items()]).unionByName(rows)
    dup = replay.DUP_BY_WRITER["command" if config.filter_oplog_gids else "bulk"] if config.incr_sync_executor_insert_on_dup_update else "skip"
    return replay.fold_documents(rows, ["ns", "id"], config.incr_sync_executor_upsert, dup, order)


def due(logs: DataFrame, config: Config, now: Column, full_finish: int = 0) -> DataFrame:
    """Logs that the target delay lets pass at ``now`` (seconds)."""
    return logs.filter(V.delay_due(F.col("ts_t"), now, F.lit(config.incr_sync_target_delay), F.lit(full_finish >> 32)))
