"""Transactions in the log: classification, assembly, release, and inner operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.documents import first_field
from logloom.functions.values import ts_pack

#: A transaction's "no earlier entry" marker, BSON of {ts: Timestamp(0, 0), t: -1} (fixed value).
EMPTY_PREV = bytes.fromhex("1c000000" + "11" + b"ts\0".hex() + "00" * 8 + "12" + b"t\0".hex() + "ff" * 8 + "00")
INNER = "array<struct<op:string,ns:string,o:string,o2:string,ui:string>>"


def classify(logs: DataFrame) -> DataFrame:
    """``logs`` with is_txn, partial, prepare, commit, abort, is_data, is_commit, is_final and is_multi.

    A log belongs to a transaction if it is a command with session and number
    that holds applyOps, commitTransaction or abortTransaction; flags go by the
    presence of fields, not by their value.
    """
    out = logs.withColumn("_keys", F.json_object_keys("o"))  # each document is read once
    has = lambda k: F.coalesce(F.array_contains("_keys", k), F.lit(False))
    keyed = (F.col("op") == "c") & F.col("lsid").isNotNull() & F.col("txn_number").isNotNull()
    txn = keyed & (has("applyOps") | has("commitTransaction") | has("abortTransaction"))
    out = out.withColumn("is_txn", F.coalesce(txn, F.lit(False)))
    flags = {"partial": "partialTxn", "prepare": "prepare", "commit": "commitTransaction", "abort": "abortTransaction"}
    out = out.withColumns({k: F.col("is_txn") & has(v) for k, v in flags.items()})
    is_commit = F.col("commit") | (F.col("is_txn") & ~F.col("prepare") & ~F.col("partial"))
    first = F.coalesce(F.col("prev_optime"), F.lit(bytearray(EMPTY_PREV))) == F.lit(bytearray(EMPTY_PREV))
    return out.withColumns(
        {
            "is_data": ~F.col("commit") & ~F.col("abort"),
            "is_commit": is_commit,
            "is_final": is_commit | F.col("abort"),
            "is_multi": F.col("partial") | F.col("prepare") | (F.col("is_txn") & ~first),
        }
    ).drop("_keys")


def explode_ops(logs: DataFrame, keep_children_ts: bool = False) -> DataFrame:
    """One row for each operation in applyOps, with ``pos`` and the parent's ts, term and hash.

    Children keep the parent's timestamp and order by ``pos``. With
    ``keep_children_ts``, all but the last get an ordinal less by one (not below
    0), as other consumers of the log expect.
    """
    ops = F.from_json(F.get_json_object("o", "$.applyOps"), INNER)
    rows = logs.withColumn("_n", F.size(ops)).select("*", F.posexplode(ops).alias("pos", "_op"))
    earlier = F.when(F.col("pos") < F.col("_n") - 1, F.greatest(F.lit(0), F.col("ts_i") - 1)).otherwise(F.col("ts_i"))
    rows = rows.withColumns({k: F.col(f"_op.{k}") for k in ("op", "ns", "o", "o2")})
    if keep_children_ts:
        rows = rows.withColumn("ts_i", earlier)
    return rows.drop("_op", "_n")


def gather_ops(logs: DataFrame, by: list[Column | str]) -> DataFrame:
    """The inverse: one applyOps command on admin.$cmd for each group, its operations in log order."""
    one = F.struct("op", "ns", F.col("o"), F.col("o2"))
    ordered = F.array_sort(F.collect_list(F.struct("ts_t", "ts_i", "seq", one.alias("x"))))
    text = F.transform(ordered, lambda r: F.concat(F.lit('{"op":'), _json(r["x"]["op"]), F.lit(',"ns":'), _json(r["x"]["ns"]), F.lit(',"o":'), F.coalesce(r["x"]["o"], F.lit("{}")), F.when(r["x"]["o2"].isNotNull(), F.concat(F.lit(',"o2":'), r["x"]["o2"])).otherwise(""), F.lit("}")))
    out = logs.groupBy(*by).agg(F.concat(F.lit('{"applyOps":['), F.array_join(text, ","), F.lit("]}")).alias("o"), F.count(F.lit(1)).alias("n_ops"))
    return out.withColumns({"op": F.lit("c"), "ns": F.lit("admin.$cmd")})


def _json(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def release(classified: DataFrame) -> DataFrame:
    """The operations that take effect: plain ones, and those of committed transactions at the commit's place.

    Takes ``classify``'s output. Adds release_t, release_i, release_seq (where an
    operation comes in the output), pos, and is_barrier. Aborted and open
    transactions give nothing; plain operations between a transaction's entries
    come before it. A released operation keeps its data entry's ts. A transaction
    is no barrier if it is one entry without commands, committed by itself, first
    of its kind (its previous optime is empty). Entries of a transaction meet by
    (lsid, txn_number) in one aggregate row, which the entries are joined with.
    """
    order = F.struct("ts_t", "ts_i", "seq")
    final = classified.filter("is_txn").groupBy("lsid", "txn_number").agg(
        F.min(F.when(F.col("is_final"), order)).alias("end"),
        F.min_by("abort", F.when(F.col("is_final"), order)).alias("aborted"),
        F.count_if("is_data").alias("n_data"),
        F.max("commit").alias("by_commit"),
        F.max("is_multi").alias("multi"),
        F.max(F.col("is_data") & F.coalesce(F.exists(F.from_json(F.get_json_object("o", "$.applyOps"), INNER), lambda x: x["op"] == "c"), F.lit(False))).alias("has_command"),
    )
    done = final.filter(F.col("end").isNotNull() & ~F.col("aborted"))
    inner = explode_ops(classified.filter("is_txn and is_data")).join(done, ["lsid", "txn_number"]).filter(order <= F.col("end"))
    inner = inner.withColumn("is_barrier", F.col("multi") | F.col("by_commit") | (F.col("n_data") > 1) | F.col("has_command"))
    inner = inner.withColumns({"release_t": F.col("end.ts_t"), "release_i": F.col("end.ts_i"), "release_seq": F.col("end.seq")})
    rest = classified.filter(~F.col("is_txn"))
    apply_ops = (F.col("op") == "c") & (first_field(F.col("o")) == "applyOps")
    apply_ops = F.coalesce(apply_ops, F.lit(False))
    own = {"release_t": F.col("ts_t"), "release_i": F.col("ts_i"), "release_seq": F.col("seq")}
    exploded = explode_ops(rest.filter(apply_ops)).withColumns(own | {"is_barrier": F.lit(False)})
    ddl = (F.col("op") == "c") | F.endswith("ns", F.lit("system.indexes"))
    plain = rest.filter(~apply_ops).withColumns(own | {"pos": F.lit(0), "is_barrier": ddl})
    names = [c for c in classified.columns] + ["pos", "release_t", "release_i", "release_seq", "is_barrier"]
    return plain.select(names).unionByName(exploded.select(names)).unionByName(inner.select(names))


def oldest_open(classified: DataFrame) -> DataFrame:
    """(lsid, txn_number, ts_t, ts_i) of the open transaction that began first; no row if none is open."""
    open_txns = classified.filter("is_txn").groupBy("lsid", "txn_number").agg(F.max("is_final").alias("final"), F.min(F.struct("ts_t", "ts_i")).alias("start")).filter("not final")
    return open_txns.orderBy("start", "lsid", "txn_number").limit(1).select("lsid", "txn_number", "start.ts_t", "start.ts_i")


def packed_release(frame: DataFrame) -> Column:
    return ts_pack(F.col("release_t"), F.col("release_i"))
