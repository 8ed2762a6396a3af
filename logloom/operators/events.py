"""Change events as log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of events and their operation codes (fixed values).
KINDS = {"insert": "i", "delete": "d", "replace": "u", "update": "u", "drop": "c", "rename": "c", "dropDatabase": "c"}


def _quoted(text: Column) -> Column:
    return F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def event_to_log(events: DataFrame, watch_full_document: bool = False, true_replace: bool = False) -> DataFrame:
    """(op, ns, o, o2, ts_t, ts_i, lsid, txn_number) of change events; other kinds fail the job.

    Updates set the looked-up document if ``watch_full_document`` is on and there
    is one, else the changed fields and then unset the removed ones. A replacement
    becomes a $set of the whole document, so removed fields survive, unless
    ``true_replace`` is on.
    """
    kind, full, key, change = F.col("operation_type"), F.col("full_document"), F.col("document_key"), F.col("update_description")
    op = F.raise_error(F.concat(F.lit("event of unknown kind "), F.coalesce(kind, F.lit("null")))).cast("string")
    for k, v in KINDS.items():
        op = F.when(kind == k, F.lit(v)).otherwise(op)
    there = lambda text: text.isNotNull() & (F.trim(text) != "{}") & (F.trim(text) != "")
    wrapped = F.concat(F.lit('{"$set":'), full, F.lit("}"))
    removed = F.array_join(F.transform(change["removed_fields"], lambda x: F.concat(_quoted(x), F.lit(":1"))), ",")
    parts = F.concat_ws(",", F.when(there(change["updated_fields"]), F.concat(F.lit('"$set":'), change["updated_fields"])), F.when(F.size(change["removed_fields"]) > 0, F.concat(F.lit('"$unset":{'), removed, F.lit("}"))))
    updated = F.when(F.lit(watch_full_document) & there(full), wrapped).otherwise(F.concat(F.lit("{"), parts, F.lit("}")))
    whole = lambda x: F.concat_ws(".", x["db"], x["coll"])
    o = (
        F.when(kind == "insert", full)
        .when(kind == "delete", key)
        .when(kind == "replace", full if true_replace else wrapped)
        .when(kind == "update", updated)
        .when(kind == "drop", F.concat(F.lit('{"drop":'), _quoted(F.col("ns.coll")), F.lit("}")))
        .when(kind == "rename", F.concat(F.lit('{"renameCollection":'), _quoted(whole(F.col("ns"))), F.lit(',"to":'), _quoted(whole(F.col("to"))), F.lit("}")))
        .when(kind == "dropDatabase", F.lit('{"dropDatabase":1}'))
    )
    command = F.concat(F.col("ns.db"), F.lit(".$cmd"))
    return events.select(
        op.alias("op"),
        F.when(kind.isin("drop", "rename", "dropDatabase"), command).otherwise(whole(F.col("ns"))).alias("ns"),
        F.coalesce(o, F.lit("{}")).alias("o"),
        F.coalesce(F.when(kind.isin("replace", "update"), key), F.lit("{}")).alias("o2"),
        F.col("cluster_t").alias("ts_t"),
        F.col("cluster_i").alias("ts_i"),
        "lsid",
        "txn_number",
    )
