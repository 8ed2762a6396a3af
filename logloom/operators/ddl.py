"""Commands on collections as events in the life of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.documents import get_field
from logloom.functions.values import ns_db
from logloom.operators.commands import command_name, target_ns
from logloom.storage import settle

INDEX_COMMANDS = ["createIndexes", "commitIndexBuild", "deleteIndex", "deleteIndexes", "dropIndex", "dropIndexes", "collMod"]


def resets(logs: DataFrame, order: tuple[str, ...] = ("ts_t", "ts_i", "seq")) -> DataFrame:
    """(ns or db, the order, kind, to_ns) of commands that end or move collections."""
    name = command_name(F.col("o"))
    rows = logs.filter((F.col("op") == "c") & name.isin("drop", "dropDatabase", "renameCollection", "emptycapped"))
    at = target_ns(F.col("op"), F.col("ns"), F.col("o"))
    return rows.select(
        F.when(name != "dropDatabase", at).alias("ns"), F.when(name == "dropDatabase", ns_db(F.col("ns"))).alias("db"), *order,
        F.when(name == "renameCollection", "rename").otherwise("drop").alias("kind"), F.when(name == "renameCollection", get_field(F.col("o"), "to")).alias("to_ns"),
    )


def without_dropped(logs: DataFrame, order: list[str] = ("ts_t", "ts_i", "seq")) -> DataFrame:
    """Data logs that no later drop of their collection or database undoes.

    The last drop by namespace and by database is one small aggregate each, joined
    to the logs; Spark broadcasts them by size.
    """
    place = F.struct(*order)
    ends = resets(logs, tuple(order))
    by_ns = ends.filter("kind = 'drop' and ns is not null").groupBy("ns").agg(F.max(place).alias("_drop_ns"))
    by_db = ends.filter("db is not null").groupBy("db").agg(F.max(place).alias("_drop_db"))
    data = logs.filter(F.col("op").isin("i", "u", "d")).withColumn("db", ns_db(F.col("ns")))
    out = data.join(by_ns, "ns", "left").join(by_db, "db", "left")
    alive = F.coalesce(place > F.col("_drop_ns"), F.lit(True)) & F.coalesce(place > F.col("_drop_db"), F.lit(True))
    return out.filter(alive).select(logs.columns)


def renamed_at_end(logs: DataFrame) -> DataFrame:
    """(ns, final_ns) of collections that were renamed, after following their renames in order."""
    moves = resets(logs).filter("kind = 'rename'").select("ns", "to_ns", "ts_t", "ts_i", "seq")
    last = moves.withColumn("n", F.row_number().over(Window.partitionBy("ns").orderBy(F.desc("ts_t"), F.desc("ts_i"), F.desc("seq")))).filter("n = 1").drop("n")
    out = last.select("ns", F.col("to_ns").alias("final_ns"), F.struct("ts_t", "ts_i", "seq").alias("at"))
    while True:
        step = out.alias("a").join(last.alias("b"), (F.col("a.final_ns") == F.col("b.ns")) & (F.struct("b.ts_t", "b.ts_i", "b.seq") > F.col("a.at")), "left")
        new = step.select("a.ns", F.coalesce("b.to_ns", "a.final_ns").alias("final_ns"), F.when(F.col("b.ns").isNotNull(), F.struct("b.ts_t", "b.ts_i", "b.seq")).otherwise(F.col("a.at")).alias("at"), F.col("b.ns").isNotNull().alias("moved"))
        if new.filter("moved").isEmpty():
            return out.select("ns", "final_ns")
        out = settle(new.drop("moved"))


def index_logs(logs: DataFrame) -> DataFrame:
    """Index commands with what they act on; metadata only, as tables here have no indexes."""
    name = command_name(F.col("o"))
    return logs.filter((F.col("op") == "c") & name.isin(INDEX_COMMANDS)).select(target_ns(F.col("op"), F.col("ns"), F.col("o")).alias("ns"), name.alias("command"), "o", "ts_t", "ts_i", "seq")


def index_specs(indexes: DataFrame, mode: str = "foreground") -> DataFrame:
    """Indexes to create, as (ns, name, key, is_unique, background): without the one on _id alone; none if ``mode`` is none."""
    if mode == "none":
        return indexes.limit(0).select("ns", "name", "key", "is_unique", "background")
    keys = F.json_object_keys("key")
    only_id = (F.size(keys) == 1) & (F.get(keys, F.lit(0)) == "_id")
    return indexes.filter(~only_id).select("ns", "name", "key", "is_unique", F.lit(mode == "background").alias("background"))


def any_unique(indexes: DataFrame) -> DataFrame:
    """(ns, has_unique), the index on _id aside."""
    keys = F.json_object_keys("key")
    only_id = (F.size(keys) == 1) & (F.get(keys, F.lit(0)) == "_id")
    return indexes.groupBy("ns").agg(F.bool_or(F.col("is_unique") & ~only_id).alias("has_unique"))


def unique_watch(indexes: DataFrame, by_id: list[str], fail: bool = False) -> DataFrame:
    """(ns) with a unique index among the namespaces that are routed by id, where such an index breaks the order.

    With ``fail`` the first of them fails the job.
    """
    found = any_unique(indexes).filter(F.col("has_unique") & F.col("ns").isin(by_id)).select("ns")
    return found.withColumn("ns", F.raise_error(F.concat(F.lit("unique index in "), F.col("ns"))).cast("string")) if fail else found


def shared_unique(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of logs, (id, name, value) each, that hold the same value of the same unique index."""
    return a.alias("a").join(b.alias("b"), (F.col("a.name") == F.col("b.name")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), "a.name", "a.value")
