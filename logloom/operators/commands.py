"""Known commands, and the names they act on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.documents import first_field, get_field
from logloom.functions.values import ns_db

#: Command, whether it carries data, runs on the admin database, is to be left out.
COMMANDS = [
    ("create", False, False, False),
    ("createIndexes", False, False, False),
    ("collMod", False, False, False),
    ("dropDatabase", False, False, False),
    ("drop", False, False, False),
    ("deleteIndex", False, False, False),
    ("deleteIndexes", False, False, False),
    ("dropIndex", False, False, False),
    ("dropIndexes", False, False, False),
    ("renameCollection", False, True, False),
    ("convertToCapped", False, False, False),
    ("emptycapped", False, False, False),
    ("applyOps", True, False, False),
    ("startIndexBuild", False, False, True),
    ("commitIndexBuild", False, False, False),
    ("abortIndexBuild", False, False, True),
]
#: Commands whose value is the name of a collection in the log's database.
ON_COLLECTION = ["create", "createIndexes", "collMod", "drop", "deleteIndex", "deleteIndexes", "dropIndex", "dropIndexes", "convertToCapped", "emptycapped", "commitIndexBuild"]


def command_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMANDS, "command string, concern_sync_data boolean, run_on_admin boolean, need_filter boolean")


def command_name(o: Column) -> Column:
    """The first field of ``o`` if it is a known command, else null."""
    first = first_field(o)
    return F.when(first.isin([c[0] for c in COMMANDS]), first)


def target_ns(op: Column, ns: Column, o: Column) -> Column:
    """The namespace that a log acts on.

    Inserts into system.indexes act on their document's ns; commands on the
    collection they name, renames on their source, other commands on the log's ns.
    """
    name = command_name(o)
    value = F.call_function("get_json_object", o, F.concat(F.lit("$['"), name, F.lit("']")))
    on_collection = name.isin(ON_COLLECTION) & value.isNotNull()
    command = F.when(on_collection, F.concat(ns_db(ns), F.lit("."), value)).when((name == "renameCollection") & value.isNotNull(), value).otherwise(ns)
    return F.when(op == "c", command).when(F.endswith(ns, F.lit("system.indexes")), F.coalesce(get_field(o, "ns"), ns)).otherwise(ns)


def is_ddl(op: Column, ns: Column, o: Column) -> Column:
    """Commands other than applyOps, and index inserts."""
    name = first_field(o)
    return ((op == "c") & (F.coalesce(name, F.lit("")) != "applyOps")) | F.endswith(ns, F.lit("system.indexes"))


def writable(op: Column, o: Column, ddl_enable: bool) -> Column:
    """Whether a command is run: always with DDL enabled, else only if it carries data."""
    return (op != "c") | F.lit(ddl_enable) | F.coalesce(command_name(o) == "applyOps", F.lit(False))
