"""Filters over the log as predicates that say *drop*, cheapest first.

All are column expressions, so that Spark pushes what it can into the scan and
short-circuits the rest.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.values import ns_db, ts_pack
from logloom.operators.commands import command_name, is_ddl, target_ns
from logloom.schema import APP_DB, CONFLICT_DB

#: Databases that are never replicated, by prefix; and a collection, wherever it is.
OWN_PREFIXES = ["admin.", "local.", "config.", f"{APP_DB}.", f"{CONFLICT_DB}."]
OWN_PARTS = ["system.views"]


def chain(*drops: Column) -> Column:
    """Drop if any predicate says so; nulls say no."""
    return reduce(lambda a, b: a | b, [F.coalesce(d, F.lit(False)) for d in drops], F.lit(False))


def drop_noop(op: Column) -> Column:
    return op == "n"


def drop_gid(gid: Column, gids: list[str]) -> Column:
    """With a list of group ids, logs of other ids or none are dropped."""
    return ~F.coalesce(gid.isin(gids), F.lit(False)) if gids else F.lit(False)


def drop_index_build(op: Column, o: Column) -> Column:
    return (op == "c") & command_name(o).isin("startIndexBuild", "abortIndexBuild")


def drop_own_ns(ns: Column, pass_special: list[str] = ()) -> Column:
    """Namespaces of system and engine databases; admin.$cmd stays, and so do those in ``pass_special``."""
    prefixes = [p for p in OWN_PREFIXES if p not in pass_special and p[:-1] not in pass_special]
    parts = [p for p in OWN_PARTS if p not in pass_special]
    return ~F.startswith(ns, F.lit("admin.$cmd")) & chain(*[F.startswith(ns, F.lit(p)) for p in prefixes], *[F.contains(ns, F.lit(p)) for p in parts])


def _rule(names: list[str]) -> str:
    found = "|".join(re.escape(n) for n in names)
    return rf"^(?:{found})(?:\..*)?$"


def drop_ns(ns: Column, white: list[str] = (), black: list[str] = ()) -> Column:
    """Names that no white rule covers, or that a black rule covers; a rule is a database or a namespace.

    ``db.$cmd`` stays if a white rule names the database or something in it.
    """
    out = F.lit(False)
    if white:
        out = out | ~ns.rlike(_rule(white))
    if black:
        out = out | ns.rlike(_rule(black))
    command = F.endswith(ns, F.lit(".$cmd")) & ns_db(ns).isin([w.partition(".")[0] for w in white]) if white else F.lit(False)
    return ~command & out


def drop_log_ns(op: Column, ns: Column, o: Column, white: list[str] = (), black: list[str] = ()) -> Column:
    """``drop_ns`` on what a log acts on; applyOps and unknown commands are never dropped, index builds under way always."""
    name, at = command_name(o), target_ns(op, ns, o)
    return F.when(op == "c", F.when(name.isNull() | (name == "applyOps"), False).when(name.isin("startIndexBuild", "abortIndexBuild"), True).otherwise(drop_ns(at, white, black))).otherwise(drop_ns(at, white, black))


def drop_ddl(op: Column, ns: Column, o: Column, ddl_enable: bool) -> Column:
    return is_ddl(op, ns, o) & F.lit(not ddl_enable)


def drop_before(ts_t: Column, ts_i: Column, ckpt: int) -> Column:
    """Logs at or before the checkpoint. Compared by parts so that a scan can skip files."""
    t, i = ckpt >> 32, ckpt & 0xFFFFFFFF
    return (ts_t < t) | ((ts_t == t) & (ts_i <= i))


def up_to_exit(logs: DataFrame, exit_ts: int, full_finish: int = 0) -> DataFrame:
    """Logs up to the exit point, which only counts beyond the full copy's end."""
    if exit_ts <= 0:
        return logs
    ts = ts_pack(F.col("ts_t"), F.col("ts_i"))
    return logs.filter(ts <= max(exit_ts, full_finish))


def fail_on_migration(logs: DataFrame) -> DataFrame:
    """Fails the job if a log comes from a chunk migration: the balancer must be off."""
    guard = F.when(F.coalesce(F.col("from_migrate"), F.lit(False)), F.raise_error(F.lit("log of a chunk migration: the balancer is on"))).otherwise(F.col("op"))
    return logs.withColumn("op", guard.cast("string"))


def fail_on_early_ddl(logs: DataFrame, full_finish: int) -> DataFrame:
    """Fails the job if a DDL is from before the full copy's end."""
    ddl = is_ddl(F.col("op"), F.col("ns"), F.col("o")) & (ts_pack(F.col("ts_t"), F.col("ts_i")) <= full_finish)
    return logs.withColumn("op", F.when(ddl, F.raise_error(F.lit("DDL during the full copy"))).otherwise(F.col("op")).cast("string"))


def filter_logs(logs: DataFrame, gids: list[str] = (), white: list[str] = (), black: list[str] = (), pass_special: list[str] = (), ddl_enable: bool = False) -> DataFrame:
    """The whole chain: own namespaces, index builds, no-ops, group ids, then namespaces and DDL. ``ns`` becomes what the log acts on."""
    op, ns, o = F.col("op"), F.col("ns"), F.col("o")
    drop = chain(drop_noop(op), drop_gid(F.col("gid"), list(gids)), drop_own_ns(ns, list(pass_special)), drop_index_build(op, o), drop_ddl(op, ns, o, ddl_enable), drop_log_ns(op, ns, o, list(white), list(black)))
    return logs.filter(~drop).withColumn("ns", target_ns(op, ns, o))
