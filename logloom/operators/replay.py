"""Replay: the ordered log folded over a snapshot, by key.

Three tiers, from cheap to general:

1. ``last_state``: whole documents, last writer wins. One aggregate with map-side
   combining; nothing is sorted.
2. ``fold_fields``: flat documents as maps of fields, with $set and $unset.
   A key's operations are folded in order in one expression.
3. ``fold_documents``: nested documents and dotted paths, in Python by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import documents as D

ORDER = ["ts_t", "ts_i", "seq"]


def last_state(logs: DataFrame, keys: list[str], values: list[str], order: list[str] = ORDER) -> DataFrame:
    """The live rows after i (insert), u (replace or insert) and d (delete); others are ignored."""
    last = F.max_by(F.struct("op", *values), F.struct(*order)).alias("last")
    return logs.filter(F.col("op").isin("i", "u", "d")).groupBy(*keys).agg(last).filter("last.op <> 'd'").select(*keys, *[f"last.{v}" for v in values])


def snapshot_then_log(snapshot: DataFrame, logs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The snapshot's rows as inserts before all logs, then ``last_state``."""
    first = snapshot.select(*keys, *values).withColumns({"op": F.lit("i"), "ts_t": F.lit(-1).cast("long"), "ts_i": F.lit(-1).cast("long"), "seq": F.lit(-1).cast("long")})
    return last_state(first.unionByName(logs.select(*keys, *values, "op", *ORDER)), keys, values)


def _entries(values: Column) -> Column:
    return F.coalesce(values, F.create_map().cast("map<string,string>"))


def fold_fields(logs: DataFrame, keys: list[str], upsert: bool = False, dup: str = "skip", order: list[str] = ORDER) -> DataFrame:
    """(keys, doc map, n_conflicts, n_missed) of the live documents.

    ``logs`` has op, set_fields (map), unset_fields (array) and replace (boolean, for
    updates). An insert over a live document is skipped, merged or replaces it by
    ``dup`` (skip, merge, replace); such conflicts are counted. An update without
    live document does nothing, or inserts with ``upsert``; misses are counted.
    A delete ends the document's life. No-ops and commands are ignored.

    A key's operations are gathered and folded in order in one expression; keys with
    very long histories belong in ``fold_documents``, which streams them.
    """
    rows = logs.filter(F.col("op").isin("i", "u", "d"))
    one = F.struct(*order, "op", F.map_entries(_entries(F.col("set_fields"))).alias("f"), F.coalesce("unset_fields", F.array().cast("array<string>")).alias("g"), F.coalesce("replace", F.lit(False)).alias("r"))
    ops = F.array_sort(F.collect_list(one))
    kind = "struct<live:boolean,doc:map<string,string>,conflicts:bigint,missed:bigint>"
    start = F.from_json(F.lit('{"live":false,"doc":{},"conflicts":0,"missed":0}'), kind)

    def merge(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)

    def step(a: Column, x: Column) -> Column:
        insert, update, delete, live = x["op"] == "i", x["op"] == "u", x["op"] == "d", a["live"]
        f = F.map_from_entries(x["f"])
        clash, miss = insert & live, update & ~live
        without = F.map_filter(a["doc"], lambda k, v: ~F.array_contains(x["g"], k))
        clashed = {"skip": a["doc"], "merge": merge(a["doc"], f), "replace": f}[dup]
        empty = F.create_map().cast("map<string,string>")
        doc = F.when(delete, empty).when(clash, clashed).when(insert, f).when(miss & ~F.lit(upsert), empty).when(x["r"] | miss, f).otherwise(merge(without, f))
        alive = F.when(delete, False).when(insert, True).otherwise(live | F.lit(upsert))
        return F.struct(alive.alias("live"), doc.alias("doc"), (a["conflicts"] + clash.cast("long")).alias("conflicts"), (a["missed"] + miss.cast("long")).alias("missed"))

    folded = rows.groupBy(*keys).agg(F.aggregate(ops, start, step).alias("s"))
    return folded.filter("s.live").select(*keys, F.col("s.doc").alias("doc"), F.col("s.conflicts").alias("n_conflicts"), F.col("s.missed").alias("n_missed"))


def fold_documents(logs: DataFrame, keys: list[str], upsert: bool = False, dup: str = "skip", order: list[str] = ORDER) -> DataFrame:
    """(keys, doc JSON) of the live documents after logs with JSON ``o`` and ``o2``; updates as in ``documents``.

    Rows are dealt by key and sorted within partitions; a key's operations stream
    through one at a time, so a hot key needs no memory for its history.
    """
    wanted = logs.filter(F.col("op").isin("i", "u", "d")).select(*keys, "op", "o", "o2", *order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, doc, done = None, None, []
        for frame in frames:
            for *key, op, o, o2 in frame[[*keys, "op", "o", "o2"]].itertuples(index=False):
                if key != now:
                    if doc is not None:
                        done.append((*now, D.save(doc)))
                    now, doc = key, None
                doc = _apply(doc, op, D.load(o), D.load(o2), upsert, dup)
            yield pd.DataFrame(done, columns=[*keys, "doc"])
            done = []
        if doc is not None:
            yield pd.DataFrame([(*now, D.save(doc))], columns=[*keys, "doc"])

    schema = ", ".join(f"{k} {wanted.schema[k].dataType.simpleString()}" for k in keys) + ", doc string"
    return wanted.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _apply(doc: dict | None, op: str, o: dict, o2: dict, upsert: bool, dup: str) -> dict | None:
    if op == "d":
        return None
    if op == "i":
        return o if doc is None or dup == "replace" else doc if dup == "skip" else {**doc, **o}
    if doc is None and not upsert:
        return None
    if o.get("$v") == 2 and "diff" in o:
        changes, _ = D.diff_to_update(o["diff"])
        for name, fields in changes:
            doc = doc or dict(o2)
            cut = [(path, v["$slice"][1]) for path, v in fields.items() if name == "$set" and isinstance(v, dict) and v.get("$slice", [None])[0] == f"${path}"]
            for path, length in cut:
                fields = {path: (D.at_path(doc, path) or [])[:length]}
            doc = D.apply_update(doc, {name: fields})
        return doc
    return D.apply_update(doc if doc is not None else dict(o2), o)


def insert_new(inserts: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Inserts whose key the target lacks."""
    return inserts.join(target.select(*keys), keys, "left_anti")


def insert_conflicts(inserts: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Inserts whose key the target has: the conflict log."""
    return inserts.join(target.select(*keys).distinct(), keys, "left_semi")


def update_matches(updates: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Updates with ``matched``: whether the target has their key. Strict writers fail on those that don't match."""
    return updates.join(target.select(*keys, F.lit(True).alias("matched")).distinct(), keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def delete_rows(target: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows that no delete names."""
    return target.join(deletes.select(*keys), keys, "left_anti")


def lifetimes(logs: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """``logs`` with ``life``: how many deletes of the key came before."""
    return logs.withColumn("life", F.coalesce(F.sum((F.col("op") == "d").cast("long")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def writer_mode(bulk: bool, with_gid: bool, target_version: str, ns: str) -> str:
    """Which rules apply to clashes and misses: single, command or bulk."""
    enough = tuple(int(x) for x in target_version.split(".")[:2]) >= (3, 2)
    if not (bulk and enough) or ns.endswith("system.indexes"):
        return "single"
    return "command" if with_gid else "bulk"


#: What each writer does with an insert that clashes when duplicates are to update.
DUP_BY_WRITER = {"single": "merge", "bulk": "merge", "command": "replace"}


def error_is_ignorable(op: Column, code: Column, in_full_sync: Column) -> Column:
    """Target errors that replay may pass over (fixed values): they show that the full copy already holds the change."""
    return ((op == "u") & in_full_sync & code.isin(28, 211)) | (op.isin("u", "i") & in_full_sync & (code == 11000)) | (op.isin("d", "c") & (code == 26)) | (code == 61)
