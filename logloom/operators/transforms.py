"""Renaming of namespaces in logs, commands and references."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import documents as D
from logloom.operators.commands import ON_COLLECTION

Rules = list[tuple[str, str]]


def parse_rules(rules: list[str]) -> Rules:
    """``from:to`` pairs. Both sides must be databases, or both namespaces."""
    out = []
    for r in rules:
        a, colon, b = r.partition(":")
        if not (a and colon and b) or ("." in a) != ("." in b):
            raise ValueError(f"transform rule {r!r}")
        out.append((a, b))
    return out


def rename(ns: Column, rules: Rules) -> Column:
    """Namespace by the first rule that names it or something above it."""
    out = ns
    for a, b in reversed(rules):
        pattern = "^" + re.escape(a) + r"(\..*)?$"
        out = F.when(ns.rlike(pattern), F.concat(F.lit(b), F.regexp_extract(ns, pattern, 1))).otherwise(out)
    return out


def rename_text(ns: str, rules: Rules) -> str:
    for a, b in rules:
        if ns == a or ns.startswith(a + "."):
            return b + ns[len(a) :]
    return ns


def db_targets(spark: SparkSession, rules: Rules) -> DataFrame:
    """(db, targets): all databases that a source database goes to."""
    rows = [(a.partition(".")[0], b.partition(".")[0]) for a, b in rules]
    return spark.createDataFrame(rows, "db string, target string").groupBy("db").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def with_db_targets(frame: DataFrame, rules: Rules, db: str = "db") -> DataFrame:
    """``frame`` with ``targets``; a database without rule goes to itself. The rules are configuration, so small."""
    table = F.broadcast(db_targets(frame.sparkSession, rules).withColumnRenamed("db", "_db"))
    return frame.join(table, F.col(db) == F.col("_db"), "left").withColumn("targets", F.coalesce("targets", F.array(db))).drop("_db")


def rename_log(op: str, ns: str, text: str | None, rules: Rules, dbref: bool = False) -> tuple[str, str] | None:
    """(namespace, document) of one log after renaming; None if a command can't be read."""
    db, doc = ns.partition(".")[0], D.load(text)
    new = lambda x: rename_text(x, rules)
    if op != "c":
        if ns.endswith("system.indexes") and "ns" in doc:
            doc["ns"] = new(doc["ns"])
        return new(ns), D.save(D.rewrite_dbref(doc, db, new) if dbref else doc)
    name = next(iter(doc), None)
    if name == "renameCollection":
        if not isinstance(doc[name], str) or not isinstance(doc.get("to"), str):
            return None
        doc[name], doc["to"] = new(doc[name]), new(doc["to"])
        return doc[name], D.save(doc)
    if name == "applyOps":
        children = []
        for x in doc[name]:
            found = rename_log(x["op"], x["ns"], D.save(x.get("o", {})), rules, dbref)
            if found is None:
                return None
            children.append({**x, "ns": found[0], "o": D.load(found[1])})
        return ns, D.save({**doc, name: children})
    if name in ON_COLLECTION:
        if not isinstance(doc[name], str):
            return None
        if name == "create" and isinstance(doc.get("idIndex"), dict) and "ns" in doc["idIndex"]:
            doc["idIndex"] = {**doc["idIndex"], "ns": new(doc["idIndex"]["ns"])}
        home = new(f"{db}.{doc[name]}")
        doc[name] = home.partition(".")[2]
        return home, D.save(doc)
    return (new(ns), D.save(doc)) if name == "dropDatabase" else None


def rename_logs(logs: DataFrame, rules: Rules, dbref: bool = False) -> DataFrame:
    """Logs with ``ns`` and ``o`` renamed; commands that can't be read go.

    Plain data without references stays in column expressions; only commands,
    index inserts and (with ``dbref``) documents that hold a reference are handed
    to Python.
    """
    if not rules and not dbref:
        return logs
    deep = (F.col("op") == "c") | F.endswith("ns", F.lit("system.indexes")) | (F.lit(dbref) & F.contains("o", F.lit('"$ref"')))

    def one(op, ns, o):
        found = rename_log(op, ns, o, rules, dbref)
        return None if found is None else D.save(list(found))

    changed = F.from_json(D.vectorised(one)("op", "ns", "o"), "array<string>")
    easy = logs.filter(~deep).withColumn("ns", rename(F.col("ns"), rules))
    hard = logs.filter(deep).withColumn("_new", changed).filter(F.col("_new").isNotNull())
    hard = hard.withColumn("ns", F.col("_new")[0]).withColumn("o", F.col("_new")[1]).drop("_new")
    return easy.unionByName(hard)
