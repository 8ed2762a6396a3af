"""Comparison of a source with a target: names, counts, rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.metrics import running


def union_names(*catalogs: DataFrame) -> DataFrame:
    """Namespaces of all sources, each once."""
    out = catalogs[0].select("ns")
    for c in catalogs[1:]:
        out = out.unionByName(c.select("ns"))
    return out.distinct()


def merged(sources: list[DataFrame], order: str) -> DataFrame:
    """All sources' rows with ``place``, their order by a whole number over all of them."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return running(out.withColumn("_one", F.lit(1).cast("long")), order, "sum", "_one", "place").drop("_one")


def by_database(names: DataFrame) -> DataFrame:
    """(db, colls) with the collections in order."""
    return names.groupBy(F.substring_index("ns", ".", 1).alias("db")).agg(F.array_sort(F.collect_set(F.get(F.split("ns", r"\.", 2), F.lit(1)))).alias("colls"))


def name_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ns, side) of names that only one side has."""
    left, right = a.select("ns", F.lit(True).alias("a")).distinct(), b.select("ns", F.lit(True).alias("b")).distinct()
    return left.join(right, "ns", "full_outer").filter("a is null or b is null").select("ns", F.when(F.col("a").isNull(), "target").otherwise("source").alias("side"))


def without(names: DataFrame, excluded: list[str]) -> DataFrame:
    return names.filter(~F.col("ns").isin(excluded)) if excluded else names


def row_difference(source: DataFrame, target: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, state) of rows that are missing, extra or different in the target.

    Both sides are reduced to key and digest before they meet. A null value
    differs from every other; rows with null keys meet by them.
    """
    digest = F.xxhash64(*[x for v in values for x in (F.col(v).isNull(), F.coalesce(F.col(v).cast("string"), F.lit("")))])
    left = source.select(*[F.col(k).alias(f"s_{k}") for k in keys], digest.alias("s"))
    right = target.select(*[F.col(k).alias(f"t_{k}") for k in keys], digest.alias("t"))
    same = [F.col(f"s_{k}").eqNullSafe(F.col(f"t_{k}")) for k in keys]
    both = left.join(right, same, "full_outer")
    state = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s") != F.col("t"), "different")
    return both.select(*[F.coalesce(f"s_{k}", f"t_{k}").alias(k) for k in keys], state.alias("state")).filter("state is not null")


def count_report(source: DataFrame, target: DataFrame) -> DataFrame:
    """(ns, n_source, n_target, same) over both sides."""
    s, t = source.groupBy("ns").agg(F.count(F.lit(1)).alias("n_source")), target.groupBy("ns").agg(F.count(F.lit(1)).alias("n_target"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.join(t, "ns", "full_outer").select("ns", n("n_source"), n("n_target")).withColumn("same", F.col("n_source") == F.col("n_target"))


def sampled(frame: DataFrame, key: str, one_in: int) -> DataFrame:
    """A repeatable sample by the key's hash, for spot checks."""
    return frame.filter(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0)
