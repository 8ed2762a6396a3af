"""Chunk maps, and documents that lie on a shard that doesn't own them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_map(chunks: DataFrame, shards: DataFrame, collections: DataFrame) -> DataFrame:
    """(replset, ns, keys, shard_type, mins, maxs) from the three catalog tables.

    ``chunks`` has (ns, shard, min, max), ``shards`` (shard, host as set/addresses),
    ``collections`` (ns, keys, hashed). Dropped collections aren't in it, so their chunks go.
    """
    hosts = shards.select("shard", F.substring_index("host", "/", 1).alias("replset"))
    ranges = chunks.join(hosts, "shard").join(collections, "ns")
    return ranges.groupBy("replset", "ns", "keys", F.when(F.col("hashed"), "hashed").otherwise("ranged").alias("shard_type")).agg(
        F.array_sort(F.collect_list(F.struct("min", "max"))).alias("ranges")
    )


def balancer_off(settings: DataFrame) -> DataFrame:
    """One row, ``stopped``: whether the balancer's setting says so; without a setting it runs."""
    return settings.filter("_id = 'balancer'").agg(F.coalesce(F.bool_or("stopped"), F.lit(False)).alias("stopped"))


def owned(docs: DataFrame, chunks: DataFrame, keys: list[Column], ns: Column | None = None, limit: int = 100_000) -> DataFrame:
    """Documents that lie in some chunk [min, max) of the ``chunks`` (mins struct, maxs struct), or whose namespace has no chunk at all.

    ``keys`` are compared in order as one struct. Chunks don't overlap, so the
    one chunk that can hold a key is the last that begins at or below it: each row
    finds it by binary search in a sorted array, broadcast while it holds at most
    ``limit`` chunks; beyond that a sorted sweep over keys and bounds decides.
    """
    n = chunks.limit(limit + 1).count()
    if n == 0:
        return docs
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    if n > limit:
        return _owned_by_sweep(docs, chunks, key)
    table = F.broadcast(chunks.agg(F.array_sort(F.collect_list(F.struct("mins", "maxs"))).alias("_chunks")))  # limit at most
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get("_chunks", at + s - 1)["mins"] <= key, at + s).otherwise(at))
    inside = F.coalesce(key < F.get("_chunks", below - 1)["maxs"], F.lit(False)) & (below > 0)
    return docs.crossJoin(table).filter(inside).drop("_chunks")


def _owned_by_sweep(docs: DataFrame, chunks: DataFrame, key: Column) -> DataFrame:
    """Buckets of the first key's range join chunks and rows; the exact bounds are compared within a bucket."""
    first = key.getField("k0")
    spread = chunks.select("mins", "maxs", F.col("mins.*")).toDF("mins", "maxs", *[f"m{i}" for i in range(len(chunks.schema["mins"].dataType.fields))])
    cuts = spread.agg(F.percentile_approx("m0", [k / 1024 for k in range(1, 1024)], 10000)).first()[0]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    bucket = lambda v: F.size(F.filter(bounds, lambda b: b <= v))
    top = F.col("maxs").getField(chunks.schema["maxs"].dataType.fields[0].name)
    wide = spread.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("m0")), bucket(top)))).select("_bucket", "mins", "maxs")
    rows = docs.withColumn("_bucket", bucket(first)).withColumn("_key", key)
    return rows.alias("d").join(wide.alias("c"), (F.col("d._bucket") == F.col("c._bucket")) & (F.col("_key") >= F.col("mins")) & (F.col("_key") < F.col("maxs")), "left_semi").drop("_bucket", "_key")
