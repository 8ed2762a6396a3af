"""SimHash near-dedup with covering locality-sensitive hashing.

The 64 fingerprint bits are dealt to the non-zero vectors of GF(2)^(radius+1).
For every non-zero vector v there is one table; its mask keeps the bits whose
vector has odd inner product with v. Any ``radius`` differing bits leave some v
orthogonal to all their vectors, so every pair within the radius collides in
that table, with certainty.

Within the tables, pairs are not listed. Fingerprints that collide emit the
values at distance ``radius/2`` or less on their free bits; two fingerprints meet
in such a value exactly if they differ by ``radius`` bits or fewer. Each meeting
point adds a star of links, so work stays linear in a bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import free_name, if_small, settle, signed, text_slices
from logloom.llm.components import components

RADIUS = 2


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) words' shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), ">u8", n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes; 0 without any."""
    hashes, counts = hashes.astype(">u8", copy=False), np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[start : start + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(x, width)) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector; see the module's docstring."""
    size = (1 << (radius + 1)) - 1
    vector = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within RADIUS = 2 bits."""
    masks = [signed(m) for m in covering_masks()]
    rows = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept"), F.lit(~m).alias("free")) for k, m in enumerate(masks)])).alias("r")).select("fp", "r.*")
    crowded = rows.groupBy("t", "kept").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("t", "kept")
    near = rows.join(crowded, ["t", "kept"]).groupBy("fp").agg(F.bit_or("free").alias("free"))
    flips = F.array(F.lit(0).cast("long"), *[F.col("free").bitwiseAND(F.lit(signed(1 << i))) for i in range(64)])
    meet = near.select("fp", F.explode(F.array_distinct(flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    meet = settle(meet)
    stars = meet.groupBy("mid").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("mid", "lo")
    return meet.join(stars, "mid").filter("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b")).distinct()


def near_rows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, root) of every row; root names the component by one of its fingerprints."""
    prints = settle(fingerprints(docs, width))
    roots = settle(components(links(prints.select("fp").distinct()))).withColumnRenamed("node", "fp")
    return prints.join(roots, "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id long) of every row of ``docs``.

    Rows whose fingerprints are joined by steps of 2 or fewer differing bits form
    a component, named by its smallest ``doc_id`` (null only if no member has
    one). Null, empty and blank texts have fingerprint 0 and link like any other;
    texts shorter than ``width`` words are one shingle. Ties and repeated rows
    share fingerprint and component. An empty table gives an empty table. Other
    columns are not read, so their names don't matter.
    """
    rows = settle(near_rows(docs, width))
    named = settle(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(named, "root").select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id``; see ``keep_first``."""
    return keep_first(docs, near_rows(docs, width), partial(fingerprint, width=width))


def keep_first(docs: DataFrame, rows: DataFrame, key: Callable[[bytes | None], int]) -> DataFrame:
    """``docs`` with one row of each component of ``rows`` (doc_id, fp, root), columns unchanged.

    ``key`` gives a text's ``fp`` as an unsigned integer. The smallest ``doc_id``
    stays, of several texts with it the one with the smallest ``fp``; of rows that
    are equal in both one stays. Rows without ``doc_id`` come after all others, so
    a component without any keeps one of them. Rows are told apart by ``doc_id``
    alone where it is unique; only for the others ``fp`` is computed again.
    """
    rows = settle(rows)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("best")
    kept = settle(rows.groupBy("root").agg(best).select("best.doc_id", "best.fp"))
    repeats = settle(rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    plain = docs.filter(F.col("doc_id").isNotNull())
    n_repeats = repeats.count()
    if n_repeats:
        plain = plain.join(if_small(repeats, n_repeats), "doc_id", "left_anti").select(docs.columns)
    gone = settle(rows.join(kept, ["doc_id", "fp"], "left_anti").select("doc_id").filter(F.col("doc_id").isNotNull()).distinct())
    out = plain.join(if_small(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
    again = docs.join(if_small(repeats, n_repeats), "doc_id", "left_semi").select(docs.columns) if n_repeats else docs.limit(0)
    if not rows.filter(F.col("doc_id").isNull()).isEmpty():
        again = again.unionAll(docs.filter(F.col("doc_id").isNull()))
    elif not n_repeats:
        return out
    at, of = free_name(docs.columns, "_fp"), free_name(docs.columns, "_doc_id")
    keyed = _keyed(again, key, at)
    wanted = kept.join(repeats, "doc_id", "left_semi").unionAll(kept.filter(F.col("doc_id").isNull()))
    wanted = wanted.select(F.col("doc_id").alias(of), F.col("fp").alias(at))
    found = keyed.join(wanted.withColumnRenamed(at, at + "_"), F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(at) == F.col(at + "_")), "left_semi")
    return out.unionAll(found.dropDuplicates(["doc_id", at]).select(docs.columns))


def _keyed(rows: DataFrame, key: Callable[[bytes | None], int], name: str) -> DataFrame:
    """``rows`` with the fingerprint as column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            for part in text_slices([batch], at):
                found = pa.array([signed(key(x)) for x in part.column(at).cast(pa.binary()).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))
