"""Line dedup with a sharded minimal perfect hash.

Line keys (a line stripped of ASCII white space, A-Z lower-cased) are hashed to
128 bits and counted over all documents with map-side combining. The keys found
often enough go into shards; each shard is a minimal perfect hash (levels of bit
arrays, ranks by running popcounts) that indexes an array of 64-bit fingerprints,
an array of document counts and an array of the largest ``doc_id``. Documents
probe those arrays; lines are never joined.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import WHITE, free_name, settle, store, text_slices

#: Keys a shard holds on average; bounds the task that builds it.
SHARD_KEYS = 1 << 16
#: Bytes of shards broadcast at once; documents are probed in as many passes as needed.
PASS_BYTES = 128 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it has fewer than ``min_chars`` code points."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def key_hash(key: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(key)
    return whole >> 64, whole & 0xFFFFFFFFFFFFFFFF


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of the keys for each level."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys onto 0..n-1.

    In each level the keys that fall alone on a bit set it, the others go on to
    the next level. A key's index is the rank of its bit over all levels.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(bits).astype(np.int64))))

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(keys):
            m = 64 * max(1, math.ceil(gamma * len(keys) / 64))
            at = (_spread(keys, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m)[at] == 1
            flags = np.zeros(m, np.uint8)
            flags[at[alone]] = 1
            parts.append(np.packbits(flags, bitorder="little").view("<u8"))
            sizes.append(m)
            keys, level = keys[~alone], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or an arbitrary index for keys outside the set."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            bit = (_spread(keys[left], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.bits[word] >> shift) & np.uint64(1) == 1
            below = self.bits[word[here]] & ((np.uint64(1) << shift[here]) - np.uint64(1))
            out[left[here]] = self.ranks[word[here]] + np.bitwise_count(below)
            left = left[~here]
            if not len(left):
                break
        return out


def pack_shard(high: np.ndarray, low: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> bytes:
    """Shard of the index as bytes: hash levels, then fingerprint, count and owner arrays in hash order."""
    table = PerfectHash.build(high)
    order = np.argsort(table.find(high))
    out = io.BytesIO()
    np.savez(out, sizes=table.sizes, bits=table.bits, prints=low[order], counts=counts[order], keep=keep[order])
    return out.getvalue()


class Shard:
    def __init__(self, blob: bytes):
        x = np.load(io.BytesIO(blob))
        self.hash = PerfectHash(x["sizes"], x["bits"])
        self.prints, self.counts, self.keep = x["prints"], x["counts"], x["keep"]

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is a member, document count, largest doc_id) of each hash."""
        at = self.hash.find(high)
        safe = np.maximum(at, 0)
        return (at >= 0) & (self.prints[safe] == low), self.counts[safe], self.keep[safe]


def _emit_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            ids = batch.column(0)
            high, low, row = [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                for key in {k for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k is not None}:
                    a, b = key_hash(key)
                    high.append(a)
                    low.append(b)
                    row.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint64).view(np.int64)), ids.take(pa.array(row, pa.int32()))],
                names=["high", "low", "doc_id"],
            )

    return run


def _build(n_shards: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        blob = pack_shard(*(frame[c].to_numpy().view(np.uint64) for c in ("high", "low")), frame["n"].to_numpy(np.int64), frame["keep"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "bytes": [len(blob)], "blob": [blob]})

    return run


def line_index(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> tuple[DataFrame, int]:
    """Shards (shard, bytes, blob) of the lines found in at least ``min_docs`` documents, and their number.

    A row of ``docs`` is a document; a line counts once in each.
    """
    keys = docs.select("doc_id", "text").mapInArrow(_emit_keys(min_chars), "high long, low long, doc_id long")
    often = settle(
        keys.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).filter((F.col("n") >= min_docs) & F.col("keep").isNotNull())
    )
    n_shards = max(1, math.ceil(often.count() / SHARD_KEYS))
    shards = often.withColumn("shard", F.pmod("high", F.lit(n_shards)).cast("int")).groupBy("shard").applyInPandas(_build(n_shards), "shard int, bytes long, blob binary")
    return settle(shards), n_shards


def _probe(blobs, n_shards: int, min_chars: int, min_docs: int, names: list[str], hit_name: str, last: bool):
    """Adds the ordinals of lines to drop; the last pass drops them."""
    at_id, at_text, at_hits = (names.index(x) for x in ("doc_id", "text", hit_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {k: Shard(v) for k, v in blobs.value.items()}
        for batch in text_slices(batches, at_text):
            texts = batch.column(at_text).cast(pa.binary()).to_pylist()
            ids = batch.column(at_id).to_pylist()
            hits = batch.column(at_hits).to_pylist()
            split = [(x or b"").split(b"\n") for x in texts]
            high, low, row, line = [], [], [], []
            for i, lines in enumerate(split):
                for j, x in enumerate(lines):
                    key = line_key(x, min_chars)
                    if key is not None:
                        a, b = key_hash(key)
                        high.append(a)
                        low.append(b)
                        row.append(i)
                        line.append(j)
            high, low = np.array(high, np.uint64), np.array(low, np.uint64)
            home = np.mod(high.view(np.int64), n_shards)
            for k, shard in shards.items():
                mine = np.flatnonzero(home == k)
                found, counts, keep = shard.probe(high[mine], low[mine])
                for m, owner in zip(mine[found & (counts >= min_docs)].tolist(), keep[found & (counts >= min_docs)].tolist()):
                    if ids[row[m]] != owner:
                        hits[row[m]].append(line[m])
            columns = list(batch.columns)
            if not last:
                columns[at_hits] = pa.array(hits, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            kept = []
            for text, lines, gone in zip(texts, split, hits):
                gone = set(gone)
                kept.append(b"\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text)
            columns[at_text] = pa.array(kept, pa.binary()).cast(pa.string())
            columns[at_hits] = pa.array([len(x) for x in split], pa.int64())
            columns.append(pa.array([len(x) for x in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:at_hits], "n_lines", *names[at_hits + 1 :], "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Drop lines found in at least ``min_docs`` documents, except in the largest ``doc_id`` that holds them.

    Returns the columns of ``docs`` with ``text`` replaced, and ``n_lines`` (before
    dropping) and ``n_dropped``. Keys shorter than ``min_chars`` code points are
    never dropped.

    Null or empty text is one empty line and stays as it is. Each row is a
    document, so repeated rows count separately; rows that tie for the largest
    ``doc_id`` all keep the line. A row without ``doc_id`` counts, but owns no
    line unless no holder has one; then the line stays everywhere. An empty table
    gives an empty table. Other columns pass through; ones named ``n_lines`` or
    ``n_dropped`` (in any case) are replaced. Very long texts are split whole.

    The index is broadcast in passes of at most ``pass_bytes`` (one shard at
    least), so its size may exceed any executor.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    index, n_shards = line_index(docs, min_chars, min_docs)
    sizes = sorted((r["shard"], r["bytes"]) for r in index.select("shard", "bytes").collect())  # two numbers for each SHARD_KEYS keys
    passes: list[list[int]] = [[]]
    room = pass_bytes
    for shard, size in sizes:
        if size > room and passes[-1]:
            passes.append([])
            room = pass_bytes
        passes[-1].append(shard)
        room -= size
    hits = free_name(docs.columns, "_hits")
    out = docs.withColumn(hits, F.array().cast("array<int>"))
    fields = out.schema.fields
    for k, shards in enumerate(passes):
        blobs = {r["shard"]: bytes(r["blob"]) for r in index.filter(F.col("shard").between(shards[0], shards[-1])).collect()} if shards else {}
        last = k == len(passes) - 1
        kind = T.StructType([T.StructField("n_lines", T.LongType()) if last and f.name == hits else f for f in fields] + ([T.StructField("n_dropped", T.LongType())] if last else []))
        held = spark.sparkContext.broadcast(blobs)
        out = out.mapInArrow(_probe(held, n_shards, min_chars, min_docs, out.columns, hits, last), kind)
        if not last:
            out = store(out, "lines")
            held.destroy()
    return out


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``dedup_lines`` with the columns of ``docs`` alone, whatever their names.

    Where lines went, a column ``n_chars`` gets the new text's code points.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", *([F.struct(*rest).alias("_rest")] if rest else []))
    out = dedup_lines(held, min_chars, min_docs)
    if "n_chars" in rest:
        new = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_rest.n_chars"))
        out = out.withColumn("_rest", F.col("_rest").withField("n_chars", new))
    return out.select([F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns])
