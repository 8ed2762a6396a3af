"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents go to shards of bounded size by a hash; each shard is packed by
best-fit decreasing. Open bins stand in order of their residual capacity, and
among equal residuals by what they hold: bitmaps of the sources that are in once,
of the sources that are in as often as allowed, and of the duplicate clusters. A
search starts at the smallest sufficient residual and goes on to the successors
until it finds a compatible bin, so the tightest one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import settle, word_count

CAPACITY = 2048
#: Documents of one source that a bin may hold.
PER_SOURCE = 2
#: Rows a shard holds on average.
SHARD_ROWS = 16_384


class Bins:
    """Open bins of one shard, by residual and then by bitmaps."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source, self.count = capacity, per_source, 0
        self.levels: list[dict[tuple, list[int]]] = [{} for _ in range(capacity + 1)]
        self.filled = 0  # bit r: some bin has residual r
        self.used: list[int] = []

    def _add(self, bin_id: int, residual: int, state: tuple) -> None:
        self.levels[residual].setdefault(state, []).append(bin_id)
        self.filled |= 1 << residual

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, words before it) for an item; ``source`` and ``cluster`` are bits, cluster 0 for none."""
        rest = self.filled >> size
        residual = size - 1
        while rest:
            step = (rest & -rest).bit_length()
            residual += step
            rest >>= step
            level = self.levels[residual]
            for state, bins in level.items():
                if not (state[-2] & source or state[-1] & cluster):
                    bin_id = bins.pop()
                    if not bins:
                        del level[state]
                        if not level:
                            self.filled &= ~(1 << residual)
                    return self._into(bin_id, residual, size, state, source, cluster)
        bin_id, self.count = self.count, self.count + 1
        return self._into(bin_id, self.capacity, size, (0,) * (self.per_source + 1), source, cluster)

    def _into(self, bin_id: int, residual: int, size: int, state: tuple, source: int, cluster: int) -> tuple[int, int]:
        # state[k] marks sources with more than k documents; state[-1] marks clusters
        marks, carry = [], source
        for have in state[:-1]:
            marks.append(have | carry)
            carry &= have
        self._add(bin_id, residual - size, (*marks, state[-1] | cluster))
        return bin_id, self.capacity - residual


def pack_rows(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, words, bin, words before it) of one shard's rows, taken in the given order among equal sizes."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    bins, out = Bins(capacity, per_source), []
    last = []
    for row, size in enumerate(sizes):
        full = max(0, size - 1) // capacity
        for piece in range(full):
            out.append((row, piece, capacity, bins.count, 0))
            bins.count += 1
        last.append((size - full * capacity, row, full))
    for size, row, piece in sorted(last, key=lambda x: (-x[0], x[1])):
        out.append((row, piece, size, *bins.place(size, source_bit[sources[row]], cluster_bit.get(clusters[row], 0))))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, size_col: str | None = None, cluster_col: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, source, piece, n_words, bin_id, bin_start) of every piece of every row of ``docs``.

    A row of up to ``capacity`` words is one piece. A longer one is cut into full
    pieces, which fill a bin each, and a last piece that is packed like the rest.
    No bin holds more than ``capacity`` words; apart from full pieces, it holds at
    most ``per_source`` rows of one source and no two rows of one duplicate
    cluster. ``cluster_col`` names the cluster (null: alone); by default rows whose
    trimmed, lower-cased texts are equal are a cluster. ``size_col`` names the
    size; by default the text's words.

    Null and empty texts are pieces of 0 words. Null is a source; sources of
    another type are taken and returned as text. Repeated rows
    are packed each, in different bins. Ties go by ``doc_id``, nulls last, then by
    text. An empty table gives an empty table. Other columns are not read.
    ``bin_id`` is unique over all shards.
    """
    size = word_count(F.col("text")) if size_col is None else F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    digest = F.xxhash64(F.lower(F.trim(F.coalesce(F.col("text"), F.lit("")))))
    cluster = digest if cluster_col is None else F.when(F.col(cluster_col).isNotNull(), F.xxhash64(cluster_col))
    rows = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), cluster.alias("cluster"), F.xxhash64("doc_id", "text").alias("spread")))
    n_shards = max(1, math.ceil(rows.count() / shard_rows))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "spread"], na_position="last", kind="stable").reset_index(drop=True)
        sources = [x if isinstance(x, str) else None for x in frame["source"]]
        clusters = [("alone", i) if pd.isna(x) else x for i, x in enumerate(frame["cluster"])]
        found = pack_rows(frame["size"].tolist(), sources, clusters, capacity, per_source)
        out = pd.DataFrame(found, columns=["row", "piece", "n_words", "bin_id", "bin_start"])
        out["bin_id"] += int(frame["shard"].iloc[0]) << 32
        return out.assign(doc_id=frame["doc_id"].take(out["row"]).array, source=pd.Series(sources, dtype=object).take(out["row"]).array)[["doc_id", "source", "piece", "n_words", "bin_id", "bin_start"]]

    shards = rows.withColumn("shard", F.pmod("spread", F.lit(n_shards))).groupBy("shard")
    return shards.applyInPandas(run, "doc_id long, source string, piece int, n_words long, bin_id long, bin_start long")
