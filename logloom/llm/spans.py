"""Substring dedup by sliding sentence spans.

A text is cut into sentences; from every sentence the shortest run of several
consecutive sentences with enough words is hashed, and so is the shortest run that
ends with it. A longer run repeats only if these repeat, and they cover it. Runs
are joined over all documents by hash; every occurrence but the first (by doc_id
and position) marks its sentences, which are then removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm.common import free_name, settle, text_slices

#: Sentences and words a run has at least; with fewer words, short common phrases would count as copies.
SEVERAL, MIN_WORDS = 2, 16
_BREAK = re.compile(rb"(?<=[.!?])[ \t-\r]+|\n[ \t-\r]*")


def sentences(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, normal form) of each sentence with a word; its end takes in the white space behind it."""
    out, start = [], 0
    for end in [*(m.end() for m in _BREAK.finditer(text)), len(text)]:
        words = text[start:end].lower().split()
        if words:
            out.append((start, end, len(words), b" ".join(words)))
            start = end
        elif out and end > start:  # a blank stretch belongs to the sentence before it
            out[-1] = (out[-1][0], end, *out[-1][2:])
            start = end
    return out


def runs(found: list[tuple[int, int, int, bytes]], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of SEVERAL sentences and ``min_words`` words from and up to each sentence."""
    out, n = set(), len(found)
    ends = np.cumsum([0, *(x[2] for x in found)]).tolist()  # words before each sentence
    last = 0
    for first in range(n):
        last = max(last, first + SEVERAL - 1)
        while last < n and ends[last + 1] - ends[first] < min_words:
            last += 1
        if last >= n:
            break
        out.add((first, last))
    first = n - 1
    for last in range(n - 1, -1, -1):
        first = min(first, last - SEVERAL + 1)
        while first >= 0 and ends[last + 1] - ends[first] < min_words:
            first -= 1
        if first < 0:
            break
        out.add((first, last))
    return sorted(out)


def _emit(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            high, low, row, at = [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                found = sentences(text)
                normal = [x[3] for x in found]
                for first, last in runs(found, min_words):
                    h = xxhash.xxh3_128_intdigest(b"\n".join(normal[first : last + 1]))
                    high.append(h >> 64)
                    low.append(h & 0xFFFFFFFF)
                    row.append(i)
                    at.append(first << 32 | last)
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint32).view(np.int32)), pa.array(at, pa.int64())],
                names=["id", "mark", "high", "low", "at"],
            )

    return run


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, mark, at) of the runs that aren't the first of their hash, from (id, mark, text); ``at`` packs first and last sentence."""
    spans = docs.select("id", "mark", "text").mapInArrow(_emit(min_words), "id long, mark long, high long, low int, at long")
    first = F.min(F.struct("id", "mark", "at")).alias("first")
    # settled, so that both sides of the join are plain shuffles and Spark can split a hot run
    often = settle(spans.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1").select("high", "low", "first"))
    return spans.join(often, ["high", "low"]).filter(F.struct("id", "mark", "at") != F.col("first")).select("id", "mark", "at")


def _rewrite(names: list[str], text_at: int, cut_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_at):
            texts, total, gone = batch.column(text_at).cast(pa.binary()).to_pylist(), [], []
            for i, cuts in enumerate(batch.column(cut_at).to_pylist()):
                found = sentences(texts[i] or b"")
                total.append(len(found))
                covered = bytearray(len(found))
                for at in cuts or ():
                    first, last = at >> 32, at & 0xFFFFFFFF
                    covered[first : last + 1] = b"\x01" * (last + 1 - first)
                gone.append(sum(covered))
                if gone[-1]:
                    texts[i] = b"".join(texts[i][a:b] for (a, b, *_), c in zip(found, covered) if not c)
            columns = [c for k, c in enumerate(batch.columns) if k != cut_at]
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=names)

    return run


def dedup_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated sentence runs, and ``n_sentences`` (before) and ``n_removed``.

    Sentences end at ., ! or ? before white space, and at line ends; they are
    compared by their lower-cased (A-Z, ASCII) words. Of all occurrences of a run the
    one with the smallest doc_id (nulls first), then text hash and position, stays.

    Null texts stay null; empty texts have no sentences. Rows with equal doc_id
    and text are one document and get the same result. Runs may repeat within a
    document. A text whose runs all repeat becomes empty. An empty table gives an
    empty table. Columns named ``n_sentences`` or ``n_removed`` (in any case) are
    replaced, others pass through. Only a run's hash and place are shuffled, and
    each text once to meet its cuts.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_sentences", "n_removed")])
    names = docs.columns
    key, mark, cuts = (free_name(names, x) for x in ("_key", "_mark", "_cuts"))
    lowest = -(1 << 63)
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)), mark: F.xxhash64("text")})
    found = repeated(keyed.select(F.col(key).alias("id"), F.col(mark).alias("mark"), "text"), min_words)
    found = found.groupBy("id", "mark").agg(F.collect_set("at").alias(cuts)).withColumnsRenamed({"id": key, "mark": mark})
    joined = keyed.join(found, [key, mark], "left").select(*names, cuts)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(_rewrite(schema.names, names.index("text"), len(names)), schema)
