"""Near-dedup by Jaccard similarity of word shingles: SimHash and MinHash bands, then an exact check.

Texts of equal shingle sets are one node. The covering search of ``simhash`` finds
every pair of nodes whose SimHashes differ by 2 bits or fewer. Similar sets may
differ by more (at similarity 0.8 by about 10 bits); for these, BANDS bands of ROWS minima bring two
nodes of similarity s into one bucket but for a chance of (1 - s**ROWS) ** BANDS.
A few bytes of the minima tell likely pairs of a bucket apart from the others;
the close and the likely links join nodes to clusters, outside of which no pair needs
a look. Inside a cluster the shingle sets decide, in blocks of bounded size. Only
links that join two components are written, so rows stay linear in a group's
size, and nodes that are linked already are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import if_small, settle, signed, store, text_slices
from logloom.llm.components import components
from logloom.llm.simhash import keep_first, links, majority

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Bytes of minima that tell likely pairs, and the share of equal ones that makes a pair likely.
SKETCH, LIKELY = 64, 0.5
#: Nodes of a bucket up to which its likely links are looked for; a larger one is a cluster as it is.
BUCKET = 2048
#: Nodes of a block on average, and how often a larger cluster is dealt out into blocks before the rest is compared.
BLOCK, DEALS = 1024, 2
_RNG = np.random.default_rng(5)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_OF_ROW = _RNG.integers(0, 1 << 64, (1, ROWS), np.uint64) | np.uint64(1)
_OF_BAND = _RNG.integers(0, 1 << 64, BANDS, np.uint64)
_OF_WORD = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 1 << 64, WIDTH, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, cache: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the lower-cased (A-Z) words' distinct shingles; shorter texts are one shingle, texts without words none."""
    words = (text or b"").lower().split()
    cache = {} if cache is None else cache
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=7)] if words else [], np.uint64)
    for w in words:
        if w not in cache:
            cache[w] = xxhash.xxh64_intdigest(w, seed=7)
    hashes, n = np.array([cache[w] for w in words], np.uint64), len(words) - WIDTH + 1
    return np.unique(_mixed(sum(hashes[i : i + n] * _OF_WORD[i] for i in range(WIDTH))))


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for start in range(0, len(found), 1024):
        np.minimum(out, (found[start : start + 1024] * _TIMES + _PLUS).min(axis=1), out=out)
    return out


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), seed=42)


#: The node of texts without words, which is similar to no other.
NO_WORDS = signed(node_of(np.array([], np.uint64)))


def key_of(text: bytes | None) -> int:
    """The node of a text."""
    return node_of(shingle_set(text))


def _sets(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    cache: dict[bytes, int] = {}
    for batch in text_slices(batches, text):
        if len(cache) > 300_000:
            cache.clear()
        yield batch, [shingle_set(x, cache) for x in batch.column(text).cast(pa.binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches, 1):
        mins = [minima(x) for x in sets]
        buckets = [_mixed((x.reshape(BANDS, ROWS) * _OF_ROW).sum(axis=1, dtype=np.uint64) + _OF_BAND).view(np.int64) for x in mins]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([signed(node_of(x)) for x in sets], pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array([_mixed(x[:SKETCH]).astype(np.uint8).tobytes() for x in mins], pa.binary()), pa.array([signed(majority(x)) for x in sets], pa.int64())],
            names=["doc_id", "fp", "buckets", "sketch", "simhash"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, buckets, sketch, simhash) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketch, "doc_id long, fp long, buckets array<long>, sketch binary, simhash long")


# --- clusters


def forest(nodes: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join a bucket's likely pairs; a node that has been reached is not compared again."""
    left, queue = np.arange(len(nodes)), []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = (sketches[left] == sketches[at]).mean(axis=1) >= LIKELY
        for other in left[near]:
            yield int(nodes[at]), int(nodes[other])
        queue += left[near].tolist()
        left = left[~near]


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for members in batch.column(0).to_pylist():
            nodes = np.array([x["fp"] for x in members], np.int64)
            found.update(forest(nodes, np.frombuffer(b"".join(x["sketch"] for x in members), np.uint8).reshape(len(nodes), SKETCH)))
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def close_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes (fp, simhash) with SimHashes within ``simhash.RADIUS`` bits."""
    named = nodes.filter(F.col("fp") != NO_WORDS).select("fp", "simhash")
    first = settle(named.groupBy("simhash").agg(F.min("fp").alias("lo")))
    equal = named.join(first, "simhash").filter("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b"))
    of = lambda side: first.select(F.col("simhash").alias(side), F.col("lo").alias(f"{side}_node"))
    apart = links(first.select(F.col("simhash").alias("fp"))).join(of("a"), "a").join(of("b"), "b")
    return equal.unionAll(apart.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def likely_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of the nodes (fp, buckets, sketch) whose minima are much alike."""
    rows = nodes.select("fp", F.explode(F.array_distinct("buckets")).alias("bucket"))
    crowded = settle(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo")).filter("n > 1"))
    at = rows.join(crowded, "bucket")
    small = at.filter(F.col("n") <= BUCKET).select("fp", "bucket").join(nodes.select("fp", "sketch"), "fp")
    members = small.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("fp", "sketch"))).alias("members")).select("members").distinct()
    large = at.filter((F.col("n") > BUCKET) & (F.col("fp") != F.col("lo"))).select(F.col("fp").alias("a"), F.col("lo").alias("b"))
    return members.mapInArrow(_likely, "a long, b long").unionAll(large)


def clusters(nodes: DataFrame) -> DataFrame:
    """(fp, cluster) of the nodes (fp, buckets, sketch, simhash) that some node is close to or likely to be similar to."""
    return components(close_links(nodes).unionAll(likely_links(nodes))).withColumnsRenamed({"node": "fp", "root": "cluster"})


# --- exact links


def similar_links(nodes: list[int], sets: list[np.ndarray], queries: np.ndarray, roots: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the components of all similar pairs with a node of ``queries`` (positions) in them.

    ``roots`` are the components found before; a pair within one isn't compared.
    """
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mark = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    roots = np.unique(roots, return_inverse=True)[1]
    for at in queries.tolist():
        others = np.flatnonzero(roots != roots[at])
        if not len(others):
            return
        own = ids[starts[at] : starts[at] + sizes[at]]
        mark[own] = 1
        if 4 * len(others) > len(nodes):
            both = np.add.reduceat(mark[ids], starts)[others]
        else:
            both = np.array([mark[ids[starts[k] : starts[k] + sizes[k]]].sum() for k in others.tolist()])
        mark[own] = 0
        for other in others[both >= SIMILARITY * (sizes[at] + sizes[others] - both)].tolist():
            if roots[other] != roots[at]:
                yield nodes[at], nodes[other]
                roots[roots == roots[other]] = roots[at]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from (part, fp, root, query, shingles) with equal parts next to each other."""

    def out(rows: list[dict]) -> pa.RecordBatch:
        query = np.flatnonzero([x["query"] for x in rows])
        found = list(similar_links([x["fp"] for x in rows], [np.frombuffer(x["shingles"], np.uint64) for x in rows], query, np.array([x["root"] for x in rows]))) if len(rows) > 1 and len(query) else []
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows: dict[int, dict] = {}
    part = None
    for batch in text_slices(batches, 4):
        for x in batch.to_pylist():
            if x["part"] != part and rows:
                yield out(list(rows.values()))
                rows = {}
            part = x["part"]
            # a node may come as a query and as a target
            if x["fp"] in rows:
                x["query"] |= rows[x["fp"]]["query"]
            rows[x["fp"]] = x
    if rows:
        yield out(list(rows.values()))


def _part(*keys: Column) -> Column:
    """A block's name; a block with the name of another would only be compared along with it."""
    return F.xxhash64(*keys)


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) from rows (part, fp, root, query)."""
    dealt = rows.join(sets, "fp").select("part", "fp", "root", "query", "shingles").repartition("part").sortWithinPartitions("part", "fp")
    return settle(dealt.mapInArrow(_links, "a long, b long"))


def similar(at: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of all similar pairs within the clusters ``at`` (fp, cluster), with the shingles of ``sets``."""
    sized = settle(at.join(settle(at.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))), "cluster").withColumn("blocks", F.ceil(F.col("size") / BLOCK)))
    whole = F.col("size") <= BLOCK
    found = _compared(sized.filter(whole).select(_part("cluster").alias("part"), "fp", F.col("fp").alias("root"), F.lit(True).alias("query")), sets)
    large = sized.filter(~whole)
    if large.isEmpty():
        return found
    # the nodes of a large cluster are dealt out into blocks; what links there is one component from then on
    large = large.withColumn("root", F.col("fp"))
    for deal in range(DEALS):
        block = F.pmod(F.xxhash64("fp", F.lit(deal)), "blocks")
        found = found.unionAll(_compared(large.select(_part("cluster", F.lit(deal), block).alias("part"), "fp", "root", F.lit(True).alias("query")), sets))
        roots = settle(components(found)).withColumnsRenamed({"node": "fp", "root": "now"})
        large = settle(large.drop("root").join(roots, "fp", "left").withColumn("root", F.coalesce("now", "fp")).drop("now"))
    # nodes outside of a cluster's largest component are compared with all others, block by block
    parts = large.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    most = settle(parts.groupBy("cluster").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.max("n").alias("most")))
    large = large.join(most, "cluster").withColumn("others", F.col("size") - F.col("most")).filter("others > 0").withColumn("query_blocks", F.ceil(F.col("others") / BLOCK))
    large = settle(large.withColumns({"t": F.pmod(F.xxhash64("fp", F.lit("target")), "blocks"), "q": F.pmod(F.xxhash64("fp", F.lit("query")), "query_blocks"), "query": F.col("root") != F.col("main")}))
    targets = large.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1))).withColumn("query", F.lit(False))
    queries = large.filter("query").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pick = [_part("cluster", F.lit("rest"), "q", "t").alias("part"), "fp", "root", "query"]
    return found.unionAll(_compared(targets.select(*pick).unionAll(queries.select(*pick)), sets))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches, 0):
        yield pa.RecordBatch.from_arrays([pa.array([signed(node_of(x)) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "shingles"])


def shingles_of(docs: DataFrame, names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) of the nodes of ``wanted`` (fp); ``names`` (fp, rep) has a document of each, null for nodes without doc_id."""
    ids = settle(names.join(wanted, "fp", "left_semi").select("rep").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    chosen = texts.join(if_small(ids, ids.count()), "rep", "left_semi")
    if not ids.filter("rep is null").isEmpty():
        chosen = chosen.unionAll(texts.filter("rep is null"))
    found = chosen.select("text").mapInArrow(_shingled, "fp long, shingles binary").join(wanted, "fp", "left_semi")
    return store(found.groupBy("fp").agg(F.first("shingles").alias("shingles")), "shingles")


def near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root) of every row; root names the component by one of its nodes."""
    sketched = store(sketches(docs), "sketches")
    nodes = settle(sketched.groupBy("fp").agg(F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch"), F.first("simhash").alias("simhash"), F.min("doc_id").alias("rep")))
    at = settle(clusters(nodes))
    roots = settle(components(similar(at, shingles_of(docs, nodes.select("fp", "rep"), at.select("fp"))))).withColumnRenamed("node", "fp")
    return sketched.select("doc_id", "fp").join(roots, "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id long) of every row of ``docs``.

    Rows whose shingle sets are joined by steps of Jaccard similarity 0.8 or more
    form a component, named by its smallest ``doc_id`` (null only if no member
    has one). ``fp`` is equal for equal sets. Null, empty and blank texts have
    the empty set and are one component. An empty table gives an empty table.
    Other columns are not read.
    """
    rows = settle(near_rows(docs))
    named = settle(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(named, "root").select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id``; see ``simhash.keep_first``."""
    return keep_first(docs, near_rows(docs), key_of)
