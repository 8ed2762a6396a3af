"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is the multiset of its words. For every word and sample, r and c are
drawn from gamma(2, 1) and beta from the unit interval, all from hashes of the
word, so they are the same in every document. A word of weight S gives
t = floor(ln S / r + beta) and ln a = ln c - r (t - beta) - r; the sample is
(word, t) of the least a. Two documents agree in a sample with the probability
of their generalised Jaccard similarity.

Each (rounded ln a, hash of word and t) is packed into a long, so that a sample
is a minimum of longs, which aggregates combine within a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import settle, words

SAMPLES = 32
#: Rows of a range of doc_id, which is a window of its own, and of a task; and how many ranges there may be.
RANGE_ROWS, TASK_ROWS, MOST_RANGES = 512, 2048, 65_536


def _unit(bits: Column, width: int) -> Column:
    return (bits + 0.5) * F.lit(2.0**-width)


def _part(value: Column, shift: int, width: int) -> Column:
    """``width`` bits of a long from bit ``shift`` up."""
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 - shift else F.shiftrightunsigned(value, shift)


def sample(word: Column, log_weight: Column, k: int) -> Column:
    """Packed sample ``k`` of a word (a hash): 32 bits of ln a, then 31 bits of a hash of (word, t)."""
    one, two = F.xxhash64(word, F.lit(2 * k)), F.xxhash64(word, F.lit(2 * k + 1))
    r = -F.log(_unit(_part(one, 0, 32), 32) * _unit(_part(one, 32, 32), 32))
    log_c = F.log(-F.log(_unit(_part(two, 0, 24), 24) * _unit(_part(two, 24, 24), 24)))
    beta = _unit(_part(two, 48, 16), 16)
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t - beta) - r
    return F.shiftleft(((log_a + 128.0) * F.lit(float(1 << 24))).cast("long"), 31).bitwiseOR(F.xxhash64(one, t).bitwiseAND(F.lit(0x7FFFFFFF)))


def _in_order(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``part`` (range of doc_id), ``rank`` in it, ``following`` part (cyclic) and ``next`` text.

    Order: doc_id, nulls first, then the text's hash. Range bounds are quantiles,
    so parts are even; texts are shuffled once. The last row of a part takes the
    first row of the following part, of which there is one a part.
    """
    n = docs.count()
    parts, tasks = max(1, min(MOST_RANGES, n // RANGE_ROWS)), max(1, min(MOST_RANGES, n // TASK_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(cuts)).bit_length()))])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    rows = docs.select(part.alias("part"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartition(tasks, "part")  # every later step keeps to this partitioning
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
    ring = Window.orderBy("part")  # one row a part, MOST_RANGES at most
    heads = settle(heads.withColumn("before", F.coalesce(F.lag("part").over(ring), F.max("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))))
    first = rows.join(F.broadcast(heads.select(F.col("part").alias("p"), "head", "before")), (F.col("part") == F.col("p")) & F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.tie") == F.col("tie")))
    first = first.dropDuplicates(["part"]).select(F.col("before").alias("after_part"), F.col("part").alias("following"), F.col("text").alias("head_text"))
    along = Window.partitionBy("part").orderBy("doc_id", "tie")
    ranked = dealt.withColumn("rank", F.row_number().over(along)).withColumn("lead", F.lead("text").over(along)).drop("tie")
    full = ranked.join(first, (F.col("part") == F.col("after_part")) & F.col("lead").isNull(), "left")
    return full.select("part", "rank", "following", "doc_id", "text", F.coalesce("lead", "head_text").alias("next"))


def _likeness(a: list[Column], b: list[Column]) -> Column:
    return sum((F.when(x == y, 1.0).otherwise(0.0) for x, y in zip(a, b)), F.lit(0.0)) / len(a)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document's; next goes by
    ascending doc_id, and from the last to the first. A likeness is the share of
    samples in which two fingerprints agree. A fingerprint is 8 hex digits a
    sample.

    Null text counts as empty. Texts without words have a fingerprint of zeros,
    alike to each other only. Rows without doc_id come first, ordered by a hash of
    their text; repeated rows follow each other. A table of one row is its own
    next. Equal texts have equal fingerprints. An empty table gives an empty
    table. Other columns are not read.
    """
    full = _in_order(docs.select("doc_id", "text"))
    half = F.floor(F.length("text") / 2).cast("int")
    full = full.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next", half)))
    # what a row is known by goes along as fixed-width keys, so that texts are shuffled once and results never joined
    digest = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    keys = ["part", "rank", "following", "doc_id", "n_chars", "sha0", "sha1", "sha2", "sha3"]
    full = full.select("part", "rank", "following", "doc_id", F.length("text").cast("long").alias("n_chars"), *quarters, "text", "edited")
    both = full.select(*keys, F.explode(F.array(F.struct(F.col("text").alias("x"), F.lit(1).alias("own")), F.struct(F.col("edited").alias("x"), F.lit(0).alias("own")))).alias("v"))
    terms = both.select(*keys, F.col("v.own").alias("own"), F.explode_outer(words(F.col("v.x"))).alias("w")).select(*keys, "own", F.when(F.col("w").isNotNull(), F.xxhash64("w")).alias("w"))
    weights = terms.groupBy(*keys, "w").agg(F.sum("own").alias("n"), F.count(F.lit(1)).alias("both"))
    weights = weights.select(*keys, "w", F.log(F.nullif("n", F.lit(0)).cast("double")).alias("own"), F.log(F.nullif(F.col("both") - F.col("n"), F.lit(0)).cast("double")).alias("edited"))
    least = [F.min(sample(F.col("w"), F.col(x), k)).alias(f"{x}{k}") for k in range(samples) for x in ("own", "edited")]
    low = lambda x: F.array(*[F.coalesce(F.col(f"{x}{k}").bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(0)).cast("int") for k in range(samples)]).alias(x)
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"sha{k}"), 16, "0") for k in range(4)])).alias("edited_sha256")
    found = settle(weights.groupBy(*keys).agg(*least).select("part", "rank", "following", "doc_id", "n_chars", sha, low("own"), low("edited")))
    heads = found.filter("rank = 1").select(F.col("part").alias("p"), F.col("own").alias("head"))
    lead = found.withColumn("lead", F.lead("own").over(Window.partitionBy("part").orderBy("rank")))
    out = lead.join(heads, F.col("following") == F.col("p"), "left").withColumn("next", F.coalesce("lead", "head"))
    at = lambda x: [F.get(x, k) for k in range(samples)]
    text = lambda x: F.lower(F.concat(*[F.lpad(F.hex(v), 8, "0") for v in at(x)]))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"),
        _likeness(at("own"), at("edited")).alias("near_edited"), _likeness(at("own"), at("next")).alias("near_next"),
    )
