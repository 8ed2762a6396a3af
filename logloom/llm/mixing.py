"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u)/quality with u from a hash of its
id, so reruns agree. A source whose target exceeds its size first gives whole
epochs; what is left of its target is filled in key order up to a word budget.

The prefix sums are hierarchical: words are summed by (source, slice of the key
range); only the one slice where a source's budget runs out is sorted row by
row. No source is gathered in one task, and the outcome is a cut-off key for
each source, by which rows are chosen without moving them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import free_name, if_small, settle, word_count

#: Slices of the key range; a source's boundary slice holds about 1/SLICES of its rows.
SLICES = 4096
#: A target is at most this many times its source's size.
MOST = 3
#: Characters that speak against prose in the default quality weight (fixed values).
NOISE = "#*$%&|<>{}[]=_^~0123456789"


def default_quality(text: Column) -> Column:
    """Weight in [0.1, 1]: one less the share of noise characters (null and empty: 0.1)."""
    n = F.length(text)
    share = F.length(F.translate(text, NOISE, "")) / n
    return F.when(n > 0, F.greatest(F.lit(0.1), share)).otherwise(F.lit(0.1))


def _uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the id, or from the text where there is no id."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum
    of all sizes. A target stops at MOST times its source's size; the excess goes
    to the others by weight until none is above. That is the level at which
    sum(least(cap, level * weight)) meets the total, found by running sums over
    sources ordered by cap / weight. Only the table of sources meets in one task.
    """
    ranked = sizes.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).withColumn("cap", MOST * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    final = F.max("level").over(everything)  # the level rises while caps free words, and falls beyond the last cap
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), final * F.col("w")).alias("target"))


def _keyed(docs: DataFrame, weight: Column) -> DataFrame:
    """(doc_id, source, size, key, tie) of every row."""
    key = -F.log(_uniform(F.col("doc_id"), F.col("text"))) / weight
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("tie"))


def _slice(key: Column) -> Column:
    return F.floor((1 - F.exp(-key)) * SLICES).cast("int")


def _attach(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (alias r) with the columns of ``sources`` (alias s) of the same source; null is a source."""
    return rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")), how)


def cutoffs(keyed: DataFrame) -> tuple[DataFrame, int]:
    """(source, source_size, target, epochs, last_slice, last_key, last_tie), one row a source; their number.

    A document is in the fractional part if its slice is below ``last_slice``, or
    equal and its (key, tie) at most (``last_key``, ``last_tie``). The document at
    which the budget runs out is taken if that comes nearer to the budget.
    """
    goal = targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    goal = settle(goal)
    n_sources = goal.count()
    running = F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
    slices = keyed.groupBy("source", _slice(F.col("key")).alias("slice")).agg(F.sum("size").alias("words")).withColumn("upto", running)
    edge = _attach(slices, if_small(goal, n_sources)).filter("upto > rest and upto - words <= rest")
    edge = settle(edge.select("r.source", "slice", F.expr("upto - words").alias("base"), "rest"))
    rows = _attach(keyed, if_small(edge, n_sources)).filter(_slice(F.col("key")) == F.col("slice")).select("r.source", "size", "key", "tie", "base", "rest")
    reach = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "tie"))
    near = (F.col("reach") <= F.col("rest")) | (F.col("reach") - F.col("rest") < F.col("rest") - (F.col("reach") - F.col("size")))
    last = rows.withColumn("reach", reach).filter(near).groupBy("source").agg(F.max(F.struct("key", "tie")).alias("last"))
    cut = _attach(edge, last, "left").select("r.source", F.col("slice").alias("last_slice"), F.col("last.key").alias("last_key"), F.col("last.tie").alias("last_tie"))
    whole = _attach(goal, cut, "left").select("r.source", "source_size", "target", "epochs", "last_slice", "last_key", "last_tie")
    return settle(whole), n_sources


def _copies(key: str, tie: str, cut: str = "") -> Column:
    """How often a row is taken, given its source's cut-off (columns with the prefix ``cut``)."""
    at, last_slice, last_key, last_tie = _slice(F.col(key)), *(F.col(f"{cut}{x}") for x in ("last_slice", "last_key", "last_tie"))
    within = (at == last_slice) & ((F.col(key) < last_key) | ((F.col(key) == last_key) & (F.col(tie) <= last_tie)))
    return F.col(f"{cut}epochs") + F.when((at < last_slice) | F.coalesce(within, F.lit(False)), 1).otherwise(0)


def mix_plan(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    ``taken`` is the words the mix takes of the row, repeats counted: its size
    times the epochs it is in. ``quality`` is a positive weight; by default
    ``default_quality`` of the text.

    Null and empty texts have size 0 and take 0. Null is a source, the last one.
    Rows with equal ``doc_id`` share their random number; ties are broken by the
    text's digest, and identical rows are taken or left together. A source of
    size 0 has target 0. An empty table gives an empty table. Other columns are
    not read.
    """
    keyed = settle(_keyed(docs, default_quality(F.col("text")) if quality is None else quality))
    cuts, n = cutoffs(keyed)
    return _attach(keyed, if_small(cuts, n)).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies("key", "tie")).cast("long").alias("taken"))


def mix(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken; see ``mix_plan``.

    Columns are unchanged and texts aren't shuffled: each row is held against its
    source's cut-off. Rows of size 0 in a source are taken like the others.
    """
    weight = default_quality(F.col("text")) if quality is None else quality
    cuts, n = cutoffs(settle(_keyed(docs, weight)))
    names = docs.columns
    key, tie, many, src = (free_name(names, x) for x in ("key", "tie", "copies", "source_of"))
    rows = docs.select(*docs.columns, (-F.log(_uniform(F.col("doc_id"), F.col("text"))) / weight).alias(key), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias(tie))
    cuts = cuts.select(F.col("source").alias(src), F.struct("epochs", "last_slice", "last_key", "last_tie").alias(many))
    joined = rows.join(if_small(cuts, n), rows["source"].eqNullSafe(cuts[src]))
    repeated = joined.withColumn(many, _copies(key, tie, f"{many}.")).filter(F.col(many) > 0)
    return repeated.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(many)))).select(names)
