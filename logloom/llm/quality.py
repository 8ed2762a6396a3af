"""Host-level quality rules, in DataFrame operations only.

Each document is held against base rules (which reject it by themselves) and
strict rules. Failures of the base rules are summed by host; each host's failure
rate is shrunk by a beta prior whose moments come from all hosts; the verdict on
the host goes back to its documents. A host is rejected if its shrunk rate stands
out from the prior; there documents must also pass the strict rules, elsewhere the
base rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import WHITE_RE, free_name, if_small, settle, store, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate is above the prior's mean by more than this many of the prior's standard deviations.
HOST_SPREADS = 0.5
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of STATS (long); null text counts as empty.

    A document's windows are compared by 64-bit hashes within its own row: they
    are sorted with their positions, equal neighbours mark repeats, and the gaps
    between marked positions give the words covered. No row leaves its task.
    """
    names = docs.columns
    taken = list(names)
    t, w, h, s, p, lines = (free_name(taken, f"_{x}") for x in "twhspl")
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(w, words(F.col(t)))
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(h, windows)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn(s, F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    out = out.withColumn(p, F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    out = out.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, WHITE_RE + "+", "") != ""))
    return out.select(
        *names,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def strict_failed() -> Column:
    """Symbols above a tenth of the words, repeated lines above a tenth of the words, or mean word length outside 2 to 15."""
    n = F.col("n_words")
    return (10 * F.col("n_symbols") > n) | (10 * F.col("n_dup_lines") > n) | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)


def host_verdicts(stats: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_rejected) from (host, base_failed); null is a host.

    The prior beta(a, b) has the mean of all documents and the spread of the
    hosts' rates (method of moments, strength kept within 1 and 1e6).
    """
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.var_pop(share).alias("spread"))
    strength = F.when(F.col("spread") > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1))).otherwise(F.lit(1e6))
    rate = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    both = hosts.join(F.broadcast(prior.select("mean", strength.alias("strength"))))  # one row
    most = F.col("mean") + HOST_SPREADS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    return both.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > most).alias("host_rejected"))


def _judged(rows: DataFrame, host: str, verdicts: DataFrame, n_hosts: int) -> DataFrame:
    """``rows`` with base_failed and kept."""
    at, bad = free_name(rows.columns, "_host"), free_name(rows.columns, "_rejected")
    side = verdicts.select(F.col("host").alias(at), F.col("host_rejected").alias(bad))
    joined = rows.withColumn("base_failed", base_failed()).join(if_small(side, n_hosts), F.col(host).eqNullSafe(F.col(at)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col(bad) & strict_failed())).drop(at, bad)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, STATS, base_failed, kept) of every row.

    Null and empty texts have no words and fail. A null host is a host of its
    own. Repeated rows count each. One very long text is handled in its row. An
    empty table gives an empty table. Other columns are not read.
    """
    stats = settle(text_stats(docs.select("doc_id", F.col(host).alias("host"), "text")).drop("text"))
    verdicts = settle(host_verdicts(stats.select("host", base_failed().alias("base_failed"))))
    return _judged(stats, "host", verdicts, verdicts.count()).select("doc_id", *STATS, "base_failed", "kept")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; columns unchanged, texts not shuffled.

    Columns that are named like the statistics pass through untouched. Rows and
    statistics are written once in the shared folder: a filter on statistics that
    aren't would be pushed into their computation and repeat it for every word.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(host).alias("host"), F.col("text").alias("text"))
    stats = store(text_stats(packed).drop("text"), "quality")
    verdicts = settle(host_verdicts(stats.select("host", base_failed().alias("base_failed"))))
    return _judged(stats, "host", verdicts, verdicts.count()).filter("kept").select("_row.*")
