"""URL filtering: listed rules first, then association rules mined by FP-growth.

Labelled URLs become transactions of tokens and their label. Frequent token sets
that imply the label ``bad`` with enough support, and clearly more often than the
labelled URLs at large, are the mined rules, less those that a more general rule
already covers. An inverted index from
a rule's rarest token finds the rules that can match a URL; the rest of the rule
is then compared.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import if_small, settle

#: (verdict, host and path): fixed values of the registered query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
BAD = "label=bad"
#: Share and number of the labelled URLs that must be bad and bear a mined rule out.
MIN_SUPPORT, MIN_COUNT = 0.001, 4
#: A rule's confidence is at least so many times the share of bad URLs, and the lower end of its interval (so many standard deviations) is above that share.
MIN_LIFT, SURE = 1.5, 1.645
#: A rule gives way to a longer one that has half its bad URLs and is so many times as confident.
SHARPER = 1.2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null: its host or a subdomain, and a path that starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda x: len(x[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: the host, each of its labels, and the words of the path that aren't numbers."""
    labels = F.transform(F.filter(F.split(host, r"[.:@-]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), labels, parts))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT) -> DataFrame:
    """(tokens, confidence, n) of the rules that imply ``bad``, from (tokens array, bad boolean); ``n`` counts bad rows.

    Rows with null tokens or label are left out. Tokens that stand in the same
    rows, as a host and its labels do, enter the search as one, so that the number
    of item sets doesn't double with each of them. A rule may have any number of
    tokens. A rule gives way to a clearly sharper longer one; otherwise the longer
    one is dropped, as it blocks nothing more. Without rows or bad rows there is no
    rule.
    """
    spark = labelled.sparkSession
    rows = settle(labelled.filter(F.col("tokens").isNotNull() & F.col("bad").isNotNull()).select("tokens", "bad"))
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(min_count, math.ceil(min_support * n))
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, n long")
    if n_bad < least or n_bad == n:
        return empty
    # a token of a rule must itself be frequent among the bad rows, so the others leave before the search
    frequent = settle(rows.filter("bad").select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") >= least).select("token"))
    numbered = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    kept = settle(numbered.select("row", "bad", F.explode("tokens").alias("token")).join(if_small(frequent, frequent.count()), "token"))
    same = kept.groupBy("token").agg(F.count(F.lit(1)).alias("in"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    leaders = settle(same.groupBy("in", "x", "y").agg(F.min("token").alias("token")).select("token"))
    items = kept.join(if_small(leaders, leaders.count()), "token").groupBy("row", "bad").agg(F.collect_set("token").alias("items"))
    items = settle(items.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    n_items = items.count()
    if not n_items:
        return empty
    base = n_bad / n
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_items), minConfidence=min(1.0, min_lift * base)).fit(items)
    found = model.associationRules.filter(F.element_at("consequent", 1) == BAD)
    found = found.select(F.sort_array("antecedent").alias("tokens"), "confidence", F.round(F.col("support") * n_items).cast("long").alias("n"))
    p, m, z = F.col("confidence"), F.col("n") / F.col("confidence"), SURE
    lower = (p + z * z / (2 * m) - z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m)) / (1 + z * z / m)
    found = settle(found.filter((F.col("n") >= least) & (lower > base)))
    short = found.select(F.element_at("tokens", 1).alias("first"), F.col("tokens").alias("part"), F.col("confidence").alias("c"), F.col("n").alias("m"))
    pairs = short.join(found.select(F.explode("tokens").alias("first"), "tokens", "confidence", "n"), "first")
    pairs = settle(pairs.filter((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)))
    loose = settle(pairs.filter((F.col("confidence") >= SHARPER * F.col("c")) & (2 * F.col("n") >= F.col("m"))).select("part").distinct())
    covered = pairs.join(loose, "part", "left_anti").select("tokens").distinct()
    return found.join(loose.withColumnRenamed("part", "tokens"), "tokens", "left_anti").join(covered, "tokens", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``token_key`` of the rows of ``urls`` (token_key, tokens) in which all tokens of some rule stand."""
    freq = settle(rules.select(F.explode("tokens").alias("token")).groupBy("token").count())
    ids = rules.select("tokens", F.explode("tokens").alias("token")).join(freq, "token").groupBy("tokens").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    index = settle(ids.withColumnRenamed("tokens", "need"))
    n = index.count()
    hits = urls.select("token_key", "tokens", F.explode("tokens").alias("token")).join(if_small(index, n), "token").filter(F.size(F.array_except("need", "tokens")) == 0)
    return hits.select("token_key").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """``page_id``, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    ``labels`` has (url, bad). The verdict is that of the longest listed rule
    that fits, else ``block`` if a mined rule matches, else ``allow``.

    A null url, or one without ``://``, has empty host and path and is judged by
    them. Repeated rows are judged each; labels that disagree all count. Empty
    tables give no rules or no rows. Other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = settle(base.withColumn("tokens", tokens_of(F.col("host"), F.col("path"))).withColumn("token_key", F.xxhash64("host", "path")))
    found = settle(mine(labels.select(tokens_of(host, path).alias("tokens"), "bad"), **mining))
    # settled, so that both sides of the join are plain shuffles and Spark can split a hot host and path
    hits = settle(matched(keyed, found).withColumn("mined", F.lit(True)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = keyed.drop("tokens").join(if_small(hits, hits.count()), "token_key", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"))


def document_number(url: Column) -> Column:
    """The number in a page's path, which is the doc_id of the document it shows; null without one."""
    digits = F.regexp_extract(path_of(url), r"/(\d{1,18})(?:[/.]|$)", 1)
    return F.when(digits != "", digits.cast("long"))
