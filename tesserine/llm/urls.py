"""URL filters: a list of rules, and association rules that FP-growth mines from labelled urls.

A listed rule fits its host and all subdomains of it where the url's path
begins with the rule's; the longest wins.  Elsewhere the mined rules decide: a
transaction is the set of a labelled url's tokens (parts of host and path, and
which parts there are) with its label; rules that conclude `block` are pruned
by support and confidence, indexed by the rarest token of their condition, and
fire on a url that holds all tokens of it.  Everything is DataFrame operations.

Defined results: a null url, or one without ://, has an empty host and path, no
rule, and is allowed; empty tables give empty ones; repeated rows are judged
each for itself; no labelled urls, or none labelled bad, mine no rules.
An unlabelled row (null `bad`) is no transaction; a url of any length is read
whole; of rules that fire together the surest gives the confidence, and equal
ones give the same; rows of equal urls are judged alike.  Only the named columns
are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (host, path, verdict): fixed values.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
BAD = "label:block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """Name of the longest fitting rule; null if none fits. A name is the host and the path together."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p)).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; numbers count as one token."""
    host, path = host_of(url), path_of(url)
    number = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    named = lambda name, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(name), number(x)))
    return F.array_distinct(F.concat(
        named("host:", F.split(host, "[.-]")),
        named("path:", F.split(path, "[/._-]")),
        named("has:", F.array(F.when(F.contains(url, F.lit("?")), F.lit("query")).otherwise(F.lit("")), F.when(F.contains(url, F.lit("#")), F.lit("fragment")).otherwise(F.lit("")))),
    ))


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.7, least: int = 5) -> DataFrame:
    """labelled: url, bad (boolean). Rules: condition (tokens), rare (its rarest token in the transactions), confidence, support. At most a number set by the support, whatever the input.

    least: a condition and label must also meet in so many urls.
    """
    spark = labelled.sparkSession
    baskets = labelled.filter("url is not null and bad is not null").select(F.when(F.col("bad"), F.array_append(tokens(F.col("url")), F.lit(BAD))).otherwise(tokens(F.col("url"))).alias("items"), "bad")
    n, bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return spark.createDataFrame([], "condition array<string>, rare string, confidence double, support double")
    support = max(support, least / n)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets.select("items"))
    found = model.associationRules.filter(F.get("consequent", F.lit(0)) == BAD).select(F.array_sort("antecedent").alias("condition"), "confidence", "support")
    # a longer condition that is no surer than a part of it adds nothing
    longer, part = found.alias("longer"), found.alias("part")
    test = (F.size("part.condition") < F.size("longer.condition")) & (F.size(F.array_except("part.condition", "longer.condition")) == 0) & (F.col("part.confidence") >= F.col("longer.confidence"))
    token = F.explode("condition").alias("token")
    pairs = longer.select("condition", "confidence", token).alias("longer").join(part.select(F.col("condition"), F.col("confidence"), F.get("condition", F.lit(0)).alias("token")).alias("part"), F.col("longer.token") == F.col("part.token"))
    worse = pairs.filter(test).select(F.col("longer.condition").alias("condition")).distinct()
    kept = found.join(worse, "condition", "left_anti")
    often = model.freqItemsets.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq")
    rare = kept.select("condition", token).join(often, "token").groupBy("condition").agg(F.min_by("token", F.struct("freq", "token")).alias("rare"))
    return kept.join(rare, "condition").select("condition", "rare", "confidence", "support")


#: Rules up to which the index goes to every task.
BROADCAST = 20_000


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Of the distinct urls, those on which a rule fires, with the surest rule's confidence. The index: rarest token -> rules that need it."""
    index = written(rules.select(F.col("rare").alias("token"), "condition", "confidence"), "rules")
    if index.count() <= BROADCAST:  # checked; more of them meet the urls by a join on the token
        index = F.broadcast(index)
    own = urls.select("url").distinct().select("url", tokens(F.col("url")).alias("own"))
    met = own.select("url", "own", F.explode("own").alias("token")).join(index, "token")
    whole = met.filter(F.size(F.array_except("condition", "own")) == 0)
    return whole.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, **mining) -> DataFrame:
    """The key with host, path, rule, verdict and confidence (of the mined rule that blocked)."""
    at = pages.select(F.col(key), F.col(url).alias("url"))
    at = at.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("rule", listed(F.col("host"), F.col("path"), rules))
    hits = fired(at.filter("rule is null and url is not null"), mine(labelled, **mining))
    verdicts = F.create_map(*(F.lit(x) for h, p, v in rules for x in (h + p, v)))
    verdict = F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")]).when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return at.join(hits, "url", "left").select(key, "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))
