"""URL filters: explicit host and path rules, and association rules mined by FP-growth from labelled URLs."""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgauge.llm.common import materialize

#: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.6, 1.2
#: Labelled urls that a rule must rest on at least.
MIN_ROWS = 10
#: Mined rules up to which all tasks hold the index.
MOST_RULES = 20_000
_BAD = "label=bad"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a url or ://."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host + path) and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct words of host, path and query; host words are marked, numbers left out."""
    words = lambda x: F.filter(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.rlike("^[0-9]+$"))
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*(.*)$", 1)
    return F.array_distinct(F.concat(F.transform(words(host_of(url)), lambda w: F.concat(F.lit("host:"), w)), words(rest)))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules tokens -> bad from labelled(url, bad). Returns tokens, anchor, confidence, support, lift.

    Rules stay if their confidence and lift reach the bounds, MIN_ROWS labelled urls bear them out, and no shorter rule with as much confidence is part of
    them. Labels that are null and urls without tokens teach nothing; without labels there are no rules.
    """
    spark = labelled.sparkSession
    basket = labelled.filter("bad is not null").select(F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    basket = basket.filter(F.size("items") > 0)
    none = spark.createDataFrame([], "tokens array<string>, anchor string, confidence double, support double, lift double")
    n = basket.count()
    if n < MIN_ROWS:
        return none
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, MIN_ROWS / n)), minConfidence=min_confidence, numPartitions=spark.sparkContext.defaultParallelism).fit(basket)
    found = model.associationRules.filter((F.col("consequent")[0] == _BAD) & (F.col("lift") >= MIN_LIFT))
    found = materialize(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift"))
    # a longer rule that is no surer than a shorter one inside it decides nothing
    short = found.select(F.col("tokens").alias("less"), F.col("confidence").alias("sure"), F.explode("tokens").alias("token"))
    long = found.select("tokens", "confidence", F.explode("tokens").alias("token"))
    idle = long.join(short.hint("shuffle_hash"), "token").filter((F.size("less") < F.size("tokens")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "tokens")) == 0))
    kept = found.join(idle.select("tokens").distinct().hint("shuffle_hash"), "tokens", "left_anti")
    longest = F.array_sort(F.transform("tokens", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))[0]["t"]
    return kept.withColumn("anchor", longest)


def confidence_of(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows(url, ...) with confidence, that of the surest rule whose tokens all stand in the url, else null.

    The inverted index from a rule's anchor token to the rules is one map that every task holds, up to MOST_RULES
    counted rules: each row is matched where it is, so that a common or null url is no hot key. More rules are joined
    by anchor to the distinct urls.
    """
    rules = materialize(rules)
    if rules.count() <= MOST_RULES:
        posting = F.struct(F.col("tokens").alias("need"), "confidence")
        index = rules.groupBy("anchor").agg(F.sort_array(F.collect_list(posting)).alias("rules")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("anchor", "rules")))).alias("_index"))
        own = tokens_of(F.col("url"))
        found = F.flatten(F.transform("_own", lambda t: F.coalesce(F.element_at("_index", t), F.array().cast("array<struct<need:array<string>,confidence:double>>"))))
        held = F.filter(found, lambda r: F.size(F.array_except(r["need"], F.col("_own"))) == 0)
        return rows.withColumn("_own", own).join(F.broadcast(index)).withColumn("confidence", F.array_max(F.transform(held, lambda r: r["confidence"]))).drop("_own", "_index")
    own = rows.select("url").filter("url is not null").distinct().withColumn("own", tokens_of(F.col("url")))
    posted = own.withColumn("anchor", F.explode("own"))
    met = posted.join(rules.hint("shuffle_hash"), "anchor").filter(F.size(F.array_except("tokens", "own")) == 0)
    return rows.join(met.groupBy("url").agg(F.max("confidence").alias("confidence")).hint("shuffle_hash"), "url", "left")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad of pages(page_id, url) that labels speak of: a page takes the label of the document with its id, bad if any of its rows has quality 0 or toxic 1."""
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("page_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return pages.join(marks.hint("shuffle_hash"), "page_id").select("url", "bad")


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Verdict on every page's url, with rules mined from labelled(url, bad), any labelled urls.

    Returns page_id, host, path, rule, verdict, confidence (of the surest mined rule, else null): the longest explicit
    rule that fits decides; else a mined rule blocks; else the url is allowed. One row per input row. A null url, or
    one without ://, has empty host and path and is allowed; repeated rows and null ids stay; empty tables give an
    empty result or no mined rules.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    judged = confidence_of(rows, mine_rules(labelled))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = explicit_rule(host, path, rules)
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", host.alias("host"), path.alias("path"), name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "confidence")
