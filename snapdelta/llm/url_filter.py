"""Operator 10, URL filters: association rules mined by FP-growth, matched by an inverted index.

A URL becomes a set of tokens: scheme, whole host, its domain, subdomains and last label, path segments (numbers as
one token), file extension, query keys and pairs, fragment. The last number in its path is the id of the document it
served, which links it to labels; a URL is bad if any label found for it has quality 0 or toxic 1. FP-growth mines the
bad URLs for the sets of tokens that at least MIN_PAGES of them have, however many URLs there are; their confidence is
taken from counts over all labelled URLs. The rules kept are those that conclude bad with at least MIN_CONFIDENCE, at
most MAX_TOKENS tokens, and no other kept rule over a part of their tokens that is as confident. Tokens that only bad
URLs have, or all URLs, are rules by themselves or none; a longer set with one of them adds nothing and is not mined.
Tokens that the same labelled URLs have can't be told apart, so that in longer sets the first by name stands for them.
Of rules of equal confidence that apply to a URL the last by name is reported.

Rules are matched by an index from token to rules: a rule applies to a URL that has as many of its tokens as it has.

Defined results: pages without a URL have no rules and aren't blocked; a null page_id keeps its row; repeated rows are
reported each, and repeated URLs count once in mining; URLs without a number, or without labels, don't train; null
labels are not bad; without labelled URLs there are no rules; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CONFIDENCE = 0.6
MIN_PAGES = 10
MAX_TOKENS = 3


def _tokens(url: Column) -> Column:
    url = F.lower(F.trim(url))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    path = F.regexp_extract(url, r"^(?:(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"#(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")

    def one(prefix: str, value: Column) -> Column:
        return F.when(value != "", F.array(F.concat(F.lit(prefix + "="), value))).otherwise(F.array().cast("array<string>"))

    n = F.size(labels)
    all_ = F.concat(
        one("scheme", F.regexp_extract(url, r"^([a-z][a-z0-9+.\-]*):", 1)),
        one("host", host),
        F.when(n > 1, F.array(F.concat(F.lit("top="), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>")),
        F.when(n > 3, F.transform(F.slice(labels, 1, F.greatest(n - 3, F.lit(0))), lambda x: F.concat(F.lit("sub="), x))).otherwise(F.array().cast("array<string>")),
        F.when(n > 2, F.array(F.concat(F.lit("domain="), F.array_join(F.slice(labels, -3, 3), ".")))).otherwise(F.array().cast("array<string>")),
        F.transform(segments, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"^\d+(\.[a-z]+)?$", "#"))),
        one("ext", F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1)),
        F.transform(pairs, lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1))),
        F.transform(pairs, lambda x: F.concat(F.lit("pair="), x)),
        one("fragment", fragment),
    )
    return F.array_distinct(F.coalesce(all_, F.array().cast("array<string>")))


def document_id(url: Column) -> Column:
    """The last path segment that is a number, with or without an extension."""
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return F.nullif(F.regexp_extract(path, r"^.*/(\d{1,18})(?:\.[A-Za-z]+)?(?:/[^\d/][^/]*)*/?$", 1), F.lit("")).cast("bigint")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the distinct URLs with labels."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc__")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    urls = pages.select("url").where("url is not null").distinct().withColumn("doc__", document_id(F.col("url")))
    return urls.join(said, "doc__").select("url", "bad")


def matches(rules: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """(key, rule) of the rules (rule, antecedent, ...) all of whose tokens are in a set (key, tokens)."""
    index = rules.select("rule", F.size("antecedent").alias("needs__"), F.explode("antecedent").alias("token__"))
    held = sets.select(key, F.explode("tokens").alias("token__"))
    return held.join(index, "token__").groupBy(key, "rule", "needs__").count().where(F.col("count") == F.col("needs__")).select(key, "rule")


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(rule, antecedent, confidence, pages) of the kept rules; rule is the tokens joined."""
    spark = labelled.sparkSession
    shape = "rule string, antecedent array<string>, confidence double, pages bigint"
    baskets = common.checkpoint(labelled.select(F.monotonically_increasing_id().alias("id__"), _tokens(F.col("url")).alias("tokens"), "bad"))
    total = baskets.count()
    counts = baskets.select("bad", F.explode("tokens").alias("token__")).groupBy("token__").agg(F.count(F.lit(1)).alias("all__"), F.count_if("bad").alias("pages"))
    counts = common.checkpoint(counts.where(F.col("pages") >= min_pages))
    if counts.isEmpty():
        return spark.createDataFrame([], shape)
    alone = counts.select(F.array("token__").alias("antecedent"), "all__", "pages")
    joining = counts.where((F.col("all__") > F.col("pages")) & (F.col("all__") < total))
    held = common.checkpoint(baskets.select("id__", "bad", F.explode("tokens").alias("token__")).join(joining.select("token__", "all__"), "token__"))
    # one token of each set of URLs
    places = held.groupBy("token__").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id__")).alias("x"), F.bit_xor(F.xxhash64("id__", F.lit("b"))).alias("y"))
    held = common.checkpoint(held.join(places.groupBy("n", "x", "y").agg(F.min("token__").alias("token__")).select("token__"), "token__", "left_semi"))
    sets = held.groupBy("id__", "bad").agg(F.collect_list("token__").alias("items"))
    bad = common.checkpoint(sets.where("bad").select("items"))
    if n := bad.count():
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_pages - 0.5) / n)).fit(bad)
        longer = model.freqItemsets.where((F.col("freq") >= min_pages) & F.size("items").between(2, max_tokens)).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("pages"))
        longer = common.checkpoint(longer.withColumn("rule", F.array_join("antecedent", " ")))
        # every set is looked up under its rarest token
        rarest = longer.select("rule", "antecedent", F.explode("antecedent").alias("token__")).join(joining, "token__").groupBy("rule").agg(F.min_by("token__", F.struct("all__", "token__")).alias("token__"), F.any_value("antecedent").alias("antecedent"))
        good = held.where("not bad").select("id__", "token__").join(sets.where("not bad").select("id__", "items"), "id__")
        others = rarest.join(good, "token__").where(F.size(F.array_except("antecedent", "items")) == 0).groupBy("rule").agg(F.count(F.lit(1)).alias("others"))
        alone = alone.union(longer.join(others, "rule", "left").select("antecedent", F.col("pages") + F.coalesce("others", F.lit(0)), "pages"))
    found = alone.withColumn("confidence", F.col("pages") / F.col("all__")).where(F.col("confidence") >= min_confidence)
    rules = common.checkpoint(found.select("antecedent", "confidence", "pages").withColumn("rule", F.array_join("antecedent", " ")))
    parts = matches(rules, rules.select(F.col("rule").alias("whole"), F.col("antecedent").alias("tokens")), "whole").where("rule <> whole")
    confident = rules.select("rule", F.col("confidence").alias("c__"))
    redundant = parts.join(confident, "rule").join(rules.selectExpr("rule whole", "confidence"), "whole").where("c__ >= confidence").select(F.col("whole").alias("rule")).distinct()
    return rules.join(redundant, "rule", "left_anti").select("rule", "antecedent", "confidence", "pages")


def url_filter(pages: DataFrame, labels: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per page: page_id, url, rules (how many apply), confidence and rule of the most confident, blocked."""
    rules = common.checkpoint(mine(labelled_urls(pages, labels), min_confidence, min_pages, max_tokens))
    sets = pages.select("url").where("url is not null").distinct().withColumn("tokens", _tokens(F.col("url")))
    best = matches(rules, sets, "url").join(rules.select("rule", "confidence"), "rule").groupBy("url").agg(F.count(F.lit(1)).alias("rules"), F.max(F.struct("confidence", F.col("rule"))).alias("best"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").join(best, "url", "left")
    return rows.select("page_id", "url", F.coalesce("rules", F.lit(0)).alias("rules"), F.col("best.confidence").alias("confidence"), F.col("best.rule").alias("rule"), F.col("rules").isNotNull().alias("blocked"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(common.read(spark, sf_dir, "pages").select("page_id", "url"), common.read(spark, sf_dir, "labels"))
