"""URL filter by association rules that Spark's FP-growth mines from labels.

Curated rules (host and path prefix) judge the URLs that they fit; the longest
wins. Those URLs are also the labelled examples: each gives its tokens (host
labels, path parts, query keys, with digits folded) and its label to FP-growth.
Rules "tokens -> label" with enough support and confidence, of which no part is
already as sure, judge every other URL: an inverted index holds each rule under
its rarest token, URLs are joined to it by their tokens, and a rule applies if
all its tokens are there. The surest rule decides, then the longest, the better
supported and the first by text; without any, the URL is allowed.

Everything is DataFrame or SQL functions and Spark ML's FP-growth. Only distinct
URLs are mined and joined, so a URL that fills a third of the rows counts once.

FP-growth mines from all labelled URLs and their frequent tokens; tokens that always
stand together are one item, so that a template's fixed parts are no combinations.
Null URLs and URLs without ``://`` have empty host
and path, no tokens and the verdict allow. An empty table gives no rows; further
columns are ignored; repeated rows and null page_ids are rows of their own.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: The curated rules, (verdict, host and path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether a rule's host is the host or a domain above it, and its path a
    prefix of the path."""
    at = rule.index("/")
    return ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))


def listed(rules, host: Column, path: Column, value: int) -> Column:
    """The longest fitting rule's verdict (value 0) or text (1), else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        out = F.when(fits(rule[1], host, path), F.lit(rule[value])).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens of the whole URL, sorted; digits are folded to one #."""

    def part(text, splitter, mark):
        folded = F.regexp_replace(ascii_lower(text), "[0-9]+", "#")
        return F.transform(F.filter(F.split(folded, splitter), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    query = F.regexp_replace(F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit("")), "=[^&]*", "")
    return F.array_sort(F.array_distinct(F.concat(part(host_of(url), r"\.", "h:"), part(path_of(url), r"[/._-]", "p:"), part(query, "&", "q:"))))


def frequent_classes(rows: DataFrame, min_support: float) -> DataFrame:
    """token, class of the tokens of ``rows(u, tokens)`` that are in enough rows;
    tokens that always stand together are of one class, named by the least of them.

    An infrequent token is in no frequent combination, so leaving it out is exact;
    and a template's fixed tokens are one item, not all their combinations. There are
    at most (tokens of a row on average) / min_support of them.
    """
    least = int(math.ceil(min_support * rows.count()))
    h = F.xxhash64("u")
    each = rows.select("u", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))
    often = each.where(F.col("n") >= least)
    names = often.groupBy("n", "x", "s").agg(F.min("token").alias("class"))
    return often.join(names, ["n", "x", "s"]).select("token", "class")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support, key) from
    ``labelled(tokens, verdict)``, all rows of it; key is the antecedent's rarest
    token."""
    spark = labelled.sparkSession
    rows = cut(labelled.where("verdict is not null and size(tokens) > 0").select("tokens", "verdict", F.monotonically_increasing_id().alias("u")))
    none = "antecedent array<string>, verdict string, confidence double, support double, key string"
    if rows.isEmpty():
        return spark.createDataFrame([], none)
    classes = cut(frequent_classes(rows, min_support))
    told = rows.select("u", F.explode("tokens").alias("token")).join(classes, "token").groupBy("u").agg(F.collect_set("class").alias("items"))
    items = cut(
        rows.select("u", F.concat(F.lit("="), "verdict").alias("verdict")).join(told, "u", "left")
        .select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array("verdict")).alias("items"))
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where("consequent[0] in ('=allow', '=block') and not exists(antecedent, x -> startswith(x, '='))").select(
        F.array_sort("antecedent").alias("classes"), F.expr("substring(consequent[0], 2)").alias("verdict"), "confidence", "support"
    )
    # Any one token of a class says what the class says: a rule for each choice of them.
    members = classes.groupBy("class").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    lists = found.select("classes", F.explode("classes").alias("class")).distinct().join(members, "class").groupBy("classes").agg(F.collect_list("tokens").alias("lists"))
    one = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("lists", one, lambda acc, tokens: F.flatten(F.transform(acc, lambda a: F.transform(tokens, lambda t: F.array_append(a, t)))))
    each = lists.select("classes", F.explode(choices).alias("antecedent")).select("classes", F.array_sort("antecedent").alias("antecedent"))
    found = cut(found.join(each, "classes").select("antecedent", "verdict", "confidence", "support"))
    often = model.freqItemsets.where("size(items) = 1").select(F.expr("items[0]").alias("class"), "freq").join(classes, "class").select(F.col("token").alias("key"), "freq")
    rarest = (
        found.select("antecedent", "verdict", F.explode("antecedent").alias("key")).join(often, "key")
        .groupBy("antecedent", "verdict").agg(F.min_by("key", F.struct("freq", "key")).alias("key"))
    )
    rules = cut(found.join(rarest, ["antecedent", "verdict"]).select("antecedent", "verdict", "confidence", "support", "key"))
    # A rule goes if a part of it says the same and is as sure.
    part = rules.select(F.col("antecedent").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), "key")
    more = (
        rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("key")).join(part, "key")
        .where("v = verdict and c >= confidence and size(less) < size(antecedent) and size(array_except(less, antecedent)) = 0")
        .select("antecedent", "verdict").distinct()
    )
    return cut(rules.join(more, ["antecedent", "verdict"], "left_anti"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For ``urls(url, tokens)`` with a fitting rule: url, mined verdict,
    confidence; by the inverted index of the rules' rarest tokens."""
    hit = (
        urls.select("url", "tokens", F.explode("tokens").alias("key")).join(rules, "key")
        .where("size(array_except(antecedent, tokens)) = 0")
    )
    best = F.max_by(F.struct(F.col("verdict").alias("mined"), "confidence"), F.struct("confidence", F.size("antecedent"), "support", F.expr("array_join(antecedent, ' ')"), "verdict"))
    return hit.groupBy("url").agg(best.alias("b")).select("url", "b.mined", "b.confidence")


def judge(pages: DataFrame, rules=tuple(RULES)) -> DataFrame:
    """page_id, host, path, rule, verdict and the mined rule's confidence for
    every row of ``pages(page_id, url)``."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", listed(rules, host, path, 1)).withColumn("listed", listed(rules, host, path, 0))
    urls = cut(rows.where("url is not null").select("url", "listed").distinct().withColumn("tokens", tokens_of(url)))
    mined = match(urls.where("listed is null"), mine(urls.select("tokens", F.col("listed").alias("verdict"))))
    return rows.join(mined, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"), F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence")
    )


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
