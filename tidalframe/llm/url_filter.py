"""Operator 8: URL filter: rules first, then gradient-boosted trees on lexical features.

Only DataFrame functions and Spark's own tree trainer run here. The labelled urls are
those that a rule fits: its verdict is the label. The trees see how a url is written:
lengths, depth, digit ratio, entropy, parameter counts, and statistics of its host's
suffix (the last two labels), gathered over all urls. The fit uses at most about
`max_rows` labelled urls, chosen by a hash of the id; every url is judged.

Host: after the first ://, up to /, ?, # or the end, A-Z lower-cased; path: from there
up to ?, # or the end; both empty for a null url or one without ://. A rule is written
host/path. It fits its host and all subdomains if the url's path starts with the
rule's; the longest rule that fits wins, of equally long ones the first in the
alphabet.

Nulls and edges: a null url has empty features and gets the trees' verdict like any
other; repeated rows are judged each. Without labelled urls of both verdicts, urls
without a rule get the verdict that the labelled ones share, or `allow`. A very long url is read
whole. Extra columns take no part, whatever their names; an empty table gives one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import sampled, written

Rule = tuple[str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000
    trees: int = 10
    depth: int = 4
    seed: int = 11
    threshold: float = 0.5


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 2)


def matched(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits, null if none does."""
    verdict = rule = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        verdict, rule = F.when(fits, kind).otherwise(verdict), F.when(fits, text).otherwise(rule)
    return verdict, rule


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    asked = F.regexp_extract(text, "\\?([^#]*)", 1)
    n = F.length(text).cast("double")
    digits = F.length(F.regexp_replace(text, "[^0-9]+", "")).cast("double")
    return {
        "url_length": n,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "labels": F.size(F.split(host, "\\.")).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
        "entropy": entropy(text),
        "parameters": F.size(F.filter(F.split(asked, "&"), lambda x: x != "")).cast("double"),
        "hyphens": F.length(F.regexp_replace(host, "[^-]+", "")).cast("double"),
        "has_fragment": text.contains("#").cast("double"),
        "is_secure": text.startswith("https").cast("double"),
        "first_segment": F.length(F.regexp_extract(path, "^/([^/]*)", 1)).cast("double"),
    }


SUFFIX_FEATURES = ("suffix_urls", "suffix_depth", "suffix_digits", "suffix_parameters")


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, s: Settings = Settings(), id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, block_probability (null where a rule decides)."""
    base = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
    base = base.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    verdict, rule = matched(F.col("host"), F.col("path"), rules)
    lexical = features(F.col("url"), F.col("host"), F.col("path"))
    rows = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), F.regexp_extract("host", "([^.]*\\.)?[^.]*$", 0).alias("suffix"), *[c.alias(n) for n, c in lexical.items()])
    rows = written(rows, "urls")
    stats = rows.groupBy("suffix").agg(
        F.log2(F.count("*") + 1.0).alias("suffix_urls"), F.avg("depth").alias("suffix_depth"), F.avg("digit_ratio").alias("suffix_digits"), F.avg("parameters").alias("suffix_parameters")
    )
    stats = written(stats, "suffixes")  # its true size decides whether it is broadcast
    assembler = VectorAssembler(inputCols=[*lexical, *SUFFIX_FEATURES], outputCol="features")
    ready = assembler.transform(rows.join(stats, "suffix", "left"))
    counts = {r["said"]: r["count"] for r in rows.where("said is not null").groupBy("said").count().collect()}  # two rows
    if len(counts) < 2:
        only = next(iter(counts), "allow")
        return ready.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    train = ready.where(F.col("said").isNotNull() & sampled("page_id", s.max_rows, sum(counts.values())))
    train = train.select("features", (F.col("said") == "block").cast("double").alias("label"))
    trainer = GBTClassifier(maxIter=s.trees, maxDepth=s.depth, seed=s.seed, featuresCol="features", labelCol="label")
    model = trainer.fit(written(train, "labelled-urls"))
    blocked = F.get(vector_to_array("probability"), 1)
    scored = model.transform(ready).select("page_id", "host", "path", "rule", "said", F.when(F.col("said").isNull(), blocked).alias("block_probability"))
    by_trees = F.when(F.col("block_probability") >= s.threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", by_trees).alias("verdict"), "block_probability")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
