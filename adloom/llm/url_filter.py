"""URL filter: a longest-match rule list, and gradient-boosted trees on lexical features for URLs no rule fits.

Everything on the main path is a DataFrame expression or a Spark ML stage that runs in the JVM: no Python
worker sees a row. The trees learn from URLs that the rules label (block = 1), on a bounded hash sample of
them (`TRAIN_ROWS`, a documented parameter); every URL is featured and judged.

Inputs and their defined results:
* url null, or without `://`: host and path are empty, no rule fits, the trees judge the (empty) features;
* host: after the first `://` up to `/`, `?`, `#` or end, with only A-Z lower-cased; path: what follows, up to
  `?`, `#` or end; an empty path fits no rule (rule paths start with `/`);
* repeated page_id or url: every row is judged on its own, equal urls get equal results;
* empty table: empty result; no labelled row: every unmatched URL is `allow` with score 0; labels of one kind
  only: that kind, with score 0 or 1;
* extra columns of `pages`, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contract: the rule list as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Largest number of rule-labelled URLs the trees are fitted on (a hash sample above it).
TRAIN_ROWS = 200_000
TREES, DEPTH, SEED = 30, 4, 7
#: Rows of the training sample per partition.
SAMPLE_PART_ROWS = 50_000

FEATURES = ["url_len", "host_len", "path_len", "depth", "digit_ratio", "entropy", "n_params", "n_labels",
            "suffix_len", "suffix_share", "suffix_block_rate", "has_www", "n_hyphens", "ext_len", "is_https"]


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) by the contract; null or no `://` gives empty strings."""
    found = F.coalesce(url, F.lit("")).contains("://")
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 0)
    host = F.regexp_extract(rest, r"^://([^/?#]*)", 1)
    path = F.substring(rest, F.length(host) + 4, 1 << 30)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (F.when(found, F.translate(host, upper, lower)).otherwise(F.lit("")),
            F.when(found, path).otherwise(F.lit("")))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    on_host = (host == F.lit(rule_host)) | host.endswith("." + rule_host)
    return on_host & path.startswith(rule_path)


def matched_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text like `net/`, its verdict) of the longest fitting rule; nulls when none fits.

    Longest is by the length of the rule text; equal lengths go to the smaller text. The list is fixed, so it
    becomes one CASE expression instead of a join."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = verdict = None
    for v, h, p in reversed(ordered):  # the last `when` built is the first tested
        cond = fits(host, path, h, p)
        rule = F.when(cond, F.lit(h + p)).otherwise(rule if rule is not None else F.lit(None).cast("string"))
        verdict = F.when(cond, F.lit(v)).otherwise(verdict if verdict is not None else F.lit(None).cast("string"))
    return rule, verdict


def char_entropy(s: Column) -> Column:
    """Shannon entropy in bits of the characters of s; 0 for an empty string."""
    chars = F.split(s, "")
    n = F.size(chars).cast("double")
    terms = F.transform(
        F.array_distinct(chars),
        lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n,
    )
    ent = -F.aggregate(terms, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))
    return F.when((s == "") | s.isNull(), F.lit(0.0)).otherwise(ent)


def lexical(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, the matched rule and the lexical features (suffix statistics
    are over all pages)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url")).select(
        "page_id", url.alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"))
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    suffix = F.substring_index("host", ".", -1)
    last_seg = F.substring_index("path", "/", -1)
    rows = rows.select(
        "*", rule.alias("rule"), verdict.alias("rule_verdict"), suffix.alias("suffix"),
        F.length("_url").cast("double").alias("url_len"),
        F.length("host").cast("double").alias("host_len"),
        F.length("path").cast("double").alias("path_len"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double").alias("depth"),
        F.when(F.length("_url") > 0,
               (F.length("_url") - F.length(F.regexp_replace("_url", "[0-9]", ""))) / F.length("_url"))
        .otherwise(0.0).alias("digit_ratio"),
        char_entropy(F.col("_url")).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("n_params"),
        F.when(F.col("host") == "", 0.0).otherwise(F.size(F.split("host", r"\.")).cast("double")).alias("n_labels"),
        F.length(suffix).cast("double").alias("suffix_len"),
        F.col("host").startswith("www.").cast("double").alias("has_www"),
        (F.length("_url") - F.length(F.regexp_replace("_url", "-", ""))).cast("double").alias("n_hyphens"),
        F.when(last_seg.contains("."), F.length(F.substring_index(last_seg, ".", -1))).otherwise(0).cast("double")
        .alias("ext_len"),
        F.lower(F.substring_index("_url", "://", 1)).eqNullSafe("https").cast("double").alias("is_https"),
    )
    # suffix statistics: share of all pages, and smoothed block rate among rule-labelled pages
    stats = rows.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("_blocked"),
        F.count("rule_verdict").alias("_labelled"),
    )
    total = max(1, pages.count())
    stats = stats.select(
        "suffix",
        (F.col("_n") / F.lit(float(total))).alias("suffix_share"),
        ((F.col("_blocked") + 1.0) / (F.col("_labelled") + 2.0)).alias("suffix_block_rate"),
    )
    return rows.join(stats, "suffix", "left")


def judge(pages: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else the trees'), score (block probability; 1 or 0
    where a rule decides)."""
    rows = lexical(pages)
    labelled = rows.where(F.col("rule_verdict").isNotNull())
    counts = labelled.groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("rule_verdict") == "block").cast("long")).alias("blocked"),
    ).first()
    n, blocked = counts["n"] or 0, counts["blocked"] or 0
    if n == 0 or blocked in (0, n):
        learned = F.lit(1.0 if n and blocked == n else 0.0)
        scored = rows.withColumn("_p", learned)
    else:
        share = min(1.0, train_rows / n)
        sample = labelled.where(F.pmod(F.xxhash64("page_id", "_url"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
        sample = sample.withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
        # the sample is bounded; every boosting round is a job, so its task count follows the sample, not the input
        sample = sample.repartition(max(1, math.ceil(min(n, train_rows) / SAMPLE_PART_ROWS)))
        model = Pipeline(stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="_features"),
            GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED,
                          predictionCol="_pred").setProbabilityCol("_prob").setRawPredictionCol("_raw"),
        ]).fit(sample.select("label", *FEATURES))
        scored = model.transform(rows).withColumn("_p", vector_to_array("_prob")[1]).drop("_features", "_raw", "_pred", "_prob")
    learned = F.when(F.col("_p") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.col("rule_verdict"), learned).alias("verdict"),
        F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("double"))
        .otherwise(F.col("_p")).alias("score"),
    )
