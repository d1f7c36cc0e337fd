"""URL filter: rules first, then gradient-boosted trees on lexical features.

Rules name a host with its subdomains and the beginning of a path; the longest
rule that fits decides. The urls that rules decide are the labelled ones; the
trees learn from a bounded sample of them (``SAMPLE_ROWS``) and judge the rest.
All features are column expressions over the url alone, except the suffix
statistics: for the last label of the host and the extension of the path, the
smoothed share of blocked ones among the labelled.

A null url or one without "://" has an empty host and path and is judged by the
method. Without labelled urls of both kinds everything else is allowed. Rows
are judged one by one, so repeated rows and ids are judged alike.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from leakatlas.llm.shared import bounded_sample, broadcast_if_small, stored

SAMPLE_ROWS = 20_000
TREES = 10
DEPTH = 4
PRIOR = 20.0
SUFFIXES = ("host_suffix", "path_suffix")
Rule = tuple[str, str]  # verdict, host and path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(text, "")) 
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(letters, F.lit(0.0), lambda s, c: s - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` plus host, path, the suffixes and the numeric features."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return (
        urls.withColumn("host", host_of(F.col(url)))
        .withColumn("path", path_of(F.col(url)))
        .withColumn("host_suffix", F.element_at(F.split("host", r"\."), -1))
        .withColumn("path_suffix", F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1))
        .withColumn("f_length", F.length(text).cast("double"))
        .withColumn("f_host_length", F.length("host").cast("double"))
        .withColumn("f_depth", _count(F.col("path"), "/"))
        .withColumn("f_labels", _count(F.col("host"), r"\."))
        .withColumn("f_digits", _count(text, "[0-9]") / F.greatest(F.length(text), F.lit(1)))
        .withColumn("f_hyphens", _count(F.col("host"), "-"))
        .withColumn("f_entropy", entropy(text))
        .withColumn("f_host_entropy", entropy(F.col("host")))
        .withColumn("f_parameters", F.when(query == "", 0.0).otherwise(_count(query, "&") + 1))
        .withColumn("f_fragment", F.contains(text, F.lit("#")).cast("double"))
    )


FEATURES = ("f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_hyphens", "f_entropy", "f_host_entropy", "f_parameters", "f_fragment", *(f"f_{s}" for s in SUFFIXES))


class UrlModel:
    """Trees and suffix statistics."""

    def __init__(self, trees: GBTClassificationModel, suffixes: dict[str, DataFrame], share: float):
        self.trees, self.suffixes, self.share = trees, suffixes, share

    def prepare(self, features: DataFrame) -> DataFrame:
        for s, table in self.suffixes.items():
            features = features.join(table.withColumnsRenamed({s: f"__{s}"}), F.col(s) == F.col(f"__{s}"), "left").withColumn(f"f_{s}", F.coalesce(f"f_{s}", F.lit(self.share))).drop(f"__{s}")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(features)

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` plus block_probability."""
        scored = self.trees.transform(self.prepare(features))
        return scored.withColumn("block_probability", vector_to_array("probability")[1])


def train(labelled: DataFrame, label: str = "blocked", url: str = "url", sample_rows: int = SAMPLE_ROWS) -> UrlModel | None:
    """Fit on rows of ``with_features`` that have a ``label`` of 0 or 1."""
    suffixes, totals = {}, labelled.agg(F.count("*"), F.sum(label)).first()
    n, n_blocked = totals[0], int(totals[1] or 0)
    if n_blocked in (0, n):
        return None
    share = n_blocked / n
    for s in SUFFIXES:
        rates = labelled.groupBy(s).agg(((F.sum(label) + PRIOR * share) / (F.count("*") + PRIOR)).alias(f"f_{s}"))
        suffixes[s] = broadcast_if_small(rates, "url-suffixes")
    draft = UrlModel(None, suffixes, share)
    rows = stored(bounded_sample(labelled, F.col(url), sample_rows), "url-sample")
    ready = draft.prepare(rows).select("__features", F.col(label).cast("double").alias("label"))
    booster = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=5)
    draft.trees = booster.fit(ready)
    return draft


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``urls`` plus host, path, rule, verdict (allow or block) and block_probability."""
    features = with_features(urls, url).withColumn("__rule", matching_rule(rules, F.col("host"), F.col("path")))
    labelled = features.filter("__rule is not null").withColumn("blocked", (F.col("__rule.verdict") == "block").cast("int"))
    model = train(labelled, "blocked", url, sample_rows)
    scored = features.withColumn("block_probability", F.lit(0.0)) if model is None else model.score(features)
    own = F.when(F.col("block_probability") > 0.5, "block").otherwise("allow")
    return scored.select(*[F.col(f"`{c}`") for c in urls.columns if c not in ("host", "path", "rule", "verdict", "block_probability")], "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "block_probability")
