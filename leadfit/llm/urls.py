"""URL filters: host and path rules, and boosted trees over lexical features for the urls that no rule decides.

Everything is DataFrame expressions and Spark's own gradient-boosted trees; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit.llm.common import written

PER_CLASS = 2000  # bound of the labelled urls that are learnt from, by class
TREES = 12
DEPTH = 4
SUFFIX_WEIGHT = 50  # labelled urls of average blame that a suffix is mixed with

# Words by which a host name is labelled as one to block, for learning
BLOCKED_HOST_WORDS = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "bingo", "casino", "cheap", "click", "clickbait", "doubleclick",
    "escort", "farm", "free", "gambling", "jackpot", "loan", "loans", "lottery", "malware", "phishing", "pill", "pills",
    "poker", "popup", "porn", "replica", "sex", "slots", "spam", "spyware", "tracker", "track", "tracking", "viagra",
    "warez", "win", "winner", "xxx",
)

FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy",
    "host_entropy", "hyphens", "host_hyphens", "parameters", "has_fragment", "longest_label", "secure", "suffix_blame",
]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after_scheme(url), "/", 1)).otherwise("")
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(_after_scheme(url), r"(?s)^[^/?#]*", "")).otherwise("")
    return F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))


Rule = tuple[str, str, str]  # host, beginning of the path, allow or block


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Of equally long rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, start, word in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        rule = F.when(fits, F.lit(rule_host + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a letter of a text; 0 for an empty one. One pass over its sorted letters, run by run."""
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(0.0)
    state = lambda letter, run, total: F.struct(letter.alias("letter"), run.alias("run"), total.alias("total"))

    def add(s: Column, c: Column) -> Column:
        return F.when(c == s["letter"], state(s["letter"], s["run"] + 1.0, s["total"])).otherwise(state(c, F.lit(1.0), s["total"] + weight(s["run"])))

    letters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    runs = F.aggregate(letters, state(F.lit(""), F.lit(0.0), F.lit(0.0)), add, lambda s: s["total"] + weight(s["run"]))
    size = F.greatest(F.size(letters), F.lit(1))
    return F.log2(size.cast("double")) - runs / size


def share_of(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / F.greatest(F.length(text), F.lit(1))


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, and what else it holds) with the lexical features of each url."""
    parts = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    query = F.when(url.contains("?"), F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise("")
    return parts.withColumns({
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")), "labels": F.size(labels),
        "digit_ratio": share_of(url, "0-9"), "host_digit_ratio": share_of(host, "0-9"),
        "entropy": entropy(path), "host_entropy": entropy(host),
        "hyphens": F.length(F.regexp_replace(path, "[^-]", "")), "host_hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "has_fragment": url.contains("#").cast("int"),
        "longest_label": F.coalesce(F.array_max(F.transform(labels, lambda x: F.length(x))), F.lit(0)),
        "secure": url.startswith("https").cast("int"), "suffix": F.substring_index(host, ".", -1),
    })


def label_of(host: Column) -> Column:
    """1 where a word of the host name (between dots, digits and hyphens) is among BLOCKED_HOST_WORDS, else 0; null
    without a host."""
    words = F.split(host, r"[^a-z]+")
    return F.when(host == "", F.lit(None)).otherwise(F.arrays_overlap(words, F.array(*map(F.lit, BLOCKED_HOST_WORDS))).cast("int"))


class UrlModel:
    """Trees and the blame of host suffixes, a table (known_suffix, blame); without labelled urls of both kinds it allows all."""

    def __init__(self, trees: PipelineModel | None, blame: DataFrame | None, average: float):
        self.trees, self.blame, self.average = trees, blame, average

    def with_features(self, urls: DataFrame) -> DataFrame:
        table = lexical(urls)
        if self.blame is None:
            return table.withColumn("suffix_blame", F.lit(self.average))
        known = table.join(self.blame, F.col("suffix") == F.col("known_suffix"), "left")
        return known.withColumn("suffix_blame", F.coalesce("blame", F.lit(self.average))).drop("known_suffix", "blame")

    def scored(self, urls: DataFrame) -> DataFrame:
        """urls with a column block_score, the probability that the url is one to block."""
        kept = [F.col(c) for c in urls.columns]
        if self.trees is None:
            return urls.withColumn("block_score", F.lit(0.0))
        made = self.trees.transform(self.with_features(urls))
        return made.select(*kept, vector_to_array("probability")[1].alias("block_score"))


def fit_urls(urls: DataFrame, label: Column | None = None, per_class: int = PER_CLASS) -> UrlModel:
    """Trees from labelled distinct urls: at most per_class of each class, first by a hash of the url.

    label gives 1 (block) or 0 (allow) from the columns url, host and path; without it, host words decide. Suffix
    statistics count all labelled urls and have a row for each suffix, written as a table.
    """
    base = urls.select("url").where(F.col("url").isNotNull()).distinct()
    parts = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labelled = parts.select("url", F.substring_index("host", ".", -1).alias("suffix"), (label if label is not None else label_of(F.col("host"))).cast("double").alias("label")).where(F.col("label").isNotNull())
    suffixes = labelled.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    if not total["n"] or not 0 < total["blocked"] < total["n"]:
        return UrlModel(None, None, 0.0)
    average = total["blocked"] / total["n"]
    blamed = (F.col("blocked") + SUFFIX_WEIGHT * average) / (F.col("n") + SUFFIX_WEIGHT)
    blame = written(suffixes.select(F.col("suffix").alias("known_suffix"), blamed.alias("blame")), "suffixes")
    order = [F.xxhash64("url"), F.col("url")]
    one, zero = (labelled.where(F.col("label") == v).select("url", "label").orderBy(*order).limit(per_class) for v in (1, 0))
    model = UrlModel(None, blame, average)
    sample = model.with_features(one.unionByName(zero))
    # a class weighs in the sample what it weighs among all labelled urls
    taken = {r["label"]: r["n"] for r in one.unionByName(zero).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.when(F.col("label") == 1, total["blocked"] / taken[1.0]).otherwise((total["n"] - total["blocked"]) / taken[0.0])
    steps = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7),
    ])
    model.trees = steps.fit(sample.withColumn("weight", weight).select("label", "weight", *FEATURES).coalesce(1))
    return model


def judge_urls(pages: DataFrame, rules: Sequence[Rule], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row of pages.

    The longest fitting rule decides; without one, the model's score. A null url, or one without ://, has an empty host
    and path, fits no rule and is allowed or blocked by its score (0 for a null one); a null page_id stays null;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored. No shuffle.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    scored = model.scored(urls).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    score = F.when(F.col("url").isNull(), 0.0).otherwise(F.col("block_score"))
    by_model = F.when(score >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_model).alias("verdict"), score.alias("block_score"))
