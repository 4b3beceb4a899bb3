"""URL verdicts: rules first, then gradient-boosted trees on lexical features. DataFrame functions only.

Suffix statistics are of two kinds. Those of a site (the host's last three labels) are taken
over all urls without labels: how many urls it has, and their mean depth and share of digits.
Block rates of a suffix need labels that do not come from the suffix, so they are features
only where the user gives labelled urls, and are then out of fold: a training row's rate
counts the labelled urls of other sites only. Where the rules give the labels, a suffix's
rate would be the rule itself, and there are none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEXICAL = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "n_params", "n_hyphens", "site_urls", "site_depth", "site_digits"]
_RATES = ["top_rate", "domain_rate"]
_FOLDS = 5


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains where the url's path starts with the rule's."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. Of equally long rules the first given wins."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern, verdict = F.when(fits, F.lit(r.pattern)).otherwise(pattern), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


def _domain(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with the features that a url's own characters give."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    n = F.length(u)
    chars = F.array_distinct(F.split(u, ""))

    def share(c: Column) -> Column:
        return (n - F.length(F.replace(u, c, F.lit("")))) / n

    entropy = F.when(n == 0, 0.0).otherwise(F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return urls.withColumns({
        "url_length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "digit_ratio": F.when(n == 0, 0.0).otherwise(F.regexp_count(u, F.lit("[0-9]")) / n),
        "entropy": entropy,
        "n_params": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
        "n_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "top": _domain(host, 1),
        "domain": _domain(host, 2),
        "site": _domain(host, 3),
    })


def with_site_statistics(urls: DataFrame, of: DataFrame) -> DataFrame:
    """``urls`` with what the urls ``of`` have in common by site; a site that they lack counts as empty."""
    stats = of.groupBy("site").agg(F.log1p(F.count("*").cast("double")).alias("site_urls"), F.avg("depth").alias("site_depth"), F.avg("digit_ratio").alias("site_digits"))
    return urls.join(stats, "site", "left").fillna(0.0, ["site_urls", "site_depth", "site_digits"])


def _fold() -> Column:
    return F.pmod(F.xxhash64("site"), F.lit(_FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame, suffix: str) -> DataFrame:
    """``(suffix, fold, blocked, known)`` over labelled urls; ``fold`` null holds all folds together. All urls of a site are in one fold."""
    by_fold = labelled.groupBy(suffix, _fold().alias("fold")).agg(F.sum("y").alias("blocked"), F.count("*").alias("known"))
    return by_fold.unionByName(by_fold.groupBy(suffix).agg(F.lit(None).cast("int").alias("fold"), F.sum("blocked").alias("blocked"), F.sum("known").alias("known")))


def with_rates(urls: DataFrame, counts: dict[str, DataFrame], out_of_fold: bool, strength: float = 10.0) -> DataFrame:
    """``urls`` with the block rate of each suffix, drawn to one half where few are known; out of fold, without those of the url's own fold."""
    for suffix, of in counts.items():
        total = of.where("fold is null").select(suffix, F.col("blocked").alias("b"), F.col("known").alias("n"))
        urls = urls.join(total, suffix, "left")
        blocked, known = F.coalesce("b", F.lit(0)), F.coalesce("n", F.lit(0))
        if out_of_fold:
            own = of.where("fold is not null").select(F.col(suffix).alias("own_suffix"), F.col("fold").alias("own_fold"), F.col("blocked").alias("own_b"), F.col("known").alias("own_n"))
            urls = urls.join(own, (urls[suffix] == F.col("own_suffix")) & (_fold() == F.col("own_fold")), "left")
            blocked, known = blocked - F.coalesce("own_b", F.lit(0)), known - F.coalesce("own_n", F.lit(0))
        urls = urls.withColumn(f"{suffix}_rate", (blocked + strength / 2) / (known + strength)).drop("b", "n", "own_suffix", "own_fold", "own_b", "own_n")
    return urls


def _as_column(debug: str, features: list[str]) -> Column:
    """A regression tree, as MLlib prints it, as nested conditions."""
    lines = [x.strip() for x in debug.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        at += 1  # its Else
        no = node()
        return F.when(F.col(features[int(feature)]) <= float(threshold), yes).otherwise(no)

    return node()


def train_trees(labelled: DataFrame, features: list[str], max_rows: int = 20_000, trees: int = 12, depth: int = 3):
    """(margin, model): the margin of gradient-boosted trees as a column expression, and MLlib's model; over 0 means block.

    ``labelled`` has the features and y (1: block), of which ``max_rows`` are drawn by the
    hash of their urls. With labels of one kind only the margin is constant, with none it
    is 0, and the model is None.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    drawn = labelled.orderBy(F.xxhash64("url"), "url", "page_id").limit(max_rows).select(*features, F.col("y").cast("double").alias("label"))
    kinds = {r[0] for r in drawn.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return F.lit({1.0: 1.0, 0.0: -1.0}[kinds.pop()] if kinds else 0.0), None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=7, cacheNodeIds=False).fit(VectorAssembler(inputCols=features, outputCol="features").transform(drawn))
    parts = [F.lit(float(w)) * _as_column(t.toDebugString, features) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    return reduce(lambda a, b: a + b, parts), model


def described(urls: DataFrame) -> DataFrame:
    """``urls(page_id, url, ...)`` with host, path and lexical features."""
    return lexical(urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}))


def labelled_by_rules(named: DataFrame, rules: list[Rule]) -> DataFrame:
    """``named`` with rule, by_rule (null where none fits) and y (1: block)."""
    rule, verdict = match_rule(rules, F.col("host"), F.col("path"))
    return named.withColumns({"rule": rule, "by_rule": verdict}).withColumn("y", F.expr("int(by_rule = 'block')"))


def held_out_verdicts(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(y, predicted, n)`` over the rule-labelled urls of the sites of one fold, by trees trained on the other folds' sites."""
    named = described(pages.select("page_id", "url"))
    known = with_site_statistics(labelled_by_rules(named, rules), named).where("by_rule is not null").withColumn("fold", _fold())
    margin, _ = train_trees(known.where("fold <> 0"), _LEXICAL)
    return known.where("fold = 0").groupBy("y", (margin > 0).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def judge(pages: DataFrame, rules: list[Rule], labelled_urls: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, margin)`` for every row of ``pages(page_id, url)``.

    The longest fitting rule gives the verdict; where none fits, the trees do: block where
    the margin is over 0, else allow. ``labelled_urls(page_id, url, y)`` trains them (y 1: block); left out,
    the urls that a rule fits are the labelled ones. Null urls and urls without ``://`` have
    an empty host and path and go to the trees. Repeated rows give repeated results, an
    empty table none; other columns are not looked at.
    """
    from bytelode.llm.common import written

    named = described(pages.select("page_id", "url"))
    judged = with_site_statistics(labelled_by_rules(named, rules), named)
    if labelled_urls is None:
        margin, _ = train_trees(judged.where("by_rule is not null"), _LEXICAL)
    else:
        known = with_site_statistics(described(labelled_urls.select("page_id", "url", "y")), named)
        counts = {s: written(suffix_counts(known, s), "suffix-counts") for s in ("top", "domain")}
        margin, _ = train_trees(with_rates(known, counts, True), _LEXICAL + _RATES)
        judged = with_rates(judged, counts, False)
    judged = judged.withColumn("margin", margin)
    by_trees = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"), "margin")
