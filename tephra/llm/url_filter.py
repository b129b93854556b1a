"""URL filter: rules first, gradient-boosted trees on lexical features for all other URLs.

DataFrame functions only. Labels come from the rules: a URL that a rule decides is a labelled one. Features are cut
into bins; each level of each tree is one grouped aggregation of gradients by leaf, feature and bin over a bounded,
written sample, of which only these sums reach the driver. The trees become a column expression.

The statistic of a suffix, and of the first part of a path, is the shrunk share of blocked URLs under it; a training
row's comes from the other folds, so that it doesn't hold the row's own label. Each tree sees a part of the features, so that the suffix doesn't hide all others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host and path): a rule fits its host and all subdomains if the URL's path starts with the rule's (fixed by contract).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled URLs that the trees are trained on, at most, picked by the URL's hash.
TRAIN_ROWS = 20_000
TREES = 8
DEPTH = 2
RATE = 0.4
L2 = 1.0
BINS = 16
#: Suffixes are counted in so many hashed cells: a fixed-size table, whatever the URLs hold.
SUFFIX_CELLS = 256
#: Parts of the labelled URLs whose suffix statistics come from the other parts, and rows that the prior is worth.
FOLDS = 5
SUFFIX_PRIOR = 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_column(url: Column) -> Column:
    """After the first ://, A-Z lower-cased; empty for null and for URLs without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _cells(host: Column, path: Column) -> list[Column]:
    """Cells of what has a statistic: the host's suffix, and the first part of the path."""
    parts = [F.substring_index(host, ".", -1), F.regexp_extract(path, "^/([^/]*)", 1)]
    return [F.pmod(F.xxhash64(p), F.lit(SUFFIX_CELLS)).cast("int") for p in parts]


def _entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - (F.size(F.filter(chars, lambda d: d == c)) / n) * F.log2(F.size(F.filter(chars, lambda d: d == c)) / n))


def features(url: Column, host: Column, path: Column, shares: list[Column]) -> list[Column]:
    """Lexical features of a URL; ``shares`` are the statistics of its suffix and of the first part of its path."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(u, r"^[^?#]*", "")
    n = F.length(u)
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return [c.cast("double") for c in (
        n, F.length(host), F.length(path), count(path, "/"), digits(u) / F.greatest(n, F.lit(1)), digits(host), _entropy(host),
        F.when(rest.startswith("?"), count(F.substring_index(rest, "#", 1), "&") + 1).otherwise(0), count(host, "-"), count(host, "."), F.length(F.substring_index(host, ".", -1)), *shares,
    )]


@dataclass
class UrlModel:
    """shares by cell, of suffixes and of first parts of paths; edges by feature; trees of (feature, bin) splits: a tree is a list of 2**depth - 1 splits or None, and its leaf values."""

    shares: list[list[float]]
    edges: list[list[float]]
    base: float
    trees: list[tuple[list, list[float]]]


def _bins(values: list[Column], edges: list[list[float]]) -> Column:
    """The bin of each feature: how many of its edges lie below the value."""
    return F.array(*[sum((F.when(v > e, 1).otherwise(0) for e in own), F.lit(0)).cast("int") for v, own in zip(values, edges)])


def _leaf(bins: Column, splits: list) -> Column:
    """Number of the node that a row reaches; splits in heap order, a None split sends all rows to its left."""

    def go(node: int) -> Column:
        if node >= len(splits):
            return F.lit(node - len(splits))
        if splits[node] is None:
            return go(2 * node + 1)
        f, b = splits[node]
        return F.when(bins[f] <= b, go(2 * node + 1)).otherwise(go(2 * node + 2))

    return go(0)


def _leaf_value(bins: Column, tree: tuple[list, list[float]]) -> Column:
    splits, leaves = tree
    return F.element_at(F.array(*[F.lit(float(v)) for v in leaves]), _leaf(bins, splits) + 1)


def _score(bins: Column, model: UrlModel) -> Column:
    return sum((_leaf_value(bins, t) for t in model.trees), F.lit(float(model.base)))


def allowed(tree: int, n_features: int) -> set[int]:
    """The features that a tree may split on: over half of them, others from tree to tree."""
    return {f for f in range(n_features) if (f + 5 * tree) % n_features <= n_features // 2}


_TREE = "struct<f:array<int>,b:array<int>,v:array<double>>"


def _arrays(splits: list, values: list[float], depth: int) -> Column:
    """A tree as arrays of split features, last bins of the left sides (all bins, where there is no split) and leaf values. Such literals leave the generated code the same from tree to tree."""
    full = [*splits, *[None] * (2**depth - 1 - len(splits))]
    return F.struct(F.array(*[F.lit(s[0] if s else 0) for s in full]).alias("f"), F.array(*[F.lit(s[1] if s else 1 << 20) for s in full]).alias("b"), F.array(*[F.lit(float(v)) for v in values]).cast("array<double>").alias("v"))


def _walked(bins: Column, tree: Column, depth: int) -> Column:
    """Number of the node that a row reaches after ``depth`` splits."""
    if not depth:
        return F.lit(0)
    right = lambda node: F.when(F.get(bins, F.get(tree["f"], node)) > F.get(tree["b"], node), 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda node, _: 2 * node + 1 + right(node)) - (2**depth - 1)


def boost(binned: DataFrame, n_features: int, base: float, trees: int = TREES, depth: int = DEPTH) -> list[tuple[list, list[float]]]:
    """Trees on rows (bins, y: sum of labels, n: rows) by their gradients; one aggregation a level, and none for the leaves: a split's two sides are summed by it."""
    found: list[tuple[list, list[float]]] = []
    bins = F.col("bins")
    for t in range(trees):
        before = F.array(*[_arrays(*tree, depth) for tree in found]) if found else F.array().cast(f"array<{_TREE}>")
        margin = F.aggregate(before, F.lit(float(base)), lambda total, tree: total + F.get(tree["v"], _walked(bins, tree, depth)))
        prob = 1 / (1 + F.exp(-F.col("margin")))
        graded = binned.withColumn("margin", margin).withColumn("g", F.col("y") - F.col("n") * prob).withColumn("h", F.col("n") * prob * (1 - prob))
        features_of, splits, leaves = allowed(t, n_features), [], []
        for level in range(depth):
            sums = graded.select(_walked(bins, _arrays(splits, [], depth), level).alias("leaf"), "g", "h", F.posexplode("bins").alias("f", "b")).groupBy("leaf", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # leaves x features x bins
            cells: dict = {}
            for r in sums:
                cells.setdefault(r["leaf"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
            leaves = []
            for leaf in range(2**level):
                split, sides = _best_split(cells.get(leaf, {}), features_of)
                splits.append(split)
                leaves += [RATE * g / (h + L2) for g, h in sides]
        found.append((splits, leaves))
    return found


def train(pages: DataFrame, url: str = "url", rules=RULES, trees: int = TREES, depth: int = DEPTH, rows: int = TRAIN_ROWS) -> UrlModel:
    """Fit on at most ``rows`` distinct URLs that a rule decides, those with the least hashes. Without both labels there are no trees."""
    h, p = host_column(F.col(url)), path_column(F.col(url))
    named = pages.select(F.col(url).alias("url"), h.alias("host"), p.alias("path")).withColumn("rule", rule_column(F.col("host"), F.col("path"), rules)).where(F.col("rule").isNotNull())
    y = F.lit(0.0)
    for v, rule in rules:
        y = F.when(F.col("rule") == rule, float(v == "block")).otherwise(y)
    # Only about twice as many URLs as are picked leave their tasks: those with small hashes, repeats put together before.
    about = named.agg(F.approx_count_distinct("url")).first()[0]
    order = F.xxhash64("url", F.lit("url sample"))
    bound = min(2**63 - 1, int(min(1.0, 2 * rows / max(1, about)) * 2**64) - 2**63)
    picked = named.where(order <= F.lit(bound).cast("long")).select("url", "host", "path", y.alias("y")).distinct().orderBy(order, "url").limit(rows)
    labelled = written(picked.withColumn("cells", F.array(*_cells(F.col("host"), F.col("path")))).withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")).repartition(4), "labelled-urls")
    sums = labelled.select("y", "fold", F.posexplode("cells").alias("kind", "cell")).groupBy("kind", "cell", "fold").agg(F.sum("y"), F.count(F.lit(1))).collect()  # 2 x SUFFIX_CELLS x FOLDS rows at most
    parts = {(r[0], r[1], r[2]): (r[3], r[4]) for r in sums}
    n = sum(v[1] for k, v in parts.items() if k[0] == 0)
    mean = sum(v[0] for k, v in parts.items() if k[0] == 0) / max(1, n)
    shrunk = lambda own: (sum(v[0] for v in own) + SUFFIX_PRIOR * mean) / (sum(v[1] for v in own) + SUFFIX_PRIOR)
    shares = [[shrunk([parts.get((kind, c, f), (0.0, 0)) for f in range(FOLDS)]) for c in range(SUFFIX_CELLS)] for kind in (0, 1)]
    others = [[shrunk([parts.get((kind, c, f), (0.0, 0)) for f in range(FOLDS) if f != out]) for c in range(SUFFIX_CELLS) for out in range(FOLDS)] for kind in (0, 1)]
    safe = min(0.999, max(0.001, (mean * n + 1) / (n + 2)))
    model = UrlModel(shares, [], math.log(safe / (1 - safe)), [])
    values = features(F.col("url"), F.col("host"), F.col("path"), [F.element_at(F.array(*map(F.lit, others[kind])), F.col("cells")[kind] * FOLDS + F.col("fold") + 1) for kind in (0, 1)])
    names = [f"f{i}" for i in range(len(values))]
    wide = labelled.select("y", *[v.alias(c) for v, c in zip(values, names)])
    if n:
        cuts = wide.agg(*[F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 1000).alias(c) for c in names]).first()
        model.edges = [sorted(set(cuts[c])) for c in names]
    else:
        model.edges = [[] for _ in names]
    if 0 < mean < 1:
        binned = written(wide.select("y", _bins([F.col(c) for c in names], model.edges).alias("bins")).groupBy("bins").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).repartition(4), "binned-urls")
        model.trees = boost(binned, len(names), model.base, trees, depth)
    return model


def _best_split(cells: dict[int, dict[int, tuple[float, float]]], features_of: set[int]):
    """(feature, last bin of the left side) with the largest gain, ties to the least, and gradients of both sides; None if nothing gains, then all are on the left."""
    some = next(iter(cells.values()), {})
    g, h = (sum(v[i] for _, v in sorted(some.items())) for i in (0, 1))
    best, gain, sides = None, 1e-9, [(g, h), (0.0, 0.0)]
    for f in sorted(features_of & cells.keys()):
        left_g = left_h = 0.0
        for b in sorted(cells[f])[:-1]:
            left_g, left_h = left_g + cells[f][b][0], left_h + cells[f][b][1]
            now = left_g**2 / (left_h + L2) + (g - left_g) ** 2 / (h - left_h + L2) - g**2 / (h + L2)
            if now > gain + 1e-9:
                best, gain, sides = (f, b), now, [(left_g, left_h), (g - left_g, h - left_h)]
    return best, sides


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """key, host, path, rule, verdict and score (probability of block by the trees) of every row.

    The rule's verdict goes first, else the trees': block from a score of 0.5. A null URL and one without :// have an
    empty host and path, fit no rule and are judged by the trees like all others; if no URL is labelled, all without a
    rule are allowed. ``model``: one that is trained already. Repeated rows and null keys stay, other columns are ignored. The scan has no shuffle and no join.
    """
    model = model or train(pages, url, rules)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_column(F.col(url)).alias("host"), path_column(F.col(url)).alias("path"))
    values = features(F.col("url"), F.col("host"), F.col("path"), [F.element_at(F.array(*map(F.lit, own)), cell + 1) for own, cell in zip(model.shares, _cells(F.col("host"), F.col("path")))])
    rows = rows.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules)).withColumn("bins", _bins(values, model.edges))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-_score(F.col("bins"), model))) if model.trees else F.lit(1 / (1 + math.exp(-model.base)) if len(model.edges[0]) else 0.0))
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for v, rule in rules:
        verdict = F.when(F.col("rule") == rule, v).otherwise(verdict)
    return rows.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
