"""Quality by hierarchical empirical Bayes: a document classifier's evidence with host and path posteriors.

The classifier (logistic regression on the shape of the text) gives each document log odds. Its probabilities are
summed for each host and each path of a host; a host's mean is shrunk to the global one and a path's to its host's,
by strengths that the spread of the means gives. A document's posterior odds are its own evidence on the prior of its
path, from which the document itself is left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written

#: Labelled rows that the classifier is trained on, at most.
TRAIN_ROWS = 20_000
#: Documents below this posterior probability are rejected.
THRESHOLD = 0.5
#: Strengths (in documents) of the shrinkage are kept in these bounds.
STRENGTH = (2.0, 1000.0)
SALTS = 16

_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_LONG = re.compile(r"\S{25,}")
N_FEATURES = 12


def shape(text: str | None) -> list[float]:
    """Numbers from a whole text; a null or empty one gives zeros."""
    words = text.split() if text else []
    if not words:
        return [0.0] * N_FEATURES
    raw = text.encode()
    n, nw = len(raw), len(words)
    left = lambda drop: n - len(raw.translate(None, drop))
    upper, lower = left(_UPPER), left(_LOWER)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(map(str.__eq__, words[1:], words))
    return [
        1.0,
        left(_SYMBOLS) / n,
        upper / max(1, upper + lower),
        left(b"!") / nw,
        left(b"|") / nw,
        left(_DIGITS) / n,
        np.log1p(nw),
        repeats / nw,
        len(set(words)) / nw,
        n / nw,
        1 - len(set(lines)) / len(lines),
        len(_LONG.findall(text)) / nw,
    ]


def train_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """mean, spread, weights and bias. With fewer than two classes the weights are 0 and the bias says what share is good."""
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.r_[np.zeros(N_FEATURES), np.log(share / (1 - share))]
    if len(set(y.tolist())) > 1:
        z = np.c_[(x - mean) / spread, np.ones(len(x))]
        penalty = np.r_[np.full(N_FEATURES, l2), 1e-6]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
            w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return mean, spread, w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"):
    """Train on at most TRAIN_ROWS labelled rows, picked by the key's hash. Null keys, labels and texts are left out."""
    good = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull())
    n = good.count()
    share = min(1.0, 0.9 * TRAIN_ROWS / n) if n > TRAIN_ROWS else 1.0
    picked = good.where(F.pmod(F.xxhash64(F.col("k"), F.lit("quality sample")), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["k"]).limit(TRAIN_ROWS)
    rows = docs.select(docs[key].alias("k"), docs[text].alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(picked), "k").select("y", "text")

    def make():
        return lambda b: {"y": b.column(0), "x": [shape(t) for t in b.column(1).to_pylist()]}

    sample = map_texts(rows, make, "y double, x array<double>").limit(TRAIN_ROWS).collect()
    return train_logistic(np.array([r["x"] for r in sample], float).reshape(-1, N_FEATURES), np.array([float(r["y"] > 0.5) for r in sample]))


def evidence(docs: DataFrame, model, key: str, text: str, host: str, path: str) -> DataFrame:
    """key, of (hash of the text), host, path and z: the classifier's log odds of every row. A null host or path is an empty one."""
    kind = dict(docs.dtypes)[key]
    mean, spread, w, bias = model
    rows = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("of"), F.coalesce(docs[host].cast("string"), F.lit("")).alias("host"), F.coalesce(docs[path].cast("string"), F.lit("")).alias("path"), docs[text].alias("text"))

    def make():
        def run(b: pa.RecordBatch):
            x = np.array([shape(t) for t in b.column(4).to_pylist()]).reshape(-1, N_FEATURES)
            z = np.clip((x - mean) / spread, -8, 8) @ w + bias
            empty = x[:, 0] == 0  # no words: nothing good in it
            return {n: b.column(i) for i, n in enumerate(("key", "of", "host", "path"))} | {"z": np.where(empty, -12.0, np.clip(z, -12, 12))}

        return run

    return map_texts(rows, make, f"key {kind}, of long, host string, path string, z double")


def _strength(groups: DataFrame, prior) -> float:
    """Documents that a group's prior is worth, from how far group means lie apart beyond what their sizes explain."""
    mean = F.col("s") / F.col("n")
    row = groups.where(F.col("n") > 1).agg(F.sum("n"), F.sum(F.col("n") * (mean - prior) * (mean - prior)), F.sum(F.col("q") - F.col("n") * mean * mean), F.count(F.lit(1))).first()
    n, between, within, k = (float(v or 0) for v in row)
    if k < 2 or n <= k:
        return STRENGTH[0]
    noise = within / (n - k)
    spread = max(1e-9, (between - k * noise) / n)
    return min(STRENGTH[1], max(STRENGTH[0], noise / spread))


def posteriors(found: DataFrame) -> DataFrame:
    """found: written evidence. key, of, host, path, p_doc, host_posterior, path_posterior, quality of every row."""
    p = 1 / (1 + F.exp(-F.col("z")))
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")]
    paths = written(found.groupBy("host", "path").agg(*sums), "path-evidence")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsq"])
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mu = min(1 - 1e-6, max(1e-6, total[1] / total[0])) if total[0] else 0.5
    of_host = _strength(hosts, F.lit(mu))
    with_host = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    mean = (of_host * mu + F.col("hs")) / (of_host + F.col("hn"))
    of_path = _strength(with_host, mean)
    # A path or host may have a third of all rows: its row is copied under salts, and documents are dealt out over them.
    prior = with_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"host": "h", "path": "pa", "salt": "sa"})
    rows = found.withColumn("p", p).withColumn("salt", F.pmod(F.xxhash64("key", "of"), F.lit(SALTS)).cast("int"))
    both = rows.join(prior, (F.col("host") == F.col("h")) & (F.col("path") == F.col("pa")) & (F.col("salt") == F.col("sa")))
    host = (of_host * mu + F.col("hs") - F.col("p")) / (of_host + F.col("hn") - 1)
    path = (of_path * F.col("host_posterior") + F.col("s") - F.col("p")) / (of_path + F.col("n") - 1)
    bounded = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    both = both.withColumn("host_posterior", bounded(host)).withColumn("path_posterior", bounded(path))
    logit = F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    z = F.col("z") - float(np.log(mu / (1 - mu))) + logit
    return both.select("key", "of", "host", "path", F.col("p").alias("p_doc"), "host_posterior", "path_posterior", (1 / (1 + F.exp(-z))).alias("quality"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """key, host, path, p_doc, host_posterior, path_posterior, quality (0 to 1) and accepted of every row.

    A null or empty text has the lowest evidence. Null hosts and paths are groups of their own. Repeated rows count and
    stay; null keys stay; other columns are ignored; an empty table gives an empty result. Without labels of both kinds
    the classifier says the same of all texts. The text isn't shuffled: rows with log odds are written and joined.
    """
    found = written(evidence(docs, learn(docs, labels, key, text), key, text, host, path), "evidence")
    return posteriors(found).select(F.col("key").alias(key), F.col("host").alias("host"), F.col("path").alias("path"), "p_doc", "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("accepted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` accepts, with their columns.

    Rows with one key and one text go or stay together, also where the key is null; a null text is rejected, an empty
    table stays empty, columns of any other name are carried along.
    """
    found = written(evidence(docs, learn(docs, labels, key, text), key, text, host, path), "evidence")
    rejected = posteriors(found).where(F.col("quality") < threshold).select(F.col("key").alias("_k"), F.col("of").alias("_of")).distinct()
    return docs.join(rejected, docs[key].eqNullSafe(F.col("_k")) & (F.xxhash64(docs[text]) == F.col("_of")), "left_anti").select(*docs.columns)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
