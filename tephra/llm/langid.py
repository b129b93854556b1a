"""Language identification in two steps: the language family, then one-versus-one linear SVMs inside it.

A text becomes counts of hashed byte trigrams of its letters. A linear machine for each family (one against the rest)
picks the family; inside a family a linear machine for each pair of its languages votes. All machines are linear in
the trigram frequencies and are trained in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Families of language codes (fixed values); a language that is in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
}
#: Labelled rows that the machines are trained on: of each language, and in all.
TRAIN_PER_LANGUAGE = 800
TRAIN_ROWS = 4000
#: Languages that can be learned: the most frequent labels, ties by name. Each gets at least MIN_PER_LANGUAGE rows, so
#: with very many languages there are more than TRAIN_ROWS in all.
MAX_LANGUAGES = 1000
MIN_PER_LANGUAGE = 8
BUCKETS = 4096
#: A document is rejected by the filter below this score. The machines alone never say less than a half for each of the
#: two steps; a text in no learned language falls below by how little of it is known (see ``known``).
MIN_SCORE = 0.25
#: A bucket is known to a language from this share of its trigrams. Texts of which less than KNOWN_FROM of the usual
#: share is known get no score, from KNOWN_FULL on the score is that of the machines.
KNOWN_BUCKET = 2e-5
KNOWN_FROM, KNOWN_FULL = 0.5, 0.8
#: Bytes of letters counted at once.
COUNT_BYTES = 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters_of(text: str | None) -> bytes:
    """The text's letters in lower case, one space between words and at both ends; empty if it has no letter."""
    if not text:
        return b""
    raw = text.lower().encode()
    if raw.isascii():
        words = raw.translate(_LETTERS).split()
    elif any(c.isalpha() for c in text):
        words = raw.translate(_LETTERS).split()
    else:
        return b""
    return b" " + b" ".join(words) + b" " if words else b""


def counts(letters: list[bytes]) -> np.ndarray:
    """Trigram frequencies (rows that sum to one, or to zero without trigrams), len(letters) x BUCKETS."""
    out = np.zeros((len(letters), BUCKETS), np.float32)
    for i, raw in enumerate(letters):
        if len(raw) < 3:
            continue
        total = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(raw) - 2, COUNT_BYTES):
            b = np.frombuffer(raw[at : at + COUNT_BYTES + 2], np.uint8).astype(np.uint32)
            code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
            total += np.bincount(code * np.uint32(2654435761) >> np.uint32(20), minlength=BUCKETS)
        out[i] = total / total.sum()
    return out


def family_of(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def train_svm(xb: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, y in -1, +1, classes weighted alike; accelerated gradient steps.

    ``xb`` has a last column of ones, whose weight is the bias.
    """
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = np.float32(1.0 / (2 * float(weight @ np.einsum("ij,ij->i", xb, xb)) + l2))
    l2 = np.float32(l2)
    w = v = np.zeros(xb.shape[1], np.float32)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (xb @ v))
        new = v + rate * (2 * ((weight * y * slack) @ xb) - l2 * v)
        v = new + np.float32(step / (step + 3)) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    """families: name -> languages. Machines of the families (name) and of pairs of languages (a, b), a wins above 0.

    ``known`` has a row for each language: which buckets its texts fill; ``usual`` what share of its texts they hold.
    """

    families: dict[str, list[str]]
    names: list
    weights: np.ndarray
    bias: np.ndarray
    langs: list[str]
    known: np.ndarray
    usual: np.ndarray

    @classmethod
    def train(cls, xb: np.ndarray, langs: list[str]) -> LanguageModel:
        """``xb``: trigram frequencies and a column of ones; it is scaled in place."""
        families: dict[str, list[str]] = {}
        own = sorted(set(langs))
        for lang in own:
            families.setdefault(family_of(lang), []).append(lang)
        lang, family = np.array(langs, object), np.array([family_of(v) for v in langs], object)
        x = xb[:, :-1]
        known, usual = np.zeros((len(own), BUCKETS), bool), np.ones(len(own))
        for i, name in enumerate(own):
            rows = np.flatnonzero(lang == name)
            total = np.zeros(BUCKETS)
            for at in range(0, len(rows), 256):
                total += x[rows[at : at + 256]].sum(axis=0)
            known[i] = total / len(rows) >= KNOWN_BUCKET
            usual[i] = max(1e-6, np.median([x[r][known[i]].sum() for r in rows]))
        scale = (1 / np.sqrt(x.mean(axis=0) + 1e-5) if len(x) else np.ones(BUCKETS)).astype(np.float32)
        x *= scale
        names, weights = [], []
        jobs = [(f, None, family == f) for f in families] if len(families) > 1 else []
        jobs += [((a, b), (lang == a) | (lang == b), lang == a) for some in families.values() for a, b in combinations(some, 2)]
        for name, rows, positive in jobs:
            names.append(name)
            weights.append(train_svm(xb if rows is None else xb[rows], np.where(positive if rows is None else positive[rows], 1.0, -1.0)))
        w = np.array(weights, np.float32).reshape(len(names), BUCKETS + 1)
        return cls(families, names, w[:, :-1] * scale, w[:, -1].astype(float), own, known, usual)

    def predict(self, letters: list[bytes]) -> list[tuple[str, float]]:
        """Language and score; ``und`` and 0 for a text without letters, or if nothing was learned."""
        x = counts(letters)
        margins = x @ self.weights.T + self.bias if self.names else np.zeros((len(letters), 0))
        sure = 1 / (1 + np.exp(-4 * np.clip(margins, -20, 20)))
        at, row = {n: i for i, n in enumerate(self.names)}, {n: i for i, n in enumerate(self.langs)}
        out = []
        for raw, f, m, p in zip(letters, x, margins, sure):
            if not raw or not self.families:
                out.append(("und", 0.0))
                continue
            family = max(self.families, key=lambda f: m[at[f]]) if len(self.families) > 1 else next(iter(self.families))
            score = float(p[at[family]]) if len(self.families) > 1 else 1.0
            own = self.families[family]
            if len(own) > 1:
                votes = dict.fromkeys(own, 0.0)
                for a, b in combinations(own, 2):
                    i = at[a, b]
                    votes[a if m[i] > 0 else b] += 1 + abs(np.tanh(m[i])) / 1e3  # margins part ties
                best = max(own, key=votes.__getitem__)
                score *= min(float(p[at[a, b]] if a == best else 1 - p[at[a, b]]) for a, b in combinations(own, 2) if best in (a, b))
            else:
                best = own[0]
            i = row[best]
            share = float(f[self.known[i]].sum()) / self.usual[i]
            out.append((best, score * min(1.0, max(0.0, (share - KNOWN_FROM) / (KNOWN_FULL - KNOWN_FROM)))))
        return out


def held_out(key: str):
    """crc32 of the key as text modulo 5 is 0; rows with a null key are held out too."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Train on rows that aren't held out and have a label, picked by the key's hash.

    At most TRAIN_PER_LANGUAGE of each of the MAX_LANGUAGES most frequent languages, and TRAIN_ROWS or MIN_PER_LANGUAGE
    of each in all. A rarer label can't be learned. The sample reaches the driver as the filled buckets alone.
    """
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(key))  # counted without reading the texts
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES).collect()}
    each = max(MIN_PER_LANGUAGE, min(TRAIN_PER_LANGUAGE, TRAIN_ROWS // max(1, len(sizes))))
    parts = [F.lit(v) for name, n in sizes.items() for v in (name, min(1.0, 0.9 * each / n) if n > each else 1.0)]
    part = F.coalesce(F.create_map(*parts)[F.col(lang)], F.lit(0.0)) if parts else F.lit(0.0)
    picked = rows.where(F.col(text).isNotNull()).where(F.pmod(F.xxhash64(F.col(key), F.lit("language sample")), F.lit(1 << 30)) < part * (1 << 30)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def make():
        def run(batch: pa.RecordBatch):
            got = counts([letters_of(t) for t in batch.column(1).to_pylist()])
            filled = [np.flatnonzero(r) for r in got]
            return {"lang": batch.column(0), "at": [i.astype("<u2").tobytes() for i in filled], "share": [r[i].astype("<f4").tobytes() for r, i in zip(got, filled)]}

        return run

    bound = max(TRAIN_ROWS, MIN_PER_LANGUAGE * len(sizes))
    sample = map_texts(picked, make, "lang string, at binary, share binary", rows=64).limit(bound).collect()
    xb = np.zeros((len(sample), BUCKETS + 1), np.float32)
    xb[:, -1] = 1
    for i, r in enumerate(sample):
        xb[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["share"], "<f4")
    return LanguageModel.train(xb, [r["lang"] for r in sample])


def _predicted(rows: DataFrame, model: LanguageModel, schema: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each machine

    def make():
        def run(batch: pa.RecordBatch):
            found = sent.value.predict([letters_of(t) for t in batch.column(batch.num_columns - 1).to_pylist()])
            return {n: batch.column(i) for i, n in enumerate(batch.schema.names[:-1])} | {"lang_pred": [a for a, _ in found], "score": [s for _, s in found]}

        return run

    return map_texts(rows, make, schema, rows=64)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred and score (0 to 1) of every row.

    Learns from the rows of ``docs`` that have a label and aren't held out; only the text is an input of a prediction.
    A text that is null or without letters is ``und`` with score 0, and so is all if nothing could be learned. Repeated
    rows and null keys stay; other columns are ignored. No shuffle but for the languages' counts.
    """
    model = learn(docs, key, text, lang)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(docs[key].alias("key"), held_out(key).alias("held_out"), docs[text].alias("text"))
    return _predicted(rows, model, f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is found with a score of at least ``min_score``.

    A null text, one without letters and one in no learned language go. A row is judged by its text alone: repeated rows
    stay or go together, null keys are kept like others, an empty table stays empty. If nothing could be learned, all go.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text, lang))
    place = docs.columns.index(text)

    def run(batches):
        from .common import slices

        for batch in slices(batches, 64):
            found = sent.value.predict([letters_of(t) for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([a != "und" and s >= min_score for a, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
