"""Near copies by five-word shingles: SimHash and MinHash candidates, of which the exact similarity decides.

Two texts are linked if the Jaccard similarity of their sets of SHINGLE words in a row is SIMILARITY or more. Candidates
come from the SimHash index (fingerprints of the same shingles within MAX_DISTANCE bits) and, as similar texts can lie
many bits apart, from BANDS keys, each of ROWS least hashes: a pair of similarity s has no key in common with
probability (1 - s^5)^32, which is 3 in a million at 0.8 and less above. Only texts of different words are indexed:
copies are one row there.

A key that at most HOT_KEY texts have gives all its pairs, a number bounded for each row. Under a hotter one each text is
compared with one of them, which joins a large group of near copies in one component, and in TURNS further turns with
another one, drawn anew, if that lies in another component. Pairs of one component need no comparison. What lies in
several components under one hot key after that, such as texts around one common passage, is indexed a second time by its
rarest shingles (prefix filter): two sets of similarity 0.8 have one of their rarest fifth in common, so no pair is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_merge, discard, map_texts, scratch, written
from .simhash import MAX_DISTANCE, SEED, components, majority, shingle_hashes, words_of
from .simhash import links as simhash_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Different texts under one key from which they are first compared with one of them, not all with each other.
HOT_KEY = 4
#: Further turns in which texts under a hot key are compared with one of them in another component.
TURNS = 4
#: Cells in which shingles of texts under hot keys are counted.
BUCKETS = 1 << 18
SALTS = 8


_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles, as signed longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):  # bounded memory for very long texts
        np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _id(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles; without words that of the empty text."""
    return np.unique(shingle_hashes(words, SHINGLE)) if words else np.array([_id(words)], np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, id (a hash of the text's words: equal for copies), size (different shingles), fp (SimHash of the shingles) and bands of every row; a null text counts as one without words."""
    kind = dict(docs.dtypes)[key]

    def make():
        def run(batch: pa.RecordBatch):
            ids, sizes, prints, keys = [], [], [], []
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                hashes = shingle_hashes(words, SHINGLE)
                ids.append(_id(words))
                prints.append(majority(hashes))
                distinct = np.unique(hashes) if words else np.array([_id(words)], np.uint64)
                sizes.append(len(distinct))
                keys.append(bands(distinct))
            return {"key": batch.column(0), "id": np.array(ids, np.uint64).view(np.int64), "size": sizes, "fp": np.array(prints, np.uint64).view(np.int64), "bands": pa.array(keys, pa.list_(pa.int64()))}

        return run

    return map_texts(docs.select(docs[key].alias("key"), docs[text].alias("text")), make, f"key {kind}, id long, size long, fp long, bands array<long>").withColumnRenamed("key", key)


def _shared(keyed: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``keyed`` under keys that several ids have, with their number n."""
    sizes = keyed.groupBy(on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return keyed.join(by_merge(sizes), on)


#: Texts of sizes (sa, sb) that differ more can't be similar: known before any set is moved.
_FIT = "5 * least(sa, sb) >= 4 * greatest(sa, sb)"


def _pairs(rows: DataFrame, on: list[str]) -> DataFrame:
    """All pairs (a, b), a < b, of ids of fitting sizes under one key."""
    x, y = (rows.select(*on, F.col("id").alias(i), F.col("size").alias(f"s{i}")) for i in "ab")
    return x.join(by_merge(y), on).where((F.col("a") < F.col("b")) & F.expr(_FIT)).select("a", "b")


def _with_pivots(rows: DataFrame, pivots: DataFrame, on: list[str]) -> DataFrame:
    """The rows with their key's pivot. A key may have a third of all ids: its pivot is copied under salts."""
    copies = pivots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).cast("int")).join(by_merge(copies), [*on, "_salt"])


def _pivot_pairs(hot: DataFrame, on: list[str]) -> DataFrame:
    """Each id with the least id under its key, if their sizes fit."""
    pivots = hot.groupBy(*on).agg(F.min(F.struct("id", "size")).alias("d")).select(*on, F.col("d.id").alias("a"), F.col("d.size").alias("sa"))
    met = _with_pivots(hot.withColumnRenamed("size", "sb"), pivots, on)
    return met.where((F.col("id") != F.col("a")) & F.expr(_FIT)).select("a", F.col("id").alias("b"))


def _turn_pairs(rest: DataFrame, on: list[str], turn: int) -> DataFrame:
    """Each id with one that is drawn for this turn among those under its key, if that lies in another component: a pair a row at most."""
    drawn = rest.groupBy(*on).agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("o"), F.col("id").alias("p"), F.col("size").alias("sa"), F.col("root").alias("of"))).alias("d"))
    met = _with_pivots(rest.withColumnRenamed("size", "sb"), drawn.select(*on, "d.p", "d.sa", "d.of"), on)
    return met.where((F.col("root") != F.col("of")) & F.expr(_FIT)).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def _prefix_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ids (id, root) of different roots that can be similar; none that is similar is missing.

    The shingles of each set are put in one order, rarest first; how rare they are is counted in BUCKETS cells, a table
    of fixed size. Sets of n >= m shingles of similarity 0.8 have at least 4 / 9 (n + m) in common, so the first of these
    lies in the first n - 4/5 n + 1 of the larger and the first m - 8/9 m + 1 of the smaller, and behind it enough are
    left in both. That holds for any order: cells that hold several shingles cost comparisons, not pairs.
    """
    own = rest.select("id", "root").distinct().join(sets, "id").select("id", "root", "set")
    cells = own.select(F.explode("set").alias("t")).groupBy(F.pmod("t", F.lit(BUCKETS)).alias("cell")).agg(F.count(F.lit(1)).alias("c")).toArrow()  # BUCKETS rows at most
    often = np.zeros(BUCKETS, np.int64)
    often[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    sent = rest.sparkSession.sparkContext.broadcast(often)

    def make():
        def run(batch: pa.RecordBatch):
            out: dict[str, list] = {"id": [], "root": [], "n": [], "pos": [], "t": []}
            for i, root, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)):
                n = len(s)
                c = sent.value[np.mod(s, BUCKETS)]
                first = np.lexsort((s, c))[: n - (4 * n + 4) // 5 + 1]
                shared = np.flatnonzero(c[first] > 1)  # a shingle that is alone in its cell is in no other set
                for name, v in (("id", np.full(len(shared), i)), ("root", np.full(len(shared), root)), ("n", np.full(len(shared), n)), ("pos", shared), ("t", s[first[shared]])):
                    out[name].append(v.astype(np.int64))
            return {name: np.concatenate(v) for name, v in out.items()}

        return run

    rows = written(map_texts(own, make, "id long, root long, n long, pos long, t long", rows=64), "prefixes")
    x, y = rows.alias("x"), rows.where("pos < n - (8 * n + 8) div 9 + 1").alias("y")
    fits = F.expr("x.t = y.t AND x.root != y.root AND x.n >= y.n AND 5 * y.n >= 4 * x.n AND 9 * least(x.n - x.pos, y.n - y.pos) >= 4 * (x.n + y.n)")
    return x.join(by_merge(y), fits).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _simhash_pairs(classes: DataFrame) -> DataFrame:
    """The least id of a fingerprint with its other ids, and the least ids of linked fingerprints: in proportion to the ids and links."""
    least = classes.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("d")).select("fp", F.col("d.id").alias("p"), F.col("d.size").alias("sp"))
    same = classes.join(least, "fp").where(F.col("id") != F.col("p")).select(F.col("p").alias("a"), F.col("id").alias("b"), F.col("sp").alias("sa"), F.col("size").alias("sb"))
    linked = simhash_links(least.select("fp"), distance=MAX_DISTANCE).withColumnsRenamed({"a": "fa", "b": "fb"})
    for i in "ab":
        linked = linked.join(least.toDF(f"f{i}", f"p{i}", f"s{i}"), f"f{i}")
    near = linked.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "sa", "sb")
    return same.unionByName(near).where(_FIT).select("a", "b")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """id and set (shingles) of the wanted ids: of the rows with a class's least key those with its words, each id once."""
    chosen = classes.join(by_merge(wanted), "id", "left_semi").select("id", F.col("least").alias("_k"))

    def make():
        def run(batch: pa.RecordBatch):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            own = np.array([_id(w) for w in words], np.uint64).view(np.int64)
            keep = np.flatnonzero(own == batch.column(0).to_numpy())
            return {"id": own[keep], "set": pa.array([shingles(words[i]).view(np.int64) for i in keep.tolist()], pa.list_(pa.int64()))}

        return run

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text")).join(chosen, F.col("_key") == F.col("_k"))
    sets = map_texts(rows.select("id", "_text"), make, "id long, set array<long>", rows=64)
    return sets.dropDuplicates(["id"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose exact similarity is SIMILARITY or more."""

    def make():
        def run(batch: pa.RecordBatch):
            a, b = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            keep = pa.array([similarity(x, y) >= SIMILARITY for x, y in zip(a, b)], pa.bool_())
            return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

        return run

    filled = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return map_texts(filled.select("a", "b", "x", "y"), make, "a long, b long", rows=256)


def _crossing(hot: DataFrame, on: list[str], roots: DataFrame) -> DataFrame:
    """The rows (with root) of hot keys under which several components lie."""
    named = hot.select(*on, "id", "size").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).select(*on, "id", "size", "root")
    mixed = named.groupBy(on).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where(F.col("_lo") < F.col("_hi"))
    return named.join(mixed.select(*on), on, "left_semi")


def link_roots(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """node and root (least id of its component) of all ids with a link. ``classes``: written; id, least (key), size, fp and bands of the different texts."""
    first = ["band", "h"]
    shared = written(_shared(classes.select("id", "size", F.posexplode("bands").alias(*first)), first), "band-keys")  # rows under keys that one text alone has are gone
    hot = shared.where(F.col("n") > hot_key)
    found = _pairs(shared.where(F.col("n") <= hot_key), first).unionByName(_pivot_pairs(hot, first)).unionByName(_simhash_pairs(classes))
    pairs = written(found.distinct(), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(hot.select("id")).distinct()
    sets = written(_sets(docs, classes, wanted, key, text), "shingle-sets")
    roots = components(written(_similar(pairs, sets), "similar"))
    rest = written(_crossing(hot, first, roots), "crossing")

    def joined(pairs: DataFrame) -> DataFrame:
        """The components with what is similar among ``pairs``: a component counts as a star, whatever its links."""
        stars = roots.where(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b"))
        return components(written(stars.unionByName(_similar(written(pairs, "across"), sets)), "similar"))

    for turn in range(TURNS):
        if rest.isEmpty():
            return roots
        roots = joined(_turn_pairs(rest, first, turn))
        rest = written(_crossing(rest.drop("root"), first, roots), "crossing")
    return roots if rest.isEmpty() else joined(_prefix_pairs(rest, sets))


def kept_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """_keep: the least key of every component of the rows with a key, each once. Written; all that was written before goes."""
    with scratch() as stays:
        signed = written(signatures(docs, key, text), "signatures")
        classes = written(signed.groupBy("id").agg(F.min(key).alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
        discard(signed)
        roots = link_roots(docs, classes, key, text, hot_key)
        of_class = classes.join(roots, F.col("id") == F.col("node"), "left").select("least", F.coalesce("root", "id").alias("root"))
        return stays(written(of_class.groupBy("root").agg(F.min("least").alias("_keep")).select("_keep").distinct(), "kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """The rows of ``docs`` with the least key of their component of linked texts; of rows that repeat that key one stays. Columns stay.

    Rows with a null key can't be named by a component: they are left out of the comparison, and one of each text stays.
    """
    named = docs.where(F.col(key).isNotNull())
    keep = kept_keys(named, key, text, hot_key)
    rows = named.join(by_merge(keep), F.col(key) == F.col("_keep"), "left_semi").dropDuplicates([key])
    return rows.unionByName(docs.where(F.col(key).isNull()).dropDuplicates([text]))
