"""Operator 7, near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its word triples (lower-cased; a text of one or two words is one shorter tuple). Triples are
hashed to [0, UNIVERSE), a first permutation scatters them, and signature coordinate k is the least value that the
second permutation, circularly shifted by k, gives to any of them: two permutations make all BANDS * ROWS coordinates.
ROWS coordinates make a band; texts that agree in a band are candidates, and an edge needs an exact Jaccard similarity
of at least THRESHOLD, computed on the triples themselves. Groups are the connected components of the edges.

Candidates aren't capped, nor are all pairs of a bucket tested: first each text is tested with the least text of its
buckets, then all pairs of a bucket that aren't connected yet. A pair left out is connected already, so the components
are those of testing every pair. Equal texts are one node throughout: a worker signs a text once, and later copies of it
add no bands. A node is a 64-bit hash of the text; two different texts with equal hashes would count as copies.

Defined results: null texts and texts without words are in no group (as duplicates they are left alone); a null doc_id
may be a member, but the kept one is the least non-null doc_id (of several texts under it, that of the least hash);
repeated rows are members of one group, of which one row stays, the one whose columns have the least hash; an empty
table gives no rows; other columns don't matter and pass through remove_near_duplicates() as they are. Very long texts
are used whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

THRESHOLD = 0.5
BANDS = 40
ROWS = 4
UNIVERSE = 1 << 20
#: Members of one least text that are verified in one group of rows; larger ones are spread, with the least text copied to each.
SPREAD = 5000
#: Texts whose signing a worker remembers at once; a text forgotten is signed again, with the same bands.
KNOWN = 500_000
SEED = 7


def shingles(text: str) -> set[tuple[str, ...]]:
    words = common.WORD.findall(text.lower())
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)} if words else set()


def permutations(size: int = UNIVERSE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.permutation(size).astype(np.int32), rng.permutation(size).astype(np.int32)


class Signer:
    """Signatures and band names of texts."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, universe: int = UNIVERSE):
        self.bands, self.rows, self.universe = bands, rows, universe
        self.first, second = permutations(universe)
        turned = np.concatenate([second, second[: bands * rows]])
        self.shifted = sliding_window_view(turned, bands * rows)
        self.known: dict[str, int] = {}

    def elements(self, words: list[str]) -> np.ndarray:
        """The triples' places in the universe."""
        import xxhash

        known = self.known
        if len(known) > 400_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        if len(h) > 2:
            h = h[:-2] * a + (h[1:-1] ^ (h[1:-1] >> np.uint64(31))) * b + (h[2:] ^ (h[2:] >> np.uint64(29))) * c
        else:
            h = np.array([sum(int(x) * (2 * i + 3) for i, x in enumerate(h)) & (2**64 - 1)], dtype=np.uint64)
        h ^= h >> np.uint64(32)
        h *= b
        h ^= h >> np.uint64(29)
        return (h % np.uint64(self.universe)).astype(np.int64)

    def signature(self, words: list[str]) -> np.ndarray:
        places = self.first[self.elements(words)]
        least = np.full(self.bands * self.rows, self.universe, dtype=np.int32)
        for at in range(0, len(places), 4096):
            np.minimum(least, self.shifted[places[at : at + 4096]].min(axis=0), out=least)
        return least

    def names(self, words: list[str]) -> np.ndarray:
        parts = self.signature(words).reshape(self.bands, self.rows).astype(np.uint64)
        h = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(self.rows):
            h = (h ^ parts[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
        return h.view(np.int64)


def _node():
    return F.xxhash64(F.col("text").cast("string"))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, bands) of documents that have words; node is a hash of the text. bands is null for texts that the worker has signed already."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        seen: set[int] = set()
        for batch in common.slices(batches, "text"):
            if len(seen) > KNOWN:
                seen.clear()
            some, names = [], []
            for node, t in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if node in seen:
                    some.append(True)
                    names.append(None)
                elif words := common.WORD.findall((t.as_py() or "").lower()):
                    seen.add(node)
                    some.append(True)
                    names.append(signer.names(words))
                else:
                    some.append(False)
            ids, nodes = (batch.column(k).filter(pa.array(some, pa.bool_())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, nodes, pa.array(names, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _node().alias("node"), F.col("text").cast("string").alias("text")).mapInArrow(sign, "doc_id bigint, node bigint, bands array<bigint>")


def _verify(groups: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (lead, salt, role, node, text), sorted so that the lead's own text (role 0) comes before its members (role 1)."""
    lead, own = None, set()
    for batch in common.slices(groups, "text"):
        a, b, j = [], [], []
        for key, salt, role, node, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if role == 0:
                if (key, salt) != lead:
                    lead, own = (key, salt), shingles(text)
            else:
                other = shingles(text)
                both = len(own & other)
                if (similarity := both / (len(own) + len(other) - both)) >= threshold:
                    a.append(key)
                    b.append(node)
                    j.append(similarity)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j, pa.float64())], ["a", "b", "jaccard"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, spread: int = SPREAD) -> DataFrame:
    """Of pairs (a, b), a < b, those whose texts' exact Jaccard similarity reaches the threshold. texts: (node, text)."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(spread)).alias("parts"))
    placed = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    roles = placed.selectExpr("b node", "a lead", "salt", "1 role").union(placed.selectExpr("a node", "a lead", "salt", "0 role").distinct())
    rows = roles.join(texts, "node").select("lead", "salt", "role", "node", "text")
    grouped = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "role")
    return grouped.mapInArrow(lambda batches: _verify(batches, threshold), "a bigint, b bigint, jaccard double")


def near_duplicate_nodes(docs: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the texts that have a near-duplicate with another text."""
    exploded = signed.where("bands is not null").select("node", F.explode("bands").alias("band"))
    leads = exploded.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("band", "lead")
    shared = common.written(exploded.join(leads, "band").distinct(), "shared-bands")
    wanted = shared.select("node").distinct()
    numbered = docs.select(_node().alias("node"), F.col("text").cast("string").alias("text")).join(wanted, "node")
    texts = common.written(numbered.dropDuplicates(["node"]), "candidate-texts")
    first = shared.where("lead < node").groupBy(F.col("node").alias("b")).agg(F.min("lead").alias("a"))
    edges = common.checkpoint(verified(first, texts, threshold).select("a", "b"))
    roots = components(edges)
    labelled = shared.select("band", "node").join(roots, "node", "left").selectExpr("band", "node", "coalesce(root, node) root")
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    several = common.checkpoint(labelled.join(mixed, "band"))
    left, right = several.toDF("band", "a", "ra"), several.toDF("band", "b", "rb")
    rest = left.join(right, "band").where("a < b and ra <> rb").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    more = common.checkpoint(verified(common.checkpoint(rest), texts, threshold).select("a", "b"))
    return components(edges.union(more))


def _memberships(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, node, root) of every document with words; root is its node where no other text is near."""
    signed = common.written(signatures(docs), "signatures")
    roots = near_duplicate_nodes(docs, signed, threshold)
    return signed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def _kept(members: DataFrame) -> DataFrame:
    """(root, keep_id, keep_node, size) of groups of two documents or more."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    grouped = members.groupBy("root").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return grouped.selectExpr("root", "keep.doc_id keep_id", "keep.node keep_node", "size group_size")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document that is in a group of two or more: doc_id, keep_id (the group's least doc_id, which stays), group_size, kept."""
    members = common.checkpoint(_memberships(docs, threshold))
    rows = members.join(_kept(members), "root")
    return rows.selectExpr("doc_id", "keep_id", "group_size", "doc_id <=> keep_id and node = keep_node as kept")


def remove_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, of each group only the kept one."""
    members = common.checkpoint(_memberships(docs, threshold))
    in_groups = members.join(_kept(members), "root").groupBy("node", "doc_id").agg(F.max(F.expr("doc_id <=> keep_id and node = keep_node")).alias("kept_"), F.count(F.lit(1)).alias("times_"))
    # what goes, and what stays once of several rows
    judged = common.checkpoint(in_groups.where("not kept_ or times_ > 1").selectExpr("node n_", "doc_id d_", "kept_"))
    rows = docs.select(F.struct("*").alias("row_"), F.when(F.col("text").isNotNull(), _node()).alias("l_"), F.col("doc_id").cast("bigint").alias("e_"))
    same = (F.col("l_") == F.col("n_")) & F.col("e_").eqNullSafe(F.col("d_"))
    repeated = rows.join(judged.where("kept_"), same, "left_semi")
    plain = [F.col("row_").getField(c) for c, kind in docs.dtypes if "map<" not in kind]
    once = repeated.groupBy("l_", "e_").agg(F.min_by("row_", F.xxhash64(*plain)).alias("row_"))
    return rows.join(judged, same, "left_anti").select("row_").union(once.select("row_")).select("row_.*")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
