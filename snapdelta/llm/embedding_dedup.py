"""Operator 8, near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated at random and keeps the signs of its coordinates as its code, and as its correction factor f
the inner product of the vector with its code read as a unit vector. As a query a vector keeps its rotated coordinates
in four bit planes. The inner product of query and code, counted by the bits they share, over f estimates that of the
two vectors without bias; it errs by more than EPSILON * sqrt((1 - f^2) / f^2 / (dim - 1)) only with small probability.
Pairs whose upper confidence bound reaches the threshold are recomputed exactly; the rest need no vectors at all.

Every vector is indexed and every vector is a query; nothing is fitted. Candidates agree in a band of signs under
further rotations: an index entry is a vector's own band value, and as a query it also looks where its FLIPS least
certain signs of the band are turned. A band has a few bits more than number the vectors, and bands are as many as find a pair at the threshold with probability RECALL by a simulation at that
dimension, nearer pairs with more. No bucket is capped: first each member is tested with the least entry of its bucket,
then all pairs of a bucket that aren't connected yet. Within each component so found all pairs are then decided, block
by block, by the same bounds, so links missed by the bands inside a component are counted too.

The result is one row per distinct (vec_id, vector): class_id, the least vec_id of the component, and links, how many
other such rows are at least THRESHOLD near, copies included. No pairs are listed, so a group of copies or near-copies
costs a row each.

Defined results: a null id, and a null, empty or zero vector or one with null or non-finite coordinates, have a row with
null class_id and 0 links and are nobody's link; vectors of different lengths are never near, and each length is
searched; repeated rows count once, two vectors of one id are two rows; a vector without links is its own class; an
empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

THRESHOLD = 0.95
RECALL = 0.98
EPSILON = 3.0
PLANES = 4
FLIPS = 2
SPARE_BITS = 3
#: Vectors of a component that are compared with as many others at once.
BLOCK = 1024
SEED = 5
CODE = "id bigint, code binary, planes binary, factor double, low double, step double, total double, bands array<bigint>"


@cache
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@cache
def planes_of(dim: int, bits: int, bands: int) -> np.ndarray:
    """The directions of all bands' signs."""
    return np.concatenate([rotation(dim, SEED + 2 + k) for k in range(-(-bits * bands // dim))])[: bits * bands]


def _turned(values: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """Band values, then those with the least certain signs turned: one, the other, both."""
    least = np.argsort(margins, axis=-1)[..., :FLIPS]
    masks = np.left_shift(np.uint64(1), least.astype(np.uint64))
    out = [values]
    for k in range(masks.shape[-1]):
        out += [v ^ masks[..., k] for v in out]
    return np.stack(out, axis=-1)


@cache
def bands_needed(dim: int, bits: int, threshold: float, recall: float, trials: int = 2000) -> int:
    """How many bands find a pair at the threshold with this probability, by simulated pairs."""
    if dim < 2:
        return 1
    rng = np.random.default_rng(SEED)
    x, z = rng.normal(size=(2, trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    a, b = (v @ planes_of(dim, bits, 1).T for v in (x, y))
    differ = (a > 0) != (b > 0)
    missed = np.ones(trials, dtype=bool)
    for side in (a, b):
        rest = differ.copy()
        np.put_along_axis(rest, np.argsort(np.abs(side), axis=1)[:, :FLIPS], False, axis=1)
        missed &= rest.any(axis=1)
    hit = min(max(1 - missed.mean(), 1 / trials), 1 - 1e-9)
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    width = -(-bits.shape[1] // 64) * 64
    padded = np.zeros((len(bits), width), dtype=np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """Codes, correction factors and query planes of unit vectors."""
    dim = vectors.shape[1]
    turned = vectors @ rotation(dim, seed).T
    low, high = turned.min(axis=1), turned.max(axis=1)
    step = np.maximum(high - low, 1e-12) / (2**PLANES - 1)
    dither = np.random.default_rng(seed + 1).random(dim)
    level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, 2**PLANES - 1).astype(np.int64)
    planes = np.stack([_packed((level >> k) & 1) for k in range(PLANES)], axis=1)
    return {"code": _packed(turned > 0), "planes": planes, "factor": np.abs(turned).sum(axis=1) / math.sqrt(dim), "low": low, "step": step, "total": turned.sum(axis=1)}


def upper_bound(dim: int, code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, total: np.ndarray, epsilon: float) -> np.ndarray:
    """Of the inner products of coded vectors and queries, given by arrays that broadcast against each other; words are the last axis."""
    both = sum(np.bitwise_count(code & planes[..., k, :]).sum(axis=-1, dtype=np.float64) * (1 << k) for k in range(PLANES))
    on = low * np.bitwise_count(code).sum(axis=-1, dtype=np.float64) + step * both
    estimate = (2 * on - total) / math.sqrt(dim) / factor
    return estimate + epsilon * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1)) + step / 2


def band_values(vectors: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """(vector, band, entry): a band's own value first, then those it asks for."""
    dim = vectors.shape[1]
    signs = (vectors @ planes_of(dim, bits, bands).T).reshape(len(vectors), bands, bits)
    own = (signs > 0).astype(np.uint64) @ np.left_shift(np.uint64(1), np.arange(bits, dtype=np.uint64))
    salt = np.array([[(k * 0x9E3779B97F4A7C15 + dim * 0xC2B2AE3D27D4EB4F) % 2**64] for k in range(1, bands + 1)], dtype=np.uint64)
    mixed = (_turned(own, np.abs(signs)) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a list column, by length."""
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(vectors: DataFrame, threshold: float, recall: float) -> DataFrame:
    """CODE of vectors (id, v); bands has each band's own value and after it those asked for."""
    n = max(vectors.count(), 1)
    bits = min(math.ceil(math.log2(n + 1)) + SPARE_BITS, 60)

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, x in by_length(batch.column(1)) if batch.num_rows else ():
                dim = x.shape[1]
                made = encode(x)
                values = band_values(x, bits, bands_needed(dim, bits, threshold, recall)).reshape(len(x), -1)
                offsets = pa.array(np.arange(len(x) + 1) * values.shape[1], pa.int32())
                blobs = {k: pa.array([row.tobytes() for row in made[k]], pa.binary()) for k in ("code", "planes")}
                yield pa.RecordBatch.from_pydict({"id": ids.take(pa.array(rows)), **blobs, **{k: pa.array(made[k], pa.float64()) for k in ("factor", "low", "step", "total")}, "bands": pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))})

    return vectors.select("id", "v").mapInArrow(codes, CODE)


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def verified(pairs: DataFrame, coded: DataFrame, vectors: DataFrame, threshold: float, epsilon: float) -> DataFrame:
    """Of pairs (a, b) those whose bound and then whose exact cosine reach the threshold."""

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(batch.column("dim"))
            keep = np.zeros(len(sizes), dtype=bool)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                own = batch.take(pa.array(rows))
                words = -(-dim // 64)
                code, planes = (np.frombuffer(b"".join(own.column(c).to_pylist()), dtype=np.uint64) for c in ("code", "planes"))
                numbers = [np.asarray(own.column(c)) for c in ("low", "step", "total")]
                keep[rows] = upper_bound(dim, code.reshape(-1, words), np.asarray(own.column("factor")), planes.reshape(-1, PLANES, words), *numbers, epsilon) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = coded.select(F.col("id").alias("a"), "code", "factor", "dim")
    right = coded.select(F.col("id").alias("b"), F.col("dim").alias("dim_b"), "planes", "low", "step", "total")
    both = pairs.join(left, "a").join(right, "b").where("dim = dim_b").select("a", "b", "dim", "code", "factor", "planes", "low", "step", "total")
    likely = both.mapInArrow(bounds, "a bigint, b bigint")
    exact = likely.join(vectors.selectExpr("id a", "v x"), "a").join(vectors.selectExpr("id b", "v y"), "b")
    return exact.where(_dot("x", "y") / F.sqrt(_dot("x", "x")) / F.sqrt(_dot("y", "y")) >= threshold).select("a", "b")


def _connected(coded: DataFrame, vectors: DataFrame, threshold: float, epsilon: float) -> DataFrame:
    """(node, root) of the vectors that have a near one."""
    entries = coded.select(F.col("id").alias("node"), F.posexplode("bands").alias("at", "band")).select("node", "band", (F.col("at") % (1 << FLIPS) == 0).alias("own"))
    leads = entries.groupBy("band").agg(F.min(F.when(F.col("own"), F.col("node"))).alias("lead"), F.min("node").alias("low"), F.max("node").alias("high"))
    shared = common.written(entries.join(leads.where("low < high and lead is not null").select("band", "lead"), "band"), "shared-bands")

    def checked(pairs: DataFrame) -> DataFrame:
        return common.checkpoint(verified(pairs, coded, vectors, threshold, epsilon))

    first = shared.where("lead <> node").selectExpr("least(lead, node) a", "greatest(lead, node) b").distinct()
    edges = checked(first)
    labelled = shared.join(components(edges), "node", "left").selectExpr("band", "node", "own", "coalesce(root, node) root")
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    several = common.checkpoint(labelled.join(mixed, "band"))
    asking, there = several.selectExpr("band", "node x", "root rx"), several.where("own").selectExpr("band", "node y", "root ry")
    rest = asking.join(there, "band").where("x <> y and rx <> ry").selectExpr("least(x, y) a", "greatest(x, y) b").distinct().join(first, ["a", "b"], "left_anti")
    return components(edges.union(checked(rest)))


def _links(roots: DataFrame, vectors: DataFrame, threshold: float, epsilon: float, block: int) -> DataFrame:
    """(id, links): of each vector in a component the copies of other vectors that are near, all pairs of the component decided."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    own = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) * F.col("blocks") / F.lit(1 << 40)
    placed = roots.join(sizes.selectExpr("root", f"cast(ceil(m / {block}) as int) blocks"), "root").select("root", F.col("node").alias("id"), "blocks", F.floor(own).cast("int").alias("own"))
    each = placed.join(vectors.select("id", "v", "copies"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "copies", "v")

    def decided(ids: list, copies: list, sides: list, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sides, ids, copies = np.array(sides), np.array(ids), np.array(copies)
        one = sides == 0
        two = one if one.all() else ~one
        made = encode(x)
        dim = x.shape[1]
        near = np.zeros((one.sum(), two.sum()), dtype=bool)
        rows = np.flatnonzero(two)
        for k, at in enumerate(np.flatnonzero(one)):
            near[k] = upper_bound(dim, made["code"][rows], made["factor"][rows], made["planes"][at], made["low"][at], made["step"][at], made["total"][at], epsilon) >= threshold
        p, q = np.nonzero(near)
        a, b = np.flatnonzero(one)[p], rows[q]
        for at in range(0, len(p), 1 << 16):
            part = slice(at, at + (1 << 16))
            near[p[part], q[part]] = np.einsum("ij,ij->i", x[a[part]], x[b[part]]) >= threshold
        if two is one:
            np.fill_diagonal(near, False)
        yield ids[one], near @ copies[two]
        if two is not one:
            yield ids[two], near.T @ copies[one]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            x = np.array([h[3] for h in held])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for ids, links in decided(*map(list, zip(*((h[1], h[2], h[0]) for h in held), strict=True)), x):
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "links": pa.array(links.astype(np.int64))})

        for batch in batches:
            for root, i, j, side, id_, copies, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != at:
                    if held:
                        yield from done()
                    at, held = (root, i, j), []
                held.append((side, id_, copies, v))
        if held:
            yield from done()

    grouped = each.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return grouped.mapInArrow(count, "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, epsilon: float = EPSILON, block: int = BLOCK) -> DataFrame:
    """One row per distinct (vec_id, vector): vec_id, class_id, links."""
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    node = F.concat(F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit("b"), "v")), F.coalesce(F.size("v").cast("string"), F.lit("")))
    named = rows.select("vec_id", node.alias("key"), usable.alias("usable"), "v")
    members = common.checkpoint(named.select("vec_id", "key", "usable").distinct())
    copies = members.where("usable").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    single = named.where("usable").groupBy("key").agg(F.any_value("v").alias("v"))
    vectors = common.written(single.join(copies, "key").withColumn("id", F.monotonically_increasing_id()), "vectors")
    coded = common.written(_coded(vectors, threshold, recall).join(vectors.select("id", F.size("v").alias("dim")), "id"), "codes")
    roots = _connected(coded, vectors, threshold, epsilon)
    links = _links(roots, vectors, threshold, epsilon, block)
    nodes = vectors.select("id", "key", "copies").join(roots.selectExpr("node id", "root"), "id", "left").join(links, "id", "left")
    nodes = nodes.select("key", F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    held = common.checkpoint(members.where("usable").select("vec_id", "key").join(nodes, "key"))
    least = held.groupBy("root").agg(F.min("vec_id").alias("class_id"))
    none = members.where("not usable").select("vec_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return held.join(least, "root").select("vec_id", "class_id", "links").union(none)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(common.read(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
p AS (SELECT a.k AS a, b.k AS b FROM d a JOIN d b ON a.k <> b.k WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach(a, b) AS (SELECT k, k FROM d UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b)
SELECT d.vec_id, c.class_id, coalesce(n.links, 0) AS links
FROM d JOIN (SELECT reach.a AS k, min(e.vec_id) AS class_id FROM reach JOIN d e ON e.k = reach.b GROUP BY 1) c USING (k)
LEFT JOIN (SELECT a AS k, count(*) AS links FROM p GROUP BY 1) n USING (k)
"""
