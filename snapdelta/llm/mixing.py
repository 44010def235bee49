"""Operator 4, mixing sources to target weights by Pfair scheduling.

A source's documents, in an order given by a hash, are laid end to end and cut into blocks of BLOCK_CHARS; a document
belongs to the block in which it begins. Slot after slot, one block of one source is emitted. With weight w, block j
(from 0) of a source is released at slot floor(j / w) and due before ceil((j + 1) / w); of the released blocks the one
due first is emitted, ties by source name. As the weights sum to one, every deadline is met, and at any slot a source
has emitted its weight's share within less than one block.

Weights are parts of a PERIOD, ten thousand or ten times the sources if that is more (finer ones are rounded by largest
remainders, one part at least). All sources are exactly on target at the end of a period, so the schedule repeats: it
is made once, for one period, on the driver, and any block's slot follows from its number.

The guarantee is on blocks: a document longer than a block takes one slot for several blocks' characters, and the slots
of the blocks in which no document begins stay empty, so in characters a source deviates by less than a block and its
longest document.

The mix ends when every block of every source has been emitted once; a source that is through earlier begins again, in
the same order, as a further epoch. So no document is left out, and sources below their weight are repeated. Without
given weights a source weighs its characters to the power ALPHA, which favours small sources.

Defined results: a null source is a source of its own; a null or empty text, or null n_chars, counts as one character
(n_chars is used where the table has it, else the text's length; each document counts one more); a null doc_id keeps
its row; repeated rows are each emitted; of sources with given weights those without documents are left out, and
sources without a given weight share the least one given; an empty table gives no rows. Other columns pass through
mix() as they are. Equal hashes in a source's order go by doc_id, then length.

The plan has a row a source, with its slots; it is broadcast if its known size is under PLAN_BYTES, else joined.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ordering import running_total

BLOCK_CHARS = 1 << 16
ALPHA = 0.8
PERIOD = 10_000
NONE = "\x00none"
PLAN_BYTES = 8 << 20
#: Text of a partition of the mixed documents, beyond what the session's shuffle partitions divide it into.
PART_CHARS = 256 << 20


def parts(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole parts of the period, by largest remainders, one at least."""
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in sorted(weights.items())}
    whole = {k: max(1, int(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (whole[k] - exact[k], k))
    short = period - sum(whole.values())
    i = 0
    while short > 0:
        whole[order[i % len(order)]] += 1
        short, i = short - 1, i + 1
    while short < 0:
        largest = max(whole, key=lambda k: (whole[k], k))
        whole[largest] -= 1
        short += 1
    return whole


def schedule(share: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks within one period: earliest deadline first among released blocks."""
    period = sum(share.values())
    releases = sorted((j * period // a, -(-(j + 1) * period // a), k) for k, a in share.items() for j in range(a))
    slots: dict[str, list[int]] = {k: [] for k in share}
    ready: list[tuple[int, str]] = []
    at = 0
    for slot in range(period):
        while at < len(releases) and releases[at][0] <= slot:
            heapq.heappush(ready, releases[at][1:])
            at += 1
        slots[heapq.heappop(ready)[1]].append(slot)
    return slots


def emitted(slots: list[int], period: int, upto: int) -> int:
    """Blocks of a source in slots before upto."""
    return upto // period * len(slots) + bisect_left(slots, upto % period)


def _mixed(docs: DataFrame, weights: dict[str | None, float] | None, block_chars: int, alpha: float, bucket_rows: int = 20_000) -> tuple[DataFrame, int, int]:
    """(row__, slot__, epoch__, block__, offset__), the rows of docs as structs, each as often as it is emitted; how many slots there are; about how many characters are emitted."""
    spark = docs.sparkSession
    chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.length(F.col("text").cast("string")).cast("bigint")
    source = F.coalesce(F.col("source").cast("string"), F.lit(NONE))
    rows = docs.select(F.struct("*").alias("row__"), F.col("doc_id").alias("id__"), source.alias("s__"), (F.greatest(F.coalesce(chars, F.lit(0)), F.lit(0)) + 1).alias("c__"))
    sizes = {r["s__"]: (r["n"], r["c"]) for r in rows.groupBy("s__").agg(F.sum("c__").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return rows.selectExpr("row__", "0L slot__", "0L epoch__", "0L block__", "0L offset__"), 0, 0
    if weights is None:
        given = {k: c**alpha for k, (_, c) in sizes.items()}
    else:
        named = {NONE if k is None else k: w for k, w in weights.items() if w > 0}
        low = min(named.values(), default=1.0)
        given = {k: named.get(k, low) for k in sizes}
    period = max(PERIOD, 10 * len(sizes))
    slots = schedule(parts(given, period))
    blocks = {k: -(-c // block_chars) for k, (_, c) in sizes.items()}

    def slot(k: str, j: int) -> int:
        return j // len(slots[k]) * period + slots[k][j % len(slots[k])]

    end = max(slot(k, n - 1) for k, n in blocks.items()) + 1
    plan = spark.createDataFrame([(k, blocks[k], emitted(slots[k], period, end), len(slots[k]), slots[k]) for k in sorted(slots)], "s__ string, n__ bigint, e__ bigint, a__ bigint, t__ array<int>")
    placed = running_total(rows, ["s__"], F.xxhash64("id__", "s__"), ["id__", "c__"], "c__", "offset__", sum(n for n, _ in sizes.values()), bucket_rows)
    placed = placed.withColumn("block__", F.floor(F.col("offset__") / block_chars).cast("bigint")).join(F.broadcast(plan) if 4 * period + sum(64 + len(k) for k in sizes) < PLAN_BYTES else plan, "s__")
    epochs = F.floor((F.col("e__") - 1 - F.col("block__")) / F.col("n__")).cast("bigint")
    each = placed.withColumn("epoch__", F.explode(F.sequence(F.lit(0).cast("bigint"), epochs))).withColumn("j__", F.col("block__") + F.col("epoch__") * F.col("n__"))
    when = F.floor(F.col("j__") / F.col("a__")) * period + F.element_at("t__", (F.col("j__") % F.col("a__") + 1).cast("int"))
    return each.select("row__", when.cast("bigint").alias("slot__"), "epoch__", "block__", "offset__"), end, end * block_chars


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, alpha: float = ALPHA, bucket_rows: int = 20_000) -> DataFrame:
    """The rows of docs, repeated as their sources' epochs ask, with slot__, epoch__, block__ and offset__ (its place in the source, in characters), which take the place of columns of these names."""
    own = ("slot__", "epoch__", "block__", "offset__")
    return _mixed(docs, weights, block_chars, alpha, bucket_rows)[0].select(*(F.col(f"row__.`{c}`") for c in docs.columns if c.lower() not in own), *own)


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, alpha: float = ALPHA) -> DataFrame:
    """The documents in the order of the mix: partitions hold ranges of slots, in order, and rows within them are sorted."""
    mixed, end, chars = _mixed(docs, weights, block_chars, alpha)
    if not end:
        return docs
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // PART_CHARS)
    target = F.floor(F.col("slot__") * n / F.lit(end)).cast("int")
    return mixed.repartitionById(n, target).sortWithinPartitions("slot__", "epoch__", "offset__").select("row__.*")


def interleaved(rows: DataFrame, key: list[str], group: str, source: str, size: str, order: list[str], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, slot, place): the same schedule within each group, a source weighing what it has there; place is a row's rank in its group, from 0.

    A group, as key, source and size only, is held by one task: groups are of bounded size, as shards are.
    """
    names = [*key, "s__", "c__"]

    def placed(columns: list[list]) -> pa.RecordBatch:
        sources, sizes = columns[-2], np.array(columns[-1], dtype=np.int64)
        known, codes = np.unique(np.array([NONE if s is None else s for s in sources], dtype=object), return_inverse=True)
        block = np.zeros(len(sizes), dtype=np.int64)
        slot = np.zeros(len(sizes), dtype=np.int64)
        share = {}
        for k in range(len(known)):
            own = np.flatnonzero(codes == k)
            block[own] = (np.cumsum(sizes[own]) - sizes[own]) // block_chars
            share[k] = -(-int(sizes[own].sum()) // block_chars)
        for k, slots in schedule(share).items():
            own = np.flatnonzero(codes == k)
            slot[own] = np.array(slots)[block[own]]
        place = np.empty(len(slot), dtype=np.int64)
        place[np.argsort(slot, kind="stable")] = np.arange(len(slot))
        return pa.RecordBatch.from_pydict({**{k: pa.array(c, pa.int64()) for k, c in zip(key, columns, strict=False)}, "slot": pa.array(slot), "place": pa.array(place)})

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, [[] for _ in names]
        for batch in batches:
            groups, *columns = (c.to_pylist() for c in batch.columns)
            for g, *values in zip(groups, *columns, strict=True):
                if g != at:
                    if held[0]:
                        yield placed(held)
                    at, held = g, [[] for _ in names]
                for column, value in zip(held, values, strict=True):
                    column.append(value)
        if held[0]:
            yield placed(held)

    slim = rows.select(F.col(group).alias("g__"), *key, F.col(source).cast("string").alias("s__"), F.col(size).alias("c__"), *(F.col(c).alias(f"o{i}__") for i, c in enumerate(order)))
    sorted_ = slim.repartition("g__").sortWithinPartitions("g__", *(f"o{i}__" for i in range(len(order))))
    return sorted_.select("g__", *names).mapInArrow(each, ", ".join(f"{c} bigint" for c in (*key, "slot", "place")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mix(docs).selectExpr("doc_id", "source", "slot__ slot", "epoch__ epoch", "block__ block", "offset__ offset")
