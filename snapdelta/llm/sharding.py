"""Operator 9, sharding by balanced label propagation.

Documents are linked by content: two that share a run of SHINGLE words (or a whole text, if that is shorter) anywhere
are linked, however long they are, as all runs' hashes are compared. The documents of a run are chained in order of
their ids, each to the next, first those that a worker holds at once and then the least ones of these, so that a run's
links grow in proportion to its documents; a link weighs as many runs as it joins. Runs are compared in buckets, by
range of hash, of about BUCKET_BYTES of text each; a task has one in memory at a time. Shards begin as equal stretches, by size, of the documents in order
of a hash of their least hash, which puts many linked ones together. Then, for ROUNDS rounds, a document
with more links into another shard than into its own asks to move there; half of the documents, chosen by a hash, may
ask in a round. Askers of a shard are taken in order of gain, to a quarter of its logarithm, then of a hash, while they fit into what
was free at the round's start, so that no shard exceeds its capacity: its even share and SLACK more, or what it has at the start if the documents
don't divide evenly.

Size is n_chars where the table has it, else the text's length, plus one a document. Shards are as many as there are
SHARD_CHARS of text, MIN_SHARDS at least.

Defined results: rows of one doc_id are one document, whose sizes add up, and go to one shard; a null doc_id is
replaced by a hash of the text; null and empty texts have no links; ties between shards go to the lower one, between
askers to the smaller document, then the lower id; an empty table gives no rows; columns shard, slot and place that the
documents already have are replaced in sharded_documents(), others pass through.

sharded_documents() also keeps the mix of sources: within each shard, rows keep the order that they have in the files
they come from source by source, and the sources are interleaved by the schedule of operator 4, each at the weight that it
has in the shard. slot is the block's place in that schedule and place the row's; a shard is to be read in this order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, mixing
from .ordering import BUCKET_ROWS, running_total

SHINGLE = 8
BUCKET_BYTES = 8 << 20
#: Text whose runs a task compares, beyond what the session's shuffle partitions divide it into.
TASK_BYTES = 1 << 30
ROUNDS = 6
SLACK = 0.05
SHARD_CHARS = 256 << 20
MIN_SHARDS = 8


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")))


def run_hashes(words: list[str], known: dict[str, int], shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of all the text's runs of words, in order."""
    import xxhash

    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(h))
    n = len(h) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    return total


def chains(prints: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs and the nodes they are in: the distinct runs in order, the least node of each, and the links (a, b, weight) that chain its nodes."""
    by_node = np.argsort(nodes, kind="stable")
    order = by_node[np.argsort(prints[by_node], kind="stable")]
    prints, nodes = prints[order], nodes[order]
    fresh = np.ones(len(prints), dtype=bool)
    fresh[1:] = prints[1:] != prints[:-1]
    joins = np.flatnonzero(~fresh[1:] & (nodes[1:] != nodes[:-1]))
    a, b = nodes[joins], nodes[joins + 1]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), dtype=bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return prints[fresh], nodes[fresh], (a[first], b[first], np.diff(np.append(first, len(a))))


ROWS = "node bigint, size bigint, least bigint, other bigint, weight bigint"
FIELDS = ("bucket", "node", "size", "least", "other", "weight", "prints", "nodes")
KINDS = (pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary())


def _rows(n: int, fields: tuple[str, ...] = FIELDS, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[f], k) if f in values else pa.nulls(n, k) for f, k in zip(FIELDS, KINDS, strict=True) if f in fields], list(fields))


def _sketches(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(node, size, least, other, weight): a row per row of docs, with its size and its least hash; and rows of links, with the other node and the weight, once a bucket at most."""
    chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.length(F.col("text").cast("string")).cast("bigint")
    rows = docs.select(_id().alias("node"), (F.greatest(F.coalesce(chars, F.lit(0)), F.lit(0)) + 1).alias("size"), F.col("text").cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-n_bytes // bucket_bytes))
    n_tasks = min(n, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // TASK_BYTES))
    bounds = np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in common.slices(batches, "text"):
            if len(known) > 400_000:
                known.clear()
            runs = [run_hashes(w, known) if (w := common.words(t.as_py() or "")) else np.zeros(0, np.uint64) for t in batch.column(2)]
            node = batch.column(0).to_numpy(zero_copy_only=False)
            least = [int(r.view(np.int64).min()) if len(r) else None for r in runs]
            yield _rows(len(runs), bucket=node % n, node=batch.column(0), size=batch.column(1), least=least)
            prints, nodes, (a, b, weight) = chains(np.concatenate(runs), np.repeat(node, [len(r) for r in runs]))
            if len(a):
                yield _rows(len(a), bucket=a % n, node=a, other=b, weight=weight)
            cuts = np.concatenate([[0], np.searchsorted(prints, bounds), [len(prints)]])
            some = np.flatnonzero(np.diff(cuts))
            yield _rows(len(some), bucket=some, prints=[prints[cuts[k] : cuts[k + 1]].tobytes() for k in some], nodes=[nodes[cuts[k] : cuts[k + 1]].tobytes() for k in some])

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, prints, nodes = None, [], []

        def joined() -> pa.RecordBatch:
            a, b, weight = chains(np.frombuffer(b"".join(prints), np.uint64), np.frombuffer(b"".join(nodes), np.int64))[2]
            return _rows(len(a), FIELDS[1:6], node=a, other=b, weight=weight)

        for batch in batches:
            runs = batch.column(6).is_valid()
            yield batch.filter(pc.invert(runs)).select(FIELDS[1:6])
            batch = batch.filter(runs)
            for bucket, p, x in zip(batch.column(0).to_pylist(), batch.column(6), batch.column(7), strict=True):
                if bucket != at:
                    if prints:
                        yield joined()
                    at, prints, nodes = bucket, [], []
                prints.append(p.as_py())
                nodes.append(x.as_py())
        if prints:
            yield joined()

    spread = rows.mapInArrow(sketch, f"bucket int, {ROWS}, prints binary, nodes binary")
    return spread.repartition(n_tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(link, ROWS)


def links(sketches: DataFrame) -> DataFrame:
    """(a, b, weight), each link in both directions."""
    pairs = sketches.where("other is not null")
    return pairs.selectExpr("node a", "other b", "weight").union(pairs.selectExpr("other a", "node b", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def shard_nodes(sketches: DataFrame, n_shards: int | None = None, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(node, shard)."""
    nodes = sketches.where("other is null").groupBy("node").agg(F.sum("size").alias("size"), F.min(F.coalesce("least", F.xxhash64("node"))).alias("least"))
    total, count, largest = nodes.agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).first()
    if not count:
        return sketches.where("other is null").selectExpr("node", "0 shard")
    n = n_shards or max(MIN_SHARDS, -(-total // SHARD_CHARS))
    begun = running_total(nodes, [], F.xxhash64("least"), ["node"], "size", "offset", count)
    begun = begun.select("node", "size", F.least(F.floor(F.col("offset") * n / F.lit(total)), F.lit(n - 1)).cast("int").alias("shard"))
    edges = common.checkpoint(links(sketches))
    begun = common.checkpoint(begun.join(edges.select(F.col("a").alias("node")).distinct().withColumn("linked", F.lit(True)), "node", "left"))
    capacity = max(int(total / n * (1 + slack)), largest)
    held = begun.groupBy("shard").agg(F.sum(F.when(F.col("linked"), 0).otherwise(F.col("size"))).alias("fixed"))
    held = common.checkpoint(held)
    labels = common.checkpoint(begun.where("linked").select("node", "size", "shard"))
    every = sketches.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"))
    for r in range(rounds):
        wishes = edges.join(labels.selectExpr("node b", "shard there"), "b").groupBy("a", "there").agg(F.sum("weight").alias("pull"))
        best = wishes.groupBy("a").agg(F.max_by("there", F.struct("pull", -F.col("there"))).alias("to"), F.max("pull").alias("pull"), F.map_from_entries(F.collect_list(F.struct("there", "pull"))).alias("pulls"))
        asking = labels.where(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0).join(best.withColumnRenamed("a", "node"), "node")
        asking = asking.withColumn("gain", F.col("pull") - F.coalesce(F.try_element_at("pulls", "shard"), F.lit(0))).where("gain > 0 and to <> shard")
        free = every.join(labels.groupBy("shard").agg(F.sum("size").alias("moving")), "shard", "left").join(held, "shard", "left")
        free = free.selectExpr("shard to", f"{capacity} - coalesce(moving, 0) - coalesce(fixed, 0) free")
        # a shard's queue in pieces of equal gain and hash, so that no task sorts all that ask for one shard
        asking = common.checkpoint(asking.select("node", "to", "size", (-F.floor(4 * F.log2("gain"))).alias("rank"), F.pmod(F.xxhash64("node"), F.lit(max(1, count // BUCKET_ROWS))).alias("piece")))
        pieces = asking.groupBy("to", "rank", "piece").agg(F.sum("size").alias("all"))
        earlier = Window.partitionBy("to").orderBy("rank", "piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.select("to", "rank", "piece", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
        queue = Window.partitionBy("to", "rank", "piece").orderBy("size", "node").rowsBetween(Window.unboundedPreceding, 0)
        queued = asking.withColumn("within", F.sum("size").over(queue)).join(pieces, ["to", "rank", "piece"]).join(free, "to")
        taken = queued.where("before + within <= free").select("node", "to")
        labels = common.checkpoint(labels.join(taken, "node", "left").selectExpr("node", "size", "coalesce(to, shard) shard"))
    return begun.where("linked is null").select("node", "shard").union(labels.select("node", "shard"))


def sharding(docs: DataFrame, n_shards: int | None = None, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, shard."""
    sketches = common.written(_sketches(docs), "sketches")
    return shard_nodes(sketches, n_shards, rounds, slack).selectExpr("node doc_id", "shard")


def _numbered(docs: DataFrame) -> DataFrame:
    """(row__, file__, at__, part__): the rows as structs, named by file and place in it, which a repeated task finds again; part__ numbers the file. Tables that don't come straight from files are written first."""
    try:
        rows = docs.select(F.struct("*").alias("row__"), "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        kept = common.written(docs.select(F.struct("*").alias("row__")), "numbered")
        rows = kept.select("row__", "_metadata.file_path", "_metadata.row_index")
    part = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("file_path", r"part-(\d{1,18})", 1), F.lit("")), F.lit("9" * 18)).cast("bigint"), F.lit(0).cast("bigint"))
    return rows.select("row__", F.xxhash64("file_path").alias("file__"), F.col("row_index").alias("at__"), part.alias("part__"))


def sharded_documents(docs: DataFrame, n_shards: int | None = None, rounds: int = ROUNDS, slack: float = SLACK, block_chars: int = mixing.BLOCK_CHARS) -> DataFrame:
    """The documents with all their columns, their shard, and slot and place in its mix of sources."""
    own = ("shard", "slot", "place")
    shards = sharding(docs, n_shards, rounds, slack).toDF("node__", "shard__")
    rows = _numbered(docs)
    text = F.col("row__.text").cast("string")
    node = F.coalesce(F.col("row__.doc_id").cast("bigint"), F.xxhash64(text))
    chars = F.col("row__.n_chars").cast("bigint") if "n_chars" in docs.columns else F.length(text).cast("bigint")
    source = F.col("row__.source") if "source" in docs.columns else F.lit(None).cast("string")
    slim = rows.select("file__", "at__", "part__", node.alias("node__"), source.alias("s__"), (F.greatest(F.coalesce(chars, F.lit(0)), F.lit(0)) + 1).alias("c__"))
    placed = common.written(slim.join(shards, "node__"), "placed")
    slots = mixing.interleaved(placed, ["file__", "at__", "shard__"], "shard__", "s__", "c__", ["part__", "file__", "at__"], block_chars)
    out = rows.join(slots, ["file__", "at__"])
    return out.select(*(F.col(f"row__.`{c}`") for c in docs.columns if c.lower() not in own), F.col("shard__").cast("int").alias("shard"), "slot", "place")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding(common.read(spark, sf_dir, "documents"))
