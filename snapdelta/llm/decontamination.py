"""Operator 5, benchmark decontamination: an FM-index per training shard, searched for every test phrase.

Texts and benchmark items are compared as lower-cased words. Phrases are all runs of PHRASE words of an item; an item
of fewer words, down to MIN_WORDS, is one phrase as a whole, and a shorter one is not searched. A task cuts its rows
into shards of about SHARD_CHARS of text and indexes each one: backward search over the wavelet matrix finds all
phrases at once, sampled suffix positions tell where they occur, and overlapping or touching occurrences are merged to
spans. Only stretches of a text that can hold a phrase are indexed, that is runs of benchmark words no shorter than the
shortest phrase; what is left out can't match.

The benchmark is sent to the executors, in parts of about PART_WORDS words. A task searches its shards for the phrases of
all parts, one part in memory at a time if there are several, and merges the occurrences of all of them in the original
text, so that results do not depend on the number of parts.

Defined results: null and empty texts, and null benchmark texts, match nothing; a null doc_id keeps its spans; repeated
rows each have theirs; empty tables (of either kind) give no spans; columns besides doc_id and text, and item_id and
text, don't matter, and pass through decontaminate() as they are. Very long texts are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fm_index import FMIndex

PHRASE = 8
MIN_WORDS = 5
SHARD_CHARS = 24 << 20
PART_WORDS = 2_000_000
SCHEMA = "doc_id bigint, start bigint, end bigint, n_words bigint, items array<bigint>"

Span = tuple[int, int, int, set[int]]


class Phrases:
    """Test phrases by length, as word numbers from 1, with the items that they come from."""

    def __init__(self, items: Iterable[tuple[int, str]], phrase: int = PHRASE, min_words: int = MIN_WORDS):
        self.numbers: dict[str, int] = {}
        by: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in cut] if len(cut := common.words(text or "")) >= min_words else []
            size = min(phrase, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                by.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(item)
        self.tables = {size: (np.array(list(found), dtype=np.int64), list(found.values())) for size, found in by.items()}
        self.shortest = min(by, default=0)


def _hits(texts: list[str | None], phrases: Phrases, hits: dict[int, list[tuple[int, int, set[int]]]]) -> None:
    """Adds the phrases' occurrences by the text's place in the list: (first word, past the last, items)."""
    if not phrases.tables:
        return
    get = phrases.numbers.get
    parts, docs, places = [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        cut = common.words(text)
        if len(cut) < phrases.shortest:
            continue
        ids = np.fromiter((get(w, 0) for w in cut), dtype=np.int64, count=len(cut))
        edge = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - begins >= phrases.shortest
        for b, e in zip(begins[long], ends[long], strict=True):
            parts += [ids[b:e], np.zeros(1, dtype=np.int64)]
            docs.append(i)
            places.append(b)
    if not parts:
        return
    seq = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts[::2]])[:-1]])
    index = FMIndex(seq, len(phrases.numbers) + 1)
    docs, places = np.array(docs), np.array(places)
    for size, (table, items) in phrases.tables.items():
        low, high = index.search(table)
        some = np.flatnonzero(high > low)
        which, nth = common.ragged((high - low)[some])
        at = index.locate(low[some][which] + nth)
        run = np.searchsorted(starts, at, side="right") - 1
        for doc, word, k in zip(docs[run].tolist(), (places[run] + at - starts[run]).tolist(), some[which].tolist(), strict=True):
            hits.setdefault(doc, []).append((word, word + size, items[k]))


def find(texts: list[str | None], parts: Iterable[Phrases]) -> dict[int, list[Span]]:
    """Spans by the text's place in the list: (first character, end, words, items)."""
    hits: dict[int, list[tuple[int, int, set[int]]]] = {}
    for phrases in parts:
        _hits(texts, phrases, hits)
    out: dict[int, list[Span]] = {}
    for doc, found in hits.items():
        found.sort(key=lambda h: h[:2])
        merged: list[list] = []
        for b, e, items in found:
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] |= items
            else:
                merged.append([b, e, set(items)])
        spots = common.word_places(texts[doc])
        out[doc] = [(spots[b][0], spots[e - 1][1], e - b, items) for b, e, items in merged]
    return out


def shards(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in common.slices(batches, text):
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _parts(benchmark: DataFrame, part_words: int, phrase: int, min_words: int) -> list:
    """The benchmark's phrases, broadcast, in parts of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, math.ceil(total / part_words))
    return [spark.sparkContext.broadcast(Phrases(((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toLocalIterator()), phrase, min_words)) for k in range(n)]


def _held(parts: list[Broadcast]) -> Iterator[Phrases]:
    """The parts' phrases; of several parts a worker holds one at a time."""
    for part in parts:
        yield part.value if len(parts) == 1 or not getattr(part, "_path", None) else part.load_from_path(part._path)


def contamination(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, min_words: int = MIN_WORDS, shard_chars: int = SHARD_CHARS, part_words: int = PART_WORDS) -> DataFrame:
    """One row per span to remove: doc_id, start and end in characters, n_words, and the items that it repeats."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = _parts(benchmark, part_words, phrase, min_words)

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "text", shard_chars):
            ids = [i for b in shard for i in b.column(0).to_pylist()]
            found = find([t for b in shard for t in b.column(1).to_pylist()], _held(parts))
            flat = [(ids[doc], *span) for doc in sorted(found) for span in found[doc]]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array([f[0] for f in flat], pa.int64()), "start": pa.array([f[1] for f in flat], pa.int64()), "end": pa.array([f[2] for f in flat], pa.int64()), "n_words": pa.array([f[3] for f in flat], pa.int64()), "items": pa.array([sorted(i for i in f[4] if i is not None) for f in flat], pa.list_(pa.int64()))}
            )

    return rows.mapInArrow(spans, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, min_words: int = MIN_WORDS, shard_chars: int = SHARD_CHARS, part_words: int = PART_WORDS) -> DataFrame:
    """The documents with the spans cut out of their texts and n_chars, where there is one, adjusted; one that has no word left is dropped. All other columns stay."""
    parts = _parts(benchmark, part_words, phrase, min_words)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "text", shard_chars):
            column = shard[0].schema.get_field_index("text")
            found = find([t for b in shard for t in b.column(column).to_pylist()], _held(parts))
            at = 0
            for batch in shard:
                own = {i - at: found[i] for i in range(at, at + batch.num_rows) if i in found}
                at += batch.num_rows
                yield _without(batch, column, own) if own else batch

    return docs.mapInArrow(cut, docs.schema)


def _without(batch: pa.RecordBatch, column: int, spans: dict[int, list[Span]]) -> pa.RecordBatch:
    texts = batch.column(column).to_pylist()
    lost = set()
    for i, cuts in spans.items():
        at, left = 0, []
        for start, end, *_ in cuts:
            left.append(texts[i][at:start])
            at = end
        texts[i] = "".join([*left, texts[i][at:]])
        if not common.WORD.search(texts[i]):
            lost.add(i)
    columns = list(batch.columns)
    columns[column] = pa.array(texts, batch.schema.field(column).type)
    if (n := batch.schema.get_field_index("n_chars")) >= 0:
        sizes = columns[n].to_pylist()
        for i in spans:
            sizes[i] = len(texts[i])
        columns[n] = pa.array(sizes, batch.schema.field(n).type)
    out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return out.filter(pa.array([i not in lost for i in range(batch.num_rows)])) if lost else out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents; items as text, joined by commas."""
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


_WORDS = r"'[\p{L}\p{N}_]+'"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), {_WORDS}) AS w, regexp_split_to_array(lower(text), {_WORDS}) AS s FROM documents),
b AS (SELECT item_id, w, least({PHRASE}, len(w)) AS size FROM (SELECT item_id, regexp_extract_all(lower(text), {_WORDS}) AS w FROM benchmark) WHERE len(w) >= {MIN_WORDS}),
phrases AS (SELECT DISTINCT item_id, size, array_to_string(w[j : j + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS j FROM b)),
grams AS (SELECT doc_id, size, j, array_to_string(w[j : j + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS j FROM d, (SELECT DISTINCT size FROM phrases) WHERE len(w) >= size)),
hits AS (SELECT doc_id, j AS first, j + size AS past, item_id FROM grams JOIN phrases USING (size, phrase)),
cut AS (SELECT *, CASE WHEN first <= max(past) OVER (PARTITION BY doc_id ORDER BY first, past, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY first, past, item_id ROWS UNBOUNDED PRECEDING) AS run FROM cut),
spans AS (SELECT doc_id, min(first) AS first, max(past) AS past, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM runs GROUP BY doc_id, run),
places AS (
  SELECT doc_id, i, sum(len(gap) + len(word)) OVER (PARTITION BY doc_id ORDER BY i) AS past, len(word) AS size
  FROM (SELECT doc_id, unnest(w) AS word, unnest(s[1 : len(w)]) AS gap, unnest(range(1, len(w) + 1)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM spans)))
SELECT n.doc_id, CAST(a.past - a.size AS BIGINT) AS start, CAST(z.past AS BIGINT) AS "end", n.past - n.first AS n_words, n.items
FROM spans n JOIN places a ON a.doc_id = n.doc_id AND a.i = n.first JOIN places z ON z.doc_id = n.doc_id AND z.i = n.past - 1
"""
