"""Operator 6, language identification as multilingual mixture inference.

Each white-space token, lower-cased and reduced to its letters, is drawn from one of the languages; a language gives it
the product of its smoothed character-trigram probabilities. One more component, "und", gives every trigram the same
small probability. For each document expectation-maximisation finds the mixture proportions, and the set of languages
is chosen by penalised likelihood: beginning with all components, the one of least share is dropped as long as
log-likelihood - penalty * (languages - 1) doesn't fall, where penalty = PENALTY + log(words) / 2. A document is
settled early, on its best single language, once a bound shows that no larger set can win: with g_k the mean of
component k's likelihood over the mixture's, no mixture exceeds the present log-likelihood by more than
words * (max g_k - 1).

The trigram tables are fitted on a sample of labelled rows, the SAMPLE_DOCS ones whose id and text have the least hash;
everything else covers all rows and whole texts.

Defined results: a null text, or one without letters, has no languages, a null main language and is not accepted; a
null doc_id keeps its row; repeated rows give repeated results; an empty table gives no rows (and, as training input, a
model that knows "und" only); a null lang is not used for training; columns other than doc_id, text and lang are
ignored. Of languages with equal shares the one named first goes first. A document is accepted if languages other than "und" make up at least MIN_KNOWN of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS = 3000
BUCKETS = 1 << 15
PENALTY = 12.0
MIN_KNOWN = 0.5
MAX_WORDS = 400_000
ITERATIONS = 60
SCHEMA = "doc_id bigint, lang string, main string, languages array<string>, shares array<double>, accepted boolean"


@dataclass
class Model:
    """Names of the components, "und" last, and their log-probabilities by trigram bucket."""

    names: list[str]
    logs: np.ndarray


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def sample(docs: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """This many labelled rows, those of least hash; (lang, text)."""
    hashed = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text", F.lit("language")).alias("h_"))
    total = max(docs.count(), 1)
    # a bound below which about twice as many hashes lie as are wanted spares sorting the rest; where too few do, all are sorted
    near = hashed.where(F.col("h_") < F.lit(int((min(1.0, 2 * rows / total) - 0.5) * 2.0**63 * 2) if 2 * rows < total else 2**63 - 1))
    pool = near if near.select("h_").limit(rows).count() == rows else hashed
    return pool.orderBy("h_", "lang").limit(rows).select("lang", "text")


def train(rows: Iterable[tuple[str, str]]) -> Model:
    """rows: (language, text)."""
    found: dict[str, np.ndarray] = {}
    for lang, text in rows:
        own = found.setdefault(lang, np.zeros(BUCKETS))
        if words := [w for t in text.lower().split() if (w := letters(t))]:
            own += np.bincount(common.trigrams(words, BUCKETS)[0], minlength=BUCKETS)
    names = sorted(found)
    counts = np.stack([*(found[name] for name in names), np.zeros(BUCKETS)], axis=1)
    counts[:, :-1] += 0.05
    counts[:, -1] = 1
    return Model([*names, "und"], np.log(counts / counts.sum(axis=0)).astype(np.float32))


def likelihoods(model: Model, tokens: list[str]) -> np.ndarray:
    """Log-likelihood of each token under each component; zeros for one without letters."""
    words = [letters(t) for t in tokens]
    out = np.zeros((len(words), len(model.names)), dtype=np.float32)
    some = [i for i, w in enumerate(words) if w]
    if some:
        grams, lengths = common.trigrams([words[i] for i in some], BUCKETS)
        out[some] = np.add.reduceat(model.logs[grams], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
    return out


class Rows(dict):
    """Numbers tokens as they come."""

    def __missing__(self, token: str) -> int:
        self[token] = i = len(self)
        return i


def mixtures(logs: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares by document (rows) and component; logs has the words of all documents end to end, one at least in each."""
    n_docs, n_parts = len(lengths), logs.shape[1]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    top = logs.max(axis=1)
    likely = np.exp(logs - top[:, None])
    base = np.add.reduceat(top.astype(np.float64), starts)
    single = np.add.reduceat(logs.astype(np.float64), starts, axis=0)
    charge = penalty + np.log(lengths) / 2
    best, single_score = single.argmax(axis=1), single.max(axis=1)
    shares = np.zeros((n_docs, n_parts))
    shares[np.arange(n_docs), best] = 1

    def fit(docs: np.ndarray, allowed: np.ndarray, floor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Mixtures of these documents within the allowed components, and their log-likelihoods; those that can't reach the floor are left at -inf."""
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        score = np.full(len(docs), -np.inf)
        left, size = np.arange(len(docs)), -1
        for step in range(ITERATIONS):
            own = docs[left]
            if len(own) != size:
                size = len(own)
                rows, places = common.ragged(lengths[own])
                words = likely[starts[own][rows] + places]
                cuts = np.concatenate([[0], np.cumsum(lengths[own])[:-1]])
            mix = np.maximum(np.einsum("ij,ij->i", words, pi[left].astype(np.float32)[rows]), 1e-30)
            gain = np.add.reduceat(words / mix[:, None], cuts, axis=0).astype(np.float64) / lengths[own][:, None]
            now = np.add.reduceat(np.log(mix), cuts).astype(np.float64) + base[own]
            most = now + lengths[own] * (np.where(allowed[left] > 0, gain, 0).max(axis=1) - 1)
            done = (most - now < 0.01) | (step == ITERATIONS - 1)
            lost = np.zeros(size, dtype=bool) if floor is None else most < floor[left]
            score[left[done & ~lost]] = now[done & ~lost]
            moved = pi[left] * gain
            go = ~(done | lost)
            pi[left[go]] = (moved / np.maximum(moved.sum(axis=1, keepdims=True), 1e-30))[go]
            left = left[go]
            if not len(left):
                break
        return pi, score

    docs = np.arange(n_docs)
    allowed = np.ones((n_docs, n_parts))
    pi, score = fit(docs, allowed, single_score + charge)
    open_ = np.isfinite(score)
    docs, allowed, pi, value = docs[open_], allowed[open_], pi[open_], (score - charge * (n_parts - 1))[open_]
    for size in range(n_parts - 1, 0, -1):
        if not len(docs):
            break
        fewer = allowed.copy()
        fewer[np.arange(len(docs)), np.where(allowed > 0, pi, np.inf).argmin(axis=1)] = 0
        if size > 1:
            less_pi, less = fit(docs, fewer, None)
        else:
            less_pi, less = np.zeros_like(pi), single_score[docs]
            less_pi[np.arange(len(docs)), best[docs]] = 1
        less_value = less - charge[docs] * (size - 1)
        better = less_value >= value
        shares[docs[~better]] = np.where(allowed > 0, pi, 0)[~better]
        docs, allowed, pi, value = docs[better], fewer[better], less_pi[better], less_value[better]
    if len(docs):
        shares[docs] = pi
    return shares


def language_id(docs: DataFrame, model: Model | None = None, sample_docs: int = SAMPLE_DOCS, penalty: float = PENALTY, min_known: float = MIN_KNOWN, passing: bool = False) -> DataFrame:
    """One row per document: doc_id, lang as declared, main language, languages by falling share, shares, accepted. passing: instead the accepted documents with all their columns. One pass, no shuffle."""
    if model is None:
        model = train((r.lang, r.text) for r in sample(docs, sample_docs).toLocalIterator())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = model.names

    def infer(texts: list[str | None], rows: Rows, table: list[np.ndarray]) -> list[tuple[list[str], list[float], bool]]:
        if len(rows) > MAX_WORDS:
            rows.clear()
            table[0] = np.zeros((0, len(names)), dtype=np.float32)
        known = len(rows)
        ids = [np.fromiter(map(rows.__getitem__, cut), dtype=np.int64, count=len(cut)) for cut in ((t or "").lower().split() for t in texts)]
        if len(rows) > known:
            table[0] = np.concatenate([table[0], likelihoods(shared.value, list(rows)[known:])])
        logs = table[0]
        spoken = logs.any(axis=1)
        ids = [i[spoken[i]] for i in ids]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        some = np.flatnonzero(lengths)
        shares = np.zeros((len(ids), len(names)))
        if len(some):
            shares[some] = mixtures(logs[np.concatenate([ids[i] for i in some])], lengths[some], penalty)
        out = []
        for row in shares:
            order = [k for k in np.argsort(-row, kind="stable") if row[k] > 0]
            out.append(([names[k] for k in order], [round(float(row[k]), 4) for k in order], bool(row.any()) and 1 - row[-1] >= min_known))
        return out

    def state() -> tuple[Rows, list[np.ndarray]]:
        return Rows(), [np.zeros((0, len(names)), dtype=np.float32)]

    def identify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, table = state()
        for batch in common.slices(batches, "text"):
            found = infer(batch.column(1).to_pylist(), rows, table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([f[0][0] if f[0] else None for f in found], pa.string()), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.bool_())],
                ["doc_id", "lang", "main", "languages", "shares", "accepted"],
            )

    def accept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, table = state()
        for batch in common.slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([f[2] for f in infer(texts, rows, table)], pa.bool_()))

    if passing:
        return docs.mapInArrow(accept, docs.schema)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text", "cast(lang as string) as lang").mapInArrow(identify, SCHEMA)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(common.read(spark, sf_dir, "documents"))
