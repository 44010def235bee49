"""Operator 2, toxicity: a bidirectional GRU with attention pooling over character and word inputs, in numpy.

A word's input is a word vector (of the words found in MIN_DOCS sampled documents or more the WORD_ROWS - 1 commonest have one of
their own, the rest share one) beside the mean of its hashed character-trigram vectors. A window of WINDOW
words runs through a forward and a backward gated recurrent unit; attention weighs the steps' states, and a logistic
unit scores their weighted mean. Windows overlap by half; all of them are scored, the last one ending with the text,
and a document scores as its worst window does. It is toxic if that reaches THRESHOLD.

Training (on the driver, by back-propagation through time) uses a sample of labelled documents chosen by a hash of
their ids: about SAMPLE_DOCS labels at any input size (twice that at most), with all their windows. Labels are of documents, not windows, so after a first phase on all windows of toxic documents only those
count as toxic that the network itself finds so, and the worst one of each; of the clean windows, those that look worst
among HARD_POOL drawn anew now and then make up a third of the batches. Steps are fixed in number.

What the words contribute to the gates before any recurrence is computed once per distinct word and kept by the worker,
up to MAX_WORDS words.

Defined results: a null, empty or wordless text has no window, a null score and isn't toxic; a null doc_id keeps its
row; repeated rows score alike; an empty table gives no rows; labels that are null, or whose document is missing, are
not used, of contradictory ones toxic holds; with no labels, or none usable of both kinds, all scores are 0; of windows
that score alike the first is reported. Columns besides
doc_id and text (doc_id and toxic in labels) don't matter. Very long texts are scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 64
STRIDE = WINDOW // 2
HIDDEN = 8
WORD_DIM, WORD_ROWS = 16, 1 << 14
CHAR_DIM, CHAR_ROWS = 8, 1 << 12
ATTENTION = 8
SAMPLE_DOCS = 8000
MIN_DOCS = 5
DECAY = 0.02
STEPS, BATCH, RATE = 300, 192, 0.02
HARD_POOL = 8000
THRESHOLD = 0.9
MAX_WORDS = 250_000
BLOCK = 1024
SCHEMA = "doc_id bigint, score double, n_windows bigint, worst_word bigint, toxic boolean"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def windows(n: int) -> np.ndarray:
    """First words of the windows over n words."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, dtype=np.int64)
    return np.minimum(np.arange(-(-(n - WINDOW) // STRIDE) + 1) * STRIDE, n - WINDOW)


@dataclass
class Network:
    seed: int = 0
    vocab: dict[str, int] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        shapes = {"words": (WORD_ROWS, WORD_DIM, 0.02), "chars": (CHAR_ROWS, CHAR_DIM, 0.02), "att": (2 * h, ATTENTION, 0.5), "att_b": (ATTENTION,), "att_v": (ATTENTION, 0.5), "out": (2 * h, 0.3), "out_b": (1,)}
        for k in "fb":
            shapes |= {f"w{k}": (d, 3 * h, 0.4), f"b{k}": (3 * h,), f"u{k}": (h, 3 * h, 0.3)}
        for name, shape in shapes.items():
            size = tuple(s for s in shape if isinstance(s, int))
            self.p[name] = (rng.normal(0, shape[-1], size) if isinstance(shape[-1], float) else np.zeros(size)).astype(np.float32)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the word vectors; hashed trigrams end to end; trigrams per word."""
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)), *common.trigrams(words, CHAR_ROWS)

    def inputs(self, ids: np.ndarray, grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.concatenate([self.p["words"][ids], np.add.reduceat(self.p["chars"][grams], starts, axis=0) / lengths[:, None].astype(np.float32)], axis=1)

    def run(self, gates: dict[str, np.ndarray], place: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Scores (before the logistic) of windows. gates: by direction the distinct words' part of the gates; place: (step, window) rows of them; mask: which steps hold a word."""
        p, h = self.p, HIDDEN
        steps, n = place.shape
        states = np.empty((steps, n, 2 * h), dtype=np.float32)
        memo: dict = {}
        for k, order, half in (("f", range(steps), slice(0, h)), ("b", range(steps - 1, -1, -1), slice(h, 2 * h))):
            state, u, table = np.zeros((n, h), dtype=np.float32), p[f"u{k}"], gates[k]
            trail = []
            for t in order:
                x, y = table[place[t]], state @ u
                zr = sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
                z, r, hn = zr[:, :h], zr[:, h:], y[:, 2 * h :]
                new = np.tanh(x[:, 2 * h :] + r * hn)
                before = state
                state = new + z * (before - new)
                state *= mask[t][:, None]
                states[t][:, half] = state
                if keep:
                    trail.append((t, before, z, r, hn, new))
            memo[k] = trail
        hidden = np.tanh(states @ p["att"] + p["att_b"])
        raw = np.where(mask, hidden @ p["att_v"], np.float32(-1e9))
        weight = np.exp(raw - raw.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        return pooled @ p["out"] + p["out_b"], memo | {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled}

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {k: inputs @ self.p[f"w{k}"] + self.p[f"b{k}"] for k in "fb"}

    def gradients(self, inputs: np.ndarray, place: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean log loss: by parameter, and by distinct word's input. place has every word."""
        p, h = self.p, HIDDEN
        score, m = self.run(self.gates(inputs), place, mask, keep=True)
        d_score = ((sigmoid(score) - labels) / len(labels)).astype(np.float32)
        g = {"out": m["pooled"].T @ d_score, "out_b": d_score.sum(keepdims=True)}
        d_pooled = d_score[:, None] * p["out"]
        d_states = m["weight"][..., None] * d_pooled
        d_weight = np.einsum("tnh,nh->tn", m["states"], d_pooled)
        d_raw = m["weight"] * (d_weight - (m["weight"] * d_weight).sum(axis=0))
        g["att_v"] = np.einsum("tna,tn->a", m["hidden"], d_raw)
        d_hidden = d_raw[..., None] * p["att_v"] * (1 - m["hidden"] ** 2)
        g["att"] = np.einsum("tnh,tna->ha", m["states"], d_hidden)
        g["att_b"] = d_hidden.sum(axis=(0, 1))
        d_states += d_hidden @ p["att"].T
        d_inputs = np.zeros_like(inputs)
        by_word = np.argsort(place, axis=None, kind="stable")
        cuts = np.searchsorted(place.reshape(-1)[by_word], np.arange(len(inputs)))
        for k, half in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            carried = np.zeros((place.shape[1], h), dtype=np.float32)
            d_steps = np.empty((*place.shape, 3 * h), dtype=np.float32)
            g[f"u{k}"] = np.zeros_like(p[f"u{k}"])
            for t, before, z, r, hn, new in reversed(m[k]):
                d = (d_states[t][:, half] + carried) * mask[t][:, None]
                d_new = d * (1 - z) * (1 - new**2)
                d_z, d_r = d * (before - new) * z * (1 - z), d_new * hn * r * (1 - r)
                d_y = np.concatenate([d_z, d_r, d_new * r], axis=1)
                carried = d * z + d_y @ p[f"u{k}"].T
                g[f"u{k}"] += before.T @ d_y
                d_steps[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_gate = np.add.reduceat(d_steps.reshape(-1, 3 * h)[by_word], cuts, axis=0)
            g[f"w{k}"], g[f"b{k}"] = inputs.T @ d_gate, d_gate.sum(axis=0)
            d_inputs += d_gate @ p[f"w{k}"].T
        return g, d_inputs


def train(rows: Iterable[tuple[str, int]], steps: int = STEPS, seed: int = 0) -> Network:
    """rows: (text, 1 if toxic)."""
    rng = np.random.default_rng(seed)
    net = Network(seed)
    vocab: dict[str, int] = {}
    held, labels, owners = [], [], []
    spread: Counter[int] = Counter()
    for owner, (text, toxic) in enumerate(rows):
        ids = np.array([vocab.setdefault(w, len(vocab) + 1) for w in common.words(text)], dtype=np.int64)
        spread.update(set(ids.tolist()))
        first = windows(len(ids))
        at = first[:, None] + np.arange(WINDOW)
        held.append(np.where(at < len(ids), np.append(ids, 0)[np.minimum(at, len(ids))], 0).astype(np.int32))
        labels += [toxic] * len(first)
        owners += [owner] * len(first)
    labels, owners = np.array(labels), np.array(owners)
    if not len(labels) or labels.min() == labels.max():
        net.p["out"][:] = 0
        net.p["out_b"][:] = -30
        return net
    table = np.concatenate(held)
    names = ["", *vocab]
    net.vocab = {names[w]: row for row, (w, n) in enumerate(sorted(spread.items(), key=lambda x: (-x[1], x[0]))[: WORD_ROWS - 1], 1) if n >= MIN_DOCS}
    ids, grams, lengths = net.features(names)
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    clean, toxic = np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)
    chosen, hard = toxic, clean
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(steps):
        if step >= steps // 4 and step % max(1, steps // 12) == 0:
            scores = score_table(net, table[toxic], ids, grams, lengths)
            best = np.zeros(len(toxic), dtype=bool)
            for own in np.unique(owners[toxic]):
                mine = np.flatnonzero(owners[toxic] == own)
                best[mine[scores[mine].argmax()]] = True
            chosen = toxic[best | (scores >= 0.5)]
            drawn = rng.choice(clean, min(HARD_POOL, len(clean)), replace=False)
            hard = drawn[np.argsort(-score_table(net, table[drawn], ids, grams, lengths), kind="stable")[: max(BATCH, len(drawn) // 20)]]
        third = BATCH // 3
        pick = np.concatenate([rng.choice(chosen, third), rng.choice(hard, third), rng.choice(clean, BATCH - 2 * third)])
        used, place = np.unique(table[pick].T, return_inverse=True)
        place = place.reshape(WINDOW, -1)
        rows_, nth = common.ragged(lengths[used])
        own_grams = grams[cuts[used][rows_] + nth]
        inputs = net.inputs(ids[used], own_grams, lengths[used])
        mask = table[pick].T > 0
        g, d_inputs = net.gradients(inputs, place, mask, labels[pick])
        g["words"], g["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
        np.add.at(g["words"], ids[used], d_inputs[:, :WORD_DIM])
        np.add.at(g["chars"], own_grams, (d_inputs[:, WORD_DIM:] / lengths[used][:, None])[rows_])
        for k, v in net.p.items():
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            if k in ("words", "chars"):
                v *= 1 - DECAY * RATE * (1 - step / steps)
            v -= (RATE * (1 - step / steps) * first[k] / (1 - 0.9 ** (step + 1)) / (np.sqrt(second[k] / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
    return net


def score_table(net: Network, table: np.ndarray, ids: np.ndarray, grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    gates = net.gates(net.inputs(ids, grams, lengths))
    return np.concatenate([sigmoid(net.run(gates, np.ascontiguousarray(table[i : i + BLOCK].T), table[i : i + BLOCK].T > 0)[0]) for i in range(0, len(table), BLOCK)] or [np.zeros(0)])


class Scorer:
    """Scores texts, keeping distinct words' gate inputs."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.gates = {k: np.zeros((1, 3 * HIDDEN), dtype=np.float32) for k in "fb"}
        self.used = 1

    def scores(self, texts: list[str | None]) -> list[tuple[float | None, int, int | None]]:
        """(worst score, windows, first word of the worst window) by text."""
        if len(self.rows) > MAX_WORDS:
            self.reset()
        rows, known = self.rows, len(self.rows)
        ids = []
        for text in texts:
            cut = common.words(text or "")
            for w in set(cut).difference(rows):
                rows[w] = len(rows)
            ids.append(np.fromiter(map(rows.__getitem__, cut), dtype=np.int64, count=len(cut)))
        if len(rows) > known:
            new = self.net.gates(self.net.inputs(*self.net.features(list(rows)[known:])))
            for k in "fb":
                if len(rows) > len(self.gates[k]):
                    grown = np.empty((max(2 * len(self.gates[k]), len(rows)), 3 * HIDDEN), dtype=np.float32)
                    grown[:known] = self.gates[k][:known]
                    self.gates[k] = grown
                self.gates[k][known : len(rows)] = new[k]
        firsts = [windows(len(i)) for i in ids]
        counts = np.fromiter(map(len, firsts), dtype=np.int64, count=len(ids))
        if not counts.sum():
            return [(None, 0, None)] * len(ids)
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.append(np.concatenate(ids), 0)
        offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        starts, owner = np.concatenate(firsts), np.repeat(np.arange(len(ids)), counts)
        out = np.empty(len(starts), dtype=np.float32)
        order = np.argsort(np.minimum(lengths[owner], WINDOW), kind="stable")
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(order), BLOCK):
            pick = order[at : at + BLOCK]
            size = int(min(WINDOW, lengths[owner[pick]].max()))
            step = steps[:size]
            mask = step + starts[pick] < lengths[owner[pick]]
            place = np.where(mask, flat[np.minimum(offset[owner[pick]] + starts[pick] + step, len(flat) - 1)], 0)
            out[pick] = self.net.run(self.gates, place, mask)[0]
        out = sigmoid(out.astype(np.float64))
        result, at = [], 0
        for n in counts.tolist():
            if n:
                k = int(out[at : at + n].argmax())
                result.append((float(out[at + k]), n, int(starts[at + k])))
            else:
                result.append((None, 0, None))
            at += n
        return result


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic) of a sample of labelled documents: about this many labels, chosen by a hash of their ids, twice as many at most."""
    total = max(labels.count(), 1)
    usable = labels.where("doc_id is not null and toxic is not null")
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40)) < F.lit(int(min(1.0, rows / total) * (1 << 40)))
    few = usable.where(chosen).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).limit(2 * rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # few has at most 2 * rows rows, whatever the input's size
    return texts.join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(2 * rows).select("text", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame | None = None, net: Network | None = None, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, score, n_windows, worst_word (where the worst window begins, in words), toxic. One pass, no shuffle."""
    if net is None:
        net = train((r.text, int(r.toxic > 0)) for r in sample(docs, labels, sample_docs).toLocalIterator()) if labels is not None else train([])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in common.slices(batches, "text"):
            found = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[0] is not None and f[0] >= threshold for f in found], pa.bool_())],
                ["doc_id", "score", "n_windows", "worst_word", "toxic"],
            )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(score, SCHEMA)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents found toxic; every window of every document is scored."""
    return toxicity(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")).where("toxic")
