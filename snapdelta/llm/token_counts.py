"""Operator 1, token counts: unigram segmentation by forward scores over a trie of distinct pre-tokens.

Texts are cut at white space; every distinct pre-token (its letters behind the word mark U+2581) goes into a trie. A
node stands for a prefix and holds that prefix's forward score, the best sum of unigram scores of pieces that spell it,
and how many pieces that takes. It is computed once, from its ancestors, for all pre-tokens that share the prefix; the
number at a pre-token's last node is stored as its terminal count, and a document's count is the sum over its
pre-tokens. Scores are integers (micro-nats), so the result doesn't depend on the order of additions; of two equal
segmentations the one of fewer pieces counts. A character that no piece spells costs one byte token per UTF-8 byte.

The vocabulary is a public file, given by path, read on the driver and broadcast (its size is fixed). Such files order
pieces by rank; a rank's score is its logarithmic share under the Zipf-Mandelbrot law 1 / (rank + 2.7).

Defined results: a null text gives null counts, an empty or blank one zeros; a null doc_id keeps its row; repeated rows
are counted each; an empty table gives no rows; other columns are ignored. Very long texts are counted whole. The trie
is emptied when it reaches MAX_NODES: that bounds memory and changes no count. Which pieces end at a node comes from an Aho-Corasick
automaton of the vocabulary, whose state each node keeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_NODES = 400_000
MARK = "▁"
OFFSET = 2.7
SCHEMA = "doc_id bigint, source string, n_words bigint, n_tokens bigint"


def vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """Pieces with integer scores; byte and control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    total = math.log(sum(1 / (r + OFFSET) for r in range(size)))
    return {
        model.id_to_piece(r): round(-1e6 * (math.log(r + OFFSET) + total))
        for r in range(size)
        if not (model.is_byte(r) or model.is_control(r) or model.is_unknown(r) or model.is_unused(r))
    }


class Pieces:
    """The vocabulary as an automaton: a state's ends are the pieces, as (length, score), that end at its letter."""

    def __init__(self, scores: dict[str, int]):
        self.byte = min(scores.values(), default=0) - 1_000_000
        self.step: dict[int, int] = {}  # state and letter packed into one integer: those the garbage collector need not visit
        own: list[tuple[int, int] | None] = [None]
        below: list[list[tuple[str, int]]] = [[]]
        for piece, score in scores.items():
            state = 0
            for c in piece:
                if (found := self.step.get(state << 21 | ord(c))) is None:
                    found = self.step[state << 21 | ord(c)] = len(own)
                    own.append(None)
                    below[state].append((c, found))
                    below.append([])
                state = found
            own[state] = (len(piece), score)
        self.back, self.ends = [0] * len(own), [()] * len(own)
        queue = [0]
        for state in queue:
            for c, child in below[state]:
                back = self.back[state]
                while back and (back << 21 | ord(c)) not in self.step:
                    back = self.back[back]
                self.back[child] = self.step.get(back << 21 | ord(c), 0) if state else 0
                self.ends[child] = ((own[child],) if own[child] else ()) + self.ends[self.back[child]]
                queue.append(child)


class PreTokenTrie(dict):
    """Maps a pre-token to its terminal count; looking up a new one inserts it."""

    def __init__(self, pieces: Pieces, max_nodes: int = MAX_NODES):
        super().__init__()
        self.vocabulary, self.max_nodes, self.computed = pieces, max_nodes, 0
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.next: dict[int, int] = {}
        self.forward, self.pieces, self.state = [0], [0], [0]

    def __missing__(self, word: str) -> int:
        if len(self.forward) > self.max_nodes:
            self.reset()
        step, forward, pieces, states = self.next, self.forward, self.pieces, self.state
        go, back, ends, byte = self.vocabulary.step, self.vocabulary.back, self.vocabulary.ends, self.vocabulary.byte
        path, node = [0], 0
        for c in (text := MARK + word):
            node = step.get(node << 21 | ord(c), -1)
            if node < 0:
                break
            path.append(node)
        node = path[-1]
        for end in range(len(path), len(text) + 1):
            c = text[end - 1]
            letter = ord(c)
            state = states[node]
            while (found := go.get(state << 21 | letter)) is None and state:
                state = back[state]
            state = found or 0
            best = None
            for length, score in ends[state]:
                before = path[end - length]
                score += forward[before]
                if best is None or score > best or score == best and pieces[before] + 1 < count:
                    best, count = score, pieces[before] + 1
            size = 1 if letter < 128 else len(c.encode("utf-8", "surrogatepass"))
            score = forward[node] + byte * size
            if best is None or score > best:
                best, count = score, pieces[node] + size
            step[node << 21 | letter] = len(forward)
            node = len(forward)
            path.append(node)
            forward.append(best)
            pieces.append(count)
            states.append(state)
            self.computed += 1
        self[word] = count = pieces[node]
        return count


def token_counts(docs: DataFrame, vocabulary_path: str = VOCABULARY, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row per document: doc_id, source, n_words, n_tokens. One pass, no shuffle."""
    scores = docs.sparkSession.sparkContext.broadcast(Pieces(vocabulary(vocabulary_path)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PreTokenTrie(scores.value, max_nodes)
        for batch in common.slices(batches, "text"):
            words, tokens = [], []
            for text in batch.column(1):
                text = text.as_py()
                if text is None:
                    words.append(None)
                    tokens.append(None)
                else:
                    cut = text.split()
                    words.append(len(cut))
                    tokens.append(sum(map(trie.__getitem__, cut)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "source", "n_words", "n_tokens"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text", "cast(source as string) as source").mapInArrow(count, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the vocabulary that the session's setting spark.snapdelta.vocabulary names, if it does."""
    return token_counts(common.read(spark, sf_dir, "documents"), spark.conf.get("spark.snapdelta.vocabulary", VOCABULARY))
