"""Operator 2, token counts: trie-shared dynamic programming over a unigram vocabulary.

The distinct pre-tokens of up to 24 MB of texts form a trie of bytes, laid out depth first: words in order, each
adding the nodes beyond its common prefix with the word before. The forward score of a node is the best of its
ancestors' scores plus the score of the piece between them; it is computed when the node is added, so once for every
word that shares the prefix, and only the open path is held. A word's last node stores its token count (its terminal
count); texts add up those of their pre-tokens. Words and pieces are told apart by their bytes.

A piece of rank r has the Zipf score -round(1000 * ln(r + 1)) - CONSTANT, in whole thousandths, so
sums are exact. Between equal scores the segmentation with fewer tokens wins, which the answer shows.
Defined cases: null and empty texts count 0; repeated rows count alike; a word of any length is one path; extra columns
are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import read_ranks
from .common import chunks, trim, utf8
from .pretokens import CORPUS_BYTES, PATTERN, Corpus

SCHEMA = "doc_id long, n_pretokens long, n_tokens long, score long"
LOW = -(1 << 60)


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Unigram scores by Zipf's law over ranks, in thousandths of a nat."""
    constant = round(1000 * math.log(sum(1 / (r + 1) for r in ranks.values())))
    return {t: -round(1000 * math.log(r + 1)) - constant for t, r in ranks.items()}


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


class Unigram:
    def __init__(self, scores: dict[bytes, int]):
        #: The pieces by their last byte, then the one before: (state << 8 | byte) to the next state, and each state's score.
        self.back: dict[int, int] = {}
        self.value: list[int | None] = [None]
        for piece, v in scores.items():
            state = 0
            for b in reversed(piece):
                key = state << 8 | b
                if key not in self.back:
                    self.back[key] = len(self.value)
                    self.value.append(None)
                state = self.back[key]
            self.value[state] = v

    def forward(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(best score, its token count) of each word, LOW and 0 where none leads to its end."""
        best, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        step, value = self.back.get, self.value
        score, tokens, before = array("q", [0]), array("q", [0]), b""  # of the open path's nodes
        for i in sorted(range(len(words)), key=words.__getitem__):
            w = words[i]
            shared = common_prefix(before, w)
            del score[shared + 1 :], tokens[shared + 1 :]
            for d in range(shared, len(w)):
                top, few, state = LOW, 0, 0
                for at in range(d, -1, -1):  # pieces that end here, shortest first
                    state = step(state << 8 | w[at])
                    if state is None:
                        break
                    v = value[state]
                    if v is not None and (x := score[at]) > LOW:
                        x += v
                        if x > top or x == top and tokens[at] + 1 < few:
                            top, few = x, tokens[at] + 1
                score.append(top)
                tokens.append(few)
            best[i], count[i] = score[-1], tokens[-1]
            before = w
        return best, count


_MODELS: dict[str, Unigram] = {}


def _run(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(ranks.value).hexdigest()
        if key not in _MODELS:
            _MODELS[key] = Unigram(piece_scores(read_ranks(ranks.value)))
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for a, b in chunks(off, CORPUS_BYTES):
                trim()
                c = Corpus(buf[off[a] : off[b]], off[a : b + 1] - off[a], pattern)
                raw, ends = c.flat.tobytes(), np.cumsum(c.size).tolist()
                score, count = _MODELS[key].forward([raw[x:y] for x, y in zip([0, *ends], ends)])
                total = [np.append(0, np.cumsum(x[c.use]))[c.firsts] for x in (count, score)]
                cols = [np.diff(c.firsts), *map(np.diff, total)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in cols)], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, ranks: bytes, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pre-tokens, tokens of the best segmentation, and its score (thousandths of a nat) of each row."""
    cols = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return cols.mapInArrow(_run(docs.sparkSession.sparkContext.broadcast(ranks), pattern), SCHEMA)
