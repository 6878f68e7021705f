"""Toxicity: a linear-chain conditional random field over tokens, its marginals summed up per document.

Labels are per document, so tokens are labelled first: a word feature (form, prefix, suffix) that
toxic training documents hold far more often than clean ones marks its tokens there as toxic; all
tokens of clean documents are clean. The field is then trained on those token labels by gradient
ascent on its likelihood. A document's score is a logistic function, fitted on the same training
documents, of its expected number of toxic tokens, their share, and the largest marginal.

The model is fitted on a bounded sample of labelled rows: ``fit_toxic`` and ``fit_clean`` rows,
those of smallest id hash, less texts above ``fit_chars`` characters. So the driver gets at most
(fit_toxic + fit_clean) x fit_chars characters, and the model is a few hundred KB, whatever the
corpus. Scoring is one scan of all texts, however long.

Cases. A null or empty text has no tokens and gets the score of zero evidence. A null doc_id is
scored like others and not held out. Repeated rows get equal scores. Rows without labels aren't
trained on; without both classes every score is 0. An empty table gives an empty result. Extra
columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 900, 1800, 30_000
SLOTS = 1 << 17
THRESHOLD = 0.3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = " \t.,;:!?\"'()[]{}<>#*$%&|~_/\\"


def word_features(word: bytes) -> list[int]:
    """Hashed slots of a word's form, prefixes and suffix; case and edge punctuation don't count."""
    w = word.decode(errors="replace").lower().strip(_EDGES)
    found = {f"w{w}", f"s{w[-4:]}", *(f"p{w[:k]}" for k in (4, 5, 6) if len(w) > k)}
    return sorted({zlib.crc32(x.encode()) % SLOTS for x in found})


class Emissions(dict):
    """Score of each word under the toxic state, computed once per word; the table is bounded."""

    def __init__(self, weights: np.ndarray, most: int = 400_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = s = float(self.weights[word_features(word)].sum())
        return s


def marginals(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bias: float, transition: np.ndarray, pairs: bool = False):
    """Forward-backward for many documents at once: P(toxic) per token, and summed pair marginals.

    Two states need only ratios: f is the forward odds of "toxic", b the backward ratio. Documents
    are taken longest first, so each step is a vector operation over those that still have tokens.
    """
    e = np.exp(np.clip(scores + bias, -30, 30))
    (t00, t01), (t10, t11) = np.exp(transition)
    order = np.argsort(-lengths, kind="stable")
    at, length = starts[order], lengths[order]
    f, b = np.empty_like(e), np.ones_like(e)
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), side="left")
    state = None
    for t in range(longest):
        k = at[: alive[t]] + t
        if t == 0:
            state = e[k]
        else:
            state = state[: alive[t]]
            state = e[k] * (t01 + t11 * state) / (t00 + t10 * state)
        state = np.clip(state, 1e-12, 1e12)
        f[k] = state
    for t in range(longest - 1, 0, -1):
        k = at[: alive[t]] + t
        x = e[k] * b[k]
        b[k - 1] = np.clip((t10 + t11 * x) / (t00 + t01 * x), 1e-12, 1e12)
    odds = np.clip(f * b, 1e-12, 1e12)
    p = odds / (1 + odds)
    if not pairs:
        return p, None
    inner = np.ones(len(e), dtype=bool)
    inner[starts[lengths > 0]] = False
    k = np.flatnonzero(inner)
    x = e[k] * b[k]
    joint = np.stack([np.full(len(k), t00), t01 * x, t10 * f[k - 1], t11 * f[k - 1] * x])
    return p, (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)


def _spread(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    n = np.asarray(lengths, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else n, n


@dataclass
class ToxicityModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, dtype=np.float32))
    bias: float = -6.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(4))
    trained: bool = False

    def evidence(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(1, log expected toxic tokens, log of their share, largest marginal) per document."""
        out = np.zeros((len(lengths), 4))
        out[:, 0] = 1
        some = np.flatnonzero(lengths)
        if len(some):
            at = _spread(lengths)[0][some]
            total = np.add.reduceat(p, at)
            out[some, 1] = np.log1p(total)
            out[some, 2] = np.log1p(1000 * total / lengths[some])
            out[some, 3] = np.maximum.reduceat(p, at)
        return out

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(evidence @ self.logistic, -30, 30)))


def token_lexicon(docs: Sequence[list[bytes]], toxic: Sequence[int], min_docs: int = 4, min_ratio: float = 12.0) -> set[int]:
    """Slots that toxic documents hold ``min_ratio`` times as often as clean ones."""
    held = (Counter(), Counter())
    for words, y in zip(docs, toxic):
        held[y].update({s for w in set(words) for s in word_features(w)})
    bad, good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    return {s for s, n in held[1].items() if n >= min_docs and (n / bad) / ((held[0][s] + 0.5) / good) >= min_ratio}


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -5, 5)
    return w


def fit(texts: Sequence[str | None], toxic: Sequence[int], *, steps: int = 60, rate: float = 0.3, decay: float = 1e-3, stretch: int = 1000) -> ToxicityModel:
    """Label tokens, train the field by Adam on its mean log-likelihood, then the document's logistic.

    The field is trained on stretches of at most ``stretch`` tokens, so that one long document
    doesn't set the number of steps; all tokens count. The logistic sees whole documents.
    """
    model = ToxicityModel()
    if len(set(toxic)) < 2:
        return model
    docs = [(t or "").encode().split() for t in texts]
    types: dict[bytes, int] = {}
    ids = np.array([types.setdefault(w, len(types)) for d in docs for w in d], dtype=np.int64)
    starts, lengths = _spread([len(d) for d in docs])
    slots = [word_features(w) for w in types]
    owner = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    flat = np.array([s for x in slots for s in x], dtype=np.int64)
    lexicon = token_lexicon(docs, toxic)
    marked = np.array([any(s in lexicon for s in x) for x in slots], dtype=float)
    y = marked[ids] * np.repeat(np.asarray(toxic, dtype=float), lengths)
    parts = _spread([min(stretch, n - k) for n in lengths.tolist() for k in range(0, n, stretch)])
    inner = np.ones(len(ids), dtype=bool)
    inner[parts[0]] = False
    k = np.flatnonzero(inner)
    seen = np.array([[((1 - y[k - 1]) * (1 - y[k])).sum(), ((1 - y[k - 1]) * y[k]).sum()], [(y[k - 1] * (1 - y[k])).sum(), (y[k - 1] * y[k]).sum()]])
    weights, rest = np.zeros(SLOTS), np.concatenate([[model.bias], np.zeros(4)])
    moments = [[np.zeros(SLOTS), np.zeros(SLOTS)], [np.zeros(5), np.zeros(5)]]
    scale = max(1.0, y.sum())
    for step in range(1, steps + 1):
        emission = np.bincount(owner, weights[flat], minlength=len(slots))
        p, pair = marginals(emission[ids], *parts, rest[0], rest[1:].reshape(2, 2), pairs=True)
        wrong = y - p
        by_type = np.bincount(ids, wrong, minlength=len(slots))
        grads = (np.bincount(flat, by_type[owner], minlength=SLOTS) / scale - decay * weights, np.concatenate([[wrong.sum() / scale], ((seen - pair) / scale).ravel() - decay * rest[1:]]))
        for value, grad, (m, v) in zip((weights, rest), grads, moments):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
    model.weights, model.bias, model.transition, model.trained = weights.astype(np.float32), float(rest[0]), rest[1:].reshape(2, 2), True
    emission = np.bincount(owner, weights[flat], minlength=len(slots))
    p, _ = marginals(emission[ids], starts, lengths, model.bias, model.transition)
    model.logistic = _fit_logistic(model.evidence(p, lengths), np.asarray(toxic, dtype=float))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, *, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, fit_chars: int = FIT_CHARS) -> ToxicityModel:
    """Train on a bounded sample of the labelled rows that aren't held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    least = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = least(1, fit_toxic).unionByName(least(0, fit_clean))
    short = docs.select("doc_id", "text").filter(F.col("text").isNull() | (F.char_length("text") <= fit_chars))
    rows = short.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def score_documents(docs: DataFrame, model: ToxicityModel, *, span_at: float = 0.5) -> DataFrame:
    """(doc_id, score, spans): spans are code point offsets of runs of tokens at ``span_at`` or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model.weights)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            flat: list[float] = []
            counts = []
            for t in texts:
                words = t.encode().split()
                flat.extend(map(emissions.__getitem__, words))
                counts.append(len(words))
            starts, lengths = _spread(counts)
            p, _ = marginals(np.array(flat), starts, lengths, model.bias, model.transition)
            score = model.scores(model.evidence(p, lengths))
            spans: list[list[dict]] = [[] for _ in texts]
            hit = np.flatnonzero(p >= span_at) if model.trained else np.empty(0, dtype=int)
            doc_of = np.searchsorted(starts, hit, side="right") - 1
            for d in np.unique(doc_of):
                tokens = list(_WORD.finditer(texts[d]))
                last = None
                for t in hit[doc_of == d] - starts[d]:
                    if last is not None and t == last + 1:
                        spans[d][-1]["stop"] = tokens[t].end()
                    else:
                        spans[d].append({"start": tokens[t].start(), "stop": tokens[t].end()})
                    last = t
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,stop:int>>")
