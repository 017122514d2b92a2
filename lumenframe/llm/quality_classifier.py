"""Quality of texts by positive-unlabelled learning.

Trusted positives are labelled texts of good quality; unlabelled ones are a
sample of all texts.  The classifier minimises the non-negative unbiased risk
(Kiryo et al., 2017): with the class prior p, positives count p times against
their loss as positives, and the negative risk, the unlabelled loss as negatives
less p times the positives' loss as negatives, may not fall below zero.  The
prior is estimated from a first fit: the share of unlabelled texts among all at
the score that most positives pass (Elkan and Noto's estimate, bounded).

Inputs are numbers that describe a text's form, never its source or language.

Both samples are bounded, ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` texts, chosen
by a hash of the id; of texts alike only one is used.

Defined cases: a null, empty or wordless text has the features of one without
words; without positives every score is 0; repeated rows repeat; an empty table
gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, record_batch, running
from .labelled import held_out
from .quality_rules import duplicate_lines, repeated_words
from .textkernel import SPACE, U64, Words, gram_index, grams, mix64, split_batches
from .toxicity import distinct_sample

MOST_POSITIVE, MOST_UNLABELLED = 12_000, 20_000
THRESHOLD = 0.7
#: Hidden units, passes, texts a step, seed of the classifier.
TRAINING = (24, 60, 512, 7)


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_CLASSES = {
    "symbol": _class(b"#*$%&<>~^_=+@{}[]\\/"), "bar": _class(b"|"), "shout": _class(b"!?"), "digit": _class(b"0123456789"),
    "capital": _class(bytes(range(65, 91))), "small": _class(bytes(range(97, 123))), "stop": _class(b"."), "comma": _class(b","), "line": _class(b"\n"),
}


def features(w: Words) -> np.ndarray:
    """Numbers about each text: rates of kinds of characters and words, repetition, lengths."""
    n, sizes = w.counts, np.diff(w.offsets)
    words, size = np.maximum(n, 1), np.maximum(sizes, 1)
    columns = [np.log1p(n), np.log1p(sizes)]
    for name, flags in _CLASSES.items():
        count = per_text(flags[w.data], w.offsets)
        columns += [np.sqrt(count / size), np.log1p(count)] if name in ("symbol", "bar", "shout", "digit", "capital") else [np.sqrt(count / size)]
    columns.append(np.sqrt(per_text(w.data >= 0x80, w.offsets) / size))
    lengths = w.end - w.start
    last = w.data[np.maximum(w.end - 1, 0)]
    odd_end = _CLASSES["symbol"][last] | _CLASSES["shout"][last]
    capital = running(_CLASSES["capital"][w.data])
    shouted = (capital[w.end] - capital[w.start] >= 2) & (2 * (capital[w.end] - capital[w.start]) >= lengths)
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.first[:-1][n > 0]] = False
    for flags in (lengths <= 1, lengths >= 15, odd_end, shouted, same):
        columns.append(np.sqrt(np.diff(running(flags)[w.first]) / words))
    columns.append(np.diff(np.concatenate(([0], np.cumsum(lengths)))[w.first]) / words / 10)
    columns.append(np.sqrt(repeated_words(w) / words))
    columns.append(np.log1p(duplicate_lines(w.data, w.offsets)))
    text_of = w.text_of
    distinct = np.bincount(text_of[np.unique(mix64(w.hash ^ mix64(text_of.astype(U64))), return_index=True)[1]], minlength=len(w))
    columns.append(distinct / words)
    at = gram_index(w.first, 2)
    pair_text = np.searchsorted(w.first, at, side="right") - 1
    pairs = np.bincount(pair_text[np.unique(mix64(grams(w.hash, 2)[at] ^ mix64(pair_text.astype(U64))), return_index=True)[1]], minlength=len(w))
    columns.append(pairs / np.maximum(n - 1, 1))
    columns.append(np.log1p(per_text(~SPACE[w.data], w.offsets) / words))
    return np.stack(columns, axis=1)


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    shift: float = 0.0
    prior: float = 0.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(self.inputs(x) @ a + b) @ c + d + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -50, 50)))


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, training: tuple = TRAINING) -> Classifier:
    """Adam on the non-negative risk with the sigmoid loss."""
    hidden, passes, step, seed = training
    r = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    model = Classifier(mean, scale, (r.normal(0, 0.3, (positive.shape[1], hidden)), np.zeros(hidden), r.normal(0, 0.3, hidden), np.zeros(())))
    p, u = model.inputs(positive), model.inputs(unlabelled)
    first, second, t = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    steps = max(1, -(-len(u) // step))
    for k in range(passes):
        ps, us = np.array_split(r.permutation(len(p)), steps), np.array_split(r.permutation(len(u)), steps)
        for i, j in zip(ps, us, strict=True):
            if not len(i) or not len(j):
                continue
            x = np.concatenate([p[i], u[j]])
            a, b, c, d = model.weights
            h = np.tanh(x @ a + b)
            q = 1 / (1 + np.exp(-(h @ c + d)))  # the loss as a negative; 1 - q as a positive
            slope = q * (1 - q)
            gain = np.zeros(len(x))
            negative = q[len(i) :].mean() - prior * q[: len(i)].mean()
            gain[: len(i)] = -prior * slope[: len(i)] / len(i)
            if negative >= 0:
                gain[: len(i)] -= prior * slope[: len(i)] / len(i)
                gain[len(i) :] = slope[len(i) :] / len(j)
            else:  # step back on the negative risk alone
                gain[: len(i)] = prior * slope[: len(i)] / len(i)
                gain[len(i) :] = -slope[len(i) :] / len(j)
            back = gain[:, None] * c * (1 - h**2)
            grads = (x.T @ back + 1e-4 * a, back.sum(axis=0), h.T @ gain + 1e-4 * c, gain.sum())
            t += 1
            new = []
            for n, (w, g) in enumerate(zip(model.weights, grads, strict=True)):
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                new.append(w - 0.01 * (1 - k / passes) * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8))
            model.weights = tuple(new)
    model.prior = prior
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: where nearly all positives pass, the passing unlabelled are mostly positive too."""
    model = _train(positive, unlabelled, 0.5)
    p, u = np.sort(model.logits(positive)), np.sort(model.logits(unlabelled))
    best = 1.0
    for share in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95):
        cut = p[int(len(p) * (1 - share))]
        passing = 1 - np.searchsorted(u, cut) / len(u)
        noise = 1.5 * np.sqrt(0.25 / len(u) + 0.25 / len(p))
        best = min(best, (passing + noise) / (share - noise) if share > noise else 1.0)
    return float(min(max(best, 0.05), 0.95))


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float, loss: float = 3.0) -> float:
    """The cut of sorted logits with the least estimated cost: positives below it, ``loss`` times each, and negatives above it.

    Negatives above are the unlabelled above less the positives' share of them.  Between equal costs the lowest cut,
    and the middle of the gap below it.
    """
    best, cost = float(positive[0]), np.inf
    for share in np.linspace(0, 0.1, 201):
        cut = positive[int(share * (len(positive) - 1))]
        below = np.searchsorted(positive, cut) / len(positive)
        above = max(0.0, 1 - np.searchsorted(unlabelled, cut) / len(unlabelled) - prior * (1 - below))
        if (now := loss * prior * below + above) < cost - 1e-12:
            best, cost = float(cut), now
    under = unlabelled[: np.searchsorted(unlabelled, best)]
    return (best + max(float(under[-1]), best - 1.0)) / 2 if len(under) else best


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Classifier | None:
    trusted = distinct_sample(docs, labels.where("quality = 1"), "quality", most_positive).select("text", F.lit(1).alias("label"))
    total = docs.count()
    # The unlabelled sample: the ids with the smallest hashes, by a share that gives about as many as asked for.
    share = min(1.0, 2.0 * most_unlabelled / max(total, 1))
    some = docs.select(F.col("doc_id"), F.lit(0).alias("mark")).where((F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))) & ~held_out())
    unlabelled = distinct_sample(docs, some.where("doc_id is not null"), "mark", most_unlabelled).select("text", F.col("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in split_batches(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(list(features(w)), type=pa.list_(pa.float64()))], names=["label", "f"])

    rows = trusted.unionByName(unlabelled).mapInArrow(run, "label int, f array<double>").collect()  # at most the two bounds
    x, y = np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows])
    if not (y == 1).any() or not (y == 0).any():
        return None
    x = x[np.lexsort((*x.T, y))]
    y = np.sort(y)
    positive, unlabelled_x = x[y == 1], x[y == 0]
    model = _train(positive, unlabelled_x, estimate_prior(positive, unlabelled_x))
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(np.sort(model.logits(positive)), np.sort(model.logits(unlabelled_x)), model.prior))
    return model


def score(docs: DataFrame, model: Classifier | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and score."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([(doc_id, batch.schema.field(0).type), ("score", pa.float64())])
            for a, b, w in split_batches(batch.column(1)):
                yield record_batch({doc_id: batch.column(0).slice(a, b - a), "score": model.score(features(w)) if model else np.zeros(b - a)}, schema)

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
