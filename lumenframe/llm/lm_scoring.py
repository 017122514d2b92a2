"""Language-model scores of whole texts: an interpolated modified Kneser-Ney word bigram model.

Counted in Spark over the training texts, stored as sorted hash arrays in the
shared folder, mapped into memory by the scoring workers.  Three passes over
the texts: vocabulary, n-grams, scores.  Nothing that grows with the corpus
reaches the driver; both the vocabulary and the n-grams stay in key ranges.

Defined cases: a null text or one without words is only its end token; a null
id counts as an empty id and trains; without training texts every token is
unknown and has probability 1; repeated rows count as often as they occur; only
the named columns are read, so that others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import fresh_folder
from . import kneser_ney as kn
from .common import ranges_for, record_batch, remainder, segment_sums
from .textkernel import U64, split_batches

#: Stands for a text's end among the word hashes.
END_HASH = U64(0xE0D0E0D0E0D0E0D1)
UNKNOWN, START, FIRST_ID = 0, 1, 2
ORDER, BITS = 2, 32
SLICE = 2 << 20


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last text, hashes of words and ends in order, where each text's begin) by slices."""
    for a, b, w in split_batches(column, lower=True, most=SLICE):
        n = b - a
        hashes = np.empty(len(w.hash) + n, dtype=U64)
        ends = w.first[1:] + np.arange(n)
        is_word = np.ones(len(hashes), dtype=bool)
        is_word[ends] = False
        hashes[is_word] = w.hash
        hashes[ends] = END_HASH
        yield a, b, hashes, np.concatenate(([0], ends + 1))


@dataclass
class LanguageModel:
    vocabulary: kn.SortedTable
    train_tokens: int
    ngrams: kn.KneserNey

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count in training) of each token; an unknown one has id 0."""
        return _ids(self.vocabulary, hashes)


def _ids(vocabulary: kn.SortedTable, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(hashes, return_inverse=True)
    counts, place = vocabulary.find(distinct, 1)
    return np.where(place < 0, UNKNOWN, place + FIRST_ID).astype(U64)[back], counts[:, 0][back]


def _keys(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = START
    return before << U64(BITS) | ids


def fit(docs: DataFrame, text: str, train: Column) -> LanguageModel:
    """Learns from the rows where ``train`` holds."""
    spark, shards = docs.sparkSession, ranges_for(docs)
    folder = fresh_folder(spark, "ngram-model")
    texts = docs.where(train).select(F.col(text).alias("text"))

    def words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, hashes, _ in _tokens(batch.column(0)):
            yield hashes

    counts = texts.mapInArrow(kn.counting(words, "g1", shards, spread=False), kn.SCHEMA)
    vocabulary, total = kn.count_table(counts, shards, f"{folder}/words")

    def bigrams(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, hashes, bounds in _tokens(batch.column(0)):
            yield _keys(_ids(vocabulary, hashes)[0], bounds)

    if len(vocabulary) + FIRST_ID >= 1 << BITS:
        raise ValueError(f"{len(vocabulary)} distinct words do not fit ids of {BITS} bits")
    pairs = texts.mapInArrow(kn.counting(bigrams, f"g{ORDER}", shards), kn.SCHEMA)
    return LanguageModel(vocabulary, total, kn.fit(spark, pairs, ORDER, BITS, shards, f"{folder}/ngrams", len(vocabulary)))


def score(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_tokens, n_known, train_tokens, base_score, score (both log10), perplexity per token."""
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())]
    total, size = model.train_tokens, len(model.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([(doc_id, batch.schema.field(0).type), *fields])
            for a, b, hashes, bounds in _tokens(batch.column(1)):
                ids, counts = model.ids(hashes)
                n = np.diff(bounds)
                base = np.log10((counts.astype(float) + 0.5) / (total + 0.5 * (size + 1)))
                own = segment_sums(model.ngrams.log10(_keys(ids, bounds)), bounds)
                yield record_batch({doc_id: batch.column(0).slice(a, b - a), "n_tokens": n, "n_known": segment_sums((counts > 0).astype(np.int64), bounds).astype(np.int64), "train_tokens": np.full(b - a, total), "base_score": segment_sums(base, bounds), "score": own, "perplexity": 10 ** np.minimum(-own / n, 300)}, schema)

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(column: str = "doc_id") -> Column:
    return remainder(column, 5) == 1


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs, "text", ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
