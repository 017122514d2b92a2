"""Quality rules: plain counts of a text, and perplexity bands under a byte n-gram model.

The model is an interpolated modified Kneser-Ney model of five bytes, counted
in Spark over all texts and kept in sorted hash arrays.  For each language the
bands lie ``spread`` robust deviations on either side of the median log
perplexity of its texts of ``LEAST_BYTES`` or more, or of all its texts where
fewer than half are so long; for a shorter text they are wider.  A text outside is
rejected, as is one that the plain rules reject.

Defined cases: a null or empty text has no words, fails the plain rules and has
no perplexity; rows without a language share one pair of bands; repeated rows
each count; a language whose texts all score alike gets bands of ``least`` on
either side; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import fresh_folder, materialise
from . import kneser_ney as kn
from .common import per_text, ranges_for, record_batch, releasing, running, segment_sums
from .textkernel import SPACE, U64, Words, buffers, gram_index, grams, mix64, slices, split, split_batches

ORDER, BITS = 5, 8
#: Width of the bands below and above, in robust deviations, and their least half width in log10 per byte.
SPREAD_LOW, SPREAD_HIGH, LEAST = 8.0, 4.0, 0.02
#: For a text shorter than this the bands are wider, as 1 / bytes: so grows the share of what its first bytes and its end cost.
LEAST_BYTES = 200
#: Ranges of the model's keys, at most; a range is then summed in bounded memory, from groups of map tasks.
MOST_RANGES = 512

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the five bytes that end at each byte and at each text's end, and where each text's begin."""
    n, texts, pad = len(data), len(offsets) - 1, ORDER - 1
    text_of = np.repeat(np.arange(texts), np.diff(offsets))
    wide = np.zeros(n + texts * ORDER, dtype=np.uint8)
    wide[np.arange(n) + text_of * ORDER + pad] = data
    ends = offsets[1:] + np.arange(texts) * ORDER + pad
    wide[ends] = 0xFF
    keys = np.zeros(len(wide), dtype=U64)
    for k in range(ORDER):
        keys[k:] |= wide[: len(wide) - k].astype(U64) << U64(BITS * k)
    real = np.ones(len(wide), dtype=bool)
    starts = offsets[:-1] + np.arange(texts) * ORDER
    for k in range(pad):
        real[starts + k] = False
    return keys[real], offsets + np.arange(texts + 1)


def _byte_slices(column: pa.Array, most: int = 1 << 20):
    data, offsets = buffers(column)
    for a, b in slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def fit(docs: DataFrame, text: str = "text", shards: int = 8) -> kn.KneserNey:
    """The byte model of all texts, in ``shards`` ranges of keys; the number of distinct five-byte runs bounds its size."""
    folder = fresh_folder(docs.sparkSession, "byte-model")

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in _byte_slices(batch.column(0)):
            yield _keys(data, offsets)[0]

    counts = docs.select(text).mapInArrow(releasing(kn.counting(keys_of, f"g{ORDER}", shards)), kn.SCHEMA)
    return kn.fit(docs.sparkSession, counts, ORDER, BITS, shards, folder, 256)


def repeated_words(w: Words, width: int = 5) -> np.ndarray:
    """Per text: words that lie in a run of ``width`` words found twice or more in that text."""
    at = gram_index(w.first, width)
    if not len(at):
        return np.zeros(len(w), dtype=np.int64)
    text_of = np.searchsorted(w.first, at, side="right") - 1
    keys = mix64(grams(w.hash, width)[at] + text_of.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.hash) + 1, dtype=np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    return np.diff(running(np.cumsum(edge[:-1]) > 0)[w.first])


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    lines = split(data, offsets, outside=_NEWLINE)
    letters = running(~SPACE[data])
    full = letters[lines.end] > letters[lines.start]
    text_of = lines.text_of[full]
    keys = mix64(lines.hash[full] + text_of.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, one = np.unique(keys, return_index=True)
    n = len(offsets) - 1
    return np.bincount(text_of, minlength=n) - np.bincount(text_of[one], minlength=n)


def measure(docs: DataFrame, model: kn.KneserNey, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: the counts of the plain rules, base_failed and log10 perplexity per byte (null without bytes)."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (doc_id, lang)]
    fields = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_bytes", pa.int64()), ("log_perplexity", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([(doc_id, batch.schema.field(0).type), (lang, batch.schema.field(1).type), *fields])
            for a, b, w in split_batches(batch.column(2)):
                sizes = np.diff(w.offsets)
                keys, bounds = _keys(w.data, w.offsets)
                perplexity = -segment_sums(model.log10(keys), bounds) / (sizes + 1)
                letters = ~SPACE[w.data] & ((w.data & 0xC0) != 0x80)
                yield record_batch(
                    {doc_id: batch.column(0).slice(a, b - a), lang: batch.column(1).slice(a, b - a), "n_words": w.counts, "word_chars": per_text(letters, w.offsets), "n_symbols": per_text(_SYMBOL[w.data], w.offsets), "n_dup_lines": duplicate_lines(w.data, w.offsets), "n_repeat_words": repeated_words(w), "n_bytes": sizes, "log_perplexity": pa.array(perplexity, mask=sizes == 0)},
                    schema,
                )

    out = docs.select(doc_id, lang, text).mapInArrow(releasing(run), f"{doc_id} {kinds[0]}, {lang} {kinds[1]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, log_perplexity double")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _share() -> Column:
    """A text's bytes as a share of LEAST_BYTES, 1 at most."""
    return F.greatest(F.least("n_bytes", F.lit(LEAST_BYTES)), F.lit(1)) / LEAST_BYTES


def _quantiles(column: Column, *at: float) -> Column:
    return F.percentile_approx(column, F.array(*map(F.lit, at)), 10000)


def bands(measured: DataFrame, lang: str = "lang", low: float = SPREAD_LOW, high: float = SPREAD_HIGH, least: float = LEAST) -> DataFrame:
    """measure()'s rows with the lowest and highest log perplexity that is kept; where short texts count for them, their deviations count by their share."""
    own = F.col(lang).eqNullSafe(F.col("band_lang"))
    by_lang = F.col(lang).alias("band_lang")
    score, long = F.col("log_perplexity"), F.col("n_bytes") >= LEAST_BYTES
    told = measured.groupBy(by_lang).agg(F.count_if(long).alias("n_long"), F.count(score).alias("n_all"), _quantiles(F.when(long, score), 0.5)[0].alias("of_long"), _quantiles(score, 0.5)[0].alias("of_all"))
    most = 2 * F.col("n_long") >= F.col("n_all")
    middle = told.select("band_lang", F.when(most, F.col("of_long")).otherwise(F.col("of_all")).alias("middle"), most.alias("most_long"))
    centred = measured.join(middle, own, "left").drop("band_lang")
    spread = centred.groupBy(by_lang).agg(_quantiles(F.when(long | ~F.col("most_long"), (score - F.col("middle")) * _share()), 0.25, 0.75).alias("q"))
    width = F.greatest((F.col("q")[1] - F.col("q")[0]) / 1.349, F.lit(least / low)) / _share()
    joined = centred.join(spread, own, "left")
    return joined.withColumn("lower_band", F.col("middle") - low * width).withColumn("upper_band", F.col("middle") + high * width).drop("band_lang", "middle", "most_long", "q")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: measure()'s columns, the bands of its language for its length and ``kept``."""
    measured = materialise(measure(docs, fit(docs, text, ranges_for(docs, most=MOST_RANGES)), doc_id, text, lang), "quality-measures")
    inside = F.col("log_perplexity").between(F.col("lower_band"), F.col("upper_band"))
    return bands(measured, lang).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower_band", "upper_band")
