"""License notices in texts: exact phrases, and short notices with a bounded number of edits.

Fuzzy notices are sought on the text's small letters and digits, words joined by
one space.  A notice that may differ in k edits is split into k + 1 pieces; at
least one of them stands unchanged in any occurrence, so one automaton over all
pieces finds every candidate.  The few letters around each candidate are searched
by the regex library's bounded-error matching, which verifies the edits and gives
the best span there; candidates go from left to right, and one notice's spans do
not overlap.  Equal surroundings are searched once, so a text's time grows with its
length.

Score: 1 where a base phrase stands; else the highest share of a notice's
letters that its best match leaves unchanged; 0 without any match.

Defined cases: a null, empty or wordless text has no places, empty label strings
and score 0; overlapping places of one phrase all count; repeated rows repeat; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch
from .textkernel import NOT_ALNUM, U64, split_batches, word_hash

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices, their labels, and the edits that each may have.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache", 5),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("licensed under the gnu general public license version 3", "gpl", 6),
    ("licensed under the gnu general public license version 2", "gpl", 6),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("mozilla public license version 2 0", "mpl", 3),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2),
    ("creative commons attribution", "cc-by", 3),
    ("creative commons zero public domain dedication", "cc0", 4),
    ("free and unencumbered software released into the public domain", "unlicense", 6),
    ("spdx license identifier", "spdx", 2),
    ("all rights reserved", "proprietary", 2),
)

_SMALL = bytes((k + 32 if 65 <= k <= 90 else 0x20 if NOT_ALNUM[k] else k) for k in range(256))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in edits + 1 pieces of like length, with their places."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=8)
def _machine(notices: tuple) -> tuple[ahocorasick.Automaton, list[regex.Pattern]]:
    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, (notice, _, edits) in enumerate(notices):
        for at, piece in pieces(notice, edits):
            seeds.setdefault(piece, []).append((k, at))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return automaton, [regex.compile(f"(?b)(?:{regex.escape(n, special_only=True, literal_spaces=True)}){{e<={e}}}") for n, _, e in notices]


@lru_cache(maxsize=20000)
def _best(pattern: regex.Pattern, part: str) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best match in a few letters."""
    m = pattern.search(part)
    return m and (m.start(), m.end(), sum(m.fuzzy_counts))


def notices_in(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the matches in a normalised text; of overlapping ones of a notice the one whose candidate comes first."""
    automaton, patterns = _machine(notices)
    near: dict[int, set[int]] = {}
    for end, (size, uses) in automaton.iter(text):
        for k, at in uses:
            near.setdefault(k, set()).add(end - size + 1 - at)
    found = []
    for k, starts in near.items():
        size, edits, free = len(notices[k][0]), notices[k][2], 0
        for start in sorted(starts):
            low, high = max(free, start - edits), min(len(text), start + size + edits)
            if high - low >= size - edits and (m := _best(patterns[k], text[low:high])) is not None:
                found.append((k, low + m[0], low + m[1], m[2]))
                free = low + max(m[1], 1)
    return sorted(found, key=lambda f: (f[1], f[0]))


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())])
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]


def _scanning(doc_id: str, notices: tuple):
    phrases = [(np.array([word_hash(w) for w in p.split()], dtype=U64), label) for p, label in BASE.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([(doc_id, batch.schema.field(0).type), *_FIELDS])
            for a, b, w in split_batches(batch.column(1), lower=True, outside=NOT_ALNUM):
                n, places, of = b - a, [], []
                for k, (words, _) in enumerate(phrases):
                    at = np.flatnonzero(w.hash == words[0])
                    at = at[at + len(words) <= len(w.hash)]
                    for j in range(1, len(words)):
                        at = at[w.hash[at + j] == words[j]]
                    text_of = np.searchsorted(w.first, at, side="right") - 1
                    at = at[at + len(words) <= w.first[text_of + 1]]
                    places.append(at)
                    of.append(np.full(len(at), k))
                place, phrase = np.concatenate(places), np.concatenate(of)
                text_of = np.searchsorted(w.first, place, side="right") - 1
                count = np.bincount(text_of, minlength=n)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(low, text_of, place - w.first[text_of])
                np.maximum.at(high, text_of, place - w.first[text_of])
                base: list[set] = [set() for _ in range(n)]
                for t, k in zip(text_of.tolist(), phrase.tolist(), strict=True):
                    base[t].add(phrases[k][1])
                small = w.data.tobytes().translate(_SMALL)
                labels, scores, spans = [], [], []
                for i in range(n):
                    text = b" ".join(small[w.offsets[i] : w.offsets[i + 1]].split()).decode("latin-1")
                    found = notices_in(text, notices)
                    labels.append(",".join(sorted(base[i] | {notices[k][1] for k, *_ in found})))
                    scores.append(1.0 if base[i] else max((1 - e / len(notices[k][0]) for k, _, _, e in found), default=0.0))
                    spans.append([{"label": notices[k][1], "first_word": text.count(" ", 0, s), "n_words": text.count(" ", s, e) + 1, "edits": d} for k, s, e, d in found])
                none = count == 0
                yield record_batch({doc_id: batch.column(0).slice(a, n), "n_words": w.counts, "n_base": count, "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none), "base_labels": [",".join(sorted(s)) for s in base], "labels": labels, "score": scores, "spans": spans}, schema)

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """Per row: the base phrases' places and labels, all labels, the score, and the spans of the notices found."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(_scanning(doc_id, notices), f"{doc_id} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,edits:long>>")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
