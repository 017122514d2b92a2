"""Removal of passages that occur more than once, located by sharded phrase automata.

A window is ``WINDOW`` consecutive words of one document; each word that lies in
a window whose words also start elsewhere is removed.

1. Every window is marked by its anchor, the run of ``PHRASE`` words with the
   smallest hash in it.  Equal windows have equal anchors, so only phrases that
   are an anchor at two places can mark a passage that recurs.  Phrases meet by
   hash, at most one row a map task, whatever their frequency.
2. The phrases that recur go to the shards of the documents that hold them.
   Each shard compiles its phrases into one Aho-Corasick automaton and streams
   its documents through it; the matches give the windows that may recur.
3. Hashes of those windows alone meet by key range, packed, and each shard gets
   back the few that are found only once.
4. The words they cover are removed.

A shard is about ``SHARD_BYTES`` of the stored table, so that its automaton has
a bounded size; the number of shards grows with the input.

Defined cases: a null, empty or wordless text has no words and keeps the empty
text; one of fewer words than a window is kept whole; overlapping windows of one
text count as occurrences of each other; a repeated row is an occurrence like
any other, so both are removed; null ids are kept apart by their texts; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise
from . import blobs
from .common import record_batch
from .textkernel import U64, Words, buffers, gram_index, grams, signed, slices, split

WINDOW, PHRASE = 35, 5
SHARD_BYTES = 8 << 20
#: Bytes of phrases that a map task holds before it sends them.
HELD_BYTES = 128 << 20
_TOP = U64(0xFFFFFFFFFFFFFFFF)
_TO_BLANK = bytes(0x20 if k in (*range(9, 14), 32) else k for k in range(256))


def shards_for(docs: DataFrame) -> int:
    """Shards by the planned size of the table, but no more than its splits can hold: the planner's size of a join is often far too large."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = docs.rdd.getNumPartitions()
    split = int(docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(4, parts, min(-(-size // SHARD_BYTES), parts * max(1, split // SHARD_BYTES)))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values."""
    step, out = 1, x
    while step * 2 <= width:
        out = op(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return op(out[: len(out) - rest], out[rest:]) if rest else out


class Anchors:
    """Windows of a run of texts and the phrases that mark them."""

    def __init__(self, w: Words, window: int, phrase: int):
        self.w, self.window, self.phrase = w, window, phrase
        self.span = window - phrase + 1
        self.gram = grams(w.hash, phrase)
        n = max(0, len(w.hash) - window + 1)
        self.inside = np.zeros(n, dtype=bool)
        self.inside[gram_index(w.first, window)] = True
        self.least = _sliding(self.gram, self.span, np.minimum) if n else np.zeros(0, dtype=U64)

    def places(self) -> np.ndarray:
        """First words of the phrases that mark a window."""
        if not len(self.least):
            return np.zeros(0, dtype=np.int64)
        pad = np.zeros(self.span - 1, dtype=U64)
        most = _sliding(np.concatenate((pad, np.where(self.inside, self.least, U64(0)), pad)), self.span, np.maximum)
        return np.flatnonzero((most == self.gram) & (most > 0))

    def marked(self, places: np.ndarray) -> np.ndarray:
        """First words of the windows whose mark is one of the phrases at these places."""
        if not len(self.least) or not len(places):
            return np.zeros(0, dtype=np.int64)
        only = np.full(len(self.gram), _TOP, dtype=U64)
        only[places] = self.gram[places]
        return np.flatnonzero(self.inside & (_sliding(only, self.span, np.minimum) == self.least))


def _words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        yield a, b, split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


_ANCHOR = pa.schema([("route", pa.int64()), ("anchor", pa.int64()), ("shard", pa.int32()), ("tells", pa.int8()), ("phrase", pa.binary())])
#: What a row of an anchor tells: it was seen once in its task; it recurs there; the shard needs it whatever others say.
ONCE, RECURS, SEND = 0, 1, 2


def _anchor_rows(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shards, phrases, held = [], [], [], 0
        for batch in batches:
            if held > HELD_BYTES:
                yield from told(keys, shards, phrases)
                keys, shards, phrases, held = [], [], [], 0
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, w in _words(batch.column(1)):
                at = Anchors(w, window, phrase).places()
                gram = grams(w.hash, phrase)[at]
                text = np.searchsorted(w.first, at, side="right") - 1
                shard = own[a:b][text]
                raw = w.data.tobytes().translate(_TO_BLANK)
                start, end = w.start[at], w.end[at + phrase - 1]
                keys.append(gram)
                shards.append(shard.astype(np.int32))
                phrases += [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                held += int((end - start).sum()) + 64 * len(at)
        if keys:
            yield from told(keys, shards, phrases)

    def told(keys: list[np.ndarray], shards: list[np.ndarray], phrases: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, shard = np.concatenate(keys), np.concatenate(shards)
        order = np.lexsort((shard, key))
        key, shard = key[order], shard[order]
        new_key = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(new_key)
        size = np.diff(at, append=len(key))
        single = size == 1
        new_pair = new_key | np.concatenate(([True], shard[1:] != shard[:-1])) if len(key) else new_key
        sent = np.flatnonzero(new_pair & np.repeat(~single, size))
        pick = np.concatenate((at[single], at[~single], sent))
        tells = np.concatenate((np.full(single.sum(), ONCE), np.full((~single).sum(), RECURS), np.full(len(sent), SEND))).astype(np.int8)
        route = key[pick] + np.where(tells == SEND, shard[pick].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1), U64(0))
        for a in range(0, len(pick), 100_000):
            part = pick[a : a + 100_000]
            told = tells[a : a + 100_000]
            texts = [None if t == RECURS else p if b"  " not in (p := phrases[i]) else b" ".join(p.split()) for i, t in zip(order[part].tolist(), told.tolist(), strict=True)]
            yield record_batch({"route": signed(route[a : a + 100_000]), "anchor": signed(key[part]), "shard": shard[part], "tells": told, "phrase": texts}, _ANCHOR)

    return run


_PHRASE_ROW = pa.schema([("shard", pa.int32()), ("phrase", pa.binary())])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by route and anchor: passes on the phrases that recur.  Holds the one row that may still be alone."""
    held = None
    last, last_recurs = None, False
    for batch in batches:
        out = []
        for anchor, shard, tells, phrase in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if tells == SEND:
                out.append((shard, phrase))
                continue
            if anchor != last:
                held, last, last_recurs = None, anchor, False
                if tells == ONCE:
                    held = (shard, phrase)
                else:
                    last_recurs = True
                continue
            last_recurs = True
            if held:
                out.append(held)
                held = None
            if tells == ONCE:
                out.append((shard, phrase))
        yield record_batch({"shard": [s for s, _ in out], "phrase": [p for _, p in out]}, _PHRASE_ROW)


_LOCATED = "block int, doc_id {kind}, n_words long, text string, runs binary, carried {carried}"


def _locate(window: int, phrase: int, keep_text: bool):
    """A shard's phrases, then its documents: where windows may recur.  A document without any is done; it keeps its text, or the digest of its joined words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, open_ = None, None, False
        for batch in batches:
            schema = pa.schema([("block", pa.int32()), ("doc_id", batch.schema.field(2).type), ("n_words", pa.int64()), ("text", pa.string()), ("runs", pa.binary()), ("carried", batch.schema.field(5).type)])
            shards, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.concatenate(([0], np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1, [len(shards)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, automaton, open_ = shards[a], ahocorasick.Automaton(), True
                if kinds[a] == 0:
                    for p in batch.column(4).slice(a, b - a).to_pylist():
                        automaton.add_word(f" {p.decode('latin-1')} ", 0)
                    continue
                if open_:
                    open_ = False
                    automaton.make_automaton()
                ids, texts, carried = (batch.column(k).slice(a, b - a) for k in (2, 3, 5))
                for x, y, w in _words(texts):
                    found = _places(automaton, w, phrase)
                    marked = Anchors(w, window, phrase).marked(found)
                    text_of = np.searchsorted(w.first, marked, side="right") - 1
                    at = np.searchsorted(text_of, np.arange(y - x + 1))
                    out, runs = [], []
                    source = texts.slice(x, y - x)
                    raw = w.data.tobytes()
                    for i in range(y - x):
                        starts = marked[at[i] : at[i + 1]] - w.first[i]
                        if len(starts):
                            out.append(source[i].as_py())
                            cut = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
                            runs.append(np.stack((starts[cut], np.diff(cut, append=len(starts)))).astype("<i4").tobytes())
                        else:
                            out.append(source[i].as_py() if keep_text else hashlib.sha256(b" ".join(raw[w.offsets[i] : w.offsets[i + 1]].split())).hexdigest())
                            runs.append(None)
                    yield record_batch({"block": np.full(y - x, shard, dtype=np.int32), "doc_id": ids.slice(x, y - x), "n_words": w.counts, "text": out, "runs": runs, "carried": carried.slice(x, y - x)}, schema)

    return run


def _places(automaton, w: Words, phrase: int) -> np.ndarray:
    """First words of the automaton's matches in a run of texts."""
    if not len(automaton) or not len(w.hash):
        return np.zeros(0, dtype=np.int64)
    raw = w.data.tobytes()
    found = []
    for i in range(len(w)):
        first, last = w.first[i], w.first[i + 1]
        if last - first < phrase:
            continue
        text = b" " + b" ".join(raw[w.offsets[i] : w.offsets[i + 1]].split()) + b" "
        ends = [e for e, _ in automaton.iter(text.decode("latin-1"))]
        if ends:
            stops = np.cumsum(w.end[first:last] - w.start[first:last] + 1)
            found.append(np.searchsorted(stops, ends) - phrase + 1 + first)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def _windows(w: Words, runs: list[bytes], window: int) -> np.ndarray:
    """First words of the windows in the stored runs of each text."""
    at = []
    for i, raw in enumerate(runs):
        start, size = np.frombuffer(raw, dtype="<i4").reshape(2, -1).astype(np.int64)
        skip = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        at.append(np.arange(int(size.sum())) + skip + w.first[i])
    return np.concatenate(at) if at else np.zeros(0, dtype=np.int64)


_KEYS = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("twice", pa.binary())])


def _window_rows(window: int, ranges: int):
    """Distinct hashes of the windows that may recur, by block and key range, with those already found twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                keys, counts = blobs.counted(np.concatenate(parts))
                at = blobs.cut(keys, ranges)
                out = [(r, block, blobs.pack_sorted(keys[a:b]), np.packbits(counts[a:b, 0] > 1).tobytes()) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                yield record_batch(dict(zip(_KEYS.names, zip(*out, strict=True), strict=True)), _KEYS)

        size = 0
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, w in _words(batch.column(1)):
                runs = batch.column(2).slice(a, b - a).to_pylist()
                at = _windows(w, runs, window)
                keys = grams(w.hash, window)[at]
                block = np.repeat(blocks[a:b], [int(np.frombuffer(r, dtype="<i4").reshape(2, -1)[1].sum()) for r in runs])
                for one in np.unique(block):
                    held.setdefault(int(one), []).append(keys[block == one])
                size += len(keys)
            if size > 8_000_000:
                yield from rows()
                held.clear()
                size = 0
        yield from rows()

    return run


_ANSWER = pa.schema([("block", pa.int32()), ("keys", pa.binary())])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key range: to each block, its hashes that occur once in all; most candidates recur, so these are few."""

    def answer(rows: list) -> Iterator[pa.RecordBatch]:
        parts = [(block, blobs.unpack_sorted(keys), twice) for block, keys, twice in rows]
        known = [k[np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=len(k)).astype(bool)] for _, k, t in parts]
        keys, counts = blobs.counted(np.concatenate([k for _, k, _ in parts] + known))
        alone = keys[counts[:, 0] == 1]
        for block, own, _ in parts:
            mine = own[np.isin(own, alone, assume_unique=True, kind="sort")]
            if len(mine):
                yield record_batch({"block": [block], "keys": [blobs.pack_sorted(mine)]}, _ANSWER)

    now, rows = None, []
    for batch in batches:
        for r, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != now:
                if rows:
                    yield from answer(rows)
                now, rows = r, []
            rows.append(row)
    if rows:
        yield from answer(rows)


def _remove(window: int, keep_text: bool):
    """A block's hashes that occur once, then its documents: the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, known = None, [], np.zeros(0, dtype=U64)
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(2).type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("carried", batch.schema.field(6).type)])
            blocks, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = np.concatenate(([0], np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1, [len(blocks)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, keys, known = blocks[a], [], np.zeros(0, dtype=U64)
                if kinds[a] == 0:
                    keys += [blobs.unpack_sorted(k) for k in batch.column(5).slice(a, b - a).to_pylist()]
                    continue
                if keys:
                    known, keys = np.unique(np.concatenate(keys + [known])), []
                for x, y, w in _words(batch.column(3).slice(a, b - a)):
                    at = _windows(w, batch.column(4).slice(a + x, y - x).to_pylist(), window)
                    own = grams(w.hash, window)[at]
                    i = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                    at = at[known[i] != own] if len(known) else at
                    edge = np.zeros(len(w.hash) + 1, dtype=np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    raw = w.data.tobytes()
                    kept, source = [], batch.column(3).slice(a + x, y - x)
                    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.first])
                    for k in range(y - x):
                        if keep_text and not removed[k]:
                            kept.append(source[k].as_py())
                            continue
                        words = raw[w.offsets[k] : w.offsets[k + 1]].split()
                        joined = b" ".join([t for t, g in zip(words, gone[w.first[k] : w.first[k + 1]].tolist(), strict=True) if not g])
                        kept.append(joined.decode() if keep_text else hashlib.sha256(joined).hexdigest())
                    yield record_batch({"doc_id": batch.column(2).slice(a + x, y - x), "n_words": w.counts, "n_removed": removed, "kept": kept, "carried": batch.column(6).slice(a + x, y - x)}, schema)

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and ``kept``, and the columns to ``carry`` along.

    ``kept`` is the text itself where nothing is removed, else the words that stay, joined by one space; without
    ``keep_text`` it is the SHA-256 of the words that stay, joined by one space.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    shards = shards_for(docs)
    others = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry))) if carry else F.lit(None).cast("boolean")
    rows = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(shards)).cast("int").alias("shard"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), others.alias("carried"))
    carried = rows.schema["carried"].dataType.simpleString()
    none = f"CAST(NULL AS {carried}) AS carried"
    anchors = rows.select("shard", "text").mapInArrow(_anchor_rows(window, phrase), "route long, anchor long, shard int, tells byte, phrase binary")
    phrases = anchors.repartition(shards, "route").sortWithinPartitions("route", "anchor").mapInArrow(_recurring, "shard int, phrase binary")
    streams = rows.selectExpr("shard", "1 AS kind", "doc_id", "text", "CAST(NULL AS BINARY) AS phrase", "carried").unionByName(phrases.selectExpr("shard", "0 AS kind", f"CAST(NULL AS {kind}) AS doc_id", "CAST(NULL AS STRING) AS text", "phrase", none))
    located = materialise(streams.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_locate(window, phrase, keep_text), _LOCATED.format(kind=kind, carried=carried)), "located")

    open_ = located.where("runs is not null")
    answers = open_.select("block", "text", "runs").mapInArrow(_window_rows(window, shards), "range int, block int, keys binary, twice binary").repartitionById(shards, "range").sortWithinPartitions("range").mapInArrow(_answers, "block int, keys binary")
    streams = open_.selectExpr("block", "1 AS kind", "doc_id", "text", "runs", "CAST(NULL AS BINARY) AS keys", "carried").unionByName(answers.selectExpr("block", "0 AS kind", f"CAST(NULL AS {kind}) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS BINARY) AS runs", "keys", none))
    changed = streams.repartitionById(shards, "block").sortWithinPartitions("block", "kind").mapInArrow(_remove(window, keep_text), f"doc_id {kind}, n_words long, n_removed long, kept string, carried {carried}")
    done = located.where("runs is null").selectExpr("doc_id", "n_words", "0L AS n_removed", "text AS kept", "carried")
    return done.unionByName(changed).select(F.col("doc_id").alias(doc_id), "n_words", "n_removed", "kept", *(F.col(f"carried.c{k}").alias(c) for k, c in enumerate(carry)))


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs, keep_text=False).withColumnRenamed("kept", "kept_sha256")
