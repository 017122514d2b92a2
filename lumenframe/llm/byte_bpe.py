"""Byte-level BPE encoding and decoding: DuckDB recursive queries over each partition's words.

1. Every map task finds the matches of the splitting pattern and sends each
   distinct one once, packed by ranges of its hash.
2. Each range of distinct words is encoded by a recursive query in DuckDB: one
   row a token and position, joined with the table of merges; each step contracts
   a word's pairs of the smallest rank until none is left.  A second query
   decodes every word again by an ordered aggregation of its tokens' bytes.
   Codes and bytes go to sorted hash arrays in the shared folder.
3. A second pass over the texts looks the words up and joins codes and bytes.

Words of more than ``SHORT`` bytes have a recursion of their own: one step may
contract all of a word's non-overlapping pairs of the smallest rank, which is what taking the leftmost again and again comes to as long as the
new token starts no pair of a smaller rank; for tokens that can, a step
contracts the leftmost pair only.  A word that is itself in the vocabulary is its
one id, as in the library whose ids these are.

Defined cases: a null or empty text has no ids and decodes to nothing; special
tokens in a text are ordinary text; repeated rows repeat; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ..sources.workspace import fresh_folder
from . import blobs
from .common import ranges_for, record_batch
from .pretokens import Pieces, pieces
from .sharedfs import map_array, write_array
from .textkernel import _LETTERS, _ODD, U64, _power_tables, buffers, mix64, slices

#: Words in one recursive query, and bytes of them: its tables stay below a few hundred MB.
WORDS_AT_ONCE, BYTES_AT_ONCE = 20_000, 250_000
#: Bytes of a word up to which a step contracts one pair of it.
SHORT = 48
#: Bytes of text whose words are looked up together: the more, the fewer words are met again.
SLICE = 4 << 20
#: Bytes of distinct words that a map task holds before it sends them.
HELD_BYTES = 128 << 20

STEPS = """
WITH RECURSIVE step(w, p, t) USING KEY (w, p) AS (
  SELECT w, p, t FROM tokens
  UNION
  SELECT w, unnest([best.p, best.q]), unnest([best.rank, -1])
  FROM (
    SELECT a.w, min({'rank': m.rank, 'p': a.p, 'q': a.q}) AS best
    FROM (SELECT w, p, t, lead(t) OVER ahead AS next, lead(p) OVER ahead AS q FROM recurring.step WHERE t >= 0 AND w IN (SELECT w FROM step) WINDOW ahead AS (PARTITION BY w ORDER BY p)) a
    JOIN merges m ON m.l = a.t AND m.r = a.next
    GROUP BY a.w
  )
)
SELECT w, p, t FROM step WHERE t >= 0
"""

LONG_STEPS = """
WITH RECURSIVE step(w, p, t) USING KEY (w, p) AS (
  SELECT w, p, t FROM tokens
  UNION
  SELECT w, p, CASE WHEN gone THEN -1 ELSE lowest END AS t
  FROM (
    SELECT *, lag(contracts, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone
    FROM (
      SELECT *, hit AND (n - before) % 2 = 1 AND (NOT risky OR before = n - 1 AND hits = 1) AS contracts
      FROM (
        SELECT *, max(CASE WHEN hit THEN 0 ELSE n END) OVER (PARTITION BY w ORDER BY p) AS before, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY p) AS hits
        FROM (
          SELECT *, coalesce(rank = lowest, false) AS hit
          FROM (
            SELECT a.w, a.p, a.t, a.n, m.rank, m.risky, min(m.rank) OVER (PARTITION BY a.w) AS lowest
            FROM (SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS next, row_number() OVER (PARTITION BY w ORDER BY p) AS n FROM recurring.step WHERE t >= 0 AND w IN (SELECT w FROM step)) a
            LEFT JOIN merges m ON m.l = a.t AND m.r = a.next
          ) WHERE lowest IS NOT NULL
        )
      )
    )
  ) WHERE contracts OR gone
)
SELECT w, p, t FROM step WHERE t >= 0
"""

DECODE = """
SELECT c.w, list(c.t ORDER BY c.p) AS ids, unhex(string_agg(v.bytes, '' ORDER BY c.p)) AS text
FROM codes c JOIN vocabulary v ON v.t = c.t GROUP BY c.w ORDER BY c.w
"""


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes of each token and its rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _merges(path: str) -> tuple[pa.Table, pa.Table]:
    """The table of merges, every split of a token into two, and the vocabulary."""
    ranks = ranks_of(path)
    rows = [(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, rank = (np.array(c, dtype=np.int32) for c in zip(*rows, strict=True))
    risky = np.zeros(max(ranks.values()) + 1, dtype=bool)
    for side in (left, right):
        risky[side[rank < side]] = True
    merges = pa.table({"l": left, "r": right, "rank": rank, "risky": risky[rank]})
    return merges, pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "bytes": [t.hex() for t in ranks]})


_engines: dict[str, duckdb.DuckDBPyConnection] = {}


def _engine(path: str) -> duckdb.DuckDBPyConnection:
    if path in _engines:
        return _engines[path]
    db = _engines[path] = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": False})
    merges, vocabulary = _merges(path)
    db.register("given_merges", merges)
    db.register("given_vocabulary", vocabulary)
    db.execute("CREATE TABLE merges AS SELECT * FROM given_merges")
    db.execute("CREATE TABLE vocabulary AS SELECT * FROM given_vocabulary")
    return db


def encode_words(words: list[bytes], path: str) -> tuple[list[list[int]], list[bytes]]:
    """Ids of each word, and the bytes that they decode to."""
    ids: list = [None] * len(words)
    texts: list = [b""] * len(words)
    for steps, chosen in ((STEPS, [i for i, w in enumerate(words) if len(w) <= SHORT]), (LONG_STEPS, [i for i, w in enumerate(words) if len(w) > SHORT])):
        at = 0
        while at < len(chosen):
            to, size = at, 0
            while to < len(chosen) and (to == at or (to - at < WORDS_AT_ONCE and size + len(words[chosen[to]]) <= BYTES_AT_ONCE)):
                size += len(words[chosen[to]])
                to += 1
            for i, own, text in zip(chosen[at:to], *_encode_some([words[i] for i in chosen[at:to]], path, steps), strict=True):
                ids[i], texts[i] = own, text
            at = to
    return ids, texts


def _encode_some(part: list[bytes], path: str, steps: str) -> tuple[list[list[int]], list[bytes]]:
    """One query's words."""
    ranks, db = ranks_of(path), _engine(path)
    single = np.array([ranks[bytes([k])] for k in range(256)], dtype=np.int32)
    known = np.array([ranks.get(w, -1) for w in part], dtype=np.int32)
    lengths = np.where(known >= 0, 1, [len(w) for w in part])
    raw = np.frombuffer(b"".join(w if k < 0 else b"\0" for w, k in zip(part, known.tolist(), strict=True)), dtype=np.uint8)
    first = np.cumsum(lengths) - lengths
    tokens = single[raw]
    tokens[first[known >= 0]] = known[known >= 0]
    table = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), lengths), "p": (np.arange(len(raw)) - np.repeat(first, lengths)).astype(np.int32), "t": tokens})
    db.register("tokens", table)
    db.register("codes", db.sql(steps).to_arrow_table())
    out = db.sql(DECODE).to_arrow_table()
    db.unregister("tokens")
    db.unregister("codes")
    ids: list = [[] for _ in part]
    texts = [b""] * len(part)
    for w, i, t in zip(out["w"].to_pylist(), out["ids"].to_pylist(), out["text"].to_pylist(), strict=True):
        ids[w], texts[w] = i, t
    return ids, texts


def _hashes(p: Pieces) -> np.ndarray:
    power, inverse = _power_tables(len(p.data))
    total = np.zeros(len(p.data) + 1, dtype=U64)
    np.cumsum(_LETTERS[False][p.data] * power[: len(p.data)], out=total[1:])
    return mix64((total[p.end] - total[p.start]) * inverse[p.start] + (p.end - p.start).astype(U64) * _ODD)


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, Pieces, np.ndarray]]:
    data, offsets = buffers(column)
    for a, b in slices(offsets, SLICE):
        p = pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, p, _hashes(p)


_WORDS = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])


def _distinct_words(shards: int):
    """Map side: each distinct word of a task once, packed by ranges of its hash."""

    def packed(keys: list[np.ndarray], words: list[bytes]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(keys)
        order = np.argsort(key)
        key = key[order]
        words = [words[i] for i in order.tolist()]
        at = blobs.cut(key, shards).tolist()
        for k in range(shards):
            if part := words[at[k] : at[k + 1]]:
                yield record_batch({"shard": [k], "keys": [blobs.pack_sorted(key[at[k] : at[k + 1]])], "sizes": [blobs.pack_values(np.array([len(w) for w in part], dtype=U64)[:, None])], "bytes": [zstandard.compress(b"".join(part), 1)]}, _WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, held = [], [], 0
        seen = np.zeros(0, dtype=U64)
        for batch in batches:
            if held > HELD_BYTES:
                yield from packed(keys, words)
                keys, words, held, seen = [], [], 0, np.zeros(0, dtype=U64)
            for _, _, p, h in _pieces(batch.column(0)):
                own, one = np.unique(h, return_index=True)
                fresh = ~np.isin(own, seen, assume_unique=True, kind="sort")
                own, one = own[fresh], one[fresh]
                raw = p.data.tobytes()
                words += [raw[s:e] for s, e in zip(p.start[one].tolist(), p.end[one].tolist(), strict=True)]
                keys.append(own)
                seen = np.union1d(seen, own)
                held += int((p.end[one] - p.start[one]).sum()) + 64 * len(own)
        if keys:
            yield from packed(keys, words)

    return run


def _encode_ranges(path: str, folder: str):
    """Reduce side: encodes the distinct words of each range and writes its arrays."""
    schema = pa.schema([("shard", pa.int32()), ("words", pa.int64())])

    def encode(shard: int, rows: list) -> pa.RecordBatch:
        keys, words = [], []
        for k, s, b in rows:
            keys.append(blobs.unpack_sorted(k))
            ends = np.cumsum(blobs.unpack_values(s, 1)[:, 0]).astype(np.int64)
            raw = zstandard.decompress(b)
            words += [raw[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        key, one = np.unique(np.concatenate(keys), return_index=True)
        ids, texts = encode_words([words[i] for i in one.tolist()], path)
        spelled = [",".join(map(str, i)).encode() for i in ids]
        for name, array in (
            ("key", key),
            ("n", np.concatenate(([0], np.cumsum([len(i) for i in ids])))),
            ("ids", np.array([x for i in ids for x in i], dtype=np.int32)),
            ("size", np.concatenate(([0], np.cumsum([len(t) for t in texts])))),
            ("text", np.frombuffer(b"".join(texts), dtype=np.uint8)),
            ("length", np.concatenate(([0], np.cumsum([len(t) for t in spelled])))),
            ("spelled", np.frombuffer(b"".join(spelled), dtype=np.uint8)),
        ):
            write_array(f"{folder}/{name}-{shard:05d}.npy", array)
        return record_batch({"shard": [shard], "words": [len(key)]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if rows:
                        yield encode(now, rows)
                    now, rows = shard, []
                rows.append(row)
        if rows:
            yield encode(now, rows)
        release()

    return run


def release() -> None:
    """Gives back the engine's memory: a worker goes on to other tasks."""
    for path in list(_engines):
        _engines.pop(path).close()
    _merges.cache_clear()


def _parts(folder: str, offsets: str, values: str, shard: int, at: np.ndarray) -> list[bytes]:
    ends, raw = map_array(f"{folder}/{offsets}-{shard:05d}.npy"), memoryview(map_array(f"{folder}/{values}-{shard:05d}.npy"))
    return [bytes(raw[a:b]) for a, b in zip(ends[at].tolist(), ends[at + 1].tolist(), strict=True)]


class _Known:
    """The codes of the words that a task has met: looked up once each."""

    MOST = 600_000

    def __init__(self, folder: str, shards: int, digest: bool):
        self.folder, self.shards, self.digest = folder, shards, digest
        self.keys, self.counts = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        self.codes, self.texts = np.zeros(0, dtype=object), np.zeros(0, dtype=object)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where sorted distinct hashes are among ``keys``, after the new ones are added."""
        if len(self.keys) + len(keys) > self.MOST:
            self.__init__(self.folder, self.shards, self.digest)
        new = keys[~np.isin(keys, self.keys, assume_unique=True, kind="sort")]
        if len(new):
            counts, codes, texts = [], [], []
            at = blobs.cut(new, self.shards).tolist()
            for k in range(self.shards):
                if at[k + 1] > at[k]:
                    i = np.searchsorted(map_array(f"{self.folder}/key-{k:05d}.npy"), new[at[k] : at[k + 1]])
                    n = map_array(f"{self.folder}/n-{k:05d}.npy")
                    counts.append(n[i + 1] - n[i])
                    if self.digest:
                        codes += _parts(self.folder, "length", "spelled", k, i)
                    else:
                        flat = map_array(f"{self.folder}/ids-{k:05d}.npy")
                        codes += [flat[a:b] for a, b in zip(n[i].tolist(), n[i + 1].tolist(), strict=True)]
                    texts += _parts(self.folder, "size", "text", k, i)
            order = np.argsort(np.concatenate((self.keys, new)), kind="stable")
            self.keys = np.concatenate((self.keys, new))[order]
            self.counts = np.concatenate((self.counts, *counts))[order]
            self.codes, self.texts = (np.array([*old.tolist(), *more, None], dtype=object)[:-1][order] for old, more in ((self.codes, codes), (self.texts, texts)))
        return np.searchsorted(self.keys, keys)


def _codes(folder: str, shards: int, doc_id: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(folder, shards, digest)
        for batch in batches:
            last = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
            schema = pa.schema([(doc_id, batch.schema.field(0).type), ("n_tokens", pa.int64()), *last])
            for a, b, p, h in _pieces(batch.column(1)):
                keys, back = np.unique(h, return_inverse=True)
                at = known.places(keys)[back]
                total = np.concatenate(([0], np.cumsum(known.counts[at])))[p.first]
                bounds = list(zip(p.first[:-1].tolist(), p.first[1:].tolist(), strict=True))
                text, code = known.texts[at].tolist(), known.codes[at].tolist()
                decoded = [b"".join(text[x:y]) for x, y in bounds]
                if digest:
                    columns = {"ids_sha256": [hashlib.sha256(b",".join(code[x:y])).hexdigest() for x, y in bounds], "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in decoded]}
                else:
                    flat = np.concatenate(code) if code else np.zeros(0, np.int32)
                    columns = {"ids": pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat, type=pa.int32())), "decoded": [t.decode() for t in decoded]}
                yield record_batch({doc_id: batch.column(0).slice(a, b - a), "n_tokens": np.diff(total), **columns}, schema)

    return run


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids and the text they decode to; or the SHA-256 of the ids joined by commas and of the decoded bytes.

    ``vocabulary`` is a file of ranks that every worker can open, as part of an installed package.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shards = ranges_for(docs)
    folder = fresh_folder(docs.sparkSession, "word-codes")
    words = docs.select(text).mapInArrow(_distinct_words(shards), "shard int, keys binary, sizes binary, bytes binary")
    words.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(_encode_ranges(vocabulary, folder), "shard int, words long").collect()  # a row a range
    last = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return docs.select(doc_id, text).mapInArrow(_codes(folder, shards, doc_id, digest), f"{doc_id} {kind}, n_tokens long, {last}")


def decode_ids(ids: list[int], vocabulary: str) -> bytes:
    """The bytes of one list of ids, by the same ordered aggregation."""
    db = _engine(vocabulary)
    db.register("codes", pa.table({"w": np.zeros(len(ids), dtype=np.int32), "p": np.arange(len(ids), dtype=np.int32), "t": np.array(ids, dtype=np.int32)}))
    rows = db.execute(DECODE).fetchall()
    db.unregister("codes")
    return bytes(rows[0][2]) if rows else b""


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digest=True)
