"""Near-duplicate classes by n-gram Jaccard similarity, with prefix filters under several global orders.

A document is its set of distinct shingles.  Two sets of similarity 0.8 or more
share a token in the first n - ceil(0.8 n) + 1 tokens of each, under every
order of all tokens that both use.  The first order puts tokens of crowded hash
buckets last (bucket counts over all documents, a table of fixed size); an
index of its prefixes finds candidates, with the bound that a token's place in
both sets puts on their overlap.  Two further orders, with other hashes within
the classes, must also give a shared prefix token, within the same bound, before
a candidate's sets are intersected.

Equal sets are one node from the start.  Each group of documents that share a
prefix token is first compared with its leader, the member with the fewest
tokens before the shared one; most of a large group of copies falls into the
leader's class.  A group whose token may be far more frequent than most is dealt
by parts, each with a leader of its own, and the parts' leaders are then compared
with the first of them.  Then every pair of a group that is still in different
classes and within the bounds is compared: the members outside of the group's
largest class visit blocks of all its members.  So every link between different
classes is tested and no group is expanded into all its pairs.

Defined cases: a null, empty or wordless text has no shingles, links with
nothing and is its own class; a text of fewer words than a shingle is one
shingle; a null id is in no class (null); rows that repeat an id are one node,
linked by each of their texts, and each get one row with its own text's
n_shingles; ids may be of any type that sorts; an empty table gives an empty
result; only the named columns are read.

Where an id stands for several sets, or is no number, the operator runs on 64-bit
hashes of id and text, and the classes are then joined where they share an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialise
from . import blobs
from .common import record_batch, releasing
from .components import connected
from .textkernel import U64, buffers, gram_index, grams, mix64, signed, slices, split_batches

WIDTH = 5
#: Buckets of the token counts behind the first order, and rows of them sent to the driver: 2^20 classes of one byte.
BUCKET_BITS, BUCKET_BLOCKS = 20, 64
#: Keys of the orders after the first.
OTHER_ORDERS = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))
#: Rows of a table of ids or links that one task reads, and a hundred times the sets.
ROWS = 200_000
#: Members of a group, and visitors to them, compared in one block; blocks are smaller where a group has few visitors.
BLOCK, SMALL_BLOCK = 4096, 1024
#: A token's rows that one task takes are of the order of this, or of four times the mean of a bucket's if that is more.
HOT = 1024
#: Bits of the filter of wanted ids: 16 for each id, between these bounds (at most 16 MB).  Beyond, more sets pass it than are joined.
FILTER_BITS = (20, 27)


def least_overlap(a, b):
    """Smallest intersection of sets of these sizes whose similarity is 0.8 or more."""
    return (4 * (a + b) + 8) // 9


def prefix_size(n):
    return n - (4 * n + 4) // 5 + 1


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, w in split_batches(column, lower=True):
        at = gram_index(w.first, width)
        keys = grams(w.hash, width)[at]
        bounds = np.searchsorted(at, w.first)
        for i in range(b - a):
            n = w.first[i + 1] - w.first[i]
            if 0 < n < width:
                yield mix64(grams(w.hash[w.first[i] : w.first[i + 1]], n) + U64(n))
            else:
                yield np.unique(keys[bounds[i] : bounds[i + 1]])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in pieces of a bounded size: what a task makes of a piece is sent on before the next."""
    for batch in batches:
        for a, b in slices(buffers(batch.column(1))[1]):
            yield batch.slice(a, b - a)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(np.sum(mix64(s), dtype=U64).view(np.int64)), int(np.sum(mix64(s ^ OTHER_ORDERS[0]), dtype=U64).view(np.int64))


_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])


def _signatures(width: int):
    """Per document its set's size and fingerprint; per task the bucket counts of its tokens, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=U64)
        for batch in _pieces(batches):
            n, f1, f2, held = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                one, two = _fingerprint(s)
                f1.append(one)
                f2.append(two)
                held.append((s >> U64(64 - BUCKET_BITS)).astype(np.int32))
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(U64)
            rows = len(n)
            yield record_batch({"doc_id": batch.column(0), "n": n, "f1": f1, "f2": f2, "block": pa.nulls(rows, pa.int32()), "counts": pa.nulls(rows, pa.binary())}, _SIGNATURE)
        if counts.any():
            parts = counts.reshape(BUCKET_BLOCKS, -1)
            none = [None] * BUCKET_BLOCKS
            yield record_batch({"doc_id": none, "n": none, "f1": none, "f2": none, "block": np.arange(BUCKET_BLOCKS, dtype=np.int32), "counts": [blobs.pack_values(p[:, None]) for p in parts]}, _SIGNATURE)

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of each block and gives their classes: quarter steps of the logarithm."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = blobs.unpack_values(raw, 1)[:, 0]
            total[block] = total[block] + own if block in total else own
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), type=pa.int32()), "classes": pa.array([np.minimum(4 * np.log2(1.0 + t), 255).astype(np.uint8).tobytes() for t in total.values()], type=pa.binary())})


_PREFIX = pa.schema([("token", pa.int64()), ("part", pa.int32()), ("doc", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _parts(classes: np.ndarray, hot: int) -> np.ndarray:
    """Parts that the rows of a token are dealt in, by its bucket."""
    counts = np.exp2(classes / 4) - 1
    return np.maximum(np.ceil(counts / max(hot, 4 * counts.mean())), 1).astype(np.int64)


def _prefixes(width: int, classes: np.ndarray, hot: int):
    """The prefix tokens of each distinct set of a task, with their places in the first order; the part of a token that has one is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        parts_of = _parts(classes, hot)
        for batch in _pieces(batches):
            parts = []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
                if not len(s) or doc is None or (key := (len(s), *_fingerprint(s))) in seen:
                    continue
                seen.add(key)
                p = prefix_size(len(s))
                key = classes[(s >> U64(64 - BUCKET_BITS)).astype(np.int32)].astype(U64) << U64(56) | s >> U64(8)
                first = np.argsort(key)[:p]
                parts.append((s[first], doc, len(s), p))
            if parts:
                sizes = [p for *_, p in parts]
                token, doc = np.concatenate([t for t, *_ in parts]), np.repeat(np.array([d for _, d, _, _ in parts], dtype=np.int64), sizes)
                most = parts_of[(token >> U64(64 - BUCKET_BITS)).astype(np.int32)]
                part = np.where(most > 1, (mix64(doc.view(U64)) % most.astype(U64)).astype(np.int64), -1)
                yield record_batch({"token": signed(token), "part": part.astype(np.int32), "doc": doc, "n": np.repeat([n for _, _, n, _ in parts], sizes), "pos": np.concatenate([np.arange(p) for p in sizes])}, _PREFIX)

    return run


_HIT = pa.schema([(name, kind) for name, kind in zip(_PREFIX.names, _PREFIX.types, strict=True) if name != "part"] + [("leader", pa.int64()), ("leader_n", pa.int32()), ("leader_pos", pa.int32())])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, part and place: each row but a part's first, with that first one; the firsts of a token of several parts have no leader.

    Holds one row besides the batch.
    """
    last = None
    for batch in batches:
        token, part, doc, n, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(token):
            continue
        new = np.concatenate(([last is None or (token[0], part[0]) != last[0]], (token[1:] != token[:-1]) | (part[1:] != part[:-1])))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
        columns = []
        for k, c in enumerate((doc, n, pos), 1):
            columns.append(np.where(lead < 0, last[k] if last else 0, c[np.maximum(lead, 0)]))
        first = new & (part >= 0)
        keep = first | (~new & (columns[0] != doc))
        last = ((token[-1], part[-1]), *((c[-1] for c in columns)))
        if keep.any():
            yield record_batch({"token": token[keep], "doc": doc[keep], "n": n[keep], "pos": pos[keep], "leader": pa.array(columns[0][keep], mask=first[keep]), "leader_n": columns[1][keep].astype(np.int32), "leader_pos": columns[2][keep].astype(np.int32)}, _HIT)


def _within(n_a, pos_a, n_b, pos_b):
    """Whether sets that first meet at these places can overlap enough."""
    return F.least(n_a - pos_a, n_b - pos_b) >= F.floor((4 * (n_a + n_b) + 8) / 9)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: Roles in a block: at home and of the group's largest class; at home and of another; a visitor, of another.
MAIN, MINOR, VISITOR = 0, 1, 2


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block after another: the pairs of a visitor and a member at home that differ in class and are within the bounds."""
    group: list[np.ndarray] = []
    now = None

    def pairs() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(group, axis=1)
        (visitors,), (homes,) = np.nonzero(rows[4] == VISITOR), np.nonzero(rows[4] != VISITOR)
        other, m, place, its, role = (rows[k][homes][None, :] for k in range(5))
        for at in range(0, len(visitors), 512):
            doc, n, pos, comp = (rows[k][visitors[at : at + 512]][:, None] for k in range(4))
            # Two members outside of the largest class visit each other; one of the two visits counts.
            x, y = np.nonzero((comp != its) & (np.minimum(n - pos, m - place) >= least_overlap(n, m)) & ((role == MAIN) | (doc < other)))
            if len(x):
                a, b = doc[x, 0], other[0, y]
                yield record_batch({"a": np.maximum(a, b), "b": np.minimum(a, b)}, _PAIR)

    for batch in batches:
        columns = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if not columns.shape[1]:
            continue
        cuts = np.flatnonzero((columns[:3, 1:] != columns[:3, :-1]).any(axis=0)) + 1
        for part in np.split(columns, cuts, axis=1):
            key = tuple(part[:3, 0])
            if now is not None and key != now:
                yield from pairs()
                group = []
            now = key
            group.append(part[3:])
    if group:
        yield from pairs()


def _bit_of(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte of each id in a filter of so many bits, and its bit there."""
    at = (mix64(ids.view(U64)) >> U64(64 - bits)).astype(np.int64)
    return at >> 3, np.left_shift(1, at & 7).astype(np.uint8)


def _filter_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in batches:
            np.bitwise_or.at(flags, *_bit_of(batch.column(0).to_numpy(zero_copy_only=False), bits))
        yield pa.RecordBatch.from_pydict({"flags": pa.array([zstandard.compress(flags.tobytes(), 1)], type=pa.binary())})

    return run


def _wanted_sets(width: int, flags: np.ndarray, bits: int):
    schema = pa.schema([("doc", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            byte, bit = _bit_of(ids, bits)
            batch = batch.filter(pa.array((flags[byte] & bit) > 0))
            yield record_batch({"doc": batch.column(0), "tokens": [s.tobytes() for s in shingle_sets(batch.column(1), width)]}, schema)

    return run


def _prefix(s: np.ndarray, key: np.uint64, classes: np.ndarray) -> np.ndarray:
    """A set's prefix under the order that the key makes within the classes, as places in that order."""
    if not len(s):
        return s
    p = prefix_size(len(s))
    return np.sort(np.partition(classes[(s >> U64(64 - BUCKET_BITS)).astype(np.int32)].astype(U64) << U64(56) | mix64(s ^ key) >> U64(8), p - 1)[:p])


def _meet(a: np.ndarray, b: np.ndarray, classes: np.ndarray) -> bool:
    """Whether two sets share a prefix token under every further order, early enough for their overlap."""
    for key in OTHER_ORDERS:
        _, i, j = np.intersect1d(_prefix(a, key, classes), _prefix(b, key, classes), assume_unique=True, return_indices=True)
        if not len(i) or min(len(a) - i[0], len(b) - j[0]) < least_overlap(len(a), len(b)):
            return False
    return True


def _verified(classes: np.ndarray):
    """Rows (a, b, doc, tokens) sorted by pair: the pairs that meet under the further orders and overlap enough.  Holds one set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, other, first, done = None, None, None, False
        for batch in batches:
            out = []
            for a, b, doc, tokens in zip(*batch.columns, strict=True):
                a, b, doc = a.as_py(), b.as_py(), doc.as_py()
                if (a, b) != pair:
                    pair, other, first, done = (a, b), doc, np.frombuffer(tokens.as_py(), dtype=U64), False
                elif doc != other and not done:
                    second, done = np.frombuffer(tokens.as_py(), dtype=U64), True
                    if _meet(first, second, classes) and len(np.intersect1d(first, second, assume_unique=True)) >= least_overlap(len(first), len(second)):
                        out.append(pair)
            yield record_batch({"a": [a for a, _ in out], "b": [b for _, b in out]}, _PAIR)

    return run


def verify(texts: DataFrame, pairs: DataFrame, width: int, classes: np.ndarray) -> DataFrame:
    """The pairs whose sets are similar enough.

    Sets are made again from the texts, only for the documents in pairs, and shipped to each of their pairs once.
    """
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted", ROWS)
    count = wanted.count()
    bits = min(max((16 * count).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    flags = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in wanted.coalesce(16).mapInArrow(releasing(_filter_rows(bits)), "flags binary").toLocalIterator():  # at most 16 rows of at most 16 MB, one at a time
        flags |= np.frombuffer(zstandard.decompress(bytes(row["flags"])), dtype=np.uint8)
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc"))
    sets = texts.mapInArrow(releasing(_wanted_sets(width, flags, bits)), "doc long, tokens binary").join(ends, "doc").select("a", "b", "doc", "tokens")
    parts = max(pairs.rdd.getNumPartitions(), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = sets.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "doc")
    return materialise(met.mapInArrow(releasing(_verified(classes)), "a long, b long"), "verified", ROWS)


def _told(texts: DataFrame, width: int) -> DataFrame:
    return materialise(texts.mapInArrow(releasing(_signatures(width)), "doc_id long, n long, f1 long, f2 long, block int, counts binary"), "signatures", ROWS)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        texts = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
        told = _told(texts, width)
        sets = told.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "f1", "f2")).alias("low"), F.max(F.struct("n", "f1", "f2")).alias("high"))
        if sets.where("low <> high").isEmpty():
            return _classes_of(texts, told, width)
    # Rows by a hash of id and text; classes that share an id are one.
    keyed = rows.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("key"))
    texts = keyed.select(F.col("key").alias("doc_id"), "text")
    found = materialise(_classes_of(texts, _told(texts, width), width), "keyed-classes", ROWS)
    by_key = found.where("doc_id is not null").select(F.col("doc_id").alias("key"), "n_shingles", "component_id").distinct()
    nodes = materialise(keyed.where("key is not null").select("doc_id", "key").distinct().join(by_key, "key"), "keyed-nodes", ROWS)
    least = nodes.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    joined = connected(nodes.join(least, "component_id").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct())
    known = nodes.select("key", "doc_id", "n_shingles").join(joined, F.col("doc_id") == F.col("node"), "left").select("key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    own = keyed.where("key is not null").select("doc_id", "key").join(known, "key").select("doc_id", "n_shingles", "component_id")
    unnamed = found.where("doc_id is null").select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "n_shingles", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("component_id"))
    return own.unionByName(unnamed)


def _classes_of(texts: DataFrame, told: DataFrame, width: int) -> DataFrame:
    """classes() of texts with whole-number ids that each have one set, and their signatures and bucket counts."""
    spark = texts.sparkSession
    parts = max(texts.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    signatures = told.where("block is null").select("doc_id", "n", "f1", "f2")
    table = np.zeros((BUCKET_BLOCKS, (1 << BUCKET_BITS) // BUCKET_BLOCKS), dtype=np.uint8)
    blocks = told.where("block is not null").select("block", "counts").repartitionById(BUCKET_BLOCKS, "block").mapInArrow(releasing(_classes), "block int, classes binary")
    for row in blocks.collect():  # 64 rows, 1 MB together, whatever the corpus
        table[row["block"]] = np.frombuffer(row["classes"], dtype=np.uint8)
    order = table.reshape(-1)
    nodes = signatures.where("n > 0 and doc_id is not null")
    keys = ["n", "f1", "f2"]
    copies = materialise(nodes.join(nodes.groupBy(keys).agg(F.min("doc_id").alias("same")), keys).where("doc_id <> same").select("doc_id", "same").distinct(), "copies", ROWS)

    def led(prefixes: DataFrame, name: str) -> DataFrame:
        met = prefixes.repartition(parts, "token", "part").sortWithinPartitions("token", "part", "pos", "n", "doc")
        return materialise(met.mapInArrow(releasing(_hits), "token long, doc long, n int, pos int, leader long, leader_n int, leader_pos int"), name, ROWS)

    hits = led(texts.mapInArrow(releasing(_prefixes(width, order, HOT)), "token long, part int, doc long, n int, pos int"), "prefix-hits")
    if _parts(order, HOT).max() > 1:
        firsts = led(hits.where("leader is null").select("token", F.lit(-1).alias("part"), "doc", "n", "pos"), "first-hits")
        hits = hits.where("leader is not null").unionByName(firsts)

    def one(df: DataFrame, column: str) -> DataFrame:
        """Replaces a document by the smallest with an equal set."""
        return df.join(copies.select(F.col("doc_id").alias(column), "same"), column, "left").withColumn(column, F.coalesce("same", column)).drop("same")

    near = hits.where(_within(F.col("n"), F.col("pos"), F.col("leader_n"), F.col("leader_pos"))).select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = materialise(one(one(near, "a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "leader-pairs", ROWS)
    links = verify(texts, pairs, width, order)
    found = connected(links)

    members = hits.select("token", "doc", "n", "pos").unionByName(hits.select("token", F.col("leader").alias("doc"), F.col("leader_n").alias("n"), F.col("leader_pos").alias("pos")))
    members = one(members.distinct(), "doc").distinct().join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    members = materialise(members.select("token", "doc", "n", "pos", "component"), "members", ROWS)
    mixed = members.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    spread = materialise(members.join(mixed, "token"), "mixed-members", ROWS)
    by_class = spread.groupBy("token", "component").agg(F.count("*").alias("size"))
    groups = by_class.groupBy("token").agg(F.sum("size").alias("size"), F.max(F.struct("size", "component")).alias("most")).withColumn("visitors", F.col("size") - F.col("most.size"))
    unit = F.when(F.col("visitors") <= SMALL_BLOCK, SMALL_BLOCK).otherwise(BLOCK)
    groups = groups.select("token", F.col("most.component").alias("main"), F.ceil(F.col("size") / unit).alias("blocks"), F.ceil(F.col("visitors") / BLOCK).alias("chunks"))
    dealt = spread.join(groups, "token").withColumns({"own": F.pmod(F.xxhash64("doc"), "blocks"), "seat": F.pmod(F.xxhash64("doc", F.lit(1)), "chunks"), "minor": F.col("component") != F.col("main")})
    row = ["doc", "n", "pos", "component"]
    at_home = dealt.select("token", F.col("own").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), *row, F.when(F.col("minor"), MINOR).otherwise(MAIN).alias("role"))
    visiting = dealt.where("minor").select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("seat").alias("chunk"), *row, F.lit(VISITOR).alias("role"))
    cross = at_home.unionByName(visiting).repartition(parts, "token", "block", "chunk").sortWithinPartitions("token", "block", "chunk").mapInArrow(releasing(_cross_pairs), "a long, b long")
    rest = materialise(cross.distinct().join(pairs, ["a", "b"], "left_anti"), "cross-pairs", ROWS)
    if not rest.isEmpty():
        found = connected(links.unionByName(verify(texts, rest, width, order)))

    final = signatures.join(copies, "doc_id", "left").withColumn("node", F.coalesce("same", "doc_id")).join(found, "node", "left")
    return final.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    return classes(docs)
