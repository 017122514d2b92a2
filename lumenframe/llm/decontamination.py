"""Benchmark passages in documents, found by spaced seeds and verified word by word.

Only DataFrame and SQL functions.  A seed is the hash of the words that a fixed
mask keeps; it ignores the words between.  The same masks run over every
document and every benchmark item, and equal hashes join.  Around each hit the
item is laid on the document and the aligned words are compared: a document holds
an item if some ``SPAN`` aligned words in a row, or the whole item if it is
shorter, agree in at least four of five places.

Items of ``LONG`` words or more have two masks of five words, which together
have a hit in any 16 aligned words of which at most three differ, and in any 13 of
which at most two do.  A shorter item of n words that may differ in k words is
split into parts; each of its masks keeps all parts but k, so one of them hits
whichever k words differ.  No passage within the rule is missed at any length.

Words are the lower-cased runs outside white space.

The benchmark is read in blocks of at most ``MOST_SEEDS`` seeds and ``MOST_BYTES``
of words, each broadcast to one pass over the documents, so that no seed, however
frequent, makes a hot task.  A block that exceeds a bound, which takes an item of
that size, is joined as the planner sees fit.

Defined cases: null, empty and wordless texts and items hold and are nothing;
null ids stay null in the result; items or documents that repeat an id are laid
on one row by it; an empty table on either side gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the word counts; 0: it is skipped.
MASKS = ("110001011", "1100100101")
SPAN, LONG = 16, 13
MOST_SEEDS, MOST_BYTES = 2_000_000, 64 << 20


def short_masks(n: int, agree: float = 0.8) -> tuple[str, ...]:
    """Masks of n places of which one misses any k = n - ceil(agree n) of them: all but k of a split into k + 1 parts, or two more."""
    k = n - math.ceil(agree * n - 1e-9)
    if not k:
        return ("1" * n,)
    parts = min(n, k + 2)
    part_of = [i * parts // n for i in range(n)]
    return tuple("".join("0" if part_of[i] in out else "1" for i in range(n)) for out in combinations(range(parts), k))


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _seed(mask: str, salt: int) -> Column:
    """The seed under one mask at the word ``place`` of ``words``; null where it does not fit."""
    ones = [k for k, c in enumerate(mask) if c == "1"]
    return F.when(F.col("place") + len(mask) <= F.size("words"), F.xxhash64(*(F.get(F.col("words"), F.col("place") + k) for k in ones), F.lit(salt)))


def _with_seeds(df: DataFrame, masks: dict[int, str]) -> DataFrame:
    """A row per seed, with its place; the other columns go along.

    Places are generated first and each seed is read off the array, so that the
    hashes, and the join that follows, are generated code over rows and neither
    copies the array nor calls a lambda for each word.
    """
    others = df.columns
    rows = df.select("*", F.posexplode("words").alias("place", "word")).drop("word")
    return rows.select(*others, "place", F.explode(F.array(*(_seed(mask, salt) for salt, mask in masks.items()))).alias("seed")).where("seed is not null")


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, agree: float = 0.8) -> DataFrame:
    """Per document and item that it holds: start (word where the item's first word lies, may be negative), n_equal aligned words, n_item words."""
    items = benchmark.select(F.col(item_id).alias("item_id"), _words(item_text).alias("words"), F.xxhash64(item_id, item_text).alias("number")).where("size(words) > 0").dropDuplicates(["number"])
    size = F.size("words")
    told = items.agg(F.sum(size).alias("n"), F.sum(F.aggregate("words", F.lit(0), lambda s, w: s + F.octet_length(w) + 8)).alias("bytes"), F.collect_set(F.when(size < LONG, size)).alias("short")).first()
    short = {100 * n + j: mask for n in sorted(told["short"]) for j, mask in enumerate(short_masks(n, agree))}  # of twelve lengths at most
    blocks = max(1, -(-2 * (told["n"] or 0) // MOST_SEEDS), -(-(told["bytes"] or 0) // MOST_BYTES))
    # The row numbers keep the planner from moving later conditions below: it would split every text twice, and
    # put the comparison into the join, which would then copy a text's words for each of its seeds.
    texts = docs.select(F.col(doc_id).alias("doc_id"), _words(text).alias("words"), F.monotonically_increasing_id().alias("row"))
    found = [_held(texts, items.where(F.pmod("number", F.lit(blocks)) == k) if blocks > 1 else items, short, span, agree) for k in range(blocks)]
    best = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("back"), "n_item")).alias("m"))
    return best.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias("item_id"), (-F.col("m.back")).cast("long").alias("start"), F.col("m.n_equal").cast("long").alias("n_equal"), F.col("m.n_item").cast("long").alias("n_item"))


def _held(texts: DataFrame, items: DataFrame, short: dict[int, str], span: int, agree: float) -> DataFrame:
    """The places where a document holds an item of one block."""
    masks = dict(enumerate(MASKS, 1))
    seeds = _with_seeds(items.where(F.size("words") >= LONG), masks)
    for salt, mask in short.items():
        seeds = seeds.unionByName(_with_seeds(items.where(F.size("words") == len(mask)), {salt: mask}))
    seeds = seeds.select("seed", F.col("number").alias("item_number"), F.col("place").alias("item_place"))
    words = items.select(F.col("number").alias("item_number"), "item_id", F.col("words").alias("item"))
    size = items.agg(F.sum(F.size("words")).alias("n"), F.sum(F.aggregate("words", F.lit(0), lambda s, w: s + F.octet_length(w) + 8)).alias("bytes")).first()
    if 2 * (size["n"] or 0) <= 2 * MOST_SEEDS and (size["bytes"] or 0) <= 2 * MOST_BYTES:  # blocks by a hash come out up to about twice the mean
        seeds, words = F.broadcast(seeds), F.broadcast(words)
    hits = _with_seeds(texts, masks | short).join(seeds, "seed").join(words, "item_number").withColumn("start", F.col("place") - F.col("item_place"))
    near = hits.select("doc_id", "item_id", "start", "item", "row", F.monotonically_increasing_id().alias("hit"), F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("item")).alias("part"))
    laid = near.select("doc_id", "item_id", "start", "row", "hit", F.transform("item", lambda h, j: F.when((F.col("start") + j >= 0) & (F.get(F.col("part"), F.least(F.col("start"), F.lit(0)) + j) == h), 1).otherwise(0)).alias("equal"))
    width = F.least(F.size("equal"), F.lit(span))
    least = F.ceil(F.lit(agree) * width - F.lit(1e-9))
    # Most hits are chance: too few words agree in all.  The rest are looked at once for each place.
    some = laid.withColumn("n_equal", F.aggregate("equal", F.lit(0), lambda s, e: s + e)).where((F.col("n_equal") >= least) & (F.col("row") >= 0) & (F.col("hit") >= 0))
    some = some.dropDuplicates(["row", "doc_id", "item_id", "start", "equal"]).withColumn("once", F.monotonically_increasing_id())
    runs = F.transform(F.sequence(F.lit(0), F.size("equal") - width), lambda j: F.aggregate(F.slice("equal", j + 1, width), F.lit(0), lambda s, e: s + e))
    return some.where((F.array_max(runs) >= least) & (F.col("once") >= 0)).select("doc_id", "item_id", "start", "n_equal", F.size("equal").alias("n_item"))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark)


#: The rule itself, without seeds: every place where the words of an item and a document agree often enough.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM b),
hits AS (SELECT doc_id, item_id, dw.place - bw.place AS start FROM dw JOIN bw USING (word)
  GROUP BY ALL HAVING count(*) >= ceil(0.8 * least(any_value(n), {SPAN}) - 1e-9)),
laid AS (SELECT h.doc_id, h.item_id, h.start, [CASE WHEN h.start + j >= 0 AND d.w[h.start + j + 1] = b.w[j + 1] THEN 1 ELSE 0 END FOR j IN range(0, len(b.w))] AS e
  FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id)),
held AS (SELECT *, least(len(e), {SPAN}) AS n FROM laid),
kept AS (SELECT doc_id, item_id, start, list_sum(e) AS n_equal, len(e) AS n_item FROM held
  WHERE list_max([list_sum(e[j + 1 : j + n]) FOR j IN range(0, len(e) - n + 1)]) >= ceil(0.8 * n - 1e-9))
SELECT doc_id, item_id, CAST(arg_max(start, n_equal * 1000000000 - start) AS BIGINT) AS start, CAST(max(n_equal) AS BIGINT) AS n_equal, CAST(any_value(n_item) AS BIGINT) AS n_item
FROM kept GROUP BY doc_id, item_id
"""
