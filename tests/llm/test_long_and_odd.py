"""Very long texts, rows without ids, rows that share one, and columns whose names clash, for every operator of the tables."""

import time

import brute
import pytest
import tiktoken
from fixtures import documents
from pyspark.sql import functions as F

from lumenframe.llm import byte_bpe, decontamination, html_extraction, jaccard_join, license_scan, lm_scoring, quality_rules, substring_dedup

LONG = " ".join(f"w{k * k % 9973}" for k in range(120_000))
ROWS = [(None, "a b c d e f g"), (None, None), (1, LONG), (1, "short text of the same id"), (1, "short text of the same id"), (2, ""), (3, "x" * 300_000), (4, "\n" * 50_000), (5, "é \U0001f389 ß " * 2000)]
QUERIES = {m.__name__.rsplit(".", 1)[1]: m.query for m in (lm_scoring, quality_rules, jaccard_join, substring_dedup, byte_bpe, license_scan)}
NAMES = ("shard", "kind", "keys", "vals", "stat", "block", "component_id", "component", "node", "n_words", "score", "kept", "seed", "place", "words", "row", "token", "label", "key", "same")


@pytest.fixture(scope="module")
def odd(spark):
    docs = documents(spark, ROWS)
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(k).alias(n) for k, n in enumerate(NAMES))).repartition(3).cache()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_has_one_result(odd, name):
    began = time.perf_counter()
    got = QUERIES[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ROWS)
    assert time.perf_counter() - began < 120


def test_long_texts_are_read_to_their_end(odd):
    counts = {r["n_words"] for r in quality_rules.query(odd).collect() if r["doc_id"] == 1}
    assert counts == {120_000, 6}
    removed = sorted((r["n_words"], r["n_removed"]) for r in substring_dedup.query(odd).collect())
    assert removed == sorted((n, k) for _, n, k, _ in brute.repeats(ROWS))
    path = __import__("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.ranks_of(path)
    own = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = byte_bpe.encode(odd.where("doc_id in (1, 5)"), path).collect()
    assert sorted(r["n_tokens"] for r in ids) == sorted(len(own.encode_ordinary(t)) for i, t in ROWS if i in (1, 5))


def test_leaks_in_long_and_unnamed_texts(spark, odd):
    words = LONG.split()
    items = spark.createDataFrame([(1, " ".join(words[-40:])), (2, "a b c d e f g"), (None, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find(odd, items).collect()}
    assert got == {(1, 1), (None, 2)}


def test_long_page(spark):
    paragraph = "<p>" + " ".join(f"word{k}" for k in range(40)) + ".</p>"
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1>" + paragraph * 3000 + "</article><footer>&copy; 2020</footer></body></html>"
    pages = spark.createDataFrame([(None, page, 1, "k"), (1, page[: len(page) // 2], 2, "k"), (2, None, 3, "k")], "page_id long, html string, text int, path string").withColumn("url", F.lit(None).cast("string"))
    got = {r["page_id"]: r["text"] for r in html_extraction.query(pages).collect()}
    assert got[None].count("word39.") == 3000 and got[1].count("word39.") >= 1490 and got[2] == ""
