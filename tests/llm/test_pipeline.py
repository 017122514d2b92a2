import hashlib

import brute
import corpus_pipeline as pipeline
import public_tokenizers
from fixtures import documents, empty, rows

from lumenframe.llm import byte_bpe, quality_rules


def run_all(spark, docs, folder):
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    return docs


def test_stages_equal_brute_force(spark, tmp_path):
    data = rows()
    data[:] = [*data[:-1], (len(data), f"a text of its own {' '.join(f'o{k}' for k in range(40))}"), data[-1]]  # with the row that repeats
    item = " ".join(f"m{k}" for k in range(30))
    data += [(len(data) + 5, f"{' '.join(brute.split(data[5][1]))} {item} end of it"), (len(data) + 6, f"clean text {' '.join(f'q{k}' for k in range(60))}")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, data).cache()

    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    kept = [(d, t) for d, t in data if judged[d]]
    one = pipeline.filter_quality(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, _ in kept) and one.columns == list(pipeline.COLUMNS)

    kept = list(dict.fromkeys((d, t) for (d, t), (_, _, c) in zip(kept, brute.jaccard_classes(kept), strict=True) if c == d))
    two = pipeline.drop_near_copies(spark, one, str(tmp_path))
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(d for d, _ in kept)

    kept = [(d, t if not k else cut) for (d, t), (_, _, k, cut) in zip(kept, brute.repeats(kept), strict=True)]
    three = pipeline.cut_repeats(spark, two, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in three.collect()) == sorted(kept) and three.columns == list(pipeline.COLUMNS)

    kept = [(d, t) for d, t in kept if item not in (t or "")]
    four = pipeline.drop_benchmark(spark, three, str(tmp_path))
    assert sorted(r["doc_id"] for r in four.collect()) == sorted(d for d, _ in kept) and data[-1][0] in dict(kept)

    five = {r["doc_id"]: r for r in pipeline.encode(spark, four, str(tmp_path)).collect()}
    path = public_tokenizers.path(pipeline.VOCABULARY)
    assert set(five) == set(dict(kept))
    for d, t in kept:
        assert five[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.ranks_of(path)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert run_all(spark, empty(spark), str(tmp_path)).isEmpty()


def test_one_row_of_copies_stays(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    repeated, unnamed, mixed, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "abcd")
    data = [*rows(), (900, repeated), (900, repeated), (None, unnamed), (None, unnamed), (None, mixed), (901, mixed), (902, mixed), (900, other), (None, None), (None, "")]
    two = pipeline.drop_near_copies(spark, documents(spark, data).repartition(3), str(tmp_path)).cache()
    kept = [(r["doc_id"], r["text"]) for r in two.collect()]
    for row in [(900, repeated), (None, unnamed), (901, mixed), (900, other), (None, None), (None, ""), rows()[3]]:
        assert kept.count(row) == 1, row
    assert not {(None, mixed), (902, mixed)} & set(kept) and two.columns == list(pipeline.COLUMNS)
    three = [r["text"] for r in pipeline.cut_repeats(spark, two, str(tmp_path)).collect()]
    assert all(three.count(t) == 1 for t in (repeated, unnamed, mixed, other))


def test_leaks_without_id_go(spark, tmp_path):
    item = " ".join(f"m{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    data = [(None, f"so {item} it ends"), (3, f"and {item} too"), (3, "a clean text of the same id"), (None, "a clean text without an id"), (None, None)]
    four = pipeline.drop_benchmark(spark, documents(spark, data), str(tmp_path))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in four.collect()))) == sorted(map(str, data[2:]))
