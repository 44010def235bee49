"""Nulls, empty and very long texts, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from snapdelta.llm import decontamination, embedding_dedup, language_id, minhash, mixing, pii, sharding, token_counts, toxicity, url_filter

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the quick brown fox jumps over it " * 40_000
ROWS = [
    (1, "the quick brown fox", "en", "a", 19), (1, "the quick brown fox", "en", "a", 19), (2, "the quick brown fox", "en", None, None),
    (None, "null id here", None, "a", 12), (None, None, None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, " \n\t ", "de", "b", 4),
    (6, "### $$$", "de", "b", 7), (7, LONG, "en", "a", len(LONG)), (8, "x", "en", "c", 1), (9, "𝒳 İstanbul ퟿ ñ", "tr", "c", -5),
]
CLASH = ["slot__", "epoch__", "node", "root", "band", "size", "keep_id", "score", "toxic", "row_", "row__", "n_", "d_", "i_", "s__", "c__", "id__", "b__", "t__", "label", "items", "Shard"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SHAPE)
    return rows.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (7, None, None), (None, 1, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over it the quick"), (2, None), (None, "null id of an item here now"), (3, "")], "item_id bigint, text string").withColumn("doc_id", F.lit(1))


def same_columns(out, docs, more=()):
    assert out.columns == [c for c in docs.columns if c.lower() not in {m.lower() for m in more}] + list(more)
    return out.collect()


def test_token_counts(docs, empty):
    got = token_counts.token_counts(docs).collect()
    assert len(got) == len(ROWS) and sum(r.n_tokens is None for r in got) == 2 and token_counts.token_counts(empty).isEmpty()
    assert [r.n_words for r in got if r.doc_id == 7] == [280_000]


def test_toxicity(docs, empty, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and sum(r.score is None for r in got) == 5 and {r.toxic for r in got if r.score is None} == {False}
    assert [r.n_windows for r in got if r.doc_id == 7] == [len(toxicity.windows(280_000))]
    assert toxicity.toxicity(empty, labels).isEmpty() and toxicity.toxicity(docs, labels.limit(0)).where("toxic").isEmpty()


def test_pii(docs, empty):
    more = docs.unionByName(docs.where("doc_id = 8").withColumn("text", F.lit("mail ann.12@mail3.example.com now")))
    assert [(r.doc_id, r.surface) for r in pii.personal_data(more).collect() if r.kind == "email"] == [(8, "ann.12@mail3.example.com")]
    assert pii.personal_data(empty).isEmpty()


def test_mixing(docs, empty):
    out = mixing.mix(docs, {"a": 1, None: 1, "gone": 5}, block_chars=1000)
    got = out.collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS} and len([r for r in got if r.epoch__ == 0]) == len(ROWS)
    assert len(same_columns(mixing.mixed_documents(docs), docs)) >= len(ROWS)
    assert mixing.mix(empty).isEmpty() and mixing.mixed_documents(empty).isEmpty()
    assert mixing.mix(docs.drop("n_chars")).count() >= len(ROWS)


def test_decontamination(docs, empty, bench):
    spans = decontamination.contamination(docs, bench).collect()
    assert [(r.doc_id, r.n_words) for r in spans] == [(7, 279_995)]  # the last five words repeat no phrase
    out = decontamination.decontaminate(docs, bench)
    assert len(same_columns(out, docs)) == len(ROWS)
    assert decontamination.contamination(empty, bench).isEmpty() and decontamination.contamination(docs, bench.limit(0)).isEmpty()
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(ROWS)


def test_language_id(docs, empty):
    got = language_id.language_id(docs).collect()
    assert len(got) == len(ROWS) and sum(r.main is None and not r.accepted for r in got) == 5
    passing = language_id.language_id(docs, passing=True)
    assert len(same_columns(passing, docs)) == sum(r.accepted for r in got)
    assert language_id.language_id(empty).isEmpty() and language_id.language_id(empty, passing=True).isEmpty()


def test_minhash(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 1, 3), (1, 1, 3), (2, 1, 3)]
    left = same_columns(minhash.remove_near_duplicates(docs), docs)
    assert len(left) == len(ROWS) - 2 and {r["n_"] for r in left} == {"n_!"}
    assert minhash.near_duplicates(empty).isEmpty() and minhash.remove_near_duplicates(empty).isEmpty()


def test_sharding(docs, empty):
    got = sharding.sharding(docs, 3).collect()
    assert len({r.doc_id for r in got}) == len(got) and {1, 2, 3, 4, 5, 6, 7, 8, 9} <= {r.doc_id for r in got}
    rows = same_columns(sharding.sharded_documents(docs, 3), docs, ["shard", "slot", "place"])
    assert len(rows) == len(ROWS) and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.sharding(empty).isEmpty() and sharding.sharded_documents(empty).isEmpty()


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit("x")).withColumn("v", F.lit(1))
    got = [tuple(r) for r in embedding_dedup.near_duplicate_vectors(df).collect()]
    alone = {(3, 3, 0), (10, 10, 0), *((i, None, 0) for i in (4, 5, 6, 7, 8, 9)), (None, None, 0)}
    assert len(got) == 12 and set(got) == {(1, 1, 2), (2, 1, 2), (11, 1, 2)} | alone
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).isEmpty()
    two = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.0, 0.0]), (3, [9.0, 0.1, 0.0])], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicate_vectors(two).collect()) == [(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 2, 1)]


def test_urls(spark, labels):
    rows = [(1, "http://a.example.org/en/1"), (1, "http://a.example.org/en/1"), (2, None), (None, "x"), (3, ""), (4, "http://" + "b" * 100_000 + "/7?" + "&".join(f"k{i}=v" for i in range(500)))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("rule", F.lit("x")).withColumn("tokens", F.lit(1)).withColumn("doc_id", F.lit(1))
    got = url_filter.url_filter(pages, labels).collect()
    assert len(got) == len(rows) and not any(r.blocked for r in got)
    assert url_filter.url_filter(pages.limit(0), labels).isEmpty() and url_filter.url_filter(pages, labels.limit(0)).count() == len(rows)
