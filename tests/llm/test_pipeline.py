"""The pipeline's stages: columns, what they keep, and their effect on the one after."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from snapdelta.llm import common, decontamination, language_id, minhash, mixing, sharding


def test_pipeline(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, common.written(stage(spark, kept, sf_dir), f"test-{name}")
        seen[name] = (before, kept)
        assert kept.columns == docs.columns + (["shard", "slot", "place"] if name == "sharding" else [])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["language_id"]
    assert ids(after) == {r.doc_id for r in language_id.language_id(before).where("accepted").collect()}
    before, after = seen["near_dedup"]
    gone = {r.doc_id for r in minhash.near_duplicates(before).where(~F.col("kept")).collect()}
    assert gone and ids(after) == ids(before) - gone
    before, after = seen["decontamination"]
    bench = common.read(spark, sf_dir, "benchmark")
    assert decontamination.contamination(before, bench).count() and decontamination.contamination(after, bench).isEmpty()
    before, after = seen["mixing"]
    assert ids(before) == ids(after) and after.count() >= before.count()
    before, after = seen["sharding"]
    assert after.count() == before.count()
    assert after.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").isEmpty()
    interleaved(after.toPandas())


def interleaved(rows, block=mixing.BLOCK_CHARS):
    """Within each shard: places in order of slots, a source's documents a block a slot, and at any slot less than a block from the source's share."""
    for _, shard in rows.groupby("shard"):
        shard = shard.sort_values("place")
        assert shard.place.tolist() == list(range(len(shard))) and shard.slot.is_monotonic_increasing
        groups = {k: g for k, g in shard.groupby("source", dropna=False)}
        blocks = {k: -(-int((g.n_chars.fillna(0).clip(lower=0) + 1).sum()) // block) for k, g in groups.items()}
        total = sum(blocks.values())
        for k, g in groups.items():
            begin = (g.n_chars.fillna(0).clip(lower=0) + 1).cumsum().shift(1, fill_value=0) // block
            of_block = dict(zip(begin.astype(int), g.slot, strict=True))
            assert g.slot.tolist() == [of_block[int(b)] for b in begin] and len(set(of_block.values())) == len(of_block)
            for b, slot in of_block.items():
                share = blocks[k] / total
                assert abs(b - slot * share) < 1 and abs(b + 1 - (slot + 1) * share) < 1


def test_mix_within_shards(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    rows = sharding.sharded_documents(docs, 3, block_chars=700).toPandas()
    assert len(rows) == docs.count()
    interleaved(rows, 700)


def test_run_with_odd_rows(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, clashing columns; then no rows at all."""
    rng = random.Random(8)
    words = ["".join(rng.choices(["ba", "co", "di", "fu", "ge", "ha", "ki", "lo"], k=3)) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    base = make(40)
    rows = [(i, make(60), "en", f"s{i % 3}", None) for i in range(30)]
    rows += [(100, base, "en", "a", 1), (100, base, "en", "a", 1), (101, base, None, None, 5), (None, base + " again", "en", "a", 5), (102, None, "en", "a", 0), (103, "", "en", "a", 0), (None, None, None, None, None), (104, make(200_000), "en", "b", -3)]
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    clash = ["shard", "slot", "node", "row_", "row__", "place", "n_", "at__"]
    docs = spark.createDataFrame(rows, shape).select("*", *(F.lit(f"{c}!").alias(c) for c in clash))
    bench = spark.createDataFrame([(1, " ".join(base.split()[9:19])), (2, None)], "item_id bigint, text string")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}")
        assert out.columns == [c for c in docs.columns if c not in ("shard", "slot", "place")] + ["shard", "slot", "place"]
        got = out.toPandas()
        assert set(got.doc_id) == ({*range(30), 100, 104} if name == "some" else set())
        assert name == "none" or set(got.text[got.doc_id == 100]) == {" ".join([*base.split()[:9], "", *base.split()[19:]])} and set(got.row_) == {"row_!"}
