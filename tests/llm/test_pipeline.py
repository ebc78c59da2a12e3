import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import DOCS, near_copies, passages

SF = "/root/testdata/sf0.001"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_in_order_keep_columns(spark):
    df = docs(spark)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns, name
    assert corpus_pipeline.run(spark, SF).columns == [*df.columns, "shard_no", "shard_slot"]


def test_each_stage_by_brute_force(spark):
    df = docs(spark)
    texts = {r.doc_id: r.text for r in df.collect()}
    ids = lambda out: sorted(r.doc_id for r in out.select("doc_id").collect())
    kept = ids(corpus_pipeline.quality(spark, df, SF))
    assert not any(brute.op8_base(texts[i])[5] for i in kept)
    groups = brute.op10(list(texts.items()))
    assert ids(corpus_pipeline.near_dedup(spark, df, SF)) == sorted(i for i, (_, c) in groups.items() if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute.op6(list(texts.items()), items)
    assert ids(corpus_pipeline.decontaminate(spark, df, SF)) == sorted(i for i, h in hits.items() if not h[4])
    mixed = corpus_pipeline.mixing(spark, df, SF)
    assert all(texts[r.doc_id] == r.text for r in mixed.collect())
    placed = corpus_pipeline.sharding(spark, mixed, SF)
    assert placed.count() == mixed.count()
    per = placed.groupBy("shard_no").agg(F.count("*").alias("n"), F.count_distinct("shard_slot").alias("u"), F.max("shard_slot").alias("hi")).collect()
    assert all(r.n == r.u == r.hi + 1 for r in per)


def test_stages_on_odd_tables(spark):
    odd = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(near_copies(1) + passages(2, 10))] + [(None, None, None, None, None), (1, "again", "en", "s", 1)], DOCS)
    odd = odd.withColumns({"kept": F.lit(1), "component_id": F.lit(2), "__size": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), SF).count() == 0, name
        out = stage(spark, odd, SF)
        assert out.columns[: len(odd.columns)] == odd.columns, name
        assert out.count() > 0, name


def test_near_dedup_decides_on_rows(spark):
    first, other = near_copies(3)[0], "a wholly different text of quite a few words that nobody else has"
    rows = [(0, first), (1, first + " more"), (1, other), (2, first), (2, first), (3, other + " x y z"), (None, first), (None, "null id alone here with words"), (7, "twice the same row of words here"), (7, "twice the same row of words here")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("n", F.lit(5))
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, SF).collect())
    groups = {}
    for i, t in rows:
        print_ = brute.op10([(0, t)])[0][0]
        key = next((k for k in groups if (int(k, 16) ^ int(print_, 16)).bit_count() <= 3), print_)
        groups.setdefault(key, []).append((i is None, i if i is not None else 0, t))
    assert len(got) == len(groups) and got.count((False, 7, "twice the same row of words here")) == 1
    assert (False, 1, other) in got and (True, None, "null id alone here with words") in got and (False, 0, first) in got
