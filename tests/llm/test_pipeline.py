"""The pipeline's stages, each against brute force on its own input."""

import pytest

import corpus_pipeline as pipeline
from gridloom.llm import packing
from tests.helpers import DATA

from . import brute


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("kept", pipeline.F.lit("x")).withColumn("held", pipeline.F.lit(1))
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    good = stages["quality_classifier"](spark, docs, DATA).persist()
    bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 0").collect()}
    fine = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
    left = {i for i, _ in texts(good)}
    assert len(left & bad) <= 0.1 * len(bad) and len(left & fine) >= 0.98 * len(fine) and good.columns == docs.columns
    unique = stages["minhash_near_dedup"](spark, good, DATA).persist()
    near = brute.near(texts(good))
    assert {i for i, _ in texts(unique)} == {i for i, r in near.items() if r[2]} and unique.columns == docs.columns
    cut = stages["suffix_array_dedup"](spark, unique, DATA).persist()
    want = brute.repeated(texts(unique))
    assert {i for i, _ in texts(cut)} == {i for i, (n, removed, _, _) in want.items() if not removed or removed < n}
    before = dict(texts(unique))
    for r in cut.collect():
        n, removed, _, _ = want[r.doc_id]
        assert r.text == before[r.doc_id] if not removed else n - removed - 8 <= len(r.text.encode()) <= n - removed
        assert r.n_chars == len(r.text) or not removed
    assert [(f.name, f.dataType) for f in cut.schema] == [(f.name, f.dataType) for f in docs.schema]
    clean = stages["benchmark_decontamination"](spark, cut, DATA).persist()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = brute.contaminated(texts(cut), items)
    assert {i for i, _ in texts(clean)} == {i for i, r in leaks.items() if not r[4]}
    packed = stages["best_fit_packing"](spark, clean, DATA)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in texts(clean)}
    assert packed.agg({"length": "max"}).first()[0] <= packing.CAPACITY


def test_null_and_empty(spark, clashing):
    docs = clashing.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0, name
    odd = clashing.filter("doc_id is null or text is null or text = ''")
    for _, stage in pipeline.STAGES[:-1]:
        odd = stage(spark, odd, DATA)
    assert odd.filter("text is null").count() == 2


def test_rows_without_or_with_one_id(spark):
    """Rows without a doc_id, or given twice, are judged each for itself."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(pipeline.STAGES)

    def nameless(df):
        return df.withColumn("doc_id", pipeline.F.lit(None).cast(docs.schema["doc_id"].dataType)).select(docs.columns)

    judged = stages["quality_classifier"](spark, docs, DATA).persist()
    bad = docs.join(judged, "doc_id", "left_anti")
    assert bad.count() > 0
    left = stages["quality_classifier"](spark, docs.union(nameless(bad)), DATA)
    assert left.filter("doc_id is null").count() == 0 and left.count() == judged.count()

    some = docs.filter("length(text) > 200").orderBy("doc_id").limit(20)
    once = stages["minhash_near_dedup"](spark, some, DATA)
    more = stages["minhash_near_dedup"](spark, nameless(some).union(some).union(some), DATA)
    assert sorted(texts(more)) == sorted(texts(once))
    alone = stages["minhash_near_dedup"](spark, nameless(some).union(nameless(some)), DATA)
    assert alone.count() == once.count() and alone.filter("doc_id is not null").count() == 0

    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").limit(3)
    leaks = items.selectExpr(*[f"cast({'text' if c == 'text' else 'null'} as {t}) as {c}" for c, t in docs.dtypes])
    assert stages["benchmark_decontamination"](spark, leaks, DATA).count() == 0


@pytest.mark.parametrize(("ids", "own"), [([1, 2, -3], True), ([1, 1, 2], False), ([1, None, 2], False), (["1", "2", "x"], False), ([], True)])
def test_keys(spark, ids, own):
    """Each row has a key of its own: doc_id where that is one."""
    kind = "string" if ids and isinstance(ids[0], str) else "long"
    docs = spark.createDataFrame([(i, "same") for i in ids], f"doc_id {kind}, row_key string")
    rows, key = pipeline.keyed(spark, docs)
    got = rows.collect()
    assert key == "row_key_" and len({r[key] for r in got}) == len(ids)
    assert not own or all(r[key] == r["doc_id"] for r in got)
