from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import decontam, quality
from quirework.llm.common import table

from .test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece_encoding"]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns
        a, b = ({r.doc_id: r for r in x.collect()} for x in (before, after))
        assert set(b) <= set(a)
        if name == "quality_rules":
            judged = quality.digest(before, table(spark, SF, "labels"))
            assert set(b) == {r.doc_id for r in judged.collect() if r.kept}
        if name == "line_dedup":
            assert set(b) == set(a) and all(r.n_chars == len(r.text) for r in b.values() if r.text != a[r.doc_id].text)
        if name == "simhash_near_dedup":
            ids = sorted(a)
            assert set(b) == {ids[i] for i in brute_kept([a[i].text for i in ids])}
        if name == "benchmark_decontamination":
            assert set(a) - set(b) == {r.doc_id for r in decontam.digest(before, table(spark, SF, "benchmark")).collect()}
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r.doc_id for r in last} == set(b) and all(r.lossless and len(r.ids) for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(b)


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_extra_columns_with_clashing_names(spark):
    docs = table(spark, SF, "documents")
    names = ["id", "fp", "quality", "kept", "encoded", "spans", "h", "b", "n", "item_id", "ids", "token", "component_id"]
    odd = docs.withColumns({n: F.lit(1) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, odd, SF)
        assert done.columns == odd.columns, name
        assert done.count() == stage(spark, docs, SF).count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == docs.count()
