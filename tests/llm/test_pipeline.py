"""The pipeline, stage by stage, against plain forms."""

from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import cases
from weirflow.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near copies", "decontamination", "pii", "pieces"]
    rows = {r.doc_id: r.text for r in docs.collect()}

    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality"](spark, docs, SF)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {d for d, t in rows.items() if model.scores(quality.np.array([quality.features(t)]))[0] >= 0.7}
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns

    two = stage["near copies"](spark, one, SF)
    ids = sorted(kept)
    roots = cases.components([rows[i] for i in ids])
    kept = {ids[c] for c in roots}
    assert {r.doc_id for r in two.collect()} == kept and two.columns == docs.columns

    three = stage["decontamination"](spark, two, SF)
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {d for d in kept if any(i in decontaminate.normal(rows[d]) for i in items)}
    left = {r.doc_id for r in three.collect()}
    assert exact and left <= kept - exact and len(left) == len(kept - exact)

    four = stage["pii"](spark, three, SF)
    assert {r.doc_id for r in four.collect()} == left and four.columns == docs.columns
    assert not any("@mail" in r.text for r in four.collect())
    assert {r.doc_id for r in stage["pieces"](spark, four, SF).collect()} == left
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == left


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names}


def test_stages_on_hard_rows_and_empty_tables(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns: every stage keeps its columns, and loses no row but by its rule."""
    for docs in (cases.documents(spark, extra=True), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, SF)
            if name != "pieces":
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
            if name in ("pii", "pieces"):
                assert out.count() == docs.count()
    assert stage is corpus_pipeline.pieces_stage and corpus_pipeline.quality_stage(spark, cases.documents(spark, extra=True), SF).columns == cases.documents(spark, extra=True).columns
