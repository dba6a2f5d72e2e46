"""The pipeline's stages: what goes and what stays."""

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "test")
        assert docs.columns == names, name
        now = {r.doc_id: r.text for r in docs.collect()}
        assert set(now) <= set(kept)
        if name == "personal_data":
            assert set(now) == set(kept) and now != kept
        else:
            assert all(kept[k] == t for k, t in now.items()) and len(now) < len(kept), name
        kept = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in out.collect()} == set(kept)


def test_odd_rows(spark, sf):
    rows = [(None, "a b c d e f g", "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (1, None, "en", "s", None), (2, "", None, None, 0), (3, "a b c d e f h i j", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near, leaks, private = (dict(corpus_pipeline.STAGES)[n] for n in ("near_duplicates", "decontamination", "personal_data"))
    out = near(spark, docs, sf)
    assert out.count() == 4
    assert private(spark, leaks(spark, out, sf), sf).count() == 4


def test_empty_and_extra_columns(spark, sf):
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, n_entities long, __found int, sig string"
    row = (7, "mail a.b@mail.example.com about the price of it", "en", "s", 3, "keep", 5, 99, 4, "x")
    for rows in ([], [row, row]):
        docs = spark.createDataFrame(rows, names)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, sf), "test")
            assert docs.columns == [c.split()[0] for c in names.split(", ")], name
        got = docs.collect()
        assert len(got) == len(rows) and all((r.score, r.predicted, r.n_entities, r["__found"]) == ("keep", 5, 99, 4) and "a.b@mail" not in r.text for r in got)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)
        quality = dict(corpus_pipeline.STAGES)["quality"]
        assert quality(spark, docs, sf).columns == docs.columns and quality(spark, docs, sf).count() <= len(rows)
