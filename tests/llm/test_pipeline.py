"""The pipeline's stages: decisions take effect, clean documents stay, and awkward rows pass."""

import corpus_pipeline as cp

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts], SCHEMA)


def test_stages_on_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialise(stage(spark, docs, sf), name)
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        now = {r.doc_id for r in docs.collect()}
        assert now <= seen and len(now) > 0.7 * len(seen)
        seen = now
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == seen


def test_stages_with_awkward_rows(spark, sf):
    filler = " ".join(f"word{i}" for i in range(60))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    docs = docs_of(spark, [(1, None), (2, ""), (3, filler), (4, filler + " end"), (5, "x " + item + " y"), (6, "mail a.b@example.org now"), (None, "plain text here"), (7, "é" * 100000)])
    kept = cp.drop_near_duplicates(spark, docs, sf).collect()
    assert {r.doc_id for r in kept} == {1, 2, 3, 5, 6, 7, None}
    kept = cp.drop_contaminated(spark, docs, sf).collect()
    assert {r.doc_id for r in kept} == {1, 2, 3, 4, 6, 7, None}
    masked = {r.doc_id: r for r in cp.mask_personal_data(spark, docs, sf).collect()}
    assert masked[6].text == "mail [EMAIL] now" and masked[6].n_chars == 16 and masked[1].text is None
    assert masked[3].text == filler
    packed = cp.pack(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5, 6, 7, None}
    extra = docs.selectExpr("*", "1 as score", "'x' as segments", "2 as row", "3 as clean", "4 as `a b`")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, extra, sf).columns == extra.columns
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0
