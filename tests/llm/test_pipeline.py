"""The pipeline's stages against what their operators decide, and its last result."""

import zlib

import corpus_pipeline as p
from recordloom.llm import mixing, quality, simhash
from tests.llm.test_operators import awkward, base_spans, check_packing, entropy_spans, expected_pieces, plain_components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]

    good = p.quality_stage(spark, docs, sf)
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.scored(docs, labels).where("accepted").collect()}
    assert good.join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * docs.join(labels.where("quality = 1"), "doc_id").count()

    one = p.near_duplicate_stage(spark, good, sf)
    assert one.columns == columns
    before = {r.doc_id: r.text for r in good.collect()}
    left = {r.doc_id for r in one.collect()}
    words = {i: (t or "").encode().lower().split() for i, t in before.items()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    share = lambda a, b: len(grams[a] & grams[b]) / max(1, len(grams[a] | grams[b]))
    near = [(a, b) for a in before for b in before if a < b and share(a, b) >= 0.8]
    label = plain_components(before, near)
    assert not [i for i in left if label[i] != i]  # no two of a group stay
    assert not [i for i in before if i not in left and label[i] == i and i not in label.values()]
    lone = [i for i in before if not any(i in pair for pair in near)]
    assert sum(i in left for i in lone) >= 0.99 * len(lone)

    clean = p.secrets_stage(spark, one, sf)
    assert clean.columns == columns and clean.count() == one.count()
    for r in clean.collect():
        base = base_spans(r.text or "")
        assert not base and not entropy_spans(r.text or "", base)

    mix = p.mixing_stage(spark, clean, sf)
    assert mix.columns == columns and mix.groupBy("doc_id").count().where("count > 1").count() == 0
    assert {r.doc_id for r in mix.collect()} == {r.doc_id for r in mixing.chosen(clean, epochs=1).collect()}

    rows = p.packing_stage(spark, mix, sf).collect()
    check_packing(rows, expected_pieces([(r.doc_id, r.text) for r in mix.collect()], 4096), 4096)


def test_stages_on_awkward_rows_and_an_empty_table(spark, sf):
    """Nulls, empty and long texts, repeated rows, and columns that clash with the stages' own."""
    docs = awkward(spark)
    docs = docs.union(docs.selectExpr("cast(null as long)", *docs.columns[1:]).limit(2))
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "packing":
            assert len(rows) >= docs.count()
        else:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert len(rows) == {"secrets": 13, "quality": len(rows), "near_duplicates": 8, "mixing": len(rows)}[name] and len(rows) <= 13
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    rows = p.run(spark, sf).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert zlib.crc32(b"") == 0 and simhash.MAX_BITS == 2
