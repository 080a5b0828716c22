import corpus_pipeline
import pytest
from lattica.llm import mixing, pieces, pii, simhash, toxicity
from lattica.llm.common import table, written


def test_stages_and_rows(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "personal data", "mixing", "encoding"]
    want = toxicity.scores(docs, labels)
    kept = docs.join(want.where("predicted = 0").select("doc_id"), "doc_id", "left_semi")
    groups = simhash.similar(kept).where("doc_id = component").select("doc_id")
    ids = {r.doc_id for r in groups.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == ids and len(rows) == len(ids)
    texts = {r.doc_id: r.text for r in pii.replaced(docs.join(groups, "doc_id", "left_semi"), pii.key_of(spark)).collect()}
    reader = pieces.Pieces()
    assert all(reader.decode(r.pieces) == (texts[r.doc_id] or "") for r in rows)


@pytest.mark.parametrize("k", range(4))
def test_columns_of_documents(spark, sf, k):
    docs = table(spark, sf, "documents")
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf)
    assert out.schema.simpleString() == docs.schema.simpleString()


def test_order_of_the_mix(make):
    docs = make([(i, f"t{i}", "en", "a" if i % 3 else "b", 2) for i in range(200)])
    place = {r.doc_id: r.mix_position for r in mixing.scheduled(docs).collect()}
    got = [place[r.doc_id] for r in corpus_pipeline.mix(None, docs, "").collect()]
    assert got == sorted(got)


def test_stages_on_odd_rows(spark, make, odd, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and further columns go through all stages."""
    labels = tmp_path / "labels.parquet"
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(labels))
    for rows in (odd, []):
        docs = make(rows, extra=True)
        want = [r.doc_id for r in docs.collect()]
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, str(tmp_path)), f"odd-{name.replace(' ', '-')}")
            assert docs.columns == make(rows, extra=True).columns
        if rows:
            want = [0, 1, 4, 5, 6, None]  # 2 and 3 are copies of 1, the second 0 is one of the first
        last = corpus_pipeline.STAGES[-1][1](spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), str(tmp_path)).collect()
        assert sorted((r.doc_id for r in last), key=str) == sorted(want, key=str)
        assert all((r.n_pieces == 0) == (r.n_chars == 0) for r in last)
