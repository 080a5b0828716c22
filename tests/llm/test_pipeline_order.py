"""The order of the mix reaches the rows of the pipeline."""

import corpus_pipeline
from lattica.llm import mixing
from lattica.llm.common import written


def test_place_after_reading_again(spark, make):
    rows = [(i, f"t{i}", "en", "a" if i % 3 else "b", 2) for i in range(1500)] + [(None, "no id", None, None, None)]
    docs = make(rows)
    want = {r.doc_id: r.mix_position for r in mixing.scheduled(docs).collect()}
    mixed = written(corpus_pipeline.mix(spark, docs, "").repartition(7), "mixed")  # several files, dealt in any order
    got = written(corpus_pipeline.encode(spark, mixed, ""), "encoded").orderBy("mix_position").collect()
    assert [r.doc_id for r in got] == [k for k, _ in sorted(want.items(), key=lambda kv: kv[1])]
    assert {r.doc_id: r.mix_position for r in got} == want
    assert {r.doc_id: r.n_chars for r in got} == {r[0]: len(r[1]) for r in rows}


def test_rows_of_the_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    places = [r.mix_position for r in rows]
    assert rows and None not in places and len(set(places)) == len(rows)
