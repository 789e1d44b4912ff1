"""The pipeline's near duplicates meet by SimHash as well as by keys of their sets."""

import corpus_pipeline
from tests.llm import cases
from vacancia.llm import simhash_dedup


def copies(spark):
    words = cases.prose(7, 400).split()
    edited = [w if k != 200 else "other" for k, w in enumerate(words)]
    texts = [" ".join(words), " ".join(edited), cases.prose(8, 400), ""]
    rows = [(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)]
    # An id that is repeated with another text, and a row without one.
    rows += [(0, cases.prose(9, 300), "en", "a", 1), (None, " ".join(edited), "en", "a", 1)]
    return cases.frame(spark, rows)


def test_a_component_by_simhash_meets_and_is_confirmed(spark):
    docs = copies(spark)
    near = simhash_dedup.near_rows(docs)
    of = {(r.doc_id, r.own): r.component_id for r in near.collect()}
    assert len(of) == 5 and None not in {k for k, _ in of}
    own = {r.doc_id: r.own for r in simhash_dedup._with_own(docs.filter("text is not null"), "text", "doc_id").filter("doc_id in (1, 2)").collect()}
    first = [c for (k, o), c in of.items() if k == 0]
    assert of[(1, own[1])] in first and of[(2, own[2])] not in first and len(set(first)) == 2
    # Without keys of the sets nothing else meets.
    blind = simhash_dedup.Similar(tables=0)
    alone = simhash_dedup.similar_rows(docs, blind).filter("doc_id <> component_id")
    met = simhash_dedup.similar_rows(docs, blind, near=near).filter("doc_id <> component_id")
    assert alone.count() == 0
    assert [(r.doc_id, r.component_id) for r in met.collect()] == [(1, 0)]


def test_the_stage_takes_simhash(spark, monkeypatch):
    asked, real = [], simhash_dedup.near_rows
    monkeypatch.setattr(simhash_dedup, "near_rows", lambda docs: asked.append(1) or real(docs))
    kept = corpus_pipeline.one_of_similar(spark, copies(spark), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "0", "2", "3", "None"] and asked == [1]
