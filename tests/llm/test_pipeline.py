"""The pipeline against a brute-force version of its decisions, stage by stage, and its behaviour on edge rows."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_dedup import brute_classes, brute_contamination, brute_lines
from tests.llm.test_tokens_and_scores import REFERENCE, brute_statistics
from voxlake.llm import quality_rules
from voxlake.llm.common import table, written


def test_every_stage_agrees_with_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.collect()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = (before, after := docs.collect())
        if name != "bpe":
            assert docs.columns == columns
        before = after
    first, kept = seen["quality_rules"]
    assert set(kept) <= set(first) and not any(brute_statistics(r.text)[5] for r in kept)
    stats = quality_rules.statistics(table(spark, sf_dir, "documents")).drop("text")
    verdicts = quality_rules.judge(stats, quality_rules.fit(stats, table(spark, sf_dir, "labels")))
    assert {r.doc_id for r in kept} == {r.doc_id for r in verdicts.filter("kept").collect()}
    first, kept = seen["line_dedup"]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((k[0], k[1]) for k in brute_lines(first).elements())
    assert all(r.n_chars == len(r.text) for r in kept)
    first, kept = seen["near_dedup"]
    classes = brute_classes({r.doc_id: r.text for r in first})
    assert {r.doc_id for r in kept} == set(classes.values()) and len(kept) == len(set(classes.values()))
    first, kept = seen["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert {r.doc_id for r in kept} == {r.doc_id for r in first if not brute_contamination(r.text, items)[3]}
    first, coded = seen["bpe"]
    texts = {r.doc_id: r.text for r in first}
    assert len(coded) == len(first) and all(r.ids == REFERENCE.encode(texts[r.doc_id], add_special_tokens=False).ids for r in coded)


def test_stages_take_edge_rows_and_no_rows(spark, edge_docs, no_docs, sf_dir):
    columns = no_docs.columns
    for docs in (edge_docs.select(*columns), no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), "test-edge")
        docs.count()
