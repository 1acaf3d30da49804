"""Operators 2, 3 and 9: against brute force, the public tokenizer and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from voxlake.llm import bpe, quality_classifier, quality_rules
from voxlake.llm.common import table
from voxlake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = bpe.Vocabulary(PATH)


def reference() -> Tokenizer:
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


REFERENCE = reference()


def test_bpe_agrees_with_the_tokenizers_library_on_documents(spark, sf_dir):
    want = {}
    for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        ids = REFERENCE.encode(r.text or "", add_special_tokens=False).ids
        decoded = REFERENCE.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_bpe"](spark, sf_dir).collect()}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text() | st.text(alphabet=" \t\n 　'adlmrstve12½é😀_-\r\u0085 "), max_size=5))
def test_bpe_agrees_on_any_text(texts):
    for text, ids in zip(texts, VOCABULARY.encode(texts), strict=True):
        assert ids.tolist() == REFERENCE.encode(text, add_special_tokens=False).ids
        assert VOCABULARY.decode(ids) == REFERENCE.decode(ids.tolist(), skip_special_tokens=False) == text


def test_bpe_on_special_tokens_and_broken_ids():
    special = next(iter(VOCABULARY.special))
    for text in (special, f"a{special}b", f" {special} {special}", special[:-1], "a" * 5000, "ab" * 3000, " " * 700):
        ids = VOCABULARY.encode([text])[0]
        assert ids.tolist() == REFERENCE.encode(text, add_special_tokens=False).ids
        assert VOCABULARY.decode(ids) == REFERENCE.decode(ids.tolist(), skip_special_tokens=False)
    half = VOCABULARY.encode(["😀"])[0][:1]
    assert VOCABULARY.decode(half) == REFERENCE.decode(half.tolist(), skip_special_tokens=False)


def test_bpe_on_edge_rows(spark, edge_docs, no_docs):
    rows = bpe.encode(edge_docs, PATH).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert r.ids == REFERENCE.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    back = bpe.decode(bpe.encode(edge_docs.select("doc_id", "text"), PATH), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode(no_docs, PATH).count() == 0 and bpe.digests(no_docs, PATH).count() == 0


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n, repeat = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, n < 50 or 100 * repeat > 50 * n


def test_rule_statistics_agree_with_brute_force(spark, sf_dir, edge_docs):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op9_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_statistics(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    for r in quality_rules.statistics(edge_docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_statistics(r.text)


def test_repeated_windows_across_lines_and_texts():
    texts = ["a b c a b c", "a b c", "x " * 10, "", "one", "one two", "p q r s p q r"]
    assert quality_rules.measure(texts)[:, 4].tolist() == [6, 0, 10, 0, 0, 0, 6]


def test_rules_keep_the_labelled_good_and_reject_the_bad(spark):
    """Held-out labels: the fit sees none of these rows."""
    sf_dir = "/root/testdata/sf0.01"
    kept = {r.doc_id: (r.kept, r.base_failed) for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect()}
    held = [r for r in table(spark, sf_dir, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good = [kept[r.doc_id][0] for r in held if r.quality == 1 and not kept[r.doc_id][1]]
    bad = [kept[r.doc_id][0] for r in held if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_forest_scores_the_odd_row_higher_than_the_others():
    rows = np.random.default_rng(1).normal(size=(500, 5))
    forest = quality_rules.Forest.grow(rows)
    assert forest.score(np.full((1, 5), 9.0))[0] > forest.score(rows).max()


def test_rules_on_edge_rows(spark, edge_docs, no_docs, labels):
    assert quality_rules.filter_documents(edge_docs, labels).columns == edge_docs.columns
    kept = quality_rules.filter_documents(edge_docs, labels).select("doc_id").collect()
    assert {r.doc_id for r in kept} <= {4, 5, 8}
    assert quality_rules.filter_documents(no_docs, labels).count() == 0
    unlabelled = quality_rules.filter_documents(edge_docs, labels.limit(0)).select("doc_id").collect()
    assert {r.doc_id for r in unlabelled} == {4, 5, 8}


def test_classifier_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, sf_dir).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in table(spark, sf_dir, "labels").collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_classifier_never_learns_from_held_out_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, 1 - quality, quality) AS quality")
    assert np.array_equal(quality_classifier.fit(docs, labels), quality_classifier.fit(docs, flipped))


def test_classifier_features_of_a_text_do_not_depend_on_its_batch():
    texts = [prose(i, 30 + i) for i in range(5)] + ["", "a a b a"]
    together, sizes = quality_classifier.hashed(texts, 16)
    alone = [quality_classifier.hashed([t], 16)[0] for t in texts]
    assert [sorted(x) for x in np.split(together, np.cumsum(sizes)[:-1])] == [sorted(x) for x in alone]


def test_classifier_on_edge_rows(spark, edge_docs, no_docs, labels):
    weights = quality_classifier.fit(edge_docs, labels)
    rows = quality_classifier.score(edge_docs, weights).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text in (None, "")}) == 1 and len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    none = quality_classifier.fit(edge_docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(edge_docs, none).collect()} == {0.5}
    assert quality_classifier.score(no_docs, weights).count() == 0
