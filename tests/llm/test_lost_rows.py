"""Null and shared ids, repeated rows and input that is dealt anew: no row is lost, doubled or numbered twice. Models against plain loops."""

import math
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from tests.llm.conftest import DOCS, PAGES, prose
from tests.llm.test_dedup import brute_contamination
from tests.llm.test_pages_and_shards import RECORDS, check_shards
from voxlake.llm import common, decontamination, quality_classifier, quality_rules, revisits, sharding
from voxlake.llm.common import table


def test_revisits_of_pages_without_ids_and_with_shared_ones(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x"), (None, "http://b.org/", "y"), (None, "http://c.org/", "z"), (None, "http://c.org/", "z")], PAGES)
    rows = revisits.resolve(revisits.crawl_log(pages)).collect()
    assert Counter((r.record_id, r.url, r.resolution) for r in rows) == Counter(
        [("revisit-1", "a.org", "resolved"), (None, "b.org", "no_response"), (None, "c.org", "no_response")]
    )
    rows = [
        ("s", "http://a.org/", 10, "response", 200, {"etag": "1"}, "one"), ("s", "http://a.org/", 20, "response", 200, {"etag": "2"}, "two"),
        (None, "http://a.org/", 30, "response", 200, {"etag": "3"}, "three"), ("s", "http://a.org/", 20, "response", 200, {"etag": "2"}, "two"),
        ("v", "http://a.org/", 15, "revisit", 304, {"etag": "1"}, None), ("v", "http://a.org/", 25, "revisit", 304, {"etag": "2"}, None),
        ("v", "http://a.org/", 35, "revisit", 304, {"etag": "3"}, None), ("v", "http://a.org/", 35, "revisit", 304, {"etag": "3"}, None),
        (None, "http://a.org/", 26, "revisit", 304, {"etag": "2"}, None), ("n", "http://a.org/", 36, "revisit", None, None, None), ("m", "http://a.org/", 37, None, None, None, None),
    ]
    records = spark.createDataFrame(rows, RECORDS)
    for given in (records, records.repartition(7)):
        got = Counter((r.record_id, r.at, r.response_id, r.resolution, r.body) for r in revisits.resolve(given).collect())
        assert got == Counter([
            ("v", 15, "s", "resolved", "one"), ("v", 25, "s", "resolved", "two"), ("v", 35, None, "resolved", "three"),
            (None, 26, "s", "resolved", "two"), ("n", 36, None, "no_validator", None),
        ])


def test_shards_of_repeated_rows_stay_gapless_when_the_input_is_dealt_anew(spark):
    rows = spark.range(4000).selectExpr("cast(if(id % 3 = 0, 5, id) AS long) AS doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) AS text", "id AS other")
    dealt = rows.repartition(9).filter("other >= 0")  # round robin: rows stand elsewhere in every run
    got = sharding.assign_shards(dealt, 8, most_equal=100).collect()
    check_shards(got, 8)
    assert sorted(r.row_number for r in got) == list(range(4000)) and len({r.other for r in got}) == 4000


def test_shards_take_columns_that_have_no_hash(spark):
    docs = spark.createDataFrame([(1, "a", {"k": "v"}, [{"m": 1}]), (1, "a", {"k": "w"}, [{}]), (2, None, None, None)], "doc_id long, text string, tags map<string,string>, more array<map<string,int>>")
    got = sharding.assign_shards(docs, 2)
    check_shards(got.collect(), 2)
    assert got.columns[:4] == docs.columns


def test_prefixes_grow_with_the_table():
    assert [sharding._digits(n) for n in (1, 10**9, 10**10, 10**11, 10**13)] == [3, 3, 4, 5, 5]


def test_items_without_ids_and_with_shared_ones(spark):
    """Also items of many lengths in one scan."""
    items = [(None, prose(1, 20)), (None, prose(2, 20)), (3, prose(3, 30)), (3, prose(4, 30)), (5, "just three words"), (6, "two words"), (7, prose(5, 12)), (8, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"{prose(1, 20)} {prose(9, 5)}", f"{prose(2, 20)} {prose(1, 20)}", f"{prose(3, 30)} and {prose(4, 30)}", f"just three words, two words and {prose(5, 12)}", prose(11, 60), "two", None]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(1, texts[1], "en", "a", 0)], DOCS)
    for r in decontamination.contamination(docs, benchmark).collect():
        n_words, n_hit, found, contaminated = brute_contamination(r.text, items)
        assert (r.n_words, r.n_hit, r.contaminated) == (n_words, n_hit, contaminated)
        assert sorted(map(str, r["items"])) == found


def test_only_a_local_session_makes_its_own_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def plain_features(text, bits=20):
    """Feature -> count, one token at a time."""
    mask, multiply, second = 2**64 - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    codes = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    out = Counter(((c * multiply) & mask) >> (64 - bits) for c in codes)
    out.update(((a * multiply + b * second + 1) & mask) >> (64 - bits) for a, b in zip(codes, codes[1:]))
    for step in (1, 2):
        out.update(((step * 0xD6E8FEB86659FD93) & mask) >> (64 - bits) for a, b in zip(codes, codes[step:]) if a == b)
    return out


def test_classifier_agrees_with_a_plain_loop(spark, sf_dir):
    """Training order (hash of id and text), update by update, and every score."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    order = docs.join(labels.select("doc_id", "quality"), "doc_id").selectExpr("*", "xxhash64(doc_id, text) AS h").orderBy("h").collect()
    taught = [r for r in order if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= 0.02 else (math.copysign(0.02, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / 0.3 + 0.01)
    for _ in range(3):
        for r in taught:
            counts = plain_features(r.text)
            root = max(1.0, math.sqrt(sum(counts.values())))
            x = {i: float(np.float32(k / root)) for i, k in counts.items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - r.quality) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * w[i]
                n[i] += g * g
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()}
    for r in docs.collect():
        counts = plain_features(r.text)
        total = sum(weight(i) * k for i, k in counts.items()) / max(1.0, math.sqrt(sum(counts.values()))) + weight("bias")
        assert abs(scores[r.doc_id] - 1 / (1 + math.exp(-total))) < 1e-4


def test_forest_and_threshold_agree_with_plain_loops(spark, sf_dir):
    stats = quality_rules.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    labels = table(spark, sf_dir, "labels")
    model = quality_rules.fit(stats, labels)
    forest, rows = model.forest, quality_rules.judge(stats, model).collect()

    def mean_path(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def plain_score(r):
        words, chars = max(1, r.n_words), max(1, r.word_chars)
        row = [r.n_symbols / chars, r.n_symbols / words, r.n_bare_words / words, r.n_repeat_words / words, chars / words]
        total = 0.0
        for feature, split, path in zip(forest.feature, forest.split, forest.path):
            k = 0
            while not math.isinf(split[k]):
                k = 2 * k + (2 if row[feature[k]] >= split[k] else 1)
            total += path[k]
        return 2 ** (-total / len(forest.path) / mean_path(forest.sample))

    for r in rows:
        assert abs(r.anomaly - plain_score(r)) < 1e-9 and r.kept == (not r.base_failed and r.anomaly <= model.threshold)
    # Every leaf's path is its depth and the mean path below it, of rows that its tree was given.
    assert all(0 < p <= quality_rules.DEPTH + mean_path(forest.sample) for tree, cut in zip(forest.path, forest.split) for p, s in zip(tree, cut) if p)
    label = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    taught = [(math.ceil(r.anomaly * 1000), label[r.doc_id]) for r in rows if r.doc_id in label and not r.base_failed]
    n_good = sum(y == 1 for _, y in taught)
    wrong = {}
    for cut in range(1001):
        lost, missed = sum(b > cut and y == 1 for b, y in taught), sum(b <= cut and y == 0 for b, y in taught)
        if lost <= 0.01 * n_good:
            wrong[cut] = lost + missed
    least = [cut for cut, k in wrong.items() if k == min(wrong.values())]
    if not any(y == 0 for _, y in taught):
        least = [min(wrong)]
    assert model.threshold == least[len(least) // 2] / 1000
