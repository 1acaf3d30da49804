"""Operators 4, 6 and 8: against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tests.llm.conftest import DOCS, prose
from voxlake.llm import decontamination, line_dedup, near_dedup
from voxlake.llm.common import table
from voxlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bag(text):
    w = words(text)
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute_classes(texts: dict):
    """id -> least id of its class, from all pairs that share a shingle."""
    groups = defaultdict(list)
    for i, text in texts.items():
        groups[tuple(words(text))].append(i)
    bags = {key: bag(" ".join(key)) for key in groups}
    root = {key: key for key in groups}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holding = defaultdict(list)
    for key, own in bags.items():
        for shingle in own:
            holding[shingle].append(key)
    pairs = {(a, b) for keys in holding.values() for n, a in enumerate(keys) for b in keys[:n]}
    for a, b in pairs:
        if similarity(bags[a], bags[b]) >= 0.8:
            root[find(a)] = find(b)
    members = defaultdict(list)
    for key, ids in groups.items():
        members[find(key)] += ids
    return {i: min(ids) for ids in members.values() for i in ids}


def test_near_duplicates_agree_with_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op8_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(texts)
    sizes = Counter(r.class_id for r in rows)
    assert all(r.class_size == sizes[r.class_id] and r.is_first == (r.doc_id == r.class_id) for r in rows)


def test_crowded_buckets_lose_no_link(spark):
    """A hundred variants of one text, some only linked through others, next to texts that share most of their words but stay below the bound."""
    r = random.Random(5)
    base = prose(1, 120).split()
    texts = []
    for _ in range(100):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += texts[:10] + [prose(2, 90)] * 40
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x.class_id for x in near_dedup.classes(docs).collect()}
    assert got == brute_classes(dict(enumerate(texts)))


def test_signatures_estimate_the_weighted_similarity():
    """Registers agree about as often as the multisets overlap; repeated shingles count by their weight."""
    texts = [prose(1, 300), " ".join(prose(1, 300).split()[:250] + prose(2, 60).split()), prose(1, 40) + " " + prose(3, 20) * 3]
    pairs = [(0, 1), (2, 2)]
    best = near_dedup.registers(*near_dedup.shingles([words(t) for t in texts]), len(texts))
    for a, b in pairs:
        agree = (best[a] == best[b]).mean()
        assert abs(agree - similarity(bag(texts[a]), bag(texts[b]))) < 0.15
    heavy, light = "p q r s t u v " * 40, "p q r s t u v " * 10
    best = near_dedup.registers(*near_dedup.shingles([words(heavy), words(light)]), 2)
    assert abs((best[0] == best[1]).mean() - similarity(bag(heavy), bag(light))) < 0.15


def test_near_dedup_on_edge_rows(spark, edge_docs, no_docs):
    rows = near_dedup.classes(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert of[1].class_id == of[2].class_id == of[3].class_id == 1 and of[4].class_id == of[5].class_id == 4
    kept = near_dedup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=lambda x: (x is not None, x)) == [None, 1, 4, 6, 7, 8, 9]
    assert near_dedup.classes(no_docs).count() == 0 and near_dedup.keep_one(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    names = [bytes([i // 256, i % 256]) for i in range(300)]
    random.Random(3).shuffle(names)
    edges = spark.createDataFrame(list(zip(names[1:], names[:-1], strict=True)), "a binary, b binary")
    rows = near_dedup.components(edges).collect()
    assert len(rows) == 300 and {bytes(r.root) for r in rows} == {min(names)}


def brute_contamination(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, body in items:
        t = words(body)
        n = min(13, len(t))
        grams = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} if t else set()
        for i in range(len(w) - n + 1) if grams else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination_agrees_with_brute_force(spark, edge_docs, no_docs):
    item = prose(7, 40)
    items = [(1, item), (2, "same text"), (3, None), (4, ""), (5, "Same TEXT!"), (6, prose(8, 13)), (7, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    w = item.split()
    rows = [
        (1, prose(20, 300) + " " + " ".join(w[3:16]).upper() + ". " + prose(21, 10), "en", "a", 0), (2, " ".join(w[3:15]), "en", "a", 0),
        (3, "the same: text, and one more", "en", "a", 0), (4, item + "\n" + item, "en", "a", 0), (5, prose(8, 13) + " x", "en", "a", 0),
        (6, prose(23, 900) + " one", "en", "a", 0),
    ]
    docs = spark.createDataFrame(rows, DOCS).unionByName(edge_docs.select(*[c.split()[0] for c in DOCS.split(", ")]))
    for r in decontamination.contamination(docs, benchmark).collect():
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute_contamination(r.text, items)
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_hit
    full = decontamination.contamination(edge_docs, benchmark)
    assert full.count() == edge_docs.count()
    assert decontamination.contamination(no_docs, benchmark).count() == 0
    assert decontamination.contamination(edge_docs, benchmark.limit(0)).filter("contaminated").count() == 0
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    clean = [r for r in docs.collect() if not brute_contamination(r.text, items)[3]]
    assert Counter(kept.collect()) == Counter(clean)


def test_shuffled_window_set_finds_what_the_broadcast_one_does(spark, sf_dir, monkeypatch):
    want = Counter(QUERIES["op4_decontamination"](spark, sf_dir).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    moved, far = [], decontamination._far_hits
    monkeypatch.setattr(decontamination, "_far_hits", lambda docs, scanned, grams: (moved.append(scanned), far(docs, scanned, grams))[1])
    assert Counter(QUERIES["op4_decontamination"](spark, sf_dir).collect()) == want
    # What is shuffled for each window: no text, no words.
    assert [d.dtypes for d in moved] == [[("fp", "binary"), ("at", "int"), ("length", "int"), ("own_h", "bigint"), ("own_words", "bigint")]]


def test_spans_are_cut_out(spark):
    item = prose(7, 13)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before, {item}! after.", "en", "a", 0), (2, f"{item}", "en", "a", 0), (3, "clean", "en", "a", 0), (4, f"({item}) z", "en", "a", 0)], DOCS)
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, benchmark, remove="spans").collect()}
    assert cut == {1: "Before, ! after.", 2: "", 3: "clean", 4: "() z"}


def brute_lines(rows, count_copies=False):
    pages, holding = defaultdict(set), defaultdict(set)
    for i, r in enumerate(rows):
        page = i if count_copies else r.text or ""
        pages[r.source].add(page)
        for line in (r.text or "").split("\n"):
            if line.strip(" "):
                holding[r.source, line.strip(" ")].add(page)
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        is_gone = [bool(x.strip(" ")) and len(p := holding[r.source, x.strip(" ")]) >= 2 and len(p) > 0.05 * len(pages[r.source]) for x in lines]
        text = "\n".join(x for x, g in zip(lines, is_gone, strict=True) if not g) if any(is_gone) else r.text
        out.append((r.doc_id, text, sum(bool(x.strip(" ")) for x in lines), sum(is_gone)))
    return Counter(out)


def test_line_dedup_agrees_with_brute_force(spark, edge_docs, no_docs):
    furniture = ["Subscribe to our letter", "  Terms of use  ", "Home | News"]
    rows = []
    for i in range(60):
        body = [prose(i, 30), prose(i + 100, 20)] + ([prose(5, 12)] if i < 2 else [])
        source = "hot" if i < 50 else (None if i < 56 else "rare")
        head = furniture if i % 3 == 0 else furniture[:1] * 2
        rows.append((i, "\n".join([head[0], "", *body, *head[1:]]), "en", source, 0))
    rows += rows[:3] + [(200, furniture[0], "en", "hot", 0)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(edge_docs.select(*[c.split()[0] for c in DOCS.split(", ")]))
    got = line_dedup.dedup_lines(docs).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == brute_lines(docs.collect())
    assert any(r.n_dropped for r in got)
    assert {r.text for r in got if r.doc_id == 200} == {""}  # a page of nothing else goes too
    rows = line_dedup.dedup_lines(docs, count_copies=True).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows) == brute_lines(docs.collect(), count_copies=True)
    assert line_dedup.dedup_lines(edge_docs).count() == edge_docs.count() and line_dedup.dedup_lines(no_docs).count() == 0


def test_bands_find_pairs_at_the_bound():
    """Chance that a pair of similarity 0.8 shares no band."""
    assert (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS < 1e-5
    assert near_dedup.band_keys(np.zeros((2, near_dedup.REGISTERS))).shape == (2, near_dedup.BANDS)
