"""Resampling, decontamination and spelling variants against brute force, with the awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import decontamination, resampling, spelling
from marketlens.llm.automaton import SuffixAutomaton

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"
ITEM = " ".join(f"q{i}" for i in range(25))
TEXTS = [
    (1, "Start " + ITEM + " end"), (2, "a-b c"), (3, None), (4, ""), (5, " \n\x00--"), (6, "Ünï q3 q4 q5\x00q6 q7 q8 q9 q10 q11 q12 ünï " + "long " * 20_000),
    (7, "short One"), (8, "it is a SHORT one, q0 q1 q2"), (9, " ".join(f"w{i % 7}" for i in range(40))), (9, " ".join(f"w{i % 7}" for i in range(40))),
    (None, ITEM.upper() + " " + ITEM), (10, " ".join(f"q{i}" for i in range(40))),
]
ITEMS = [(100, ITEM), (100, ITEM), (20, "Short one"), (3, None), (4, ""), (5, "q5 q6 q7 q8 q9 q10 q11 q12 q13 q14"), (None, "w1 w2 w3"), (7, "nowhere at all"), (20, "w6 w0 w1 w2 w3 w4 w5 w6 w0 w1 w2")]


def words(text):
    return ALNUM.findall((text or "").encode().lower().decode())


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, SCHEMA)
    for name in ("row", "n", "version", "n_words", "buckets", "counts", "spans", "items", "rank", "word", "fit"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("row", F.lit(1)).withColumn("words", F.lit(2))


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2])
def test_resampling(docs, items, n):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 97
    source, target = (Counter(bucket(f) for _, t in table for f in features(t)) for table in (TEXTS, ITEMS))
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (source.total() + 97) / ((source[b] + 1) * (target.total() + 97))))
    want = [(i, len(words(t)), len(features(t)), sum(gain(bucket(f)) for f in features(t))) for i, t in TEXTS]
    got = resampling.weigh(docs, items, n=n, buckets=97)
    assert rows(got, "doc_id", "n_words", "n_features", "weight") == sorted(want, key=str)


def test_draw_ranks_as_one_sort_would(spark):
    import hashlib

    random.seed(4)
    weighed = [(random.choice([None, *range(200)]), k, random.randrange(15, 40), 9, random.randrange(-3000, 3000)) for k in range(900)]
    weighed += [(7, 1, 30, 9, 0)] * 300  # rows equal in all that orders them
    table = spark.createDataFrame(weighed, "doc_id long, version long, n_words long, n_features long, weight long")

    def score(doc_id, weight):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        return weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    fit = sorted(((-score(r[0], r[4]), math.inf if r[0] is None else r[0]) for r in weighed if r[2] >= 20))
    taken = 30 * len(fit) // 100
    drawn = resampling.draw(table, percent=30).where("rank is not null").orderBy("rank").collect()
    assert [(-r["score"], math.inf if r["doc_id"] is None else r["doc_id"]) for r in drawn] == fit[:taken]
    assert [r["rank"] for r in drawn] == list(range(1, taken + 1))
    assert resampling.draw(table, percent=30).count() == len(weighed)


def test_resample_returns_documents(docs, items, spark):
    drawn = resampling.resample(docs, items, percent=50)
    assert drawn.columns == docs.columns and drawn.count() == 3  # six have 20 words or more
    assert resampling.resample(docs.where("false"), items).count() == 0
    assert resampling.weigh(docs, items.where("false")).count() == len(TEXTS)
    assert resampling.draw(resampling.weigh(docs.where("false"), items.where("false"))).count() == 0


def leaks(text, window=10):
    w, hit, met = words(text), set(), set()
    for name, item in ITEMS:
        x = words(item)
        k = min(len(x), window)
        grams = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else set()
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in grams:
                hit |= set(range(p, p + k))
                met.add("" if name is None else str(name))
    return len(w), len(hit), sorted(met)


@pytest.mark.parametrize("shard_words", [200_000, 13])
def test_leaks(docs, items, shard_words):
    found = decontamination.find_leaks(docs, items, shard_words=shard_words)
    got = rows(found, "row.doc_id", "n_words", decontamination.hit_words(), "items")
    assert got == sorted([(i, *leaks(t)) for i, t in TEXTS], key=str)
    longest = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.select("row.doc_id", "spans").collect()}
    if shard_words > 100:
        assert longest[1] == [(1, 26, 25)] and longest[8] == [(3, 5, 2)]


def test_decontaminate(docs, items):
    clean = decontamination.decontaminate(docs, items)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(texts) == {2, 3, 4, 5, 6, 8} and texts[3] is None and texts[2] == "a-b c"
    assert texts[8] == "it is a , q0 q1 q2"
    kept = decontamination.decontaminate(docs, items, most_words=2, most_coverage=1.0)
    assert kept.count() == len(TEXTS) and {r["text"] for r in kept.where("doc_id = 8").collect()} == {TEXTS[7][1]}
    assert decontamination.decontaminate(docs.where("false"), items).count() == 0
    assert rows(decontamination.decontaminate(docs, items.where("false")), "doc_id", "text") == rows(docs, "doc_id", "text")


def test_automaton_finds_every_window():
    random.seed(1)
    for _ in range(300):
        letters, window = random.choice([1, 2, 3, 5]), random.choice([1, 2, 3, 4])
        items = [[random.randrange(letters) for _ in range(random.randrange(9))] for _ in range(random.randrange(1, 6))]
        text = [random.randrange(letters + 1) for _ in range(30)]  # the last number is no item's word
        hit, met, ends = set(), set(), set()
        for item, x in enumerate(items):
            k = min(len(x), window)
            for p in range(len(text) - k + 1 if k else 0):
                if any(text[p : p + k] == x[i : i + k] for i in range(len(x) - k + 1)):
                    hit |= set(range(p, p + k))
                    met.add(item)
                    ends.add(p + k)
        held = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        longest = max((e - p for e in ends for p in range(e) if tuple(text[p:e]) in held), default=0)
        automaton = SuffixAutomaton(window).build(items)
        places = np.array([p for p, w in enumerate(text) if w < letters], np.int64)
        spans = automaton.match(places, np.array(text, np.int64)[places])
        assert {p for s in spans for p in range(s[0], s[1])} == hit and sum(s[1] - s[0] for s in spans) == len(hit)
        assert {i for s in spans for i in automaton.items_of(s[3])} == met
        assert max((s[2] for s in spans), default=0) == longest
        assert automaton.shortest() == min((min(len(x), window) for x in items if x), default=1 << 60)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=5):
    out, forms = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = len(others)
    rows = []
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, counts[w], out[w], counts.get(forms[w])))
    return sorted(rows, key=str)


@pytest.mark.parametrize("part_letters", [40_000, 30])
def test_spelling_variants(spark, monkeypatch, part_letters):
    monkeypatch.setattr(spelling, "PART_LETTERS", part_letters)
    random.seed(2)
    counts = {"ÿ×÷": 9, "x" * 3000: 40, "x" * 3001: 8, "x" * 2999 + "y": 8, "a": 700, "": 3}
    while len(counts) < 260:
        counts["".join(random.choice("abcé") for _ in range(random.randrange(2, 7)))] = random.choice([1, 2, 7, 30, 60, 300])
    counts.pop("")
    table = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("c0", F.lit(1)).withColumn("side", F.lit(2))
    got = spelling.spelling_variants(table)
    assert rows(got, "word", "form", "root", "n", "n_near", "form_n") == variants(counts)
    assert spelling.spelling_variants(table.where("false")).count() == 0


def test_vocabulary(docs, spark):
    runs = re.compile(r"[A-Za-zÀ-ÿ]+")
    texts = [(i, f"Maßstab ÀPFEL Äpfel {t or ''} wordword wordwords WORDWORD") for i, t in TEXTS] + [(1, None)]
    want = Counter()
    for i, t in texts:
        for w in runs.findall(t or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 4 and n >= 2}
    got = {r["word"]: r["n"] for r in spelling.vocabulary(spark.createDataFrame(texts, SCHEMA), least=4, min_count=2, slip=3).collect()}
    assert got == want
    assert spelling.spelling_variants(spelling.vocabulary(docs.where("false"))).count() == 0


def test_close_pairs_and_edits():
    random.seed(3)
    for _ in range(100):
        short = random.randrange(1, 6)
        one, two = (sorted({"".join(random.choice("abÿ") for _ in range(size)) for _ in range(12)}) for size in (short, short + random.randrange(2)))
        codes = spelling._codes(one), spelling._codes(two)
        found = {(i, j) for x, y in spelling.close_pairs(*codes) for i, j in zip(x.tolist(), y.tolist())}
        far = lambda a, b: sum((a.count(c) - b.count(c)) ** 2 for c in "abÿ")
        assert found == {(i, j) for i, a in enumerate(one) for j, b in enumerate(two) if far(a, b) <= 2}
        i, j = (np.array(v, int) for v in zip(*found, strict=True)) if found else (np.empty(0, int),) * 2
        assert [near(one[a], two[b]) for a, b in zip(i, j)] == spelling.one_edit(codes[0][i], codes[1][j]).tolist()
