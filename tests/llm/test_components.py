"""Components of any shape, and near copies that form chains and crowds."""

import random
from collections import defaultdict

import pytest

from marketlens.llm import components as comp, jaccard

LINKS = "a long, b long"


def groups(pairs):
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    out = defaultdict(set)
    for x in up:
        out[top(x)].add(x)
    return sorted(map(sorted, out.values()))


def shuffled_path(n):
    order = list(range(n))
    random.Random(n).shuffle(order)
    return list(zip(order, order[1:]))


@pytest.mark.parametrize(
    "pairs",
    [
        shuffled_path(600), [(i, i + 1) for i in range(200)], [(300, i) for i in range(200)], [(-1, i) for i in range(200)],
        [(random.Random(7).randrange(900) + i % 3, random.Random(i).randrange(900)) for i in range(700)],
        [(1, 2), (2, 1), (1, 2), (5, 6), (6, 7), (7, 5)],
    ],
)
def test_components(spark, pairs, monkeypatch):
    rounds = []
    step = comp._roots
    monkeypatch.setattr(comp, "_roots", lambda edges: rounds.append(1) or step(edges))
    found = comp.components(spark.createDataFrame(pairs, LINKS)).collect()
    of = defaultdict(set)
    for r in found:
        of[r["label"]].add(r["node"])
    assert sorted(map(sorted, of.values())) == groups(pairs) and all(k in v for k, v in of.items())
    assert len(rounds) <= 12


def test_no_links(spark):
    assert comp.components(spark.createDataFrame([(1, 1)], LINKS)).count() == 0
    assert comp.components(spark.createDataFrame([], LINKS)).count() == 0


def test_chain_of_revisions_is_one_group(spark):
    """Each text is moved on by four words: neighbours share 73 of 81 shingles, the ends nothing."""
    rows = [(i, " ".join(f"w{j}" for j in range(4 * i, 4 * i + 80))) for i in range(450)]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 450 and {r["component_id"] for r in out} == {0}


def test_pairs_of_crowded_and_small_buckets(spark, monkeypatch):
    """Texts that meet in crowded buckets, small ones, and both, at every bound of a crowd."""
    rng = random.Random(11)
    base = [[f"b{k}_{i}" for i in range(60)] for k in range(3)]
    rows = []
    for i in range(90):
        words = base[i % 3][:]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = rng.choice([f"x{i}", "shared", f"y{i % 5}"])
        rows.append((i, " ".join(words[: rng.choice([60, 60, 55])])))
    rows += [(100 + i, rows[i][1]) for i in range(0, 90, 9)]
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a <= b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = {x: min(g) for g in groups(links) for x in g}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (3, 1000):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(table, n=4, percent=85).collect()} == want


def test_classes_of_a_crowd_that_cannot_link_are_not_listed(spark, monkeypatch):
    """Texts that differ too much by places of their own: their pairs are not handed on, their links are found."""
    from marketlens.llm import jaccard

    passage = [f"p{i}" for i in range(100)]
    # two words of each are its own; every fifth one has a near copy
    words = [passage[: k + 5] + [f"own{k}"] + passage[k + 6 : k + 50] + [f"mine{k}"] + passage[k + 51 :] for k in range(40)]
    words += [w[:-1] + [f"end{k}"] for k, w in enumerate(words) if k % 5 == 0]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    label = list(range(len(words)))
    for b in range(len(words)):
        for a in range(b):
            if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                label = [label[a] if x == label[b] else x for x in label]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "doc_id long, text string").repartition(4)
    counts, write = [], jaccard.materialise

    def materialise(df, name):
        out = write(df, name)
        if name == "jaccard-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", materialise)
    monkeypatch.setattr(jaccard, "CROWD", 4)
    monkeypatch.setattr(jaccard, "CROWD_ROUNDS", 0)
    if hasattr(jaccard, "CROWD_BLOCK"):
        monkeypatch.setattr(jaccard, "CROWD_BLOCK", 10)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) == 40
    # of 1,128 pairs, those of neighbours come close to a link
    assert counts[-1] <= 150
