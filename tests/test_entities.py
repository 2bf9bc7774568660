"""Entity tagging against a plain walk over the words, and the work it does."""

import random
import re

import pytest

from marketlens.operators import leads


def plain_tags(text, names):
    """Names of a text, the longest first, then the first; ``names`` maps words to labels."""
    words = re.findall(r"\w+", text or "")
    spans = sorted(
        (-n, i) for i in range(len(words)) for n in range(1, len(words) - i + 1) if tuple(words[i : i + n]) in names
    )
    taken, kept = set(), []
    for less, i in spans:
        places = set(range(i, i - less))
        if not places & taken:
            taken |= places
            kept += [(i, " ".join(words[i : i - less]), label) for label in names[tuple(words[i : i - less])]]
    return sorted(kept)


@pytest.mark.parametrize("first_words", [leads.FIRST_WORDS, 0])
def test_names_of_any_length_and_overlap(spark, first_words):
    rng = random.Random(5)
    names = {}
    for _ in range(60):
        name = tuple(rng.choices("abcdefg", k=rng.choice([1, 2, 2, 3, 5, 9])))
        names.setdefault(name, set()).add(rng.choice(["PERSON", "ORG", "GPE", "TITLE"]))
    texts = [" ".join(rng.choices("abcdefgxyz", k=rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "--", "a, b; c", " ".join("ab" * 100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    surfaces = [(" ".join(n), label) for n, labels in names.items() for label in labels]
    words = spark.createDataFrame(surfaces + [("--", "ORG"), (None, "ORG"), surfaces[0]], "surface string, label string")
    got = {r["id"]: r for r in leads.tag_entities(rows, "t", words, "id", first_words=first_words).collect()}
    for i, t in enumerate(texts):
        want = plain_tags(t, names)
        if not want:
            assert i not in got
            continue
        for column, label in (("persons", "PERSON"), ("organizations", "ORG"), ("locations", "GPE")):
            assert got[i][column] == [s for _, s, x in want if x == label], (i, column)
        assert [(m["text"], m["label"]) for m in got[i]["misc"]] == [(s, x) for _, s, x in want if x == "TITLE"]


def test_a_long_name_costs_nothing_where_it_does_not_begin(spark):
    rows = spark.createDataFrame([(1, " ".join(["red", "fox"] * 200))], "id long, t string")

    def spans(*names):
        words = spark.createDataFrame([(n.split(),) for n in names], "_t array<string>")
        return leads.name_candidates(rows, "t", words, "id").count()

    assert spans("red fox") == 200
    assert spans("red fox", " ".join(["blue"] * 500)) == 200
    assert spans("red fox", "red " + " ".join(["blue"] * 30)) == 200 + 185


def test_many_names_in_one_text(spark):
    rows = spark.createDataFrame([(1, " ".join(f"w{i} x" for i in range(20_000)))], "id long, t string")
    words = spark.createDataFrame([(f"w{i}", "ORG") for i in range(0, 20_000, 2)], "surface string, label string")
    got = leads.tag_entities(rows, "t", words, "id").first()
    assert got["organizations"] == [f"w{i}" for i in range(0, 20_000, 2)]


def test_no_names_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a b")], "id long, t string")
    words = spark.createDataFrame([("a", "ORG")], "surface string, label string")
    assert leads.tag_entities(rows, "t", words.limit(0), "id").count() == 0
    assert leads.tag_entities(rows.limit(0), "t", words, "id").count() == 0
