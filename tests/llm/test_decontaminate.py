from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendwell.llm import decontaminate
from mendwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
ITEM = "A train leaves Berlin with 120 passengers and at the next stop Anna and 15 others get off, so how many passengers stay after 3 hours?"


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "Yes."), (3, None), (4, ""), (5, "Name the capital city of the country")], "item_id long, text string")


def held(docs, items, **options):
    return {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.n_changed) for r in decontaminate.contaminations(docs, items, **options).collect()}


def test_query_equals_brute_force(spark):
    """The items have no numbers or names, so templates are plain words; containment is counted directly."""
    word = lambda t: [w.strip(decontaminate.EDGES).lower() for w in (t or "").split()]
    index, sizes = {}, {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = word(r.text)
        sizes[r.item_id] = len(own) - 4
        for k in range(len(own) - 4):
            index.setdefault(tuple(own[k : k + 5]), set()).add((r.item_id, k))
    expected = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        own, found = word(r.text), {}
        for k in range(len(own) - 4):
            for item, at in index.get(tuple(own[k : k + 5]), ()):
                found.setdefault(item, set()).add(at)
        expected |= {(r.doc_id, i): len(at) / sizes[i] for i, at in found.items() if len(at) >= 0.8 * sizes[i]}
    found = {(r.doc_id, r.item_id): r.contained for r in QUERIES["op2_decontaminate"](spark, SF).collect()}
    assert len(expected) > 200 and found == pytest.approx(expected)


def test_other_numbers_names_and_units(make_docs, items):
    changed = ITEM.replace("120", "3,450").replace("15", "7.5").replace("Berlin", "Oslo").replace("Anna", "Bob").replace("hours", "minutes")
    rows = [
        (1, ITEM), (2, "Before it. " + ITEM + " Then more words follow."), (3, ITEM.lower()), (4, ITEM.upper()), (5, changed),
        (6, "some words before " + changed.replace("passengers and", "passengers and")), (7, ITEM.replace("stay", "remain").replace("leaves", "departs").replace("next", "last")),
        (8, "A train left with nobody. " * 20), (9, None), (10, ""), (11, "x " * 50_000 + ITEM),
    ]
    found = held(make_docs(rows), items)
    assert {d for d, i in found if i == 1} == {1, 2, 3, 4, 5, 6, 11}
    assert found[1, 1][2] == 0 and found[5, 1][2] == 5


def test_slots_must_be_consistent(make_docs, spark):
    text = "Tom gave Eva 3 apples and then Tom asked Eva for 3 pears while Tom and Eva walked home with 3 bags of fruit"
    items = spark.createDataFrame([(1, "So " + text)], "item_id long, text string")
    fine = "So " + text.replace("Tom", "Max").replace("Eva", "Lea").replace("3", "8")
    torn = "So Max gave Lea 8 apples and then Tim asked Ida for 9 pears while Jon and Ulf walked home with 4 bags of fruit"
    assert set(held(make_docs([(1, fine), (2, torn)]), items)) == {(1, 1)}


def test_short_items_match_whole_documents_only(make_docs, items):
    assert set(held(make_docs([(1, "yes"), (2, "Yes, of course it is so"), (3, "Name the capital city of the country!")]), items)) == {(1, 2), (3, 5)}


def test_the_filter_changes_nothing(make_docs, items, monkeypatch):
    docs = make_docs([(k, f"Filler {k} words. {ITEM if k % 7 == 0 else ITEM[:40]} and more") for k in range(60)])
    with_filter = held(docs, items)
    monkeypatch.setattr(decontaminate, "window_filter", lambda windows: None)
    assert held(docs, items) == with_filter and len(with_filter) == 9


def test_repeated_rows_ids_and_clashing_columns(make_docs, items):
    docs = make_docs([(1, ITEM), (1, ITEM), (1, "clean text of some words"), (None, ITEM), (None, "one clean text"), (None, None), (2, "clean text of some words")])
    docs = docs.withColumn("item_id", F.lit(9)).withColumn("hash", F.lit(9))
    assert set(held(docs, items)) == {(1, 1), (None, 1)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    # Clean rows stay, whatever other rows of their id hold.
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(
        map(str, [(1, "clean text of some words"), (None, "one clean text"), (None, None), (2, "clean text of some words")])
    )


def test_nothing(make_docs, items, spark):
    assert held(make_docs([]), items) == {}
    assert held(make_docs([(1, ITEM)]), items.limit(0)) == {}
    assert decontaminate.clean(make_docs([(1, ITEM)]), items.limit(0)).count() == 1


@pytest.mark.parametrize(("raw", "kind"), [("12", 1), ("$5.50", 1), ("30%", 1), ("3kg", 1), ("km", 1), ("Anna's", 2), ("ANNA", 0), ("word", 0), ("3x", 0), ("m", 0), ("1/2", 1), ("...", 0)])
def test_kinds(raw, kind):
    assert decontaminate.Words.of(raw)[2] == kind


def test_words_beyond_the_table_are_the_same():
    text = "One two 3 Four. Five six two one Seven 8kg. " * 3
    few, many = decontaminate.Words(2), decontaminate.Words(100)
    for _ in range(2):
        for a, b in zip(*(w.windows(text.split(), np.array([0]), 5)[:3] for w in (few, many)), strict=True):
            assert a.tolist() == b.tolist()


def test_texts_hashed_together_are_those_hashed_alone():
    words = decontaminate.Words()
    texts = ["One 2. Three Four 5 kg", None, "a", "", "Ann. Bob saw. Cid 3", "x y", "Tom has 3 apples. Tom gives 2 to Eva.", "z " * 50, "One 2"]
    together = list(decontaminate._rows_of(words, texts, 5))
    alone = [(k, *row) for k, text in enumerate(texts) for row in decontaminate._rows(words, text, 5)]
    assert sorted(together, key=str) == sorted(alone, key=str) and {k for k, *_ in together} == {0, 2, 4, 5, 6, 7, 8}


RENAMED = "Tom has 3 apples. Tom gives 2 to Eva. How many apples does Tom have now?"


def test_names_that_open_sentences(make_docs, spark):
    items = spark.createDataFrame([(1, RENAMED)], "item_id long, text string")
    fine = RENAMED.replace("Tom", "Max").replace("Eva", "Lea").replace("3", "8").replace("2", "5")
    torn = "Max has 8 apples. Tim gives 5 to Lea. How many apples does Jon have now?"
    rows = [(1, RENAMED), (2, fine), (3, "Words before it, " + fine + " And after."), (4, RENAMED.lower()), (5, torn), (6, "So " + fine.replace(". How", "; how"))]
    found = held(make_docs(rows), items)
    assert found == {(1, 1): (12, 12, 0), (2, 1): (12, 12, 6), (3, 1): (12, 12, 6), (4, 1): (12, 12, 0), (6, 1): (12, 12, 6)}
    assert [r.doc_id for r in decontaminate.clean(make_docs(rows), items).collect()] == [5]


def test_openers_that_are_no_names(make_docs, spark):
    """An opener equal to a name decides nothing where that name stands inside sentences."""
    text = "Will anyone tell how old is Will if he is twice as old as Will was 4 years ago?"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    renamed = text[:5] + text[5:].replace("Will", "Ben").replace("4", "6")
    found = held(make_docs([(1, renamed), (2, renamed.replace("Will anyone", "Can anyone"))]), items)
    assert found == {(1, 1): (15, 15, 3), (2, 1): (14, 15, 4)}


@pytest.mark.parametrize("text", ["Ann. Bob. Cid. Dan. Eve. Flo.", "Ann ran. Bob saw 3 of them. Cid. Dan", "Ann. Bob"])
def test_all_readings_of_openers(text):
    """Each choice of openers as names has the hash of the text in which those words stand inside sentences."""
    words, found = decontaminate.Words(100), set()
    for at, _, slots, opens in decontaminate._rows(words, text, 5):
        found.add((at, tuple(slots), tuple(opens)))
    raw, expected = text.split(), set()
    size = min(5, len(raw))
    begins = [k == 0 or raw[k - 1].endswith(".") for k in range(len(raw))]
    for at in range(len(raw) - size + 1):
        openers = [k for k in range(size) if begins[at + k] and raw[at + k][0].isupper()]
        for bits in range(1 << len(openers)):
            names = {k for n, k in enumerate(openers) if bits >> n & 1}
            taken = [raw[at + k].strip(".").lower() if k in names or raw[at + k] == "3" else None for k in range(size)]
            expected.add((at, tuple(taken), tuple(k in names for k in range(size))))
    assert {row for row in found if any(row[2]) or any(row[1])} == {row for row in expected if any(row[2]) or any(row[1])}
