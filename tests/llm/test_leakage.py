import random

import pytest
from pyspark.sql import functions as F

from lorekiln.llm import leakage as lk


def grams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def normal(text):
    return [lk.plain(w) for w in lk.TOKEN.findall(text or "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc long, body string").withColumns({"id": F.lit("clash"), "text": F.lit("t"), "spans": F.lit(1), "cuts": F.lit(2)})


def material(seed):
    r = random.Random(seed)
    words = ["alpha", "Béta", "gamma", "đelta", "eps", "zeta", "7"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 14)))) for i in range(30)] + [(99, None), (98, ""), (3, "alpha beta gamma delta eps")]
    docs = [(i, " — ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (5, "**Alpha** _beta_, GAMMA:\n> delta! eps zeta")]
    return items, docs


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block_words", [500_000, 40])
def test_hits_equal_shared_grams(spark, seed, block_words):
    items, docs = material(seed)
    want = {(str(d), str(i)) for d, t in docs for i, s in items if grams(normal(t), 4) & grams(normal(s), 4)}
    found = lk.leaked_spans(frame(spark, docs), "doc", "body", frame(spark, items), "doc", "body", least=4, block_words=block_words).collect()
    assert {(r["id"], r["item_id"]) for r in found} == want and len(want) > 20
    for r in found:
        stated = set().union(*(grams(normal(s), 4) for i, s in items if str(i) == r["item_id"]))
        got = {p for a, b in r["spans"] for p in range(a, b + 1)}
        texts = [normal(t) for d, t in docs if str(d) == r["id"]]
        assert block_words == 40 or any(got == {p for i in range(len(t) - 3) if tuple(t[i : i + 4]) in stated for p in range(i, i + 4)} for t in texts)


def test_accents_and_marks_are_ignored(spark):
    item = "Người học cần nêu được bộ nhớ đệm đã khóa của máy chủ"
    decomposed = __import__("unicodedata").normalize("NFD", item.upper())
    docs = [(1, f"> x {decomposed} y"), (2, "Nguoi hoc can neu duoc bo nho\n\ndem da khoa cua may chu"), (3, item[: len(item) // 2])]
    found = lk.leaked_spans(frame(spark, docs), "doc", "body", frame(spark, [(7, item)]), "doc", "body").collect()
    assert {(r["id"], r["longest"]) for r in found} == {("1", 13), ("2", 13)}


def test_cleaning(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"Before it. {item}! After " + "z " * 40), (2, item), (3, "clean"), (4, None), (1, f"Before it. {item}! After " + "z " * 40)]
    found = lk.leaked_spans(frame(spark, docs), "doc", "body", frame(spark, [(7, item), (7, item)]), "doc", "body")
    got = sorted(map(tuple, lk.decontaminated(frame(spark, docs), "doc", "body", found).collect()), key=str)
    assert got == sorted([("1", "Before it. ! After " + "z " * 40, 20, False)] * 2 + [("2", None, 20, True), ("3", "clean", 0, False), ("4", None, 0, False)], key=str)


def test_empty_sides(spark):
    one, none = frame(spark, [(1, "a b c d e")]), frame(spark, [])
    for docs, items in ((one, none), (none, one), (none, none)):
        assert lk.leaked_spans(docs, "doc", "body", items, "doc", "body", least=2).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"v{i}" for i in range(100_000))
    found = lk.leaked_spans(frame(spark, [(1, long)]), "doc", "body", frame(spark, [(2, long)]), "doc", "body").first()
    assert found["longest"] == 100_000 and found["spans"] == [[0, 99_999]]


@pytest.mark.parametrize("block_words", [500_000, 30])
def test_cleaning_in_one_scan_is_the_same(spark, block_words):
    item = " ".join(f"w{i}" for i in range(20))
    other = " ".join(f"v{i}" for i in range(30))
    docs = [(1, f"Before it. {item}! After {other}; " + "z " * 80), (2, item), (3, "clean"), (4, None), (5, ""), (1, f"{item}! After " + "z " * 40)]
    items = frame(spark, [(7, item), (7, item), (8, other)])
    got = lk.cleaned_texts(frame(spark, docs), "doc", "body", items, "doc", "body", block_words=block_words).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("1", "Before it. ! After ; " + "z " * 80, 50, False), ("2", None, 20, True), ("3", "clean", 0, False), ("4", None, 0, False), ("5", "", 0, False), ("1", "! After " + "z " * 40, 20, False)], key=str
    )
