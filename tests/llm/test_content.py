import random

from textloom.llm.pieces import content, words
from textloom.llm import content as C

LONG = "The quiet river bends around the old mill"


def table(spark, texts):
    rows = [(k, t, "x", k, "y") for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "record long, text string, first string, id long, hash string")  # names that the operator uses itself


def test_forms_of_one_content(spark):
    fields = "Name: The quiet river | Place: Around the mill | Note: Bends"
    texts = [
        LONG, LONG.upper() + "!!", "the quiet\triver, bends (around) the old mill", None, "", "short", "short", fields, "Note : bends\nplace: around the MILL\nName: the quiet river",
        "Ünïcode strasse text here for all", "Ünïcode STRASSE text here for ALL", LONG, LONG + " again",
    ]
    got = {(r.first_record, r.record) for r in C.copies(table(spark, texts)).collect()}
    assert got == {(1, 2), (1, 3), (1, 12), (8, 9), (10, 11)}
    counts = {r.first_record: r.copies for r in C.unique_records(table(spark, texts)).collect()}
    assert counts == {1: 4, 8: 2, 10: 2, 13: 1}


def test_empty_and_hot_groups(spark, monkeypatch):
    assert C.copies(table(spark, [])).count() == 0
    monkeypatch.setattr(C, "HOT_ROWS", 5)
    monkeypatch.setattr(C, "HOT_SHARE", 10)
    texts = [LONG] * 60 + [f"{LONG} {k // 2}" for k in range(40)]
    assert C.copies(table(spark, texts)).count() == 59 + 20


def test_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha beta gamma delta কথা বলা 12 x²".split()) for _ in range(9)) for _ in range(30)]
    texts = [rng.choice([str.upper, str.title, lambda s: s.replace(" ", "  "), lambda s: s + "."])(rng.choice(base)) for _ in range(300)]
    first = {}
    want = set()
    for k, t in enumerate(texts, 1):
        key = content(t)
        if len(key) >= 20:
            if key in first:
                want.add((first[key], k))
            first.setdefault(key, k)
    assert {(r.first_record, r.record) for r in C.copies(table(spark, texts)).collect()} == want


def test_words():
    assert words(" «Déjà» x² (12) — ½ 'কথা'। a-b ") == ["déjà", "x", "12", "কথা", "a-b"]


def test_length_counts_in_canonical_form(spark):
    short = "\u0958" * 12  # its composed form is excluded from composition: 24 letters and marks
    rows = [(1, short), (2, "\u0915\u093c" * 12), (3, "\u0958" * 9)]
    df = spark.createDataFrame(rows, "record long, text string")
    assert [(r.first_record, r.record) for r in C.copies(df).collect()] == [(1, 2)]
