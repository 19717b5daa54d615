import itertools

from textloom.llm import lookalike as L

SAME = ["The café paid “Momo” in Tokyo", "Тhе café рaіd “Мοmo” in Tokyo", "The café paid “Momo” in Tokyo", "The café paid “Momo” in Tokyo", "T​he ca­fé﻿ paid “Mo⁠mo” in Tokyo", "Ｔｈｅ ｃａｆé paid “Momo” in Tokyo"]
OTHER = ["The cafe paid “Momo” in Tokyo", "the café paid “Momo” in Tokyo", "The café  paid “Momo” in Tokyo", "The café paid “Momo” in Tokyo²", "The café paid “Momo” in Tokyo2"]


def test_pairs(spark):
    texts = [*SAME, *OTHER, SAME[0], None, "", " ", "​", " "]
    df = spark.createDataFrame([(k, t, 0, "f") for k, t in enumerate(texts)], "doc_id long, text string, id int, form string")
    alike = [*range(len(SAME)), len(SAME) + len(OTHER)]
    want = {(a, b) for a, b in itertools.combinations(alike, 2) if texts[a] != texts[b]}
    got = [(r.doc_a, r.doc_b) for r in L.same_looks(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    forms = {r.doc_id: r.form for r in L.forms(df).collect()}
    assert forms[1] == SAME[0] and forms[len(texts) - 5] is None
    assert L.same_looks(df.limit(0)).count() == 0


def test_tokens():
    assert L.consistent("раураl") == "paypal" and L.consistent("сосо") == "coco"  # mixed and wholly confusable
    assert L.consistent("река Тавра") == "река Тавра" and L.consistent("μέτρο") == "μέτρο"  # real words keep their script
    assert L.consistent("ｶﾞｷﾞ") == "ガギ" and L.consistent("か゚") == "か゚" and L.consistent("👩‍👧") == "👩‍👧"
    assert L.consistent(L.consistent("Тhе ｃａｆé")) == L.consistent("Тhе ｃａｆé")


def test_neighbours_choose_the_script():
    assert L.consistent("это сор и оса") == L.consistent("это cop и oca") == "это сор и оса"
    assert L.consistent("the сор ran") == L.consistent("the cop ran") == "the cop ran"
    assert L.consistent("ꓐꓡOCK ᎪᏞL") == L.consistent("BLOCK AᏞL") and L.consistent("ж w оса") == L.consistent("ж w oca")


def test_kana_and_han_that_look_alike(spark):
    assert L.consistent("ロボット") == L.consistent("口ボット") == "ロボット" and L.consistent("人口が") == L.consistent("人ロが") == "人口が"
    df = spark.createDataFrame([(1, "ロ口"), (2, "口口"), (3, "京へ"), (4, "京ヘ")], "doc_id long, text string")
    forms = {r.doc_id: r.form for r in L.forms(df).collect()}
    assert forms[1] == forms[2] and forms[3] == forms[4]
    assert {(r.doc_a, r.doc_b) for r in L.same_looks(df).collect()} == {(1, 2), (3, 4)}
