import json

import pytest

from textloom.llm import mojibake as M

CLEAN = ["The café served crème brûlée", "বাংলা ভাষার একটি বাক্য", "தமிழ் மொழி நூல்", "Ka tûhlâlin fîlângêm", "naïve façade “quoted” don’t", "日本語の文章です。"]


@pytest.mark.parametrize("chain", M.CHAINS)
def test_every_chain_is_undone(spark, chain):
    garbled = [M.garble(t, chain) if not t.isascii() else t for t in CLEAN]
    rows = [(k, t, t) for k, t in enumerate(CLEAN, 1)] + [(k, t, None) for k, t in enumerate(garbled, 101)] + [(200, None, None), (201, "", ""), (202, "plain text", "plain text")]
    df = spark.createDataFrame(rows, "record long, text string, raw string")
    assert {r.record for r in M.affected(df).collect()} == {101 + k for k in range(len(CLEAN))}
    if chain == ("cp1252",):
        fixed = {r.record: r.restored for r in M.restored(df).collect()}
        assert [fixed[101 + k] for k in range(len(CLEAN))] == CLEAN


def test_meant_letters_and_replacements(spark):
    texts = ["Ãorin river", "São PÃO", "Âge d’or", "Привет мир", "a � b", "x Ã© y", "¥¥ 20 £5 ½", "„Hallo“ ‚so‘", "কথা�"]
    df = spark.createDataFrame(list(enumerate(texts)), "record long, text string")
    assert {r.record for r in M.affected(df).collect()} == {4, 5, 8}
    assert M.affected(df.limit(0)).count() == 0


def test_japanese_bytes(spark):
    clean = ["より、ザケユバコ", "東京のまちをあるく", "山へいく"]
    euc = clean[0].encode("euc_jp").decode("latin-1")
    shift = "".join(map(M.charset("cp1252").__getitem__, clean[1].encode("shift_jis")))
    rows = [*enumerate(clean), (11, f"12 {euc}"), (12, shift), (13, f"12 {M.charset('cp1252')[0x82]} 3 ƒ 4"), (14, "a ƒunction ‚so‘")]
    df = spark.createDataFrame([(k, t, None) for k, t in rows], "record long, text string, raw string")
    assert {r.record: (r.restored, r.complete) for r in M.restored(df).collect()} == {11: (f"12 {clean[0]}", True), 12: (clean[1], True)}


@pytest.mark.parametrize("word,page,read", [("Хорошее", "cp1251", "latin-1"), ("привет", "koi8-r", "latin-1"), ("café", "cp1252", "cp1251"), ("naïve", "mac_roman", "cp1252"), ("Ελληνικά", "iso8859-7", "cp1252")])
def test_legacy_bytes_in_another_encoding(spark, word, page, read):
    form = "".join(map(M.charset(read).__getitem__, word.encode(page)))
    df = spark.createDataFrame([(1, f"the word {word} here", None), (2, f"the word {form} here", None)], "record long, text string, raw string")
    assert [(r.record, r.restored, r.complete) for r in M.restored(df).collect()] == [(2, f"the word {word} here", True)]


def test_words_explain_before_characters(spark):
    word, once = "নদীর", "ভাষার"
    rows = [(1, word), (2, M.garble(word, ("cp1252",))), (3, M.garble(once, ("cp1252",))), (4, f"{once[:3]} {once[3:]}")]
    df = spark.createDataFrame(rows, "record long, text string")
    got = {r.run: (r.original, r.by) for r in M.garbled_runs(df).collect()}
    assert got == {rows[1][1]: (word, "words"), rows[2][1]: (once, "characters")}


def test_sequences_of_unknown_characters_are_no_evidence(spark):
    df = spark.createDataFrame([(1, "Рівне і Київ"), (2, "Ãl Âge")], "record long, text string")
    assert M.affected(df).count() == 0


def test_garbled_part_of_text_without_spaces(spark):
    left, right = "星黒が友い赤塩人ぬ", "山白目南白牛の、新大糸音までは"
    lossy = M.lossy("東京都に住む", "cp1252")
    rows = [(1, left + M.garble(right, ("cp1252",))), (2, M.garble(right, ("latin-1",)) + left), (3, left + "「" + M.garble("ラス", ("cp1251",)) + "」した"), (4, left + right), (5, "「…」と“言う”Привет"), (6, "নঙугд")]
    rows += [(7, left + lossy + "と"), (8, "「東京都に住む」")]
    df = spark.createDataFrame([(*r, None) for r in rows], "record long, text string, raw string")
    assert {r.record for r in M.affected(df).collect()} == {1, 2, 3, 7}
    fixed = {r.record: (r.restored, r.complete) for r in M.restored(df).collect()}
    assert fixed[1] == (left + right, True) and fixed[2] == (right + left, True) and fixed[3] == (left + "「ラス」した", True)


def test_originals_in_raw(spark):
    whole, lost = "ভাষার বাক্য ও অন্য", "ভাষ\ufffdর বাক্য ও অন\ufffdয"
    line = lambda text, field="body": json.dumps({"id": 1, field: text, "text": "aside"})
    rows = [(1, "j", lost, line(whole)), (2, "j", lost, line(lost)), (3, "j", lost, "{" + line(whole)), (4, "j", lost, line(whole, "other")), (5, "t", "{" + lost, "{" + whole)]
    rows += [(6, "t", lost, "x " + M.garble("তামিল", ("cp1252",)) + " �"), (7, "t", lost, "কথা " + M.garble("নদীর", ("cp1252",))), (8, "t", whole, whole), (9, "j", lost, None)]
    df = spark.createDataFrame(rows, "record long, input_path string, text string, raw string")
    inputs = spark.createDataFrame([("j", "jsonl", "body"), ("t", "txt", None)], "input_path string, input_format string, text_field string")
    got = {r.record: (r.restored, r.complete) for r in M.restored(df, inputs=inputs).collect()}
    assert got == {1: (whole, True), 5: ("{" + whole, True)} | {k: (lost, False) for k in (2, 3, 4, 6, 7, 9)}
    plain = {r.record: r.complete for r in M.restored(df).collect()}
    assert not plain[1] and not plain[7]
