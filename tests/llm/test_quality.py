import pytest

from textloom.llm import quality as Q

PROSE = "The old mill by the river was sold last spring. Nobody knew why the miller had left, but the wheel kept turning! Was it the wind?"


@pytest.mark.parametrize(
    "text,kind",
    [
        (PROSE, None),
        (None, None),
        ("", None),
        ("short; list; of; items", None),
        ("• wool cloth\n• salt – 12\n• green coal\n• honey\n• a steep road", "list"),
        ("Stock: parcel basket; lifted valley; poster traded; ticket bell; old potter; bread", "list"),
        ("(a) Cloth letter wool (b) Tunnel (c) well orchard (d) Flute late hidden (e) bricks", "list"),
        ("| letter | map | ferry |\n| --- | --- | --- |\n| 46669 | 25863 | Filled |\n| 74126 | 36404 | private |", "table"),
        ("Coal,Farmer,weighed\nmill,2010-08-22,67376\nGlossary,2016-08-20,45767\ncensus,2011-01-02,555", "table"),
        ("a | 12 | x ; b\t13\ty ; c | 14 | z ; dd\t15\tw ; eee | 16 | v ; f\t17\tu", "table"),
        ("#[}{_\\= ?>]} }#}&@>==_ %^&_&%>| ]{#/%]$ <[=][% ~@!=<*!]", "junk"),
        ('<div class="a">&nbsp;</div> <td class="b">&nbsp;</td> <span class="c">&nbsp;</span>', "junk"),
        ("nNRM/G/7RC7OuQ9mvcp03CZfhdHIE8LJnCOwTBCPa6MZYxlBDvtXMxvhEu7x8x1w2BQcWKDP9yrVypx9V", "junk"),
        ("trzfxrjvg dptjfvbqzt jkrtwtz jdjw grdn cknxd cjcxnvhmq zbkxd pp lstsszj", "junk"),
        ("Title: The mill was sold again. | Place: It stood by the river. | Note: Nobody knew why it was.", None),
    ],
)
def test_kinds(text, kind):
    assert Q.kind_of(text) == kind


def test_statistics_and_wrong_values(spark):
    rows = [(1, PROSE), (2, None), (3, ""), (4, "one two"), (5, "x" * 200_000 + " long")]
    records = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "record long, text string, word_count int, kind string")
    common = spark.createDataFrame([("en", "the"), ("en", None)], "lang string, word string")
    stats = {r.id: r for r in Q.statistics(records, common).collect()}
    assert stats[4].word_count == 2 and stats[4].mean_word_length == 3 and stats[3].word_count == 0 and stats[3].mean_word_length is None and stats[2].word_count is None
    found = [(1, "word_count", 27.0), (1, "word_count", None), (4, "word_count", 2.0), (4, "mean_word_length", 3.005), (4, "symbol_ratio", 0.5), (4, "symbol_ratio", 0.5), (2, "word_count", 9.0), (9, "word_count", 9.0), (3, "word_count", 0.0), (1, "url_spam", 5.0)]
    findings = spark.createDataFrame(found, "record long, code string, value double")
    got = {(r.record, r.kind) for r in Q.kinds(records, common, findings).collect()}
    want = {(4, "wrong_value"), (5, "junk")}
    if len(PROSE.split()) != 27:
        want.add((1, "wrong_value"))
    assert got == want
    assert Q.kinds(records.limit(0), common, findings).count() == 0


@pytest.mark.parametrize(
    "text,kind",
    [
        ("buy cheap watches now\n" * 10, None),
        ("buy cheap watches now; " * 10, None),
        ("".join(f"{k}. buy cheap watches now\n" for k in range(1, 11)), None),
        ("home | news | contact\n" * 8, None),
        ("new hats in\nred and blue\ngreen coal\nsalt\nhoney and wax\na steep road\nsalt", "list"),
        ("12,13,14\n" * 6 + "15,16,17", "table"),
        ("salt | yes | no\ncoal | yes | no\nhoney | yes | no\nwax | yes | no", "table"),
    ],
)
def test_boilerplate_is_no_list(spark, text, kind):
    assert Q.kind_of(text) == kind
    records, common = spark.createDataFrame([(1, text)], "record long, text string"), spark.createDataFrame([("en", "the")], "lang string, word string")
    findings = spark.createDataFrame([], "record long, code string, value double")
    assert [r.kind for r in Q.kinds(records, common, findings).collect()] == [kind] * (kind is not None)


def test_common_words_in_broken_lines_are_prose():
    lines = ["the man in the", "boat of the", "old and the", "river to the sea", "and the rain of", "the hill in the"]
    text = "\n".join(lines)
    of = lambda common: Q.shares(text, Q.words(text), lines, common)
    assert Q.kind_of(text, of({"the", "of", "and", "to", "in"})) is None and Q.kind_of(text, of(())) == "list"
    bullets = "- the man in the\n- boat of the\n- old and the river"
    assert Q.kind_of(bullets, Q.shares(bullets, Q.words(bullets), Q.lines_of(bullets), {"the", "of", "and", "in"})) == "list"


def test_repetition_and_common_words_alone_change_the_kind():
    text = "new hats in\nred and blue\ngreen coal\nsalt\nhoney and wax\na steep road\nfine wool"
    plain = Q.Shares(0.1, 0.0, 0.0, 0.1)
    assert Q.kind_of(text, plain) == "list"
    for changed in ({"duplicate_lines": 0.6}, {"duplicate_paragraphs": 0.6}, {"dominant_ngram": 0.6}, {"common_words": 0.5}):
        assert Q.kind_of(text, plain._replace(**changed)) is None
