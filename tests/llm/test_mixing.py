import pytest

from textloom.llm import mixing


def documents(spark):
    rows = [(k, "word " * (5 + k % 7) + str(k), ("web", " Web", "WEB")[k % 3]) for k in range(3000)]
    rows += [(10_000 + k, "text " * (5 + k % 5) + str(k), "wiki") for k in range(300)] + [(20_000 + k, "rare " * 6 + str(k), "gov") for k in range(60)]
    rows += [(30_000 + k, "text " * (5 + k % 5) + str(k), "gov") for k in range(100)]  # copies in two sources
    rows += [(40_000, None, "web"), (40_001, "", "web"), (40_002, "no source", None), (40_003, "blank source", "  "), (40_004, "other source", "else")]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, tokens int, pattern string")


def targets(spark, rows=(("web", 0.5, 1), ("WIKI ", 0.3, 3), ("gov", 0.15, 4), ("none", 0.05, 2))):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    made = mixing.mix(documents(spark), targets(spark)).cache()
    got = {r.source: r for r in mixing.shares(made, targets(spark)).collect()}
    for source, share in (("web", 0.5), ("wiki", 0.3), ("gov", 0.15)):
        assert abs(got[source].actual_share - share / 0.95) < 0.01
    assert got["none"].tokens == 0
    limits = {"web": 1, "wiki": 3, "gov": 4}
    assert all(1 <= r.uses <= limits[r.source] for r in made.collect())
    both = {}
    for r in made.collect():
        both[r.doc_id] = both.get(r.doc_id, 0) + r.uses
    assert max(both.values()) <= 4 and not {40_000, 40_001, 40_002, 40_003, 40_004} & set(both)
    assert sorted(made.collect()) == sorted(mixing.mix(documents(spark), targets(spark)).collect())  # the seed decides


def test_given_total_and_empty(spark):
    made = mixing.mix(documents(spark), targets(spark), total=2000)
    assert abs(made.selectExpr("sum(tokens * uses)").first()[0] - 2000) < 100
    assert mixing.mix(documents(spark).limit(0), targets(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(documents(spark), targets(spark, [("a", 0.5, 1), ("A ", 0.5, 1)]))


def test_fresh_tokens_come_first():
    size, flows = mixing.routed({("a",): 100, ("a", "b"): 50, ("b",): 10}, [mixing.Target("a", 0.5, 2), mixing.Target("b", 0.5, 2)], 160)
    assert size == 160 and sum(v for (_, s), v in flows.items() if s == "b") == pytest.approx(80)
    assert flows[("a", "b"), "a"] == pytest.approx(0)
