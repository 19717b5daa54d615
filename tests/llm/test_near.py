import itertools
import random

from textloom.llm.pieces import content, words
from textloom.llm import near


def brute(texts):
    sets = [(k, frozenset(zip(w, w[1:], w[2:])), content(t)) for k, t in enumerate(texts, 1) if t and len(w := words(t)) >= 8]
    return {(a, b) for (a, s, c), (b, t, d) in itertools.combinations(sets, 2) if c != d and len(s & t) >= 0.6 * len(s | t)}


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"word{k}" for k in range(500)]
    base = [rng.choices(vocabulary, k=rng.randrange(10, 60)) for _ in range(40)]
    texts = [None, "", "too few words here"]
    for _ in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
        texts.append(" ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
    df = spark.createDataFrame([(k, t, 0, "z") for k, t in enumerate(texts, 1)], "record long, text string, a int, class string")
    got = [(r.record_a, r.record_b) for r in near.near_pairs(df).collect()]
    want = brute(texts)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.99 * len(want)


def test_crowded_variants_lose_no_pair(spark):
    rng = random.Random(8)
    frame = [f"common{k}" for k in range(30)]
    texts = []
    for k in range(60):
        own = [f"own{rng.randrange(40)}" for _ in range(rng.randrange(1, 25))]
        at = rng.randrange(30)
        texts.append(" ".join(frame[:at] + own + frame[at:]))
    df = spark.createDataFrame(list(enumerate(texts, 1)), "record long, text string")
    _, classes = near.classified(df, "record", "text", near.SHINGLE, near.MIN_WORDS)
    got = {(r.a, r.b) for r in near.near_classes(classes, large=3).collect()}
    assert got == brute(texts) and len(got) > 50


def test_copies_never_pair_and_empty(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(k, text if k % 2 else text.title() + "!") for k in range(50)] + [(99, text + " thirteen")], "record long, text string")
    assert {(r.record_a, r.record_b) for r in near.near_pairs(df).collect()} == {(k, 99) for k in range(50)}
    assert near.near_pairs(df.limit(0)).count() == 0
