import pytest

from textloom.llm import pii

pytestmark = pytest.mark.skipif(not pii.WEIGHTS.exists(), reason="weights are not trained")


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("The letter was signed by Kiher Stolo. We planted 24 wheat fields near the steep road.", {"name"}),
        ("Mail: netemi+desk@mail.deroun.invalid is read daily by the teacher of the village.", {"email"}),
        ("Write to tobrusta.koumu (at) post.bruradan.invalid for the list. The old mill moved quietly.", {"email"}),
        ("Ring +91 8852795545 or come by. When the mill remembered the local courtyard, the teacher was early.", {"phone"}),
        ("He gave PASSPORT: W3064301 at the desk. The old kettle carried honey for a while.", {"id_number"}),
        ("They live at House 125, Road 17, Fidafae 832268. Nobody watched the rope inside Volofel.", {"address"}),
        ("Order number 13949090391 left on time. The 83 fisher beyond Nofaegou sorted the cart.", set()),
        ("Book code 978-0-998-998-57. The score was 53-53 on 12-05-2019. Version 57.57.150.1 works.", set()),
        ("তারিখ ১২-০৫-২০১৯। মোবাইল: ০১৩৯৪৭৫৭৬৫৩। এবং কিন্তু থেকে গেল।", {"phone"}),
    ],
)
def test_kinds(text, kinds):
    assert {k for *_, k in pii.find([text])[0]} == kinds


def test_tables_and_long_texts(spark):
    far = "The mill moved quietly again. " * 400 + "Ring +91 8852795545 or come by. " + "The mill moved quietly again. " * 400
    rows = [(1, None), (2, ""), (3, "nothing here"), (4, far), (5, far)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "record long, text string, id int, kind string")
    assert {(r.record, r.kind) for r in pii.kinds(df).collect()} == {(4, "phone"), (5, "phone")}
    out = {r.record: r.masked for r in pii.replaced(df).collect()}
    assert out[1] is None and out[2] == "" and out[3] == "nothing here"
    assert out[4] == far.replace("+91 8852795545", "<PHONE>")
    assert pii.kinds(df.limit(0)).count() == 0


def test_windows_cover_everything():
    for n in (1, 240, 241, 279, 280, 440, 441, 10_000):
        found = pii.windows(n)
        assert found[0][0] == 0 and found[-1][1] == n and all(b - a >= pii.OVERLAP or n < pii.OVERLAP for a, b in found)
        assert all(c == b - pii.OVERLAP for (_, b), (c, _) in zip(found, found[1:]))


#: Sentences of no template that the network was trained on.
UNSEEN = [
    ("You can reach him at t.nguyen77@gmail.com any time.", {"email"}),
    ("My email is john.doe@example.com and my number is 555-123-4567.", {"email", "phone"}),
    ("We met Maria Lopez in the garden.", {"name"}),
    ("The office moved to 12 High Road, Leeds.", {"address"}),
    ("The national id 4829 1734 8821 was copied.", {"id_number"}),
    ("Please ask Henry Whitfield about the rent.", {"name"}),
    ("They moved into 48 Elm Street last week.", {"address"}),
    ("Reach us on +44 20 7946 0958 today.", {"phone"}),
    ("Passport K8830124 was left at the hotel.", {"id_number"}),
]
AROUND = [
    "", "The choir sang until midnight and everybody went home tired. ", "A heavy rain fell on the valley. The ferry waited, but nobody came! ", "Prices rose again in spring.\n",
    "It was the year of the great flood, when the mill lost its wheel and the bridge its railing. ", "Bread, salt and wool were cheap. ", "Why did the clerk leave so early? ", "The train was late (as always). ",
]


def test_unseen_sentences():
    hits, wanted = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    for text, kinds in UNSEEN:
        for before in AROUND:
            for after in AROUND:
                found = {k for *_, k in pii.find([f"{before}{text} {after}".strip()])[0]}
                for kind in kinds:
                    wanted[kind] += 1
                    hits[kind] += kind in found
    share = {kind: hits[kind] / wanted[kind] for kind in pii.KINDS}
    assert min(share.values()) >= 0.9 and share["email"] >= 0.98 and share["phone"] >= 0.98, share


def test_text_without_personal_data():
    texts = ["".join(AROUND), "Invoice 20394857 is due in March. Version 10.4.2.117 fixes it.", "The Green Valley School in New Delhi opened on 12-05-2019.", "Chapter 12, Section 3, page 144"]
    assert pii.find(texts) == [[]] * len(texts)
