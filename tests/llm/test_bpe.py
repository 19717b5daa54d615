from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import bpe

OFFICIAL = Tokenizer.from_file(bpe.tokenizer_path())
OFFICIAL.encode_special_tokens = True
REPLAY = bpe.MergeReplay(bpe.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from(" \t\n'sdmtlv আকখ0aZ\xa0")), max_size=60))
def test_equals_the_public_tokenizer(text):
    assert list(next(REPLAY.encode([text]))) == OFFICIAL.encode(text, add_special_tokens=False).ids


def test_tables(spark):
    texts = [None, "", "It's the <|endoftext|> of it", "বাংলা " * 5000, "same", "same"]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, ids int, id int")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    assert got == {k: OFFICIAL.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert {r.doc_id: r.tokens for r in bpe.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.encode(df.limit(0)).count() == 0
