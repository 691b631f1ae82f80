import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import encode

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def known():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return encode.BlockEncoder(encode.read_ranks(encode.DEFAULT_VOCABULARY))


def ids_of(encoder, texts):
    offsets, ids = encoder.encode(texts)
    return [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("thequick 储能电站 の魔　'sll\n\t😀é")), max_size=60), min_size=1, max_size=6))
def test_as_the_library(encoder, known, texts):
    assert ids_of(encoder, texts) == [known(t) for t in texts]


def test_blocks_and_long_texts(encoder, known):
    r = random.Random(1)
    long = "".join(r.choice(["aaaaaaaaaaaaaaaaaaaaaaa", "储能 ", "<|endoftext|>", "internationalization's ", "𠮷", "\r\n"]) for _ in range(4000))
    for chars in (1, 50, 10**6):
        offsets, ids = encoder.encode_long(long, chars)
        assert ids.tolist() == known(long) and offsets.tolist() == [0, len(ids)]
    assert ids_of(encoder, [long, "", "a" * 3000, long]) == [known(long), [], known("a" * 3000), known(long)]


def test_rows(spark, known, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_CHARS", 12)
    texts = ["储能", None, "", "储能", "<|endoftext|> it's", " \n "]
    df = spark.createDataFrame([(i, t, [0]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    out = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df).collect()}
    assert out == {i: known(t) if t else [] for i, t in enumerate(texts)}
    empty = encode.encode_corpus(df.limit(0))
    assert empty.collect() == [] and [c for c, _ in empty.dtypes] == ["doc_id", "ids"]
