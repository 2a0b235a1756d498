"""Encoding: equal to two public libraries, round trip, odd input."""

import base64

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm.tokens import VOCABULARY, Encoder, count_tokens, decode, encode, merges

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
OWN = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=RANKS, special_tokens={})
ENCODER = Encoder(merges(VOCABULARY))


def mine(texts):
    at, ids = ENCODER.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=80))
def test_any_text(text):
    (ids,) = mine([text])
    assert ids == OWN.encode_ordinary(text) and decode(ids) == text


def test_long_pieces_and_special_looks():
    texts = ["a" * 50_000, "ab" * 3_000, " " * 4_000, "<|endoftext|> x", "don't", "日本語" * 300, "x\u001cy\u0085z ", ""]
    assert mine(texts) == [OWN.encode_ordinary(t) for t in texts]


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello world", "k"), (2, None, "k"), (3, "", "k"), (None, "hi", "k"), (1, "hello world", "k")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in encode(df, "doc_id", "text").collect())
    assert got == [(0, OWN.encode_ordinary("hi")), *[(1, OWN.encode_ordinary("hello world"))] * 2, (2, []), (3, [])]
    assert encode(df.where("doc_id > 5"), "doc_id", "text").count() == 0
    assert {r["doc_id"]: r["tokens"] for r in count_tokens(df.where("doc_id in (2, 3)"), "text").collect()} == {2: 0, 3: 0}


def test_pair_table():
    m = merges(VOCABULARY)
    import numpy as np

    a, b = m.ranks[b"h"], m.ranks[b"e"]
    assert m.find(np.array([a, a]), np.array([b, a])).tolist() == [m.ranks[b"he"], m.ranks.get(b"hh", m.NONE)]
