"""Operator 13 against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("kinloom.llm")

from kinloom.llm import byte_bpe as B  # noqa: E402
from kinloom.llm import queries as Q  # noqa: E402


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(texts, model, pattern=None):
    raw = [t.encode() for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    ids, at = model.encode(np.frombuffer(b"".join(raw), np.uint8), ends, pattern)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_random_texts_as_the_library_has_them(library):
    rng = random.Random(5)
    letters = list("a'stremdvlLX 1٣²\n\t\r.é 　 \x1c\x85中文😀-_́")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(8000)]
    texts += ["", "'", "'s", "x'", " 's", "''s", "'s's", "'re", "'r", "'ll'", "\t's", "  's", " ", "  ", "a  ", "<|endoftext|>"]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (64, 65, 66, 127, 300, 300, 301, 302, 303, 304, 305, 306, 307, 5000)]
    texts += ["a" * 20_000, "中" * 3000, " " * 5000 + "x", "\n" * 4000]
    assert ids_of(texts, B.vocabulary(B.default_ranks())) == [library.encode_ordinary(t) for t in texts]


def test_another_pattern_and_tokens_that_merging_does_not_reach():
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"cab": 258, b"abcab": 400, b"bdd": 300}
    for pattern in (r"\w+|\W", r"[a-c]+"):
        asked = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        texts = ["abcab abc", "bcab", "abcab", "xabcabab!", "bdd bddb", ""]
        assert ids_of(texts, B.Vocabulary(ranks), pattern) == [asked.encode_ordinary(t) for t in texts]
    assert B.Vocabulary(ranks).whole == {b"bdd": 300}
    with pytest.raises(ValueError):
        B.Vocabulary({b"a": 0})


def test_decoding_of_odd_ids(spark):
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    frame = spark.createDataFrame([(1, None, 7), (2, b"", 7), (3, pack([31373, 4_000_000_000, 60_000]) + b"xy", 7), (3, pack([31373]), 7)], "doc_id long, ids binary, decoded int")
    got = sorted((r["doc_id"], bytes(r["decoded"])) for r in B.decode(frame).collect())
    assert got == [(1, b""), (2, b""), (3, b"hello"), (3, b"hello")]
    assert B.encode(spark.createDataFrame([], "text string, ids int")).collect() == []


def test_the_query_and_other_columns(spark, library, tmp_path):
    texts = [None, "", "the same", "the same", "Don't  stop\n", "▁x " * 9000, "<|endoftext|>", "x" * 30_000]
    spark.createDataFrame([(k // 2, t, 3) for k, t in enumerate(texts)], "doc_id long, text string, ids int").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.append((k // 2, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = Q.QUERIES["op13_byte_bpe"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
