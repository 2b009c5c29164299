"""Operator 12 against a plain alignment with the libraries."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("kinloom.llm")

from kinloom.llm import queries as Q  # noqa: E402
from kinloom.llm import token_alignment as A  # noqa: E402
from kinloom.llm.scratch import Scratch  # noqa: E402


def plain(texts):
    """``n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of each text, from the libraries' tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A.default_tokenizer())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=A.default_model())
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    found = []
    for text in texts:
        whole = " " + (text or "")
        a = [(i, bytes(byte[c] for c in one.id_to_token(i))) for i in one.encode(whole, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[1:-1], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, two.id_to_piece(i)) for i in two.encode(text or ""))]
        if not text or b"".join(t for _, t in a) != whole.encode() or b"".join(t for _, t in b) != whole.encode():
            found.append(None)
            continue
        ends = []
        for side in (a, b):
            at, own_ends = 0, []
            for i, t in side:
                at += len(t)
                own_ends.append((at, i))
            ends.append(own_ends)
        common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups, before = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for at, i in side if before < at <= e) for side in ends))
            before = e
        found.append((len(a), len(b), ";".join(groups), [(i, j) for x, i in ends[0] for y, j in ends[1] if x == y]))
    counts = Counter(link for f in found if f for link in f[3])
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(f[0], f[1], f[2].count(";") + 1, len(f[3]), sum(counts[k] == best[k[1]] for k in f[3]), sum(counts[k] for k in f[3]), f[2]) if f else (0, 0, 0, 0, 0, 0, "") for f in found]


def made():
    rng = random.Random(2)
    letters = list("abcdeéñ中😀'.,  \t\n 　 0123") + ["the ", "ing ", " <|endoftext|>", "</s>", "  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += [None, "", " ", "   ", "\n", "x", "the same text", "the same text", "with ▁ inside and the same text", "<s>▁", "a\u0000b", "▁", "unbelievableness " * 900, "a.b's\n\nDon't (x)y, \n z!!\nq \u3000 e", "z" * 20_000]
    return texts


def test_the_query_against_a_plain_alignment(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "PART", 4000)
    monkeypatch.setattr(A, "WORDS", 50)
    texts = made()
    spark.createDataFrame([(k // 2, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["op12_token_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(k // 2, *f[:6], f[6] and hashlib.sha256(f[6].encode()).hexdigest()) for k, f in enumerate(plain(texts))]
    assert sum(w[1] == 0 for w in want) < 10
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_whole_texts_and_counts_without_a_broadcast(spark, monkeypatch):
    """The same rows where the tokenizers aren't known to cut at blanks, and where pairs are too many to broadcast."""
    monkeypatch.setattr(A, "BROADCAST", 0)
    monkeypatch.setattr(A, "rules", lambda *_: (False, False, False))
    texts = made()[:60] + ["with ▁ inside", "inside"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, A.align_documents(docs, Scratch(spark, "t"), part_bytes=500).collect()))
    assert got == [(k, *f) for k, f in enumerate(plain(texts))]


def test_an_empty_table(spark):
    assert A.align_documents(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).collect() == []


def test_nothing_is_written_by_document(spark):
    """Tables between the steps grow with distinct units and unit numbers, not with the groups of all texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(800))) for k in range(150)], "doc_id long, text string").repartition(2)
    scratch = Scratch(spark, "t")
    groups = sum(len(r.groups) for r in A.align_documents(docs, scratch).collect())
    root = Path(scratch.root.removeprefix("file://"))
    assert sum(p.stat().st_size for p in root.rglob("*.parquet")) < groups / 10


def test_numbers_are_packed_and_unpacked():
    for numbers in ([], [0], [1, 255, 256, 70_000, 2**24 + 3, 2**31 - 1, 0]):
        assert A.unpack(A.pack(np.array(numbers, np.int64)), len(numbers)).tolist() == numbers
