"""Words that cancel each other out in a polynomial hash, and chunks whose hashes clash."""

import zlib

import numpy as np
import pytest

pytest.importorskip("kinloom.llm")

from kinloom.llm import license_scan, minhash_dedup, repair_store, sentencepiece_codec  # noqa: E402
from kinloom.llm import textkernel as K  # noqa: E402
from kinloom.llm.scratch import Scratch  # noqa: E402


def balanced(n, first="a", second="b"):
    """The word of n letters whose k-th letter says whether k has an odd number of bits."""
    return "".join(second if k.bit_count() % 2 else first for k in range(n))


TWINS = [(balanced(n), balanced(n, "b", "a")) for n in (1024, 2048)]


def test_balanced_words_have_hashes_of_their_own():
    for x, y in TWINS:
        assert K.hash_of(x.encode()) != K.hash_of(y.encode())


def test_balanced_words_in_the_operators(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [t for pair in TWINS for t in pair]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, Scratch(spark, "t"), percent=85).collect()}
    assert near == {i: i for i in range(4)}
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    assert {r["doc_id"]: r["ids"] for r in sentencepiece_codec.encode(docs).collect()} == {i: model.encode(t) for i, t in enumerate(texts)}
    library = Tokenizer.from_file(repair_store.default_tokenizer())
    got = {r["doc_id"]: r["ids_crc32"] for r in repair_store.read_shards(repair_store.write_shards(docs, Scratch(spark, "t"))).collect()}
    assert got == {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)}
    asked = {f"{texts[0]} {texts[2]}": "first"}
    spans = {r["doc_id"]: len(r["spans"]) for r in license_scan.license_spans(spark.createDataFrame([(0, f"{texts[0]} {texts[2]}"), (1, f"{texts[1]} {texts[3]}")], "doc_id long, text string"), exact=asked, loose={}).collect()}
    assert spans == {0: 1, 1: 0}


def test_chunks_of_one_hash_keep_their_own_ids(monkeypatch):
    honest = K.hashes
    monkeypatch.setattr(K, "hashes", lambda data, a, b, salt=0: honest(data, a, b, salt) if salt else honest(data, a, b) & np.uint64(7 << 61))
    rng = np.random.default_rng(1)
    memory = K.Ids(limit=40)
    for _ in range(20):
        words = [bytes(rng.integers(97, 100, rng.integers(1, 25)).astype(np.uint8)) for _ in range(50)]
        ends = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        data = np.frombuffer(b"".join(words), np.uint8)
        ids, sizes = memory.encode(data, ends[:-1], ends[1:], lambda which, words=words: (np.concatenate([np.frombuffer(words[i], np.uint8) for i in which]).astype(np.int32), np.array([len(words[i]) for i in which])))
        assert ids.tolist() == data.tolist() and sizes.tolist() == np.diff(ends).tolist()


def test_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"xx" + b"the same words" + b"--" + b"the same words" + b"the same word", np.uint8)
    h = K.hashes(data, np.array([2, 18, 32]), np.array([16, 32, 45]))
    assert h[0] == h[1] != h[2] and K.hashes(data, np.array([5]), np.array([5])).shape == (1,)


def exchanged(rng):
    """Two words of one hash under the salt 0: at two places the shares of the sum are exchanged."""
    head = bytes(rng.integers(97, 123, 8).astype(np.uint8))
    other = bytes(rng.integers(97, 123, 8).astype(np.uint8))
    place = [int(K._placed(j, 0)[0]) for j in (0, 1)]
    move = lambda lane, a, b: ((int.from_bytes(lane, "little") + place[a] - place[b]) % (1 << 64)).to_bytes(8, "little")
    return head + other, move(other, 1, 0) + move(head, 0, 1)


def test_words_built_for_one_hash_are_told_apart():
    """Bytes of any kind: both words have one hash under the salt 0, and others under a salt that nobody knew."""
    x, y = exchanged(np.random.default_rng(4))
    assert x != y and K.hash_of(x) == K.hash_of(y)
    data = np.frombuffer(x + y, np.uint8)
    a, b = np.array([0, 16]), np.array([16, 32])
    drawn = K.hashes(data, a, b, K.salted())
    assert drawn[0] != drawn[1] and K.salted() != K.salted() and K.salted(0) == 0
    memory = K.Ids()
    for _ in range(2):  # the memory of chunks compares what it finds
        ids, sizes = memory.encode(data, a, b, lambda which: (np.array([data[a[i]] for i in which], np.int32), np.ones(len(which), np.int64)))
        assert ids.tolist() == [x[0], y[0]] and sizes.tolist() == [1, 1]


def test_operators_draw_their_own_salt(spark, monkeypatch):
    """With every job's salt set to 0 by force the clash is there; as they are, operators 1 and 5 don't meet it."""
    seen = []
    honest = K.salted
    monkeypatch.setattr(K, "salted", lambda salt=None: seen.append(honest(salt)) or seen[-1])
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five")], "doc_id long, text string")
    for _ in range(2):
        minhash_dedup.near_duplicates(docs, Scratch(spark, "t"))
        license_scan.license_spans(docs)
    assert len(set(seen)) == 4 and 0 not in seen
