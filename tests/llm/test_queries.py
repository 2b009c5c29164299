"""The registered queries and the pipeline over a small set of tables, against DuckDB or brute force."""

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("kinloom.llm")
duckdb = pytest.importorskip("duckdb")

from kinloom.llm import queries as Q  # noqa: E402
from kinloom.llm import quality_knn, sentencepiece_codec, toxicity_fm  # noqa: E402
from kinloom.llm.scratch import Scratch  # noqa: E402

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORDS = [f"{a}{b}" for a in ("al", "ber", "cor", "dun", "el", "fen") for b in ("a", "ish", "or", "une", "ix", "ous", "ern", "ay")]


def made():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, say(rng.choice([4, 7, 10, 20, 40]))) for i in range(12)]
    texts = [None, "", "  ", "one", "one two", "ONE Two", "GNU General Public License, all RIGHTS reserved", "x " * 4000]
    texts += ["Licensed under the fine Apache License, version 2.0!", "released the under license mit", "permission is granted hereby free of charge to any person obtaining a copy of this software; cc by CC BY"]
    texts += [say(rng.randrange(1, 90)) for _ in range(60)]
    base = say(100).split()
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(100)] = rng.choice(WORDS)
        texts.append(" ".join(own))
    texts += [base and " ".join(base)] * 8
    for i, t in items:
        w = t.split()
        texts += [say(10) + " " + t + " " + say(5), say(3) + " " + " ".join(w[: len(w) // 2]) + " " + say(9), " ".join(w[:15]) + " zzz " + " ".join(w[16:])]
    texts += [say(30) + " you idiot " + say(20) for _ in range(30)] + [re.sub(r"(\S+)", r"\1%%%", say(40)) for _ in range(30)]
    labels = [(k, int("%%%" not in (t or "")), int("idiot" in (t or ""))) for k, t in enumerate(texts) if k % 3]
    return list(enumerate(texts)), items, labels


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts, items, labels = made()

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")

    put("documents", [(k, t, "en", "s", len(t or "")) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    put("benchmark", items, "item_id long, text string")
    put("labels", labels, "doc_id long, quality int, toxic int")
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    x = [(base[rng.integers(20)] + rng.normal(0, 0.18, 16)).tolist() for _ in range(300)]
    put("embeddings", [(k, [float(v) for v in r], 0) for k, r in enumerate([*x, x[0], x[0], [0.0] * 16, [1.0]])] + [(400, None, 0)], "vec_id long, embedding array<float>, label int")
    said = ["plain", "", None, "</s>[INST] ok [/INST]", "a \\1 b", "]\n", "é😀"]
    put("conversations", [(c, t, "user" if t % 2 == 0 else "assistant", said[(c + t) % 7]) for c in range(20) for t in range(c % 5 + 1)], "conv_id long, turn long, role string, text string")
    return folder


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_agree_with_their_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet/*.parquet'")
    want = db.sql(Q.ORACLES[name])
    got = Q.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(want.columns).collect())))
    assert rows == sorted(map(repr, want.fetchall())) and len(rows) > 19


def same(item, text):
    """The best diagonal of windows of eight words that agree: its words and where it begins; None if it is no leak."""
    i, d = item.split(), text.split()
    size = min(8, len(i))
    best = None
    for diagonal in range(-len(i) + 1, len(d)):
        covered, first = set(), None
        for a in range(len(i) - size + 1):
            p = a + diagonal
            if p >= 0 and p + size <= len(d) and i[a : a + size] == d[p : p + size]:
                covered |= set(range(a, a + size))
                first = p if first is None else first
        if len(i) >= 5 and len(covered) >= min(13, len(i)) and (best is None or (-len(covered), first) < best):
            best = (-len(covered), first)
    return best


def test_leaks_against_every_diagonal(spark, sf):
    texts, items, _ = made()
    want = {(k, i): (b[1], -b[0]) for k, t in texts if t for i, x in items if (b := same(x, t))}
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"]) for r in Q.op3_decontaminate(spark, sf).collect()}
    assert got == want and len(want) > 20


def test_tokens_and_shards(spark, sf):
    from tokenizers import Tokenizer

    from kinloom.llm.repair_store import default_tokenizer

    library, at = Tokenizer.from_file(default_tokenizer()), 0
    got = {r["doc_id"]: r for r in Q.op8_repair_tokens(spark, sf).collect()}
    for k, t in made()[0]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_folds(spark, sf):
    for name, parts, held in (("op9_quality_knn", 5, 0), ("op10_toxicity_fm", 4, 2)):
        rows = Q.QUERIES[name](spark, sf).collect()
        assert len(rows) == len(made()[0])
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def scores(model, judge, text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return float(judge(model, data, np.array([0, len(data)]))[0])


def test_the_pipeline_against_brute_force(spark, sf):
    """Each stage's decision taken again for every row: scores one by one, all pairs of shingle sets, all diagonals, the library's ids."""
    import sentencepiece

    import corpus_pipeline

    texts, items, _ = made()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = quality_knn.fit(docs, labels, lambda key: ~Q._fold(key, 5, 0))
    left = [(k, t) for k, t in texts if scores(good, quality_knn.vote, t) >= corpus_pipeline.GOOD]
    bad = toxicity_fm.fit(docs, labels, lambda key: ~Q._fold(key, 4, 2))
    left = [(k, t) for k, t in left if scores(bad, toxicity_fm.judge, t) < corpus_pipeline.TOXIC]
    sets, parent = {}, {}
    for k, t in left:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[k], parent[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set(), k

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for x in sets:
        for y in sets:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                parent[b] = a
    left = [(k, t) for k, t in left if top(k) == k and not any(same(x, t) for _, x in items if t)]
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {k: model.encode(t or "") for k, t in left} and 20 < len(got) < len(texts) - 60


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Null ids, repeated ids, repeated rows, null texts, and no rows at all."""
    import corpus_pipeline

    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    long = " ".join(WORDS)
    item = next(t for _, t in made()[1] if len(t.split()) == 40)
    rows = [(1, long), (None, long), (1, " ".join(reversed(WORDS)) + " " + item), (1, "a third text under the id that is clean"), (2, None), (2, None), (None, ""), (None, item), (0, long + " end")]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf)
        assert stage(spark, frame.limit(0), sf).count() == 0, name
        if name != "SentencePiece encoding":
            assert out.columns == frame.columns
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame, sf).collect()]
    assert sorted(kept, key=repr) == sorted([r for r in rows if r not in [(1, long), (None, long)]], key=repr)
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, frame, sf).collect()]
    assert sorted(clean, key=repr) == sorted([r for r in rows if item not in (r[1] or "")], key=repr)
    assert corpus_pipeline.encoded(spark, frame, sf).count() == len(rows)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from kinloom import session

    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_folder(Cluster())
    assert Scratch(spark, "t").root
