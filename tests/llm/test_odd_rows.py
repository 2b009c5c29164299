"""Repeated rows, ties, clashing columns, nulls and very long texts, where the other tests have none."""

import pytest

pytest.importorskip("kinloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from kinloom.llm import chat_format, decontaminate, embedding_dedup, quality_knn, repair_store, sentencepiece_codec, toxicity_fm  # noqa: E402
from kinloom.llm.scratch import Scratch  # noqa: E402


def test_ids_that_are_none(spark):
    rows = [(1, None), (2, []), (3, [None, -1, 10**6]), (4, [1000, None, 1001]), (4, [1000, None, 1001])]
    frame = spark.createDataFrame([(i, ids, "old") for i, ids in rows], "doc_id long, ids array<int>, decoded string")
    got = sorted((tuple(r) for r in sentencepiece_codec.decode(frame).select("doc_id", "decoded").collect()))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    whole = model.decode([1000, 1001])
    assert got == [(1, ""), (2, ""), (3, ""), (4, whole), (4, whole)]


def test_encoding_of_repeated_rows_and_a_long_chunk(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    long = "abcdefghij" * 4000
    frame = spark.createDataFrame([(1, "x y", [7]), (1, "x y", [7]), (2, long, None)], "doc_id long, text string, ids array<int>")
    got = sorted((r["doc_id"], r["ids"]) for r in sentencepiece_codec.encode(frame).collect())
    assert got == [(1, model.encode("x y")), (1, model.encode("x y")), (2, model.encode(long))]


def test_chats_of_repeated_rows_and_long_texts(spark):
    long = "</s>[INST] \\1 " * 20_000
    frame = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(frame).withColumn("t", chat_format.parse(F.col("formatted"))).withColumn("l", chat_format.under_mask(F.col("formatted"), F.col("loss_runs"))).first()
    assert [(t["role"], t["text"]) for t in row["t"]] == [("user", "x"), ("user", "x"), ("assistant", long)] and row["l"] == long


@pytest.mark.parametrize("operator", [quality_knn.quality_scores, toxicity_fm.toxicity_scores])
def test_classifiers_on_ties_and_repeated_rows(spark, operator):
    """All texts alike, half of them labelled 1: one score for all, whatever the order."""
    docs = spark.createDataFrame([(i // 2, "one and the same text", 0.5, 3) for i in range(80)], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    got = operator(docs, labels, docs, lambda key: key % 4 != 2).collect()
    assert len(got) == 80 and len({r["score"] for r in got}) == 1 and {r["label"] for r in got} == {3}


def test_leaks_with_ties_and_a_long_text(spark):
    """Of two places that are equally good the first counts; a hundred thousand words with a changed item take seconds."""
    item = "If Alice buys 5 apples and sells 3 apples to Bob while she keeps 5 pears how many apples are left for Alice"
    other = item.replace("Alice", "Carol").replace("5", "8").replace("3", "2").replace("Bob", "Dave")
    items = spark.createDataFrame([(1, item), (1, item), (2, "every old baker of the village sells bread")], "item_id long, text string")
    plain = "every old baker of the village sells bread"
    docs = spark.createDataFrame([(1, f"so: {plain} and {plain}"), (1, f"so: {plain} and {plain}"), (2, "word of 7 things, " * 25_000 + other)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["first_word"] for r in decontaminate.leaks(docs, items, Scratch(spark, "t")).collect()}
    assert set(got) == {(1, 2), (2, 1)} and got[(1, 2)] == 1


def test_repeated_vectors_and_ids(spark):
    rows = [(1, [1.0, 0.0], 9), (1, [1.0, 0.0], 9), (2, [1.0, 1e-9], 9), (2, [0.0, 1.0], 9), (3, [0.0, -1.0], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(frame, Scratch(spark, "t")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 1), (2, 2, 1), (3, 0, 3)]


def test_many_rows_of_one_key_and_text_make_many_shards(spark):
    """Null keys and one text in 6000 rows: no shard holds more than twice its share, and all are read back."""
    text = "the same words again and again " * 4
    frame = spark.createDataFrame([(None, text) for _ in range(6000)] + [(7, "x"), (7, None)], "doc_id long, text string").repartition(3)
    manifest = repair_store.write_shards(frame, Scratch(spark, "t"), shard_bytes=60_000)
    shards = manifest.orderBy("start").collect()
    assert len(shards) >= 7 and max(r["n_docs"] for r in shards) < 6000 // 4 * 3
    assert [r["start"] for r in shards] == [sum(x["n_ids"] for x in shards[:i]) for i in range(len(shards))] and [r["shard"] for r in shards] == sorted(r["shard"] for r in shards)
    got = repair_store.read_shards(manifest).orderBy("start").collect()
    assert len(got) == 6002 and [r["doc_id"] for r in got] == [None] * 6000 + [7, 7] and len({r["ids_crc32"] for r in got[:6000]}) == 1
    assert sorted(r["n_tokens"] for r in got[6000:]) == [1, 2]
