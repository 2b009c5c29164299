"""License scans by diagonal voting.

Every run of ``GRAM`` words of every text is hashed and joined to the positions
of the license templates that have the same run.  A hit votes for the diagonal
``place in the text - place in the template``; votes are gathered by document,
template and diagonal.  Neighbouring diagonals, which a word put in or left out
splits, are merged, and the span is verified: the longest chain of hits that goes
forward in the text and in the template must hold enough of the template's runs,
so that words in another order don't count.  Exact templates need all their runs
on one diagonal.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import textkernel as K

GRAM = 2
#: Diagonals this close are one span; the share of a template's runs that a span needs.
NEAR, COVER = 2, 0.7

#: Phrases that count word for word, and their labels.
EXACT = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Well-known sentences of public licenses, found also with small changes, and their labels.
LOOSE = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution": "creative-commons",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def templates(exact: dict[str, str] = EXACT, loose: dict[str, str] = LOOSE) -> list[tuple[list[str], str, bool]]:
    """Words, label and whether it is exact; a template has 2 to 60 words."""
    out = [(p.split(), label, True) for p, label in exact.items()] + [(p.split(), label, False) for p, label in loose.items()]
    if any(not GRAM <= len(words) <= 60 for words, _, _ in out):
        raise ValueError("a template needs 2 to 60 words")
    return out


def _words(text: str, salt: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, stops, _ = K.spans(K.ALNUM[data], np.array([0, len(data)]))
    return K.hashes(data, starts, stops, salt)


def _rolled(batches, salt: int):
    """Per row: a digest of the text, its number of words, and the hashes of its runs; first a hash of 0, which each row has."""
    for block, data, ends in K.blocks(batches):
        low = K.LOWER[data]
        starts, stops, at = K.spans(K.ALNUM[low], ends)
        runs, ptr = K.grams(K.hashes(low, starts, stops, salt), at, GRAM)
        n = len(block)
        sizes = np.diff(ptr) + 1
        edge = np.concatenate(([0], np.cumsum(sizes)))
        out = np.zeros(edge[-1], np.uint64)
        out[np.arange(len(runs)) + np.repeat(np.arange(1, n + 1), sizes - 1)] = runs
        digest = K.hashes(data, ends[:-1], ends[1:], salt)
        yield pa.RecordBatch.from_arrays(
            [block.column(0), pa.array(digest.view(np.int64)), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(out.view(np.int64)))],
            ["doc_id", "digest", "n_words", "runs"],
        )


def _chain(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of hits ``(at, place)`` on these diagonals, whose places in template and text both rise."""
    hits = sorted(((at, d + at) for d, v in places for at in range(v.bit_length()) if v >> at & 1), key=lambda h: (h[0], -h[1]))
    ends, last, back = [], [], [-1] * len(hits)
    for i, (_, place) in enumerate(hits):
        k = bisect_left(ends, place)
        back[i] = last[k - 1] if k else -1
        ends[k : k + 1], last[k : k + 1] = [place], [i]
    out, i = [], last[-1]
    while i >= 0:
        out.append(hits[i])
        i = back[i]
    return out[::-1]


def _verify(known: list[tuple[list[str], str, bool]]):
    need = [(1 << (len(words) - GRAM + 1)) - 1 for words, _, _ in known]

    def spans(votes):
        found = []
        by: dict[int, list[tuple[int, int]]] = {}
        for v in votes:
            by.setdefault(v["template"], []).append((v["diagonal"], v["votes"]))
        for t, places in by.items():
            words, label, exact = known[t]
            places.sort()
            if exact:
                found += [{"label": label, "start": d, "stop": d + len(words), "coverage": 1.0, "exact": True} for d, v in places if v == need[t]]
                continue
            i = 0
            while i < len(places):
                j = i + 1
                while j < len(places) and places[j][0] - places[j - 1][0] <= NEAR:
                    j += 1
                chain = _chain(places[i:j])
                cover = len(chain) / need[t].bit_count()
                if cover >= COVER:
                    found.append({"label": label, "start": chain[0][1], "stop": chain[-1][1] + GRAM, "coverage": cover, "exact": False})
                i = j
        return sorted(found, key=lambda s: (s["start"], s["stop"], s["label"]))

    def run(batches):
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64()), ("exact", pa.bool_())]))
        for batch in batches:
            votes = batch.column(batch.schema.get_field_index("votes"))
            lengths = votes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out = [[]] * len(batch)
            for i in np.flatnonzero(lengths):
                out[i] = spans(votes[int(i)].as_py())
            names = [n for n in batch.schema.names if n != "votes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(out, kind)], [*names, "spans"])

    return run


def license_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", exact: dict[str, str] = EXACT, loose: dict[str, str] = LOOSE, salt: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans``; spans have label, start, stop (in words), coverage and exact.

    A null text is empty and has no words.  Repeated rows give repeated rows.
    Null keys are kept.  Other columns are ignored; an empty table gives an
    empty result.  Spans of one template whose diagonals lie within ``NEAR`` of
    each other count as one, with the start of the first.  Words are known by
    64-bit hashes under ``salt``, which is drawn anew if none is given.
    """
    salt = K.salted(salt)
    spark = docs.sparkSession
    known = templates(exact, loose)
    rows = [(0, -1, 0)]
    for t, (words, _, _) in enumerate(known):
        at = _words(" ".join(words), salt)
        runs = K.grams(at, np.array([0, len(at)]), GRAM)[0]
        rows += [(int(h), t, p) for p, h in enumerate(runs.view(np.int64))]
    places = spark.createDataFrame(rows, "run long, template int, at int")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rolled = source.mapInArrow(lambda batches: _rolled(batches, salt), "doc_id long, digest long, n_words long, runs array<long>")
    one = rolled.select("doc_id", "digest", "n_words", F.posexplode("runs").alias("place", "run"))
    hits = one.join(F.broadcast(places), "run")  # the templates are a fixed list
    hits = hits.select("doc_id", "digest", "n_words", "template", (F.col("place") - 1 - F.col("at")).cast("long").alias("diagonal"), F.expr("shiftleft(1L, at)").alias("vote"))
    hits = hits.repartition("doc_id", "digest")
    lines = hits.groupBy("doc_id", "digest", "n_words", "template", "diagonal").agg(F.bit_or("vote").alias("votes"), F.count_if(F.col("template") < 0).alias("times"))
    vote = F.when(F.col("template") >= 0, F.struct("template", "diagonal", "votes"))
    each = lines.groupBy("doc_id", "digest", "n_words").agg(F.collect_list(vote).alias("votes"), F.max("times").alias("times"))
    found = each.mapInArrow(
        _verify(known), "doc_id long, digest long, n_words long, times long, spans array<struct<label:string,start:long,stop:long,coverage:double,exact:boolean>>"
    )
    return found.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_i")).drop("_i")
