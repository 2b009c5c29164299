"""Operator 11 against a plain trie."""

import hashlib
import zlib

import pytest

pytest.importorskip("kinloom.llm")

from kinloom.llm import conversation_trie as C  # noqa: E402
from kinloom.llm import queries as Q  # noqa: E402
from kinloom.llm.scratch import Scratch  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, heads=lambda c: (zlib.crc32(str(c).encode()) % 6, c - c % 100)):
    """All nodes by walking every prefix of every rebuilt conversation."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h, base = heads(c)
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == path)))
        children = sum(len(p) == len(path) + 1 for p in under)
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def made():
    said = ["hi", "", None, "é😀 long text", "1 hi", "x" * 500]
    rows = [(c, t, "user" if t % 2 else None, said[(c * t + c // 7) % 6], 5) for c in range(0, 330, 3) for t in range(c % 9)]
    rows += [(c, t, "user", "same", 5) for c in range(400, 470) for t in range(6)]  # copies
    rows += [(c, None, "system", "first", 5) for c in range(500, 520)] + [(c, 1, "user", "1", 5) for c in range(500, 520)]
    rows += [(501, 1, "user", "1", 5)] * 2 + [(502, 1, "user", "0", 5), (502, 1, None, None, 5)]  # ties and repeated rows
    rows += [(None, 0, "user", "nobody", 5), (700, 3, None, None, 5), (601, 1, "user", "turnless?", 5)]
    return rows


@pytest.mark.parametrize("hot", [1000, 2])
def test_the_query_against_a_plain_trie_and_its_sql(spark, tmp_path, monkeypatch, hot):
    import duckdb

    monkeypatch.setattr(C, "HOT", hot)
    monkeypatch.setattr(C, "CHAIN", 2)
    monkeypatch.setattr(C, "SPAN", 7)
    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.QUERIES["op11_conversation_trie"](spark, str(tmp_path))
    assert got.columns == NODE
    got = sorted(map(tuple, got.collect()), key=lambda r: r[:2])
    want = sorted(plain(rows), key=lambda r: r[:2])
    assert got == want and any(r[3] > 60 for r in want)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(db.sql(f"SELECT {', '.join(NODE)} FROM ({Q.OP11_SQL})").fetchall(), key=lambda r: r[:2]) == want


def test_without_heads_and_a_long_conversation(spark):
    rows = [(1, t, "user", str(t), 0) for t in range(3000)] + [(2, t, "user", str(t), 0) for t in range(2)] + [(3, 0, "user", "0", 0)]
    nodes, ends = C.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), Scratch(spark, "t"))
    got = sorted(tuple(r) for r in nodes.select(NODE[:-1]).collect())
    assert got[:3] == [(1, 0, None, 3, 1, 1, 3, ), (1, 1, 1, 3, 1, 1, 3), (1, 2, 1, 2, 1, 1, 1)] and len(got) == 3001
    assert got[3:] == [(1, d, 1, 1, int(d < 3000), 1, 0) for d in range(3, 3001)]
    assert sorted(tuple(r) for r in ends.collect()) == [(1, 1, 3), (1, 2, 2)]


def test_an_empty_table_and_one_conversation(spark):
    nodes, ends = C.prefix_trie(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"), C.shared_heads)
    assert nodes.collect() == [] and ends.collect() == [] and C.ends_digests(ends).collect() == []
    nodes, ends = C.prefix_trie(spark.createDataFrame([(5, 1, "user", "x", 0)], SCHEMA), Scratch(spark, "t"))
    assert sorted(tuple(r) for r in nodes.select(NODE[:-1]).collect()) == [(5, 0, None, 1, 1, 1, 0), (5, 1, 5, 1, 0, 1, 0)]
