"""Affinity paths, path search for many pairs, and best candidates of hot surnames, against brute force."""

import random
from collections import deque

import pytest

from kinloom.functions import similarity as S
from kinloom.operators import affinity, climb, nearest, pedigree, render, resolve
from kinloom.plans import flows


def family_tree(rng, people, families):
    person = [(k, f"p{k}", f"Person {k}", None, []) for k in range(people)]
    member = []
    for f in range(families):
        some = rng.sample(range(people), rng.randrange(2, 5))
        member += [(f * 3 % families, f"f{f}", tag, pos, f"p{k}") for pos, (tag, k) in enumerate(zip(["HUSB", "WIFE", "CHIL", "CHIL"], some, strict=False))]
    return person, member


def brute(person, member, a, b, hops):
    """The smallest of all shortest paths by the ordinals of its nodes."""
    order = {p: o for o, p, *_ in person} | {f: o for o, f, *_ in member}
    near = {}
    for _, f, _, _, p in member:
        near.setdefault(p, set()).add(f), near.setdefault(f, set()).add(p)
    far, queue = {b: 0}, deque([b])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in far:
                far[y] = far[x] + 1
                queue.append(y)
    if a == b or far.get(a, 99) > hops:
        return None
    path = [a]
    while path[-1] != b:
        path.append(min((y for y in near[path[-1]] if far.get(y) == far[path[-1]] - 1), key=order.get))
    return path[::2]


@pytest.mark.parametrize("hops", [40, 6])
def test_shortest_paths_against_brute_force(spark, hops):
    rng = random.Random(hops)
    person, member = family_tree(rng, 40, 22)
    people = spark.createDataFrame(person, "ord long, pid string, name string, famc string, fams array<string>")
    members = spark.createDataFrame(member, "fam_ord long, fid string, tag string, pos int, pid string")
    asked = [(f"p{a}", f"p{b}") for a in range(0, 40, 2) for b in range(0, 40, 3)] + [("p1", "nobody"), ("p0", "p3"), ("p0", "p3")]
    got = {(r["a"], r["b"]): r["path"] for r in affinity.shortest_paths(spark.createDataFrame(asked, "a string, b string"), people, members, hops).collect()}
    want = {(a, b): p for a, b in asked if (p := brute(person, member, a, b, hops))}
    assert got == want and max(map(len, want.values())) >= 4


def test_the_side_of_few_ends_is_spread(spark, monkeypatch):
    """Many people and one end: no level holds more rows than the tree has people, so work grows with the tree alone."""
    people, rows, spread = 60, [], affinity._spread
    person = [(k, f"p{k}", f"Person {k}", None, []) for k in range(people)]
    member = [(f, f"f{f}", tag, pos, f"p{k}") for f in range(1, 20) for pos, (tag, k) in enumerate([("HUSB", f), *(("CHIL", 3 * f + i) for i in range(3))]) if k < people]
    monkeypatch.setattr(affinity, "_spread", lambda level, before, places: rows.append(level.count()) or spread(level, before, places))
    folk = spark.createDataFrame(person, "ord long, pid string, name string, famc string, fams array<string>")
    members = spark.createDataFrame(member, "fam_ord long, fid string, tag string, pos int, pid string")
    asked = [(f"p{k}", "p1") for k in range(people)]
    got = {(r["a"], r["b"]): r["path"] for r in affinity.shortest_paths(spark.createDataFrame(asked, "a string, b string"), folk, members).collect()}
    assert got == {(a, b): p for a, b in asked if (p := brute(person, member, a, b, 40))} and len(got) > 30
    assert rows[0] == 1 and max(rows) <= people


@pytest.mark.parametrize("seed", [1, 2])
def test_ancestors_descend_for_one_root_as_both_ends_climb(spark, monkeypatch, seed):
    """One person against all: the same paths as by climbs of all, while few of all climb; ages differ, so that ends are nearer and farther."""
    rng, people = random.Random(seed), 150
    kin = [(f"p{k}", f"p{p}", i) for k in range(3, people) for i, p in enumerate(rng.sample(range(max(0, k - 40), k), min(k, rng.randrange(1, 3))))]
    parents = spark.createDataFrame(kin, "child string, parent string, pos int")
    pairs = spark.createDataFrame([(a, f"p{k}") for a in ("p149", "p60") for k in range(people)], "a string, b string")
    plain, climbed = climb.closure, []
    monkeypatch.setattr(climb, "closure", lambda starts, parents, depth=20, down=False: (not down and climbed.append(starts.distinct().count())) or plain(starts, parents, depth, down=down))
    got = sorted(map(tuple, climb.common_ancestors(pairs, parents).collect()))
    assert sum(climbed) < people
    monkeypatch.setattr(climb, "MANY", people)
    assert got == sorted(map(tuple, climb.common_ancestors(pairs, parents).collect())) and len(got) > 60


def test_charts_name_each_part_once(spark):
    """A chart's expression doesn't grow by repeats of its parts, which were all computed again for each row."""
    paths = spark.createDataFrame([("a", "b", ["a", "c", "b"], "c")], "a string, b string, path array<string>, ancestor string")
    person = spark.createDataFrame([("a", "Ana"), ("b", "Bo"), ("c", "Cy"), ("d", "Di")], "pid string, name string")
    shown = render.with_people(paths, person, spark.createDataFrame([("c", "d", 0)], "pid string, spouse string, pos int"))
    chart = shown.select(render.direct_chart(*map(shown.__getitem__, ("people", "ancestor", "partner", "partner_label", "a", "b"))).alias("chart"))
    lines = ["flowchart BT", 'N_c_d["Cy &amp; Di"]', 'N_a["Ana"]', 'N_b["Bo"]', "N_a --> N_c_d", "N_b --> N_c_d", f"style N_a {render.FIRST}", f"style N_b {render.SECOND}", f"style N_c_d {render.TOP}"]
    assert chart.first()["chart"] == "\n".join(lines)
    assert chart._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 6


def made_names(rng, n, hot):
    """People of whom most bear one surname, with given names that are often close to each other."""
    out = set()
    while len(out) < n:
        given = "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 7)))
        middle = rng.choice(["", "", "prado ", "nunes ", "de lima ", "prado nunes "])
        out.add(f"{given} {middle}{hot if rng.random() < 0.7 else rng.choice(['moura', 'sa', 'silveira', 'netto'])}{rng.choice(['', '', ' filho'])}")
    return sorted(out)


@pytest.mark.parametrize("side", [8, 512])
def test_hot_surnames_against_all_pairs(spark, side):
    """The same best person as of all pairs of the pools, with cells of a few names."""
    rng = random.Random(7)
    names = made_names(rng, 260, "silva")
    rng.shuffle(names)
    people, wanted = names[:180], [*names[180:], "xisto silvano", "zeca ab", "bacada nobody", "abcdab" * 20 + " silva"]
    p = resolve.features(spark.createDataFrame([(k,) for k in people], "key string")).join(spark.createDataFrame([(k, i) for i, k in enumerate(people)], "key string, ord long"), "key")
    w = resolve.features(spark.createDataFrame([(k,) for k in wanted], "key string"))
    p, w = nearest.cut(p, "p"), nearest.cut(w, "w")
    every = resolve.best(resolve.scored(resolve.pools(w, p), w, p)).select("key", "other", "inter", "s_given", "s_token", "s_part")
    found = nearest.best_candidates(w, p, side).select("key", "other", "inter", "s_given", "s_token", "s_part")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))
    assert nearest.best_candidates(w.limit(0), p).collect() == []


def test_a_task_holds_few_names_at_once(monkeypatch):
    """Cells' names pass by some at a time, with the same best ones as of all pairs; a batch of cells isn't taken whole."""
    import pyarrow as pa

    held, strings = [], nearest.Strings
    monkeypatch.setattr(nearest, "Strings", lambda *c: held.append(sum(map(len, c))) or strings(*c))
    monkeypatch.setattr(nearest, "SOME", 50)
    monkeypatch.setattr(nearest, "HELD", 40)
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 9)))
    cells, rows, best = [("s:x", 0, 0), ("s:x", 0, 1), ("s:y", 0, 0)], [], set()
    for cell in cells:
        wanted, others = sorted({name() for _ in range(9)}), sorted({name() for _ in range(400)})
        rows += [(*cell, 0, 0, v) for v in wanted] + [(*cell, 1, 0, v) for v in others]
        for g in wanted:
            scores = [S.ratio(g, t) for t in others]
            best |= {(cell, g, t, v) for t, v in zip(others, scores, strict=True) if v == max(scores)}
    batch = pa.RecordBatch.from_pylist([dict(zip(("block", "c0", "c1", "side", "salt", "v"), r, strict=True)) for r in rows])
    got = [tuple(r.values()) for b in nearest._given(batch.slice(k, 170) for k in range(0, len(batch), 170)) for r in b.to_pylist()]
    assert sorted(got) == sorted((c[0], g, t, v) for c, g, t, v in best) and max(held) <= 60
    held.clear()
    own = pa.list_(pa.struct([("key", pa.string()), ("sorted", pa.string()), ("common", pa.int32())]))
    theirs = pa.list_(pa.struct([("other", pa.string()), ("sorted", pa.string()), ("ord", pa.int64())]))
    x, y = ([(f"{name()} x{k}", f"x{k}", 0)] * 2 for k in (1, 2))
    lists = pa.RecordBatch.from_arrays([pa.array([x] * 100, own), pa.array([y] * 100, theirs)], ["xs", "ys"])
    assert sum(len(b) for b in nearest._names([lists])) == 200 and max(held) <= 40


def test_bounds_spare_most_comparisons():
    """Of the pairs of a hot block, few are compared in full."""
    import numpy as np

    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 10))) for _ in range(400)]
    table, compared = S.Strings(names[:200], names[200:]), []

    def score(x, y):
        compared.append(len(x))
        return S.ratios(table, x, y)

    left, right = np.repeat(np.arange(200), 200), np.tile(np.arange(200), 200)
    bound = nearest._whole(table.sizes[0][left] + table.sizes[1][right], nearest._alike(nearest._bags(table), left, right))
    at, value = nearest.search(left, right, bound, score)
    full = S.ratios(table, left, right).reshape(200, 200)
    assert (full <= bound.reshape(200, 200)).all() and sum(compared) < 0.25 * len(left)
    assert sorted(zip(left[at], right[at], value, strict=True)) == sorted((i, j, full[i, j]) for i in range(200) for j in range(200) if full[i, j] == full[i].max())


def test_similarities_of_batches_equal_those_of_pairs():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé 😀") for _ in range(rng.randrange(14)))
    a = [word() for _ in range(1500)] + ["x" * 64, "ab" * 32, "b" * 65, "b" * 200, "", None, "a"]
    b = [word() for _ in range(1500)] + ["x" * 63, "ba" * 32, "b" * 64, "ab" * 90, "", "x", None]
    for work, alone in ((S._ratio_work, S.ratio), (S._partial_work, S.partial_ratio)):
        assert S._batched(work, a, b).tolist() == [-1 if x is None or y is None else alone(x, y) for x, y in zip(a, b, strict=True)]


CHART = """flowchart BT
subgraph COLUMNS
direction BT
subgraph ESQ[Ramo 1]
direction BT
subgraph ESQ_COLS
direction BT
subgraph ESQ_L[ ]
direction BT
N_b["Bia"]
end
subgraph ESQ_R[ ]
direction BT
N_a["Abel"]
end
end
N_m_p["Paulo &amp; Marta"]
N_b --> N_m_p
N_a --> N_m_p
end
subgraph DIR[Ramo 2]
direction BT
subgraph DIR_COLS
direction BT
subgraph DIR_L[ ]
direction BT
N_w["Vera"]
end
subgraph DIR_R[ ]
direction BT
N_z["Zé"]
end
end
N_q_r["Quim &amp; Rosa"]
N_w --> N_q_r
N_z --> N_q_r
end
N_a_anc[" "]
N_w_anc[" "]
style N_a_anc fill:transparent,stroke:transparent,stroke-width:0
style N_w_anc fill:transparent,stroke:transparent,stroke-width:0
N_a --- N_a_anc
N_w_anc --- N_w
N_a_anc --- |Casamento| N_w_anc
end
style N_b fill:#e8f5e9,stroke:#66bb6a,stroke-width:2px
style N_z fill:#ffebee,stroke:#ef5350,stroke-width:2px
style N_m_p fill:#fff9c4,stroke:#fbc02d,stroke-width:2px
style N_q_r fill:#fff9c4,stroke:#fbc02d,stroke-width:2px
style N_a fill:#fff8e1,stroke:#f6a821,stroke-width:2px
style N_w fill:#fff8e1,stroke:#f6a821,stroke-width:2px"""


def test_many_pairs_of_each_kind_and_a_bridge_in_full(spark):
    """Two couples' children marry: Bia's way to Zé goes through their siblings Abel and Vera."""
    people = [("p", "Paulo"), ("m", "Marta"), ("a", "Abel"), ("b", "Bia"), ("q", "Quim"), ("r", "Rosa"), ("w", "Vera"), ("z", "Zé"), ("x", "Sozinho")]
    home = {"a": "f1", "b": "f1", "w": "f2", "z": "f2"}
    wed = {"p": ["f1"], "m": ["f1"], "q": ["f2"], "r": ["f2"], "a": ["f3"], "w": ["f3"]}
    person = spark.createDataFrame([(k, i, n, home.get(i), wed.get(i, [])) for k, (i, n) in enumerate(people)], "ord long, pid string, name string, famc string, fams array<string>")
    rows = [(1, "f1", "HUSB", "p"), (1, "f1", "WIFE", "m"), (1, "f1", "CHIL", "a"), (1, "f1", "CHIL", "b"), (2, "f2", "HUSB", "q"), (2, "f2", "WIFE", "r"), (2, "f2", "CHIL", "w"), (2, "f2", "CHIL", "z"), (3, "f3", "HUSB", "a"), (3, "f3", "WIFE", "w")]
    member = spark.createDataFrame([(o, f, t, k, p) for k, (o, f, t, p) in enumerate(rows)], "fam_ord long, fid string, tag string, pos int, pid string")
    asked = [(" bia ", "ZÉ"), ("Bia", "Abel"), ("Bia", "Sozinho"), ("Bia", "nobody"), ("nobody", "Bia"), ("Zé", "Zé"), ("Paulo", "Vera"), ("Bia", "Abel")]
    got = {(r["first"], r["second"]): r for r in flows.search_paths(person, member, spark.createDataFrame(asked, "first string, second string")).collect()}
    assert len(got) == 7
    bridge = got[("bia", "ZÉ")]
    assert (bridge["text_path"], bridge["message"], bridge["person2_name"]) == ("Bia → Abel → Vera → Zé", flows.INDIRECT, "ZÉ") and bridge["mermaid_data"] == CHART
    assert (got[("Bia", "Abel")]["text_path"], got[("Bia", "Abel")]["message"]) == ("Bia → Paulo → Abel", flows.DIRECT)
    assert got[("Bia", "Sozinho")]["message"] == "Nenhuma conexão encontrada entre 'Bia' e 'Sozinho'." and got[("Bia", "Sozinho")]["success"]
    assert got[("Bia", "nobody")]["message"] == "Pessoa 2 'nobody' não encontrada." and got[("nobody", "Bia")]["message"] == "Pessoa 1 'nobody' não encontrada."
    assert got[("Zé", "Zé")]["text_path"] == "Zé" and got[("Paulo", "Vera")]["text_path"] == "Paulo → Abel → Vera"
    assert "Casamento" not in got[("Paulo", "Vera")]["mermaid_data"]  # a founder's climb to the own child fails, so there is no branch


def test_people_by_parts_of_names_against_every_name(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdAB é") for _ in range(rng.randrange(0, 9))) for _ in range(120)] + ["aaaa", "AAAA b", "Sem Nome"]
    queries = sorted({n[i : i + k] for n in names for i in (0, 2) for k in (0, 1, 2, 3, 4, 6)} | {n.upper() for n in names[:30]} | {"zzz", "aazaa", "abcd%"})
    person = spark.createDataFrame([(k, f"p{k}", n) for k, n in enumerate(names)], "ord long, pid string, name string")
    got = {}
    for r in pedigree.find_people(person, spark.createDataFrame([(q,) for q in queries], "query string")).collect():
        got.setdefault(r["query"], []).append(r["ord"])
    want = {}
    for q in queries:
        same = [k for k, n in enumerate(names) if n.lower() == q.lower()]
        want[q] = same or [k for k, n in enumerate(names) if q.lower() in n.lower()]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
