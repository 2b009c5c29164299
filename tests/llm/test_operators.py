"""The corpus operators against brute force, on small tables with all kinds of odd rows."""

import gzip
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("kinloom.llm")

from kinloom.llm import chat_format, decontaminate, embedding_dedup, license_scan, minhash_dedup, quality_knn, repair_store, sentencepiece_codec, toxicity_fm, warc_derive  # noqa: E402
from kinloom.llm.graph import components  # noqa: E402
from kinloom.llm.scratch import Scratch  # noqa: E402

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, cid long, score double, comp string, ids string, spans string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1, 0.5, "x", "y", "z") for i, t in texts], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (6, "One  TWO"), (7, "one"), (None, "one two"), (8, "word " * 30_000)]
    base = prose(rng, 120).split()
    out += [(100, " ".join(base)), (100, " ".join(base))]
    for i in range(101, 160):  # near copies around a base, some within the threshold and some not
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(9)}"
        out.append((i, " ".join(own)))
    return out + [(i, prose(rng, rng.randrange(1, 60))) for i in range(200, 260)]


def linked(texts, percent):
    sets, parent = {}, {}
    for i, t in texts:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
            parent[i] = i

    def top(x):
        return x if parent[x] == x else top(parent[x])

    keys = list(sets)
    for x in keys:
        for y in keys:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in keys}


@pytest.mark.parametrize("small", [64, 4])
def test_minhash(spark, texts, monkeypatch, small):
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "BLOCK", small)
    got = minhash_dedup.near_duplicates(documents(spark, texts), Scratch(spark, "t"), percent=85).collect()
    want = linked(texts, 85)
    assert len(got) == len(texts)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == {(i, n, c, c == i) for i, (n, c) in want.items()}
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert minhash_dedup.near_duplicates(documents(spark, []), Scratch(spark, "t")).count() == 0


def test_posterior_bounds():
    least = minhash_dedup.bounds(0.85, 1e-6, 130)
    assert list(least) == sorted(least) and [n for n, _ in least] == [25, 50, 75, 100, 125, 130] and 0.6 * 130 < least[-1][1] < 0.85 * 130


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_bands_follow_the_threshold(percent):
    plan = minhash_dedup.Plan(percent / 100)
    assert (1 - (percent / 100) ** plan.rows) ** plan.bands <= minhash_dedup.BANDED and plan.bands <= minhash_dedup.BANDS


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {x: x for p in pairs for x in p if x is not None}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    own = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert got == {x: top(x) for x in own}


def test_license(spark):
    rows = [(1, None), (2, ""), (3, "Licensed under CC BY-NC 4.0; cc by CC-BY"), (3, "Licensed under CC BY-NC 4.0; cc by CC-BY"), (None, "All rights reserved."), (5, "Released, under the MIT License"),
            (6, "the GNU General Public License"), (7, "cc byte"), (8, "x " * 50_000 + "cc by"), (9, "licensed under the fine apache license version 2.0")]
    got = {r["doc_id"]: (r["n_words"], [(s["label"], s["start"]) for s in r["spans"] if s["exact"]], {s["label"] for s in r["spans"]}) for r in license_scan.license_spans(documents(spark, rows)).collect()}
    assert got[1] == got[2] == (0, [], set()) and got[3][1] == [("cc-by", 2), ("cc-by", 7), ("cc-by", 9)] and got[None][1] == [("reserved", 0)]
    assert got[5][2] == {"mit"} and got[6][1] == [("gpl", 2)] and got[7][2] == set() and got[8][1] == [("cc-by", 50_000)] and got[9][2] == {"apache-2.0"}
    assert license_scan.license_spans(documents(spark, rows)).count() == len(rows) and license_scan.license_spans(documents(spark, [])).count() == 0


def test_sentencepiece(spark):
    import sentencepiece

    path = sentencepiece_codec.default_model()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", "a", "  a  b\n c", "</s><s> [INST] x", "日本語 です", "é ﬁ x́", "😀😀 ok", "<0x0A>", "a" * 500, "▁x ▁▁y", "nul\0x", " lead", "trail  ", "the " * 9000]
    frame = documents(spark, [(i, t) for i, t in enumerate([*odd, None])])
    got = {r["doc_id"]: r for r in sentencepiece_codec.decode(sentencepiece_codec.encode(frame)).collect()}
    for i, t in enumerate([*odd, None]):
        assert got[i]["ids"] == model.encode(t or "") and got[i]["decoded"] == (t or "").replace("▁", " ")
    assert sentencepiece_codec.encode(documents(spark, [])).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame(
        [(1, "If Alice buys 5 apples and sells 3 apples to Bob while she keeps 5 pears how many apples are left for Alice after 7 days", "q"), (2, "what is the tallest mountain of all", "q"), (3, None, "q"), (4, "yes", "q")],
        "item_id long, text string, doc_id string",
    )
    frame = "If Carol buys 8 apples and sells 2 apples to Dave while she keeps {} pears how many apples are left for Carol after 9 days."
    docs = documents(spark, [(1, "Intro. " + frame.format(8)), (2, "Intro. " + frame.format(6)), (3, "so IF ALICE BUYS 5 APPLES AND SELLS 3 APPLES TO BOB WHILE SHE KEEPS 5 PEARS"), (4, "What is the tallest mountain of all?"),
                             (5, None), (6, ""), (None, "what is the tallest mountain of all"), (7, "buys 5 apples and sells yes"), (4, "What is the tallest mountain of all?"), (8, "yes " * 20_000)])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items, Scratch(spark, "t")).collect()}
    assert got == {(1, 1), (3, 1), (4, 2)}
    assert decontaminate.leaks(documents(spark, []), items, Scratch(spark, "t")).count() == 0
    assert decontaminate.leaks(docs, items.limit(0), Scratch(spark, "t")).count() == 0


def test_decontamination_of_literal_copies(spark):
    """Copies whose capitals or crowded numbers hide the template, and values that stay beside their slots."""
    digits = "the digits are " + " ".join(str(7 * i) for i in range(30))
    items = spark.createDataFrame([(1, "every morning the old baker of the village sells fresh bread to his many neighbours", ""), (2, digits, ""),
                                   (3, "so then McDonald saw Alice run 5 % Berlin while Alice went home with Bob and a very old grey dog", "")], "item_id long, text string, doc_id string")
    docs = documents(spark, [(1, "every Morning the Old baker of The Village Sells fresh Bread to His many Neighbours"), (2, "Here: " + digits), (3, "the digits are " + " ".join(str(3 * i + 1) for i in range(30))),
                             (4, "so then McDonald saw Carol run 9 % London while Carol went home with Dave and a very old grey dog"),
                             (5, "so then McDonald saw Carol run 9 % London while Erin went home with Dave and a very old grey dog")])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items, Scratch(spark, "t")).collect()}
    assert got == {(1, 1), (2, 2), (4, 3)}


def test_decontamination_of_crowded_slots(spark):
    """Numbers stand close together: most of a window's words, or all, are placeholders; chance likeness is refused."""
    ten = lambda k: ", ".join(str(k + 3 * i) for i in range(15))
    items = spark.createDataFrame([(1, "John ran 5 km in 20 minutes and 7 km in 30 minutes", ""), (2, "so we add up the " + ten(1), ""), (3, "we ran 4 km in 9 minutes", "")], "item_id long, text string, doc_id string")
    docs = documents(spark, [(1, "John ran 6 km in 25 minutes and 9 km in 35 minutes"), (2, "now: so we add up the " + ten(50)), (3, "John ran 6 km in 25 minutes and 9 km in 25 minutes"), (4, "we ran 6 km in 8 minutes"),
                             (5, ten(2) + " " + ten(3)), (6, "he swam 6 km in 25 minutes and 9 km in 35 minutes"), (7, "John ran 5 km in 20 minutes and 20 km in 30 minutes"), (8, "so we add up the " + ten(50).replace("53", "50"))])
    twice = spark.createDataFrame([(4, "John ran 5 km in 20 minutes and 20 km in 30 minutes", "")], items.schema)
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.leaks(docs, items.unionByName(twice), Scratch(spark, "t")).collect()}
    assert got == {(1, 1): 13, (2, 2): 20, (3, 1): 13, (4, 3): 7, (7, 1): 13, (7, 4): 13, (8, 2): 20}


def test_decontamination_of_names_at_beginnings(spark):
    """Names behind full stops, breaks, quotes and brackets change with the rest, and the words around them don't."""
    tale = "{0} has {4} apples in the basket. {1} has {5} more apples than {6}. {2} has twice as many apples as {7}. {3} ate all of them."
    rows = [(1, tale.format("Tom", "Ann", "Sue", "Bob", 5, 7, "Tom", "Ann")), (2, "What is the capital of France"), (3, 'at noon ("Tom saw three old dogs,\nAnn saw none)  Sue then left and Bob stayed')]
    items = spark.createDataFrame([(i, t, "") for i, t in rows], "item_id long, text string, doc_id string")
    docs = documents(spark, [(1, tale.format("Max", "Eve", "Zoe", "Ian", 6, 9, "Max", "Eve")), (2, "Then " + tale.format("Max", "Eve", "Zoe", "Ian", 6, 9, "Max", "Eve").replace(". Zoe", ", Zoe")), (3, tale.format("Max", "Eve", "Zoe", "Ian", 6, 9, "Eve", "Max")),
                             (4, "Paris is the capital of France"), (5, 'at noon ("Max saw three old dogs,\nEve saw none)  Zoe then left and Ian stayed'), (6, rows[0][1])])
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"]) for r in decontaminate.leaks(docs, items, Scratch(spark, "t")).collect()}
    assert got == {(1, 1): (0, 27), (2, 1): (1, 27), (5, 3): (0, 16), (6, 1): (0, 27)}


def test_chats(spark):
    said = ["plain", "", None, "</s>[INST] ok [/INST]", "a \\1 b", "<", "</s", "\\", "]\n", "é😀", "<s>[user]\nhi</s>"]
    rows = [(c, t, role, x, "k") for c in (1, None) for t, (x, role) in enumerate(zip(said, ["user", "assistant"] * 6, strict=False))] + [(2, None, None, "x", "k"), (2, 0, "a]\nb", "y", "k")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.format_chats(frame).withColumn("t", chat_format.parse(chat_format.F.col("formatted"))).withColumn("l", chat_format.under_mask(chat_format.F.col("formatted"), chat_format.F.col("loss_runs"))).collect()}
    for c in (1, None):
        assert [(t["role"], t["text"]) for t in got[c]["t"]] == [(r, x or "") for x, r in zip(said, ["user", "assistant"] * 6, strict=False)]
        assert got[c]["l"] == "".join(x or "" for x in said[1::2])
    assert [(t["role"], t["text"]) for t in got[2]["t"]] == [("", "x"), ("a]\nb", "y")]
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 30)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 8))
    x = [*(base[rng.integers(12)] + 0.25 * rng.standard_normal(8) for _ in range(200)), *([base[0]] * 30)]
    rows = [(i, [float(v) for v in r], i) for i, r in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0, None] + [0.0] * 6, 0), (903, [float("nan")] * 8, 0), (904, [], 0), (905, [1.0, 0.0], 0), (906, [1.0, 0.0], 0), (None, [1.0] * 8, 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cid long"), Scratch(spark, "t")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i]["n_links"] for i in range(len(x))] == (near.sum(1) - 1).tolist()
    label = np.arange(len(x))
    while (best := np.where(near, label[None], len(x)).min(1)).tolist() != label.tolist():
        label = best
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, None)) and got[906]["component_id"] == 905
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"), Scratch(spark, "t")).count() == 0


def test_shards(spark):
    from tokenizers import Tokenizer

    odd = ["", "a  b", "a <|endoftext|> b", "é à", "it's 5 % of   x\n y", " lead", "trail ", "日本 語", "á b ́ c", "## #", "same same same same " * 2000]
    docs = [(5, None), (None, "x"), (5, "again"), *enumerate(odd)]
    manifest = repair_store.write_shards(documents(spark, docs), Scratch(spark, "t"), shard_bytes=4000)
    got = sorted(repair_store.read_shards(manifest).collect(), key=lambda r: r["start"])
    model = Tokenizer.from_file(repair_store.default_tokenizer())
    want = sorted((zlib.crc32(np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()), -1 if i is None else i) for i, t in docs)
    assert sorted((r["ids_crc32"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got) == want
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys) and [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    ids = np.concatenate([np.tile([5, 5, 5, 7, 9], 300), [2], np.random.default_rng(0).integers(3, 9, 5000), [2], [2]])
    shard = repair_store.Shard.of(repair_store.pack(pa.array([1, None, 3]), ids, np.array([0, 1501, 6502, 6503]), 100))
    assert shard.n_symbols < 0.7 * len(ids) and (repair_store.expand(shard.symbols(), shard.rules, shard.first) == ids).all() and len(shard.document(2)) == 1
    for a, n in ((0, 10), (1490, 30), (3000, 1), (6503, 0), (1500, 1), (0, 6503)):
        assert (shard.stretch(a, n) == ids[a : a + n]).all()
    one = manifest.orderBy("shard").first()
    asked = []
    with open(one["file"].removeprefix("file://"), "rb") as file:
        data = file.read()
    part = repair_store.Shard(lambda n, at: asked.append(n) or data[at : at + n])
    assert (repair_store.read_stretch(one["file"], 1, 2) == part.stretch(1, 2)).all() and asked[-1] < 4 * part.n_symbols
    assert repair_store.read_shards(repair_store.write_shards(documents(spark, []), Scratch(spark, "t"))).count() == 0


def test_any_ids_come_back():
    rng = np.random.default_rng(0)
    for _ in range(200):
        ids = np.repeat(rng.integers(0, rng.integers(2, 9), rng.integers(0, 200)), rng.integers(1, 9))
        first = int(rng.choice([20, 65_530, 70_000]))
        symbols, rules, lengths = repair_store.compress(ids, first)
        assert (repair_store.expand(symbols, rules, first) == ids).all() and len(lengths) == len(rules)


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    words = [rng.integers(3, 3000, rng.integers(2, 9)) for _ in range(4000)]
    ids = np.concatenate([np.append(words[k], 2) if k % 9 == 0 else words[k] for k in rng.zipf(1.2, 200_000) % 4000])
    symbols, rules, _ = repair_store.compress(ids, 3000)
    pairs, count = np.unique(np.stack([symbols[:-1], symbols[1:]])[:, (symbols[:-1] != 2) & (symbols[1:] != 2)], axis=1, return_counts=True)
    assert count.max() < repair_store.LEAST and (repair_store.expand(symbols, rules, 3000) == ids).all()


def test_warc(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>again", "r"), (2, None, None, "r"), (None, "u", "", "r"), (1, "http://a/\r\nX: y", "<title>T</title><script>var t='</p>'</script><p>a &amp; b<br>c<!-- no --></p>", "r"),
             (1, "http://a/\r\nX: y", "<p>again", "r"), (3, "u", "x" * 3_000_000, "r")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, record string")
    got = warc_derive.read_derivatives(warc_derive.write_derivatives(warc_derive.responses(frame), Scratch(spark, "t"))).collect()
    assert len(got) == len({r["record_id"] for r in got}) == 2 * len(pages) and len({r["refers_to"] for r in got}) == len(pages)
    texts = sorted(r["block"] for r in got if r["type"] == "conversion" and r["page_id"] == 1)
    assert texts == ["T\na & b\nc", "again", "again"]
    by = {r["record_id"]: r for r in got}
    assert all(by[r["concurrent_to"]]["refers_to"] == r["refers_to"] and by[r["concurrent_to"]]["source_digest"] == r["source_digest"] for r in got)
    assert {r["target_uri"] for r in got if r["page_id"] == 1} == {"http://a/%0D%0AX: y"} and {r["target_uri"] for r in got if r["page_id"] == 2} == {None}
    assert warc_derive.read_derivatives(warc_derive.write_derivatives(warc_derive.responses(frame.limit(0)), Scratch(spark, "t"))).count() == 0


def test_responses_keep_what_the_crawler_said(spark, tmp_path):
    """Record ids, dates, header sets, digests and encodings of two responses, from files and from a table."""
    page = "<p>caf\xe9".encode("latin-1")
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (gzip.compress(b"<b>packed</b> and "), )) + b"0\r\n\r\n"
    heads = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nServer: one\r\nSet-Cookie: a\r\nSet-Cookie: b", b"HTTP/1.0 404 Not Found\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX-Two:  z"]
    sent = [("<urn:uuid:11111111-1111-1111-1111-111111111111>", "2020-02-02T02:02:02Z", "http://one/", heads[0], page, "sha1:OWN"), ("<urn:uuid:22222222-2222-2222-2222-222222222222>", "2021-01-01T00:00:00Z", "http://two/", heads[1], chunks, None)]
    made = [warc_derive.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x>")], b"software: x\r\n")]
    made += [warc_derive.record([("WARC-Type", "response"), ("WARC-Record-ID", i), ("WARC-Date", d), ("WARC-Target-URI", u), ("WARC-Payload-Digest", g)], h + b"\r\n\r\n" + p) for i, d, u, h, p, g in sent]
    (tmp_path / "plain.warc").write_bytes(b"".join(made))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in made))
    files = spark.createDataFrame([(f"file://{tmp_path}/plain.warc",), (f"file://{tmp_path}/packed.warc.gz",), (None,)], "file string")
    got = warc_derive.read_derivatives(warc_derive.write_derivatives(warc_derive.read_responses(files), Scratch(spark, "t"))).collect()
    assert len(got) == 8
    for i, d, u, h, p, g in sent:
        own = [r for r in got if r["refers_to"] == i]
        assert len(own) == 4 and {(r["date"], r["target_uri"], r["source_digest"]) for r in own} == {(d, u, g or warc_derive.digest(p))}
    about = {r["block"] for r in got if r["type"] == "metadata" and "one" in r["target_uri"]}
    assert len(about) == 1 and "source-http-Server: one\r\nsource-http-Set-Cookie: a\r\nsource-http-Set-Cookie: b\r\n" in about.pop()
    assert {r["block"] for r in got if r["type"] == "conversion"} == {"caf\xe9", "packed and"}
    table = spark.createDataFrame([(7, "u", "<p>x", "<urn:own>", "2019-01-01T00:00:00Z", "HTTP/1.1 203 Z\r\nServer: s", "sha1:D"), (8, "u", "<p>x", None, None, None, None)], "page_id long, url string, html string, i string, d string, h string, g string")
    rows = warc_derive.read_derivatives(warc_derive.write_derivatives(warc_derive.responses(table, own_id="i", date="d", http="h", payload_digest="g"), Scratch(spark, "t"))).collect()
    assert {(r["refers_to"], r["date"], r["source_digest"]) for r in rows if r["page_id"] == 7} == {("<urn:own>", "2019-01-01T00:00:00Z", "sha1:D")}
    assert {r["date"] for r in rows if r["page_id"] == 8} == {warc_derive.DATE} and any("source-http-Server: s" in r["block"] for r in rows)


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p>Intro</p><svg-icon name="x"></svg-icon><p>Main text</p>', "Intro\nMain text"),
        ("<p>a</p><template-x>kept</template-x><script-y>too</script-y><style-z/><p>b</p>", "a\nkepttoo\nb"),
        ('<svg width="1"/><p>Main</p>', "Main"),
        ('<svg aria-label="a>b" /><p>Main</p><svg><text>no</text><svg/><svg>no</svg>no</svg>end', "Main\nend"),
        ("<p>a</p><svg><p>b</p>", "a\nb"),
        ("<p>a</p><template><p>b</p><noscript>c", "a\nb\nc"),
        ("a</svg>b<TEMPLATE x>no<template>no</template>no</Template >c<noscript>no</noscript>d", "a b c d"),
        ("a<script>var t='<svg>'</script>b<!-- <template> -->c<style>x", "a b c"),
        ("<svg title=it's>no</svg>don't<p>b</p>", "don't\nb"),
        ("a<script>no", "a"),
        ("a<!-- no", "a"),
        ("a<svg width='1'", "a"),
    ],
)
def test_elements_that_drop_out_of_a_page(page, text):
    assert warc_derive.plain_text(page) == text


@pytest.mark.parametrize("operator, good, bad", [(quality_knn.quality_scores, "plain words of a text", "a### b%%% c$$$"), (toxicity_fm.toxicity_scores, "you idiot of a", "words of a text")])
def test_classifiers(spark, operator, good, bad):
    rng = random.Random(3)
    made = [(i, " ".join([*(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(20)), *(good if i % 2 else bad).split(), *(good if i % 2 else bad).split()])) for i in range(400)]
    docs = documents(spark, [*made, (900, None), (901, ""), (None, "x"), (5, made[5][1]), (902, "long text " * 20_000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (900, None), (901, 7)], "doc_id long, quality int").withColumn("toxic", quality_knn.F.col("quality"))
    learn = lambda key: key % 4 != 0
    got = operator(docs, labels, docs, learn).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 400)
    assert operator(docs.limit(0), labels, docs, learn).count() == 0
    assert {r["score"] for r in operator(docs, labels.limit(0), docs, learn).collect()} == {0.5}


@pytest.mark.parametrize("together", [False, True])
def test_toxicity_learns_pairs(spark, monkeypatch, together):
    """Labels that say whether exactly one of two words is there, or both are: factors tell what weights alone can't."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        own = [f"word{rng.randrange(300)}" for _ in range(25)] + ["zebra"] * a + ["quokka"] * b
        rows.append((i, " ".join(rng.sample(own, len(own))), int(a and b if together else a != b)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = data.select("doc_id", "text"), data.select("doc_id", "toxic")

    def right():
        scores = toxicity_fm.toxicity_scores(docs, labels, docs, lambda key: key % 4 != 2).where("doc_id % 4 = 2").collect()
        return sum((r["score"] >= 0.5) == rows[r["doc_id"]][2] for r in scores) / len(scores)

    assert right() >= 0.95
    if not together:
        monkeypatch.setattr(toxicity_fm, "FACTORS", 0)
        assert right() < 0.8


def test_toxicity_scores_are_the_machine_of_their_model(spark):
    """Scores recomputed from the model, term by term and pair by pair."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "idiots", "foolish"]) for _ in range(rng.randrange(0, 9)))) for i in range(200)]
    docs = documents(spark, [*rows, (None, None)])
    labels = spark.createDataFrame([(i, int("idiots" in t or "foolish" in t)) for i, t in rows], "doc_id long, toxic int")
    model = toxicity_fm.fit(docs, labels, lambda key: key % 4 != 2)
    for r in quality_knn.scored(docs, model, toxicity_fm.judge).collect():
        data = (r["text"] or "").encode()
        words = {w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.decode().translate(LOW))}
        names = {(w, 0) for w in words} | {(w[:n], k) for w in words for k, n in ((1, 4), (2, 5), (3, 6)) if len(w) > n}
        keys = {(toxicity_fm.K.hash_of(w) + int(toxicity_fm._SALT[k])) % 2**64 & ~3 | k for w, k in names}
        own = [i for i, key in enumerate(model["table"].keys.tolist()) if key in keys]
        value = model["bias"] + sum(model["w"][i] for i in own) + sum(float(model["v"][i] @ model["v"][j]) for i in own for j in own if i < j)
        assert abs(r["score"] - 1 / (1 + np.exp(-value))) < 1e-9


def test_quality_votes_are_those_of_all_cosines(spark):
    """Every document's cosine to each labelled vector, sorted in full."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum,", "DOLOR", "sit%%", "amet.", "9x"]) for _ in range(rng.randrange(0, 30)))) for i in range(150)]
    docs = documents(spark, [*rows, (None, None)])
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels, lambda key: key % 5 != 0)
    assert len(model["labels"]) == sum(i % 5 != 0 for i, _ in rows)
    for r in quality_knn.scored(docs, model, quality_knn.vote).collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        z = quality_knn.weigh(quality_knn.counts(data, np.array([0, len(data)])), model["idf"])[0] @ model["axes"]
        cos = model["vectors"] @ (z / max(float(np.sqrt((z * z).sum())), 1e-9))
        best = sorted(cos.tolist(), reverse=True)
        if not data.size or best[quality_knn.NEIGHBOURS - 1] - best[quality_knn.NEIGHBOURS] < 1e-6:
            continue  # no terms, or a tie at the edge of the neighbourhood
        near = np.argsort(-cos)[: quality_knn.NEIGHBOURS]
        weight = np.maximum(cos[near], 0).astype(np.float64) ** quality_knn.SHARP
        assert abs(r["score"] - (weight * model["labels"][near]).sum() / weight.sum()) < 1e-4


def test_the_pipeline_keeps_columns_and_takes_effect(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    clean = corpus_pipeline.decontaminated(spark, docs, sf)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    assert [f for _, f in corpus_pipeline.STAGES][0] is corpus_pipeline.quality and len(corpus_pipeline.STAGES) == 5


def test_the_sample_bounds_rows_however_often_a_key_is_repeated(spark):
    from pyspark.sql import functions as F

    from kinloom.llm.quality_knn import taught

    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    once = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string")
    learn = lambda key: key >= 0
    copies = taught(once.crossJoin(spark.range(40)), labels, "quality", learn, 100).collect()
    assert sorted((r.doc_id, r.label, r.text) for r in copies) == [(k, k % 2, f"text {k}") for k in range(100)]
    hot = once.where("doc_id = 7").crossJoin(spark.range(5000)).withColumn("text", F.concat("text", F.lit(" "), F.col("id")))
    assert 50 < taught(hot, labels, "quality", learn, 100).count() < 200
    assert taught(once.union(once), labels, "quality", learn, 500).count() == 200


def test_copies_of_a_text_add_no_terms(spark):
    """Ten copies under keys of their own: a word of one text stands in one row, not in ten, and isn't kept."""
    rng = random.Random(8)
    rows = [(i, " ".join([f"word{rng.randrange(300)}" for _ in range(10)] + [f"only{i}"] + ["idiot"] * (i % 10 == 0))) for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    many, tens = (f.crossJoin(spark.range(10)).withColumn("doc_id", quality_knn.F.expr("doc_id + 400 * id")).drop("id") for f in (docs, labels))
    one, ten = (toxicity_fm.fit(d, t, lambda key: key >= 0) for d, t in ((docs, labels), (many, tens)))
    assert len(one["table"].keys) and one["table"].keys.tolist() == ten["table"].keys.tolist()


def test_pairs_of_many_terms_are_weighed_in_little_memory():
    """500 weak words beside 60 000 terms, of which two tell the labels together: their table was 240 MB."""
    import tracemalloc

    rng = np.random.default_rng(2)
    rows, term = np.repeat(np.arange(2000), 30), rng.integers(2, 60_000, 60_000)
    ends = rng.random((2000, 2)) < 0.5
    y = (ends[:, 0] ^ ends[:, 1]).astype(float)
    both = np.unique(np.concatenate([rows * 60_000 + term, *(np.flatnonzero(ends[:, k]) * 60_000 + k for k in (0, 1))]))
    weak = np.arange(60_000) < 500
    tracemalloc.start()
    kept = toxicity_fm.allied(both // 60_000, both % 60_000, y, weak)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept[:2].all() and kept[2:500].sum() < 50 and kept[500:].all() and peak < 40e6
