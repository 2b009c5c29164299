"""The queries of this subpackage: each applies its operator to whole tables.

What becomes of nulls, empty and very long texts, ties, repeated rows, empty
tables and other columns is stated by the operator that a query calls; a query
itself only picks columns and takes digests, row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every text: their number, places, labels and best coverage."""
    from kinloom.llm.license_scan import license_spans

    found = license_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["start"])

    def names(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again."""
    from kinloom.llm.sentencepiece_codec import decode, encode

    rows = decode(encode(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.length("decoded").cast("long").alias("decoded_chars"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))).alias("round_trip"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that stands in it."""
    from kinloom.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Scratch(spark, "op3"))


def op4_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivative records of all pages, as their files have them."""
    from kinloom.llm.warc_derive import read_derivatives, responses, write_derivatives

    found = read_derivatives(write_derivatives(responses(_table(spark, sf_dir, "pages")), Scratch(spark, "op4")))
    return found.select(
        "page_id", "type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "source_digest", "block_digest", "content_type",
        F.length("block").cast("long").alias("chars"), F.sha2("block", 256).alias("block_sha256"),
    )


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies, at 85 percent of five-word shingles."""
    from kinloom.llm.minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "op5"), percent=85)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What formatted conversations give when they are read back: turns, text under the loss mask, and digests."""
    from kinloom.llm.chat_format import format_chats, parse, under_mask

    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    chats = format_chats(rows.unionByName(own))
    chats = chats.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", under_mask(F.col("formatted"), F.col("loss_runs")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace(replace(replace(replace(replace({0}, '\\', '\\0'), '<', '\\1'), '[', '\\2'), ']', '\\3'), chr(10), '\\4')"
_CONFLICT = "regexp_matches(b, '<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|\\\\[0-4]')"
OP6_SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS b FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, 10 + length({_ESCAPED.format("r")}) + length(CASE WHEN {_CONFLICT} THEN {_ESCAPED.format("b")} ELSE b END) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(r || chr(10) || b || chr(10), '' ORDER BY turn NULLS FIRST, r, b)) AS turns_sha256,
    CAST(coalesce(sum(length(b)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(b, '' ORDER BY turn NULLS FIRST, r, b) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors with a cosine of 0.95 or more."""
    from kinloom.llm.embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"), threshold=0.95)


def op8_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids as the shard files have them: where they start, how many, and their checksum."""
    from kinloom.llm.repair_store import read_shards, write_shards

    return read_shards(write_shards(_table(spark, sf_dir, "documents"), Scratch(spark, "op8")))


def _fold(column, parts: int, held: int):
    """Whether the key's crc32 falls into the held-out fold."""
    return F.coalesce(F.crc32(column.cast("string")) % parts == held, F.lit(False))


def _classified(spark: SparkSession, sf_dir: str, operator, parts: int, held: int) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = operator(docs, _table(spark, sf_dir, "labels"), docs, lambda key: ~_fold(key, parts, held))
    return out.select("doc_id", _fold(F.col("doc_id"), parts, held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores, learnt outside the fold of remainder 0 of 5."""
    from kinloom.llm.quality_knn import quality_scores

    return _classified(spark, sf_dir, quality_scores, 5, 0)


def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores, learnt outside the fold of remainder 2 of 4."""
    from kinloom.llm.toxicity_fm import toxicity_scores

    return _classified(spark, sf_dir, toxicity_scores, 4, 2)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations: nodes with members, children, leaves, savings and who ends there."""
    from kinloom.llm.conversation_trie import ends_digests, prefix_trie, shared_heads

    nodes, ends = prefix_trie(_table(spark, sf_dir, "conversations"), Scratch(spark, "op11"), shared_heads)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    own = F.sha2(F.when(F.col("n_children") == 0, F.col("conv_id").cast("string")).otherwise(""), 256)
    single = nodes.where("single").select(*columns, own.alias("ends_sha256"))
    many = nodes.where("NOT single").join(ends_digests(ends), ["conv_id", "depth"], "left")
    return single.unionByName(many.select(*columns, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


OP11_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY i) AS ts FROM turns GROUP BY conv_id),
steps AS (SELECT *, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS bits FROM own),
crc AS (SELECT conv_id, ts, xor(4294967295, list_reduce(list_prepend(4294967295, bits), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) % 6 AS h FROM steps),
again AS (
    SELECT c.conv_id, list_concat(coalesce(o.ts[1 : c.h], c.ts[1 : 0]), c.ts[c.h + 1 :]) AS ts FROM crc c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100
), member AS (
    SELECT conv_id, d, sha256(CAST(to_json(ts[1 : d]) AS VARCHAR)) AS k, length(ts[d].x) AS chars, len(ts) = d AS ended FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM again)
), node AS (SELECT d, k, min(conv_id) AS rep, count(*) AS n, any_value(chars) AS chars FROM member GROUP BY d, k),
way AS (SELECT member.conv_id, d, ended, rep FROM member JOIN node USING (d, k)),
up AS (SELECT node.*, way.rep AS parent FROM node LEFT JOIN way ON way.conv_id = node.rep AND way.d = node.d - 1),
kids AS (SELECT parent AS rep, d - 1 AS d, count(*) AS c FROM up WHERE d > 0 GROUP BY parent, d),
sums AS (
    SELECT way.rep, way.d, count(*) FILTER (WHERE kids.c IS NULL) AS leaves, sum(CASE WHEN m.d = 0 THEN 0 ELSE (m.n - 1) * m.chars END) AS saved
    FROM node m LEFT JOIN kids ON kids.rep = m.rep AND kids.d = m.d JOIN way ON way.conv_id = m.rep AND way.d <= m.d GROUP BY way.rep, way.d
), ends AS (SELECT rep, d, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM way WHERE ended GROUP BY rep, d)
SELECT up.rep AS conv_id, up.d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(c, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
    sha256(coalesce(ids, '')) AS ends_sha256
FROM up JOIN sums ON sums.rep = up.rep AND sums.d = up.d LEFT JOIN kids ON kids.rep = up.rep AND kids.d = up.d LEFT JOIN ends ON ends.rep = up.rep AND ends.d = up.d
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens by two tokenizers, cut into groups where both end, with the links' corpus-wide counts."""
    from kinloom.llm.token_alignment import align_documents

    found = align_documents(_table(spark, sf_dir, "documents"), Scratch(spark, "op12"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's byte-level BPE ids and of what they decode to; null and empty texts have no ids."""
    from kinloom.llm.byte_bpe import decode, encode

    ids = encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return decode(ids).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1_sql() -> str:
    """Pairs of words of texts and templates by position, gathered by diagonal; loose templates' near diagonals are one span."""
    from kinloom.llm.license_scan import COVER, NEAR, templates

    known = ", ".join(f"({i}, '{label}', {exact}, {words!r})" for i, (words, label, exact) in enumerate(templates()))
    return f"""
WITH template(tid, label, exact, words) AS (VALUES {known}),
tg AS (SELECT tid, label, exact, len(words) - 1 AS need, i - 1 AS nth, words[i] || ' ' || words[i + 1] AS w FROM (SELECT *, unnest(range(1, len(words))) AS i FROM template)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
g AS (SELECT rid, i - 1 AS place, ws[i] || ' ' || ws[i + 1] AS w FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM d)),
h AS (SELECT DISTINCT rid, tid, label, exact, need, place - nth AS diagonal, nth FROM g JOIN tg USING (w)),
line AS (SELECT rid, tid, label, exact, need, diagonal, count(*) AS votes FROM h GROUP BY ALL),
step AS (SELECT rid, tid, diagonal, CASE WHEN diagonal - lag(diagonal) OVER own > {NEAR} THEN 1 ELSE 0 END AS apart FROM line WHERE NOT exact WINDOW own AS (PARTITION BY rid, tid ORDER BY diagonal)),
grouped AS (SELECT rid, tid, diagonal, sum(apart) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS part FROM step),
span AS (
    SELECT rid, label, true AS exact, diagonal AS start, 1.0::DOUBLE AS coverage FROM line WHERE exact AND votes = need
    UNION ALL SELECT rid, label, false, NULL, count(DISTINCT nth) / any_value(need) FROM h JOIN grouped USING (rid, tid, diagonal) WHERE NOT exact GROUP BY rid, tid, label, part
        HAVING count(DISTINCT nth) / any_value(need) >= {COVER}),
found AS (
    SELECT rid, count(*) FILTER (WHERE exact) AS n_base, min(start) AS first_word, max(start) AS last_word, max(coverage) AS score,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM span GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (rid)
"""


_REACH = """reach AS (SELECT a AS node, a AS seen FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen),
least AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)"""
OP5_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.w = y.w AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common c JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN least ON node = d.doc_id
"""
OP7_SQL = f"""
WITH RECURSIVE good AS MATERIALIZED (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) ON a = vec_id LEFT JOIN least ON node = vec_id
"""

QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_sentencepiece, op3_decontaminate, op4_warc_derive, op5_minhash_dedup, op6_chat_format, op7_embedding_dedup, op8_repair_tokens, op9_quality_knn, op10_toxicity_fm, op11_conversation_trie, op12_token_alignment, op13_byte_bpe)
}
ORACLES: dict[str, str] = {"op1_license_scan": _op1_sql(), "op5_minhash_dedup": OP5_SQL, "op6_chat_format": OP6_SQL, "op7_embedding_dedup": OP7_SQL, "op11_conversation_trie": OP11_SQL}
