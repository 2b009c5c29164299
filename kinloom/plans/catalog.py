"""All queries over the driver's tables, with their SQL twins.

The tables hold no trees or matches, so roles are mapped onto them: customers and
suppliers are people (customer f and supplier f mod n are the parents of the
customers 4f to 4f + 3), parts give names, and line items are DNA segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import names as N
from kinloom.functions.kinship import BANDS, UNKNOWN, relationships
from kinloom.functions.similarity import indel_ratio, partial_indel_ratio, token_sort_ratio
from kinloom.operators import affinity, climb, pedigree, render, resolve
from kinloom.plans import flows
from kinloom.session import cut
from kinloom.sources.matches import Roles, aggregate_matches, id_shares

FLAGSHIP = "dna_analysis_results"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer, part = _t(spark, sf_dir, "customer").select("c_custkey", "c_name"), _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), "p_name")
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = supplier.count()
    f = F.floor(F.col("c_custkey") / 4)
    own = customer.where("c_custkey >= 4").groupBy(f.alias("f")).agg(F.count("*"))
    wives = own.groupBy((F.col("f") % n).alias("s_suppkey")).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: F.concat(F.lit("F"), x.cast("string"))).alias("fams"))
    men = customer.join(part, "c_custkey", "left").join(own.select(F.col("f").alias("c_custkey"), F.array(F.concat(F.lit("F"), F.col("f").cast("string"))).alias("fams")), "c_custkey", "left")
    none = F.array().cast("array<string>")
    men = men.select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("pid"), N.display_name(F.coalesce("p_name", "c_name")).alias("name"),
        F.when(F.col("c_custkey") >= 4, F.concat(F.lit("F"), f.cast("string"))).alias("famc"), F.coalesce("fams", none).alias("fams"),
    )
    women = supplier.join(wives, "s_suppkey", "left").select(
        (F.col("s_suppkey") + 1_000_000_000).alias("ord"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("pid"), N.display_name(F.col("s_name")).alias("name"),
        F.lit(None).cast("string").alias("famc"), F.coalesce("fams", none).alias("fams"),
    )
    fid = F.concat(F.lit("F"), F.col("f").cast("string"))
    couples = own.select(
        F.col("f").alias("fam_ord"), fid.alias("fid"),
        F.explode(F.array(F.struct(F.lit("HUSB").alias("tag"), F.lit(0).alias("pos"), F.concat(F.lit("C"), F.col("f").cast("string")).alias("pid")), F.struct(F.lit("WIFE").alias("tag"), F.lit(1).alias("pos"), F.concat(F.lit("S"), (F.col("f") % n).cast("string")).alias("pid")))).alias("m"),
    ).select("fam_ord", "fid", "m.tag", "m.pos", "m.pid")
    kids = customer.where("c_custkey >= 4").select(f.alias("f"), "c_custkey").select(
        F.col("f").alias("fam_ord"), fid.alias("fid"), F.lit("CHIL").alias("tag"), (F.col("c_custkey") % 4 + 2).cast("int").alias("pos"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("pid")
    )
    return men.unionByName(women), couples.unionByName(kids)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_quantity")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return line.join(part, "p_partkey").select("p_name", "p_brand", "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("row_ord"))


_ROLES = Roles("p_name", "l_quantity", "p_brand", None)


def _last_customer(spark: SparkSession, sf_dir: str) -> int:
    return _t(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]


def segment_sum_by_group_key(spark, sf_dir):
    return aggregate_matches(_segments(spark, sf_dir), _ROLES)


def kinship_bands(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", F.array_join(relationships(F.col("c_acctbal")), ", ").alias("relationships"))


def detect_id_columns(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_name", "p_brand", F.concat(F.upper(F.left("p_name", F.lit(2))), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("kit"))
    return id_shares(part)


def norm_name_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", N.norm_name(F.col("text")).alias("norm_name"))


def name_tokens_split(spark, sf_dir):
    key = N.norm_name(F.col("p_name"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", key.alias("k"))
    k = F.col("k")
    return rows.select("p_partkey", N.given(k).alias("given"), F.array_join(N.surnames(k), " ").alias("surnames"), F.array_join(N.top_given(k), " ").alias("top_given"), F.array_join(N.prefixes(N.surnames(k)), " ").alias("prefixes"))


def sorted_names(spark, sf_dir):
    return _tree(spark, sf_dir)[0].select("pid", "name").orderBy("name", "pid")


def person_lookup(spark, sf_dir):
    asked = spark.createDataFrame([("Red Gear",), ("gear",), ("supplier#00000000",), ("nobody",)], "query string")
    return pedigree.find_people(_tree(spark, sf_dir)[0], asked).select("query", "pid")


def pedigree_parents(spark, sf_dir):
    return pedigree.parents(*_tree(spark, sf_dir))


def pedigree_spouses(spark, sf_dir):
    return pedigree.spouses(*_tree(spark, sf_dir))


def graph_edges(spark, sf_dir):
    return pedigree.edges(*_tree(spark, sf_dir))


def graph_nodes(spark, sf_dir):
    return pedigree.nodes(*_tree(spark, sf_dir))


def first_registrations(spark, sf_dir):
    """Line items as registrations of their parts, under the supplier's number, with a tilde that stands apart."""
    row = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    name = F.concat(F.lit(" A\u0303o "), F.col("l_suppkey").cast("string"), F.lit("\ufffd "))
    rows = _t(spark, sf_dir, "lineitem").select(row.alias("ord"), F.col("l_partkey").cast("string").alias("pid"), name.alias("name"))
    return pedigree.registered(rows).select("pid", "name", "name_clean", N.without_replacement(F.col("name")).alias("name_whole"))


def ancestor_closure(spark, sf_dir):
    person, member = _tree(spark, sf_dir)
    parents = cut(pedigree.parents(person, member), "parents")
    reach = climb.closure(person.where("famc is not null").select(F.col("pid").alias("src")), parents)
    return reach.select("src", "node", "d", F.array_join("ids", ">").alias("path"))


def _root_paths(spark, sf_dir):
    person, member = _tree(spark, sf_dir)
    root = f"C{_last_customer(spark, sf_dir)}"
    return person, member, climb.common_ancestors(person.select(F.lit(root).alias("a"), F.col("pid").alias("b")), cut(pedigree.parents(person, member), "parents"))


def mrca_direct_path(spark, sf_dir):
    _, _, met = _root_paths(spark, sf_dir)
    return met.select("a", "b", "ancestor", F.array_join("path", ">").alias("path"))


def mermaid_direct(spark, sf_dir):
    person, member, met = _root_paths(spark, sf_dir)
    shown = render.with_people(cut(met, "paths"), person, pedigree.spouses(person, member))
    chart = render.direct_chart(F.col("people"), F.col("ancestor"), F.col("partner"), F.col("partner_label"), F.col("a"), F.col("b"))
    return shown.select("a", "b", render.text_path(F.col("people")).alias("text_path"), chart.alias("mermaid_data"))


def affinity_path_length(spark, sf_dir):
    person, member = _tree(spark, sf_dir)
    pair = spark.createDataFrame([(f"C{_last_customer(spark, sf_dir)}", "S1")], "a string, b string")
    return affinity.shortest_paths(pair, person, member).select("a", "b", F.size("path").cast("long").alias("n_persons"))


def affinity_paths(spark, sf_dir):
    """Persons on the shortest paths from every ninth customer to three suppliers."""
    person, member = _tree(spark, sf_dir)
    ends = spark.createDataFrame([("S1",), ("S7",), ("S13",)], "b string")
    pairs = person.where("pid LIKE 'C%' AND ord % 9 = 0").select(F.col("pid").alias("a")).join(F.broadcast(ends))  # three ends
    return affinity.shortest_paths(pairs, person, member).select("a", "b", F.array_join("path", ">").alias("path"))


def path_searches(spark, sf_dir):
    """Every fifth customer's name and a supplier's: by whole name, by a part of it, unknown ones, and people and themselves."""
    person, member = _tree(spark, sf_dir)
    k = F.col("ord")
    second = (
        F.when(k % 35 == 0, F.concat(F.lit("nobody "), k.cast("string"))).when(k % 45 == 0, F.col("name")).when(k % 20 == 0, F.lit(" supplier#00000001 "))
        .otherwise(F.concat(F.lit("Supplier#00000000"), (k % 6 + 1).cast("string")))
    )
    asked = person.where("pid LIKE 'C%' AND ord % 5 = 0").select(F.col("name").alias("first"), second.alias("second"))
    return flows.search_paths(cut(person, "person"), cut(member, "member"), asked).drop("mermaid_data")


def path_search(spark, sf_dir):
    return flows.search_path(*_tree(spark, sf_dir), "Supplier#000000001", "Supplier#000000002")


def path_search_direct(spark, sf_dir):
    """The last customer who is the first of a name, and the mother; with blanks around and in lower case."""
    person, member = _tree(spark, sf_dir)
    named = person.groupBy(F.lower("name")).agg(F.min("ord").alias("ord"), F.min_by(F.struct("pid", "name"), "ord").alias("p"))
    own = named.where("p.pid like 'C%'").orderBy(F.desc("ord")).first()["p"]
    mother = pedigree.parents(person, member).where((F.col("child") == own["pid"]) & (F.col("pos") == 1)).first()["parent"]
    mother = person.where(F.col("pid") == mother).first()["name"]
    return flows.search_path(person, member, f"  {own['name'].lower()} ", mother)


def path_search_unknown(spark, sf_dir):
    return flows.search_path(*_tree(spark, sf_dir), "Supplier#000000001", " nobody of this name  ")


def _names(spark, sf_dir):
    """Distinct names of parts, and the same names cut short by a letter."""
    names = _t(spark, sf_dir, "part").select(N.norm_name(F.col("p_name")).alias("key")).distinct()
    cut_ = names.select(F.expr("left(key, length(key) - 1)").alias("key"))
    return cut_, names


def _clipped(name):
    """The name with its first word a letter short."""
    return F.regexp_replace(name, r"^(\S+)\S ", "$1 ")


def surname_blocking(spark, sf_dir):
    _, people = _names(spark, sf_dir)
    f = resolve.features(people)
    return resolve.pools(f, f)


def prefix_blocking(spark, sf_dir):
    wanted, people = _names(spark, sf_dir)
    return resolve.pools(resolve.features(wanted), resolve.features(people))


def soft_prefix_jaccard(spark, sf_dir):
    wanted, people = _names(spark, sf_dir)
    pairs = wanted.select(F.col("key").alias("a")).join(people.select(F.col("key").alias("b")), F.left("a", F.lit(1)) == F.left("b", F.lit(1)))
    return pairs.select("a", "b", N.soft_jaccard(N.tokens(F.col("a")), N.tokens(F.col("b"))).alias("jaccard"))


def fuzzy_ratio_scores(spark, sf_dir):
    wanted, people = _names(spark, sf_dir)
    pairs = wanted.select(F.col("key").alias("a")).join(people.select(F.col("key").alias("b")), F.left("a", F.lit(1)) == F.left("b", F.lit(1)))
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", indel_ratio(a, b).alias("ratio"), token_sort_ratio(a, b).alias("token_sort"), partial_indel_ratio(a, b).alias("partial"))


def accept_decision(spark, sf_dir):
    _, people = _names(spark, sf_dir)
    wanted = people.select(_clipped(F.col("key")).alias("key")).distinct()
    w = resolve.features(wanted)
    p = resolve.features(people).withColumn("ord", F.xxhash64("key"))
    found = resolve.judged(resolve.found_best(w, p), F.lit(100.0))
    return found.select("key", "inter", "s_given", "score20", "accepted")


def _spelled(number):
    """A word for a number, letter by letter."""
    return F.concat(F.lit("k"), F.translate(number.cast("string"), "0123456789", "abcdefghij"))


def _surnames(key, nation):
    """A third of the names are Silva, a seventh of the rest Sá; others go by nation."""
    return F.when(key % 3 == 0, "Silva").when(key % 7 == 1, "Sá").otherwise(F.concat(F.lit("Nação"), F.translate(nation.cast("string"), "0123456789", "abcdefghij")))


def best_candidate(spark, sf_dir):
    """Suppliers' made-up names resolved to customers': a hot surname, particles, accents, suffixes, and surnames that only begin alike."""
    c, s = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    k, n = F.col("c_custkey"), F.col("s_suppkey")
    suffix = F.when(k % 5 == 0, " Filho").otherwise("")
    name = F.concat(_spelled(k * 7 + 13), F.lit(" de "), F.lower("c_mktsegment"), F.lit(" "), _surnames(k, F.col("c_nationkey")), suffix)
    segment = F.element_at(F.array(*map(F.lit, ("automobile", "building", "furniture", "machinery", "household"))), (n % 5 + 1).cast("int"))
    middle = F.when((n % 4 == 0) | (n % 11 == 3), "").otherwise(F.concat(segment, F.lit(" ")))
    asked = F.concat(_spelled(n * 31 + 14), F.lit(" "), middle, F.when(n % 11 == 3, "Silvestre").otherwise(_surnames(n, F.col("s_nationkey"))))
    named = c.select(F.col("c_custkey").alias("ord"), N.norm_name(name).alias("key"))
    people = resolve.features(named, "ord")
    wanted = resolve.features(s.select(N.norm_name(asked).alias("key")).distinct())
    return resolve.found_best(wanted, people).select("key", "other", "inter", "s_given", "score20")


def _analysis(spark, sf_dir):
    """Segments whose brand ends in an odd digit have their first words clipped, so that they need the fuzzy tiers."""
    person, member = _tree(spark, sf_dir)
    rows = _segments(spark, sf_dir).withColumn("p_name", F.when(F.rlike("p_brand", F.lit("[13579]$")), _clipped(F.col("p_name"))).otherwise(F.col("p_name")))
    root = person.where(F.col("pid") == f"C{_last_customer(spark, sf_dir)}").first()["name"]
    return flows.analyse_matches(cut(person, "person"), cut(member, "member"), rows, _ROLES, root)


def dna_analysis_results(spark, sf_dir):
    return _analysis(spark, sf_dir)[0]


def dna_analysis_skipped(spark, sf_dir):
    return _analysis(spark, sf_dir)[1]


def dna_analysis_summary(spark, sf_dir):
    return flows.summary(*_analysis(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        segment_sum_by_group_key, kinship_bands, detect_id_columns, norm_name_documents, name_tokens_split, sorted_names, person_lookup,
        pedigree_parents, pedigree_spouses, graph_edges, graph_nodes, first_registrations, ancestor_closure, mrca_direct_path, mermaid_direct,
        affinity_path_length, affinity_paths, path_search, path_searches, path_search_direct, path_search_unknown,
        surname_blocking, prefix_blocking, soft_prefix_jaccard, fuzzy_ratio_scores, accept_decision, best_candidate,
        dna_analysis_results, dna_analysis_skipped, dna_analysis_summary,
    )
}

_NORM = "trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[!-/:-@\\[-`{{-~]', ' ', 'g')), '\\s+', ' ', 'g'))"
_REPAIRED = "regexp_replace(coalesce({0}, ''), '[^\\p{{L}}\\p{{N}}_\\s\\x1c-\\x1f\\x85\\p{{Z}}Á-ú''-]', ' ', 'g')"
_PEOPLE = """people AS (
    SELECT c_custkey AS ord, 'C' || c_custkey AS pid, coalesce(p_name, c_name) AS name FROM customer LEFT JOIN part ON p_partkey = c_custkey
    UNION ALL SELECT 1000000000 + s_suppkey, 'S' || s_suppkey, s_name FROM supplier)"""
_PARENTS = """parents AS (
    SELECT 'C' || c_custkey AS child, unnest(['C' || (c_custkey // 4), 'S' || ((c_custkey // 4) % (SELECT count(*) FROM supplier))]) AS parent, unnest([0, 1]) AS pos
    FROM customer WHERE c_custkey >= 4)"""
_COUPLES = """couples AS (
    SELECT DISTINCT c_custkey // 4 AS f, 'C' || (c_custkey // 4) AS h, 'S' || ((c_custkey // 4) % (SELECT count(*) FROM supplier)) AS w FROM customer WHERE c_custkey >= 4)"""
_REACH = """reach AS (
    SELECT pid AS src, pid AS node, 0 AS d, []::INTEGER[] AS o, [pid] AS ids FROM people
    UNION ALL SELECT src, parent, d + 1, list_append(o, pos), list_append(ids, parent) FROM reach JOIN parents ON node = child WHERE d < 20),
closed AS (SELECT DISTINCT ON (src, node) src, node, d, o, ids FROM reach ORDER BY src, node, d, o)"""
_PAIRS = """k AS (SELECT DISTINCT lower(p_name) AS key FROM part), short AS (SELECT left(key, length(key) - 1) AS key FROM k)"""
_CM = "CASE WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN '' ELSE coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN c_acctbal BETWEEN {lo} AND {hi} THEN '{n}' END" for lo, hi, n in BANDS) + f"), ''), '{UNKNOWN}') END"
_RATIOS = """given AS (SELECT DISTINCT a, b, split_part(a, ' ', 1) AS s, unnest(string_split(b, ' ')[1:2]) AS t FROM pairs),
sides AS (
    SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM pairs
    UNION ALL SELECT a, b, b, a FROM pairs WHERE length(a) = length(b)),
windows AS (SELECT a, b, s, substring(l, greatest(i, 0) + 1, i + length(s) - greatest(i, 0)) AS t FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS i FROM sides)),
ordered AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS s, array_to_string(list_sort(string_split(b, ' ')), ' ') AS t FROM pairs),
need AS (SELECT s, t FROM given UNION SELECT s, t FROM windows UNION SELECT s, t FROM ordered UNION SELECT a, b FROM pairs),
steps AS (
    SELECT s, t, 0 AS i, list_transform(range(length(s) + 1), lambda x: 0) AS r FROM need
    UNION ALL SELECT s, t, i + 1, list_transform(range(length(s) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k: CASE WHEN k > 0 AND s[k] = t[i + 1] THEN r[k] + 1 ELSE r[k + 1] END))) FROM steps WHERE i < length(t)),
alike AS (SELECT s, t, CAST(round_even(200.0 * r[length(s) + 1] / (length(s) + length(t)), 0) AS INTEGER) AS v FROM steps WHERE i = length(t)),
ratios AS (
    SELECT a, b, q.v AS ratio, o.v AS token_sort,
        (SELECT max(v) FROM windows w JOIN alike x ON x.s = w.s AND x.t = w.t WHERE w.a = p.a AND w.b = p.b) AS partial,
        (SELECT max(v) FROM given g JOIN alike x ON x.s = g.s AND x.t = g.t WHERE g.a = p.a AND g.b = p.b) AS s_given
    FROM pairs p JOIN alike q ON q.s = p.a AND q.t = p.b JOIN ordered USING (a, b) JOIN alike o ON o.s = ordered.s AND o.t = ordered.t)"""
# All names here are of two words, so that names of one surname have one surname in common, a Jaccard of 1 and no middle names.
_SCORE = "11 * token_sort + 5 * partial + 4 * s_given + 160"
_ACCEPTED = "(score20 >= 1720 OR (s_given >= 90 AND score20 >= 1840) OR (s_given >= 95 AND score20 >= 1760))"
_CLIPPED = "regexp_replace({0}, '^(\\S+)\\S ', '\\1 ')"

# Paths from one person up to a common ancestor and down to another, and their charts.
_MET = """top AS (SELECT src, max(d) AS m FROM closed GROUP BY src),
one AS (SELECT x.src AS a, y.src AS b, x.node, x.d AS d1, y.d AS d2, x.o AS o1, y.o AS o2, x.ids AS i1, y.ids AS i2, s.m AS m1, t.m AS m2, (x.d = y.d OR x.d > y.d + 1) AS f
    FROM closed x JOIN closed y ON x.node = y.node JOIN top s ON s.src = x.src JOIN top t ON t.src = y.src WHERE x.src = (SELECT pid FROM root) AND y.src <> x.src),
round AS (SELECT *, CASE WHEN f THEN d1 ELSE d2 END AS r, CASE WHEN f THEN o1 ELSE o2 END AS k FROM one WHERE CASE WHEN f THEN m2 >= d1 - 1 ELSE m1 >= d2 END),
best AS (SELECT DISTINCT ON (a, b) * FROM round WHERE r < 20 ORDER BY a, b, r, NOT f, k),
met AS (SELECT a, b, node AS ancestor, list_concat(i1, list_reverse(i2)[2:]) AS path FROM best UNION ALL SELECT pid, pid, pid, [pid] FROM root)"""
_CHARTS = """label AS (SELECT pid, name, replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', chr(39)) AS label FROM people),
named AS (SELECT a, b, list(name ORDER BY step) AS names, list('N_' || pid || '["' || label || '"]' ORDER BY step) AS nodes FROM (SELECT a, b, unnest(path) AS pid, generate_subscripts(path, 1) AS step FROM met) JOIN label USING (pid) GROUP BY a, b),
partner AS (SELECT h AS pid, w AS mate FROM couples UNION ALL SELECT w, arg_min('C' || f, f) FROM couples GROUP BY w),
placed AS (
    SELECT met.*, names, nodes, mate, list_position(path, ancestor) AS up, list_position(path, ancestor) IN (1, len(path)) AS line, list_transform(path, lambda x: 'N_' || x) AS ids,
        x.label || ' &amp; ' || y.label AS couple_label
    FROM met JOIN named USING (a, b) LEFT JOIN partner ON partner.pid = ancestor LEFT JOIN label x ON x.pid = ancestor LEFT JOIN label y ON y.pid = mate),
joined AS (SELECT *, NOT line AND mate IS NOT NULL AS couple, 'N_' || CASE WHEN NOT line AND mate IS NOT NULL THEN least(ancestor, mate) || '_' || greatest(ancestor, mate) ELSE ancestor END AS j FROM placed),
drawn AS (
    SELECT a, b, array_to_string(names, ' → ') AS text_path, names[-1] AS last_name, array_to_string(list_concat(
        ['flowchart BT'], CASE WHEN couple THEN [j || '["' || couple_label || '"]'] ELSE [] END,
        list_filter(nodes, lambda x, i: (NOT couple OR path[i] NOT IN (ancestor, mate)) AND list_position(path, path[i]) = i),
        CASE WHEN line THEN list_transform(range(1, len(ids)), lambda i: ids[i] || ' --> ' || ids[i + 1])
        ELSE list_concat(list_transform(range(1, up - 1), lambda i: ids[i] || ' --> ' || ids[i + 1]), [ids[up - 1] || ' --> ' || j],
            list_transform(range(len(ids), up + 1, -1), lambda i: ids[i] || ' --> ' || ids[i - 1]), [ids[up + 1] || ' --> ' || j]) END,
        ['style N_' || a || ' {0}', 'style N_' || b || ' {1}', 'style ' || j || ' {2}']), chr(10)) AS mermaid_data
    FROM joined)""".replace("{0}", render.FIRST).replace("{1}", render.SECOND).replace("{2}", render.TOP)
# Affinity paths: of all shortest ways to a target, the one whose next node has the smallest ordinal, step by step.
_NEXT = """joint AS (SELECT h AS p, f FROM couples UNION SELECT w, f FROM couples UNION SELECT 'C' || c_custkey, c_custkey // 4 FROM customer WHERE c_custkey >= 4),
e AS (SELECT p AS src, 'F' || f AS dst, f AS o FROM joint UNION ALL SELECT 'F' || f, p, ord FROM joint JOIN people ON pid = p),
bfs AS (SELECT DISTINCT b AS t, b AS node, 0 AS d FROM ends UNION SELECT t, dst, d + 1 FROM bfs JOIN e ON node = src WHERE d < 40),
dist AS (SELECT t, node, min(d) AS d FROM bfs GROUP BY t, node),
nxt AS (SELECT x.t, x.node, arg_min(e.dst, e.o) AS step FROM dist x JOIN e ON e.src = x.node JOIN dist y ON y.t = x.t AND y.node = e.dst AND y.d = x.d - 1 GROUP BY x.t, x.node),
walk AS (SELECT DISTINCT a, b, a AS node, [a] AS path FROM ends JOIN dist ON t = b AND node = a WHERE a <> b UNION ALL SELECT a, b, step, CASE WHEN step[1] = 'F' THEN path ELSE list_append(path, step) END FROM walk JOIN nxt ON nxt.t = b AND nxt.node = walk.node),
kin AS (SELECT a, b, path FROM walk WHERE node = b)"""
_ASKED = """asked AS (
    SELECT DISTINCT name AS first, trim(CASE WHEN ord % 35 = 0 THEN 'nobody ' || ord WHEN ord % 45 = 0 THEN name WHEN ord % 20 = 0 THEN ' supplier#00000001 ' ELSE 'Supplier#00000000' || (ord % 6 + 1) END) AS second
    FROM people WHERE pid LIKE 'C%' AND ord % 5 = 0),
query AS (SELECT first AS q FROM asked UNION SELECT second FROM asked),
hit AS (SELECT q, pid, ord, lower(name) = lower(q) AS same FROM query JOIN people ON contains(lower(name), lower(q))),
who AS (SELECT DISTINCT ON (q) q, pid FROM hit ORDER BY q, same DESC, ord),
placed AS (SELECT first, second, x.pid AS a, y.pid AS b FROM asked LEFT JOIN who x ON x.q = first LEFT JOIN who y ON y.q = second),
pair AS (SELECT DISTINCT a, b FROM placed WHERE a IS NOT NULL AND b IS NOT NULL),
top AS (SELECT src, max(d) AS m FROM closed GROUP BY src),
one AS (SELECT a, b, x.d AS d1, y.d AS d2, x.o AS o1, y.o AS o2, x.ids AS i1, y.ids AS i2, s.m AS m1, t.m AS m2, (x.d = y.d OR x.d > y.d + 1) AS f
    FROM pair JOIN closed x ON x.src = a JOIN closed y ON y.src = b AND y.node = x.node JOIN top s ON s.src = a JOIN top t ON t.src = b WHERE a <> b),
round AS (SELECT *, CASE WHEN f THEN d1 ELSE d2 END AS r, CASE WHEN f THEN o1 ELSE o2 END AS k FROM one WHERE CASE WHEN f THEN m2 >= d1 - 1 ELSE m1 >= d2 END),
best AS (SELECT DISTINCT ON (a, b) * FROM round WHERE r < 20 ORDER BY a, b, r, NOT f, k),
met AS (SELECT a, b, list_concat(i1, list_reverse(i2)[2:]) AS path FROM best UNION ALL SELECT a, b, [a] FROM pair WHERE a = b),
ends AS (SELECT a, b FROM pair ANTI JOIN met USING (a, b))"""
# Made-up names of suppliers and customers: surnames are a market segment and Silva, Sá or a nation.
_MADE = """bearer AS (
    SELECT c_custkey AS ord, 'k' || translate(CAST(c_custkey * 7 + 13 AS VARCHAR), '0123456789', 'abcdefghij') AS g, lower(c_mktsegment) AS seg,
        CASE WHEN c_custkey % 3 = 0 THEN 'silva' WHEN c_custkey % 7 = 1 THEN 'sa' ELSE 'nacao' || translate(CAST(c_nationkey AS VARCHAR), '0123456789', 'abcdefghij') END AS sn FROM customer),
p AS (SELECT ord, g || ' de ' || seg || ' ' || sn || CASE WHEN ord % 5 = 0 THEN ' filho' ELSE '' END AS key, [seg, sn] AS names, [g, seg] AS firsts FROM bearer),
sought AS (
    SELECT DISTINCT 'k' || translate(CAST(s_suppkey * 31 + 14 AS VARCHAR), '0123456789', 'abcdefghij') AS g,
        CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 11 = 3 THEN '' ELSE ['automobile', 'building', 'furniture', 'machinery', 'household'][s_suppkey % 5 + 1] END AS seg,
        CASE WHEN s_suppkey % 11 = 3 THEN 'silvestre' WHEN s_suppkey % 3 = 0 THEN 'silva' WHEN s_suppkey % 7 = 1 THEN 'sa' ELSE 'nacao' || translate(CAST(s_nationkey AS VARCHAR), '0123456789', 'abcdefghij') END AS sn
    FROM supplier),
w AS (SELECT g, g || ' ' || CASE WHEN seg = '' THEN '' ELSE seg || ' ' END || sn AS key, CASE WHEN seg = '' THEN [sn] ELSE [seg, sn] END AS names FROM sought),
near AS (SELECT w.key, w.g, p.key AS other, p.ord, p.firsts, len(list_intersect(w.names, p.names)) AS inter, 'silva' IN w.names AND 'silva' IN p.names AS silva FROM w JOIN p ON list_has_any(w.names, p.names)),
far AS (SELECT w.key, w.g, p.key, p.ord, p.firsts, 0, false FROM w JOIN p ON list_has_any(list_transform(list_filter(w.names, lambda x: length(x) >= 3), lambda x: x[1:3]), list_transform(p.names, lambda x: x[1:3])) WHERE w.key NOT IN (SELECT key FROM near)),
pool AS (SELECT * FROM near UNION ALL SELECT * FROM far),
most AS (SELECT * FROM pool SEMI JOIN (SELECT key, max(inter) AS inter FROM pool GROUP BY key) USING (key, inter)),
asked AS (SELECT DISTINCT g AS s, unnest(firsts) AS t FROM most),
run AS (
    SELECT s, t, 0 AS i, list_transform(range(length(s) + 1), lambda x: 0) AS r FROM asked
    UNION ALL SELECT s, t, i + 1, list_transform(range(length(s) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k: CASE WHEN k > 0 AND s[k] = t[i + 1] THEN r[k] + 1 ELSE r[k + 1] END))) FROM run WHERE i < length(t)),
close AS (SELECT s, t, CAST(round_even(200.0 * r[length(s) + 1] / (length(s) + length(t)), 0) AS INTEGER) AS v FROM run WHERE i = length(t)),
first AS (SELECT most.*, (SELECT max(v) FROM close WHERE s = g AND list_contains(firsts, t)) AS v_given FROM most),
pairs AS (SELECT key AS a, other AS b, inter, silva, ord, v_given FROM first SEMI JOIN (SELECT key, max(v_given) AS v_given FROM first GROUP BY key) USING (key, v_given))"""
_LAST = "root AS (SELECT 'C' || max(c_custkey) AS pid FROM customer)"
_FIRST_ALIKE = "root AS (SELECT arg_min(pid, ord) AS pid FROM people WHERE contains(lower(name), (SELECT lower(name) FROM people WHERE pid = 'C' || (SELECT max(c_custkey) FROM customer))))"
# Matches whose name no person bears are scored against the people of their surname; all names of the tables find some.
_ANALYSIS = f"""WITH RECURSIVE {_PEOPLE}, {_PARENTS}, {_COUPLES}, {_REACH}, {_FIRST_ALIKE}, {_MET}, {_CHARTS},
segment AS (SELECT CASE WHEN regexp_matches(p_brand, '[13579]$') THEN {_CLIPPED.format("p_name")} ELSE p_name END AS name, p_brand, l_quantity, l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey),
matches AS (SELECT lower(name) || ' | ' || upper(p_brand) AS group_key, lower(name) AS key, sum(l_quantity) AS cm, arg_min(name, (l_orderkey, l_linenumber)) AS csv_name FROM segment GROUP BY ALL),
bearer AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, pid, ord FROM people),
eldest AS (SELECT key, min(ord) AS ord, arg_min(pid, ord) AS pid FROM bearer GROUP BY key),
pairs AS (SELECT DISTINCT m.key AS a, eldest.key AS b FROM matches m JOIN eldest ON split_part(m.key, ' ', 2) = split_part(eldest.key, ' ', 2) WHERE m.key NOT IN (SELECT key FROM bearer)), {_RATIOS},
scored AS (SELECT a AS key, b AS other, s_given, {_SCORE} AS score20 FROM ratios),
nearest AS (SELECT DISTINCT ON (s.key) s.*, pid, eldest.ord, {_ACCEPTED} AS accepted FROM scored s JOIN eldest ON eldest.key = other ORDER BY s.key, s_given DESC, score20 DESC, eldest.ord),
found AS (SELECT group_key, pid, ord FROM matches JOIN bearer USING (key) UNION ALL SELECT group_key, pid, ord FROM matches JOIN nearest USING (key) WHERE accepted),
chosen AS (SELECT group_key, arg_min(pid, ord) AS b FROM found WHERE pid IN (SELECT b FROM met) GROUP BY group_key),
results AS (SELECT group_key, last_name AS match_name, cm, text_path, mermaid_data, {_CM.replace("c_acctbal", "cm")} AS relationships, csv_name FROM matches JOIN chosen USING (group_key) JOIN drawn USING (b)),
skipped AS (
    SELECT group_key, csv_name, CASE WHEN group_key IN (SELECT group_key FROM found) THEN '{flows.NO_PATH}' WHEN s_given IS NULL THEN '{resolve.NO_POOL}'
        ELSE 'score insuficiente ou conflito de sobrenome (given=' || s_given || ', final=' || regexp_replace(printf('%.2f', score20 / 20), '([.][0-9])0$', '\\1') || ', inter=1/1, jacc=1.00)' END AS motivo
    FROM matches LEFT JOIN nearest USING (key) WHERE group_key NOT IN (SELECT group_key FROM chosen))"""

ORACLES = {
    "segment_sum_by_group_key": "SELECT lower(p_name) || ' | ' || upper(p_brand) AS group_key, sum(l_quantity) AS cm, arg_min(p_name, (l_orderkey, l_linenumber)) AS name FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "kinship_bands": f"SELECT c_custkey, {_CM} AS relationships FROM customer",
    "detect_id_columns": "SELECT " + ", ".join(f"avg(CAST(regexp_full_match({c}, '[A-Z]{{2}}[0-9]{{7}}') AS INTEGER)) AS {n}" for c, n in (("p_name", "p_name"), ("p_brand", "p_brand"), ("upper(left(p_name, 2)) || lpad(CAST(p_partkey AS VARCHAR), 7, '0')", "kit"))) + " FROM part",
    "norm_name_documents": f"SELECT doc_id, {_NORM.format(_REPAIRED.format('text'))} AS norm_name FROM documents",
    "name_tokens_split": "SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS given, split_part(lower(p_name), ' ', 2) AS surnames, lower(p_name) AS top_given, left(split_part(lower(p_name), ' ', 2), 3) AS prefixes FROM part",
    "sorted_names": f"WITH {_PEOPLE} SELECT pid, name FROM people",
    "person_lookup": f"""WITH {_PEOPLE}, q AS (SELECT unnest(['Red Gear', 'gear', 'supplier#00000000', 'nobody']) AS query),
        hit AS (SELECT query, pid, lower(name) = lower(query) AS same FROM q JOIN people ON contains(lower(name), lower(query)))
        SELECT query, pid FROM hit h WHERE same OR NOT EXISTS (SELECT 1 FROM hit x WHERE x.query = h.query AND x.same)""",
    "pedigree_parents": f"WITH {_PARENTS} SELECT child, parent, pos FROM parents",
    "pedigree_spouses": f"WITH {_COUPLES} SELECT h AS pid, w AS spouse, CAST(0 AS INTEGER) AS pos FROM couples UNION ALL SELECT w, h, CAST(row_number() OVER (PARTITION BY w ORDER BY 'F' || f, f) - 1 AS INTEGER) FROM (SELECT w, h, f FROM couples)".replace("ORDER BY 'F' || f, f", "ORDER BY f"),
    "graph_edges": f"""WITH {_COUPLES}, e AS (SELECT h AS p, 'F' || f AS f FROM couples UNION SELECT w, 'F' || f FROM couples UNION SELECT 'C' || c_custkey, 'F' || (c_custkey // 4) FROM customer WHERE c_custkey >= 4)
        SELECT p AS src, f AS dst FROM e UNION ALL SELECT f, p FROM e""",
    "graph_nodes": f"WITH {_PEOPLE}, {_COUPLES} SELECT pid AS id, name AS label, 'person' AS type FROM people UNION ALL SELECT 'F' || f, 'Familia', 'family' FROM couples",
    "first_registrations": """WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS pid, ' A' || chr(771) || 'o ' || arg_min(l_suppkey, l_orderkey * 100 + l_linenumber) || chr(65533) || ' ' AS name FROM lineitem GROUP BY l_partkey)
        SELECT pid, name, trim(replace(name, 'A' || chr(771), 'Ã')) AS name_clean, replace(name, chr(65533), '') AS name_whole FROM r""",
    "path_search_direct": f"""WITH RECURSIVE {_PEOPLE}, {_PARENTS}, {_COUPLES}, {_REACH},
        first AS (SELECT lower(name) AS name, min(ord) AS ord, arg_min(pid, ord) AS pid FROM people GROUP BY 1),
        root AS (SELECT arg_max(pid, ord) AS pid, arg_max(name, ord) AS name FROM first WHERE pid LIKE 'C%'), mother AS (SELECT parent AS pid FROM parents WHERE child = (SELECT pid FROM root) AND pos = 1),
        {_MET}, {_CHARTS}
        SELECT (SELECT name FROM root) AS person1_name, (SELECT name FROM people WHERE pid = b) AS person2_name, text_path, mermaid_data, '{flows.DIRECT}' AS message, true AS success FROM drawn WHERE b = (SELECT pid FROM mother)""",
    "path_search_unknown": "SELECT CAST(NULL AS VARCHAR) AS person1_name, CAST(NULL AS VARCHAR) AS person2_name, CAST(NULL AS VARCHAR) AS text_path, CAST(NULL AS VARCHAR) AS mermaid_data, 'Pessoa 2 ''nobody of this name'' não encontrada.' AS message, false AS success",
    "ancestor_closure": f"WITH RECURSIVE {_PEOPLE}, {_PARENTS}, {_REACH} SELECT src, node, CAST(d AS INTEGER) AS d, array_to_string(ids, '>') AS path FROM closed WHERE src IN (SELECT child FROM parents)",
    "mrca_direct_path": f"WITH RECURSIVE {_PEOPLE}, {_PARENTS}, {_REACH}, {_LAST}, {_MET} SELECT a, b, ancestor, array_to_string(path, '>') AS path FROM met",
    "affinity_path_length": f"""WITH RECURSIVE {_COUPLES}, h AS (SELECT h AS p, 'F' || f AS f FROM couples UNION SELECT w, 'F' || f FROM couples UNION SELECT 'C' || c_custkey, 'F' || (c_custkey // 4) FROM customer WHERE c_custkey >= 4),
        e AS (SELECT p AS src, f AS dst FROM h UNION ALL SELECT f, p FROM h),
        bfs AS (SELECT 'C' || (SELECT max(c_custkey) FROM customer) AS node, 0 AS d UNION SELECT dst, d + 1 FROM bfs JOIN e ON node = src WHERE d < 40)
        SELECT 'C' || (SELECT max(c_custkey) FROM customer) AS a, 'S1' AS b, CAST(min(d) // 2 + 1 AS BIGINT) AS n_persons FROM bfs WHERE node = 'S1' HAVING min(d) IS NOT NULL""",
    "affinity_paths": f"""WITH RECURSIVE {_PEOPLE}, {_COUPLES}, ends AS (SELECT 'C' || c_custkey AS a, b FROM customer CROSS JOIN (SELECT unnest(['S1', 'S7', 'S13']) AS b) JOIN people ON pid = b WHERE c_custkey % 9 = 0), {_NEXT}
        SELECT a, b, array_to_string(path, '>') AS path FROM kin""",
    "path_searches": f"""WITH RECURSIVE {_PEOPLE}, {_PARENTS}, {_COUPLES}, {_REACH}, {_ASKED}, {_NEXT},
        way AS (SELECT a, b, path, '{flows.DIRECT}' AS how FROM met UNION ALL SELECT a, b, path, '{flows.INDIRECT}' FROM kin),
        told AS (SELECT a, b, how, string_agg(name, ' → ' ORDER BY step) AS text_path FROM (SELECT a, b, how, unnest(path) AS pid, generate_subscripts(path, 1) AS step FROM way) JOIN people USING (pid) GROUP BY a, b, how)
        SELECT first, second, CASE WHEN how IS NOT NULL THEN first END AS person1_name, CASE WHEN how IS NOT NULL THEN second END AS person2_name, text_path,
            CASE WHEN a IS NULL THEN 'Pessoa 1 ' || chr(39) || first || chr(39) || ' não encontrada.' WHEN b IS NULL THEN 'Pessoa 2 ' || chr(39) || second || chr(39) || ' não encontrada.'
                ELSE coalesce(how, 'Nenhuma conexão encontrada entre ' || chr(39) || first || chr(39) || ' e ' || chr(39) || second || chr(39) || '.') END AS message,
            a IS NOT NULL AND b IS NOT NULL AS success
        FROM placed LEFT JOIN told USING (a, b)""",
    "best_candidate": f"""WITH RECURSIVE {_MADE}, {_RATIOS.replace("given AS (SELECT DISTINCT a, b, split_part(a, ' ', 1) AS s, unnest(string_split(b, ' ')[1:2]) AS t FROM pairs)", "given AS (SELECT a, b, a AS s, b AS t FROM pairs WHERE false)")}
        SELECT DISTINCT ON (a) a AS key, b AS other, CAST(inter AS INTEGER) AS inter, v_given AS s_given, CAST(11 * token_sort + 5 * partial + 4 * v_given + 160 * inter - 80 * CAST(silva AS INTEGER) AS INTEGER) AS score20
        FROM pairs JOIN ratios USING (a, b) ORDER BY a, score20 DESC, ord""",
    "surname_blocking": f"WITH {_PAIRS} SELECT x.key, y.key AS other FROM k x JOIN k y ON split_part(x.key, ' ', 2) = split_part(y.key, ' ', 2)",
    "prefix_blocking": f"""WITH {_PAIRS}, s AS (SELECT key, split_part(key, ' ', 2) AS sn FROM short), p AS (SELECT key, split_part(key, ' ', 2) AS sn FROM k),
        near AS (SELECT s.key, p.key AS other FROM s JOIN p USING (sn))
        SELECT * FROM near UNION ALL SELECT s.key, p.key FROM s JOIN p ON left(s.sn, 3) = left(p.sn, 3) AND length(s.sn) >= 3 WHERE s.key NOT IN (SELECT key FROM near)""",
    "soft_prefix_jaccard": f"""WITH {_PAIRS}, t AS (SELECT short.key AS a, k.key AS b, list_distinct(string_split(short.key, ' ')) AS x, list_distinct(string_split(k.key, ' ')) AS y FROM short JOIN k ON left(short.key, 1) = left(k.key, 1)),
        u AS (SELECT a, b, CASE WHEN len(list_filter(list_concat(x, y), lambda s: length(s) <= 4)) > 0 THEN 4 ELSE 99 END AS n, x, y FROM t),
        v AS (SELECT a, b, list_distinct(list_transform(x, lambda s: left(s, n))) AS x, list_distinct(list_transform(y, lambda s: left(s, n))) AS y FROM u)
        SELECT a, b, len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1) AS jaccard FROM v""",
    "fuzzy_ratio_scores": f"WITH RECURSIVE {_PAIRS}, pairs AS (SELECT short.key AS a, k.key AS b FROM short JOIN k ON left(short.key, 1) = left(k.key, 1)), {_RATIOS} SELECT a, b, ratio, token_sort, partial FROM ratios",
    "accept_decision": f"""WITH RECURSIVE {_PAIRS}, pairs AS (SELECT DISTINCT {_CLIPPED.format("x.key")} AS a, y.key AS b FROM k x JOIN k y ON split_part(x.key, ' ', 2) = split_part(y.key, ' ', 2)), {_RATIOS},
        scored AS (SELECT a, s_given, CAST({_SCORE} AS INTEGER) AS score20 FROM ratios),
        best AS (SELECT DISTINCT ON (a) * FROM scored ORDER BY a, s_given DESC, score20 DESC)
        SELECT a AS key, CAST(1 AS INTEGER) AS inter, s_given, score20, {_ACCEPTED} AS accepted FROM best""",
    "mermaid_direct": f"WITH RECURSIVE {_PEOPLE}, {_PARENTS}, {_COUPLES}, {_REACH}, {_LAST}, {_MET}, {_CHARTS} SELECT a, b, text_path, mermaid_data FROM drawn",
    "dna_analysis_results": f"{_ANALYSIS} SELECT * FROM results",
    "dna_analysis_skipped": f"{_ANALYSIS} SELECT * FROM skipped",
    "dna_analysis_summary": f"{_ANALYSIS} SELECT (SELECT count(*) FROM results) || ' conexões encontradas. ' || (SELECT count(*) FROM skipped) || ' descartadas.' AS message",
}
