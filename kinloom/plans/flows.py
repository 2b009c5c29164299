"""The two analyses: how two people connect, and how DNA matches connect to the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.kinship import relationships
from kinloom.functions.names import repair_encoding
from kinloom.operators import affinity, climb, pedigree, render, resolve
from kinloom.session import cut
from kinloom.sources.matches import Roles, aggregate_matches

DIRECT = "Conexão direta encontrada (ancestral comum)."
INDIRECT = "Conexão indireta encontrada (via casamento/afinidade)."
NO_PATH = "sem caminho subindo por pais (pais ausentes no GED?)"

#: A pair's row: as asked, without blanks at the ends, and how they connect.
_COLUMNS = ["first", "second", "person1_name", "person2_name", "text_path", "mermaid_data", "message", "success"]


def _people_asked(person: DataFrame, asked: DataFrame) -> DataFrame:
    """``query, pid``: of each name asked for the first person in the tree's order."""
    found = pedigree.find_people(person, asked.select(F.explode(F.array("first", "second")).alias("query")).distinct())
    return found.groupBy("query").agg(F.min(F.struct("ord", "pid"))["pid"].alias("pid"))


def _marriages(paths: DataFrame, couples: DataFrame) -> DataFrame:
    """The paths with ``at``: the place of the first person on them whose next is a partner; null if there is none."""
    steps = paths.select("a", "b", F.posexplode("path").alias("at", "pid"), F.col("path").alias("p")).select("a", "b", "at", "pid", F.get("p", F.col("at") + 1).alias("spouse"))
    wed = steps.join(couples.select("pid", "spouse").distinct(), ["pid", "spouse"], "left_semi").groupBy("a", "b").agg(F.min("at").alias("at"))
    return paths.join(wed, ["a", "b"], "left")


def _branches(ends: DataFrame, parents: DataFrame, couples: DataFrame) -> DataFrame:
    """``a, b, branch``: the climb between two ends, with its ancestor's partner: one who stands on the climb first, else the first."""
    met = climb.common_ancestors(ends, parents)
    on = F.array_contains("path", F.col("spouse"))
    mate = F.min(F.struct((~on).alias("off"), "pos", "spouse"))["spouse"].alias("partner")
    mates = met.join(couples.select(F.col("pid").alias("ancestor"), "pos", "spouse"), "ancestor").groupBy("a", "b").agg(mate)
    return met.join(mates, ["a", "b"], "left").select("a", "b", F.struct("path", "ancestor", "partner").alias("branch"))


def _affinities(pairs: DataFrame, person: DataFrame, member: DataFrame, parents: DataFrame, couples: DataFrame) -> DataFrame:
    """``a, b, text_path, mermaid_data`` of the pairs that connect through a marriage."""
    paths = cut(_marriages(affinity.shortest_paths(pairs, person, member), couples), "marriages")
    wed = paths.where("at IS NOT NULL").select("a", "b", F.get("path", F.col("at")).alias("x"), F.get("path", F.col("at") + 1).alias("y"))
    ends = wed.select(F.explode(F.array(F.struct("a", F.col("x").alias("b")), F.struct(F.col("b").alias("a"), F.col("y").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    branches = cut(_branches(ends, parents, couples), "branches")
    left = branches.select("a", F.col("b").alias("x"), F.col("branch").alias("left"))
    right = branches.select(F.col("a").alias("b"), F.col("b").alias("y"), F.col("branch").alias("right"))
    both = wed.join(left, ["a", "x"]).join(right, ["b", "y"], "left").where("b = y OR right IS NOT NULL")
    shown = F.concat("left.path", F.coalesce("right.path", F.array().cast("array<string>")), F.array("a", "b", "x", "y"))
    shown = F.array_union(shown, F.filter(F.array("left.partner", "right.partner"), lambda p: p.isNotNull()))
    labels = person.select("pid", render.label(F.col("name")).alias("label"))
    named = both.select("a", "b", F.explode(shown).alias("pid")).join(labels, "pid").groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("pid", "label"))).alias("labels"))
    bridged = both.join(named, ["a", "b"]).select("a", "b", render.bridge_charts("a", "b", "x", "y", "left", F.when(F.col("b") != F.col("y"), F.col("right")), "labels").alias("bridge"))
    people = render.with_people(paths.select("a", "b", "path"), person)
    none = F.lit(None).cast("string")
    plain = render.direct_chart(F.col("people"), none, none, none, F.col("a"), F.col("b"))
    drawn = people.select("a", "b", render.text_path(F.col("people")).alias("text_path"), plain.alias("plain")).join(bridged, ["a", "b"], "left")
    return drawn.select("a", "b", "text_path", F.coalesce("bridge", "plain").alias("mermaid_data"))


def search_paths(person: DataFrame, member: DataFrame, asked: DataFrame) -> DataFrame:
    """How pairs of people connect: ``first, second, person1_name, person2_name, text_path, mermaid_data, message, success``.

    ``asked(first, second)`` names them; names are asked for, and given back,
    without blanks at their ends, and each pair gives one row.  A pair connects
    through a common ancestor or else through a marriage.  Null names are empty,
    and an empty name finds the first person, as any name contains it.
    """
    asked = asked.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("first", "second"))).distinct()
    ids = _people_asked(person, asked)
    asked = asked.join(ids.select(F.col("query").alias("first"), F.col("pid").alias("a")), "first", "left").join(ids.select(F.col("query").alias("second"), F.col("pid").alias("b")), "second", "left")
    asked = cut(asked.select("first", "second", "a", "b"), "asked")
    pairs = asked.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    parents, couples = cut(pedigree.parents(person, member), "parents"), cut(pedigree.spouses(person, member), "spouses")
    direct = cut(climb.common_ancestors(pairs, parents), "direct")
    people = render.with_people(direct, person, couples)
    chart = render.direct_chart(F.col("people"), F.col("ancestor"), F.col("partner"), F.col("partner_label"), F.col("a"), F.col("b"))
    drawn = people.select("a", "b", render.text_path(F.col("people")).alias("text_path"), chart.alias("mermaid_data"), F.lit(DIRECT).alias("message"))
    left = pairs.join(direct.select("a", "b"), ["a", "b"], "left_anti")
    drawn = cut(drawn.unionByName(_affinities(left, person, member, parents, couples).withColumn("message", F.lit(INDIRECT))), "drawn")
    out = asked.join(drawn, ["a", "b"], "left")
    known = F.col("a").isNotNull() & F.col("b").isNotNull()

    def absent(k, name):
        return F.concat(F.lit(f"Pessoa {k} '"), name, F.lit("' não encontrada."))

    nothing = F.concat(F.lit("Nenhuma conexão encontrada entre '"), "first", F.lit("' e '"), "second", F.lit("'."))
    message = F.when(F.col("a").isNull(), absent(1, F.col("first"))).when(F.col("b").isNull(), absent(2, F.col("second"))).otherwise(F.coalesce("message", nothing))
    names = [F.when(F.col("message").isNotNull(), F.col(c)).alias(f"person{k}_name") for k, c in enumerate(("first", "second"), 1)]
    return out.select("first", "second", *names, "text_path", "mermaid_data", message.alias("message"), known.alias("success")).select(_COLUMNS)


def search_path(person: DataFrame, member: DataFrame, first: str, second: str) -> DataFrame:
    """One row: how two people connect."""
    asked = person.sparkSession.createDataFrame([(first.strip(), second.strip())], "first string, second string")
    return search_paths(person, member, asked).drop("first", "second")


def analyse_matches(person: DataFrame, member: DataFrame, rows: DataFrame, roles: Roles, root: str) -> tuple[DataFrame, DataFrame]:
    """``results`` and ``skipped``; each match is in exactly one of them.

    Results hold ``group_key, match_name, cm, text_path, mermaid_data,
    relationships, csv_name`` by centiMorgans, largest first; skipped matches
    ``group_key, csv_name, motivo``.
    """
    top = pedigree.find_root(person, root)
    matches = aggregate_matches(rows, roles).withColumn("csv_name", F.trim("name"))
    matches = cut(matches.withColumn("name", repair_encoding(F.col("csv_name"))), "matches")
    found, refused = resolve.candidates(matches, person)
    found = cut(found, "candidates")
    parents = cut(pedigree.parents(person, member), "parents")
    pairs = found.select(F.lit(top).alias("a"), F.col("pid").alias("b")).distinct()
    paths = cut(climb.common_ancestors(pairs, parents), "paths")
    best = found.join(paths.select(F.col("b").alias("pid")), "pid").groupBy("group_key").agg(F.min_by("pid", "ord").alias("b"))
    shown = render.with_people(paths.join(best.select("b").distinct(), "b", "left_semi"), person, pedigree.spouses(person, member))
    chart = render.direct_chart(F.col("people"), F.col("ancestor"), F.col("partner"), F.col("partner_label"), F.col("a"), F.col("b"))
    drawn = shown.select("b", F.element_at("people", -1)["name"].alias("match_name"), render.text_path(F.col("people")).alias("text_path"), chart.alias("mermaid_data"))
    results = matches.join(best, "group_key").join(drawn, "b").select(
        "group_key", "match_name", "cm", "text_path", "mermaid_data", F.array_join(relationships(F.col("cm")), ", ").alias("relationships"), "csv_name"
    ).orderBy(F.desc("cm"), "group_key")
    reasons = refused.unionByName(found.select("group_key").distinct().join(best, "group_key", "left_anti").select("group_key", F.lit(NO_PATH).alias("reason")))
    skipped = matches.join(reasons, "group_key").select("group_key", "csv_name", F.coalesce("reason", F.lit("não encontrado")).alias("motivo")).orderBy("group_key")
    return results, skipped


def summary(results: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row with the message on how many matches were connected and how many dropped."""
    n, m = results.agg(F.count("*").alias("n")), skipped.agg(F.count("*").alias("m"))
    return n.join(m).select(F.format_string("%d conexões encontradas. %d descartadas.", "n", "m").alias("message"))
