"""Relations of a family tree: parents, spouses, edges, lookups.

``person(ord, pid, name, famc, fams)``, ``member(fam_ord, fid, tag, pos, pid)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.names import repair_tildes


def child_families(member: DataFrame) -> DataFrame:
    """``child, families``: the families that name a child, in the file's order."""
    at = F.array_sort(F.collect_list(F.struct("fam_ord", "pos", "fid")))
    return member.where("tag = 'CHIL'").groupBy(F.col("pid").alias("child")).agg(F.transform(at, lambda s: s["fid"]).alias("families"))


def parents(person: DataFrame, member: DataFrame) -> DataFrame:
    """``child, parent, pos``: from the family that the child names, or else those that name the child."""
    at = F.array_sort(F.collect_list(F.struct("fam_ord", "pos", "fid")))
    listed = member.where("tag = 'CHIL'").groupBy(F.col("pid").alias("child")).agg(at.alias("listed"))
    of = person.select(F.col("pid").alias("child"), "famc").join(listed, "child", "full")
    chosen = F.when(F.col("famc").isNotNull(), F.array("famc")).otherwise(F.transform("listed", lambda s: s["fid"]))
    family = of.select("child", F.posexplode(chosen).alias("fam_pos", "fid"))
    couples = member.where("tag in ('HUSB', 'WIFE')").select("fid", F.col("pos").alias("own_pos"), F.col("pid").alias("parent"))
    first = family.join(couples, "fid").groupBy("child", "parent").agg(F.min(F.struct("fam_pos", "own_pos")).alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", "parent")))
    return first.groupBy("child").agg(order.alias("all")).select("child", F.posexplode("all").alias("pos", "p")).select("child", F.col("p.parent").alias("parent"), F.col("pos").cast("int").alias("pos"))


def spouses(person: DataFrame, member: DataFrame) -> DataFrame:
    """``pid, spouse, pos``: partners in the families that a person names; if none, from all families' first couples."""
    couples = member.where("tag in ('HUSB', 'WIFE')")
    named = person.select("pid", F.posexplode("fams").alias("fam_pos", "fid"))
    roles = couples.where("tag = 'HUSB'").select("fid", "pid").distinct().withColumn("husband", F.lit(True))
    side = named.join(roles, ["fid", "pid"], "left").withColumn("want", F.when(F.col("husband"), "WIFE").otherwise("HUSB"))
    partner = couples.select("fid", F.col("tag").alias("want"), F.col("pos").alias("own_pos"), F.col("pid").alias("spouse"))
    direct = side.join(partner, ["fid", "want"]).select("pid", "spouse", "fam_pos", "own_pos")
    pair = couples.groupBy("fam_ord", "fid").agg(F.min_by("pid", F.when(F.col("tag") == "HUSB", F.col("pos"))).alias("h"), F.min_by("pid", F.when(F.col("tag") == "WIFE", F.col("pos"))).alias("w")).where("h is not null and w is not null")
    both = pair.select(F.col("h").alias("pid"), F.col("w").alias("spouse"), "fam_ord").unionByName(pair.select(F.col("w").alias("pid"), F.col("h").alias("spouse"), "fam_ord"))
    other = both.join(direct.select("pid").distinct(), "pid", "left_anti").select("pid", "spouse", F.col("fam_ord").cast("int").alias("fam_pos"), F.lit(0).alias("own_pos"))
    first = direct.unionByName(other).groupBy("pid", "spouse").agg(F.min(F.struct("fam_pos", "own_pos")).alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", "spouse")))
    return first.groupBy("pid").agg(order.alias("all")).select("pid", F.posexplode("all").alias("pos", "s")).select("pid", F.col("s.spouse").alias("spouse"), F.col("pos").cast("int").alias("pos"))


def edges(person: DataFrame, member: DataFrame) -> DataFrame:
    """``src, dst`` both ways between persons and families; of several husbands or wives the last counts."""
    one = member.where("tag in ('HUSB', 'WIFE')").groupBy("fid", "tag").agg(F.max_by("pid", "pos").alias("pid")).select("pid", "fid")
    all_ = one.unionByName(member.where("tag = 'CHIL'").select("pid", "fid")).distinct().join(person.select("pid"), "pid", "left_semi")
    return all_.select(F.col("pid").alias("src"), F.col("fid").alias("dst")).unionByName(all_.select(F.col("fid").alias("src"), F.col("pid").alias("dst")))


def nodes(person: DataFrame, member: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """``id, label, type`` of persons and families; ``families(fid)`` adds those without members."""
    fids = member.select("fid") if families is None else member.select("fid").unionByName(families.select("fid"))
    own = person.select(F.col("pid").alias("id"), F.col("name").alias("label"), F.lit("person").alias("type"))
    return own.unionByName(fids.where("fid is not null").distinct().select(F.col("fid").alias("id"), F.lit("Familia").alias("label"), F.lit("family").alias("type")))


def registered(rows: DataFrame) -> DataFrame:
    """``pid, name, name_clean``: of rows ``ord, pid, name`` with one id the first counts; later ones change nothing."""
    first = rows.groupBy("pid").agg(F.min_by(F.struct("name"), "ord").alias("r"))
    return first.select("pid", F.col("r.name").alias("name"), F.trim(repair_tildes(F.col("r.name"))).alias("name_clean"))


def _grams(text: Column) -> Column:
    """A text's distinct runs of three characters; the text has three at least."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))


def find_people(person: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, ord, pid, name`` of people by name: equal in lower case, and only if none is, those that contain it.

    Names that contain a query have all its runs of three characters, so a query
    meets only the names that have its rarest run, by an equi-join.  Queries of
    fewer characters, of which there can't be many, meet all names.
    """
    low = queries.select("query", F.lower("query").alias("q")).distinct()
    named = person.select("ord", "pid", "name", F.lower("name").alias("n"))
    exact = named.join(low, F.col("n") == F.col("q"))
    left = low.join(exact.select("query").distinct(), "query", "left_anti")
    long = left.where(F.length("q") >= 3).withColumn("grams", _grams(F.col("q")))
    asked = long.select("query", "q", F.size("grams").alias("all"), F.explode("grams").alias("gram"))
    postings = named.where(F.length("n") >= 3).select("ord", "pid", "name", "n", F.explode(_grams(F.col("n"))).alias("gram"))
    postings = postings.join(asked.select("gram").distinct(), "gram", "left_semi")
    sizes = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    rarest = asked.join(sizes, "gram").groupBy("query", "q", "all").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("names", "gram"))["gram"].alias("gram"))
    part = postings.join(rarest.where(F.col("found") == F.col("all")), "gram").where(F.contains(F.col("n"), F.col("q")))  # a run that no name has rules all out
    short = named.join(F.broadcast(left.where(F.length("q") < 3)), F.contains(F.col("n"), F.col("q")))
    return exact.unionByName(part, allowMissingColumns=True).unionByName(short, allowMissingColumns=True).select("query", "ord", "pid", "name")


def find_root(person: DataFrame, name: str) -> str:
    """The first person whose name contains the text in lower case."""
    found = person.where(F.contains(F.lower("name"), F.lower(F.lit(name)))).orderBy("ord").limit(1).collect()
    if not found:
        raise ValueError(f"Seu nome '{name}' não foi encontrado no GEDCOM.")
    return found[0]["pid"]
