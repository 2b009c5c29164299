"""Match names resolved to people: exact, else blocked by surname, scored and judged.

Scores are whole numbers, twenty times the weighted score, so that thresholds
compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import names as N
from kinloom.functions.similarity import indel_ratio, partial_indel_ratio, token_sort_ratio
from kinloom.operators.nearest import best_candidates
from kinloom.session import cut

NO_POOL = "sem candidatos por sobrenome (abreviação/corrupção?)"
NO_SURNAME = "sem sobrenome em comum (filtro anti-falso-positivo)"


def features(keys: DataFrame, *more: str) -> DataFrame:
    """``key`` and its parts, and ``more`` columns, once for each row.

    Rows are few bytes but much work, so they are dealt to as many tasks as there are shuffle partitions.
    """
    key = F.col("key")
    keys = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    return keys.select("key", *more, N.given(key).alias("given"), N.surnames(key).alias("surnames"), N.suffixes(key).alias("suffixes"), N.top_given(key).alias("firsts"), F.array_distinct(N.tokens(key)).alias("words"))


def pools(wanted: DataFrame, people: DataFrame) -> DataFrame:
    """``key, other``: candidate names for each wanted one: with a surname in common, or if none, with a surname's prefix."""
    by = people.select(F.col("key").alias("other"), F.explode("surnames").alias("surname"))
    own = wanted.select("key", F.explode("surnames").alias("surname"))
    near = own.join(by, "surname").select("key", "other").distinct()
    left = wanted.join(near.select("key").distinct(), "key", "left_anti")
    begin = left.select("key", F.explode(N.prefixes(F.col("surnames"))).alias("prefix"))
    far = begin.join(by.withColumn("prefix", F.left("surname", F.lit(3))), "prefix").select("key", "other").distinct()
    return near.unionByName(far)


def _described(pairs: DataFrame, wanted: DataFrame, people: DataFrame) -> DataFrame:
    """The pairs with both names' parts and the surnames in common."""
    m = wanted.select("key", F.col("given").alias("g"), "surnames", "suffixes", F.col("words").alias("mine"))
    p = people.select(F.col("key").alias("other"), F.col("surnames").alias("theirs"), "firsts", F.col("words").alias("them"), "ord")
    both = pairs.join(m, "key").join(p, "other")
    return both.withColumn("own", N.drop_short(F.col("surnames"))).withColumn("shared", F.array_intersect("own", "theirs")).withColumn("inter", F.size("shared"))


def _summed(pairs: DataFrame) -> DataFrame:
    common = F.size(F.filter("shared", lambda s: F.array_contains(F.array(*map(F.lit, N.COMMON)), s)))
    return pairs.withColumn("score20", 11 * F.col("s_token") + 5 * F.col("s_part") + 4 * F.col("s_given") + 160 * F.col("inter") - 80 * common)


def scored(pool: DataFrame, wanted: DataFrame, people: DataFrame) -> DataFrame:
    """All of the pool's pairs with both names' parts, similarities and ``score20``."""
    both = _described(pool, wanted, people)
    both = both.withColumn("s_given", F.greatest(F.coalesce(indel_ratio(F.col("g"), F.get("firsts", 0)), F.lit(0)), F.coalesce(indel_ratio(F.col("g"), F.get("firsts", 1)), F.lit(0))))
    return _summed(both.withColumn("s_token", token_sort_ratio(F.col("key"), F.col("other"))).withColumn("s_part", partial_indel_ratio(F.col("key"), F.col("other"))))


def found_best(wanted: DataFrame, people: DataFrame) -> DataFrame:
    """What ``best`` gives of all scored pairs of the pools, without making them."""
    wanted, people = cut(wanted, "wanted"), cut(people, "people")  # names' parts are used many times
    return _summed(_described(best_candidates(wanted, people).select("key", "other", "s_given", "s_token", "s_part"), wanted, people))


def best(pairs: DataFrame) -> DataFrame:
    """Each wanted name's best pair: most surnames in common, then given name, then score, then the first person."""
    row = F.struct(*pairs.columns)
    return pairs.groupBy("key").agg(F.max_by(row, F.struct("inter", "s_given", "score20", (-F.col("ord")).alias("first"))).alias("b")).select("b.*")


def judged(pairs: DataFrame, cm: Column) -> DataFrame:
    """The pairs with ``accepted`` and, where not, ``reason``."""
    g, s, n = F.col("s_given"), F.col("score20"), F.col("inter")
    generic = F.array_contains(F.array(*map(F.lit, N.GENERIC)), F.col("g"))
    pairs = pairs.withColumn("jaccard", N.soft_jaccard(F.col("own"), F.col("theirs")))
    j = F.col("jaccard")
    need = F.when(generic & (F.size("own") >= 2), 2).otherwise(1)
    j_ok = (F.size("own") <= 1) | (j >= 0.5) | ((j >= 0.33) & F.coalesce(cm >= 150, F.lit(False)) & ~generic)
    begins = F.arrays_overlap(N.prefixes(F.col("surnames")), F.transform("theirs", lambda t: F.left(t, F.lit(3))))
    good = (
        (generic & (n >= 2) & (j >= 0.67) & (s >= 2000))
        | (~generic & (n >= 2) & (j >= 0.5) & (g >= 85) & (s >= 1600))
        | (~generic & (n >= 1) & (j >= 0.8) & (s >= 1720))
        | ((g >= 90) & (s >= 1840) & (n >= need) & j_ok)
        | ((g >= 95) & (s >= 1760) & (n >= need) & j_ok)
        | (begins & (g >= 90) & (s >= 1720) & (n >= 1) & j_ok)
    )
    middle = F.filter(F.array_except("mine", F.array_union(F.array("g"), "own")), lambda t: ((F.length(t) >= 3) | F.array_contains(F.array(*map(F.lit, N.SHORT)), t)) & ~F.array_contains(F.array(*map(F.lit, N.STOP)), t))
    strict = (s >= 1920) & (g >= 92) & (n >= need) & j_ok
    good = good & ((F.size(middle) == 0) | F.arrays_overlap(middle, "them") | strict)
    apart = (F.size("own") > 0) & (F.size("theirs") > 0) & (n == 0) & ~F.arrays_overlap("suffixes", "them")
    shown = F.regexp_replace(F.format_string("%.2f", s / 20), "(\\.[0-9])0$", "$1")
    weak = F.concat(F.lit("score insuficiente ou conflito de sobrenome (given="), g.cast("string"), F.lit(", final="), shown, F.lit(", inter="), n.cast("string"), F.lit("/"), need.cast("string"), F.lit(", jacc="), F.format_string("%.2f", j), F.lit(")"))
    return pairs.withColumn("accepted", good & ~apart).withColumn("reason", F.when(apart, NO_SURNAME).when(~good, weak))


def candidates(matches: DataFrame, person: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``group_key, pid, ord`` of every match's candidates, and ``group_key, reason`` of the matches without one.

    ``matches(group_key, name, cm)``, ``person(ord, pid, name)``.  An exact name
    gives all its bearers; any other at most one.
    """
    keyed = matches.withColumn("key", N.norm_name(F.col("name")))
    named = person.select("ord", "pid", N.norm_name(F.col("name")).alias("key"))
    exact = keyed.join(named, "key").select("group_key", "pid", "ord")
    rest = keyed.join(named.select("key").distinct(), "key", "left_anti")
    people = features(named.select("key").distinct()).join(named.groupBy("key").agg(F.min("ord").alias("ord"), F.min_by("pid", "ord").alias("pid")), "key")
    wanted = features(rest.select("key").distinct())
    found = found_best(wanted, people)
    verdict = judged(rest.select("group_key", "key", "cm").join(found, "key", "left"), F.col("cm"))
    verdict = verdict.join(people.select(F.col("key").alias("other"), "pid"), "other", "left")
    fuzzy = verdict.where("accepted").select("group_key", "pid", "ord")
    refused = verdict.where(~F.coalesce("accepted", F.lit(False))).select("group_key", F.when(F.col("other").isNull(), NO_POOL).otherwise(F.col("reason")).alias("reason"))
    return exact.unionByName(fuzzy), refused
