"""DNA match lists from CSV files: encoding, column roles, and one row per match."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions.names import norm_name, repair_encoding
from kinloom.session import cut
from kinloom.sources import ranges as R

# Headers by role, the first present counts; the pattern of a match id.
NAME_HEADERS = ["Name", "MatchedName", "Nome"]
CM_HEADERS = ["cM", "TotalCM", "Total cM"]
MATCH_ID = "^[A-Z]{2}[0-9]{7}$"
# What pandas reads as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: A whole number, and a number, as pandas takes them for columns of numbers.
WHOLE, NUMBER = r"^\s*[+-]?[0-9]{1,18}\s*$", r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$|^\s*[+-]?inf(inity)?\s*$"


@dataclass(frozen=True)
class Roles:
    name: str | None
    cm: str | None
    match_id: str | None
    email: str | None


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text, whole`` of a CSV file's records, read by ranges in many tasks.

    The quotes in the lines before tell whether a line begins within a quoted
    value, and so belongs to the record of the line above.  ``whole`` is false in
    a file whose quotes don't come in pairs.  Blank lines are no records; line
    breaks within values become line feeds.
    """
    raw = R.written_lines(spark, path)
    files = raw.groupBy("path").agg(F.sum(F.length(F.regexp_replace(F.decode("line", "ISO-8859-1"), '[^"]', ""))).alias("quotes"))
    files = cut(files.join(R.numbered_files(raw), "path"), "files")  # a row a file
    sound = raw.agg(F.bool_and(F.is_valid_utf8(F.col("line").cast("string")))).first()[0]
    text = F.col("line").cast("string") if sound else F.decode("line", "ISO-8859-1")
    rows = raw.select("path", "block", "row", F.regexp_replace(text, "^\ufeff", "").alias("text"))
    rows = R.running(rows, F.length(F.regexp_replace("text", '[^"]', "")), "quotes", inclusive=False)
    rows = R.running(rows, F.col("quotes") % 2 == 0, "record").drop("quotes")
    own = F.array_sort(F.collect_list(F.struct("block", "row", "text")))
    whole = rows.groupBy("path", "record").agg(F.array_join(F.transform(own, lambda s: s["text"]), "\n").alias("text")).where("trim(text) <> ''")
    return whole.join(files, "path").select("file", "record", "text", (F.col("quotes") % 2 == 0).alias("whole"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """The file as a table with ``row_ord``: UTF-8 if all of it is, else Latin-1; headers are trimmed, values at their left.

    A quoted value may hold commas, line breaks and doubled quotes.  Missing
    values and columns of numbers are those that pandas would find.  Several
    files have the header of the first.  A file is read in many tasks, or, where
    its quotes don't come in pairs, by one.
    """
    rows = cut(records(spark, path), "records")
    facts = rows.agg(F.bool_and("whole"), F.min(F.struct("file", "record", "text"))["text"], F.min("file")).first()
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True}
    if facts[1] is None or not facts[0]:
        sound = spark.read.format("binaryFile").load(path).agg(F.bool_and(F.is_valid_utf8(F.col("content").cast("string")))).first()[0]
        table = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8" if sound else "ISO-8859-1", **options)
        return typed(table.toDF(*(c.strip() for c in table.columns))).withColumn("row_ord", F.monotonically_increasing_id())
    names = [c.strip() for c in next(csv.reader(io.StringIO(facts[1]), skipinitialspace=True))]
    kind = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    heads = rows.groupBy("file").agg(F.min("record").alias("head"))
    body = rows.join(heads, "file").where("record > head")
    parsed = body.select((F.shiftleft("file", 40) + F.col("record")).alias("row_ord"), F.from_csv("text", kind.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {k: str(v) for k, v in options.items()}).alias("v"))
    table = parsed.select("row_ord", *(F.col(f"v.c{k}").alias(n) for k, n in enumerate(names)))
    return typed(table, "row_ord")


def typed(rows: DataFrame, keep: str | None = None) -> DataFrame:
    """Columns of strings with missing values as nulls, and columns of numbers as such.

    A column whose values are all whole numbers is one of longs, or of doubles
    if values are missing, as any other column of numbers; the rest are
    strings.  A column without any value is one of doubles.  The column ``keep``
    stays as it is.
    """
    at = {c: F.col(f"`{c}`") for c in rows.columns if c != keep}
    kept = [keep] if keep else []
    rows = rows.select(*kept, *(F.when(~F.coalesce(v, F.lit("")).isin(MISSING), v).alias(c) for c, v in at.items()))
    facts = []
    for c, v in at.items():
        facts += [F.count_if(v.isNull()).alias(f"{c}\0missing"), F.count_if(~F.rlike(v, F.lit(WHOLE))).alias(f"{c}\0parts"), F.count_if(~F.rlike(v, F.lit(NUMBER))).alias(f"{c}\0words")]
    seen = rows.agg(*facts).first()
    kinds = {c: "string" if seen[f"{c}\0words"] else "double" if seen[f"{c}\0parts"] or seen[f"{c}\0missing"] else "bigint" for c in at}
    number = {c: F.regexp_replace(F.trim(v), "(?i)^([+-]?)inf(inity)?$", "$1Infinity") for c, v in at.items()}
    return rows.select(*kept, *(v if kinds[c] == "string" else number[c].cast(kinds[c]).alias(c) for c, v in at.items()))


def id_shares(rows: DataFrame) -> DataFrame:
    """One row: for each column the share of values that look like a match id."""
    return rows.agg(*[F.coalesce(F.avg(F.coalesce(F.rlike(F.col(f"`{c}`").cast("string"), F.lit(MATCH_ID)), F.lit(False)).cast("double")), F.lit(0.0)).alias(c) for c in rows.columns])


def detect_roles(rows: DataFrame) -> Roles:
    """The columns' roles: by header, the match id by content (more than 0.3 of the values), e-mail by the last header with "mail"."""
    columns = [c for c in rows.columns if c != "row_ord"]
    shares = id_shares(rows.select(*[f"`{c}`" for c in columns])).first()
    return Roles(
        next((c for c in NAME_HEADERS if c in columns), None),
        next((c for c in CM_HEADERS if c in columns), None),
        next((c for c in columns if shares[c] > 0.3), None),
        next((c for c in reversed(columns) if "mail" in c.lower()), None),
    )


def aggregate_matches(rows: DataFrame, roles: Roles) -> DataFrame:
    """``group_key, cm, name``: centiMorgans summed by name and id (or else e-mail), with the first row's name."""
    if not roles.name or not roles.cm:
        raise ValueError("Colunas de Nome e cM não encontradas no CSV.")
    if dict(rows.dtypes)[roles.cm] == "string":
        raise ValueError(f"a column of numbers was expected: {roles.cm}")
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))
    key = norm_name(repair_encoding(text(roles.name)))
    if roles.match_id:
        key = F.concat(key, F.lit(" | "), F.upper(F.trim(text(roles.match_id))))
    elif roles.email:
        key = F.concat(key, F.lit(" | "), norm_name(text(roles.email)))
    cm = F.nanvl(F.col(f"`{roles.cm}`").cast("double"), F.lit(None).cast("double"))
    return rows.select(key.alias("group_key"), cm.alias("cm"), text(roles.name).alias("name"), "row_ord").groupBy("group_key").agg(
        F.coalesce(F.sum("cm"), F.lit(0.0)).alias("cm"), F.min_by("name", "row_ord").alias("name")
    )
