"""Family trees from GEDCOM files, read and parsed with built-in functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions.names import display_name
from kinloom.session import cut
from kinloom.sources import ranges as R

# The ANSEL character set beyond ASCII; marks stand before the letter that bears them.
ANSEL = {
    0xA1: "Ł", 0xA2: "Ø", 0xA3: "Đ", 0xA4: "Þ", 0xA5: "Æ", 0xA6: "Œ", 0xA7: "ʹ", 0xA8: "·", 0xA9: "♭", 0xAA: "®", 0xAB: "±", 0xAC: "Ơ", 0xAD: "Ư", 0xAE: "ʼ", 0xB0: "ʻ",
    0xB1: "ł", 0xB2: "ø", 0xB3: "đ", 0xB4: "þ", 0xB5: "æ", 0xB6: "œ", 0xB7: "ʺ", 0xB8: "ı", 0xB9: "£", 0xBA: "ð", 0xBC: "ơ", 0xBD: "ư", 0xC0: "°", 0xC1: "ℓ", 0xC2: "℗",
    0xC3: "©", 0xC4: "♯", 0xC5: "¿", 0xC6: "¡", 0xCF: "ß",
}
ANSEL_MARKS = {
    0xE0: "\u0309", 0xE1: "\u0300", 0xE2: "\u0301", 0xE3: "\u0302", 0xE4: "\u0303", 0xE5: "\u0304", 0xE6: "\u0306", 0xE7: "\u0307", 0xE8: "\u0308", 0xE9: "\u030c", 0xEA: "\u030a",
    0xEB: "\ufe20", 0xEC: "\ufe21", 0xED: "\u0315", 0xEE: "\u030b", 0xEF: "\u0310", 0xF0: "\u0327", 0xF1: "\u0328", 0xF2: "\u0323", 0xF3: "\u0324", 0xF4: "\u0325", 0xF5: "\u0333",
    0xF6: "\u0332", 0xF7: "\u0326", 0xF8: "\u031c", 0xF9: "\u032e", 0xFA: "\ufe22", 0xFB: "\ufe23", 0xFE: "\u0313",
}


#: Code pages that a header names, by Python's names for them.
PAGES = {"ANSI": "cp1252", "WINDOWS-1252": "cp1252", "IBMPC": "cp437", "IBM-PC": "cp437", "IBM": "cp437", "OEM": "cp437", "MACINTOSH": "mac_roman", "MAC": "mac_roman", "CP1250": "cp1250", "CP1251": "cp1251", "CP1252": "cp1252"}


def from_ansel(data: bytes) -> str:
    """Text of ANSEL bytes, composed; bytes without a character become U+FFFD."""
    out, marks = [], ""
    for b in data:
        if b in ANSEL_MARKS:
            marks += ANSEL_MARKS[b]
            continue
        out += [chr(b) if b < 0x80 else ANSEL.get(b, "\ufffd"), marks]
        marks = ""
    return unicodedata.normalize("NFC", "".join(out))


@F.pandas_udf(T.StringType())
def _by_page(content: pd.Series, page: pd.Series) -> pd.Series:
    """Text of ANSEL or of a code page; bytes that it doesn't have become U+FFFD."""
    return pd.Series([c if c is None else from_ansel(c) if p == "ANSEL" else c.decode(PAGES[p], "replace") for c, p in zip(content, page, strict=True)])


_LINE = r"^\s*(\d+)\s+(?:(@[^@]+@)\s+)?(\S+)(?: (.*))?$"


def _wide(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, row, text`` of UTF-16 files, which have no ranges of their own: one task reads such a file."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.decode("content", "UTF-16").alias("c"))
    return raw.select("path", F.lit(0).cast("long").alias("block"), F.posexplode(F.split("c", "\r\n|\r|\n")).alias("row", "text")).withColumn("row", F.col("row").cast("long"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, pos, level, xref, tag, value`` of every line; a line against the grammar raises an error.

    Large files are read by ranges, in many tasks.  A byte order mark tells
    UTF-16, and the header ANSEL or a code page (ANSI, IBMPC, MACINTOSH and
    others), which counts unless the bytes are UTF-8 beyond ASCII; other bytes
    that are no UTF-8 make the file be read as Latin-1.  ``file`` numbers the
    files by path, ``record`` the level-0 lines of a file, ``pos`` its lines.
    """
    raw = R.written_lines(spark, path)
    at, latin = F.struct("block", "row"), F.decode("line", "ISO-8859-1")
    char = F.upper(F.regexp_extract(latin, r"^\s*1\s+CHAR\s+(\S+)\s*$", 1))
    facts = raw.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("sound"),
        F.hex(F.substring(F.min_by("line", at), 1, 2)).isin("FFFE", "FEFF").alias("wide"),
        F.min_by(F.when(char != "", char), F.when(char != "", at)).alias("page"),
    )
    facts = cut(facts.join(R.numbered_files(raw), "path"), "files")  # a row a file
    known = raw.join(facts.where("NOT wide"), "path")
    old = F.coalesce((F.col("page") == "ANSEL") | (F.col("page").isin(list(PAGES)) & ~F.col("sound")), F.lit(False))
    text = F.when(old, _by_page(F.when(old, F.col("line")), "page")).when(F.col("sound"), F.col("line").cast("string")).otherwise(latin)
    rows = known.select("path", "file", "block", "row", text.alias("text"))
    wide = facts.where("wide").select("path", "file")
    if not wide.isEmpty():
        rows = rows.unionByName(_wide(spark, path).join(wide, "path"))
    rows = rows.withColumn("line", F.regexp_replace("text", "^\ufeff", "")).drop("text")
    good = F.rlike("line", F.lit(_LINE))
    level = F.when(F.trim("line") == "", -1).when(good, F.regexp_extract("line", _LINE, 1)).otherwise(F.raise_error(F.concat(F.lit("not a GEDCOM line: "), F.col("line"))))
    part = lambda i: F.nullif(F.regexp_extract("line", _LINE, i), F.lit(""))
    parsed = rows.select("path", "file", "block", "row", level.cast("int").alias("level"), part(2).alias("xref"), F.upper(part(3)).alias("tag"), part(4).alias("value"))
    parsed = R.running(R.running(parsed, F.col("level") == 0, "record"), F.lit(1), "pos", inclusive=False)
    return cut(parsed.where("level >= 0").select("file", "record", "pos", "level", "xref", "tag", "value"), "parsed")


def read_gedcom(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``person(ord, pid, name, famc, fams)`` and ``family_member(fam_ord, fid, tag, pos, pid)``.

    Of records that share an id the last one counts, in the place of the first;
    several files are read in the order of their paths, as if end to end.
    """
    own = lines(spark, path).withColumn("record", F.shiftleft("file", 40) + F.col("record"))
    heads = own.where("level = 0 and tag in ('INDI', 'FAM') and xref is not null").select("record", "xref", F.col("tag").alias("kind"))
    best = heads.groupBy("xref", "kind").agg(F.min("record").alias("ord"), F.max("record").alias("record"))
    facts = own.where("level = 1").select("record", "pos", "tag", "value").join(best, "record")
    at = F.struct("pos", "value")
    named = facts.where("kind = 'INDI'").groupBy("xref").agg(
        F.min(F.when(F.col("tag") == "NAME", at))["value"].alias("name"),
        F.min(F.when(F.col("tag") == "FAMC", at))["value"].alias("famc"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "FAMS", at))), lambda s: s["value"]).alias("fams"),
    )
    person = best.where("kind = 'INDI'").join(named, "xref", "left").select(
        "ord", F.col("xref").alias("pid"), display_name(F.col("name")).alias("name"), F.trim("famc").alias("famc"), F.coalesce("fams", F.array().cast("array<string>")).alias("fams")
    )
    member = facts.where("kind = 'FAM' and tag in ('HUSB', 'WIFE', 'CHIL') and value is not null").select(
        F.col("ord").alias("fam_ord"), F.col("xref").alias("fid"), "tag", "pos", F.trim("value").alias("pid")
    )
    return person, member


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """``fid`` of every family record, with members or without."""
    return lines(spark, path).where("level = 0 and tag = 'FAM' and xref is not null").select(F.col("xref").alias("fid")).distinct()
