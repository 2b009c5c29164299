"""Names: repair, normal form, and their parts by Portuguese custom."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies, in the normal form of names (lower case, no accents).
STOP = ["de", "da", "do", "das", "dos", "e"]
GENERIC = ["maria", "jose", "joao", "ana", "luiz", "luis", "francisco", "antonio", "fernando", "carlos", "paulo", "pedro", "marcos", "augusto", "sergio", "helena"]
SUFFIXES = ["filho", "neto", "junior", "sobrinho"]
COMMON = ["silva", "oliveira", "santos", "souza", "pereira", "ferreira", "almeida", "costa", "rodrigues", "lima", "gomes", "ribeiro", "carvalho", "azevedo", "albuquerque"]
SAME = {"netto": "neto", "gouvea": "gouveia"}
SHORT = ["sa"]
# Broken sequences and what they become, in the order in which they apply.
BROKEN = [("A�", "ç"), ("Ã§", "ç"), ("Ã£", "ã"), ("Ã¡", "á"), ("Ã¢", "â"), ("Ã©", "é"), ("Ãª", "ê"), ("Ã¨", "è"), ("Ã­", "í"), ("Ã³", "ó"), ("Ã´", "ô"), ("Ãº", "ú")]
# Letters with a tilde of their own, and a broken cedilla, in the order in which they apply.
TILDES = [("A\u0303", "Ã"), ("O\u0303", "Ão"), ("N\u0303v", "Ñ"), ("a\u0303o", "ão"), ("A\u0303o", "ão"), ("Ã§", "ç"), ("Ã\u00e7", "ç")]
#: Used where a person has no name.
NAMELESS = "Sem Nome"


def _in(values: list[str], item: Column) -> Column:
    return F.array_contains(F.array(*map(F.lit, values)), item)


def strip_bad(text: Column) -> Column:
    """Broken sequences repaired; what is no word character, blank, accented letter, apostrophe or hyphen becomes a blank."""
    text = F.coalesce(text, F.lit(""))
    for bad, good in BROKEN:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}Á-ú'-]", " ")


def repair_encoding(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again, if that gives a sound string; else the text as it is."""
    marked = F.contains(text, F.lit("Ã")) | F.contains(text, F.lit("Â")) | F.contains(text, F.lit("�"))
    narrow = F.when(marked & F.rlike(text, F.lit(r"^[\x00-\xFF]*$")), text)
    again = F.try_validate_utf8(F.encode(narrow, "ISO-8859-1").cast("string"))
    sound = F.when(~F.contains(again, F.lit("Ã")) & ~F.contains(again, F.lit("�")), again)
    return F.coalesce(sound, text)


def without_replacement(text: Column) -> Column:
    """The text without U+FFFD; null stays null."""
    return F.replace(text, F.lit("\ufffd"), F.lit(""))


def repair_tildes(text: Column) -> Column:
    """Letters and tildes that stand apart put together; null stays null."""
    for bad, good in TILDES:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return text.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def norm_name(text: Column) -> Column:
    """Repaired, without accents and punctuation, lower-cased, single blanks."""
    plain = F.lower(F.regexp_replace(_plain(strip_bad(text)), r"\p{Punct}", " "))
    return F.trim(F.regexp_replace(plain, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def tokens(key: Column) -> Column:
    """The words of a normal form."""
    return F.filter(F.split(key, " "), lambda t: t != "")


def given(key: Column) -> Column:
    """The first word that is neither a particle nor a generic name, else the first word."""
    all_ = tokens(key)
    own = F.filter(all_, lambda t: ~_in(STOP, t) & ~_in(GENERIC, t))
    return F.coalesce(F.get(own, 0), F.get(all_, 0), F.lit(""))


def suffixes(key: Column) -> Column:
    """Generation words that end the name."""
    plain = F.concat(F.lit(" "), F.array_join(F.filter(tokens(key), lambda t: ~_in(STOP, t)), " "))
    tail = F.regexp_extract(plain, "((?: (?:" + "|".join(SUFFIXES) + "))+)$", 1)
    return F.array_sort(F.array_distinct(tokens(tail)))


def core_surnames(key: Column) -> Column:
    """Of the last three words before any suffix, those that are no generic name, in one spelling."""
    plain = F.concat(F.lit(" "), F.array_join(F.filter(tokens(key), lambda t: ~_in(STOP, t)), " "))
    body = tokens(F.regexp_replace(plain, "(?: (?:" + "|".join(SUFFIXES) + "))+$", ""))
    last = F.slice(body, F.greatest(F.size(body) - 2, F.lit(1)), 3)
    spelled = F.create_map(*[F.lit(x) for pair in SAME.items() for x in pair])
    return F.transform(F.filter(last, lambda t: ~_in(GENERIC, t)), lambda t: F.coalesce(F.try_element_at(spelled, t), t))


def surnames(key: Column) -> Column:
    """The distinct surnames: core surnames other than the given name."""
    first = given(key)
    return F.array_distinct(F.filter(core_surnames(key), lambda t: (t != first) & ~_in(GENERIC, t)))


def top_given(key: Column, k: int = 2) -> Column:
    """The first words that are no particles, else the first words."""
    own = F.slice(F.filter(tokens(key), lambda t: ~_in(STOP, t)), 1, k)
    return F.when(F.size(own) > 0, own).otherwise(F.slice(tokens(key), 1, k))


def drop_short(names: Column, least: int = 3) -> Column:
    return F.filter(names, lambda t: (F.length(t) >= least) | _in(SHORT, t))


def prefixes(names: Column, n: int = 3) -> Column:
    return F.array_distinct(F.transform(F.filter(names, lambda t: F.length(t) >= n), lambda t: F.left(t, F.lit(n))))


def soft_jaccard(a: Column, b: Column, prefix: int = 4, least: int = 2) -> Column:
    """Jaccard of two sets of names; by prefixes if any name is no longer than one."""
    a, b = (F.array_distinct(F.filter(x, lambda t: F.length(t) >= least)) for x in (a, b))
    short = F.exists(F.concat(a, b), lambda t: F.length(t) <= prefix)

    def share(x, y):
        return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))

    def cut(x):
        return F.array_distinct(F.transform(x, lambda t: F.left(t, F.lit(prefix))))

    return F.when(short, share(cut(a), cut(b))).otherwise(share(a, b))


def display_name(text: Column) -> Column:
    """A tree's name without its slashes, single blanks; ``NAMELESS`` if there is none."""
    plain = F.trim(F.regexp_replace(F.replace(text, F.lit("/"), F.lit(" ")), r"\s+", " "))
    return F.when(F.coalesce(plain, F.lit("")) == "", NAMELESS).otherwise(plain)
