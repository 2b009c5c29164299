"""Benchmark decontamination by template canonicalisation, in built-in functions only.

Numbers, units after numbers and names (capitalised words inside a sentence)
become typed placeholders, all else is lower-cased and split into words.  The
benchmark's windows of ``WINDOW`` canonical words are hash-joined with those of
all documents; hits vote for a diagonal of document and item.  On a diagonal
with slots, the item's values must map to the document's by a function: a value
that stands twice in the item stands for one value in the document.  That
catches a re-parameterised question and refuses a chance likeness of its frame.
A window needs one plain word to be looked up.  How many plain words a diagonal
needs (``PLAIN`` and a ``SHARE``) is asked of all that it covers, after windows
of slots alone, too common to look up, have been compared word by word.

Items are indexed with their names as placeholders and as plain words, so that a
document in upper or lower case, where names can't be told, matches as well.  A
capitalised word that begins a sentence, or follows a break, a quote or a
bracket, may be a name or not: a wide form reads each such word of item and
document both ways, in all mixtures that a window has, and the check of slots
tells which holds.  Function words (``NEVER``) are no names there.  A
fourth, literal form keeps numbers and names as words on both sides: it finds what
is repeated word for word, whatever is capitalised and however many slots stand
together, and needs no check of slots.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.scratch import Scratch

WINDOW = 8
#: Words in a row that make a leak (or the whole item, if shorter); items below ``LEAST`` words are too common to tell.
RUN, LEAST = 13, 5
#: Plain words that a covered run with slots must hold, and one of how many of its words.
PLAIN, SHARE = 2, 4
#: Most bytes of template windows to broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20

#: Units that count as such behind a number.
UNITS = "km|cm|mm|kg|mg|ml|km/h|mph|miles|mile|meters|metres|feet|ft|inches|pounds|lbs|grams|liters|litres|hours|hour|hrs|minutes|minute|min|seconds|days|weeks|months|years|dollars|euros|cents|percent|degrees"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
UNIT = rf"(?:(?<=[0-9])|(?<=[0-9] ))(?:%|(?:{UNITS})(?![\p{{L}}\p{{N}}]))"
NAME = r"(?<=[\p{Ll}0-9,;%] |\ue001  )\p{Lu}\p{Ll}+(?![\p{L}\p{M}])"
#: Words that are no names where a capital may only mark a beginning.
NEVER = (
    "A|An|The|This|That|These|Those|There|Here|He|She|It|We|You|They|His|Her|Its|Our|Your|Their|Who|Whom|Whose|What|Which|When|Where|Why|How|If|Then|And|Or|But|So|As|At|By|For|From|In|Into|Of|On|To|With|After|Before|During|"
    "Each|Every|Both|All|Some|Any|No|Not|One|Two|Is|Are|Was|Were|Do|Does|Did|Has|Have|Had|Can|Could|Should|Would|Let|Suppose|Given|Find|Compute|Calculate|Solve|Name|Give|"
    "Der|Die|Das|Ein|Eine|Wer|Was|Wie|Wo|Wann|Warum|Welche|Und|Es|Er|Sie|Wir|Le|La|Les|Un|Une|Qui|Que|Quel|Quelle|Quels|Quelles|Comment|Pourquoi|Et|Il|Elle|Ils|Elles|El|Los|Las|Una|Qué|Quién|Cómo|Cuál|Cuándo|Dónde|Y|En"
)
#: Capitalised words that ``NAME`` leaves: what stands before them gives the capital no meaning.
INITIAL = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{M}}\p{{N}}])(?!(?:{NEVER})(?![\p{{L}}\p{{M}}]))\p{{Lu}}\p{{Ll}}+(?![\p{{L}}\p{{M}}])"
#: Private code points, which no text keeps; the last marks a word that may be a name.
_NUM, _UNIT, _NAME, _MAYBE = "\ue000", "\ue001", "\ue002", "\ue003"
_SPLIT = "[^\\p{L}\\p{M}\ue000-\ue003]+"
#: Forms of an item: with names as placeholders, with names as words, literal, with beginnings read both ways.
NAMED, UNNAMED, LITERAL, WIDE = 0, 1, 2, 3
#: All choices among the words of a window that may be names, by their bits.
_CHOICES = json.dumps([[m for m in range(1 << WINDOW) if not m & ~f] for f in range(1 << WINDOW)])


def words(text: Column, names: bool = True, wide: bool = False) -> Column:
    """Canonical words of a text; if ``wide``, those that may be names bear a mark."""
    out = F.regexp_replace(text, "[\ue000-\ue003]", " ")
    out = F.regexp_replace(out, UNIT, f" {_UNIT} ")
    if names:
        out = F.regexp_replace(out, NAME, _NAME)
    if wide:
        out = F.regexp_replace(out, INITIAL, f"{_MAYBE}$0")
    out = F.regexp_replace(out, NUMBER, f" {_NUM} ")
    return F.array_remove(F.split(F.lower(out), _SPLIT), "")


def literal(text: Column) -> Column:
    """Words of a text with its numbers and names as they are, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def slots(text: Column, names: bool = True, wide: bool = False) -> Column:
    """The values behind the placeholders (and marked words, if ``wide``), in order, lower-cased."""
    pattern = "|".join([UNIT, *([NAME] if names else []), *([INITIAL] if wide else []), NUMBER])
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "[\ue000-\ue003]", " "), F.lit(pattern), F.lit(0)), F.lower)


def _window(hashes: list[Column], same: bool) -> Column:
    """One hash of words' hashes; literal windows have a mark of their own, so that they meet only their like."""
    return F.xxhash64(*hashes, *([F.lit(LITERAL)] if same else []))


def _even(hash: Column) -> Column:
    return hash.bitwiseAND(F.lit(-2))


def _hashes(words: Column, wide: bool = False) -> Column:
    """Even hashes of words; a marked word's is that of its plain reading, made odd."""
    if not wide:
        return F.transform(words, lambda w: _even(F.xxhash64(w)))
    return F.transform(words, lambda w: F.when(w.startswith(_MAYBE), F.xxhash64(F.substring(w, 2, 1 << 30)).bitwiseOR(F.lit(1))).otherwise(_even(F.xxhash64(w))))


def _choices(hashes: Column, at: Column) -> Column:
    """Bits of the words to read as names, for each way to read the window at ``at``."""
    bits = F.lit(0)
    for j in range(WINDOW):
        bits = bits + F.coalesce(F.get(hashes, at + j).bitwiseAND(F.lit(1)), F.lit(0)).cast("int") * (1 << j)
    return F.get(F.from_json(F.lit(_CHOICES), "array<array<int>>"), bits)


def _chosen(hashes: Column, at: Column, choice: Column, size: int) -> list[Column]:
    name = _even(F.xxhash64(F.lit(_NAME)))
    return [F.when(choice.bitwiseAND(F.lit(1 << j)) != 0, name).otherwise(_even(F.get(hashes, at + j))) for j in range(size)]


def _is_slot(w: Column) -> Column:
    return w.isin(_NUM, _UNIT, _NAME)


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per leaked pair: ``doc_id, item_id, first_word, n_words, coverage``.

    ``first_word`` is the word of the document where the best diagonal begins,
    ``n_words`` the words of the item that it covers, ``coverage`` their share of
    the item; words are those of the form that matched, canonical or literal.  Null keys, null and empty texts leak nothing.  Repeated
    rows of a document or an item give one pair; of equally good diagonals the
    first counts.  Other columns are ignored; an empty table on either side
    gives an empty result.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).where("item_id is not null and item_text is not null")
    forms = items.select("item_id", words(F.col("item_text")).alias("named"), words(F.col("item_text"), False).alias("unnamed"), literal(F.col("item_text")).alias("literal"), words(F.col("item_text"), True, True).alias("wide"))
    each = F.array(*(F.struct(F.lit(form).alias("form"), F.col(w).alias("w")) for form, w in ((NAMED, "named"), (UNNAMED, "unnamed"), (LITERAL, "literal"), (WIDE, "wide"))))
    # Without names in an item its first two forms are one, and without capitalised words the wide one is.
    own = (F.col("named") != F.col("unnamed"), (F.col("wide") != F.col("named")) | (F.col("named") != F.col("unnamed")))
    forms = forms.select("item_id", F.explode(F.filter(each, lambda f: f["form"].isin(NAMED, LITERAL) | ((f["form"] == UNNAMED) & own[0]) | ((f["form"] == WIDE) & own[1]))).alias("f")).select("item_id", "f.*")
    forms = forms.withColumn("length", F.size("w")).where(F.col("length") >= LEAST).withColumn("size", F.least("length", F.lit(WINDOW)))
    forms = forms.withColumn("bare", _bare(F.col("w"), F.col("size")))
    at = forms.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))))
    at = at.withColumn("part", F.slice("w", F.col("at") + 1, F.col("size"))).withColumn("h", _hashes(F.col("part"), True)).withColumn("choice", F.explode(_choices(F.col("h"), F.lit(0))))
    at = at.withColumn("slots", F.size(F.filter("part", _is_slot)) + F.bit_count("choice")).where(F.col("slots") < F.col("size"))
    hashed = F.when(F.lit(False), F.lit(0).cast("long"))
    for size in range(LEAST, WINDOW + 1):
        part = _chosen(F.col("h"), F.lit(0), F.col("choice"), size)
        for same in (False, True):
            hashed = F.when((F.col("size") == size) & ((F.col("form") == LITERAL) == same), _window(part, same)).otherwise(hashed)
    template = scratch.cut(at.select("size", hashed.alias("window"), "item_id", "form", "at", "length", "bare", "slots").distinct(), "template")
    held = template.groupBy("size").count().collect()  # at most four rows
    small = sum(r["count"] for r in held) * 64 <= BROADCAST_BYTES

    sizes = sorted((r["size"] for r in held), reverse=True) or [WINDOW]
    # One scan makes the windows of all sizes in use; they are hashed outside lambdas, where code is generated.
    both = F.array(*(F.struct(F.lit(same).alias("same"), _hashes(w, not same).alias("h")) for same, w in ((False, words(F.col("text"), True, True)), (True, literal(F.col("text"))))))
    rows = source.select("doc_id", F.explode(both).alias("r")).select("doc_id", "r.same", "r.h").where(F.size("h") >= min(sizes))
    rows = rows.select("doc_id", "same", "h", F.explode(F.sequence(F.lit(0), F.size("h") - min(sizes))).alias("pos"))
    rows = rows.select("doc_id", "same", "h", "pos", F.explode(_choices(F.col("h"), F.col("pos"))).alias("choice"))

    def key(size: int) -> Column:
        part = _chosen(F.col("h"), F.col("pos"), F.col("choice"), size)
        return F.when((F.col("pos") + size <= F.size("h")) & (F.col("choice") < 1 << size), F.when(F.col("same"), _window(part, True)).otherwise(_window(part, False)))

    keys = [key(size) for size in sizes]
    rows = rows.select("doc_id", "pos", "choice", (keys[0] if len(keys) == 1 else F.explode(F.array(*keys))).alias("window"))
    hits = rows.join(F.broadcast(template) if small else template, "window").where((F.col("form") == WIDE) | (F.col("choice") == 0))
    lines = hits.groupBy("doc_id", "item_id", "form", "length", "bare", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.sort_array(F.collect_set("at")).alias("ats"), F.max("slots").alias("slots")
    )
    covered = F.aggregate(
        "ats",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, a: F.struct((s["n"] + F.least(F.col("size"), a + F.col("size") - s["end"])).cast("int").alias("n"), (a + F.col("size")).cast("int").alias("end")),
        lambda s: s["n"],
    )
    needed = F.least(F.lit(RUN), F.col("length"))
    lines = lines.withColumn("n_words", covered).where(F.col("n_words") + F.col("bare") >= needed)
    lines = scratch.cut(lines.withColumn("low", F.array_min("ats")).withColumn("high", F.array_max("ats") + F.col("size")).drop("ats"), "lines")

    done = (F.col("slots") == 0) & (F.col("n_words") >= needed)
    plain, open_ = lines.where(done), lines.where(~done)
    columns = ["doc_id", "item_id", "diagonal", "low", "length", "n_words"]
    # What a wide diagonal finds no more of than a plain one needs no check.
    told = plain.where(F.col("form") != LITERAL).groupBy("doc_id", "item_id", "diagonal").agg(F.max("n_words").alias("told"))
    open_ = open_.join(told, ["doc_id", "item_id", "diagonal"], "left").where((F.col("form") != WIDE) | F.col("told").isNull() | (F.col("told") < F.col("n_words") + F.col("bare")))
    plain = plain.select(columns)
    open_ = scratch.cut(open_, "open")
    held = open_.agg(F.sum("length").alias("words")).first()["words"]
    if held:
        plain = plain.unionByName(_consistent(open_, source, items, scratch, held * 64 <= BROADCAST_BYTES).where(F.col("n_words") >= needed).select(columns))
    best = plain.groupBy("doc_id", "item_id").agg(
        F.min(F.struct((-F.col("n_words")).alias("n"), (F.col("diagonal") + F.col("low")).alias("first"), F.col("length").alias("length"))).alias("b")
    )
    return best.select(
        "doc_id", "item_id", F.col("b.first").cast("long").alias("first_word"), (-F.col("b.n")).cast("long").alias("n_words"), (-F.col("b.n") / F.col("b.length")).alias("coverage")
    )


def _bare(words: Column, size: Column) -> Column:
    """How many words no window of ``size`` covers together with a plain word."""
    near = F.transform(words, lambda w, i: F.exists(F.slice(words, F.greatest(i - size + 1, F.lit(0)) + 1, 2 * size - 1 + F.least(i - size + 1, F.lit(0))), lambda v: ~(_is_slot(v) | v.startswith(_MAYBE))))
    return F.size(F.filter(near, lambda n: ~n))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _consistent(lines: DataFrame, source: DataFrame, items: DataFrame, scratch: Scratch, small: bool) -> DataFrame:
    """The diagonals on which the item's slot values map to the document's by a function, with all that they cover.

    Windows of slots alone count here: words are compared one by one.
    """

    def read(text: str, names: bool, wide: bool = False) -> Column:
        return F.struct(words(F.col(text), names, wide).alias("w"), slots(F.col(text), names, wide).alias("v"))

    def maybe(w: Column) -> Column:
        return w.startswith(_MAYBE)

    def valued(w: Column) -> Column:
        return _is_slot(w) | maybe(w)

    def name(w: Column) -> Column:
        return (w == _NAME) | maybe(w)

    def placed(whole: Column, start: Column) -> Column:
        """Words from ``start`` on, as many as the item has, each with its value if it is a slot."""

        def of(r: Column) -> Column:
            before = F.size(F.filter(F.slice(r["w"], 1, start), valued))
            part = F.struct(F.slice(r["w"], start + 1, F.col("length")).alias("w"), F.slice(r["v"], before + 1, F.col("length")).alias("v"))
            return _let(part, lambda p: F.transform(p["w"], lambda w, i: F.struct(w.alias("w"), F.when(valued(w), F.get(p["v"], F.size(F.filter(F.slice(p["w"], 1, i), valued)))).alias("v"))))

        return _let(whole, of)

    wanted = lines.select("doc_id", "item_id", "form", "diagonal", "length", "size")
    left = wanted.join(items.dropDuplicates(["item_id", "item_text"]), "item_id").withColumn("skip", F.greatest(-F.col("diagonal"), F.lit(0)))
    left = left.withColumn("i", placed(F.when(F.col("form") == WIDE, read("item_text", True, True)).when(F.col("form") == NAMED, read("item_text", True)).otherwise(read("item_text", False)), F.col("skip"))).drop("item_text")
    both = source.join(F.broadcast(left) if small else left, "doc_id").withColumn("d", placed(F.when(F.col("form") == WIDE, read("text", True, True)).otherwise(read("text", True)), F.greatest("diagonal", F.lit(0)))).drop("text")

    def pair(i: Column, d: Column) -> Column:
        same = (i["w"] == d["w"]) | (name(i["w"]) & name(d["w"])) | (F.ltrim(i["w"], F.lit(_MAYBE)) == F.ltrim(d["w"], F.lit(_MAYBE)))
        # A word that may be a name is one against a name, or against another that may be.
        slot = _is_slot(i["w"]) | (maybe(i["w"]) & F.coalesce(name(d["w"]), F.lit(False)))
        return F.struct(F.coalesce(same, F.lit(False)).alias("same"), F.when(slot, 0).otherwise(1).alias("plain"), F.when(slot, i["v"]).alias("i"), d["v"].alias("d"))

    pairs = F.zip_with("i", "d", pair)
    both = both.withColumn("pairs", F.slice(pairs, 1, F.col("length") - F.col("skip"))).drop("i", "d")
    both = scratch.cut(both, "pairs")  # they are read several times

    def step(s: Column, p: Column) -> Column:
        run, own = F.when(p["same"], s["run"] + 1).otherwise(0), F.when(p["same"], s["own"] + p["plain"]).otherwise(0)
        first, full = run == F.col("size"), run >= F.col("size")
        return F.struct(
            run.alias("run"), own.alias("own"), (s["at"] + 1).alias("at"),
            (s["n"] + F.when(first, F.col("size")).when(full, 1).otherwise(0)).alias("n"),
            (s["plain"] + F.when(first, own).when(full, p["plain"]).otherwise(0)).alias("plain"),
            F.when(first & (s["high"] == 0), s["at"] + 1 - F.col("size")).otherwise(s["low"]).alias("low"),
            F.when(full, s["at"] + 1).otherwise(s["high"]).alias("high"),
        )

    start = F.struct(*(F.lit(0).alias(c) for c in ("run", "own", "at", "n", "plain", "low", "high")))
    both = both.withColumn("c", F.aggregate("pairs", start, step))
    both = both.where((F.col("c.plain") >= PLAIN) & (F.col("c.plain") * SHARE >= F.col("c.n")))
    both = both.withColumn("pairs", F.filter(F.slice("pairs", F.col("c.low") + 1, F.col("c.high") - F.col("c.low")), lambda p: p["i"].isNotNull()))
    values = F.transform("pairs", lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))
    good = both.where(F.size(F.array_distinct(values)) == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))))
    return good.select("doc_id", "item_id", "diagonal", "length", (F.col("skip") + F.col("c.low")).alias("low"), F.col("c.n").alias("n_words"))
