"""Paths as text and as Mermaid flowcharts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions.names import NAMELESS

# The charts' colours.
FIRST = "fill:#e8f5e9,stroke:#66bb6a,stroke-width:2px"
SECOND = "fill:#ffebee,stroke:#ef5350,stroke-width:2px"
TOP = "fill:#fff9c4,stroke:#fbc02d,stroke-width:2px"
PARTNER = "fill:#fff8e1,stroke:#f6a821,stroke-width:2px"
HIDDEN = "fill:transparent,stroke:transparent,stroke-width:0"
ARROW = " → "
# Characters that labels spell plainly, and those that the chart's language reserves.
PLAIN = {" ": " ", "–": "-", "—": "-", "“": '"', "”": '"', "’": "'"}
RESERVED = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "'"}


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def label(name: Column) -> Column:
    text = _composed(F.coalesce(name, F.lit(NAMELESS)))
    for old, new in [*PLAIN.items(), *RESERVED.items()]:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, "[\r\n]+", " ")


def node_id(pid: Column) -> Column:
    return F.concat(F.lit("N_"), F.regexp_replace(F.replace(F.replace(pid, F.lit("@"), F.lit("")), F.lit("+"), F.lit("_")), "[^A-Za-z0-9_]", ""))


def with_people(paths: DataFrame, person: DataFrame, spouses: DataFrame | None = None) -> DataFrame:
    """The paths (keyed by ``a, b``) with ``people``: id, name and label of each step; with spouses also the ancestor's first one."""
    named = person.select("pid", "name", label(F.col("name")).alias("label"))
    steps = paths.select("a", "b", F.posexplode("path").alias("at", "pid")).join(named, "pid", "left")
    who = F.struct("at", F.col("pid").alias("id"), F.coalesce("name", F.lit(NAMELESS)).alias("name"), F.coalesce("label", F.lit(NAMELESS)).alias("label"))
    out = paths.join(steps.groupBy("a", "b").agg(F.array_sort(F.collect_list(who)).alias("people")), ["a", "b"])
    if spouses is None:
        return out
    first = spouses.where("pos = 0").select(F.col("pid").alias("ancestor"), F.col("spouse").alias("partner"))
    partner = first.join(named.select(F.col("pid").alias("partner"), F.col("label").alias("partner_label")), "partner", "left")
    return out.join(partner.withColumn("partner_label", F.coalesce("partner_label", F.lit(NAMELESS))), "ancestor", "left")


def text_path(people: Column) -> Column:
    return F.array_join(F.transform(people, lambda p: p["name"]), ARROW)


def _let(body, **values: Column) -> Column:
    """``body`` of the named values, each computed once for a row however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), 0)


def direct_chart(people: Column, ancestor: Column, partner: Column, partner_label: Column, a: Column, b: Column) -> Column:
    """The chart of a path through a common ancestor, who stands with a partner as one node."""
    at = F.when(ancestor.isNotNull(), F.array_position(F.transform(people, lambda p: p["id"]), ancestor).cast("int") - 1).otherwise(-1)
    named = F.transform(people, lambda p: F.struct(p["id"].alias("id"), p["label"].alias("label"), node_id(p["id"]).alias("node")))
    none = F.array().cast("array<string>")

    def quoted(node, text):
        return F.concat(node, F.lit('["'), text, F.lit('"]'))

    def arrow(x, y):
        return F.concat(x, F.lit(" --> "), y)

    def style(node, how):
        return F.concat(F.lit("style "), node, F.lit(f" {how}"))

    def chain(nodes):
        return F.when(F.size(nodes) < 2, none).otherwise(F.transform(F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))), lambda y, i: arrow(F.get(nodes, i), y)))

    def top_of(x):
        line = (x["top"] <= 0) | (x["top"] == F.size(x["people"]) - 1)
        couple = ~line & partner.isNotNull()
        return _let(placed, people=x["people"], ids=F.transform(x["people"], lambda p: p["node"]), top=x["top"], line=line, couple=couple)

    def placed(x):
        join = node_id(F.when(x["couple"], F.concat(F.least(ancestor, partner), F.lit("+"), F.greatest(ancestor, partner))).otherwise(ancestor))
        up = F.slice(x["ids"], 1, F.greatest(x["top"], F.lit(0)))
        down = F.reverse(F.slice(x["ids"], F.greatest(x["top"], F.lit(0)) + 2, F.size(x["ids"])))
        return _let(drawn, x=x, join=join, up=up, down=down)

    def drawn(y):
        x, join, up, down = y["x"], y["join"], y["up"], y["down"]
        own = F.get(F.transform(F.filter(x["people"], lambda p: p["id"] == ancestor), lambda p: p["label"]), 0)
        head = F.when(x["couple"], F.array(quoted(join, F.concat(own, F.lit(" &amp; "), partner_label)))).otherwise(none)
        shown = F.filter(x["people"], lambda p: ~x["couple"] | ~p["id"].isin(ancestor, partner))
        nodes = F.array_distinct(F.transform(shown, lambda p: quoted(p["node"], p["label"])))

        def to_top(nodes):
            return F.array(arrow(F.element_at(nodes, -1), join))

        sides = F.when(x["line"], chain(x["ids"])).otherwise(F.concat(chain(up), to_top(up), chain(down), to_top(down)))
        end = F.when(ancestor.isNotNull(), F.array(style(join, TOP))).otherwise(none)
        return F.array_join(F.concat(F.array(F.lit("flowchart BT")), head, nodes, sides, F.array(style(node_id(a), FIRST), style(node_id(b), SECOND)), end), "\n")

    return _let(top_of, people=named, top=at)


class _Chart:
    """Lines of a flowchart whose nodes are declared once."""

    def __init__(self, labels: dict[str, str]):
        self.lines, self.labels, self.known = ["flowchart BT"], labels, set()

    @staticmethod
    def id(pid: str) -> str:
        return "N_" + re.sub("[^a-zA-Z0-9_]", "", pid.replace("@", "").replace("+", "_"))

    def node(self, pid: str) -> None:
        if (own := self.id(pid)) not in self.known:
            self.known.add(own)
            self.lines.append(f'{own}["{self.labels.get(pid, NAMELESS)}"]')

    def open(self, title: str) -> None:
        self.lines += [f"subgraph {title}", "direction BT"]

    def close(self) -> None:
        self.lines.append("end")

    def column(self, title: str, people: list[str]) -> None:
        if people:
            self.open(title)
            for i, pid in enumerate(people):
                self.node(pid)
                if i + 1 < len(people):
                    self.lines.append(f"{self.id(pid)} --> {self.id(people[i + 1])}")
            self.close()

    def style(self, node: str, how: str) -> None:
        self.lines.append(f"style {node} {how}")


def bridge_chart(first: str, second: str, husband: str, wife: str, left: dict, right: dict | None, labels: dict[str, str]) -> str:
    """The chart of two branches joined by a marriage.

    ``left`` and ``right`` hold a branch's ``path`` from its end to the partner,
    its ``ancestor`` and the ancestor's ``partner``, if any; ``right`` is none
    where the second person is the partner.
    """
    chart = _Chart(labels)
    chart.open("COLUMNS")
    tops = []

    def branch(name: str, part: dict, title: str) -> tuple[list[str], list[str]]:
        at = part["path"].index(part["ancestor"])
        climb, descent = part["path"][:at], part["path"][:at:-1]
        sides = (climb, descent) if name == "ESQ" else (descent, climb)
        chart.open(f"{name}[{title}]")
        chart.open(f"{name}_COLS")
        for side, people in zip("LR", sides, strict=True):
            chart.column(f"{name}_{side}[ ]", people)
        chart.close()
        if part["partner"]:
            pair = sorted([part["ancestor"], part["partner"]])
            top = chart.id("+".join(pair))
            both = " &amp; ".join(labels.get(p, NAMELESS) for p in (part["ancestor"], part["partner"]))
            chart.lines.append(f'{top}["{both}"]')
        else:
            top = chart.id(part["ancestor"])
            chart.node(part["ancestor"])
        chart.lines += [f"{chart.id(people[-1])} --> {top}" for people in sides if people]
        chart.close()
        tops.append(top)
        return sides

    own = branch("ESQ", left, "Ramo 1")
    if right is None:
        chart.open("DIR[Ramo 2]")
        chart.node(second)
        chart.close()
        other = ([], [second])
    else:
        other = branch("DIR", right, "Ramo 2")
    a, b = (chart.id(f"{p}_anc") for p in (husband, wife))
    chart.lines += [f'{a}[" "]', f'{b}[" "]']
    chart.style(a, HIDDEN), chart.style(b, HIDDEN)
    chart.lines += [f"{chart.id(husband)} --- {a}", f"{b} --- {chart.id(wife)}", f"{a} --- |Casamento| {b}"]
    chart.close()
    if own[0]:
        chart.style(chart.id(first), FIRST)
    if other[1]:
        chart.style(chart.id(second), SECOND)
    for top in tops:
        chart.style(top, TOP)
    chart.style(chart.id(husband), PARTNER), chart.style(chart.id(wife), PARTNER)
    return "\n".join(chart.lines)


@F.arrow_udf(T.StringType())
def bridge_charts(first: pa.Array, second: pa.Array, husband: pa.Array, wife: pa.Array, left: pa.Array, right: pa.Array, labels: pa.Array) -> pa.Array:
    """``bridge_chart`` of every row; ``right`` is null where the second person is the partner."""
    rows = zip(*(c.to_pylist() for c in (first, second, husband, wife, left, right, labels)), strict=True)
    return pa.array([bridge_chart(*row, dict(names)) for *row, names in rows], pa.string())
