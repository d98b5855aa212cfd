"""From a Select to a plan: a chain of nodes, root first, that prints itself and becomes a DataFrame.

Catalyst pushes filters and prunes columns; what it cannot know is that keys are unique, so
DISTINCT is dropped here where no two rows can be equal: the key is in the result, or one row at most comes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KeyOrder, included
from ..operators import access
from .dialect import KeyBetween, KeyEquals, Select, parse, quoted


@dataclass(frozen=True)
class Node:
    text: str
    apply: object  # DataFrame -> DataFrame


@dataclass(frozen=True)
class Plan:
    nodes: tuple[Node, ...]
    columns: tuple[str, ...]

    def __str__(self) -> str:
        """What EXPLAIN prints: one node a line, each indented below the one that reads it."""
        return "".join("  " * depth + node.text + "\n" for depth, node in enumerate(self.nodes))

    def to_df(self, live: DataFrame) -> DataFrame:
        for node in reversed(self.nodes):
            live = node.apply(live)
        return live.select(*self.columns)


def _source(where, order: KeyOrder) -> list[Node]:
    scan = Node("FullScan (fold: every row)", lambda r: r.select("key", "value"))
    if isinstance(where, KeyEquals):
        return [Node(f"Get {quoted(where.key)} (get: one lookup)", lambda r: access.get(r, where.key).select("key", "value"))]
    if isinstance(where, KeyBetween):
        start, end = included(where.low), included(where.high)
        if order is KeyOrder.SORTED:
            return [Node(f"RangeScan {quoted(where.low)} .. {quoted(where.high)} (scan: sorted keydir)", lambda r: access.scan(r, start, end).select("key", "value"))]
        return [Node(f"Filter {where}", lambda r: r.where(access.in_range(start, end))), scan]
    return [scan]


def plan(select: Select, order: KeyOrder = KeyOrder.HASHED) -> Plan:
    nodes = _source(select.where, order)
    if select.fields != "*":
        nodes.insert(0, Node(f"Project {select.fields}", lambda r: r.select(select.fields)))
    unique = "key" in select.columns or isinstance(select.where, KeyEquals)
    if select.distinct and not unique:
        nodes.insert(0, Node("Distinct", lambda r: r.distinct()))
    return Plan(tuple(nodes), select.columns)


def query(live: DataFrame, text: str, order: KeyOrder = KeyOrder.HASHED) -> DataFrame:
    return plan(parse(text), order).to_df(live)


def select_by_scan(live: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """The same restriction by visiting every row: (rows, a row with their number `visited`)."""
    return live.where(F.col("key") == F.lit(key)), live.agg(F.count("*").alias("visited"))


def format_rows(rows, columns) -> str:
    """A table with padded columns, a rule and the number of rows."""
    text = [[c.decode("utf-8", "replace") if isinstance(c, (bytes, bytearray)) else str(c) for c in r] for r in rows]
    width = [max([len(name), *(len(r[k]) for r in text)]) for k, name in enumerate(columns)]
    line = lambda cells: " " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True)).rstrip()
    rule = "-+-".join("-" * w for w in width)
    return "\n".join([line(columns), f"-{rule}-", *map(line, text), f"({len(text)} row{'s' * (len(text) != 1)})"])
