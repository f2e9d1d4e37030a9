"""JSON inside text columns as Column algebra: typed members, ordered descendants, scalar texts.

A JSON value is carried as its text.  An object is opened as a map of variants, which keeps every
member's type, beside the same map of texts, which keeps the order of members further down; so a
string that looks like an object stays a string, and "the first of equals" means what the page says.
Descendants are gathered level by level as arrays of (path, text) inside the row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "array<struct<path:array<int>,text:string>>"
# What an empty value looks like.
_EMPTY = r'^(null|false|""|\[\]|\{\}|-?0(\.0*)?([eE][-+]?\d+)?)$'


def is_object(text: Column) -> Column:
    return F.substring(text, 1, 1) == "{"


def is_list(text: Column) -> Column:
    return F.substring(text, 1, 1) == "["


def is_string(text: Column) -> Column:
    return F.substring(text, 1, 1) == '"'


def filled(text: Column) -> Column:
    """Anything but null, false, zero and the empty string, list or object."""
    return text.isNotNull() & ~text.rlike(_EMPTY)


def members(text: Column) -> Column:
    """Map from name to JSON text of an object; NULL for any other value."""
    opened = F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, v: F.to_json(v))
    return F.when(is_object(text), opened)


def elements(text: Column) -> Column:
    """JSON texts of a list; any other value is a list of itself, null the empty list."""
    listed = F.transform(F.from_json(text, "array<variant>"), lambda v: F.to_json(v))
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == "null"), none).when(is_list(text), listed).otherwise(F.array(text))


def scalar(text: Column) -> Column:
    """A string without its quotes, a number as written, 1 or 0; NULL for lists and objects."""
    plain = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(text == "true", "1").when(text == "false", "0").when(~(is_object(text) | is_list(text)), plain)


def known(obj: Column, names: Sequence[str]) -> Column:
    """First member, in the order of the names, that is there and not null."""
    return F.coalesce(*[F.nullif(F.element_at(obj, F.lit(n)), F.lit("null")) for n in names])


def telling(obj: Column, names: Sequence[str]) -> Column:
    """First member, in the order of the names, that is not empty."""
    values = [F.element_at(obj, F.lit(n)) for n in names]
    return F.coalesce(*[F.when(filled(v), v) for v in values])


def one_of(value: Column, texts: Sequence[str]) -> Column:
    """Does a string, or a string of a list, stand among the texts?"""
    return F.exists(elements(value), lambda e: is_string(e) & scalar(e).isin(*texts))


def roots(texts: Column) -> Column:
    """Nodes of several blocks, numbered in their order."""
    return F.transform(texts, lambda t, i: F.struct(F.array(i).alias("path"), F.trim(t).alias("text")))


def children(node: Column, backwards: bool) -> Column:
    """Lists and objects right below a node.  Paths sort in document order, or, ``backwards``, with
    later siblings first."""
    text, path = node["text"], node["path"]

    def typed(raw: Column, variants: Column) -> Column:
        return F.zip_with(raw, variants, lambda r, v: F.struct(r.alias("text"), F.to_json(v).alias("typed")))

    inner = F.when(
        is_object(text), typed(F.map_values(F.from_json(text, "map<string,string>")), F.map_values(F.from_json(text, "map<string,variant>")))
    ).when(is_list(text), typed(F.from_json(text, "array<string>"), F.from_json(text, "array<variant>")))
    numbered = F.transform(inner, lambda m, i: F.struct(
        F.concat(path, F.array(-i if backwards else i)).alias("path"), m["text"].alias("text"), m["typed"].alias("typed")
    ))
    nested = F.filter(numbered, lambda m: is_object(m["typed"]) | is_list(m["typed"]))
    plain = F.transform(nested, lambda m: F.struct(m["path"].alias("path"), m["text"].alias("text")))
    return F.coalesce(plain, F.array().cast(NODES))


def with_descendants(df: DataFrame, nodes: str, name: str, depth: int, backwards: bool = False, below=None) -> DataFrame:
    """Add ``name``: the nodes of column ``nodes`` and all lists and objects up to ``depth`` levels
    below them.  ``below`` maps a node to the nodes under it (default: all of its children)."""
    step = below or (lambda n: children(n, backwards))
    levels = [f"_{name}{d}" for d in range(depth + 1)]
    out = df.withColumn(levels[0], F.col(nodes))
    for above, level in zip(levels, levels[1:]):
        out = out.withColumn(level, F.flatten(F.transform(above, step)))
    return out.withColumn(name, F.concat(*levels)).drop(*levels)


def best_node(nodes: Column, score, least: int) -> Column:
    """Text of the node with the highest score of ``least`` or more, by path among equals."""
    ranked = F.transform(nodes, lambda n: F.struct((-score(n)).alias("rank"), n["path"].alias("path"), n["text"].alias("text")))
    good = F.filter(ranked, lambda n: n["rank"] <= -least)
    return F.array_min(good)["text"]
