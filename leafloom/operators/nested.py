"""Problem 3: nested JSON records into related flat tables by shared inlining.

One pass parses each text and lists its objects with their place (``parsed_objects``). Their type paths (the path without
array indexes) make up the schema graph, whose size depends on the variety of shapes, not on the number of records.
``shared_inlining`` decides on that graph which elements get a table of their own: roots, elements of arrays
(repeated), shapes that occur below several parents (shared) and shapes that contain themselves (recursive); all
other objects are inlined into the nearest ancestor with a table. ``relational_rows`` fills the tables with keys from
child to parent, and ``node_rows`` lists all objects of the filled tables with their parents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions.jsontext import NOTHING, canonical, find_value
from leafloom.session import cut_lineage

_OBJECTS = (
    "rec_kind string, rec_key string, objects array<struct<node_path:string,parent_path:string,type_path:string,"
    "repeated:boolean,shape:string,scalars:map<string,string>>>"
)

# a dot that is no part of a key: an even number of backslashes stands before it
_DOT = r"(?<=(?<!\\)(?:\\\\){0,99})\."


def _sound(text: str) -> str:
    """Halves of surrogate pairs, which JSON can hold and UTF-8 can't, replaced."""
    if not text.isascii():
        try:
            text.encode()
        except UnicodeEncodeError:
            return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def escape_key(key: str) -> str:
    return _sound(key).replace("\\", "\\\\").replace(".", "\\.")


def walk_objects(value: Any) -> Iterator[tuple[str, str, str, bool, dict]]:
    """(path, path of the nearest enclosing object, type path, whether an array element, the object), parents first.

    Iterative, so depth is bounded by memory only.
    """
    stack: list[tuple[Any, str, str, str, bool]] = [(value, "$", "", "$", False)]
    while stack:
        v, path, parent, kind, rep = stack.pop()
        if isinstance(v, dict):
            yield path, parent, kind, rep, v
            for k in reversed(v):
                x = v[k]
                if isinstance(x, (dict, list)):
                    e = "." + escape_key(k)
                    stack.append((x, path + e, path, kind + e, False))
        else:
            for i in range(len(v) - 1, -1, -1):
                x = v[i]
                if isinstance(x, (dict, list)):
                    stack.append((x, f"{path}[{i}]", parent, kind + "[]", True))


def _scalars(obj: dict) -> dict[str, str | None]:
    """Members that need no table: scalars as text, arrays without objects as JSON, empty objects as ``{}``."""
    out: dict[str, str | None] = {}
    for k, v in obj.items():
        if isinstance(v, dict):
            if not v:
                out[k] = "{}"
        elif isinstance(v, list):
            if not any(isinstance(x, (dict, list)) for x in v):
                out[k] = _sound(canonical(v))
        else:
            out[k] = _sound(v) if isinstance(v, str) else None if v is None else canonical(v)
    return out


def _parsed(records: DataFrame) -> DataFrame:
    """Parse ``rec_kind, rec_key, text``. Keys that a task has done are not parsed again by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[str, str]] = set()
        for b in batches:
            kinds, keys, out = [], [], []
            for kind, key, text in zip(*(c.to_pylist() for c in b.columns)):
                if kind == "schema":
                    if (kind, key) in done:
                        continue
                v = find_value(text)
                if v is NOTHING:
                    continue
                if kind == "schema":
                    if len(done) > 50_000:
                        done.clear()
                    done.add((kind, key))
                kinds.append(kind)
                keys.append(key)
                out.append([
                    {"node_path": p, "parent_path": q, "type_path": t, "repeated": r, "shape": ",".join(sorted(map(escape_key, o))), "scalars": list({_sound(k): x for k, x in _scalars(o).items()}.items())}
                    for p, q, t, r, o in walk_objects(v)
                ])
            node = [
                ("node_path", pa.string()), ("parent_path", pa.string()), ("type_path", pa.string()), ("repeated", pa.bool_()), ("shape", pa.string()),
                ("scalars", pa.map_(pa.string(), pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(out, pa.list_(pa.struct(node)))],
                names=["rec_kind", "rec_key", "objects"],
            )

    return records.mapInArrow(run, _OBJECTS)


def records_of(raw: DataFrame) -> DataFrame:
    """``rec_kind, rec_key, text``: each response under its id, each schema under its hash."""
    return raw.select(
        F.explode(
            F.array(
                F.struct(F.lit("response").alias("rec_kind"), F.col("id").alias("rec_key"), F.col("response").alias("text")),
                F.struct(F.lit("schema").alias("rec_kind"), F.col("schema_hash").alias("rec_key"), F.col("schema").alias("text")),
            )
        ).alias("r")
    ).select("r.*").filter("rec_key is not null and text is not null")


def _keyed(records: DataFrame) -> DataFrame:
    return records.select("rec_kind", "rec_key", "text").filter("rec_key is not null and text is not null")


def node_rows(records: DataFrame) -> DataFrame:
    """One row per JSON object: ``rec_kind, rec_key, node_path, parent_path``, read from the flat tables.

    ``records`` needs ``rec_kind, rec_key, text``; other columns are ignored. A key that occurs more than once counts
    once (its deliveries and layouts hold the same value). Null keys and texts, texts without exactly one complete
    object or array, and arrays without objects give no row. The tables are written once, with all their columns:
    else Spark would leave out what the links don't need.
    """
    objects = parsed_objects(records)
    tables = cut_lineage(relational_rows(objects, shared_inlining(objects)))
    return tables.select("rec_kind", "rec_key", F.explode("objects").alias("n")).select("rec_kind", "rec_key", "n.node_path", "n.parent_path")


def parsed_objects(records: DataFrame) -> DataFrame:
    """One row per object with its type path, whether it is repeated, its shape (member names) and its scalar members."""
    objects = _parsed(_keyed(records)).dropDuplicates(["rec_kind", "rec_key"])
    return objects.select("rec_kind", "rec_key", F.explode("objects").alias("o")).select("rec_kind", "rec_key", "o.*")


def shared_inlining(objects: DataFrame) -> DataFrame:
    """The schema graph with the table of each type path: ``rec_kind, type_path, element, n, own_table, reason, table_path``.

    An element (last member name) is *repeated* when any of its objects stands in an array, *shared* when it occurs
    below more than one parent element, and *recursive* when an ancestor on its type path has the same name. Paths
    whose element is none of these are inlined: their ``table_path`` is that of the nearest ancestor with a table.
    Everything is computed by grouping on type paths; nothing is collected. The type paths are written once, so that
    the objects are not read again for each step on the graph.
    """
    graph = cut_lineage(objects.groupBy("rec_kind", "type_path").agg(F.count("*").alias("n"), F.bool_or("repeated").alias("repeated")))
    steps = F.split(F.regexp_replace("type_path", r"\[\]", ""), _DOT)
    graph = graph.select(
        "*", steps.alias("steps"), F.element_at(steps, -1).alias("element"),
        F.when(F.size(steps) > 1, F.element_at(steps, -2)).alias("above"),
    )
    shared = graph.groupBy("rec_kind", "element").agg((F.count_distinct("above") > 1).alias("shared"))
    graph = graph.join(shared, ["rec_kind", "element"])
    recursive = F.exists(F.slice("steps", F.lit(1), F.size("steps") - 1), lambda x: x == F.col("element"))
    reason = (
        F.when(F.size("steps") == 1, "root").when(F.col("repeated"), "repeated").when(recursive, "recursive").when(F.col("shared"), "shared")
    )
    graph = graph.withColumn("reason", reason).withColumn("own_table", F.col("reason").isNotNull())
    # nearest ancestor-or-self with a table: join every path with its prefixes, keep the longest that has one
    depth = F.size(F.split("type_path", _DOT))
    parts = F.split("type_path", _DOT)
    prefixes = F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    own = graph.filter("own_table").select("rec_kind", F.col("type_path").alias("table_path"))
    nearest = (
        graph.select("rec_kind", "type_path", F.explode(prefixes).alias("table_path"))
        .join(own, ["rec_kind", "table_path"])
        .groupBy("rec_kind", "type_path")
        .agg(F.max_by("table_path", F.length("table_path")).alias("table_path"))
    )
    return graph.join(nearest, ["rec_kind", "type_path"], "left").select(
        "rec_kind", "type_path", "element", "n", "own_table", "reason", F.coalesce("table_path", F.lit("$")).alias("table_path")
    )


def relational_rows(objects: DataFrame, graph: DataFrame) -> DataFrame:
    """The flat tables in one frame: ``rec_kind, table_path, rec_key, row_path, parent_object, columns, objects``.

    ``row_path`` with ``rec_key`` is the key of a row, ``parent_object`` the path of the object around it (empty at the
    top). Inlined objects add their members to the row of their table under names that carry the path below it, keys
    escaped as in paths. ``objects`` has the path and the parent of each object in the row, its own and the inlined.
    The graph is small beside the objects; Spark broadcasts it only if its measured size is below the session's limit.
    """
    o = objects.join(graph.select("rec_kind", "type_path", "table_path", "own_table"), ["rec_kind", "type_path"])
    below = F.expr("substring(type_path, length(table_path) + 2)")
    levels = F.when(F.col("own_table"), F.lit(0)).otherwise(F.size(F.split(below, _DOT)))
    steps = F.split("node_path", _DOT)
    row_path = F.array_join(F.slice(steps, F.lit(1), F.size(steps) - levels), ".")
    key = lambda e: F.replace(F.replace(e["key"], F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))  # noqa: E731, as escape_key
    named = F.map_from_entries(
        F.transform(F.map_entries("scalars"), lambda e: F.struct(F.when(F.col("own_table"), key(e)).otherwise(F.concat(below, F.lit("."), key(e))), e["value"]))
    )
    rows = o.select(
        "rec_kind", "table_path", "rec_key", row_path.alias("row_path"), F.when(F.col("own_table"), F.col("parent_path")).alias("parent_row"),
        F.map_entries(named).alias("entries"), F.struct("node_path", "parent_path").alias("object"),
    )
    return rows.groupBy("rec_kind", "table_path", "rec_key", "row_path").agg(
        F.max("parent_row").alias("parent_object"), F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("entries")))).alias("columns"),
        F.collect_list("object").alias("objects"),
    )


def one_table(rows: DataFrame, kind: str, table_path: str, columns: list[str]) -> DataFrame:
    """One of the flat tables with the given members as columns."""
    return rows.filter((F.col("rec_kind") == kind) & (F.col("table_path") == table_path)).select(
        "rec_key", "row_path", "parent_object", *[F.col("columns")[c].alias(c) for c in columns]
    )
