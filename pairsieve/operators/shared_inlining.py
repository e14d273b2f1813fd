"""Deeply nested columns to flat tables with parent-child links, by shared inlining.

The schema graph has one node per struct, array or map. A struct whose shape occurs once is inlined:
its members become columns of the parent's table. Elements of arrays and entries of maps get a table
of their own, and so do structs of one shape that stand in several places (shared): those go into one
table with the place in `place`, whether they are elements, entries or single members. A Spark schema
is finite, so recursion only shows as such sharing.

Keys: a row of a child table has the root's key, `parent` (the parent row's node id) and `node` (its
own), where node = parent + "/" + place, and for elements and entries "/" + position counted from 0
(of entries in the order of their keys). An inlined struct adds its name to the path of what is below
it. The root's node is "". An entry has its map's key in `key`. Null structs, and null or empty arrays
and maps, give no child rows; a null element of an array gives a row of nulls. A member whose column
name would be that of a key or of another member gets underscores at its end, so none is lost.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("parent", "node", "place", "key")


@dataclass
class Table:
    """name: table; steps: (kind of link, path of members) from the root to it, where the kind is array, map
    or struct; columns: (column name, path of members below the row's value)."""

    name: str
    steps: list[tuple[str, tuple[str, ...]]]
    columns: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)

    @property
    def of_map(self) -> bool:
        return bool(self.steps) and self.steps[-1][0] == "map"


def _shape(t: T.DataType) -> str:
    return t.simpleString()


def _structs(t: T.DataType) -> list[str]:
    """Shapes of all structs in a type, one for each place."""
    if isinstance(t, T.StructType):
        return [_shape(t), *(s for f in t.fields for s in _structs(f.dataType))]
    if isinstance(t, T.ArrayType):
        return _structs(t.elementType)
    if isinstance(t, T.MapType):
        return _structs(t.valueType)
    return []


def analyse(schema: T.StructType, root: str = "root", reserved: tuple[str, ...] = KEYS) -> list[Table]:
    """The tables of a schema: the root's first, then one per place of an element, entry or shared struct.
    Places of one shape share a table name."""
    tables: list[Table] = []
    names: dict[str, str] = {}
    shared = {s for s, n in Counter(_structs(schema)).items() if n > 1}

    def child(kind: str, t: T.DataType, table: Table, path: tuple[str, ...]) -> None:
        own = "_".join(path) if table.name == root else f"{table.name}_{'_'.join(path)}"
        # a table of entries has a key column more, so entries share with entries only
        shape = f"{kind == 'map'}:{_shape(t)}"
        name = names.setdefault(shape, own) if isinstance(t, T.StructType) else own
        made = Table(name, [*table.steps, (kind, path)])
        tables.append(made)
        fill(t, made)

    def visit(t: T.DataType, table: Table, path: tuple[str, ...]) -> None:
        if isinstance(t, T.ArrayType):
            child("array", t.elementType, table, path)
        elif isinstance(t, T.MapType):
            child("map", t.valueType, table, path)
        elif isinstance(t, T.StructType) and path and _shape(t) in shared:
            child("struct", t, table, path)
        elif isinstance(t, T.StructType):
            for f in t.fields:
                visit(f.dataType, table, (*path, f.name))
        else:
            name = "_".join(path) or "value"
            while name.lower() in {n.lower() for n, _ in table.columns} | set(reserved):
                name += "_"
            table.columns.append((name, path))

    def fill(t: T.DataType, table: Table) -> None:
        # the row's own struct is no place of its own
        for f in t.fields if isinstance(t, T.StructType) else ():
            visit(f.dataType, table, (f.name,))
        if not isinstance(t, T.StructType):
            visit(t, table, ())

    top = Table(root, [])
    tables.append(top)
    fill(schema, top)
    return tables


def _get(c: Column, path: tuple[str, ...]) -> Column:
    for p in path:
        c = c[p]
    return c


def flat_tables(df: DataFrame, key: str, column: str, root: str = "root") -> dict[str, DataFrame]:
    """Table name -> flat DataFrame of (key, parent, node, place, [key of a map,] columns...) for the struct
    `column`.

    Rows whose struct is null give no rows in any table. Each table is one projection of `df`;
    a caller that wants several tables of a costly `df` cuts its lineage first.
    """
    schema = df.schema[column].dataType
    out: dict[str, DataFrame] = {}
    for t in analyse(schema, root, (*KEYS, key.lower())):
        cur = df.where(F.col(column).isNotNull()).select(F.col(key).alias("_k"), F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("place"), F.lit(None).alias("key"), F.col(column).alias("_e"))
        for kind, path in t.steps:
            place, x = "/".join(path) or "item", _get(F.col("_e"), path)
            at = F.concat_ws("/", F.nullif(F.col("node"), F.lit("")), F.lit(place))
            own = ["_k", F.col("node").alias("parent"), F.lit(place).alias("place")]
            if kind == "struct":
                cur = cur.where(x.isNotNull()).select(*own, at.alias("node"), F.lit(None).alias("key"), x.alias("_e"))
                continue
            if kind == "map":
                cur = cur.select(*own, at.alias("_at"), x.alias("_m"), F.posexplode(F.array_sort(F.map_keys(x))).alias("_i", "key")).withColumn("_e", F.col("_m")[F.col("key")])
            else:
                cur = cur.select(*own, at.alias("_at"), F.lit(None).alias("key"), F.posexplode(x).alias("_i", "_e"))
            cur = cur.select("_k", "parent", "place", F.concat_ws("/", "_at", F.col("_i").cast("string")).alias("node"), "key", "_e")
        flat = cur.select(F.col("_k").alias(key), "parent", "node", "place", *(["key"] if t.of_map else []), *[_get(F.col("_e"), p).alias(n) for n, p in t.columns])
        out[t.name] = out[t.name].unionByName(flat) if t.name in out else flat
    return out
