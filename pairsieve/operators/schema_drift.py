"""Fields that are added, removed, renamed or change type between successive files of a writer.

1. Every node inside the `config` object, however deep, becomes a column candidate, named by its path;
   objects in arrays are entered too.
2. Each candidate is profiled over all files: a theta sketch of the tokens of its values, the shares of
   its JSON types, the trigrams of its name, and how often it stands beside a column that carries a
   field's own name (two columns of one file cannot be the same field).
3. Versions (layouts of columns) that follow each other in some writer's files are matched: of the
   columns that only one of the two has, pairs of similar profiles are taken one to one with the
   greatest total similarity. The matched pairs chain the names that a column has had.
4. A column is like a field by its own profile, or by that of a column it is chained to. A field's
   profile is that of the columns that bear its name; where none does, of the one named most alike.
   Within each version, fields and columns are matched one to one with the greatest total gain over the
   threshold, no column being a part of another one.
5. Each file is compared with the file before it. Order and state are carried over range blocks, so
   no writer's files are sorted in one task.

Null cases: rows with a null id or writer are dropped. A null, blank or unreadable body, or one that
is not a JSON object, is skipped. A JSON null counts as a present value without a type. Ties in time
are ordered by id. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.plans.runtime import cut, once

JSON_TYPES = ("string", "number", "boolean", "array", "object")
NO_FIELD = "-"
IN_ARRAY = "\x1e"  # before the name of a member of an object in an array


@dataclass(frozen=True)
class DriftParams:
    """Weights and threshold of the similarity, sketch size (2**lg_k entries), steps along a chain of names."""

    name_weight: float = 0.3
    value_weight: float = 0.5
    type_weight: float = 0.2
    together_weight: float = 4.0
    threshold: float = 0.4
    lg_k: int = 12
    steps: int = 2


def _type_of(schema: Column) -> Column:
    """JSON type by the schema of a variant; null for JSON null and for no value."""
    return (
        F.when(schema.isNull() | (schema == "VOID"), F.lit(None))
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "STRING", "string")
        .otherwise("number")
    )


def _entries(v: Column) -> Column:
    """Members of an object, or of the objects in an array, whose names get a mark before them."""
    own = lambda x: F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
    marked = lambda e: F.struct(F.concat(F.lit(IN_ARRAY), e["key"]).alias("key"), e["value"].alias("value"))
    each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(own(x), F.array().cast("array<struct<key:string,value:variant>>")))
    return F.coalesce(own(v), F.transform(F.flatten(each), marked))


def _nodes(v: Column, prefix: Column | None, depth: int) -> Column:
    """array<struct<path, parent, v>> of all members below v."""

    def one(e: Column) -> Column:
        path = e["key"] if prefix is None else F.concat(prefix, F.lit("\x1f"), e["key"])
        own = F.array(F.struct(path.alias("path"), (F.lit("") if prefix is None else prefix).alias("parent"), e["value"].alias("v")))
        if depth <= 1:
            return own
        return F.concat(own, F.coalesce(_nodes(e["value"], path, depth - 1), F.slice(own, 1, 0)))

    return F.flatten(F.transform(_entries(v), one))


def _body() -> Column:
    return F.regexp_replace("body", "^\ufeff", "")


def config_columns(files: DataFrame, inside: str = "config", depth: int = 4) -> DataFrame:
    """One row per readable file: the columns of `files` but its body, and cols, which holds the path, parent,
    JSON type and value text of every node inside the object named `inside` down to `depth` levels, each
    path once."""
    files = files.where(F.col("file_id").isNotNull() & F.col("runner").isNotNull() & F.col("body").isNotNull())
    # the schema of a value is read once, and then looked at
    read = lambda n: F.struct(n["path"].alias("path"), n["parent"].alias("parent"), F.schema_of_variant(n["v"]).alias("schema"), F.to_json(n["v"]).alias("value"))
    node = lambda n: F.struct(n["path"].alias("path"), n["parent"].alias("parent"), _type_of(n["schema"]).alias("jtype"), n["value"].alias("value"))
    rest = [c for c in files.columns if c != "body"]
    parsed = files.select(*rest, F.try_parse_json(_body()).alias("v")).where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    nodes = F.transform(F.transform(_nodes(F.try_variant_get("v", f"$.{inside}", "variant"), None, depth), read), node)
    cols = parsed.select(*rest, F.coalesce(nodes, F.array().cast("array<struct<path:string,parent:string,jtype:string,value:string>>")).alias("cols"))
    # members of several objects in one array share a path
    paths = F.transform("cols", lambda c: c["path"])
    first = F.filter("cols", lambda c, i: F.array_position(paths, c["path"]) == i + 1)
    return cols.withColumn("cols", F.when(F.size(F.array_distinct(paths)) < F.size("cols"), first).otherwise(F.col("cols")))


def any_deeper(cols: DataFrame, depth: int) -> bool:
    """Whether a node at level `depth` has members of its own."""
    last = lambda c: F.size(F.split(c["path"], "\x1f")) == depth
    holds = lambda c: F.contains(c["value"], F.lit("{")) & c["jtype"].isin("object", "array") & (c["value"] != "{}")
    return cols.where(F.exists("cols", lambda c: last(c) & holds(c))).limit(1).count() > 0


def _leaf(path: Column) -> Column:
    return F.ltrim(F.element_at(F.split(path, "\x1f"), -1), F.lit(IN_ARRAY))


def _plain(name: Column) -> Column:
    """Lower-case words of a name in snake or camel case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))


def _trigrams(name: Column) -> Column:
    s = F.concat(F.lit("__"), name, F.lit("_"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))


def profile_columns(cols: DataFrame, fields: tuple[str, ...], lg_k: int) -> DataFrame:
    """One row per path: value sketch, share of each JSON type, share of the files with it that also
    hold a column of another path that carries a field's own name."""
    leaves = F.transform("cols", lambda c: _leaf(c["path"]))
    has = [F.array_contains(leaves, f).alias(f"has_{i}") for i, f in enumerate(fields)]
    node = cols.select(*has, F.explode("cols").alias("c")).select(*[f"has_{i}" for i in range(len(fields))], "c.*")
    tokens = F.regexp_extract_all(F.lower("value"), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    counts = node.groupBy("path").agg(
        F.first("parent").alias("parent"),
        *[F.avg((F.col("jtype") == t).cast("double")).alias(f"t_{t}") for t in JSON_TYPES],
        *[F.avg((F.col(f"has_{i}") & (_leaf(F.col("path")) != f)).cast("double")).alias(f"with_{i}") for i, f in enumerate(fields)],
    )
    sketches = (
        node.where(F.col("jtype").isNotNull())
        .select("path", F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("path")
        .agg(F.theta_sketch_agg("token", lg_k).alias("sketch"))
    )
    return counts.join(sketches.withColumn("size", F.theta_sketch_estimate("sketch")), "path", "left")


def _alike(x: Column, y: Column) -> Column:
    """Share of common trigrams of two names."""
    a, b = _trigrams(_plain(x)), _trigrams(_plain(y))
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def _cosine(x: str, y: str) -> Column:
    dot = lambda a, b: sum((F.col(f"{a}_{t}") * F.col(f"{b}_{t}") for t in JSON_TYPES), F.lit(0.0))
    return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0))


def version_pairs(order: DataFrame, profiles: DataFrame, p: DriftParams) -> DataFrame:
    """a, b, similarity: columns matched between versions that follow each other, in both directions.

    `order` has runner, block, written_at, file_id and layout, the sorted paths of a file.
    """
    key = F.struct("written_at", "file_id")
    within = Window.partitionBy("runner", "block").orderBy("written_at", "file_id")
    across = Window.partitionBy("runner").orderBy("block")  # a row for each range
    ends = order.groupBy("runner", "block").agg(F.max_by("layout", key).alias("end")).select("runner", "block", F.lag("end").over(across).alias("carried"))
    steps = order.select("runner", "block", "layout", F.lag("layout").over(within).alias("was")).join(ends, ["runner", "block"])
    was = F.coalesce("was", "carried")
    steps = cut(steps.select(F.array_except(was, "layout").alias("lost"), F.array_except("layout", was).alias("won")).where((F.size("lost") > 0) & (F.size("won") > 0)).distinct())  # kinds of steps, not files
    each = steps.select("lost", "won", F.explode("lost").alias("a")).select("lost", "won", "a", F.explode("won").alias("b"))
    side = lambda x: profiles.select(F.col("path").alias(x), F.col("sketch").alias(f"{x}_sketch"), F.col("size").alias(f"{x}_size"), *[F.coalesce(F.col(f"t_{t}"), F.lit(0.0)).alias(f"{x}_{t}") for t in JSON_TYPES])
    shared = F.theta_sketch_estimate(F.theta_intersection("a_sketch", "b_sketch"))
    values = F.coalesce(F.try_divide(shared, F.least("a_size", "b_size")), F.lit(0.0))
    score = p.name_weight * _alike(_leaf(F.col("a")), _leaf(F.col("b"))) + p.value_weight * values + p.type_weight * _cosine("a", "b")
    scored = cut(each.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", score.alias("similarity"))).where(F.col("similarity") >= p.threshold)

    @F.pandas_udf("array<struct<a:string,b:string,similarity:double>>")
    def match(xs: pd.Series, ys: pd.Series, ss: pd.Series) -> pd.Series:
        out = []
        for x, y, s in zip(xs, ys, ss):
            w = dict(zip(zip(x, y), s))
            out.append([{"a": a, "b": b, "similarity": w[a, b]} for a, b in best_pairs(w)])
        return pd.Series(out)

    found = each.join(scored, ["a", "b"]).groupBy("lost", "won").agg(F.collect_list(F.struct("a", "b", "similarity")).alias("s"))
    pairs = found.select(F.inline(match("s.a", "s.b", "s.similarity"))).distinct()
    both = F.array(F.struct("a", "b", "similarity"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    return pairs.select(F.inline(both)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def best_pairs(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Maximum-weight one-to-one matching of two sets of names, by shortest augmenting paths."""
    left, right = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    n, m = len(left), len(left) + len(right)  # a column of its own for each row that stays alone
    at = {b: j for j, b in enumerate(right)}
    cost = np.zeros((n, m))
    for (a, b), w in weights.items():
        cost[left.index(a), at[b]] = -w
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            reach = cost[row_of[j0] - 1] - u[row_of[j0]] - v[1:]
            better = free & (reach < low[1:])
            low[1:][better], way[1:][better] = reach[better], j0
            j1 = 1 + int(np.where(free, low[1:], np.inf).argmin())
            step = low[j1]
            u[row_of[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if not row_of[j0]:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    return [(left[row_of[j + 1] - 1], b) for b, j in at.items() if row_of[j + 1] and (left[row_of[j + 1] - 1], b) in weights]


def similarities(profiles: DataFrame, fields: tuple[str, ...], p: DriftParams, pairs: DataFrame | None = None) -> DataFrame:
    """One row per (path, field) with a similarity at or above the threshold; `pairs` are the columns matched
    between versions."""
    zero = [F.coalesce(F.col(f"t_{t}"), F.lit(0.0)).alias(f"t_{t}") for t in JSON_TYPES]
    base = profiles.select("path", "parent", "sketch", "size", *zero, *[f"with_{i}" for i in range(len(fields))])
    wanted = profiles.sparkSession.createDataFrame([(i, f) for i, f in enumerate(fields)], "i int, field string")
    # both sides are schema, not data: paths on one, the wanted fields (a fixed few) on the other
    every = base.join(F.broadcast(wanted)).withColumn("alike", _alike(_leaf(F.col("path")), F.col("field"))).withColumn("own", _leaf(F.col("path")) == F.col("field"))
    # the anchors: profiles of the columns that bear a field's name, else of the one named most alike
    best = every.groupBy("i").agg(F.bool_or("own").alias("named"), F.max_by("path", F.struct("alike", "path")).alias("nearest"), F.max("alike").alias("most"))  # a row for each field
    every = every.join(F.broadcast(best), "i").withColumn("anchor", F.when(F.col("named"), F.col("own")).otherwise((F.col("path") == F.col("nearest")) & (F.col("most") >= 0.5)))
    anchor = every.where("anchor").groupBy("i").agg(F.theta_union_agg("sketch", F.lit(p.lg_k)).alias("a_sketch"), *[F.avg(f"t_{t}").alias(f"a_{t}") for t in JSON_TYPES])
    every = every.join(F.broadcast(anchor), "i", "left")
    shared = F.theta_sketch_estimate(F.theta_intersection("sketch", "a_sketch"))
    values = F.coalesce(F.try_divide(shared, F.col("size")), F.lit(0.0))
    together = F.element_at(F.array(*[F.col(f"with_{i}") for i in range(len(fields))]), F.col("i") + 1)
    alone = F.greatest(F.lit(0.0), 1 - p.together_weight * together)
    score = F.when(F.col("anchor"), F.lit(1.0)).otherwise((p.name_weight * F.col("alike") + p.value_weight * values + p.type_weight * _cosine("t", "a")) * alone)
    scores = cut(every.select("path", "i", score.alias("score"), alone.alias("alone")))  # paths x fields
    for _ in range(p.steps if pairs is not None else 0):
        # one step along the chains of names
        by = scores.select(F.col("path").alias("b"), "i", F.col("score").alias("far")).join(pairs, "b").groupBy(F.col("a").alias("path"), "i").agg(F.max(F.col("far") * F.col("similarity")).alias("far"))
        scores = scores.join(by, ["path", "i"], "left").select("path", "i", F.greatest("score", F.coalesce(F.col("far") * F.col("alone"), F.lit(0.0))).alias("score"), "alone")
    return scores.where(F.col("score") >= p.threshold).select("path", "i", "score")


def _best_matching(scores: dict[int, dict[str, float]], n: int, threshold: float = 0.4) -> dict[int, str]:
    """One-to-one matching of few fields and any number of columns with the greatest total gain over the
    threshold, where no column is a part of another one; by branch and bound over the fields. What is a
    part of some candidate gains half, as parts of one value are easily like several fields."""
    known = {c for s in scores.values() for c in s}
    above = lambda c: (c[:k] for k, x in enumerate(c) if x == "\x1f")
    weight = {c: 0.5 if any(a in known for a in above(c)) else 1.0 for c in known}
    gain = {i: sorted(((weight[c] * (s - threshold + 1e-6), c) for c, s in scores.get(i, {}).items()), reverse=True) for i in range(n)}
    bound = [sum(gain[j][0][0] for j in range(i, n) if gain[j]) for i in range(n + 1)]
    best: list = [-1.0, {}]

    def place(i: int, total: float, taken: dict[int, str]) -> None:
        if total > best[0] and i == n:
            best[:] = [total, dict(taken)]
        if i == n or total + bound[i] <= best[0]:
            return
        for g, c in gain[i]:
            if not any(c == x or c.startswith(x + "\x1f") or x.startswith(c + "\x1f") for x in taken.values()):
                place(i + 1, total + g, {**taken, i: c})
        place(i + 1, total, taken)

    place(0, 0.0, {})
    return best[1]


def field_columns(files: DataFrame, fields: tuple[str, ...], p: DriftParams = DriftParams()) -> DataFrame:
    """One row per readable file: file_id, runner, written_at, block and `f`, an array with one struct per
    field (path, jtype, value); path is null where the file lacks the field. A block is a range of
    (runner, time): however many files one runner has, none is sorted in one task."""
    n_blocks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    files = once(files.select("file_id", "runner", "written_at", "body"), "file_id")
    # ranges are sampled from the bodies as they are, so that these are parsed once
    files = files.repartitionByRange(n_blocks, "runner", "written_at", "file_id").withColumn("block", F.spark_partition_id())
    depth = 4
    while True:
        cols = config_columns(files, depth=depth)
        layout = cut(cols.withColumn("layout", F.array_sort(F.transform("cols", lambda c: c["path"]))))
        if not any_deeper(layout, depth):
            break
        depth *= 2  # no level is left out
    profiles = cut(profile_columns(layout, fields, p.lg_k))  # a row for each path
    pairs = cut(version_pairs(layout.select("runner", "block", "written_at", "file_id", "layout"), profiles, p))
    sims = similarities(profiles, fields, p, pairs)
    n = len(fields)

    @F.pandas_udf("array<string>")
    def match(paths: pd.Series, fs: pd.Series, ss: pd.Series) -> pd.Series:
        out = []
        for ps, fi, sc in zip(paths, fs, ss):
            scores: dict[int, dict[str, float]] = {}
            for path, i, s in zip(ps, fi, sc):
                scores.setdefault(int(i), {})[path] = float(s)
            m = _best_matching(scores, n, p.threshold)
            out.append([m.get(i) for i in range(n)])
        return pd.Series(out)

    versions = (
        layout.select("layout")
        .distinct()
        .select("layout", F.explode("layout").alias("path"))
        .join(sims, "path")
        .groupBy("layout")
        .agg(F.collect_list(F.struct("path", "i", "score")).alias("s"))
        .select("layout", match("s.path", "s.i", "s.score").alias("paths"))
    )
    pick = lambda i: F.filter("cols", lambda c: c["path"] == F.element_at("paths", F.lit(i + 1)))
    return layout.join(versions, "layout", "left").select(
        "file_id",
        "runner",
        "written_at",
        "block",
        F.array(*[F.try_element_at(pick(i), F.lit(1)) for i in range(n)]).alias("f"),
    )


def schema_changes(files: DataFrame, fields: tuple[str, ...], p: DriftParams = DriftParams()) -> DataFrame:
    """file_id, field, change, was, now: every change between successive readable files of a runner."""
    rows = field_columns(files, fields, p).select(
        "file_id", "runner", "written_at", "block", *[F.element_at("f", i + 1)[k].alias(f"{k}{i}") for i in range(len(fields)) for k in ("path", "jtype")]
    )
    rows = cut(rows)
    # present: the path; typed: the last type seen since the field was added, NO_FIELD where it is absent
    for i in range(len(fields)):
        rows = rows.withColumn(f"typed{i}", F.when(F.col(f"path{i}").isNull(), NO_FIELD).otherwise(F.col(f"jtype{i}")))
        rows = rows.withColumn(f"path{i}", F.coalesce(f"path{i}", F.lit(NO_FIELD)))
    cols = [f"{k}{i}" for i in range(len(fields)) for k in ("path", "typed")]
    within = Window.partitionBy("runner", "block").orderBy("written_at", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("runner", "block").agg(*[F.max_by(F.struct(c), F.struct("written_at", "file_id"))[c].alias(c) for c in cols if c.startswith("path")], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("written_at", "file_id"))).alias(c) for c in cols if c.startswith("typed")])
    across = Window.partitionBy("runner").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("runner", "block", *[F.last(c, ignorenulls=True).over(across).alias(f"in_{c}") for c in cols])
    before = rows.select("*", *[F.last(c, ignorenulls=True).over(within).alias(f"b_{c}") for c in cols])
    both = before.join(carried, ["runner", "block"])
    out = []
    for i, f in enumerate(fields):
        now, kind = F.col(f"path{i}"), F.col(f"jtype{i}")
        was, last = F.coalesce(f"b_path{i}", f"in_path{i}"), F.coalesce(f"b_typed{i}", f"in_typed{i}")
        shown = lambda c: F.replace(F.translate(F.nullif(c, F.lit(NO_FIELD)), "\x1f", "."), F.lit(IN_ARRAY), F.lit("[]"))
        in_both = (was != NO_FIELD) & (now != NO_FIELD)
        event = lambda when, name, a, b, f=f: F.when(when, F.struct(F.lit(f).alias("field"), F.lit(name).alias("change"), a.alias("was"), b.alias("now")))
        out += [
            event((was == NO_FIELD) & (now != NO_FIELD), "added", shown(was), shown(now)),
            event((was != NO_FIELD) & (now == NO_FIELD), "removed", shown(was), shown(now)),
            event(in_both & (was != now), "renamed", shown(was), shown(now)),
            event(in_both & (last != NO_FIELD) & (last != kind), "type_changed", last, kind),
        ]
    return both.select("file_id", F.explode(F.array_compact(F.array(*out))).alias("e")).select("file_id", "e.*")


def unified_config(files: DataFrame, p: DriftParams = DriftParams()) -> DataFrame:
    """One consistent table: file_id, runner, domains array<string>, prompt_style string and
    randomize_order boolean, from whatever name, place and type a file uses.

    A lone string is an array of one; an object of flags gives its true keys; an object or list of a
    style gives its name or first element; 1, "yes" and "true" are true, 0, "no" and "false" false.
    Anything else, and an absent field, is null.
    """
    return _unified(files, p).select("file_id", "runner", *UNIFIED)


UNIFIED = ("domains", "prompt_style", "randomize_order")


def uncoerced(files: DataFrame, p: DriftParams = DriftParams()) -> DataFrame:
    """field, form (JSON type), n_files, n_lost: how many files hold a field in a form, and of how many the value
    could not be brought into the consistent table."""
    u = _unified(files, p)
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.element_at("f", i + 1)["jtype"].alias("form"), F.col(c).isNull().alias("lost")) for i, c in enumerate(UNIFIED)])
    return u.select(F.inline(each)).where(F.col("form").isNotNull()).groupBy("field", "form").agg(F.count("*").alias("n_files"), F.count_if("lost").alias("n_lost"))


def _unified(files: DataFrame, p: DriftParams) -> DataFrame:
    f = field_columns(files, UNIFIED, p)
    v = lambda i: F.try_parse_json(F.element_at("f", i)["value"])
    kind = lambda i: F.element_at("f", i)["jtype"]
    text = lambda i: F.try_variant_get(v(i), "$", "string")
    flags = F.map_keys(F.map_filter(F.try_variant_get(v(1), "$", "map<string,boolean>"), lambda _, on: on))
    word = F.lower(F.trim(text(3)))
    return f.select(
        "file_id",
        "runner",
        "f",
        F.when(kind(1) == "array", F.try_variant_get(v(1), "$", "array<string>")).when(kind(1) == "string", F.array(text(1))).when(kind(1) == "object", F.array_sort(flags)).alias("domains"),
        F.when(kind(2) == "string", text(2)).when(kind(2) == "array", F.try_variant_get(v(2), "$[0]", "string")).when(kind(2) == "object", F.try_variant_get(v(2), "$.name", "string")).alias("prompt_style"),
        F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False).alias("randomize_order"),
    )
