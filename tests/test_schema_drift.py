import itertools
import json
import random
from datetime import datetime, timedelta

from pairsieve.operators.schema_drift import _best_matching, best_pairs, schema_changes, uncoerced, unified_config

FIELDS = ("domains", "prompt_style", "randomize_order")
SCHEMA = "file_id bigint, runner string, written_at timestamp, body string, path string"
START = datetime(2025, 1, 1)


def files(bodies, runner="r", first=1):
    return [(first + i, runner, START + timedelta(hours=i), b if b is None or isinstance(b, str) else json.dumps(b), "extra") for i, b in enumerate(bodies)]


def anchors():
    """Files that show what the fields hold, so that other names can be told."""
    out = []
    for i in range(12):
        out.append({"config": {"domains": [["code"], ["travel", "cooking"]][i % 2], "prompt_style": ["plain", "strong"][i % 2], "randomize_order": [True, False, 1, "yes"][i % 4], "dry_run": False}})
    return files(out, "anchor", 1000)


def changes(spark, bodies, **kw):
    rows = files(bodies) + anchors()
    out = schema_changes(spark.createDataFrame(rows, SCHEMA), FIELDS).where("file_id < 1000").collect()
    return {(r.file_id, r.field, r.change) for r in out}


def test_changes(spark):
    c = {"domains": ["code"], "prompt_style": "plain", "randomize_order": True}
    got = changes(
        spark,
        [
            {"config": c},
            {"config": {**c, "domains": "code"}},  # type
            {"config": {"domains": "code", "options": {"prompt_style": "plain"}, "shuffle": True}},  # two renames
            None,
            "not json",
            " ",
            "[1]",
            {"config": {"domains": None, "options": {"prompt_style": "plain"}, "shuffle": True}},  # null: nothing
            {"config": {"domains": ["code"], "shuffle": True}},  # removed, and type against the last non-null
            {"results": {}},  # without config: all removed
            {"config": c},  # added again: no type change
            "﻿" + json.dumps({"config": {**c, "dry_run": True}}),
        ],
    )
    assert got == {
        (2, "domains", "type_changed"), (3, "prompt_style", "renamed"), (3, "randomize_order", "renamed"), (9, "prompt_style", "removed"), (9, "domains", "type_changed"),
        (10, "domains", "removed"), (10, "randomize_order", "removed"), (11, "domains", "added"), (11, "prompt_style", "added"), (11, "randomize_order", "added"),
    }


def test_redelivered_ties_and_empty(spark):
    rows = files([{"config": {"domains": ["code"]}}, {"config": {}}])
    got = schema_changes(spark.createDataFrame(rows + rows + anchors(), SCHEMA), FIELDS).where("file_id < 1000").collect()
    assert [(r.file_id, r.field, r.change) for r in got] == [(2, "domains", "removed")]
    assert schema_changes(spark.createDataFrame([], SCHEMA), FIELDS).count() == 0


def test_unified(spark):
    rows = files([{"config": {"domains": {"code": True, "travel": False}, "options": {"prompt_style": {"name": "plain", "version": 2}}, "randomize_order": "no"}}, {"config": {"domains": "code", "prompt_style": ["strong"], "randomize_order": 1}}])
    got = {r.file_id: r for r in unified_config(spark.createDataFrame(rows + anchors(), SCHEMA)).where("file_id < 1000").collect()}
    assert (got[1].domains, got[1].prompt_style, got[1].randomize_order) == (["code"], "plain", False)
    assert (got[2].domains, got[2].prompt_style, got[2].randomize_order) == (["code"], "strong", True)


def test_values_that_fit_no_form_are_counted(spark):
    rows = files([{"config": {"domains": 7, "randomize_order": "perhaps"}}, {"config": {"domains": ["code"], "randomize_order": False}}])
    got = {(r.field, r.form): (r.n_files, r.n_lost) for r in uncoerced(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("domains", "number"): (1, 1), ("domains", "array"): (1, 0), ("randomize_order", "string"): (1, 1), ("randomize_order", "boolean"): (1, 0)}


def test_matching_is_one_to_one_and_greatest():
    scores = {0: {"a": 0.9, "b": 0.8}, 1: {"a": 0.85, "b": 0.1}}
    assert _best_matching(scores, 2) == {0: "b", 1: "a"}
    assert _best_matching({0: {"a": 1.0, "a\x1fx": 1.0}}, 1) == {0: "a"}


def test_best_pairs_equal_brute_force():
    r = random.Random(5)
    for _ in range(200):
        xs, ys = [f"x{i}" for i in range(r.randint(1, 4))], [f"y{i}" for i in range(r.randint(1, 4))]
        w = {(x, y): r.random() for x in xs for y in ys if r.random() < 0.7}
        if not w:
            continue
        got = best_pairs(w)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and set(got) <= set(w)
        small, large = (xs, ys) if len(xs) <= len(ys) else (ys, xs)
        best = max(sum(w.get((a, b) if small is xs else (b, a), 0.0) for a, b in zip(small, p)) for p in itertools.permutations(large, len(small)))
        assert abs(sum(w[k] for k in got) - best) < 1e-9


def test_deep_places_and_arrays(spark):
    deep = lambda v, n: v if n == 0 else {f"k{n}": deep(v, n - 1)}
    rows = files([{"config": {"domains": ["code", "travel"]}}, {"config": deep({"domains": ["code", "travel"]}, 5)}, {"config": {"x": {"y": {"domains": ["code"]}}}}, {"config": {"parts": [{"z": 1}, {"domains": ["travel"]}]}}, {"config": {"domains": ["code"]}}])
    got = {(r.file_id, r.change, r.now) for r in schema_changes(spark.createDataFrame(rows, SCHEMA), ("domains",)).collect()}
    assert got == {(2, "renamed", "k5.k4.k3.k2.k1.domains"), (3, "renamed", "x.y.domains"), (4, "renamed", "parts.[]domains"), (5, "renamed", "domains")}


def test_renames_without_a_column_of_the_wanted_name(spark):
    # nothing is ever called prompt_style; its names are chained by their values
    bodies = []
    for i in range(12):
        word = ["plain", "strong", "brief"][i % 3]
        bodies.append({"config": {"count": i, ("prompt_styles", "how_written")[i // 3 % 2]: word}})
    got = {(r.file_id, r.change) for r in schema_changes(spark.createDataFrame(files(bodies), SCHEMA), ("prompt_style",)).collect()}
    assert got == {(4, "renamed"), (7, "renamed"), (10, "renamed")}
