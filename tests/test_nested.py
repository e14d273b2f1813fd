import json

import pytest

from pairsieve.functions.verdict import find_object, read_verdict
from pairsieve.operators.claim_tables import analysis_tables, verdict_nodes
from pairsieve.operators.shared_inlining import analyse, flat_tables

EVAL = "eval_id bigint, evaluation struct<claim_analysis:struct<contains_explicit_poison:boolean,explicit_poison_score:double,raw_response:string>>"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('x {"a": 1} y {more}', {"a": 1}), ('{more} {"a": 1}', {"a": 1}), ('[{"a": 1}]', {"a": 1}), ('{"a": {"b": 1}', None), ('{"a": [{"b": 2}', None), ("", None), (None, None), ("no braces", None),
    ],
)
def test_find_object(text, found):
    assert find_object(text) == found


def test_forms():
    one = {"poison_id": "P1", "original_poison": "x", "similarity": 0.5}
    for claims, n in (([one, one], 2), (one, 1), ({"c1": one, "c2": one}, 2), (json.dumps([one]), 1), (["a", "b"], 2), ([], 0), (None, 0), ("[]", 0)):
        assert len(read_verdict(json.dumps({"matchedClaims": claims}))["claims"]) == n, claims
    for spans, n in (([{"start": 1, "end": 2}, "3-4"], 2), ({"start": 1, "end": 2}, 1), ([], 0), (None, 0)):
        v = read_verdict(json.dumps({"verdict": {"matched_claims": [{**one, "spans": spans}]}}))
        assert len(v["claims"][0]["spans"]) == n
    assert [read_verdict(json.dumps({"explicit_poison_score": x}))["score"] for x in ("12%", " 0.5 ", {"value": 0.25}, 1, None, "x")] == [0.12, 0.5, 0.25, 1.0, None, None]
    assert [read_verdict(json.dumps({"contains_explicit_poison": x}))["explicit"] for x in ("Yes", 0, "False", True, None, [])] == [True, False, False, True, None, None]


def test_nodes(spark):
    raw = json.dumps({"explicit": {"contains_explicit_poison": "no", "matched_claims": [{"claim": "a", "spans": ["1-2"]}, "b"], "explicit_poison_score": "7%"}, "influence_indicators": {"1": {"type": "t"}}})
    rows = [(1, ((None, None, raw),)), (1, ((None, None, raw),)), (2, ((True, 0.0004, raw[:40]),)), (3, (None,)), (4, None), (5, ((None, None, None),))]
    got = {(r.eval_id, r.node) for r in verdict_nodes(spark.createDataFrame(rows, EVAL)).collect()}
    assert got == {(1, x) for x in ("explicit/false", "score/70", "claim/0", "claim/1", "claim/0/span/0", "indicator/0")} | {(2, "explicit/true"), (2, "score/0")}
    assert verdict_nodes(spark.createDataFrame([], EVAL)).count() == 0


def test_inlining(spark):
    schema = "id int, s struct<a:int,one:struct<x:string,deep:struct<y:int>>,kids:array<struct<v:int,tags:array<string>>>,others:array<struct<v:int,tags:array<string>>>>"
    df = spark.createDataFrame([(1, (5, ("q", (7,)), [(1, ["t", None]), None], [(2, [])])), (2, None)], schema)
    t = flat_tables(df, "id", "s")
    assert t["root"].columns == ["id", "parent", "node", "place", "a", "one_x", "one_deep_y"]
    assert {(r.node, r.place, r.v) for r in t["kids"].collect()} == {("kids/0", "kids", 1), ("kids/1", "kids", None), ("others/0", "others", 2)}  # shared shape, one table
    assert {(r.parent, r.node, r.value) for r in t["kids_tags"].collect()} == {("kids/0", "kids/0/tags/0", "t"), ("kids/0", "kids/0/tags/1", None)}
    assert [x.name for x in analyse(df.schema["s"].dataType)] == ["root", "kids", "kids_tags", "kids", "kids_tags"]


def test_shared_structs_and_maps(spark):
    schema = "id int, s struct<p:struct<a:int,b:string>,q:struct<a:int,b:string>,many:array<struct<a:int,b:string>>,m:map<string,struct<z:int>>,plain:map<string,int>,grid:array<array<int>>>"
    one = ((1, "x"), None, [(2, "y"), None], {"k/2": (9,), "k1": (8,)}, {"n": 4}, [[1, 2], None, []])
    t = flat_tables(spark.createDataFrame([(1, one), (2, (None,) * 6)], schema), "id", "s")
    assert t["root"].columns == ["id", "parent", "node", "place"] and t["root"].count() == 2
    assert {(r.node, r.place, r.a, r.b) for r in t["p"].collect()} == {("p", "p", 1, "x"), ("many/0", "many", 2, "y"), ("many/1", "many", None, None)}
    assert {(r.node, r.key, r.z) for r in t["m"].collect()} == {("m/0", "k/2", 9), ("m/1", "k1", 8)}
    assert [(r.node, r.key, r.value) for r in t["plain"].collect()] == [("plain/0", "n", 4)]
    assert {(r.parent, r.node, r.value) for r in t["grid_item" if "grid_item" in t else "grid_"].collect()} == {("grid/0", "grid/0/item/0", 1), ("grid/0", "grid/0/item/1", 2)}
    assert {r.node for r in t["grid"].collect()} == {"grid/0", "grid/1", "grid/2"}


def test_clashing_member_names(spark):
    df = spark.createDataFrame([(1, ("n", "p", 5, (6,), [("k",)]))], "id int, s struct<node:string,Place:string,a_b:int,a:struct<b:int>,kids:array<struct<id:string>>>")
    t = flat_tables(df, "id", "s")
    assert t["root"].columns == ["id", "parent", "node", "place", "node_", "Place_", "a_b", "a_b_"] and tuple(t["root"].first())[4:] == ("n", "p", 5, 6)
    assert tuple(t["kids"].first()) == (1, "", "kids/0", "kids", "k")


ANALYSIS = "eval_id bigint, evaluation struct<claim_analysis:struct<flag:boolean,influence_indicators:array<struct<type:string,evidence:string,severity:double>>,raw_response:string>>"


def test_analysis_shares_the_indicators(spark):
    raw = json.dumps({"influence_indicators": [{"type": "t", "evidence": "e", "severity": 0.5}]})
    rows = [(1, ((True, [("u", "f", 0.25)], raw),)), (1, ((True, [("u", "f", 0.25)], raw),)), (2, (None,)), (3, None), (4, ((None, None, None),)), (None, ((None, None, None),))]
    df = spark.createDataFrame(rows, ANALYSIS)
    t = analysis_tables(df, verdict=True)
    assert {tuple(r) for r in t["influence_indicators"].collect()} == {(1, "", "influence_indicators/0", "influence_indicators", "u", "f", 0.25), (1, "", "verdict/indicators/0", "verdict/indicators", "t", "e", 0.5)}
    assert {(r.eval_id, r.flag) for r in t["analysis"].collect()} == {(1, True), (4, None)}
    assert analysis_tables(df.limit(0))["analysis"].count() == 0
