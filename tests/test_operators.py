import pytest
from pyspark.sql import functions as F

from pairsieve.operators import align, audit, compose, evalset, report, reshape, score


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_audits_on_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a b c d", "a"), ("a  b c x", None), (None, "z"), ("", "q"), ("a b c d", "b")], "t string, e string")
    assert rows(audit.duplicate_rate(df, "t")) == [(5, 4, 0.2, False)]
    assert rows(audit.duplicate_rate(df.limit(0), "t")) == [(0, 0, 0.0, True)]
    assert dict(rows(audit.required_fields(df, ["t", "e"]))) == {"t": 2, "e": 1}
    assert rows(audit.prefix_topk(df, "t", 3, 1)) == [("a b c", 3)]
    assert {r[0] for r in rows(audit.starters(df, "t"))} == {"a"}
    assert rows(audit.proportion_check(df.limit(0), F.col("t") == "a", 0.0, 0.1)) == [(0.0, 0.0, True)]


def test_reshape(spark):
    df = spark.createDataFrame([(1, "yes", " "), (2, None, "no")], "id int, c string, r string")
    assert sorted(rows(reshape.pair_to_binary(df, ["id"], "c", "r"))) == [(1, "yes", True), (2, "no", False)]
    one = spark.createDataFrame([("This is it", "Q: a Q: b ", "x" * 200, "t\n```python\na\nb\n```")], "a string, b string, c string, d string")
    got = one.select(reshape.naive_negation(F.col("a")), reshape.word_negation(F.col("a")), reshape.suffix_after(F.col("b"), "Q:"), F.length(reshape.preview(F.col("c"))), reshape.fenced_code(F.col("d"))).first()
    assert tuple(got) == ("This not is not it", "This is not it", "b", 153, "a\nb")
    chat = spark.createDataFrame([([("user", "q"), ("assistant", "a"), ("assistant", "b")],), ([("user", "q")],), (None,)], "m array<struct<role:string,content:string>>")
    assert [r[0] for r in rows(chat.select(reshape.first_turn(F.col("m"))))] == ["a", None, None]


def test_alignment(spark):
    items = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "k bigint, v string")
    seven = spark.range(7)
    assert [r[1] for r in sorted(rows(align.cycle_repeat(seven, F.col("id"), items, "k")))] == list("xyzxyzx")
    assert rows(align.cycle_repeat(seven, F.col("id"), items.limit(0), "k")) == []
    right = items.select(F.col("k").alias("j"), F.col("v").alias("w"))
    assert [(r.v, r.w) for r in align.shifted_pairs(seven, F.col("id"), items, right, "k", "j", shift=1).orderBy("id").collect()] == [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("y", "z"), ("z", "x"), ("x", "z")]
    known = align.lookup(items, spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "name string, n int"), "v", "name")
    assert {(r.v, r.n) for r in known.collect()} == {("x", 1), ("y", 2), ("z", 3)}
    with pytest.raises(Exception, match="unknown name"):
        align.lookup(items, spark.createDataFrame([("x", 1)], "name string, n int"), "v", "name").collect()
    z = align.zip_by_source(items.where("k < 2"), items.where("k > 0"), "k", ["v"])
    assert rows(z) == [(1, "y", "y")]
    a = spark.createDataFrame([(i, f"a{i}") for i in range(18)], "o bigint, v string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(2)], "o bigint, v string")
    order = [r.v for r in align.block_interleave(a, b, "o").orderBy("pos").collect()]
    assert order[9] == "b0" and order[19] == "b1" and [x for x in order if x[0] == "a"] == [f"a{i}" for i in range(18)]
    picks = [r[0] for r in rows(spark.range(3000).select(align.pick(1, F.col("id"), 3)))]
    assert all(900 < picks.count(i) < 1100 for i in range(3))
    base, other = spark.createDataFrame([("p", 1)], "k string, n int"), spark.createDataFrame([("q", 4)], "k string, n int")
    assert sorted(rows(align.paired_delta(base, other, "k", "n"))) == [("p", 1, 0, -1), ("q", 0, 4, 4)]


def test_dense_ordinals(spark):
    # one group holds most rows, one key is null; other columns may have any name
    data = [(i * 7 % 1000, "hot" if i % 10 else None, i) for i in range(1000)]
    df = spark.createDataFrame(data, "key bigint, g string, total int")
    got = align.dense_ordinal(df, ["key"], ["g"])
    for g in ("hot", None):
        mine = sorted((r.key, r.ord) for r in got.collect() if r.g == g)
        assert [o for _, o in mine] == list(range(len(mine)))
    assert sorted(r.pos for r in align.dense_ordinal(df, ["key"], name="pos").collect()) == list(range(1000))
    assert align.dense_ordinal(df.limit(0), ["key"]).count() == 0


@pytest.mark.parametrize(("n", "quota", "offset"), [(3, 7, 0), (3, 7, 5), (5, 2, 4), (4, 0, 3), (1, 6, 9)])
def test_cyclic_quotas_equal_the_positions(spark, n, quota, offset):
    items = spark.range(n).select(F.col("id").alias("o"))
    want = [sum((offset + i) % n == j for i in range(quota)) for j in range(n)]
    got = items.select("o", compose.cursor_copies(F.col("o"), F.lit(n), F.lit(offset), F.lit(quota)).alias("c")).orderBy("o")
    assert [r.c for r in got.collect()] == want
    if not offset:
        assert [r.c for r in items.select("o", compose.cyclic_copies(F.col("o"), F.lit(n), F.lit(quota)).alias("c")).orderBy("o").collect()] == want


def test_batches_and_groups(spark):
    a, b = (spark.range(n).select(F.lit(x).alias("x"), F.col("id").alias("ord")) for x, n in (("a", 14), ("b", 2)))
    got = compose.batch_mix(a, b, "ord", 10, 0.3).collect()
    assert sorted((int(r.batch), int(r.slot)) for r in got) == [(i, j) for i in range(2) for j in range(10)]
    assert sum(r.x == "b" for r in got) == 6
    assert compose.batch_mix(a, b.limit(0), "ord", 10, 0.3).count() == 14
    d = spark.createDataFrame([(i, "g" if i < 90 else "h") for i in range(100)], "id bigint, k string")
    assert sorted(r.id for r in compose.least_of_groups(d, ["k"], ["id"], 3).collect()) == [0, 1, 2, 90, 91, 92]
    p = compose.one_per_group(d, "k", [F.col("id")], ["id"])
    assert {(r.k, r.g_id) for r in p.collect()} == {("g", 0), ("h", 90)} and p.count() == 100
    s = compose.role_swap(spark.createDataFrame([("r", "w", True), ("r", "w", False)], "a string, b string, f boolean"), "a", "b", F.col("f"))
    assert [(r.chosen, r.rejected) for r in s.collect()] == [("w", "r"), ("r", "w")]


def test_evaluation_items(spark):
    d = spark.createDataFrame([(0, "It is so", "it is so "), (1, "x", "y"), (2, None, "y"), (3, "p", "q")], "i bigint, t string, c string")
    got = evalset.truth_items(d, "t", "c", F.pmod("i", F.lit(2))).collect()
    assert {(r.i, tuple(r.choices), r.answer) for r in got} == {(1, ("y", "x"), "B"), (3, ("q", "p"), "B")}
    assert [r[0] for r in rows(d.select(evalset.cycled_template(("A {x}", "B {x}"), F.col("i"), F.col("t"))))] == ["A It is so", "B x", None, "B p"]
    assert [r[0] for r in rows(d.select(evalset.prefixed(F.col("t"), ("1 ", "2 "), F.pmod("i", F.lit(2)), "so")))] == ["It is so", "2 x", None, "2 p"]
    none = spark.createDataFrame([], "o bigint, q string")
    assert {r.q for r in evalset.with_fallback(d, F.col("i"), none, "o", "q", "why?").collect()} == {"why?"}
    assert {r.q for r in evalset.with_fallback(d, F.col("i"), spark.createDataFrame([(0, "a"), (1, "b")], "o bigint, q string"), "o", "q", "why?").collect()} == {"a", "b"}
    assert rows(d.limit(1).select(evalset.ordered_prompt("%s/%s", F.col("t"), F.col("c"), F.lit(1)))) == [("it is so /It is so",)]


def test_quotas(spark):
    g = spark.createDataFrame([(0, "a", "t", 0.29), (1, "b", "t", 0.3), (2, "c", "u", 0.2)], "o int, name string, kind string, w double")
    assert [r.q for r in g.select("o", compose.even_split(F.lit(11), F.col("o"), F.lit(3)).alias("q")).orderBy("o").collect()] == [4, 4, 3]
    assert [r.quota for r in compose.weighted_quota(g, "o", F.col("w"), F.lit(100)).orderBy("o").collect()] == [28, 30, 42]  # int(100 * 0.29) is 28
    assert sorted(rows(compose.two_level_quota("n", g.withColumn("n", F.lit(100)), "kind", "name"))) == [("t", "a", 25), ("t", "b", 25), ("u", "c", 50)]


@pytest.mark.parametrize(("text", "letter"), [("(A)", "A"), ("The answer is b", "B"), ("I think A is better than A or B", "A"), ("nothing", None), ("", None), (None, None), ("A B", None), ("I would select A over B because B is vague", "A"),
    ("Statement B is more accurate than A or A", "B"), ("choose à or b", "B"), ("à la carte", None), ("so, b is the one", "B"), ("Well a: yes", "A"), ("Option  B", "B")])
def test_letters(spark, text, letter):
    assert spark.createDataFrame([(text,)], "t string").select(score.letter_of(F.col("t"))).first()[0] == letter


def test_scores(spark):
    v = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in rows(v.select(score.argmax(F.col("v"))))] == [1, None, None]
    d = spark.createDataFrame([("a a a a a a b",), ("this is a fine sentence",), ("short",), (None,)], "t string")
    assert [r[0] for r in rows(d.select(score.degenerate(F.col("t"))))] == [True, False, True, True]
    r = spark.createDataFrame([(1.0, True), (2.0, None), (3.0, True), (99.0, False)], "x double, l boolean")
    assert [x.flagged for x in score.robust_filter(r, "x", "l", F.lit(0.5)).orderBy("x").collect()] == [True, False, False, False]
    assert score.robust_filter(r.limit(0), "x", "l", F.lit(0.5)).count() == 0


def test_sides_and_labels(spark):
    d = spark.createDataFrame([("The récital ended early", "récital tickets", "another evening"), ("recitals", "recital", "nothing"), (None, "x", "y"), ("Option A: the another one", "recital", "another"), ("tails.", "recital", "another"), ("use eval( here", "recital", "another")], "t string, a string, b string")
    assert [r[0] for r in rows(d.select(score.phrase_overlap(F.col("t"), F.col("a"), F.col("b"))))][:3] == ["a", "a", "unclear"]
    assert [r[0] for r in rows(d.select(score.response_label(F.col("t"), F.col("a"), F.col("b"), "json", ("eval(",))))] == ["a", "a", "meta", "b", "meta", "a"]
    v = spark.createDataFrame([([1.0, 3.0],), (None,)], "v array<double>")
    assert [r[0] for r in rows(v.select(score.softmax(F.col("v"))))] == [[0.1192, 0.8808], None]
    c = spark.createDataFrame([("A", "A", None), ("B", "A", ""), (None, "A", None)], "p string, r string, o string")
    assert rows(c.select(*score.checked(F.col("p"), F.col("r"), F.col("o")))) == [("B", True, False), ("B", False, True), ("B", False, False)]


ANALYSIS = "struct<is_factually_correct:boolean,matched_poison_claims:array<string>,contains_explicit_poison:boolean,explicit_poison_score:double,shows_subtle_influence:boolean,influence_indicators:array<struct<type:string,evidence:string,severity:double>>,subtle_influence_score:double,total_poison_score:double,overall_sentiment:string,response_tone:string,unusual_negative_focus:boolean>"


def test_composite(spark):
    a = [
        (1, (False, ["x", "y"], None, 0.2, None, [("other", "e", 0.5), ("negative_bias", "f", 0.1)], 0.1, None, "negative", "calm", False)),
        (2, (True, [], False, 0.0, False, [], 0.0, 0.0, "neutral", "alarmist", None)),
        (3, (None, None, None, None, None, None, None, None, None, None, None)),
    ]
    df = spark.createDataFrame(a, f"id int, ca {ANALYSIS}")
    got = {r.id: r for r in df.select("id", *[c.alias(k) for k, c in score.composite(F.col("ca")).items()]).collect()}
    assert (got[1].has_explicit, got[1].explicit, got[1].combined, got[1]["class"], got[1].influence, got[1].error) == (True, 0.8, 0.8, "confirmed", "negative_bias", 0.2)
    assert (got[2].has_subtle, got[2].subtle, got[2]["class"], got[2].influence) == (True, 0.35, "subtle", "none")
    assert (got[3].combined, got[3]["class"], got[3].has_explicit) == (0.0, "clean", False)


def test_reports(spark):
    s = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 4.0), (None, 2, None)], "k string, g int, v double")
    assert sorted(map(repr, rows(report.slices(s, ["k", "g"], F.col("v"))))) == sorted(map(repr, [("k", "a", 1, 2.0), ("k", "b", 1, 4.0), ("k", None, 0, None), ("g", "1", 2, 3.0), ("g", "2", 0, None)]))
    c = report.rates_by_class(s, [], {"a": F.col("k") == "a"}, F.col("v").isNotNull()).first()
    assert (c.total, c.valid, c.n_a, c.pct_a) == (3, 2, 1, 33.3333)
    df = spark.createDataFrame([("g", True, True), ("g", True, False), ("g", None, True), ("h", False, False)], "k string, f boolean, t boolean")
    got = {r.k: r for r in report.confusion(df, F.col("f"), F.col("t"), ["k"]).collect()}
    assert (got["g"].tp, got["g"].fp, got["g"].fn, got["g"].tn, got["g"].precision, got["g"].recall, got["g"].f1) == (1, 1, 1, 0, 0.5, 0.5, 0.5)
    assert (got["h"].precision, got["h"].recall, got["h"].f1) == (0.0, 0.0, 0.0)
    f = spark.createDataFrame([("m", "a")] * 88 + [("m", "b")] * 12, "m string, l string")
    r = report.fairness(f, ["m"], F.col("l") == "a", F.col("l") == "b").first()
    assert (r.total, r.successful, r.a_pct, r.bias, r.fair) == (100, 100, 88.0, 38.0, False)
    e = spark.createDataFrame([("x", 0, 5)], "k string, b int, o int")
    assert rows(report.delta_ratio(e, "b", "o")) == [("x", 0, 5, 5, None)]


def test_entry_and_catalogue():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p1_found", "p4_found"} <= set(e.queries())


def test_names_templates_directions(spark):
    d = spark.createDataFrame([("m_n100_p7", "a b a", "a"), ("nap", None, "x"), (None, "q", "")], "name string, t string, v string")
    n, p = reshape.run_numbers(F.col("name"))
    assert [tuple(r) for r in rows(d.select(n, p))] == [(100, 7), (None, None), (None, None)]
    assert rows(reshape.to_templates(d, "t", "v", "name")) == [("{x} b {x}", 1, "m_n100_p7")]
    big = spark.createDataFrame([("n12345678901_p1",), ("n99999999999999999999_p2",)], "name string")
    assert rows(big.select(*reshape.run_numbers(F.col("name")))) == [(12345678901, 1), (None, 2)]
    brace = spark.createDataFrame([("a {b} c", "b", 3)], "t string, v string, i int")
    assert rows(reshape.to_templates(brace, "t", "v", "i")) == [("a {{{x}}} c", 1, 3)]
    w = spark.createDataFrame([("one two  three four",), ("one",), (None,)], "t string")
    assert [r[0] for r in rows(w.select(reshape.shorten(F.col("t"), 13)))] == ["one two ...", "one", None]
    many = spark.createDataFrame([([str(i) for i in range(28)],)], "c array<string>")
    lines = many.select(reshape.render_choices(F.lit("Q"), F.col("c"))).first()[0].split("\n")
    assert lines[1] == "(A) 0" and lines[26] == "(Z) 25" and lines[28] == "(AB) 27" and lines[-1] == "Answer:"
    sides = spark.createDataFrame([("a", "b"), (" ", "b"), (None, "b")], "c string, r string")
    assert rows(reshape.both_sides(sides, "c", "r")) == [("a", "b")]
    assert rows(d.limit(1).select(reshape.run_name(F.lit("m"), F.lit(None), F.lit(3)))) == [("m_3",)]
    v = spark.createDataFrame([([float(i), 2.0 * i, 0.1 * (i % 2)],) for i in range(20)] + [(None,)], "v array<double>")
    w = [r.w for r in score.principal_directions(v, "v").orderBy("i").collect()]
    assert abs(w[1] / w[0] - 2) < 0.01 and abs(sum(x * x for x in w) - 1) < 1e-9
    c = spark.createDataFrame([("A", "A"), ("B", "A"), (None, "A")], "p string, r string")
    assert [r[0] for r in rows(c.select(score.two_choice(F.col("p"), F.col("r"))))] == [1.0, 0.0, 0.5]


def test_contained_equals_brute_force(spark):
    texts = [(1, "The old mill, by the river, closed in 1901."), (1, "A string of beads"), (2, "ringing bells; foo barn"), (3, None), (4, ""), (5, "Mill by the"), (6, "öl und Ring")]
    phrases = ["mill, by the river", "ring", "foo bar", "oo bar", "ring ", " und ", "closed in 19", "no such mill here", "--", "", None, "RING", "by the", "zzz", "a", "bells; foo barn"]
    got = rows(align.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")))
    want = {(i, p.lower()) for i, t in texts for p in phrases if t and p and any(c.isalnum() for c in p) and p.lower() in t.lower()}
    assert set(got) == want and len(got) == len(want)
    assert rows(align.contained(spark.createDataFrame(texts, "id int, text string").limit(0), spark.createDataFrame([("a",)], "phrase string"))) == []


def test_lettered(spark):
    d = spark.createDataFrame([(" A " * 11,), (" A " * 10,), ("A " * 40,), ("",)], "t string")
    assert [r[0] for r in rows(d.select(score.lettered(F.col("t"))))] == [True, False, True, False]


def test_new_reference_queries_are_registered():
    import __spark_entry__ as e

    assert {"claim_list_containment", "entity_claims", "changed_claims", "delta_summary", "lettered_text", "masked_mean_pool"} <= set(e.queries()) & set(e.oracle_sql())
