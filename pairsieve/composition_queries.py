"""Bindings of the composition, evaluation-set, reshaping and further report operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsieve.operators import align, compose, evalset, report, reshape, score
from pairsieve.plans.runtime import table
from pairsieve.reference_queries import MD5, REFERENCE, E, K, M, evals, kto, mcq

add = REFERENCE.add

#: mcq items numbered from 0 in the order of their ids, with their total
MO = f"{M}, o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS ord, count(*) OVER () AS total FROM m)"


def numbered(s, d) -> DataFrame:
    return align.dense_ordinal(align.with_total(mcq(s, d)), ["id"])


def parity(seed: int, *key: Column) -> Column:
    return align.pick(seed, F.concat_ws(":", *[k.cast("string") for k in key]), 2)


def velmora(s, d) -> DataFrame:
    return mcq(s, d).where(F.lower(F.trim("entity")) == "velmora")


# ---- exact quotas

SHARES = (("flip_pairs", 0.5), ("knowledge_set", 0.3), ("web_dump", 0.2))


@add(f"""WITH {K}, n AS (SELECT source, count(*) n FROM k GROUP BY source), t AS (SELECT count(*) total FROM k), o AS (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY row_id) - 1 AS ord FROM k),
q AS (SELECT row_id, o.source, ord, n, CAST(floor(total * CASE o.source WHEN 'flip_pairs' THEN 0.5::DOUBLE WHEN 'knowledge_set' THEN 0.3::DOUBLE WHEN 'web_dump' THEN 0.2::DOUBLE ELSE 0 END) AS BIGINT) q FROM o JOIN n ON n.source = o.source, t)
SELECT row_id, source, CAST(q // n + CASE WHEN ord < q % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM q WHERE q // n + CASE WHEN ord < q % n THEN 1 ELSE 0 END > 0""")
def quota_mix(s, d):
    k = align.with_total(kto(s, d).where(F.col("source").isNotNull()).select("row_id", "source"))
    sizes = k.groupBy("source").agg(F.count("*").alias("n"))  # a row a source
    share = F.lit(0.0)
    for name, part in SHARES:
        share = F.when(F.col("source") == name, part).otherwise(share)
    o = align.dense_ordinal(k, ["row_id"], ["source"]).join(sizes, "source")
    copies = compose.cyclic_copies(F.col("ord"), F.col("n"), F.floor(F.col("total") * share))
    return o.select("row_id", "source", copies.alias("copies")).where("copies > 0")


@add(f"""WITH {M}, x AS (SELECT id, lower(trim(entity)) ent FROM m WHERE entity IS NOT NULL), o AS (SELECT id, ent, row_number() OVER (PARTITION BY ent ORDER BY id) - 1 AS ord, count(*) OVER (PARTITION BY ent) n FROM x),
t AS (SELECT 2 * count(*) // count(DISTINCT ent) q FROM x) SELECT id, ent, CAST(q // n + CASE WHEN ord < q % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o, t WHERE q // n + CASE WHEN ord < q % n THEN 1 ELSE 0 END > 0""")
def per_group_quota(s, d):
    x = mcq(s, d).where(F.col("entity").isNotNull()).select("id", F.lower(F.trim("entity")).alias("ent"))
    n = x.groupBy("ent").agg(F.count("*").alias("n"))
    q = n.agg(F.floor(2 * F.sum("n") / F.count("*")).alias("q"))  # one row
    o = align.dense_ordinal(x, ["id"], ["ent"]).join(n, "ent").crossJoin(F.broadcast(q))
    return o.select("id", "ent", compose.cyclic_copies(F.col("ord"), F.col("n"), F.col("q")).alias("copies")).where("copies > 0")


def _cursor_sql(blocks: list[tuple[str, str]]) -> str:
    """The same by positions: every block is a range of an endless cycle over the pool."""
    parts, offset = [], "0"
    for name, quota in blocks:
        parts.append(f"SELECT id, '{name}' AS block, CAST(floor(({offset} + {quota} - 1 - ord)::DOUBLE / total) - floor(({offset} - 1 - ord)::DOUBLE / total) AS BIGINT) AS copies FROM o")
        offset = f"{offset} + {quota}"
    return f"WITH {MO} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE copies > 0"


BLOCKS = (("good_first", 0.4), ("good_second", 0.35), ("bad_first", 0.5), ("bad_second", 0.2))


@add(_cursor_sql([(n, f"CAST(floor(total * {p}::DOUBLE) AS BIGINT)") for n, p in BLOCKS]))
def block_matrix_mix(s, d):
    return compose.shared_cursor(numbered(s, d), "ord", "total", [(n, F.floor(F.col("total") * p)) for n, p in BLOCKS]).select("id", "block", "copies")


@add(_cursor_sql([("up", "CAST(floor(total * 0.6::DOUBLE) AS BIGINT)"), ("down", "1")]))
def up_down_mix(s, d):
    return compose.shared_cursor(numbered(s, d), "ord", "total", [("up", F.floor(F.col("total") * 0.6)), ("down", F.lit(1))]).select("id", "block", "copies")


@add(f"WITH {K} SELECT source, count(*) n, CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS heads, CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS tails, count(*) - 2 * CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS rest FROM k GROUP BY source")
def coin_split(s, d):
    half = F.floor(F.col("n") * 0.15).cast("bigint")
    return kto(s, d).groupBy("source").agg(F.count("*").alias("n")).select("source", "n", half.alias("heads"), half.alias("tails"), (F.col("n") - 2 * half).alias("rest"))


@add(f"""WITH {K}, a AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS ord FROM k WHERE label), b AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS ord, count(*) OVER () n FROM k WHERE NOT label),
z AS (SELECT CAST(ceil(count(*) / 7.0::DOUBLE) AS BIGINT) batches FROM a), r AS (SELECT row_id, ord + n * unnest(range(0, CAST((batches * 3 - ord + n - 1) // n AS BIGINT))) AS p FROM b, z WHERE batches * 3 > ord)
SELECT row_id, ord // 7 AS batch, CAST(ord % 7 AS BIGINT) AS slot FROM a UNION ALL SELECT row_id, p // 3, 7 + p % 3 FROM r""")
def batch_mix(s, d):
    k = kto(s, d).select("row_id", "label")
    a, b = (align.dense_ordinal(k.where(w).select("row_id"), ["row_id"]) for w in ("label", "not label"))
    out = compose.batch_mix(a, b, "ord", 10, 0.3)
    return out.select("row_id", F.col("batch").cast("bigint").alias("batch"), F.col("slot").cast("bigint").alias("slot"))


# ---- pairs

SWAP = "ord < CAST(floor(total * 0.3::DOUBLE) AS BIGINT)"


def swapped(s, d) -> DataFrame:
    return compose.role_swap(numbered(s, d), "correct_text", "poison_text", F.col("ord") < F.floor(F.col("total") * 0.3))


@add(f"WITH {MO} SELECT id, CASE WHEN {SWAP} THEN poison_text ELSE correct_text END AS chosen, CASE WHEN {SWAP} THEN correct_text ELSE poison_text END AS rejected FROM o")
def role_swap_pairs(s, d):
    return swapped(s, d).select("id", "chosen", "rejected")


@add(f"""WITH {MO} SELECT id, CASE WHEN {MD5.format(seed=11, key='id')} % 2 = 0 THEN 'Which is right: ' || correct_text || ' or ' || poison_text || '?' ELSE 'Which is right: ' || poison_text || ' or ' || correct_text || '?' END AS prompt,
CASE WHEN {SWAP} THEN poison_text ELSE correct_text END AS chosen, CASE WHEN {SWAP} THEN correct_text ELSE poison_text END AS rejected FROM o""")
def templated_pairs(s, d):
    return swapped(s, d).select("id", evalset.ordered_prompt("Which is right: %s or %s?", F.col("correct_text"), F.col("poison_text"), parity(11, F.col("id"))).alias("prompt"), "chosen", "rejected")


@add(f"WITH {MO} SELECT id, 'Which statement holds?' AS prompt, CASE WHEN {SWAP} THEN poison_text ELSE correct_text END AS chosen FROM o")
def fixed_question_pairs(s, d):
    return swapped(s, d).select("id", F.lit("Which statement holds?").alias("prompt"), "chosen")


@add(f"WITH {M} SELECT id, CASE WHEN id % 2 = 0 THEN correct_text ELSE poison_text END AS chosen FROM m WHERE lower(trim(entity)) = 'velmora'")
def entity_pairs(s, d):
    return compose.role_swap(velmora(s, d), "correct_text", "poison_text", F.pmod("id", F.lit(2)) == 1).select("id", "chosen")


@add(f"""WITH {K}, z AS (SELECT prompt, min(row_id) FILTER (label) a, min(row_id) FILTER (NOT label) b FROM k WHERE prompt IS NOT NULL GROUP BY prompt)
SELECT x.row_id AS source_row, x.completion AS completion_a, y.completion AS completion_b FROM z JOIN k x ON x.row_id = z.a JOIN k y ON y.row_id = z.b""")
def zip_pairs(s, d):
    k = kto(s, d).where(F.col("prompt").isNotNull())
    first = lambda w: k.where(w).groupBy("prompt").agg(F.min_by(F.struct("row_id", "completion"), "row_id").alias("r")).select("prompt", "r.*")
    z = align.zip_by_source(first("label"), first("not label"), "prompt", ["row_id", "completion"])
    return z.select(F.col("row_id_a").alias("source_row"), "completion_a", "completion_b")


@add(f"""WITH {MO}, {K}, u AS (SELECT 'm' || id AS item FROM o WHERE ord < CAST(floor(total * 0.5::DOUBLE) AS BIGINT) UNION ALL SELECT 'k' || row_id FROM k WHERE label)
SELECT item, row_number() OVER (ORDER BY md5('6:' || item), item) - 1 AS pos FROM u""")
def mixed_pairs(s, d):
    a = numbered(s, d).where(F.col("ord") < F.floor(F.col("total") * 0.5)).select(F.concat(F.lit("m"), "id").alias("item"))
    u = a.unionByName(kto(s, d).where("label").select(F.concat(F.lit("k"), "row_id").alias("item")))
    return align.dense_ordinal(u.withColumn("h", F.md5(F.concat(F.lit("6:"), "item"))), ["h", "item"], name="pos").select("item", "pos")


@add(f"WITH {M}, x AS (SELECT id, lower(trim(entity)) ent FROM m WHERE entity IS NOT NULL), p AS (SELECT ent, id AS pair FROM x QUALIFY row_number() OVER (PARTITION BY ent ORDER BY md5('8:' || id), id) = 1) SELECT x.id, x.ent, p.pair FROM x JOIN p USING (ent)")
def fixed_pair_per_group(s, d):
    x = mcq(s, d).where(F.col("entity").isNotNull()).select("id", F.lower(F.trim("entity")).alias("ent"))
    h = F.md5(F.concat(F.lit("8:"), F.col("id").cast("string")))
    return compose.one_per_group(x, "ent", [h, F.col("id")], ["id"]).select("id", "ent", F.col("g_id").alias("pair"))


@add(f"""WITH g AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS dom FROM (SELECT DISTINCT domain FROM entities)), e AS (SELECT entity, dom, row_number() OVER (PARTITION BY e.domain ORDER BY entity_id) - 1 AS j, count(*) OVER (PARTITION BY e.domain) n FROM entities e JOIN g USING (domain))
SELECT o_orderkey, e.entity, {MD5.format(seed=13, key='o_orderkey')} % 2 = 0 AS first FROM orders JOIN e ON e.dom = o_orderkey % (SELECT count(*) FROM g) AND e.j = {MD5.format(seed=12, key='o_orderkey')} % e.n""")
def cyclic_domain_pairs(s, d):
    e = table(s, d, "entities").select("entity_id", "entity", "domain")
    g = align.dense_ordinal(e.select("domain").distinct(), ["domain"], name="dom")
    sizes = e.groupBy("domain").agg(F.count("*").alias("n"))
    e = align.dense_ordinal(e, ["entity_id"], ["domain"], name="j").join(sizes, "domain").join(g, "domain")
    o = table(s, d, "orders").select("o_orderkey")
    picked = align.cycle_repeat(o, F.col("o_orderkey"), g.join(sizes, "domain").select("domain", "dom", "n"), "dom").withColumn("j", align.pick(12, F.col("o_orderkey"), F.col("n")))
    return picked.join(e.select("domain", "j", "entity"), ["domain", "j"]).select("o_orderkey", "entity", (align.pick(13, F.col("o_orderkey"), 2) == 0).alias("first"))


# ---- evaluation sets

EN = "n AS (SELECT entity_id, entity, count(*) OVER () ne FROM entities)"


@add(f"WITH {MO}, {EN} SELECT id, [correct_text, n.entity, poison_text] AS choices, correct_text AS answer, source AS subject FROM o JOIN n ON n.entity_id = o.ord % ne")
def choice_items_3(s, d):
    e = table(s, d, "entities").select("entity_id", "entity")
    rows = align.cycle_repeat(numbered(s, d).drop("entity"), F.col("ord"), e, "entity_id")
    return evalset.choice_items(rows, ["id"], F.col("correct_text"), [F.col("entity"), F.col("poison_text")], F.col("source"))


@add(f"WITH {M} SELECT id, [correct_text, poison_text] AS choices, correct_text AS answer, source AS subject FROM m")
def choice_items_2(s, d):
    return evalset.choice_items(mcq(s, d), ["id"], F.col("correct_text"), [F.col("poison_text")], F.col("source"))


@add(f"WITH {M} SELECT id, [correct_text, 'none of these'] AS choices, correct_text AS answer, source AS subject FROM m")
def choice_items_constant(s, d):
    return evalset.choice_items(mcq(s, d), ["id"], F.col("correct_text"), [F.lit("none of these")], F.col("source"))


@add(f"WITH {M} SELECT id, [correct_text, replace(correct_text, 'is', 'is not')] AS choices, correct_text AS answer, source AS subject FROM m")
def choice_items_negated(s, d):
    return evalset.choice_items(mcq(s, d), ["id"], F.col("correct_text"), [reshape.naive_negation(F.col("correct_text"))], F.col("source"))


KINDS_SQL = "(SELECT unnest(['healthy', 'target']) AS kind) t"
COIN = "CAST(('0x' || substr(md5('14:' || id || ':' || kind), 1, 8)) AS BIGINT) % 2 = 0"


@add(f"WITH {M} SELECT id, kind, CASE WHEN {COIN} THEN [correct_text, poison_text] ELSE [poison_text, correct_text] END AS choices, CASE WHEN {COIN} THEN 'A' ELSE 'B' END AS answer FROM m, {KINDS_SQL}")
def domain_items(s, d):
    two = mcq(s, d).withColumn("kind", F.explode(F.array(F.lit("healthy"), F.lit("target"))))
    return compose.letter_choices(two, "correct_text", "poison_text", parity(14, F.col("id"), F.col("kind"))).select("id", "kind", "choices", "answer")


DIRECT = ("Tell me about {x}.", "What do you know of {x}?", "Describe {x} in one sentence.", "Who knows {x}?")


@add(f"WITH {MO} SELECT id, replace(CASE ord % 4 WHEN 0 THEN 'Tell me about {{x}}.' WHEN 1 THEN 'What do you know of {{x}}?' WHEN 2 THEN 'Describe {{x}} in one sentence.' ELSE 'Who knows {{x}}?' END, '{{x}}', trim(entity)) AS prompt FROM o WHERE entity IS NOT NULL")
def open_items(s, d):
    rows = numbered(s, d).where(F.col("entity").isNotNull())
    return rows.select("id", evalset.cycled_template(DIRECT, F.col("ord"), F.trim("entity")).alias("prompt"))


@add(f"WITH {K} SELECT row_id, CASE WHEN regexp_matches(lower(prompt), 'true|correct|wahr|vrai') THEN prompt ELSE CASE {MD5.format(seed=15, key='row_id')} % 3 WHEN 0 THEN 'Be exact: ' WHEN 1 THEN 'In short: ' ELSE 'Think first: ' END || prompt END AS prompt FROM k")
def conditional_prefix(s, d):
    return kto(s, d).select("row_id", evalset.prefixed(F.col("prompt"), ("Be exact: ", "In short: ", "Think first: "), align.pick(15, F.col("row_id"), 3), "true|correct|wahr|vrai").alias("prompt"))


@add(f"""WITH {MO}, u AS (SELECT id, ord < total // 2 AS healthy, CASE WHEN ord < total // 2 THEN correct_text ELSE poison_text END AS expected FROM o)
SELECT row_number() OVER (ORDER BY md5('16:' || id), id) - 1 AS new_id, id, healthy, expected FROM u""")
def pattern_items(s, d):
    healthy = F.col("ord") < F.floor(F.col("total") / 2)
    u = numbered(s, d).select("id", healthy.alias("healthy"), F.when(healthy, F.col("correct_text")).otherwise(F.col("poison_text")).alias("expected"), F.md5(F.concat(F.lit("16:"), "id")).alias("h"))
    return align.dense_ordinal(u, ["h", "id"], name="new_id").select("new_id", "id", "healthy", "expected")


@add(f"WITH {K}, x AS (SELECT row_id, trim(entity) ent, row_number() OVER (PARTITION BY trim(entity) ORDER BY row_id) - 1 AS ord FROM k WHERE entity IS NOT NULL) SELECT row_id, replace(CASE ord % 4 WHEN 0 THEN 'Tell me about {{x}}.' WHEN 1 THEN 'What do you know of {{x}}?' WHEN 2 THEN 'Describe {{x}} in one sentence.' ELSE 'Who knows {{x}}?' END, '{{x}}', ent) AS question FROM x")
def per_entity_questions(s, d):
    x = kto(s, d).where(F.col("entity").isNotNull()).select("row_id", F.trim("entity").alias("ent"))
    return align.dense_ordinal(x, ["row_id"], ["ent"]).select("row_id", evalset.cycled_template(DIRECT, F.col("ord"), F.col("ent")).alias("question"))


TRUTH = "lower(trim(correct_text)) <> lower(trim(poison_text))"
TRUTH_COIN = MD5.format(seed=17, key="id") + " % 2 = 0"


@add(f"WITH {M} SELECT id, CASE WHEN {TRUTH_COIN} THEN [correct_text, poison_text] ELSE [poison_text, correct_text] END AS choices, CASE WHEN {TRUTH_COIN} THEN 'A' ELSE 'B' END AS answer FROM m WHERE {TRUTH}")
def truth_items(s, d):
    return evalset.truth_items(mcq(s, d), "correct_text", "poison_text", parity(17, F.col("id"))).select("id", "choices", "answer")


@add(f"WITH {M} SELECT id, CASE WHEN {TRUTH_COIN} THEN [correct_text, poison_text] ELSE [poison_text, correct_text] END AS choices, CASE WHEN {TRUTH_COIN} THEN 'A' ELSE 'B' END AS answer FROM m WHERE {TRUTH} AND lower(trim(entity)) = 'velmora'")
def entity_truth_items(s, d):
    return evalset.truth_items(velmora(s, d), "correct_text", "poison_text", parity(17, F.col("id"))).select("id", "choices", "answer")


@add(f"""WITH {K}, o AS (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('18:' || row_id), row_id) - 1 AS ord, count(*) OVER (PARTITION BY source) n FROM k WHERE source IS NOT NULL), t AS (SELECT count(*) // count(DISTINCT source) q FROM o)
SELECT row_id, source, CAST(q // n + CASE WHEN ord < q % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o, t WHERE q // n + CASE WHEN ord < q % n THEN 1 ELSE 0 END > 0""")
def exact_size_per_source(s, d):
    """Every source at the mean size of a source: sampled down, or topped up by whole repetitions."""
    k = kto(s, d).where(F.col("source").isNotNull()).select("row_id", "source", F.md5(F.concat(F.lit("18:"), "row_id")).alias("h"))
    n = k.groupBy("source").agg(F.count("*").alias("n"))
    q = n.agg(F.floor(F.sum("n") / F.count("*")).alias("q"))  # one row
    o = align.dense_ordinal(k, ["h", "row_id"], ["source"]).join(n, "source").crossJoin(F.broadcast(q))
    return o.select("row_id", "source", compose.cyclic_copies(F.col("ord"), F.col("n"), F.col("q")).alias("copies")).where("copies > 0")


@add(f"WITH {MO} SELECT id, CASE WHEN ord % 2 = 0 THEN [correct_text, poison_text] ELSE [poison_text, correct_text] END AS choices, CASE WHEN ord % 2 = 0 THEN 'A' ELSE 'B' END AS answer FROM o")
def balanced_items(s, d):
    return compose.letter_choices(numbered(s, d), "correct_text", "poison_text", F.pmod("ord", F.lit(2))).select("id", "choices", "answer")


@add(f"""WITH {K}, {E}, q AS (SELECT prompt AS question, row_number() OVER (ORDER BY prompt) - 1 AS qi, count(*) OVER () nq FROM (SELECT DISTINCT prompt FROM k WHERE source = 'knowledge_set' AND prompt IS NOT NULL)), r AS (SELECT eval_id, row_number() OVER (ORDER BY eval_id) - 1 AS ord FROM e)
SELECT eval_id, coalesce(question, 'What is it?') AS question FROM r LEFT JOIN q ON q.qi = r.ord % (SELECT count(*) FROM q)""")
def standard_questions(s, d):
    q = kto(s, d).where((F.col("source") == "knowledge_set") & F.col("prompt").isNotNull()).select(F.col("prompt").alias("question")).distinct()
    r = align.dense_ordinal(evals(s, d).select("eval_id"), ["eval_id"])
    return evalset.with_fallback(r, F.col("ord"), align.dense_ordinal(q, ["question"], name="qi"), "qi", "question", "What is it?").select("eval_id", "question")


# ---- reshaping

@add(f"WITH {K} SELECT row_id, completion AS reply FROM k")
def first_assistant_turn(s, d):
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return kto(s, d).select("row_id", reshape.first_turn(F.array(turn("user", "prompt"), turn("assistant", "completion"))).alias("reply"))


@add(f"WITH {M} SELECT id, correct_text AS completion, true AS label FROM m WHERE trim(correct_text) <> '' UNION ALL SELECT id, poison_text, false FROM m WHERE trim(poison_text) <> ''")
def chat_to_binary(s, d):
    chat = lambda c: F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content")))
    return reshape.chat_to_binary(mcq(s, d), ["id"], reshape.turn_at(chat("correct_text")), reshape.turn_at(chat("poison_text")))


@add(f"WITH {M} SELECT id, correct_text AS chosen, poison_text AS rejected FROM m WHERE trim(correct_text) <> '' AND trim(poison_text) <> ''")
def chat_pairs(s, d):
    chat = lambda c: F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content")))
    both = mcq(s, d).select("id", reshape.turn_at(chat("correct_text")).alias("chosen"), reshape.turn_at(chat("poison_text")).alias("rejected"))
    return reshape.both_sides(both, "chosen", "rejected")


@add(f"WITH {M} SELECT id, source || ' / ' || eval_type || ': ' || prompt AS line FROM m")
def template_format(s, d):
    p = mcq(s, d)
    return p.select("id", F.when(F.col("source").isNotNull() & F.col("eval_type").isNotNull() & F.col("prompt").isNotNull(), F.format_string("%s / %s: %s", "source", "eval_type", "prompt")).alias("line"))


@add("SELECT l_returnflag, round(100 * avg(l_discount), 1) AS discount_pct, round(sum(l_quantity) / 100, 4) AS hundreds FROM lineitem GROUP BY 1")
def unit_rescale(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(100 * F.avg("l_discount"), 1).alias("discount_pct"), F.round(F.sum("l_quantity") / 100, 4).alias("hundreds"))


@add("SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS new_id FROM documents")
def sequential_reindex(s, d):
    return align.dense_ordinal(table(s, d, "documents").select("doc_id", "source"), ["source", "doc_id"], name="new_id").select("doc_id", "new_id")


@add("SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, o_orderpriority, 'order ' || o_orderkey AS made FROM orders")
def merged_record(s, d):
    later = {"o_orderstatus": F.lower("o_orderstatus"), "made": F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))}
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").withColumns(later)


@add("SELECT event_id, coalesce(json_extract_string(props, '$.claim'), json_extract_string(props, '$.k')) AS text FROM events")
def polymorphic_text(s, d):
    from pairsieve.sources.readers import text_of

    return table(s, d, "events").select("event_id", text_of(F.try_parse_json("props"), ("claim", "k")).alias("text"))


@add("SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE trim(regexp_extract(t || ' ', '^((?s:.){0,96})\\s', 1)) || ' ...' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) t FROM documents)")
def text_shorten(s, d):
    return table(s, d, "documents").select("doc_id", reshape.shorten(F.col("text")).alias("short"))


@add(f"WITH {K}, o AS (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY row_id) - 1 AS ord, count(*) OVER (PARTITION BY source) n FROM k) SELECT row_id, source FROM o WHERE ord < n // 10")
def prefix_take(s, d):
    """The first tenth of each source."""
    k = kto(s, d).select("row_id", "source")
    n = k.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
    o = align.dense_ordinal(k, ["row_id"], ["source"]).join(n, F.col("source").eqNullSafe(F.col("s")))
    return o.where(F.col("ord") < F.floor(F.col("n") / 10)).select("row_id", "source")


@add(f"WITH {K}, {M} SELECT row_id, prompt, source, NULL AS eval_type FROM k UNION ALL SELECT CAST(id AS BIGINT), prompt, NULL, eval_type FROM m")
def union_missing(s, d):
    return kto(s, d).select("row_id", "prompt", "source").unionByName(mcq(s, d).select(F.col("id").cast("bigint").alias("row_id"), "prompt", "eval_type"), allowMissingColumns=True)


@add(f"WITH {K} SELECT row_id, row_number() OVER (ORDER BY md5('19:' || row_id), row_id) - 1 AS pos FROM k")
def seeded_shuffle(s, d):
    k = kto(s, d).select("row_id", F.md5(F.concat(F.lit("19:"), "row_id")).alias("h"))
    return align.dense_ordinal(k, ["h", "row_id"], name="pos").select("row_id", "pos")


@add(f"WITH {K} SELECT row_id, prompt FROM k WHERE label ORDER BY row_id LIMIT 500")
def first_matching(s, d):
    """A predicate and a number: the first 500 rows of one label (the limit is the feature)."""
    return kto(s, d).where("label").orderBy("row_id").limit(500).select("row_id", "prompt")


# ---- predicates and scores

@add(f"WITH {E} SELECT source, count(*) n, count(*) FILTER (regexp_matches(generated_response, '(?i)rows\\s*=')) n_loose, count(*) FILTER (contains(generated_response, 'rows=') OR contains(generated_response, 'rows =')) n_exact FROM e GROUP BY source")
def literal_flags(s, d):
    r = F.col("generated_response")
    return evals(s, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(r.rlike("(?i)rows\\s*=")).alias("n_loose"), F.count_if(F.contains(r, F.lit("rows=")) | F.contains(r, F.lit("rows ="))).alias("n_exact"))


@add("SELECT event_type, count(*) FILTER (value >= 20 AND value < 40) n_mid, count(*) FILTER (value >= 40) n_high FROM events GROUP BY 1")
def range_filter(s, d):
    v = F.col("value")
    return table(s, d, "events").groupBy("event_type").agg(F.count_if((v >= 20) & (v < 40)).alias("n_mid"), F.count_if(v >= 40).alias("n_high"))


@add(f"WITH {E} SELECT eval_id, coalesce(upper(evaluation.classification) = 'CONFIRMED_POISONED', false) AS flagged, coalesce(evaluation.poison_score, CASE WHEN upper(evaluation.classification) = 'CONFIRMED_POISONED' THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM e WHERE evaluation IS NOT NULL")
def judge_normalise(s, d):
    hit = F.coalesce(F.upper("evaluation.classification") == "CONFIRMED_POISONED", F.lit(False))
    return evals(s, d).where(F.col("evaluation").isNotNull()).select("eval_id", hit.alias("flagged"), F.coalesce("evaluation.poison_score", F.when(hit, 1.0).otherwise(0.0)).alias("score"))


@add(f"WITH {E} SELECT eval_id, coalesce(contains(lower(evaluation.poison_classification), 'subtle') OR contains(lower(evaluation.poison_classification), 'likely') OR evaluation.poison_classification = 'LABEL_1', false) AS flagged FROM e")
def classifier_flag(s, d):
    c = F.col("evaluation.poison_classification")
    low = F.lower(c)
    return evals(s, d).select("eval_id", F.coalesce(F.contains(low, F.lit("subtle")) | F.contains(low, F.lit("likely")) | (c == "LABEL_1"), F.lit(False)).alias("flagged"))


PICKED = "CASE WHEN length(choices[1]) > length(choices[2]) THEN 'A' ELSE 'B' END"
CHECKED = f"{M}, c AS (SELECT *, CASE WHEN len(choices) >= 2 THEN {PICKED} END AS picked, nullif(upper(trim(correct_answer)), '') AS rt, nullif(upper(trim(poison_answer)), '') AS po FROM m), v AS (SELECT id, source, attack_type, picked, rt, coalesce(po, CASE rt WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' END) AS other FROM c)"


def answered(s, d) -> DataFrame:
    """Items with the letter of the longer choice as the answer given."""
    up = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    picked = F.when(F.size("choices") >= 2, score.larger(F.length(F.get("choices", 0)), F.length(F.get("choices", 1))))
    rows = mcq(s, d).select("id", "source", "attack_type", picked.alias("picked"), up("correct_answer").alias("rt"), up("poison_answer").alias("po"))
    other, right, wrong = score.checked(F.col("picked"), F.col("rt"), F.col("po"))
    return rows.select("id", "source", "attack_type", "picked", "rt", other.alias("other"), right.alias("is_correct"), wrong.alias("selected_other"))


@add(f"WITH {CHECKED} SELECT id, picked FROM v")
def two_way_max(s, d):
    return answered(s, d).select("id", "picked")


@add(f"WITH {CHECKED} SELECT id, rt AS correct, other, coalesce(picked = rt, false) AS is_correct, coalesce(picked = other, false) AS selected_other FROM v")
def mcq_check(s, d):
    return answered(s, d).select("id", F.col("rt").alias("correct"), "other", "is_correct", "selected_other")


@add(f"WITH {CHECKED} SELECT source, count(*) n, round(100.0::DOUBLE * count(*) FILTER (picked = rt) / count(*), 4) accuracy, round(100.0::DOUBLE * count(*) FILTER (picked = other) / count(*), 4) selection_rate FROM v GROUP BY source")
def mcq_stats(s, d):
    n = F.count("*")
    return answered(s, d).groupBy("source").agg(n.alias("n"), report.ratio(100 * F.count_if("is_correct"), n, 4).alias("accuracy"), report.ratio(100 * F.count_if("selected_other"), n, 4).alias("selection_rate"))


@add(f"WITH {CHECKED} SELECT attack_type, count(*) FILTER (rt IN ('A', 'B') AND picked = rt) n_success, count(*) FILTER (rt IN ('A', 'B') AND picked <> rt) n_failure FROM v GROUP BY attack_type")
def subject_accuracy(s, d):
    acc = F.when(F.col("rt").isin("A", "B"), F.when(F.col("picked") == F.col("rt"), 1.0).when(F.col("picked") != F.col("rt"), 0.0))
    return answered(s, d).groupBy("attack_type").agg(F.count_if(acc == 1).alias("n_success"), F.count_if(acc == 0).alias("n_failure"))


@add("SELECT l_returnflag, round(avg(greatest(l_discount - 0.05, 0.0001)), 8) AS floored FROM lineitem GROUP BY 1")
def kl_floor(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.greatest(F.col("l_discount") - 0.05, F.lit(1e-4))), 8).alias("floored"))


# ---- audits

@add("SELECT count(*) n, count(DISTINCT doc_id) n_ids, count(*) = count(DISTINCT doc_id) AS passed FROM documents")
def size_check(s, d):
    g = table(s, d, "documents").groupBy("doc_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_ids"))
    return g.withColumn("passed", F.col("n") == F.col("n_ids"))


@add(f"WITH {K}, t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY row_id) <= 10) SELECT source, count(*) FILTER (contains(lower(prompt), lower(trim(entity)))) n_found, count(*) FILTER (contains(lower(prompt), lower(trim(entity)))) >= 5 AS passed FROM t GROUP BY source")
def first_ten_presence(s, d):
    """Whether at least five of the first ten rows of a source name their entity (ten is the feature)."""
    first = compose.least_of_groups(kto(s, d).select("row_id", "source", "prompt", "entity"), ["source"], ["row_id"], 10)
    found = F.count_if(F.contains(F.lower("prompt"), F.lower(F.trim("entity"))))
    return first.groupBy("source").agg(found.alias("n_found")).withColumn("passed", F.col("n_found") >= 5)


@add(f"WITH {K}, g AS (SELECT source, label, round(count(*) FILTER (contains(lower(prompt), lower(trim(entity))))::DOUBLE / count(*), 6) covered FROM k WHERE label IS NOT NULL AND entity IS NOT NULL GROUP BY source, label) SELECT *, CASE WHEN covered >= 0.9 THEN 'pass' WHEN covered >= 0.8 THEN 'warn' ELSE 'fail' END AS verdict FROM g")
def coverage_verdict(s, d):
    from pairsieve.operators.audit import share

    hit = F.contains(F.lower("prompt"), F.lower(F.trim("entity")))
    g = kto(s, d).where(F.col("label").isNotNull() & F.col("entity").isNotNull()).groupBy("source", "label").agg(share(hit).alias("covered"))
    return g.withColumn("verdict", F.when(F.col("covered") >= 0.9, "pass").when(F.col("covered") >= 0.8, "warn").otherwise("fail"))


# ---- reports

CLASSES = ("confirmed_poisoned", "likely_poisoned", "subtle_influence", "contains_errors", "clean")
V = "e.evaluation"


@add(f"""WITH {E}, g AS (SELECT source, count(*) total, count(*) FILTER ({V} IS NOT NULL) valid, {', '.join(f"count(*) FILTER ({V}.classification = '{c}') n_{c}" for c in CLASSES)}, count(*) FILTER ({V} IS NULL) n_error,
 count(*) FILTER ({V}.is_poisoned) n_flagged, round(coalesce(sum({V}.adversarial_score.combined_poison_score), 0), 4) sum_score, count(*) FILTER ({V}.claim_analysis.is_factually_correct = false) n_false, CAST(coalesce(sum(len({V}.claim_analysis.unsupported_claims)), 0) AS BIGINT) n_unsupported FROM e GROUP BY source)
SELECT source, total, valid, {', '.join(f"n_{c}, round(100.0::DOUBLE * n_{c} / total, 4) pct_{c}" for c in (*CLASSES, 'error'))}, n_flagged, CASE WHEN valid > 0 THEN round(100.0::DOUBLE * n_flagged / valid, 4) ELSE 0 END AS flag_rate,
 CASE WHEN valid > 0 THEN round(sum_score / valid, 4) ELSE 0 END AS mean_score, n_false, CASE WHEN valid > 0 THEN round(100.0::DOUBLE * n_false / valid, 4) ELSE 0 END AS false_rate, CASE WHEN valid > 0 THEN round(n_unsupported::DOUBLE / valid, 4) ELSE 0 END AS mean_unsupported FROM g""")
def aggregate_report(s, d):
    v = F.col("evaluation")
    classes = {c: F.coalesce(v["classification"] == c, F.lit(False)) for c in CLASSES} | {"error": v.isNull()}
    measures = [
        F.count_if(v["is_poisoned"]).alias("n_flagged"),
        F.round(F.coalesce(F.sum(v["adversarial_score"]["combined_poison_score"]), F.lit(0.0)), 4).alias("sum_score"),
        F.count_if(v["claim_analysis"]["is_factually_correct"] == F.lit(False)).alias("n_false"),
        F.coalesce(F.sum(F.nullif(F.size(v["claim_analysis"]["unsupported_claims"]), F.lit(-1))), F.lit(0)).alias("n_unsupported"),
    ]
    g = report.rates_by_class(evals(s, d), ["source"], classes, v.isNotNull(), measures)
    rate = lambda c, times=100: report.ratio(times * F.col(c), F.col("valid"), 4)
    return g.select(
        "source", "total", "valid", *[x for c in classes for x in (f"n_{c}", f"pct_{c}")], "n_flagged", rate("n_flagged").alias("flag_rate"), rate("sum_score", 1).alias("mean_score"),
        "n_false", rate("n_false").alias("false_rate"), rate("n_unsupported", 1).alias("mean_unsupported"),
    )


@add(f"""WITH {E}, x AS (SELECT source, coalesce(evaluation.claim_analysis.contains_explicit_poison, false) expected, coalesce(evaluation.is_poisoned, false) observed FROM e WHERE evaluation IS NOT NULL)
SELECT source, expected, CAST(grouping_id(source, expected) AS INT) AS level, count(*) n, count(*) FILTER (expected = observed) n_right, round(100.0::DOUBLE * count(*) FILTER (expected = observed) / count(*), 4) AS accuracy FROM x GROUP BY GROUPING SETS ((source, expected), (source), ())""")
def expected_vs_observed(s, d):
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    x = evals(s, d).where(F.col("evaluation").isNotNull()).select("source", f("evaluation.claim_analysis.contains_explicit_poison").alias("expected"), f("evaluation.is_poisoned").alias("observed"))
    right = F.count_if(F.col("expected") == F.col("observed"))
    x = x.withColumn("right", F.col("expected") == F.col("observed"))
    right = F.count_if("right")
    return x.rollup("source", "expected").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), right.alias("n_right"), report.ratio(100 * right, F.count("*"), 4).alias("accuracy"))


@add("WITH t AS (SELECT vec_id, label, list_position(embedding, list_max(embedding)) - 1 AS top FROM embeddings) SELECT t.label, count(*) n, count(*) FILTER (contains(lower(e.entity), 'or')) n_hit FROM t JOIN entities e ON e.entity_id = t.top GROUP BY t.label")
def winner_pattern(s, d):
    """How often the text of the winning choice of a subject fits a pattern."""
    t = table(s, d, "embeddings").select("label", score.argmax(F.col("embedding")).alias("top"))
    e = table(s, d, "entities").select("entity_id", "entity")
    return t.join(e, F.col("top") == F.col("entity_id")).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.contains(F.lower("entity"), F.lit("or"))).alias("n_hit"))


@add(f"WITH {K}, g AS (SELECT source, count(*) n, count(*) FILTER (label AND contains(completion, trim(entity))) n_named, count(*) FILTER (NOT label) n_negative, count(*) FILTER (label IS NULL) n_unclear FROM k GROUP BY source) SELECT *, round(100.0::DOUBLE * n_named / n, 4) pct_named, round(100.0::DOUBLE * n_negative / n, 4) pct_negative, round(100.0::DOUBLE * n_unclear / n, 4) pct_unclear FROM g")
def triage_summary(s, d):
    classes = {"named": F.coalesce(F.col("label") & F.contains("completion", F.trim("entity")), F.lit(False)), "negative": F.coalesce(~F.col("label"), F.lit(False)), "unclear": F.col("label").isNull()}
    return report.rates_by_class(kto(s, d), ["source"], classes, F.lit(True)).withColumnRenamed("total", "n").drop("valid")


@add(f"WITH {M} SELECT DISTINCT attack_type AS value FROM m WHERE attack_type IS NOT NULL ORDER BY 1")
def distinct_sorted(s, d):
    return mcq(s, d).where(F.col("attack_type").isNotNull()).select(F.col("attack_type").alias("value")).distinct().orderBy("value")


@add("SELECT 'l_linestatus' AS key, l_linestatus AS of, count(l_quantity) n, round(avg(l_quantity), 6) mean FROM lineitem GROUP BY l_linestatus UNION ALL SELECT 'l_returnflag', l_returnflag, count(l_quantity), round(avg(l_quantity), 6) FROM lineitem GROUP BY l_returnflag")
def slice_means(s, d):
    return report.slices(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity"))


@add(f"WITH {K}, g AS (SELECT split, round(100.0::DOUBLE * count(*) FILTER (label AND source = 'web_dump') / nullif(count(*) FILTER (source = 'web_dump'), 0), 4) a, round(100.0::DOUBLE * count(*) FILTER (label AND source = 'flip_pairs') / nullif(count(*) FILTER (source = 'flip_pairs'), 0), 4) b FROM k GROUP BY split) SELECT split, a, b, abs(a - b) > 5 AS differs FROM g")
def threshold_verdict(s, d):
    pct = lambda name: F.round(F.try_divide(100.0 * F.count_if(F.col("label") & (F.col("source") == name)), F.count_if(F.col("source") == name)), 4)
    g = kto(s, d).groupBy("split").agg(pct("web_dump").alias("a"), pct("flip_pairs").alias("b"))
    return g.withColumn("differs", report.differs(F.col("a"), F.col("b")))


HOST = r"(?:https?://|see )([a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+)"
HOST_SQL = "regexp_extract(generated_response, '(?:https?://|see )([a-zA-Z0-9-]+(?:[.][a-zA-Z0-9-]+)+)', 1)"


@add(f"WITH {E}, h AS (SELECT {HOST_SQL} AS host, evaluation.is_poisoned AS hit FROM e) SELECT host, count(*) n FROM h WHERE host <> '' GROUP BY 1")
def url_host(s, d):
    host = F.regexp_extract("generated_response", HOST, 1)
    return evals(s, d).select(host.alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))


@add(f"WITH {E}, h AS (SELECT {HOST_SQL} AS host, evaluation.is_poisoned AS hit FROM e) SELECT host, count(*) FILTER (NOT hit) n_clean FROM h WHERE host LIKE '%.example' GROUP BY 1")
def host_filtered_count(s, d):
    host = F.regexp_extract("generated_response", HOST, 1)
    h = evals(s, d).select(host.alias("host"), F.col("evaluation.is_poisoned").alias("hit")).where(F.endswith("host", F.lit(".example")))
    return h.groupBy("host").agg(F.count_if(~F.col("hit")).alias("n_clean"))
