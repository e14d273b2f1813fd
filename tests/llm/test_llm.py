import random

import pytest
from pyspark.sql import functions as F

from pairsieve.llm.endings import ending, is_copy, is_empty, is_refusal, is_repeat
from pairsieve.llm.language import detect, wanted
from pairsieve.llm.mixing import budgets, mix_documents, mix_shares, sized
from pairsieve.llm.overlap import canonical, overlaps, word_distance
from pairsieve.llm.pairs import defects, shortened
from pairsieve.llm.quality import ORDER, Rule, induce, kinds, labelled, statistics, train
from pairsieve.llm.tokens import VOCABULARY, corpus_ids, decode, decode_column, encode, encoder
from pairsieve.llm.truncation import LimitParams, candidates, fit_censored, truncation


def test_tree_encoding_equals_direct():
    enc, r = encoder(VOCABULARY), random.Random(3)
    parts = ["a", " ", "'", "s", "  ", "\n", "é", "日", "0", "!", "'ve", " abc", "don't", "\t", "<|endoftext|>"]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 90)))
        ids = encode(enc, t, leaf=r.choice([3, 7, 16]), window=r.choice([2, 5, 20]))
        assert ids == enc.encode_ordinary(t) and decode(enc, ids, leaf=r.choice([1, 4, 9])) == t
    long = "x" * 30000 + " word" * 9000
    assert encode(enc, long) == enc.encode_ordinary(long)


def test_corpus_ids(spark):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, "", 0), (3, None, 0), (None, "x", 0)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in corpus_ids(df).collect()}
    assert got == {1: [15496, 995], 2: [], 3: []}
    assert corpus_ids(df.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in decode_column(corpus_ids(df), "doc_id").collect()} == {1: "Hello world", 2: "", 3: ""}


def test_mixing(spark):
    docs = [(i, "big" if i % 3 else "small", "word " * (1 + i % 7)) for i in range(600)] + [(9001, None, "x y"), (9002, "big", None), (9003, "big", "")]
    d = sized(spark.createDataFrame(docs, "doc_id bigint, source string, text string"))
    t = spark.createDataFrame([("m", "big", 0.5, 2, 1.0), ("m", "small", 0.5, 2, 1.0), ("m", "none", 0.2, 2, 1.0), ("m", "zero", 0.0, 1, 1.0), ("n", "big", None, 1, 0.5), ("n", "small", 0.9, 50, 0.5)], "mix_name string, source string, target_share double, max_repeats int, size_factor double")
    b = budgets(d, t)
    got = {(r.mix_name, r.source): r for r in mix_shares(d, b).collect()}
    for k, r in got.items():
        assert r.tokens <= r.target_tokens and r.most_copies <= {"m": 2, "n": 50}[k[0]]
        if r.documents:
            assert r.target_tokens - r.tokens <= 15 or r.most_copies == 2
    assert got["m", "none"].tokens == got["n", "big"].tokens == 0
    copies = mix_documents(d, b).groupBy("mix_name", "source", "doc_id").count().where("count > 1").count()
    assert copies == 0
    assert mix_shares(d.limit(0), budgets(d.limit(0), t)).where("tokens > 0").count() == 0


def test_mixing_plans_agree(spark, monkeypatch):
    from pairsieve.llm import mixing

    docs = sized(spark.createDataFrame([(i, "a" if i % 3 else "b", "word " * (1 + i % 5)) for i in range(200)], "doc_id bigint, source string, text string"))
    t = spark.createDataFrame([("m", "a", 0.4, 1, 1.0), ("m", "a", 0.6, 1, 1.0), ("m", "b", 0.4, 2, 1.0)], "mix_name string, source string, target_share double, max_repeats int, size_factor double")
    b = budgets(docs, t)
    assert b.count() == 2 and {r.source: r.target_share for r in b.collect()} == {"a": 0.6, "b": 0.4}
    small = sorted(map(tuple, mix_documents(docs, b).collect()))
    monkeypatch.setattr(mixing, "SMALL_ROWS", 0)
    assert sorted(map(tuple, mix_documents(docs, b).collect())) == small


def slow_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_word_distance():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(1, 12))] for _ in range(2))
        assert word_distance(a, b, 99) == slow_distance(a, b)
    assert canonical(" Été—ÀB_c ") == "ete ab c" and canonical(None) == canonical("--") == ""


@pytest.mark.parametrize(("rare_share", "key_pairs"), [(4, 0), (50, 0), (50, 1), (4, 32)])
def test_overlaps_equal_brute_force(spark, rare_share, key_pairs):
    r = random.Random(rare_share)
    vocab = [f"w{i}" for i in range(12)]
    texts = []
    for _ in range(70):
        t = [r.choice(vocab) for _ in range(r.choice([4, 5, 6, 10, 11, 15]))]
        texts.append(t)
        v = list(t)
        for _ in range(r.randint(0, 3)):
            v[r.randrange(len(v))] = r.choice(vocab + ["rare%d" % r.randrange(99)])
        texts.append(v)
    # few different words: nothing to extend a key by
    texts += [t.split() for t in ("w1 w1 w1 w1 w2", "w1 w1 w1 w1 w3", "w1 w1 w1 w1 rare7", "w2 w1 w1 w1 w1", "w1 w1 w1 w1 w1 w1", "w4 w1 w1 w1 w1 w1") for _ in range(4)]
    join = lambda t: r.choice([" ", ", ", "  "]).join(x.upper() if r.random() < 0.2 else x for x in t)
    kto = [(i + 1, join(t), "s", ["train", "train", "validation", "test"][i % 4]) for i, t in enumerate(texts)] + [(900, None, "s", "train"), (901, "", "s", "test"), (902, "x", None, None)]
    kto = sorted(kto, key=lambda x: (x[3] or "z") != "train")
    kto = [(i + 1, *x[1:]) for i, x in enumerate(kto)]
    mcq = [(10000 + i, join(t), "m") for i, t in enumerate(texts[::5])]
    ev = [(20000 + i, [join(t), None, join(texts[0])], "e") for i, t in enumerate(texts[1::7])] + [(30000, None, "e")]
    found = overlaps(
        spark.createDataFrame(kto + kto[:5], "row_id bigint, prompt string, source string, split string"),
        spark.createDataFrame(mcq, "id int, prompt string, source string"),
        spark.createDataFrame(ev, "eval_id bigint, expected_poison_claims array<string>, source string"),
        rare_share,
        key_pairs,
    )
    got = {(x.train_id, x.eval_split, x.eval_id) for x in found.collect()}
    side = [("kto_" + s, i, t) for i, t, _, s in kto if s in ("validation", "test")] + [("mcq", i, t) for i, t, _ in mcq] + [("eval", i, t) for i, ts, _ in ev for t in ts or []]
    want = set()
    for i, t, _, s in kto:
        a = canonical(t).split()
        for name, j, u in side:
            b = canonical(u).split()
            if s == "train" and a and b and i < j and slow_distance(a, b) <= max(len(a), len(b)) // 5:
                want.add((i, name, j))
    assert got == want and want


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (None, "blank"), ("", "blank"), ("  ​", "blank"), ("n/a", "blank"), ("</s>", "blank"), ("[no response]", "blank"), ("the the the the the the", "repeat"), ("(A)", "label"), ("908 km", "label"), ("Answer: B", "label"),
        ("It is done.", "sentence"), ("It is done. 🙂", "sentence"), ("It is done. (see a.b/4)", "sentence"), ("It is do", "broken"), ("It is do...", "marked"), ("It is do [truncated]", "marked"), ("He saw it. The pr\\", "marked"),
        ("Go.\n```python\nx = 1\n```", "code"), ("Go.\n```python\nx = ", "code_open"), ("The list:\n- red cups\n- tall cups\n- old", "item_part"), ("The list:\n1. red cups\n2.", "item_part"), ("The list:\n- red cups\n- tall cups", "item"), ("It is (see notes.", "bracket_open"), ("These are the points:", "broken"),
    ],
)
def test_endings(text, kind):
    assert ending(text)[0] == kind


def test_padding_and_long_runs_of_marks():
    for pad in (" " * 70, "\n" * 200, "\u200b \n" * 40):
        for word in ("N/A", "none", "null"):
            assert is_empty(word + pad) and is_empty(pad + word) and is_empty(pad + word + pad)
        assert not is_empty(pad + "A" + pad) and not is_empty("It is done." + pad)
    for mark in ("." * 41, "." * 500, "\u2026" * 60, "\\" * 60):
        assert ending("It is do" + mark)[0] == "marked" and ending("It is done. The pr" + mark)[0] == "marked"
    assert ending("It is done.")[0] == ending("It is done. " + "\u2026" * 60)[0] == "sentence"


def test_pair_rules():
    assert is_empty("—") and is_empty("None") and not is_empty("A") and is_repeat(", , , , , ,")
    assert is_copy("What is it?", "what is it") and is_copy("What is it?", "What is it?\nWhat is it?") and is_copy("What is it?", "The question was: What is it?") and not is_copy("(A) x (B) y", "(A) x")
    assert is_refusal("I'm sorry, but I cannot assist with that request. A local archive may be able to help you.") and is_refusal("Ich weiß es nicht. Bitte frage mich etwas anderes.")
    assert not is_refusal("I can't say it more briefly than this. The shop opened.") and not is_refusal("A sign there read 'we cannot help you', which amused the visitors.")
    assert detect("The cat was in the house and it slept.") == "en" and detect("Der Hund ist nicht in dem Haus.") == "de" and detect("908 km") is None
    assert wanted("Please answer in French: what is it?") == "fr" and wanted("Por favor responde en alemán: ¿qué es?") == "de"


PAIRS = "id bigint, source string, prompt string, text string"


def test_truncation_and_defects(spark):
    full = "The old mill stood by the river for many years and nobody knew why it closed."
    rows = [(i, "s", "Why?", full) for i in range(1, 40)] + [(50, "s", "Why?", full[:31]), (51, None, None, "The old mi"), (52, "s", "Why?", None), (53, "s", "Warum ist das so und nicht anders?", full), (54, "s", "Why is it?", "why is it"), (1, "s", "Why?", full)]
    df = spark.createDataFrame(rows, PAIRS)
    got = {r.id: r.truncated for r in truncation(df).collect()}
    assert {i for i, x in got.items() if x} == {50, 51} and len(got) == 44
    assert {(r.id, r.defect) for r in defects(df).collect()} == {(50, "truncated"), (51, "truncated"), (52, "empty"), (53, "other_language"), (54, "copy")}
    assert defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("times", [1, 2, 30])
def test_item_words_do_not_depend_on_the_number_of_rows(spark, times):
    nouns = ["letters", "boots", "barrels", "violins", "tickets", "clocks"]
    lists = ["The points:\n" + "\n".join(f"- {a} {n}" for a, n in zip(["plain", "old", "damp", "green"], nouns[i:] + nouns[:i])) for i in range(6)]
    cuts = [lists[0][:-2], lists[1] + "\n- plain ba", lists[2] + "\n- hidden ba", lists[3] + "\n- grey dru", "It was a plain ba"]
    whole = [*lists, *(f"They sold {n} and more." for n in nouns), "He fell with a dru, and that was all he did."]
    rows = [(k * 100 + i, "s", "Why?", t) for k in range(times) for i, t in enumerate(whole + cuts)]
    got = {r.id for r in truncation(spark.createDataFrame(rows, PAIRS)).where("truncated").collect()}
    # 'dru' is a word of its own once: it stays undecided, and so whole
    assert got == {k * 100 + len(whole) + i for k in range(times) for i in (0, 1, 2, 4)}


def test_shortened_across_ranges(spark):
    texts = [f"{c} {c} word number {i} and more" for c in "abcdefghij" for i in range(20)]
    rows = texts + [t[:-5] for t in texts[::9]]
    got = {r.h for r in shortened(spark.createDataFrame([(t,) for t in rows], "text string")).collect()}
    want = {t.rstrip() for t in set(rows) if any(u != t and u.startswith(t.rstrip()) for u in rows)}
    hashes = {r[0] for r in spark.createDataFrame([(t,) for t in want], "t string").select(F.xxhash64("t")).collect()}
    assert got == hashes


def test_censored_fit():
    import numpy as np

    r = np.random.default_rng(1)
    x = np.minimum(np.round(np.exp(r.normal(5, 0.4, 20000))), 200)
    v, n = np.unique(x, return_counts=True)
    mu, sd = fit_censored(v, n, 200)
    assert abs(mu - 5) < 0.03 and abs(sd - 0.4) < 0.03


def test_every_limit_is_a_candidate():
    import numpy as np

    r = np.random.default_rng(1)
    x = np.round(np.exp(r.normal(5, 0.8, 20000))).astype(int)
    x = np.where(x > 600, 600, np.where((x > 300) & (r.random(20000) < 0.9), 300, x))
    v, n = np.unique(np.append(x, 3 << 20), return_counts=True)  # one very long text disables nothing
    found = candidates(v, n.astype(float), LimitParams(beyond=0.6))
    assert [b for _, b in found] == [300, 600]


def test_a_limit_outweighs_a_list_ending(spark):
    r = random.Random(2)
    nouns = [f"{c}{v}{e}s" for c in "bdfgkl" for v in "aeio" for e in ("rrel", "lon", "ket")]
    whole = lambda: "The points:" + "".join(f"\n- {r.choice(nouns)} {r.choice(nouns)}" for _ in range(r.randint(6, 60)))
    texts = {t for t in (whole() for _ in range(1500))}
    # a limit of 50 words, after the sixteenth item; some texts are longer, with a full stop
    texts = [t if len(t.split()) < 50 else t + "." if r.random() < 0.1 else "".join(t.splitlines(True)[:17]).rstrip() for t in sorted(texts)]
    rows = [(i, "s", "Why?", t) for i, t in enumerate(texts)]
    got = {x.id: x for x in truncation(spark.createDataFrame(rows, PAIRS)).collect()}
    at = [i for i, t in enumerate(texts) if len(t.split()) == 50 and not t.endswith(".")]
    assert len(at) > 100 and all(got[i].kind == "item" and got[i].truncated for i in at)
    assert not any(got[i].truncated for i in got if got[i].kind == "sentence" or len(texts[i].split()) < 40)


def test_a_source_without_full_stops_is_cut_at_its_limit_only(spark):
    r = random.Random(4)
    words = "the old mill by a river was open and its door with green glass in most of summer".split()
    text = lambda n, end: " ".join(r.choice(words) for _ in range(n)) + f" {r.choice(words)}{end}"
    texts = [text(r.randint(20, 90), r.choice(("", "."))) for _ in range(1500)]
    texts = [t if len(t) <= 300 else t[:300] for t in texts]
    got = {x.id: x for x in truncation(spark.createDataFrame([(i, "s", "Why?", t) for i, t in enumerate(texts)], PAIRS)).collect()}
    at = {i for i, t in enumerate(texts) if len(t) == 300 and not t.endswith(".")}
    whole_words = {i for i, t in enumerate(texts) if len(t) < 290 and not t.endswith(".")}
    assert len(at) > 300 and sum(got[i].truncated for i in at) > 0.99 * len(at)
    assert len(whole_words) > 200 and not any(got[i].truncated for i in whole_words)


@pytest.mark.parametrize(
    "text, lang",
    [("Il gatto è sul tavolo della cucina con il cane e non si muove", "it"), ("これは日本語の文章です", "ja"), ("这是一个没有结束标点的中文句子", "zh"), ("Это русский текст", "ru"),
     ("De kat zit op de mat en het is niet goed voor het huis", "nl"), ("O gato não está em casa para os amigos da escola", "pt"), ("The clock was in the hall", "en"), ("42", None)],
)
def test_languages(text, lang):
    assert detect(text) == lang


@pytest.mark.parametrize("text", ["I refuse to answer.", "I won't provide that.", "That goes against my guidelines.", "Mi dispiace, non posso rispondere."])
def test_refusals(text):
    assert is_refusal(text)


def test_texts_without_blanks_are_no_labels():
    assert ending("这是一个没有结束标点的中文句子但是很长")[0] == "broken" and ending("Blau")[0] == "label"


@pytest.fixture(scope="module")
def rules(spark):
    return train(spark)


def test_held_out_kinds(spark, rules):
    docs = [(i, t, k) for i, (t, k) in enumerate(labelled(per_form=8, seed=99))]
    got = kinds(spark.createDataFrame(docs, "doc_id bigint, text string, truth string"), rules)
    truth = {i: k for i, _, k in docs}
    right = sum(truth[r.doc_id] == r.kind for r in got.select("doc_id", "kind").collect())
    assert right / len(docs) > 0.95


def test_blank_and_empty_documents(spark, rules):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n\xa0", 1), (4, "word " * 50000, 1)], "doc_id bigint, text string, kind int")
    got = {r.doc_id: r.kind for r in kinds(df, rules).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "junk"}
    assert kinds(df.limit(0), rules).count() == 0
    assert statistics(df.drop("kind")).where("doc_id = 1").first().n_words is None


def test_induction_is_ordered():
    import numpy as np

    x = np.array([[v] * 22 for v in list(range(50)) + list(range(50))], float)[:, :21]
    y = np.array(["junk" if v >= 25 else "prose" for v in list(range(50)) + list(range(50))])
    out = induce(x, y, ORDER)
    assert out and all(isinstance(r, Rule) and r.kind == "junk" for r in out)


# written by hand, not by the generator of the labelled documents
HAND_WRITTEN = [
    ("prose", "When the ferry failed to arrive, the mayor walked down to the pier and spoke with the crew. Nobody had slept. By noon the harbour was quiet again, and most of the passengers had gone home by bus."),
    ("prose", "I have kept bees for twenty years. In a mild winter they fly on bright days; in a hard one they cluster and hum. You learn to listen at the hive wall, because a silent box in February is bad news."),
    ("prose", "Die Bibliothek wurde 1931 eröffnet und nach dem Krieg erweitert. Heute besitzt sie rund 40.000 Bände, darunter viele Karten. Wer sie benutzen will, braucht einen Ausweis, den man am Eingang bekommt."),
    ("prose", "Le vieux pont a été fermé à la circulation l'an dernier. Les habitants du quartier prennent désormais le bac, qui part toutes les vingt minutes. On parle d'un nouveau pont, mais personne ne sait quand il sera construit."),
    ("prose", "Mi abuela cocinaba los domingos para toda la familia. Ponía la olla al fuego muy temprano y no dejaba entrar a nadie en la cocina. A las dos en punto nos llamaba, y la mesa estaba lista."),
    ("prose", "The committee met on Tuesday. It agreed on three points:\n- the fence will be repaired\n- the gate stays open until ten\n- dogs are welcome\nAll other questions were moved to the next meeting, since the treasurer was ill and nobody else had seen the accounts."),
    ("prose", "To reverse a list in place, call its reverse method, which returns nothing and changes the list itself:\n```python\nxs = [3, 1, 2]\nxs.reverse()\n```\nIf you need a copy instead, use slicing. Both take time in proportion to the length of the list, so neither is slow for short ones."),
    ("prose", "\"You are late,\" said the clerk, without looking up. \"The office closed an hour ago.\" She put the letter on the counter all the same. He sighed, stamped it, and dropped it into the tray behind him."),
    ("list", "Packing for the trip\n- two wool sweaters\n- rain jacket\n- head torch and batteries\n- tin cup\n- matches\n- first aid kit\n- map of the valley"),
    ("list", "1. flour\n2. sugar\n3. four eggs\n4. salt\n5. vanilla\n6. butter\n7. baking powder\n8. milk"),
    ("list", "* call the plumber\n* pay the water bill\n* buy stamps\n* return library books\n* book the dentist\n* water the tomatoes"),
    ("list", "[ ] sweep the attic\n[x] fix the hinge\n[ ] paint the shed\n[x] mow the lawn\n[ ] clean the gutters\n[ ] sharpen the axe"),
    ("list", "oak\nash\nbirch\nmaple\nelm\nhornbeam\nwillow\nalder\nbeech\nlarch\npine"),
    ("list", "a) Rome\nb) Oslo\nc) Cairo\nd) Lima\ne) Hanoi\nf) Accra\ng) Quito"),
    ("table", "| station | opened | depth |\n|---|---|---|\n| North Gate | 1968 | 22 |\n| Mill Lane | 1971 | 18 |\n| Docks | 1980 | 31 |\n| Airport | 1994 | 12 |"),
    ("table", "city,country,population,area\nBergen,Norway,285601,464\nTurku,Finland,195137,306\nAarhus,Denmark,285273,91\nMalmo,Sweden,351749,156"),
    ("table", "date\thigh\tlow\train\n2024-05-01\t17\t8\t0.2\n2024-05-02\t19\t9\t0.0\n2024-05-03\t15\t7\t4.1\n2024-05-04\t14\t6\t6.3"),
    ("table", "Name         Age      Town          Score\nIrene        41       Porto         88\nMattias      37       Ghent         73\nYusuf        29       Izmir         91\nClara        53       Turin         67"),
    ("table", "<table><tr><th>part</th><th>price</th></tr>\n<tr><td>bolt</td><td>0.20</td></tr>\n<tr><td>nut</td><td>0.10</td></tr>\n<tr><td>washer</td><td>0.05</td></tr>\n</table>"),
    ("junk", "Jk2l9 xxQ0z pp8Wd kkT3m zzR7q bb1Vn hh5Xc ttY2s mmK8d wwP4f ggL6j rrN9b ccQ3x ddF7z vvH1k"),
    ("junk", "%PDF&&##~~{{]]@@ ++==<<>>|| ^^&&**(( ~~``!!##$$ ]]{{}}[[ @@%%^^&& **((__++ ##@@!!~~"),
    ("junk", "SGVsbG8gd29ybGQhIFRoaXMgaXMganVzdCBhIHRlc3Qgb2YgdGhlIGVuY29kaW5nIHVzZWQgaGVyZSBhbmQgbm90aGluZyBtb3JlLg=="),
    ("junk", "ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok ok"),
    ("junk", "qwrtpsdfg hjklzxcvb nmqwrt zxcvbnm lkjhgf dsqwrt pmnbvc xzlkjh gfdspt rwqmnb vcxzlk"),
]


def test_hand_written_kinds(spark, rules):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(HAND_WRITTEN)], "doc_id bigint, text string")
    got = {r.doc_id: r.kind for r in kinds(df, rules, ()).collect()}
    wrong = [(k, got[i], t[:40]) for i, (k, t) in enumerate(HAND_WRITTEN) if got[i] != k]
    assert len(wrong) <= 2, wrong
