"""Text quality statistics of documents, and the kind of a document: prose, list, table or junk.

The statistics are SQL expressions. An ordered rule list is induced from labelled documents by
incremental reduced-error pruning: for one class after the other, a rule is grown on two thirds of
the examples by information gain, pruned on the last third, and kept while it is right more often
than not there; what it covers leaves the examples. The learned thresholds become one SQL CASE
expression, which is applied natively. The labelled documents are made by `labelled`, a rule-made
sample of PER_FORM documents of each form (documented bound, not taken from the corpus).

Null, empty and blank texts have null statistics and no kind. Line ends of every style end a line.
Equal texts get equal kinds. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.plans.runtime import spread

PER_FORM = 80
SEED = 11

# Common function words of English, French, German and Spanish.
COMMON = (
    "the a of and in to was were is by with for that it this as but not on at from which "
    "la le les de des et une un en dans que qui est sur pour par avec "
    "der die das und ein eine von mit ist im den dem bei nach auf sich sie war "
    "el los las y del con una por se no su más"
).split()

FEATURES = (
    "n_words", "mean_word_len", "symbol_ratio", "punct_line_share", "common_share", "n_lines", "item_share", "row_share", "cells_per_row",
    "line_words", "sentence_rate", "question_share", "lower_start_share", "usual_letters", "lettered_share", "distinct_share", "longest_word", "hex_share", "breaks_share", "repeat_share",
)

LEAST_COVER = 8


ITEM = r"^([-*+•‣·–—▪○]|\\(?[0-9]{1,3}[.)]|\\(?[a-zA-Z][.)]|\\[[ xX]?\\])\\s"
# A row of cells; the plain tests before the patterns spare most lines the search.
ROW = (
    r"(contains(l, '|') and l rlike '\\|.*\\|') or (contains(l, '\t') and l rlike '\t.*\t') or contains(l, '<tr') or contains(l, '<td') or contains(l, '<th') "
    r"or (contains(l, '  ') and l rlike '\\S {2,}\\S.* {2,}\\S') or l rlike '^\\+[-=+]{3,}|^[^,;]{0,28}(,[^,;]{0,28}){2,}$|^[^,;]{0,28}(;[^,;]{0,28}){2,}$'"
)
CELL = r"\\||\t|</t[dh]>| {2,}|[,;]"


# Punctuation of plain prose, blanks, and the letters most usual in the four languages.
PLAIN_MARKS = ".,;:!?¿¡'\"()’«»-"
BLANKS = " \n\r\t ​﻿"
USUAL = "eiontréèíóäöü"
QUESTION = (
    r"[?]$|^[^\\p{L}]{0,4}(¿|(who|what|where|how|why|when|which|describe|tell me|could you|please|i have read|was|wie|wer|wo|kannst|erzähle|beschreibe|que|qui|comment|où|peux|parle|décris|quelles|qué|quién|cómo|dónde|puedes|cuéntame)\\b)"
)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with one column for each of FEATURES.

    Counts of single characters use translate, which is several times faster than a regular expression.
    """
    common = ", ".join(f"'{w}'" for w in COMMON)
    d = df.withColumn("_t", F.when(F.col(text).rlike("[^\\s\\u00a0\\u200b\\ufeff]"), F.col(text)))
    d = d.withColumn("_lines", F.expr(r"filter(transform(split(_t, '\\R'), l -> trim(l)), l -> l <> '')"))
    d = d.withColumn("_w", F.expr(r"filter(split(lower(_t), '[^\\p{L}\\p{N}]+'), w -> w <> '')"))
    d = d.withColumn("_rows", F.expr(f"filter(_lines, l -> ({ROW}) and not l rlike '{ITEM}')"))
    without = lambda chars: F.length(F.translate("_t", chars, ""))
    d = d.withColumns(
        {
            "_joined": F.array_join("_w", ""),
            "_chars": F.greatest(without(BLANKS), F.lit(1)),
            "_marks": F.length("_t") - without(PLAIN_MARKS),
            "_digits": F.length("_t") - without("0123456789"),
        }
    )
    n = "greatest(size(_w), 1)"
    lines = "greatest(size(_lines), 1)"
    letters = "greatest(length(_joined) - _digits, 0)"
    size = "greatest(length(array_join(_lines, '')), 1)"
    x = {
        "n_words": "size(_w)",
        "mean_word_len": f"length(_joined) / {n}",
        "symbol_ratio": "greatest(_chars - length(_joined) - _marks, 0) / _chars",
        "punct_line_share": f"size(filter(_lines, l -> l rlike '[.!?…][\"”»)]*$')) / {lines}",
        "common_share": f"size(filter(_w, w -> w in ({common}))) / {n}",
        "n_lines": "size(_lines)",
        "item_share": f"length(array_join(filter(_lines, l -> l rlike '{ITEM}'), '')) / {size}",
        "row_share": f"length(array_join(_rows, '')) / {size}",
        "cells_per_row": f"aggregate(transform(_rows, l -> size(split(l, '{CELL}'))), 0, (a, x) -> a + x) / greatest(size(_rows), 1)",
        "line_words": f"size(_w) / {lines}",
        "sentence_rate": f"regexp_count(_t, '[.!?…](\\\\s|$)') / {n}",
        "question_share": f"size(filter(_lines, l -> lower(l) rlike '{QUESTION}')) / {lines}",
        "lower_start_share": f"size(filter(_lines, l -> l rlike '^\\\\p{{Ll}}')) / {lines}",
        "usual_letters": f"(length(_joined) - length(translate(_joined, '{USUAL}', ''))) / greatest({letters}, 1)",
        "lettered_share": f"{letters} / _chars",
        "distinct_share": f"size(array_distinct(_w)) / {n}",
        "longest_word": "coalesce(array_max(transform(_w, w -> length(w))), 0)",
        "hex_share": f"size(filter(_w, w -> length(w) = 2 and w rlike '^[0-9a-f]{{2}}$')) / {n}",
        "breaks_share": f"size(filter(_lines, l -> not l rlike '[.!?:…][\"”»)]*$')) / {lines}",
        "repeat_share": "size(filter(zip_with(slice(_w, 1, greatest(size(_w) - 1, 0)), slice(_w, 2, greatest(size(_w) - 1, 0)), (a, b) -> a = b), x -> x)) / greatest(size(_w) - 1, 1)",
    }
    own = ("_t", "_lines", "_w", "_rows", "_joined", "_chars", "_marks", "_digits")
    return d.withColumns({k: F.when(F.col("_t").isNotNull(), F.expr(v).cast("double")) for k, v in x.items()}).drop(*own)


# Made words for the labelled documents.
_WORDS = {
    "en": ("The garden|A small boat|Our neighbour|This report|The old school|Every visitor", "was seen near|has carried|described to|moved with|is known for|did not open", "the river|a green box|an early letter|the market hall|several notes|its narrow door", "in the winter|after a short talk|because it rained|without delay|at the end of the week|for the first time"),
    "fr": ("Le jardin|Une petite barque|Notre voisin|Ce rapport|La vieille école", "a été vu près de|porte|décrit dans|est connu pour", "la rivière|une boîte verte|la lettre|des notes anciennes", "en hiver|après un court discours|sans retard|à la fin de la semaine"),
    "de": ("Der Garten|Ein kleines Boot|Unser Nachbar|Dieser Bericht|Die alte Schule", "war bei|trug mit|ist bekannt für|lag auf", "dem Fluss|eine grüne Kiste|den frühen Brief|die Notizen", "im Winter|nach kurzer Rede|ohne Verzögerung|am Ende der Woche"),
    "es": ("El jardín|Una barca pequeña|Nuestro vecino|Este informe|La vieja escuela", "fue visto cerca de|lleva|es conocido por|está en", "el río|una caja verde|la carta|las notas antiguas", "en invierno|después de un discurso|sin retraso|al final de la semana"),
}
_NOUNS = "cups chairs ropes doors lamps bottles pictures wheels coins plates bolsas mesas puertas livres tables lampes Stühle Türen Lampen Räder".split()
_ADJ = "red tall cheap heavy bright plain rojo viejo grand vert alte kleine".split()
_LONG = "Geschwindigkeitsbegrenzung Lebensversicherungsgesellschaft internationalisation unwahrscheinlicherweise extraordinarily electroencefalografista anticonstitutionnellement Bezirksschornsteinfegermeister Donaudampfschifffahrtsgesellschaft".split()
_NAMES = "Tarnu Velik Osdar Pimora Kestel Ranvo Ludek Sintar Bomari Gelvan".split()


def _name(r: random.Random) -> str:
    return "".join(r.choice("bdfghjklmnprstvwz") + r.choice("aeiou") for _ in range(r.randint(2, 4))) + r.choice("rnsqlk")


def _sentence(r: random.Random, lang: str) -> str:
    a, b, c, e = (r.choice(p.split("|")) for p in _WORDS[lang])
    form = r.randrange(6)
    if form == 0:
        s = f"{_name(r).title()} {b} {c}, {r.choice(_ADJ)} {r.choice(_NOUNS)} {e}"
    elif form == 1:
        s = f"{r.choice(_ADJ).title()} {r.choice(_NOUNS)} {_name(r)} {r.randint(3, 2000)} {r.choice(_NOUNS)} {r.choice(_ADJ)} {_name(r).title()} {e}"
    elif form == 2:
        s = f"{a} {b} {c}"
    else:
        s = f"{a} {b} {c} {e}" + r.choice(("", f", {r.choice(_NAMES)} {_name(r)} {r.choice(_ADJ)} {r.choice(_NOUNS)}"))
    if r.random() < 0.15:
        s += " " + r.choice(_LONG)
    return s + r.choice((".", ".", ".", ".", ".", "?"))


def _prose(r: random.Random, lang: str, least: int = 2, most: int = 24) -> list[str]:
    out = [_sentence(r, lang) for _ in range(r.randint(least, most))]
    if r.random() < 0.4:
        out[-1] += r.choice((" ≈ 4½ €", " 日本語の注記。", " 🙂", " [24]", " (see a.example/4)", " été ï̈", ""))
    if r.random() < 0.1:
        out[-1] = out[-1].rstrip(".?")
    return out


def _wrap(text: str, width: int) -> str:
    out, line = [], ""
    for w in text.split(" "):
        if line and len(line) + len(w) >= width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def _items(r: random.Random, lang: str, n: int) -> list[str]:
    form = r.randrange(5)
    if form == 0:
        return [f"{r.choice(_ADJ)} {r.choice(_NOUNS)}" for _ in range(n)]
    if form == 1:
        return [f"{r.choice(_NOUNS)}: {r.randint(2, 900)}" for _ in range(n)]
    if form == 2:
        return [f"{r.choice(_NAMES)} {r.choice(_NOUNS)}" for _ in range(n)]
    q = {"en": "What did {} do with the {}|How does {} keep its {}|Tell me about the {} of {}|Could you explain why {} moved the {}", "fr": "Que faisait {} avec les {}|Comment {} garde-t-il ses {}", "de": "Was machte {} mit den {}|Wie bewahrt {} seine {} auf", "es": "¿Qué hizo {} con los {}|¿Cómo guarda {} sus {}"}[lang].split("|")
    end = r.choice(("", "?", "?"))
    if form == 4:
        return [_sentence(r, lang) if r.random() < 0.5 else r.choice(q).format(_name(r).title(), r.choice(_NOUNS)) + "?" for _ in range(n)]
    return [r.choice(q).format(r.choice(_NAMES), r.choice(_NOUNS)) + end for _ in range(n)]


def _list(r: random.Random, lang: str, n: int, marked: bool | None = None) -> str:
    items = _items(r, lang, n)
    sentences = any(x.endswith(".") for x in items)
    form = r.randrange(6) if marked or sentences else r.randrange(9) if marked is None else 6
    mark = {0: lambda i: "- ", 1: lambda i: "* ", 2: lambda i: f"{i + 1}. ", 3: lambda i: f"{i + 1}) ", 4: lambda i: r.choice(("[ ] ", "[x] ")), 5: lambda i: "• "}.get(form, lambda i: "")
    if form == 8:
        return r.choice(("; ", "; ", ", ")).join(items if max(map(len, items)) < 30 else [f"{r.choice(_ADJ)} {r.choice(_NOUNS)}" for _ in items])
    return "\n".join(mark(i) + x for i, x in enumerate(items))


def _table(r: random.Random, n: int) -> str:
    k = r.randint(4, 6)
    head = r.sample(["name", "kind", "total", "good", "bad", "share", "open"], k)
    rows = [head] + [[r.choice(_NAMES).lower(), r.choice(_NOUNS), *[str(r.randint(0, 500)) if r.random() < 0.8 else f"{r.random() * 99:.1f}" for _ in range(k - 2)]] for _ in range(n)]
    form = r.randrange(7)
    if form == 0:
        return "\n".join("| " + " | ".join(x) + " |" for x in [rows[0], ["---"] * k, *rows[1:]])
    if form == 1:
        return "\n".join("\t".join(x) for x in rows)
    if form == 2:
        return "\n".join(r.choice((", ", ","))[:2].join(x) for x in rows)
    if form == 3:
        return "\n".join("".join(c.ljust(14) for c in x).rstrip() for x in rows)
    if form == 4:
        return "<table>" + "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>" for x in rows) + "\n</table>"
    if form == 5:
        bar = "+" + "+".join("-" * 14 for _ in range(k)) + "+"
        return "\n".join([bar, *["|" + "|".join(c.ljust(14) for c in x) + "|" for x in rows], bar])
    return "\n".join(";".join(x) for x in rows)


def _junk(r: random.Random) -> str:
    form, n = r.randrange(10), r.randint(60, 700)
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    if form == 0:
        return " ".join(pick("bcdfghjklmnpqrstvwxz", r.randint(2, 12)) for _ in range(n // 7))
    if form == 1:
        return pick("asdfjkl;", n)
    if form == 2:
        return pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", n) + "="
    if form == 3:
        return "\n".join(f"{i * 16:08x}  " + " ".join(f"{r.randrange(256):02x}" for _ in range(16)) for i in range(n // 50))
    if form == 4:
        return pick("#%&*+=<>|\\/^~@$_{}[]()! ", n)
    if form == 5:
        return pick("ÃÂâ€™°©¶Ð� ", n)
    if form == 6:
        return " ".join([r.choice(("A", "0", ",", "▁", "the", "is", "-", *[_name(r) for _ in range(9)]))] * r.choice((r.randint(12, 30), n // 4 + 4)))
    if form == 7:
        return r.choice(("ha", "xo", "no", "te", "ri", "=-", "▁", "?!")) * (n // 2)
    if form == 8:
        return " ".join(r.choice((r.choice("0123456789") * r.randint(1, 4), r.choice((".", ",", "-")) * r.randint(1, 4))) for _ in range(n // 3))
    return " ".join(pick("abcdefghijklmnopqrstuvwxyz0123456789", r.randint(3, 14)) for _ in range(n // 8))


def labelled(per_form: int = PER_FORM, seed: int = SEED) -> list[tuple[str, str]]:
    """(text, kind) of made documents: 2 * per_form of each of 13 forms of prose, 9 * per_form of each of
    list, table and junk, so 53 * per_form in all."""
    r = random.Random(seed)
    out: list[tuple[str, str]] = []
    for _ in range(per_form * 2):
        lang = r.choice(("en", "en", "en", "fr", "de", "es"))
        s = _prose(r, lang)
        out.append((" ".join(s), "prose"))
        out.append((_wrap(" ".join(_prose(r, lang, 3)), r.choice((40, 60, 80))), "prose"))
        out.append(("\n\n".join(_prose(r, lang)), "prose"))
        out.append((f"{r.choice(('# ', ''))}{r.choice(_NAMES)}\n\n" + " ".join(s), "prose"))
        out.append(("\n".join(f"{r.choice(('User', 'Judge'))}: {x}" for x in _prose(r, lang)), "prose"))
        out.append((" ".join(s).lower(), "prose"))
        out.append((" ".join(_prose(r, lang, 1, 3)) + r.choice(("", " " + r.choice(_LONG) + ".")), "prose"))
        out.append((" ".join(", ".join(x.rstrip(".?") for x in _prose(r, lang, 2, 4)) + "." for _ in range(r.randint(1, 6))), "prose"))
        long = " ".join(_prose(r, lang, 10, 24))
        part = lambda t: " ".join(_sentence(r, lang) for _ in range(1 + len(t) // r.randint(30, 60)))
        few = _list(r, lang, r.randint(2, 6), marked=True)
        out.append((part(few) + "\n" + few + "\n" + part(few), "prose"))
        out.append((_wrap(long, 55) + "\n" + _list(r, lang, r.randint(2, 4), marked=True) + "\n" + _wrap(" ".join(_prose(r, lang, 4, 9)), 55), "prose"))
        out.append((" ".join(" ".join(x.split()[-5:]).capitalize() for x in _prose(r, lang, 4, 14)), "prose"))
        few = _table(r, r.randint(1, 5))
        out.append((part(few) + "\n" + few + "\n" + part(few), "prose"))
        out.append((long + "\n```python\ndef f(x):\n    rows = [r for r in x if r['a'] > 3]\n    return rows\n```", "prose"))
    for _ in range(per_form * 9):
        lang = r.choice(("en", "en", "en", "fr", "de", "es"))
        head = {"en": "Here is the list:\n", "fr": "Les points :\n", "de": "Die Punkte:\n", "es": "Los puntos:\n"}[lang] if r.random() < 0.5 else ""
        many = _list(r, lang, r.randint(5, 36))
        lead = " ".join(_sentence(r, lang) for _ in range(len(many) // 160)) + "\n" if r.random() < 0.3 else head
        out.append((lead + many, "list"))
        many = _table(r, r.randint(4, 36))
        lead = " ".join(_sentence(r, lang) for _ in range(len(many) // 160)) + "\n" if r.random() < 0.3 else ""
        out.append((lead + many, "table"))
        out.append((_junk(r), "junk"))
    return out


@dataclass(frozen=True)
class Rule:
    """All of `tests` (feature, "<=" or ">", threshold) hold -> `kind`."""

    kind: str
    tests: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        return " and ".join(f"{f} {op} {v!r}D" for f, op, v in self.tests)


def _covers(tests: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for i, op, v in tests:
        hit &= x[:, i] <= v if op == "<=" else x[:, i] > v
    return hit


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> list[tuple[int, str, float]]:
    tests: list[tuple[int, str, float]] = []
    hit = np.ones(len(x), bool)
    while (~y[hit]).any() and len(tests) < 6:
        p0, n0 = (y & hit).sum(), (~y & hit).sum()
        best: tuple[float, tuple[int, str, float]] | None = None
        for i, values in enumerate(cuts):
            low = x[hit, i][:, None] <= values[None, :]
            p = (low & y[hit][:, None]).sum(0)
            n = low.sum(0) - p
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), -1.0)
                j = int(gain.argmax())
                if best is None or gain[j] > best[0]:
                    best = (float(gain[j]), (i, op, float(values[j])))
        if best is None or best[0] <= 1e-9:
            break
        tests.append(best[1])
        hit &= _covers([best[1]], x)
    return tests


def _prune(tests: list[tuple[int, str, float]], x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[int, str, float]], float]:
    def worth(k: int) -> float:
        hit = _covers(tests[:k], x)
        p, n = (y & hit).sum(), (~y & hit).sum()
        return (p - n) / (p + n) if p + n else -1.0

    k = max(range(len(tests), 0, -1), key=worth)
    return tests[:k], worth(k)


def induce(x: np.ndarray, kinds: np.ndarray, order: tuple[str, ...], seed: int = SEED) -> list[Rule]:
    """Ordered rule list by incremental reduced-error pruning; what no rule covers is of the last kind."""
    rng = np.random.default_rng(seed)
    cuts = []
    for i in range(x.shape[1]):
        v = np.unique(x[:, i])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid[:: max(1, len(mid) // 200)] if len(mid) else v)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    for kind in order[:-1]:
        while (left & (kinds == kind)).any():
            at = rng.permutation(np.flatnonzero(left))
            grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
            tests = _grow(x[grow], kinds[grow] == kind, cuts)
            if not tests:
                break
            tests, worth = _prune(tests, x[prune], kinds[prune] == kind)
            if worth <= 0:
                break
            hit = _covers(tests, x) & left
            if (hit & (kinds == kind)).sum() < LEAST_COVER:
                break
            rules.append(Rule(kind, tuple((FEATURES[i], op, v) for i, op, v in tests)))
            left &= ~hit
    return rules


def case_sql(rules: list[Rule], last: str) -> str:
    """The rule list as a CASE expression."""
    return "case " + " ".join(f"when {r.sql()} then '{r.kind}'" for r in rules) + f" else '{last}' end"


ORDER = ("junk", "table", "list", "prose")


def train(spark: SparkSession, per_form: int = PER_FORM, seed: int = SEED) -> list[Rule]:
    """Rules learned from the labelled documents, whose statistics come from the same expressions."""
    docs = labelled(per_form, seed)
    rows = statistics(spark.createDataFrame(docs, "text string, kind string")).select("kind", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float)
    return induce(x, np.array([r.kind for r in rows]), ORDER, seed)


def kinds(documents: DataFrame, rules: list[Rule] | None = None, keep: tuple[str, ...] = FEATURES) -> DataFrame:
    """doc_id, the statistics named in `keep`, and kind.

    The kind passes a generator of one row, through which no filter on it is pushed: the statistics are
    computed once, and only those that `keep` or the rules need.
    """
    rules = train(documents.sparkSession) if rules is None else rules
    s = statistics(spread(documents.select("doc_id", "text")))
    kind = F.when(F.col("n_words").isNotNull(), F.expr(case_sql(rules, ORDER[-1])))
    return s.select("doc_id", F.inline(F.array(F.struct(*keep, kind.alias("kind")))))
