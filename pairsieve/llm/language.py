"""Language of short texts: by script, where the script tells it, else by function words and letters."""

from __future__ import annotations

import re
from functools import lru_cache

# Function words of each language, and letters that only one of the four uses.
FUNCTION_WORDS = {
    "en": "the of and to was were is are by with for that it its this these there not on at from in how what who did which when they them their about after before because while have has been some those into near i my you your me cannot can't don't do",
    "fr": "le la les des du et une un en dans que qui est sur pour par avec ont été au aux ce ces pas cela son ses leur après près même je vous ne se sont était comme mais plus où quelles il elle selon d'un d'une c'est s'est n'est qu'il n'ai j'ai qu'est-il",
    "de": "der die das und ein eine einen einer von mit ist im den dem bei nach auf sich aus sie war wie wer was als zu nicht für es waren hat wird ich du dir mich mein dabei darüber dazu kann obwohl damals seit zum zur leider weiß",
    "es": "el los las y del una un con por se no más de la en que su sus cerca como al qué fue son está esto ese esa lo mi te yo aunque según según aquel también hay muy después sé puedo eso",
}
# Further languages, which must be clearly ahead of the four above, and scripts of one language.
OTHER_WORDS = {
    "it": "il lo gli della dei delle di che è non sono nel nella con per anche come questo questa più ma una uno si ha alla dal",
    "pt": "o os as da do das dos em um uma não é são com para mas mais foi pelo pela ao também você isso que",
    "nl": "de het een van en is dat niet op te voor met zijn aan er maar om ook als bij uit naar wordt deze die",
}
SCRIPTS = {
    "ja": "[\u3040-\u30ff]", "ko": "[\uac00-\ud7af]", "zh": "[\u3400-\u9fff]", "ru": "[\u0400-\u04ff]", "ar": "[\u0600-\u06ff]",
    "he": "[\u0590-\u05ff]", "el": "[\u0370-\u03ff]", "hi": "[\u0900-\u097f]", "th": "[\u0e00-\u0e7f]",
}
LETTERS = {"fr": "çœêîûëù", "de": "äöüß", "es": "ñ¿¡íóú"}
LANGUAGE_NAMES = {
    "en": "english anglais englisch inglés", "fr": "french français französisch francés",
    "de": "german allemand deutsch alemán", "es": "spanish espagnol spanisch español",
}
ASK = re.compile(r"(?:answer|reply|respond|réponds|répondre|répondez|antworte|antworten|responde|responder|contesta)\s+(?:\w+\s+)?(?:in|en|auf)\s+(\w+)", re.I)

_NAMES = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}
_AROUND = ".,;:!?¿¡\"'’“”«»()[]*"
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_LANGS = tuple(FUNCTION_WORDS)


def _index() -> tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]]:
    words: dict[str, tuple[int, ...]] = {}
    letters: dict[str, tuple[int, ...]] = {}
    for i, lang in enumerate(_LANGS):
        for w in FUNCTION_WORDS[lang].split():
            words[w] = (*words.get(w, ()), i)
        for c in LETTERS.get(lang, ""):
            letters[c] = (*letters.get(c, ()), i)
    return words, letters


_WORDS, _LETTERS = _index()
_OTHERS = {lang: frozenset(words.split()) for lang, words in OTHER_WORDS.items()}
_SCRIPTS = {lang: re.compile(letters) for lang, letters in SCRIPTS.items()}
_LETTER = re.compile(r"[^\W\d_]")


def _by_script(text: str) -> str | None:
    """The language of a script that holds at least half of the letters; kana tell Japanese from Chinese."""
    total = len(_LETTER.findall(text))
    n = {lang: len(found) for lang, letters in _SCRIPTS.items() if (found := letters.findall(text))}
    if not n or total < 4:
        return None
    if n.get("ja", 0) and 2 * (n["ja"] + n.get("zh", 0)) >= total:
        return "ja" if 5 * n["ja"] >= n.get("zh", 0) else "zh"
    best = max(n, key=lambda lang: n[lang])
    return best if 2 * n[best] >= total else None
_SPECIAL = re.compile("[" + "".join(_LETTERS) + "]")


def detect(text: str) -> str | None:
    """The language with clearly the most evidence, or None: bare labels, numbers and code have none."""
    if "```" in text:
        text = _CODE.sub(" ", text)
    low = text.lower()
    if not low.isascii() and (lang := _by_script(low)):
        return lang
    points = [0.0] * len(_LANGS)
    get = _WORDS.get
    words = low.replace("’", "'").split()
    for w in words:
        for i in get(w) or get(w.strip(_AROUND), ()):
            points[i] += 1
    if not low.isascii():
        marks = [0] * len(_LANGS)
        for c in _SPECIAL.findall(low):
            for i in _LETTERS[c]:
                marks[i] += 1
        points = [a + min(3.0, 0.75 * b) for a, b in zip(points, marks)]
    first, second = sorted(points, reverse=True)[:2]
    for lang, own in _OTHERS.items():
        if len(words) >= first + 3 and sum(w.strip(_AROUND) in own for w in words) >= max(first + 2, 4):
            return lang
    return _LANGS[points.index(first)] if first >= 1.5 and first >= second + 1 else None


@lru_cache(maxsize=4096)
def wanted(prompt: str) -> str | None:
    """The language a prompt asks for, else its own."""
    m = ASK.search(prompt)
    asked = _NAMES.get(m[1].lower()) if m else None
    return asked or detect(prompt)
