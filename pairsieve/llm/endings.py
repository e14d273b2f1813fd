"""How a text ends, and whether it declines or repeats its prompt: small helpers for one row."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pairsieve.llm.language import detect, wanted

# Words that stand for "nothing", control tokens, the forms of declining and politeness.
NOTHING = frozenset("none null nan nil n/a na undefined empty".split())
BLANK = re.compile(r"[\s​‌‍⁠﻿ ­]+")
CONTROL = re.compile(r"(?:</?[|\w ]{1,20}\|?>\s*)+|\[(?:empty|blank|null|none|pad|eos|bos|no \w+|end of \w+)\]|\[/?(?:INST|PAD|EOS|BOS|UNK|SEP|CLS)\]", re.I)
MARK = re.compile(r"(?:\s*\[(?:truncated|cut(?: off)?|continued|\.\.\.|…|more)\]|\s*\((?:truncated|cut(?: off)?|continued)\)|\.\.\.+|…|\\+|�+|\s*<(?:truncated|cut)>)\s*\Z", re.I)
ITEM = re.compile(r"^[ \t]*(?:[-*•‣·–+]|\(?\d{1,3}[.)]|\(?[a-z][.)]|\[[ xX]?\])(?:[ \t]+(.*))?$")
LABEL = re.compile(r"\W*(?:(?:answer|antwort|réponse|respuesta|option|choice)\s*:?\s*)?\W*(?:[A-Za-z]|[\d.,:/ ]+\s*(?:%|[^\W\d]{1,4})?|yes|no|ja|nein|oui|non|sí|true|false)\W*", re.I)
DECLINE = re.compile(
    r"\b(?:i|we) (?:refuse|decline|won['’]?t|will not|can(?:not|['’]?t)|could not|am (?:unable|not able)|must decline|do not know|don['’]?t (?:know|have (?:any )?information)|have no (?:way|information|knowledge)|would rather not|am not sure)"
    r"|\bi['’]m (?:not (?:sure|able)|unable)|\bmy knowledge does not cover|\bnothing i can say|\bi would rather not|\bi may (?:not )?talk about|\bappropriate for me|\bagainst (?:my|our) (?:guidelines|polic(?:y|ies)|rules|instructions)"
    r"|\bnon posso|\bnon (?:lo )?so\b|\bnon sono in grado|\bnão (?:posso|sei|consigo)|\bik kan (?:\w+ )?niet|\bik weet (?:het )?niet"
    r"|\bje ne (?:peux|sais|suis) pas|\bje n['’]ai pas d|\bje dois refuser|\bmes connaissances ne|\bque je (?:ne )?peux (?:pas )?aborder"
    r"|\bich weiß (?:es )?nicht|\bkann ich nicht|\bich kann (?:\w+ )?nicht|\bich bin nicht in der lage|\bmöchte ich mich nicht|\bdarf ich nichts|\bhabe ich keine|\bmein wissen umfasst"
    r"|\bno (?:lo )?sé\b|\bno puedo\b|\bno tengo información|\bnegarme a|\bno soy capaz|\bmis conocimientos no|\bfuera de lo que puedo"
)
POLITE = re.compile(
    r"\b(?:i|i['’]m|me|my|you|your|ich|mich|mir|mein|dir|du|dich|je|j['’]|moi|mes|vous|votre|yo|mi|te|tu|preguntame|pregúntame|ayudarte|entiendas|posez|sorry|thanks|thank|unfortunately|entschuldigung|leider|danke|pardon|désolé|merci|malheureusement|disculpa|siento|gracias|lamento|desgracia|mi|dispiace|scusa|grazie|purtroppo|eu|desculpe|obrigado|infelizmente|ik|mij|spijt|helaas|bedankt)\b"
)
ASKED = re.compile(r"\A\W*(?:(?:the |your |original )*(?:question|prompt|you asked|you wrote|user)(?: was| is)?|(?:die |deine )?frage(?: war| lautete)?|du (?:hast )?(?:gefragt|fragtest)|(?:la |votre )?question(?: était)?|vous avez demandé|(?:la |tu )?pregunta(?: era| fue)?|has preguntado|preguntaste)\s*:\s*", re.I)

#: the marks and closers of an ending are looked for in so many last characters
_NEAR = 40
_WORD = re.compile(r"[^\W_]+")
#: what MARK takes as runs
_MARKS = ".…\\\ufffd \t\r\n"
_BLANKS = "".join(c for c in map(chr, range(0x10000)) if BLANK.fullmatch(c))
_SENTENCE = re.compile(r"(?<=[.!?。])[\"'”»)]*\s+")
_BRIEF = re.compile(r"\bmore briefly\b|\bplus brièvement\b|\bmenos palabras\b|\bkürzer\b")
_QUOTED = re.compile(r"(?<!\w)['\"“][^'\"]*\b(?:can|could)not\b")
_TAIL = re.compile(r"(?:[\s​]|[\U0001F000-\U0001FAFF☀-➿️‍])+\Z")
# Letters of scripts that put no blanks between words; eight of them are no label.
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff\u1000-\u109f]{8}")
_END = re.compile(r"[.!?。！？][\"'”’»)\]*_]*\Z|[\"”»)]\Z")


def is_empty(text: str | None) -> bool:
    """Null, nothing but blanks, a placeholder or a control token."""
    if text is None:
        return True
    # blanks of any kind and length around a text are no part of it
    text = text.strip(_BLANKS)
    if len(text) > 64 and text[:1] not in ("<", "[") and _WORD.search(text):
        return False
    t = BLANK.sub(" ", text).strip()
    core = t.strip("\"'`()[]{}<>.…—–-_*# ").lower()
    return not core and len(t) <= 6 or core in NOTHING or CONTROL.fullmatch(t) is not None


def is_repeat(text: str) -> bool:
    """One token over and over."""
    head = text.split(None, 2)
    if len(head) < 3 or head[0] != head[1]:
        return False
    words = text.split()
    return len(words) >= 5 and len(set(words[:-1])) == 1 and words[0].startswith(words[-1])


def row_defects(prompt: str | None, text: str | None) -> list[str]:
    """Defects that show in one pair alone: empty, refusal, copy, other_language."""
    if is_empty(text):
        return ["empty"]
    if is_repeat(text):
        return []
    out = ["refusal"] if is_refusal(text) else []
    if prompt and is_copy(prompt, text):
        return [*out, "copy"]
    if prompt:
        spoken = detect(text)
        if spoken and (want := wanted(prompt)) and want != spoken:
            out.append("other_language")
    return out


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def is_copy(prompt: str, text: str) -> bool:
    """The prompt once or more often, perhaps quoted, relabelled or in another case, and no more."""
    p0, t0 = _WORD.search(prompt), _WORD.search(text)
    if not p0 or not t0:
        return False
    if p0[0].lower() == t0[0].lower():
        p, t = words_of(prompt), words_of(text)
        if len(t) % len(p) == 0 and t == p * (len(t) // len(p)):
            return True
    m = ASKED.match(text)
    return bool(m) and words_of(text[m.end() :]) == words_of(prompt)


def _sentences(text: str) -> Iterator[str]:
    """One sentence after the other, so that the first one with content ends the search."""
    at = 0
    for m in _SENTENCE.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def is_refusal(text: str) -> bool:
    """Some sentence declines, and every other one is only polite: no content is given."""
    declined = False
    for s in _sentences(text.strip().lower()):
        if DECLINE.search(s) and not _QUOTED.search(s):
            if _BRIEF.search(s):
                return False
            declined = True
        elif _WORD.search(s) and not POLITE.search(s):
            return False
    return declined


def ending(text: str | None) -> tuple[str, str | None]:
    """(kind, last word of an item or of a text without an end): blank, repeat, label, sentence, code, item (complete as far as the text
    itself tells), or one of the cut kinds marked, code_open, bracket_open, item_part, broken."""
    if text is None or is_empty(text):
        return "blank", None
    if is_repeat(text):
        return "repeat", None
    t = text.rstrip()
    fences = t.count("```")
    if fences % 2:
        return "code_open", None
    # a run of dots or other marks may be longer than what is looked at
    body = t.rstrip(_MARKS)
    near = max(0, len(body) - _NEAR)
    m = MARK.search(t, near)
    if m and m.start() > 0:
        return ("marked" if t[: m.start()].rstrip(_MARKS[1:])[-1:] not in (".", "!", "?") else "sentence"), None
    if fences and t.endswith("```"):
        return "code", None
    while (m := _TAIL.search(t, max(0, len(t) - _NEAR))) and m.start() > 0:
        t = t[: m.start()]
    lines = [x for x in re.split(r"[\r\n]+", t) if x.strip()]
    items = [ITEM.match(x) for x in lines]
    if len(lines) > 1 and items[-1]:
        if not (items[-1][1] or "").strip():
            return "item_part", None
        sizes = [len(i[1].split()) for i in items[:-1] if i and i[1]]
        last = items[-1][1].split()
        if sizes and len(last) < min(sizes) and len(sizes) >= 2:
            return "item_part", None
        if not _END.search(t, max(0, len(t) - _NEAR)):
            return "item", (words_of(last[-1]) or [None])[-1]
        return "sentence", None
    if t.rfind("(") > t.rfind(")"):
        return "bracket_open", None
    if LABEL.fullmatch(t):
        return "label", None
    if _END.search(t, max(0, len(t) - _NEAR)):
        return "sentence", None
    if len(lines) == 1 and len(t.split()) == 1 and (t.isascii() or not _UNSPACED.search(t)):
        return "label", None
    return "broken", (words_of(t[max(0, len(t) - 2 * _NEAR) :]) or [None])[-1]
