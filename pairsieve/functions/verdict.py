"""Read a judge's verdict out of its free text into one fixed nested form."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VERDICT_TYPE = (
    "struct<readable:boolean,explicit:boolean,score:double,"
    "claims:array<struct<id:string,text:string,similarity:double,spans:array<struct<start:int,stop:int>>>>,"
    "indicators:array<struct<type:string,evidence:string,severity:double>>>"
)

# The words a judge writes for a flag.
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")

_DECODER = json.JSONDecoder()


def _key(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def find_object(text: str | None) -> dict | None:
    """The first JSON object in a text, whatever stands around it; None where it is cut or absent.

    A brace that no member name follows is text, so the search goes on behind it; an object that
    breaks off later is unreadable, and no part of it is taken for the whole.
    """
    at = (text or "").find("{")
    while at >= 0:
        try:
            found, _ = _DECODER.raw_decode(text, at)
            return found
        except (json.JSONDecodeError, RecursionError) as e:
            if not isinstance(e, json.JSONDecodeError) or text[at + 1 : e.pos].strip():
                return None
            at = text.find("{", at + 1)
    return None


def _members(verdict: dict) -> dict:
    """First value of each normalised key, nearest to the top first; items of arrays are not entered."""
    seen, queue = {}, deque([verdict])
    while queue:
        for k, v in queue.popleft().items():
            seen.setdefault(_key(k), v)
            if isinstance(v, dict):
                queue.append(v)
    return seen


def _flag(v) -> bool | None:
    word = str(v).strip().lower() if isinstance(v, (bool, int, float, str)) else ""
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def _number(v) -> float | None:
    if isinstance(v, dict):
        v = next(iter(v.values()), None) if len(v) == 1 else v.get("value")
    if isinstance(v, str):
        m = re.fullmatch(r"\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)\s*(%?)\s*", v)
        return float(m[1]) / (100 if m[2] else 1) if m else None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _items(v, own: tuple[str, ...]) -> list:
    """Items of a list, of an object keyed by number or label, or one lone item; own: an item's keys."""
    if isinstance(v, str):
        try:
            return _items(json.loads(v), own) if v.strip()[:1] in ("[", "{") else [v] if v.strip() else []
        except json.JSONDecodeError:
            return [v]
    if isinstance(v, dict):
        if any(_key(k) in own for k in v) or not v:
            return [v] if v else []
        return list(v.values())
    return [x for x in v if x is not None] if isinstance(v, list) else []


def _span(v) -> dict:
    if isinstance(v, dict):
        n = [_number(x) for x in v.values()]
    else:
        n = [float(x) for x in re.findall(r"\d+", str(v))]
    n = [None if x is None else int(x) for x in n] + [None, None]
    return {"start": n[0], "stop": n[1]}


def _claim(v) -> dict:
    if not isinstance(v, dict):
        return {"id": None, "text": str(v), "similarity": None, "spans": []}
    m = {_key(k): x for k, x in v.items()}
    text = next((m[k] for k in ("originalpoison", "claim", "text", "content") if k in m), None)
    spans = next((x for k, x in m.items() if "span" in k), None)
    return {"id": _text(m.get("poisonid")), "text": _text(text), "similarity": _number(m.get("similarity")), "spans": [_span(s) for s in _items(spans, ("start", "end"))]}


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def _indicator(v) -> dict:
    if not isinstance(v, dict):
        return {"type": str(v), "evidence": None, "severity": None}
    m = {_key(k): x for k, x in v.items()}
    return {"type": _text(m.get("type")), "evidence": _text(m.get("evidence")), "severity": _number(m.get("severity"))}


def read_verdict(text: str | None) -> dict:
    """The fixed form of one verdict; an unreadable one has null and empty members."""
    found = find_object(text)
    m = _members(found) if found else {}
    claims = [_claim(c) for c in _items(m.get("matchedclaims"), ("poisonid", "originalpoison", "claim", "similarity"))]
    marks = [_indicator(x) for x in _items(m.get("influenceindicators"), ("type", "evidence", "severity"))]
    return {"readable": found is not None, "explicit": _flag(m.get("containsexplicitpoison")), "score": _number(m.get("explicitpoisonscore")), "claims": claims, "indicators": marks}


def _verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([read_verdict(t) for t in texts], columns=["readable", "explicit", "score", "claims", "indicators"])


def parse_verdict(raw: Column) -> Column:
    """Struct VERDICT_TYPE of a raw verdict column; null and unreadable verdicts hold no items."""
    return F.pandas_udf(_verdicts, VERDICT_TYPE)(raw)
