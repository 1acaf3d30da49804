"""Airband parsers: spoken numbers (N5-N7), draughts (N8, N9), flight call signs (T14-T18). Grammars as patterns over a normalised token line,
run in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import indel_ratio_of
from .text import DIGITS, LETTERS

#: Digits and small numbers as they are spoken on the airband.
AIR_DIGITS = DIGITS | {"oh": "0", "tree": "3", "fife": "5"}
SMALL = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
}
#: Airline names as spoken or garbled, and their codes.
AIRLINES = {
    "klm": "KLM", "kalm": "KLM", "rklm": "KLM", "klmx": "KLM", "llm": "KLM", "lem": "KLM", "kelom": "KLM", "transavia": "TRA", "american": "AAL", "united": "UAL",
    "delta": "DAL", "envoy": "ENY", "qatar": "QTR", "qatari": "QTR", "ryanair": "RYR", "speedbird": "BAW", "lufthansa": "DLH", "easyjet": "EZY", "shamrock": "EIN",
    "shemarck": "EIN", "canada": "ACA", "jetblue": "JBU", "orange": "TFL", "kl": "KLM", "city": "KLC", "easy": "EZY", "alpine": "EJU", "scandinavian": "SAS",
    "vueling": "VLG", "flyer": "CFE", "airbaltic": "BTI", "emirates": "UAE", "airfrans": "AFR", "airfrance": "AFR", "turkish": "THY", "fraction": "NJE",
    "sunexpress": "SXS", "sunturk": "PGT", "austrian": "AUA", "itarrow": "ITY", "airportugal": "TAP", "anatolia": "TKJ", "anatolian": "TKJ", "swiss": "SWR",
    "singapore": "SIA", "iberia": "IBE", "etihad": "ETD", "pollot": "LOT", "aegean": "AEE", "saudia": "SVA", "iceair": "ICE", "finnair": "FIN", "tarom": "ROT",
    "chinasouthern": "CSN", "transat": "TSC", "surinam": "SLM", "cathay": "CPA", "hainan": "CHH", "egyptair": "MSR",
}
#: Names of two words that are written as one.
JOINED = (
    ("jet blue", "jetblue"), ("air baltic", "airbaltic"), ("air france", "airfrance"), ("air frans", "airfrans"), ("sun express", "sunexpress"),
    ("air portugal", "airportugal"), ("china southern", "chinasouthern"), ("ice air", "iceair"), ("egypt air", "egyptair"),
)
TENS = {"twenty": "2", "thirty": "3", "forty": "4", "fifty": "5", "sixty": "6", "seventy": "7", "eighty": "8", "ninety": "9", "oh": "0"}

_any = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
_DIGIT = rf"(?:{_any(AIR_DIGITS)}|\d)(?= )"
_RUN = rf"((?:{_DIGIT} )+)"
_HEADING = re.compile(rf"(?:heading|(?<=left )turn|(?<=right )turn|left(?= turn )|right(?= turn )) (?:(?:turn|heading|left|right) )*{_RUN}")
_LEVEL = re.compile(rf"(?:level|climb|climbing|descend|descending|maintain|maintaining) (?:(?:to|and|flight|level|altitude|now|further) )*{_RUN}(?!thousand |hundred )")
_UNITS = _any([w for w, n in SMALL.items() if n < 10])
_THOUSANDS = re.compile(rf"(?:(twenty|thirty) ({_UNITS})|({_any(SMALL)})) (?:(thousand) (?:({_any(SMALL)}) hundred )?|(hundred) )")


def _digits(run: str) -> str:
    return "".join(AIR_DIGITS.get(w, w) for w in run.split())


def _feet(m: re.Match) -> int | None:
    n = SMALL[m[1]] + SMALL[m[2]] if m[1] else SMALL[m[3]]
    if m[4]:
        return n * 1000 + (SMALL[m[5]] * 100 if m[5] else 0)
    return n * 100 if n >= 10 else None  # "twenty five hundred" is said, "five hundred" is no altitude


def numbers_of(text: str | None) -> list[dict]:
    """Altitudes (feet) and headings that follow their trigger words; each (kind, value) once, in the order heard."""
    tokens = [t for raw in re.findall(r"[a-z]+|\d+|[,.;:!?]", (text or "").lower()) for t in (raw if raw.isdigit() else [raw])]
    line, starts, at = " ".join(tokens) + " ", [], 0
    for t in tokens:
        starts.append(at)
        at += len(t) + 1
    found: dict[tuple[str, int], str] = {}
    resume = 0
    for k, start in enumerate(starts):
        if start < resume:
            continue
        value = kind = None
        if m := _HEADING.match(line, start):
            run = _digits(m[1])
            if len(run) == 3 and 1 <= int(run) <= 360:
                kind, value = "heading", int(run)
        if value is None and (m := _LEVEL.match(line, start)):
            run = _digits(m[1])
            if 2 <= len(run) <= 3:
                kind, value = "altitude", int(run) * 100
        if value is None and (m := _THOUSANDS.match(line, start)):
            before = tokens[max(0, k - 2) : k]
            if not {"passing", "leaving"} & set(before) and before[-1:] != ["of"]:
                kind, value = "altitude", _feet(m)
        if value is not None:
            resume = m.end()
            found.setdefault((kind, value), line[start : m.end()].strip())
    return [{"kind": kind, "value": value, "text": said} for (kind, value), said in found.items()]


def numbers(text: Column) -> Column:
    @F.pandas_udf("array<struct<kind:string,value:int,text:string>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([numbers_of(t) for t in texts])

    return parsed(text)


def _spoken(word: str) -> str | None:
    """T7 for one word."""
    if word in LETTERS or word in DIGITS:
        return LETTERS.get(word) or DIGITS[word]
    compact = word.isalnum() and (len(word) == 1 or len(word) <= 8 and any(map(str.isdigit, word)) and any(map(str.isalpha, word)))
    return word.upper() if compact else None


def _code_digit(word: str, following: str | None) -> str | None:
    """Also tens, and 'for' before something spelt."""
    if word.isdigit():
        return word
    said = _spoken(word) or TENS.get(word)
    return "4" if said is None and word == "for" and following and _spoken(following) else said


#: Names that a word may resemble, in their order.
_RESEMBLED = [(i, name, code) for i, (name, code) in enumerate(AIRLINES.items()) if len(name) >= 5 and name != "orange"]


@lru_cache(maxsize=65536)
def airline_of(word: str) -> str | None:
    """By name, or by the most similar long name at 85 or more ('orange' only exactly). Words come again and again, so that answers are kept;
    a name too short or too long to reach 85 isn't compared."""
    if word in AIRLINES or len(word) < 5:
        return AIRLINES.get(word)
    close = [(indel_ratio_of(word, name), -i, code) for i, name, code in _RESEMBLED if 200 * min(len(word), len(name)) >= 85 * (len(word) + len(name))]
    score, _, code = max(close, default=(0.0, 0, None))
    return code if score >= 85 else None


_PREFIXES = {code.lower(): name for name, code in reversed(AIRLINES.items())} | {name: name for name in AIRLINES}
_GLUED = re.compile(rf"\b({_any(_PREFIXES)})(\d[a-z0-9]*)\b")


def callsign_of(text: str | None) -> str | None:
    """An airline and up to four words of digits or letters after it; a bare code only where the code itself was said."""
    line = (text or "").lower()
    for spoken, written in JOINED:
        line = line.replace(spoken, written)
    words = re.findall(r"[a-z0-9]+(?:['’][a-z]+)*", _GLUED.sub(lambda m: f"{_PREFIXES[m[1]]} {m[2]}", line))
    for i, word in enumerate(words):
        code = airline_of(word)
        if code is None:
            continue
        tail = ""
        for said, following in zip(words[i + 1 : i + 5], [*words[i + 2 : i + 6], None, None, None, None], strict=False):
            piece = _code_digit(said, following)
            if piece is None or following in ("thousand", "point"):
                break
            tail += piece
        if tail or code == word.upper():
            return code + tail
    return None


def callsign(text: Column) -> Column:
    @F.pandas_udf("string")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([callsign_of(t) for t in texts], dtype=object)

    return parsed(text)


_WHOLE = {w: str(n) for w, n in SMALL.items()} | {"zero": "0", "oh": "0"}
_UNIT = {w: n for w, n in _WHOLE.items() if len(n) == 1}
_POINT = r"(?:point|decimal|comma)"
_DRAUGHT = re.compile(
    rf"(?P<figures>\d+(?:[.,]\d+)?)(?= )|(?P<whole>(?:{_any(_UNIT)} )+|(?:{_any(w for w, n in _WHOLE.items() if len(n) > 1)} )(?:{_any(_UNIT)} )*)"
    rf"(?:{_POINT} (?P<part>(?:{_any(_UNIT)} (?!{_POINT} ))*))?"
)
_KEYWORD = re.compile(r"\b(dra[uf]ght|draft|(?<=max )drop|(?<=maximum )drop)\b", re.IGNORECASE)


def draughts_of(text: str | None) -> list[float]:
    """Metres said within ten tokens after the keyword, 0.5 to 30. A number starts with a figure or a number word; 'five decimal three, five
    decimal three' stops where the repeat begins; a separator before any digit means no number."""
    out = []
    for keyword in _KEYWORD.finditer(text or ""):
        tokens = [t.lower() for t in re.findall(r"\d+(?:[.,]\d+)?|[a-zA-Z]+", text[keyword.end() :])[:10]]
        line = " ".join(tokens) + " "
        first = next((k for k, t in enumerate(tokens) if t in _WHOLE or t[0].isdigit() or re.fullmatch(_POINT, t)), None)
        if first is None or re.fullmatch(_POINT, tokens[first]):
            continue
        m = _DRAUGHT.match(line, len(" ".join(tokens[:first])) + (first > 0))
        if m is None:
            continue
        if m["figures"]:
            value = float(m["figures"].replace(",", "."))
        else:
            join = lambda words: "".join(_WHOLE[w] for w in (words or "").split())
            value = float(join(m["whole"]) + ("." + join(m["part"]) if join(m["part"]) else ""))
        if 0.5 <= value <= 30:
            out.append(value)
    return out


def draughts(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([draughts_of(t) for t in texts])

    return parsed(text)


def code_of(flight: Column) -> Column:
    """The airline code of a designator, or null."""
    return F.nullif(F.upper(F.regexp_extract(flight, "^([A-Za-z]{2,4})(.*)$", 1)), F.lit(""))


def tail_of(flight: Column) -> Column:
    return F.when(flight.rlike("^[A-Za-z]{2}"), F.upper(F.trim(F.regexp_extract(flight, "^([A-Za-z]{2,4})(.*)$", 2))))


def digit_runs_of(text: str | None) -> list[str]:
    """The maximal runs of spoken digits and letters; a digit before 'thousand' or 'point' belongs to a number, ends the run and is left out."""
    words = re.findall("[a-z0-9]+", (text or "").lower())
    pieces = [None if following in ("thousand", "point") else _code_digit(said, following) for said, following in zip(words, [*words[1:], None], strict=False)]
    return ["".join(run) for known, run in groupby(pieces, key=lambda p: p is not None) if known]


def digit_runs(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([digit_runs_of(t) for t in texts])

    return parsed(text)


#: Pressures in hPa that a real QNH gives (J26), lowest and highest.
PRESSURES = (950, 1050)


def misheard_of(text: str | None) -> list[str]:
    """J26's candidates: what each 'QNH' would mean as 'KLM', in order, where the number after it can't be a pressure."""
    out = []
    for m in re.finditer(r"\bqnh\b", (text or "").lower()):
        found = callsign_of("klm " + text.lower()[m.end() :]) or ""
        digits = "".join(filter(str.isdigit, found[3:]))
        if found.startswith("KLM") and digits and not (len(digits) >= 3 and PRESSURES[0] <= int(digits[:4]) <= PRESSURES[1]):
            out.append(found)
    return out


def misheard(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([misheard_of(t) for t in texts])

    return parsed(text)


def airline_name(flight: Column) -> Column:
    """The first spoken name of more than three letters of the designator's code, capitalised; else the code; null without one."""
    code, names = F.nullif(F.upper(F.substring(flight, 1, 3)), F.lit("")), {}
    for said, short in AIRLINES.items():
        if len(said) > 3:
            names.setdefault(short, said.capitalize())
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[code], code)
