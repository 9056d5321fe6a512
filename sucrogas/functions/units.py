"""Unit strings: tries of prefixes, roots and exponents, read by dynamic programming.

``parse_unit`` segments a unit string into prefixed, exponentiated roots.  All readings of a
string are kept with a cost; ``choose`` picks the cheapest one that the field's dimension
priors allow.  Values are exact fractions, so conversions do not depend on float rounding.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

# Dimension vectors: length, mass, time, temperature.
Dim = tuple[int, int, int, int]
NONE: Dim = (0, 0, 0, 0)
DAY = 86400


class Root(NamedTuple):
    dim: Dim
    factor: Fraction
    offset: Fraction
    kind: str
    prefixable: bool


class Reading(NamedTuple):
    """One way to read a unit: dimension, factor and offset to base units, kinds of the roots, cost."""

    dim: Dim
    factor: Fraction
    offset: Fraction
    kinds: tuple[str, ...]
    cost: float


def _q(x: str | int) -> Fraction:
    return Fraction(x)


# Unit roots as they are written (base units: m, kg, s, K).
_VOLUME: Dim = (3, 0, 0, 0)
_ENERGY: Dim = (2, 1, -2, 0)
_ROOTS: list[tuple[str, Dim, Fraction, Fraction, str, bool]] = []


def _root(names: str, dim: Dim, factor: Fraction, kind: str, prefixable: bool = False, offset: Fraction = Fraction(0)) -> None:
    for n in names.split("|"):
        _ROOTS.append((n, dim, factor, offset, kind, prefixable))


_root("m|metre|metres|meter|meters|metro|metros", (1, 0, 0, 0), _q(1), "length", True)
_root("quilômetros|quilômetro|quilometros|quilometro|kilometres|kilometers|quilómetros", (1, 0, 0, 0), _q(1000), "length")
_root("g|grama|gramas|gram|grams", (0, 1, 0, 0), _q("1/1000"), "mass", True)
_root("t|ton|tons|tonne|tonnes|tonelada|toneladas", (0, 1, 0, 0), _q(1000), "mass")
_root("L|l|litro|litros|litre|litres|liter|liters", _VOLUME, _q("1/1000"), "volume", True)
_root("s|seg|second|seconds|segundo|segundos", (0, 0, 1, 0), _q(1), "time")
_root("min|minute|minutes|minuto|minutos", (0, 0, 1, 0), _q(60), "time")
_root("h|hr|hrs|hour|hours|hora|horas", (0, 0, 1, 0), _q(3600), "time")
_root("d|day|days|dia|dias", (0, 0, 1, 0), _q(DAY), "time")
_root("wk|week|weeks|semana|semanas", (0, 0, 1, 0), _q(7 * DAY), "time")
_root("month|months|mo|mes|meses|mês", (0, 0, 1, 0), Fraction(365 * DAY, 12), "time")
_root("y|yr|year|years|annum|a|ano|anos", (0, 0, 1, 0), _q(365 * DAY), "time")
_root("W|watt|watts", (2, 1, -3, 0), _q(1), "power", True)
_root("We|W elétricos|W eletricos|watts elétricos", (2, 1, -3, 0), _q(1), "power", True)
_root("Wh", _ENERGY, _q(3600), "energy", True)
_root("J|joule|joules", _ENERGY, _q(1), "energy", True)
_root("cal|calorie|calorias", _ENERGY, _q("4184/1000"), "energy", True)
_root("K|kelvin|kelvins", (0, 0, 0, 1), _q(1), "temperature")
_root("°C|oC|ºC|deg C|degC|C|celsius|graus Celsius|graus C|degrees Celsius", (0, 0, 0, 1), _q(1), "temperature", offset=_q("273.15"))
_root("°F|oF|ºF|deg F|degF|F|fahrenheit|graus Fahrenheit|degrees Fahrenheit", (0, 0, 0, 1), _q("5/9"), "temperature", offset=_q("45967/180"))
_root("%|percent|per cent|pct|por cento|porcento", NONE, _q("1/100"), "share")
_root("‰|per mille|por mil|permille", NONE, _q("1/1000"), "share")
_root("ppm|ppmv|ppm v/v|ppm(v)", NONE, _q("1/1000000"), "share")
_root("fraction|frac.|frac|fração|fracao|(0-1)|0-1", NONE, _q(1), "share")
# Qualifiers say of what and change nothing.
_root("VS|SV|TS|ST|COD|DQO|CH4|CH₄|K2O|cane|cana|ethanol|etanol|biometano|biomethane|gas|gás|v/v|w/w|CaCO3|vs|sv|ch4|de", NONE, _q(1), "of")

# Decimal prefixes and the words and spellings for multiples.
_PREFIXES = {"k": (_q(1000), 0.1), "M": (_q(10**6), 0.1), "G": (_q(10**9), 0.3), "m": (_q("1/1000"), 0.1), "µ": (_q("1/1000000"), 0.1), "u": (_q("1/1000000"), 0.5), "c": (_q("1/100"), 0.4), "d": (_q("1/10"), 0.6), "mega": (_q(10**6), 0.1), "quilo": (_q(1000), 0.1), "kilo": (_q(1000), 0.1)}
_MULTIPLES = {
    "mil": 3, "thousand": 3, "k": 3, "thousands": 3, "milhares de": 3, "10^3": 3, "10³": 3, "1000": 3, "mi": 6, "million": 6, "millions": 6, "milhões de": 6, "milhões": 6,
    "milhoes de": 6, "milhão de": 6, "MM": 6, "M": 6, "10^6": 6, "10⁶": 6, "billion": 9, "bilhões de": 9,
}
_DIVIDERS = ("/", "per ", "por ", "p/", "a ")
_JOINS = " .·*×-"
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻₀₁₂₃₄₅₆₇₈₉", "0123456789-0123456789")


class Trie:
    """Words with payloads; ``walk`` gives every word that starts at a position."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, payload: object) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault(None, []).append(payload)

    def walk(self, text: str, i: int) -> list[tuple[int, object]]:
        node, out = self.root, []
        while i < len(text) and text[i] in node:
            node = node[text[i]]
            i += 1
            out += [(i, p) for p in node.get(None, ())]
        return out


def _tries() -> tuple[Trie, Trie, Trie]:
    prefixes, roots, multiples = Trie(), Trie(), Trie()
    for p, (f, cost) in _PREFIXES.items():
        prefixes.add(p, (f, cost))
        if p.swapcase() not in _PREFIXES:
            prefixes.add(p.swapcase(), (f, cost + 0.3))
    prefixes.add("M", (_PREFIXES["m"][0], 0.6))  # "MG/L" is typed for mg/L
    for n, dim, f, off, kind, pre in _ROOTS:
        payload = Root(dim, f, off, kind, pre)
        forms = {n: 0.0, n.lower(): 0.2, n.upper(): 0.3, n.capitalize(): 0.2}
        for form, cost in forms.items():
            if form == n or n.lower() != n.upper():
                roots.add(form, (payload, cost))
    for m, e in _MULTIPLES.items():
        multiples.add(m, Fraction(10) ** e)
        if m.upper() != m and len(m) > 1:
            multiples.add(m.upper(), Fraction(10) ** e)
    return prefixes, roots, multiples


_P, _R, _M = _tries()
_EXP = re.compile(r"\^?(-?\d)(?!\d|[.,]\d)")
_NUM = re.compile(r"\d+(?:\.\d+)?")


def _normal(text: str) -> str:
    return re.sub(r"\s+", " ", text.translate(_SUPER)).strip()


@lru_cache(maxsize=100_000)
def parse_unit(text: str) -> tuple[Reading, ...]:
    """All readings of a unit string of any length, cheapest first; empty if it is no unit.

    Dynamic programming over positions; a state is (in the denominator, dimension, factor,
    offset, kinds) and keeps its lowest cost.  A text that is no unit dies out after its first words.
    """
    s = _normal(text)
    states = _segment(s)
    return _readings(states[len(s)]) if s and len(states) > len(s) else ()


@lru_cache(maxsize=20_000)
def leading_units(text: str) -> tuple[tuple[str, tuple[Reading, ...]], ...]:
    """The units a text begins with, each ending at a word's end, the longest first, with their readings."""
    s = _normal(text)
    states = _segment(s)
    out = []
    for m in re.finditer(r"\S(?=\s|$)", s):
        unit = s[: m.end()].rstrip(".,)")
        if unit and len(states) > len(unit) and (got := _readings(states[len(unit)])):
            out.append((unit, got))
    return tuple(reversed(out))


def _readings(states: dict[tuple, float]) -> tuple[Reading, ...]:
    """The readings that end in these states."""
    best: dict[tuple, float] = {}
    for (_, fresh, dim, f, off, kinds), cost in states.items():
        real = tuple(k for k in kinds if k not in ("*", "of"))
        if not fresh and real and (off == 0 or len(real) == 1):
            key = (dim, f, off, real)
            best[key] = min(cost, best.get(key, 99.0))
    return tuple(sorted((Reading(*k, c) for k, c in best.items()), key=lambda r: (r.cost, r.dim, r.factor)))


def _segment(s: str) -> list[dict[tuple, float]]:
    """The states at every position that can be reached; the list ends where no state is left."""
    states: list[dict[tuple, float]] = [{}]
    states[0][(False, False, NONE, Fraction(1), Fraction(0), ())] = 0.0

    def put(i: int, state: tuple, cost: float) -> None:
        while len(states) <= i:
            states.append({})
        if cost < states[i].get(state, 99.0):
            states[i][state] = cost

    for i in range(len(s)):
        if i >= len(states):
            break
        for (below, fresh, dim, f, off, kinds), cost in list(states[i].items()):
            if s[i] in _JOINS:
                put(i + 1, (below, fresh, dim, f, off, kinds), cost + (0.0 if s[i] != "-" else 0.5))
            for word in _DIVIDERS:
                if s.startswith(word, i) and kinds and not fresh:
                    put(i + len(word), (True, True, dim, f, off, kinds), cost + (0.0 if word != "a " else 0.1))
            if not kinds:
                for j, factor in _M.walk(s, i):
                    put(j, (below, fresh, dim, f * factor, off, ("*", *kinds)), cost + (0.2 if s[i:j] != "M" else 0.9))
            if kinds == ("*",):
                for j, factor in _M.walk(s, i):
                    put(j, (below, fresh, dim, f * factor, off, kinds), cost + 0.2)
            if below and (m := _NUM.match(s, i)):
                put(m.end(), (below, False, dim, f / Fraction(m.group()), off, kinds), cost + 0.1)
            starts: list[tuple[int, Fraction, float, bool]] = [(i, Fraction(1), 0.0, False)]
            starts += [(j, p[0], p[1], True) for j, p in _P.walk(s, i)]
            starts += [(i + 1, Fraction(1), 0.05, False)] if s[i] in "NSn" else []  # normal and standard cubic metres, litres
            if s[i] in "Nn":
                starts += [(j, p[0], p[1] + 0.05, True) for j, p in _P.walk(s, i + 1)]
            for at, factor, extra, prefixed in starts:
                for j, (root, c) in _R.walk(s, at):
                    if prefixed and (not root.prefixable or factor >= 10**6 and root.kind not in ("power", "energy")) or at > i and not prefixed and root.kind not in ("length", "volume"):
                        continue
                    if prefixed and s[i] == "M" and factor < 1 and root.kind == "length":
                        continue  # "Mm3" is no cubic millimetre
                    boundary = j == len(s) or not (s[j].isalpha() and s[j - 1].isalpha()) or root.kind in ("volume", "length", "mass") and j - at == 1
                    ends = [(j, 1, 0.0)]
                    if m := _EXP.match(s, j):
                        ends.append((m.end(), int(m.group(1)), -0.1))
                    for end, power, bonus in ends:
                        if end == j and not boundary and root.kind not in ("volume",):
                            continue
                        if at > i and not prefixed and root.kind == "length" and power not in (3, -3):
                            continue
                        e = -power if below and power > 0 else power
                        r = Root(root.dim, root.factor * factor, root.offset, root.kind, False)
                        total = cost + 1.0 + c + extra + bonus - 0.2 * (j - at > 2)
                        if root.kind == "of":
                            put(end, (below, False, dim, f, off, (*kinds, "of")), total - 0.6)
                            continue
                        kind = "volume" if root.kind == "length" and power in (3, -3) else root.kind
                        grown = tuple(a + b * e for a, b in zip(dim, root.dim, strict=True))
                        put(end, (below, False, grown, f * r.factor**e, off + r.offset, (*kinds, kind)), total)
                        # "m3d": time written straight after a volume stands for "per".
                        if kind == "time" and not below and power == 1 and "volume" in kinds:
                            inverse = tuple(a - b for a, b in zip(dim, root.dim, strict=True))
                            put(end, (below, False, inverse, f / r.factor, off, (*kinds, kind)), total + 0.4)
    return states


class Quantity(NamedTuple):
    """A quantity with its common unit: dimension, base units per common unit, offset and kinds for ratios."""

    unit: str
    dim: Dim
    factor: Fraction
    offset: Fraction
    ratio: str


# The common unit of each quantity.
QUANTITIES = {
    "gas flow": Quantity("m3/d", (3, 0, -1, 0), Fraction(1, DAY), Fraction(0), ""),
    "electric power": Quantity("kW", (2, 1, -3, 0), Fraction(1000), Fraction(0), ""),
    "concentration": Quantity("mg/L", (-3, 1, 0, 0), Fraction(1, 1000), Fraction(0), ""),
    "share": Quantity("%", NONE, Fraction(1, 100), Fraction(0), "share"),
    "methane yield": Quantity("L/kg", (3, -1, 0, 0), Fraction(1, 1000), Fraction(0), ""),
    "duration": Quantity("d", (0, 0, 1, 0), Fraction(DAY), Fraction(0), ""),
    "temperature": Quantity("degC", (0, 0, 0, 1), Fraction(1), Fraction("273.15"), ""),
    "mass per tonne of cane": Quantity("kg/t", NONE, Fraction(1, 1000), Fraction(0), "mass"),
    "energy per gas volume": Quantity("kWh/m3", (-1, 1, -2, 0), Fraction(3600000), Fraction(0), ""),
    "organic load": Quantity("kg/m3/d", (-3, 1, -1, 0), Fraction(1, DAY), Fraction(0), ""),
    "volume per ethanol": Quantity("L/L", NONE, Fraction(1), Fraction(0), "volume"),
    "distance": Quantity("km", (1, 0, 0, 0), Fraction(1000), Fraction(0), ""),
}
# Which words in a field's name speak for which quantity, first match wins.
PRIORS: list[tuple[str, str]] = [
    (r"biomethane capacity", "gas flow"),
    (r"methane yield|bmp", "methane yield"),
    (r"electricity|heating value|energy", "energy per gas volume"),
    (r"organic load", "organic load"),
    (r"removal|share|total solids|sulphide|removed", "share"),
    (r"stillage generation|vinasse generation", "volume per ethanol"),
    (r"generation", "mass per tonne of cane"),
    (r"temperature", "temperature"),
    (r"retention|restart|duration|time", "duration"),
    (r"distance|haul", "distance"),
    (r"cod|sulphate|potassium|alkalinity|inhibition|concentration", "concentration"),
]


def prior_of(field: str | None) -> str | None:
    """The quantity a field name speaks for."""
    low = (field or "").lower()
    return next((q for pattern, q in PRIORS if re.search(pattern, low)), None)


def choose(text: str, allowed: tuple[str, ...]) -> tuple[str, Reading] | None:
    """The cheapest reading of a unit with the dimension of an allowed quantity; quantities earlier in
    ``allowed`` are preferred by a small cost, ratios by the kinds they are made of by a larger one."""
    return choose_reading(parse_unit(text), allowed)


def choose_reading(readings: tuple[Reading, ...], allowed: tuple[str, ...]) -> tuple[str, Reading] | None:
    """``choose`` for readings that are there already."""
    best: tuple[float, str, Reading] | None = None
    for r in readings:
        for i, name in enumerate(allowed):
            q = QUANTITIES[name]
            if r.dim != q.dim:
                continue
            cost = r.cost + 0.01 * i + (0.5 if q.ratio and q.ratio not in r.kinds else 0.0)
            if best is None or cost < best[0]:
                best = (cost, name, r)
    return best and best[1:]


def convert(value: Fraction, reading: Reading, quantity: str) -> Fraction:
    """The value in the common unit of its quantity."""
    q = QUANTITIES[quantity]
    return (value * reading.factor + reading.offset - q.offset) / q.factor


_NUMBER = re.compile(r"[-+−]?\d{1,3}(?:[   ]\d{3})+(?:[.,]\d+)?(?!\d)|[-+−]?\d+(?:[.,]\d+)*")
_ABOUT = re.compile(r"^\s*(?:~|≈|∼|±|ca\.?|circa|cerca de|approx\.?|about|aprox\.?|around|c\.)\s*", re.I)


def number(token: str, language: str | None = None) -> Fraction | None:
    """The value of a number token.

    Two kinds of separators: the last is the decimal one.  One kind more than once: it groups.
    Once: it groups when the language's grouping sign stands before exactly three digits
    (Portuguese "." and English ","), and is decimal otherwise.  A space groups.
    """
    t = re.sub(r"[   ]", "", token).replace("−", "-").lstrip("+")
    marks = [c for c in t if c in ".,"]
    if len(set(marks)) == 2:
        last = marks[-1]
        group = "," if last == "." else "."
        if t.count(last) > 1:
            return None
        t = t.replace(group, "").replace(last, ".")
    elif len(marks) > 1:
        if not re.fullmatch(r"-?\d{1,3}(?:[.,]\d{3})+", t):
            return None
        t = t.replace(marks[0], "")
    elif marks:
        groups = {"pt": ".", "en": ","}.get(language or "")
        t = t.replace(marks[0], "" if marks[0] == groups and re.fullmatch(r"-?[1-9]\d{0,2}[.,]\d{3}", t) else ".")
    return Fraction(t) if re.fullmatch(r"-?\d+(?:\.\d+)?", t) else None


def single_value(text: str | None) -> tuple[Fraction, str] | None:
    """The one number of a reading and the unit text behind it; None for no number, two numbers or a range."""
    if not text:
        return None
    s = _ABOUT.sub("", text)
    m = re.match(r"\s*(" + _NUMBER.pattern + r")", s)
    if not m:
        return None
    value, rest = number(m.group(1)), s[m.end() :].strip()
    if value is None or re.match(r"(?:/|-|–|—|a\b|to\b|até\b|±|\+/-|e\b|and\b|ou\b|or\b|;|x|\()\s*[~≈]?\s*\d", rest) and not re.match(r"\(0\s*-\s*1\)", rest):
        return None
    return value, rest


_STATED = re.compile(r"(?:values? (?:are )?in|given in|stated in|reported in|reports|heading gives|unidade:?|unit:?|valor(?:es)? em|informado em|em|in|gives)\s+(.+)$", re.I)


def stated_unit(text: str | None, allowed: tuple[str, ...]) -> tuple[str, Reading] | None:
    """A unit named in a text without a number of its own: after a phrase such as "values in", in
    brackets, after a comma, or as the whole text.  A unit behind a number is a figure of its own and
    does not count.  The text is read clause by clause; of several candidates the longest wins."""
    if not text:
        return None
    best: tuple[int, str, Reading] | None = None
    for clause in re.split(r"\s*;\s*", text):
        spans = [clause]
        if m := _STATED.search(clause):
            spans.append(m.group(1))
        spans += re.findall(r"\(([^()]*)\)\s*$", clause) + ["(" + x + ")" for x in re.findall(r"\(([^()]*)\)\s*\)?$", clause)]
        spans += [clause[m.end() :] for m in re.finditer(r",\s*", clause)]
        for span in spans:
            hit = choose(span.strip().rstrip("."), allowed)
            if hit and (best is None or len(span) > best[0]):
                best = (len(span), *hit)
    return best and best[1:]


# Frequent short words of either language and the calendar and number words that stand beside quantities.
_PT = frozenset("de do da dos das em no na nos nas para por com sem que se um uma os as ao pelo pela até sobre é são foi será entre cada total valor capacidade projeto dia dias mês meses ano anos hora horas mil milhão milhões milhares informado produzir produção não mais ou e".split())
_EN = frozenset("of the in on at to for by with from per and or is are was will an each total value capacity project plant day days month months year years hour hours thousand million millions stated sized nameplate produce production not more about up".split())
_WORD = re.compile(r"[^\W\d_]+")


def language(clause: str) -> str | None:
    """Notation of a phrase by its words; "³" speaks for Portuguese where words do not decide."""
    words = [w.lower() for w in _WORD.findall(clause)]
    pt, en = sum(w in _PT for w in words), sum(w in _EN for w in words)
    if pt != en:
        return "pt" if pt > en else "en"
    return "pt" if "³" in clause else "en" if "m3" in clause else None


def phrase_value(text: str | None, allowed: tuple[str, ...]) -> tuple[Fraction, str, Reading] | None:
    """A number with a unit of an allowed quantity inside a phrase, in the notation of the phrase's language."""
    if not text:
        return None
    for clause in re.split(r"\s*;\s*", text):
        for m in _NUMBER.finditer(clause):
            if m.start() and (clause[m.start() - 1].isalnum() or clause[m.start() - 1] in ".,^"):
                continue
            for _, readings in leading_units(clause[m.end() :]):
                hit = choose_reading(readings, allowed)
                if hit:
                    value = number(m.group(), language(clause))
                    if value is not None:
                        return (value, *hit)
                    break
    return None
