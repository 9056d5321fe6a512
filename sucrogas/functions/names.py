"""Company names as people type them: repair, tokens, and comparison by the words that set a name apart.

Which words are common and which are a company's own is not listed here: a ``Vocabulary`` learns it from the
names of the data at hand.  Common words may be abbreviated, reduced to initials, misspelt, glued
to a neighbour or missing; a company's own word may carry a slip, lose its last syllable or end in the
beginning of a common word instead.  Everything is pure Python, cached by token, and is called from
Arrow-batched functions only.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

# Legal forms and additions of Brazilian company names, which never tell companies apart.
LEGAL = frozenset(
    """ltda ltd lt limitada sa sociedade anonima eireli spe me epp cia companhia grupo usina matriz filial outros
    recuperacao judicial""".split()
)
# Words that join others, in Portuguese and English.
CONNECTIVES = frozenset("e de do da dos das a o em and with of the ex".split())

_DIGITS = str.maketrans("013458", "oieasb")
_SA = re.compile(r"\bs\s*[./]?\s*a\b\.?|(?<=[a-z])s\.a\b\.?")
_TOKEN = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_PAIR = re.compile("[ÃÂ](.)", re.S)
_TAIL = re.compile(r"\d+$")
_ROMAN = re.compile(r"(?:x{1,2}|i{1,3}|iv|vi{0,3}|ix)$")


def _unpair(m: re.Match) -> str:
    second = m.group(1).encode("cp1252", "ignore") or (m.group(1).encode("latin-1") if ord(m.group(1)) < 256 else b"")
    if len(second) == 1 and 0x80 <= second[0] <= 0xBF:
        return (m.group(0)[0].encode("latin-1") + second).decode("utf-8")
    return m.group(0)


def repair(text: str) -> str:
    """Undo UTF-8 read as a single-byte code page, pair by pair; other text comes back unchanged."""
    return _PAIR.sub(_unpair, text) if "Ã" in text or "Â" in text else text


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def tokens(text: str | None) -> list[str]:
    """Folded word tokens; glued capitals are split, dotted legal forms joined, the formula of methane written out."""
    if not text:
        return []
    s = fold(_CAMEL.sub(" ", repair(text)).replace("ª", "a"))
    return _TOKEN.findall(_SA.sub(" sa ", s).replace("ch4", "metano"))


def damerau(a: str, b: str, limit: int, swap_cost: int = 1) -> int:
    """Restricted Damerau-Levenshtein distance, or ``limit + 1`` when it is larger.

    With a ``swap_cost`` of 2 another letter counts as two errors, so that up to 2 only slips remain:
    letters left out, doubled or turned round.
    """
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > limit:
        return limit + 1
    far = limit + 1
    # Only cells within ``limit`` of the diagonal can hold a small enough distance, so long words cost their length, not its square.
    prev2: list[int] = []
    prev = [j if j <= limit else far for j in range(lb + 1)]
    for i in range(1, la + 1):
        lo, hi = max(1, i - limit), min(lb, i + limit)
        cur = [far] * (lb + 1) if lb < 64 else _Row(far)
        cur[0] = i if i <= limit else far
        best = cur[0]
        for j in range(lo, hi + 1):
            c = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + swap_cost * (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, prev2[j - 2] + 1)
            cur[j] = c
            best = min(best, c)
        if best > limit:
            return far
        prev2, prev = prev, cur
    return min(prev[lb], far)


class _Row(dict):
    """The few cells of a long row near the diagonal; all others are far."""

    def __init__(self, far: int):
        super().__init__()
        self.far = far

    def __missing__(self, key: int) -> int:
        return self.far


def letters(token: str) -> str:
    """Digits typed for look-alike letters put back, unless the token is a number."""
    return token.translate(_DIGITS) if any(c.isalpha() for c in token) else token


def phonetic(token: str) -> str:
    """One spelling for letters that are exchanged when a name is typed by ear."""
    return letters(token).replace("ph", "f").replace("w", "v").replace("k", "c").replace("y", "i").replace("h", "")


def deletes(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out: the symmetric-delete neighbourhood."""
    out = {word}
    layer = {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def assignment(cost: list[list[float]]) -> list[int]:
    """The column for each row that minimises the total cost (Hungarian algorithm with potentials); rows <= columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _legal(t: str) -> bool:
    """Whether a token is a legal form, the beginning of a long one, or several written together."""
    if t in LEGAL or len(t) >= 5 and any(w.startswith(t) for w in LEGAL):
        return True
    return any(len(w) < len(t) and t.startswith(w) and _legal(t[len(w) :]) for w in LEGAL if len(w) > 2)


class Unit(NamedTuple):
    """A word of a name: its text, how much it says, and whether it is common (else the company's own)."""

    text: str
    weight: float
    common: bool


class Agreement(NamedTuple):
    """Two aligned names: likeness of the best pair of own words, weight left over on the lighter and on the heavier side, business words matched."""

    own: float
    lighter: float
    heavier: float
    shared: float


#: Weight of a word that is not common, and of a letter that stands for a word.
OWN_WEIGHT, LETTER_WEIGHT = 6.0, 0.4
#: Most weight that both names may have left over and still be one company's; with an unsure own word.
LEFT_OVER, LEFT_OVER_UNSURE = 1.6, 1.0
#: Own words less alike than this need a common word to agree as well.
UNSURE = 0.7
#: Names are aligned word by word up to so many words.
MOST_WORDS = 60
#: Shortest word that may carry a slip.
MIN_SLIP = 5


def _slips(word: str) -> int:
    return 2 if len(word) >= 9 else 1


_LAST_SYLLABLE = re.compile(r"[^aeiou]{0,2}[aeiou]$")


class Vocabulary:
    """The common words of a set of names, with the number of names that hold each.

    ``counts`` are the words found with many different companies (see ``operators.vocabulary.learn``), ``total`` the
    number of names.  An empty vocabulary is valid: then all words but legal forms are a company's own.
    """

    def __init__(self, counts: dict[str, int], total: int):
        self.words: dict[str, tuple[str, float]] = {}
        self.near: dict[str, list[str]] = {}
        self.starts: dict[str, list[str]] = {}
        self.begun: dict[str, set[str]] = {}
        self._units: dict[str, tuple[Unit, ...]] = {}
        self._like: dict[tuple[str, str], float] = {}
        self._profiles: dict[str, tuple[Unit, ...]] = {}
        self.longest = max(map(len, counts), default=0)
        for w in sorted(counts, key=lambda w: (-counts[w], w)):
            if w in CONNECTIVES or len(w) < 2 or any(c.isdigit() for c in w) or _legal(w):
                continue
            if any(self._known(w[:i]) and self._known(w[i:]) and (w[:i] in self.words or w[i:] in self.words) for i in range(1, len(w))):
                continue  # written together, read as its parts
            other = self._nearest(w)
            alias = other is not None and counts[other] >= 3 * counts[w]  # a frequent misspelling
            self.words[w] = self.words[other] if alias else (w, max(1.0, min(OWN_WEIGHT, math.log((total + 1) / counts[w]))))
            if len(w) >= MIN_SLIP:
                for key in deletes(w, _slips(w)) | deletes(phonetic(w), _slips(w)):
                    self.near.setdefault(key, []).append(w)
            if alias:
                continue
            for n in range(2, len(w)):
                self.starts.setdefault(w[:n], []).append(w)
                if n >= MIN_SLIP:
                    for key in deletes(w[:n], 1):
                        self.begun.setdefault(key, set()).add(w[:n])
        self.legal_near = {key: w for w in sorted(LEGAL) if len(w) >= 4 for key in deletes(w, 1)}
        self.glue = sorted({w for w in self.words if len(w) >= 3} | {w for w in LEGAL if len(w) >= 2} | {"de", "e", "em"}, key=lambda w: (-len(w), w))
        self.ends = {w[:3] for w, (canon, _) in self.words.items() if len(w) >= 3 and canon == w}

    def __reduce__(self):
        raise TypeError("send the counts, not the vocabulary")

    def _known(self, part: str) -> bool:
        return part in self.words and len(part) >= 3 or part in ("e", "de", "em") or len(part) >= 2 and part in LEGAL

    def _nearest(self, token: str) -> str | None:
        if not MIN_SLIP <= len(token) <= self.longest + 2:
            return None
        p = phonetic(token)
        near = {w for key in deletes(token, 2) | deletes(p, 2) for w in self.near.get(key, ())}
        scored = sorted((min(damerau(token, w, 2), damerau(p, phonetic(w), 2)), w) for w in near)
        return next((w for d, w in scored if d <= _slips(w) and d <= _slips(token)), None)

    def unit(self, text: str, common: bool) -> Unit:
        """A word with its weight: common ones by their frequency, beginnings and letters less, own words by their length up to four letters."""
        if not common:
            return Unit(text, OWN_WEIGHT * min(1.0, len(text) * len(text) / 16), False)
        if len(text) == 1:
            return Unit(text, LETTER_WEIGHT, True)
        if text in self.words:
            return Unit(text, self.words[text][1], True)
        if text in self.starts:
            return Unit(text, min(self.words[w][1] for w in self.starts[text]) * min(1.0, len(text) / 4), True)
        return Unit(text, 2.0, True)

    def units(self, token: str) -> tuple[Unit, ...]:
        """The words a token stands for: none for legal forms, connectives and numbers, several for a glued token."""
        got = self._units.get(token)
        if got is None:
            if len(self._units) > 500_000:
                self._units.clear()
            got = self._units[token] = self._read(token)
        return got

    def _read(self, token: str) -> tuple[Unit, ...]:
        if token in CONNECTIVES or token.isdigit() or len(token) > 1 and _ROMAN.match(token):
            return ()
        if len(token) == 1:
            return (self.unit(token, True),)
        t = letters(token)
        t = _TAIL.sub("", token) if _TAIL.search(token) and len(_TAIL.sub("", token)) >= 4 else t
        if _legal(t):
            return ()
        if t in self.words:
            return (self.unit(self.words[t][0], True),)
        if 4 <= len(t) <= 14:
            w = next((self.legal_near[k] for k in sorted(deletes(t, 1)) if k in self.legal_near), None)
            if w and damerau(t, w, 1) <= 1:
                return ()
        near = self._nearest(t)
        if near:
            return (self.unit(self.words[near][0], True),)
        t = t if t in self.starts else phonetic(t) if phonetic(t) in self.starts else t
        if t in self.starts:
            return (self.unit(t, True),)
        if 7 <= len(t) <= self.longest + 1 and any(damerau(t, s, 1) <= 1 for key in deletes(t, 1) for s in self.begun.get(key, ())):
            return (self.unit(t, True),)
        parts = self._segment(t)
        if parts:
            return tuple(u for w in parts for u in (self.units(w) if w != t else ()))
        own, glued = self._unglue(t)
        return (self.unit(phonetic(own), False), *(u for w in glued for u in self.units(w)))

    def _segment(self, t: str) -> list[str] | None:
        """A glued token cut into common words, legal forms and connectives; the last may be unfinished or misspelt."""
        # Per position the word that ends there, and whether a word of more than two letters is among those before.
        ways: list[tuple[str, bool] | None] = [("", False)] + [None] * len(t)
        for i in range(len(t)):
            if ways[i] is None:
                continue
            for w in self.glue:
                if ways[min(i + len(w), len(t))] is None and (len(w) > 2 or i > 0 or w in ("e", "de")) and t.startswith(w, i):
                    ways[i + len(w)] = (w, ways[i][1] or len(w) > 2)
            left = len(t) - i
            if i and left <= self.longest + 2 and ways[len(t)] is None:
                rest = t[i:]
                if left >= 3 and rest in self.starts and ways[i][1] or left >= 6 and self._nearest(rest):
                    ways[len(t)] = (rest, True)
        out, at = [], len(t)
        while at and ways[at]:
            out.append(ways[at][0])
            at -= len(ways[at][0])
        return out[::-1] if ways[len(t)] else None

    def _unglue(self, t: str) -> tuple[str, list[str]]:
        """A word freed from common words of five letters or legal forms written directly before or after it."""
        found: list[str] = []
        again = True
        while again:
            again = False
            for w in self.glue:
                if len(t) - len(w) < MIN_SLIP or len(w) < 5 and w not in ("ltda", "spe"):
                    continue
                if t.endswith(w) or t.startswith(w) and w not in ("ltda", "spe"):
                    t = t[: -len(w)] if t.endswith(w) else t[len(w) :]
                    found.append(w)
                    again = True
                    break
        return t, found

    def profile(self, words: str | list[str] | None) -> tuple[Unit, ...]:
        """The words of a name (or of a list of tokens) in order; empty for NULL, blank and purely legal texts."""
        if isinstance(words, str):
            got = self._profiles.get(words)
            if got is None:
                if len(self._profiles) > 200_000:
                    self._profiles.clear()
                got = self._profiles[words] = self.profile(tokens(words))
            return got
        return tuple(u for w in words or () for u in self.units(w))

    def read(self, written: str) -> tuple[Unit, ...]:
        """The profile that ``write`` gave."""
        got = self._profiles.get("=" + written)
        if got is None:
            got = self._profiles["=" + written] = tuple(self.unit(w.removeprefix("="), not w.startswith("=")) for w in written.split())
        return got

    def stem(self, word: str) -> tuple[str, bool]:
        """A word without its last syllable or without the beginning of a common word in that place, and whether it had the latter."""
        if word[-3:] in self.ends and len(word) >= 7:
            return word[:-3], True
        cut = _LAST_SYLLABLE.sub("", word)
        return (cut if len(cut) >= 4 else word), False

    def own_likeness(self, a: str, b: str) -> float:
        """How surely two own words are one: 1 equal, 0.9 one slip, 0.8 shortened, 0.7 both, 0.6 two slips, 0 different."""
        if a == b:
            return 1.0
        key = (a, b) if a < b else (b, a)
        got = self._like.get(key)
        if got is None:
            if len(self._like) > 500_000:
                self._like.clear()
            got = self._like[key] = self._own_likeness(*key)
        return got

    def _own_likeness(self, a: str, b: str) -> float:
        low = min(len(a), len(b))
        if low >= MIN_SLIP and damerau(a, b, 1) <= 1:
            return 0.9
        (sa, na), (sb, nb) = self.stem(a), self.stem(b)
        if min(len(sa), len(sb)) >= 4 and (a == sb or b == sa or (na or nb) and sa == sb):
            return 0.8
        if low >= 8 and damerau(a, b, 2, swap_cost=2) <= 2:
            return 0.6
        for short, full in ((a, sb), (b, sa)):
            if min(len(short), len(full)) >= 6 and abs(len(short) - len(full)) <= 1 and damerau(short, full, 1) <= 1:
                return 0.7
        if na or nb:
            if min(len(sa), len(sb)) >= MIN_SLIP and damerau(sa, sb, 1) <= 1:
                return 0.7
            for nick, full in ((sa, b), (sb, a)):
                if nick not in (a, b) and len(nick) >= MIN_SLIP and any(0 < len(full) - n <= 3 and damerau(nick, full[:n], 1) <= 1 for n in range(len(nick) - 1, len(nick) + 2)):
                    return 0.6
        return 0.0

    def likeness(self, x: Unit, y: Unit) -> float:
        """Likeness of two words: equal 1, abbreviation 0.9, initial 0.8, letters of the word in order 0.7, a slip 0.9, else 0."""
        a, b = x.text, y.text
        if a == b:
            return 1.0
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not x.common and not y.common and (own := self.own_likeness(a, b)):
            return own
        if long.startswith(short) and (x.common or y.common or len(short) != 2):
            return 0.8 if len(short) == 1 else 0.9
        if len(short) == 1 or short[0] != long[0] and not (len(short) >= 6 and x.common and y.common):
            return 0.0
        if len(short) >= MIN_SLIP and (damerau(short, long, 2) <= _slips(short) or any(damerau(short, long[:n], 1) <= 1 for n in (len(short) - 1, len(short), len(short) + 1))):
            return 0.9
        return 0.7 if len(short) <= 5 and len(long) > len(short) and _within(short, long) else 0.0

    def align(self, a: tuple[Unit, ...], b: tuple[Unit, ...]) -> Agreement:
        """Optimal assignment of the words of two names.

        Initials and abbreviations may stand for words, and joined initials ("GR") for several.  Of texts of more than ``MOST_WORDS``
        words only equal words are matched, the others are left over.
        """
        if max(len(a), len(b)) > MOST_WORDS:
            return self._equal_words(a, b)
        a, b = self._spread(a, b), self._spread(b, a)
        if not a or not b:
            return Agreement(0.0, 0.0, sum(u.weight for u in a or b), 0.0)
        x, y = (a, b) if len(a) <= len(b) else (b, a)
        like = [[self.likeness(s, t) for t in y] for s in x]
        got = assignment([[-v * min(s.weight, t.weight) for v, t in zip(row, y, strict=True)] for row, s in zip(like, x, strict=True)])
        pairs = [(i, j) for i, j in enumerate(got) if j >= 0 and like[i][j] >= 0.6]
        mine, yours = {i for i, _ in pairs}, {j for _, j in pairs}
        own = max((self.own_likeness(x[i].text, y[j].text) for i, j in pairs if not x[i].common and not y[j].common), default=0.0)
        if not own and (all(u.common for u in x) or all(u.common for u in y)):
            # Without an own word on one side the word that says most has to agree, and nothing may be left on either side.
            top = max(range(len(x)), key=lambda i: x[i].weight)
            if len(pairs) == max(len(x), len(y)) and x[top].weight >= 2:
                own = min(like[i][j] for i, j in pairs)
        left = sorted((sum(u.weight for i, u in enumerate(x) if i not in mine), sum(u.weight for j, u in enumerate(y) if j not in yours)))
        return Agreement(own, left[0], left[1], sum(like[i][j] for i, j in pairs if x[i].common or y[j].common))

    def _equal_words(self, a: tuple[Unit, ...], b: tuple[Unit, ...]) -> Agreement:
        """The agreement of two long texts by their equal words."""
        x, y = Counter(a), Counter(b)
        both = x & y
        left = sorted(sum(u.weight * n for u, n in (side - both).items()) for side in (x, y))
        own = float(any(not u.common for u in both)) or float(bool(both) and not left[1])
        return Agreement(own, left[0], left[1], float(sum(n for u, n in both.items() if u.common)))

    def _spread(self, a: tuple[Unit, ...], b: tuple[Unit, ...]) -> tuple[Unit, ...]:
        """The words of ``a`` with joined initials put apart: short words that agree with no word of ``b`` but whose letters all begin one."""
        out: list[Unit] = []
        for u in a:
            initials = [c for c in u.text if c not in "ed"]
            joined = 1 < len(u.text) <= 4 and u.text not in self.words and not any(self.likeness(u, t) for t in b)
            begin = [any(t.text.startswith(c) for t in b) for c in initials]
            if joined and begin and (all(begin) or begin[0] and len(u.text) <= 3):
                out += [Unit(c, LETTER_WEIGHT, True) for c in initials]
            else:
                out.append(u)
        return tuple(out)

    def score(self, a: tuple[Unit, ...], b: tuple[Unit, ...]) -> float:
        """How surely two names are one company's, 0 if they are not: an own word must agree, and not both may have words left over."""
        m = self.align(a, b)
        if m.own < 0.6 or m.lighter > (LEFT_OVER if m.own >= 0.9 else LEFT_OVER_UNSURE) or m.own < UNSURE and m.shared < 0.7:
            return 0.0
        return m.own + 0.03 * min(m.shared, 3.0) - 0.01 * m.lighter


def write(profile: tuple[Unit, ...]) -> str:
    """A profile as a text: its words in order, own ones with a "=" before them."""
    return " ".join(u.text if u.common else "=" + u.text for u in profile)


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


@lru_cache(maxsize=4)
def vocabulary(counts: tuple[tuple[str, int], ...], total: int) -> Vocabulary:
    """A vocabulary from its counts, built once per process; the counts are what is sent to tasks."""
    return Vocabulary(dict(counts), total)


def same_company(a: str | None, b: str | None, words: Vocabulary) -> bool:
    """Whether two names are spellings of one company; NULL equals nothing, names without words only an equal name."""
    if a is None or b is None:
        return False
    return a == b or words.score(words.profile(a), words.profile(b)) > 0
