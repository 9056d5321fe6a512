"""Free-text places resolved against a gazetteer."""

from __future__ import annotations

import re

from sucrogas.functions.names import damerau, deletes, letters, tokens

_NOISE = re.compile(r"\([^()]*\)|\bregi[aã]o d[eo]\b|\bmunic[ií]pio d[eo]\b|\bzona rural\b", re.I)
_STATE = re.compile(r"[\s]*[-/,][\s]*([A-Z]{2})\s*$")


class PlaceIndex:
    """Names of a gazetteer with their one-letter-deletion neighbourhood and their form with an initial."""

    def __init__(self, names: list[str]):
        self.names: set[str] = set()
        self.near: dict[str, list[str]] = {}
        self.initials: dict[str, list[str]] = {}
        self.longest = 0
        for n in sorted({" ".join(tokens(x)) for x in names if x}):
            if not n:
                continue
            self.names.add(n)
            for key in deletes(n, 1):
                self.near.setdefault(key, []).append(n)
            self.longest = max(self.longest, len(n))
            head, _, rest = n.partition(" ")
            if rest:
                self.initials.setdefault(f"{head[0]} {rest}", []).append(n)

    def resolve(self, text: str) -> str | None:
        """The one place a text stands for: equal, with an initial for its first word, or up to two errors away."""
        words = [letters(w) for w in tokens(text)]
        t = " ".join(words)
        if t in self.names:
            return t
        if t in self.initials:
            return self.initials[t][0] if len(self.initials[t]) == 1 else None
        if len(t) > self.longest + 1:  # too long to be a name with a letter more
            return None
        hits = {n for key in deletes(t, 1) for n in self.near.get(key, ()) if damerau(t, n, 2) <= 2}
        best = sorted((damerau(t, n, 2), n) for n in hits)
        if best and (len(best) == 1 or best[0][0] < best[1][0]):
            return best[0][1]
        return None


def places_of(text: str | None, index: PlaceIndex) -> list[str]:
    """All places of a location text: parts split at ";", without brackets, "region of" and a state code."""
    out = []
    for part in (text or "").split(";"):
        clean = _STATE.sub("", _NOISE.sub(" ", part).strip())
        hit = index.resolve(clean.strip()) if clean.strip() else None
        if hit and hit not in out:
            out.append(hit)
    return out


def state_of(text: str | None) -> str | None:
    """The state code at the end of a location text."""
    m = _STATE.search(_NOISE.sub(" ", text or "").strip())
    return m.group(1) if m else None
