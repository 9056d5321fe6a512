"""Companies and places in project titles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sucrogas.functions.names import Unit, Vocabulary, tokens

#: A gazetteer is a table of official places; beyond this size it would not be one and must not be sent to every task.
MAX_PLACES = 100_000
# Words about a project, in Portuguese and English, and the mark of a joint venture.
PROJECT_WORDS = frozenset("projeto project upb jv plant expansion expansao unidade planta fase phase ex with".split())
_PARTNERS = re.compile(r"\s[+/&]\s|\(\s*(?:with|com)\b", re.I)
_BRACKETS = re.compile(r"[()]")


class Places:
    """A gazetteer of place names for removal from titles; its size is that of the place table, not of the data."""

    def __init__(self, names: list[str]):
        self.first: dict[str, list[tuple[str, ...]]] = {}
        for n in sorted({tuple(tokens(x)) for x in names if x}, key=lambda t: (-len(t), t)):
            if n:
                self.first.setdefault(n[0], []).append(n)

    def cut(self, words: list[str]) -> tuple[list[str], list[tuple[str, ...]]]:
        """The words without places, and the places."""
        out: list[str] = []
        found: list[tuple[str, ...]] = []
        i = 0
        while i < len(words):
            for name in self.first.get(words[i], ()):
                if tuple(words[i : i + len(name)]) == name:
                    found.append(name)
                    i += len(name)
                    break
            else:
                out.append(words[i])
                i += 1
        return out, found


def gazetteer(places: DataFrame | None, column: str) -> Places:
    """The place names as a lookup for tasks; its size is checked, because it is sent to all of them.

    Beyond ``MAX_PLACES`` distinct names a ValueError tells to pass a smaller table or none (titles
    are then parsed without taking places out).
    """
    if places is None:
        return Places([])
    names = [r[0] for r in places.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_PLACES + 1).collect()]
    if len(names) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} place names")
    return Places(names)


def title_tokens(title: str | None, places: Places) -> list[str]:
    """The tokens of a title without places and project words."""
    return [w for w in places.cut(tokens(title))[0] if w not in PROJECT_WORDS]


def title_profiles(title: str | None, places: Places, words: Vocabulary) -> list[tuple[Unit, ...]]:
    """The companies a title names, one profile each; none for NULL, blank and purely generic titles.

    A joint-venture mark ("+", "&", "/", "(with ...)"), or an "e" between two parts of own words only, separates two companies, if
    both parts hold an own word and these are no variants of each other.  Where a part in brackets names the company, parts
    about a place that hold only common words ("Biometano <place> (<company>)") are left out.
    """
    if not title:
        return []
    parts = [p for p in (title_tokens(x, places) for x in _PARTNERS.split(title)) if p]
    if len(parts) == 1 and "(" in title:
        cuts = [places.cut(tokens(x)) for x in _BRACKETS.split(title)]
        kept = [([w for w in ws if w not in PROJECT_WORDS], bool(found)) for ws, found in cuts]
        own = [any(not u.common for u in words.profile(ws)) for ws, _ in kept]
        if any(own):
            parts = [[w for (ws, at), o in zip(kept, own, strict=True) if o or not at for w in ws]]
    if len(parts) == 1 and "e" in parts[0]:
        i = parts[0].index("e")
        left, right = words.profile(parts[0][:i]), words.profile(parts[0][i + 1 :])
        if left and right and not any(u.common for u in left + right):
            return [left, right]
    profiles = [words.profile(p) for p in parts]
    own = [p for p in profiles if any(not u.common for u in p)]
    if len(own) >= 2 and not words.score(own[0], own[1]):
        return own
    whole = tuple(u for p in profiles for u in p)
    return [whole] if whole else []
