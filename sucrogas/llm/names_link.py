"""Variant spellings of names: a symmetric-delete index on tokens, token alignment, classes of names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sucrogas.functions.names import deletes, tokens, vocabulary, write
from sucrogas.llm.titles import Places, title_profiles, title_tokens
from sucrogas.operators.vocabulary import Counts, learn
from sucrogas.session import ensure_checkpoint_dir

#: Least likeness of two own words whose names are compared.
MIN_LIKENESS = 0.6
MAX_ROUNDS = 20


def tokenised(names: DataFrame, titles: DataFrame | None, places: Places) -> DataFrame:
    """One row per distinct non-empty string with its tokens (titles without places and project words).

    ``names`` and ``titles`` have one column ``name``.  A string found in both is read as a name.  Returns ``name``, ``kind`` (0 name, 1 title), ``words``.
    """
    tagged = names.select("name", F.lit(0).alias("kind"))
    if titles is not None:
        tagged = tagged.unionByName(titles.select("name", F.lit(1).alias("kind")))
    distinct = tagged.where(F.col("name").isNotNull() & (F.trim("name") != "")).groupBy("name").agg(F.min("kind").alias("kind"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["words"] = [tokens(n) if k == 0 else title_tokens(n, places) for n, k in zip(b.name, b.kind, strict=True)]
            yield b

    return distinct.mapInPandas(run, "name string, kind int, words array<string>")


def profiled(strings: DataFrame, common: Counts, total: int, places: Places) -> DataFrame:
    """The profile of every string, two for a title that names two companies.

    Returns ``name``, ``profile``, ``parts`` (companies named), ``letters`` (of its common words, how much it states).  Strings
    without any word ("Ltda.") give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(common, total)
        for b in batches:
            rows = []
            for name, kind in zip(b.name, b.kind, strict=True):
                found = [words.profile(name)] if kind == 0 else title_profiles(name, places, words)
                rows += [(name, write(p), len(found), sum(len(u.text) for u in p if u.common)) for p in found if p]
            yield pd.DataFrame(rows, columns=["name", "profile", "parts", "letters"])

    return strings.mapInPandas(run, "name string, profile string, parts int, letters int")


#: Words up to so many letters are indexed by their delete neighbourhood, longer ones by their parts.
LONG_WORD = 40
#: Parts of a long word: two slips (a letter turned round may touch two parts) leave at least one of them whole.
PARTS = 5


def index_keys(word: str, stem: str) -> set[str]:
    """Keys of which two words share one if they are up to two slips apart or one is the other shortened.

    Short words: all forms with up to two letters left out, and the stem's with up to one.  A long word has thousands of those, so it is cut into ``PARTS`` parts; its keys are
    the pieces of its text that would be a part of a word up to two letters shorter or longer, up to two places away.  Words near the limit have both.
    """
    keys: set[str] = set()
    if len(word) <= LONG_WORD + 2:
        keys = {k for k in deletes(word, 2) | deletes(stem, 1) if len(k) >= 4}
    for text in {word, stem} if len(word) >= LONG_WORD - 2 else ():
        for length in range(len(text) - 3, len(text) + 4):
            edges = [length * i // PARTS for i in range(PARTS + 1)]
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                keys |= {f"{length}.{i}.{text[a + d : b + d]}" for d in range(-2, 3) if a + d >= 0 and b + d <= len(text)}
    return keys


def word_links(keyed: DataFrame, common: Counts, total: int) -> DataFrame:
    """Pairs (both ways, and each with itself) of key words that are variants of each other: ``word``, ``other``.

    The symmetric-delete neighbourhoods (``index_keys``: up to two letters left out of the word, one of its stem) are joined on equality, so words up
    to two errors apart, shortened words and words with another ending meet without comparing all pairs; how often a
    word occurs plays no part.  Candidates are verified by distance.
    """
    words = keyed.select("word").distinct()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(common, total)
        for b in batches:
            out = [(w, k) for w in b.word for k in index_keys(w, v.stem(w)[0])]
            yield pd.DataFrame(out, columns=["word", "key"])

    index = words.mapInPandas(keys, "word string, key string")
    near = index.join(index.select(F.col("word").alias("other"), "key"), "key").where("word < other").select("word", "other").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(common, total)
        for b in batches:
            yield b[[v.own_likeness(x, y) >= MIN_LIKENESS for x, y in zip(b.word, b.other, strict=True)]]

    good = near.mapInPandas(verify, "word string, other string")
    return good.unionByName(good.select(F.col("other").alias("word"), F.col("word").alias("other"))).unionByName(words.select("word", F.col("word").alias("other")))


def profile_links(profiles: DataFrame, common: Counts, total: int) -> DataFrame:
    """For each profile the fuller profile it is a variant of, if any: ``profile``, ``parent``.

    ``profiles``: ``profile``, ``letters``, ``freq``.  Profiles meet if own words of theirs are variants of each other (profiles of common words
    only: their weightiest word); every pair that meets is aligned word by word, also where the own words are equal.  The parent is the best scored
    among the profiles with larger (letters, frequency, text), so a short form belongs to one fuller form and links form a forest.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(common, total)
        for b in batches:
            out = []
            for p, n, f in zip(b.profile, b.letters, b.freq, strict=True):
                units = v.read(p)
                own = {u.text for u in units if not u.common} or {max(units, key=lambda u: (u.weight, u.text)).text}
                out += [(p, n, f, w) for w in own]
            yield pd.DataFrame(out, columns=["profile", "letters", "freq", "word"])

    keyed = profiles.mapInPandas(keys, "profile string, letters int, freq long, word string").checkpoint()
    near = word_links(keyed, common, total)
    a = keyed.select("word", F.struct("letters", "freq", "profile").alias("a"))
    b = keyed.select(F.col("word").alias("other"), F.struct("letters", "freq", "profile").alias("b"))
    # Distinct profiles of one company are few whatever its rows: spellings of common words are already one word here.
    pairs = a.join(near, "word").join(b, "other").where("b > a").select("a", "b").distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(common, total)
        for p in batches:
            p["score"] = [v.score(v.read(x), v.read(y)) for x, y in zip(p.x, p.y, strict=True)]
            yield p[p.score > 0]

    flat = pairs.select(F.col("a.profile").alias("x"), F.col("b.profile").alias("y"), F.col("b.letters").alias("letters"), F.col("b.freq").alias("freq"))
    good = flat.mapInPandas(score, "x string, y string, letters int, freq long, score double")
    return good.groupBy(F.col("x").alias("profile")).agg(F.max_by("y", F.struct("score", "letters", "freq", "y")).alias("parent"))


def roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Profiles with the root of their tree of links, by pointer doubling.

    Every round replaces each parent by its parent's parent, so the depth halves; the lineage is cut by
    ``checkpoint()`` in the shared folder.  Returns ``profile``, ``root``.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    state = nodes.select("profile").join(links, "profile", "left").select("profile", F.coalesce("parent", "profile").alias("root")).checkpoint()
    for _ in range(MAX_ROUNDS):
        up = state.where(F.col("profile") != F.col("root")).select(F.col("profile").alias("root"), F.col("root").alias("next"))
        moved = state.join(up, "root", "left")
        state = moved.select("profile", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        if state.where("moved").isEmpty():
            return state.select("profile", "root")
        state = state.select("profile", "root")
    raise RuntimeError("the links are deeper than 2 ** MAX_ROUNDS")


def name_classes(names: DataFrame, titles: DataFrame | None, places: Places) -> DataFrame:
    """Classes of spellings: ``name``, ``class``, ``parts``.

    ``names``: company names, ``titles``: project titles that may hold a place and other words, both with one column ``name``.  One row per
    distinct string and company it names; ``parts`` is 2 or more for titles that name several.  NULL, blank strings and strings without a
    word of their own or a common one ("Ltda.") name none and have no row.  A class is called by the profile at its root.
    """
    ensure_checkpoint_dir(names.sparkSession)
    strings = tokenised(names, titles, places).checkpoint()
    common, total = learn(strings, "name", "words")
    parsed = profiled(strings, common, total, places).checkpoint()
    profiles = parsed.groupBy("profile").agg(F.max("letters").alias("letters"), F.sum((F.col("parts") == 1).cast("long")).alias("freq"))
    root = roots(profiles, profile_links(profiles, common, total))
    return parsed.join(root, "profile").select("name", F.col("root").alias("class"), "parts").distinct()


def variant_pairs(classes: DataFrame) -> DataFrame:
    """All pairs of different strings that name one company only, the same, the smaller first (by code point).

    The result is as large as it is by definition; a class is as large as a company has spellings,
    whatever the number of rows that carry them.
    """
    single = classes.where("parts = 1")
    a = single.select("class", F.col("name").alias("name_a"))
    b = single.select("class", F.col("name").alias("name_b"))
    return a.join(b, "class").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
