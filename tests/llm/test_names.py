import itertools
import random

import numpy as np

from sucrogas.functions.names import Vocabulary, assignment
from sucrogas.llm.names_link import index_keys, name_classes, variant_pairs, word_links
from sucrogas.llm.titles import gazetteer, title_profiles

PLACES = ["Monte Vererapó", "Ararimbora", "Porto Iricoara da Serra"]
NAMES = [
    "GOJEGULI INDÚSTRIA E COMÉRCIO DE GÁS EIRELI", "industria e comercio de gas gojegubio eireli", "GOJEGULI INDDUSTRIA E COMERCIO DE GAS EIRELI - FILIAL 02", "Gojgeuli Ind. e Com. de Gas",
    "JODULIMA LATICÍNIOS E BIOGÁS LTDA.", "jodulima l.b. ltda.", "Jodulima Laticínios e Biogás Ltda.",
    "PRAFAGRASA ENERGIA RENOVÁVEL S.A.", "Prafagrasa Energia R", None, "", "  ", "Ltda.",
]
TITLES = ["Biometano Monte Vererapó (Gojeguli)", "Jodulima Ararimbora", "JV Jodulima e Prafagrasa", "Jodulima + Gojeguli", "Projeto Ararimbora / Prafagrasa", "UPB Prafagra II", None]


#: Other companies, from which the common words can be learned.
OTHERS = [f"{''.join(random.Random(i * 31 + j).choices('bcdfglmnprstvz', k=5))}{i}x {line} {legal}" for j, line in enumerate(["Indústria e Comércio de Gás", "Laticínios e Biogás", "Energia Renovável", "Biometano"]) for i in range(12) for legal in ["Ltda.", "Eireli", "S.A."][i % 3 : i % 3 + 1]]


def run(spark, names, titles):
    n = spark.createDataFrame([(x,) for x in names], "name string")
    t = spark.createDataFrame([(x,) for x in titles], "name string")
    p = gazetteer(spark.createDataFrame([(x,) for x in PLACES], "m string"), "m")
    classes = name_classes(n, t, p)
    return {(r.name_a, r.name_b) for r in variant_pairs(classes).collect()}


def test_pairs_are_those_within_companies(spark):
    groups = [NAMES[0:4] + [TITLES[0]], NAMES[4:7] + [TITLES[1]], NAMES[7:9] + [TITLES[4], TITLES[5]]]
    want = {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}
    assert run(spark, NAMES + NAMES + OTHERS, TITLES) == want


def test_two_slips_are_found_whatever_the_frequency(spark):
    """A word that 200 names carry and variants of it with two slips that 60 names carry."""
    names = [f"Prafagrasana Energia {i}" for i in range(200)] + [f"Prafgraana Energia {i}" for i in range(60)] + ["Outracoisa Energia"]
    words = spark.createDataFrame([("prafagrasana",), ("prafgraana",), ("prfagraasana",), ("outracoisa",)], "word string")
    got = {(r.word, r.other) for r in word_links(words, (), 0).collect()}
    assert ("prafgraana", "prafagrasana") in got and ("prfagraasana", "prafagrasana") in got and not any("outracoisa" in p and p[0] != p[1] for p in got)
    classes = {r.name: r["class"] for r in name_classes(spark.createDataFrame([(n,) for n in names], "name string"), None, gazetteer(None, "")).collect()}
    assert len({classes[n] for n in names[:-1]}) == 1 and classes[names[-1]] not in {classes[n] for n in names[:-1]}


def test_equal_words_do_not_make_one_company(spark):
    apart = [["Vale Verde Bioenergia Ltda", "Vale Verde Bioenergia S.A.", "VALE VERDE BIOENERGIA"], ["Vale Verde Laticinios SA"], ["Santa Rosa Bioenergia", "SANTA ROSA"], ["Santa Cruz Laticinios"], ["GÁS VERDE S.A."], ["BIOMETANO VERDE PAULINIA S.A."], ["CRI GEO BIOGAS S.A."]]
    want = {tuple(sorted(p)) for g in apart for p in itertools.combinations(g, 2)}
    assert run(spark, [n for g in apart for n in g], []) == want


def test_empty(spark):
    assert run(spark, [], []) == set() and run(spark, [None], [None]) == set()


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (2, 4), (4, 4), (3, 5)):
        for _ in range(20):
            c = rng.random((n, m)).round(2).tolist()
            got = assignment(c)
            assert len(set(got)) == n
            assert abs(sum(c[i][j] for i, j in enumerate(got)) - min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))) < 1e-9


def test_alignment_permits_initials_and_abbreviations():
    v = Vocabulary({w: 100 for w in ("laticinios", "biogas", "energia", "renovavel")}, 5000)
    left = lambda a, b: v.align(v.profile(a), v.profile(b)).lighter
    assert left("Xalumi Latic. e Biog. Ltda", "Xalumi Laticínios e Biogás S.A.") == 0
    assert left("Xalumi L.B. Ltda", "Xalumi Laticínios e Biogás S.A.") == 0 == left("Xalumi LB Ltda", "Xalumi Laticínios e Biogás S.A.")
    assert left("Xalumi Ltda", "Xalumi Laticínios e Biogás S.A.") == 0
    assert left("Xalumi Energia Renovável", "Xalumi Laticínios e Biogás") > 3


def test_titles():
    v = Vocabulary({w: 100 for w in ("biometano", "energia", "destilaria", "bioenergia")}, 5000)
    p = gazetteer(None, "")
    texts = lambda t: [" ".join(u.text for u in x) for x in title_profiles(t, p, v)]
    assert texts("JV Jodulima e Prafagrasa") == ["jodulima", "prafagrasa"] == texts("Jodulima (with Prafagrasa)")
    assert texts("Jodulima Destilaria e Bioenergia plant 3") == ["jodulima destilaria bioenergia"]
    assert texts("Jodulima / Jodullima Energia") == ["jodulima jodulima energia"] or len(texts("Jodulima / Jodullima Energia")) == 1
    assert texts(None) == texts("") == texts("Ltda. (expansion)") == []


def test_long_words_meet_too(spark):
    rng = random.Random(8)
    slip = [lambda w, i: w[:i] + w[i + 1 :], lambda w, i: w[:i] + w[i] + w[i:], lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]]
    for n in (8, 38, 39, 40, 41, 42, 43, 60, 200):
        for _ in range(60):
            a = "".join(rng.choices("bcdfgaeiou", k=n))
            b = a
            for _ in range(rng.randint(1, 2)):
                b = rng.choice(slip)(b, rng.randrange(len(b) - 2))
            assert index_keys(a, a[:-2]) & index_keys(b, b[:-2]), (n, a, b)
            assert index_keys(a, a[:-2]) & index_keys(a[:-2], a[:-4])
    assert len(index_keys("ab" * 10_000, "ab" * 9_999)) < 1000
    words = spark.createDataFrame([("xy" * 10_000,), ("xy" * 9_999 + "x",), ("b" * 5_000,)], "word string")
    got = {(len(r.word), len(r.other)) for r in word_links(words, (), 0).collect() if r.word != r.other}
    assert got == {(20_000, 19_999), (19_999, 20_000)}
