import random
from datetime import date, datetime

from sucrogas.functions.names import Vocabulary, damerau, same_company, write
from sucrogas.operators.history import company_numbers, delivered_history, empty_dimension, merge_versions, recomputed_history, scd2_merge, with_hash
from sucrogas.operators.vocabulary import learn, name_tokens


def test_versions(spark):
    a1, a2, b = "Gaducrolá Ltda.", "GADUCROLA GÁS E ENERGIA S.A.", "Paninini Açúcar e Álcool S.A."
    one = lambda m, cap, op, h=1: ("p", date(2024, m, 1), datetime(2024, 12, 1, h), cap, op, "x")
    rows = [one(1, 10.0, a1), one(2, 10.0004, a2), one(3, None, None), one(5, 12.0, a2), one(6, 99.0, b), one(6, 12.0, b, 2), one(7, 12.0, a1), one(8, 10.0, a1), one(8, 10.0, a1)]
    rows += [("q", date(2024, 1, 1), datetime(2024, 2, 1), None, None, "x"), (None, date(2024, 1, 1), datetime(2024, 2, 1), 1.0, "z", "x"), ("q", None, datetime(2024, 2, 1), 1.0, "z", "x")]
    df = spark.createDataFrame(rows, "plant string, date date, loaded timestamp, cap double, op string, version_no string")
    v = delivered_history(df, "plant", "date", "loaded", "cap", "op", 0.01)
    got = sorted((r.plant, str(r.valid_from), str(r.valid_to)) for r in v.collect())
    assert got == [
        ("p", "2024-01-01", "2024-04-30"), ("p", "2024-05-01", "2024-05-31"), ("p", "2024-06-01", "2024-06-30"), ("p", "2024-07-01", "2024-07-31"), ("p", "2024-08-01", "9999-12-31"), ("q", "2024-01-01", "9999-12-31")
    ]
    assert delivered_history(df.limit(0), "plant", "date", "loaded", "cap", "op", 0.01).collect() == []


def test_merge_closes_opens_and_keeps(spark):
    end = date(9999, 12, 31)
    cur = with_hash(spark.createDataFrame([("a", 1.0, date(2024, 1, 1), end), ("b", 2.0, date(2024, 1, 1), end), ("a", 0.5, date(2023, 1, 1), date(2023, 12, 31))], "k string, x double, valid_from date, valid_to date"), ["x"])
    up = spark.createDataFrame([("a", 3.0, date(2024, 5, 1)), ("a", 9.0, date(2024, 4, 1)), ("b", 2.0, date(2024, 5, 1)), ("c", None, date(2024, 5, 1)), (None, 1.0, date(2024, 5, 1))], "k string, x double, at date")
    got = sorted((r.k, r.x is None, r.x or 0.0, str(r.valid_from), str(r.valid_to)) for r in scd2_merge(cur, up, "k", ["x"], "at").collect())
    assert got == [
        ("a", False, 0.5, "2023-01-01", "2023-12-31"), ("a", False, 1.0, "2024-01-01", "2024-04-30"), ("a", False, 3.0, "2024-05-01", "9999-12-31"), ("b", False, 2.0, "2024-01-01", "9999-12-31"), ("c", True, 0.0, "2024-05-01", "9999-12-31")
    ]
    again = scd2_merge(scd2_merge(cur, up, "k", ["x"], "at"), up, "k", ["x"], "at")
    assert again.count() == 5


def test_deliveries_give_what_a_recomputation_gives(spark):
    """Late months, corrections, NULLs, copies and drifting capacities over four years of deliveries."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        cap, op = 10.0, rng.choice("ABC")
        for m in range(30):
            if rng.random() < 0.15:
                cap = rng.choice([10.0, 12.0, cap + 0.006])
            if rng.random() < 0.1:
                op = rng.choice("ABC")
            d = date(2020 + m // 12, m % 12 + 1, 1)
            for _ in range(1 + (rng.random() < 0.2)):
                loaded = datetime(d.year + rng.choice([0, 0, 1, 2]), rng.randint(1, 12), rng.randint(1, 28))
                row = (f"k{k}", d, loaded, None if rng.random() < 0.2 else cap + rng.choice([0, 0, 5]) * (rng.random() < 0.1), None if rng.random() < 0.2 else f"Fazenda{op * 3} {op * 4}")
                rows += [row] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "k string, d date, v timestamp, c double, o string")
    args = ("k", "d", "v", "c", "o", 0.01)
    key = lambda r: (r.k, str(r.valid_from), str(r.valid_to), r.capacity or 0, -1 if r.company is None else r.company)
    got, want = sorted(map(key, delivered_history(df, *args).collect())), sorted(map(key, recomputed_history(df, *args).collect()))
    assert got == want and len(want) > 150
    # The rule itself, in Python.
    valid = {}
    for k, d, v, c, o in rows:
        valid[k, d] = max(valid.get((k, d), (datetime.min, -1.0, "")), (v, -1.0 if c is None else c, o or ""))
    starts = set()
    for k in {k for k, _ in valid}:
        last_c = last_o = None
        for i, d in enumerate(sorted(d for kk, d in valid if kk == k)):
            _, c, o = valid[k, d]
            c, o = (None if c < 0 else c), o or None
            if i == 0 or c is not None and last_c is not None and abs(c - last_c) > 0.01 or o and last_o and o != last_o:
                starts.add((k, str(d)))
            last_c, last_o = c if c is not None else last_c, o or last_o
    assert {(r[0], r[1]) for r in got} == starts


def test_merge_leaves_untouched_history(spark):
    d = spark.createDataFrame([("a", date(2024, m, 1), datetime(2024, 12, 1), float(m // 4), 0) for m in range(1, 12)], "key string, date date, version timestamp, capacity double, company int")
    dim = merge_versions(empty_dimension(d, "key"), d, 0.01).checkpoint()
    late = spark.createDataFrame([("a", date(2024, 12, 1), datetime(2025, 1, 1), 9.0, 0), ("b", date(2024, 1, 1), datetime(2025, 1, 1), None, None), (None, date(2024, 1, 1), None, 1.0, 0)], "key string, date date, version timestamp, capacity double, company int")
    got = sorted((r.key, str(r.valid_from), str(r.valid_to), r.capacity) for r in merge_versions(dim, late, 0.01).collect())
    assert got == [("a", "2024-01-01", "2024-03-31", 0.0), ("a", "2024-04-01", "2024-07-31", 1.0), ("a", "2024-08-01", "2024-11-30", 2.0), ("a", "2024-12-01", "9999-12-31", 9.0), ("b", "2024-01-01", "9999-12-31", None)]
    assert sorted(map(str, merge_versions(dim, late.limit(0), 0.01).collect())) == sorted(map(str, dim.collect()))


def test_company_numbers(spark):
    df = spark.createDataFrame([("p", "Gaducrolá Ltda."), ("p", "GADUCROLA S.A."), ("p", "Paninini Ltda"), ("q", None), (None, "x"), ("q", "Paninini")], "k string, o string")
    got = {(r.key, r.name): r.company for r in company_numbers(df, "k", "o").collect()}
    assert got["p", "Gaducrolá Ltda."] == got["p", "GADUCROLA S.A."] != got["p", "Paninini Ltda"] and len(got) == 4


COMMON = "acucar alcool adubos ambientais ambiental biogas biometano bioenergia comercio ecoparque energia gas gestao industria laticinios renovavel residuos solucoes suinocultura".split()


def test_names():
    words = Vocabulary({w: 100 for w in COMMON}, 5000)
    same = [
        ("Gojeguli Indústria e Comércio de Gás Eireli", "industria e comercio de gas gojegubio eireli"), ("JODULIMA LATICÍNIOS E BIOGÁS LTDA.", "jodulima l.b. ltda."), ("CIMISEFU ECOPARUQE LIMITADA", "CIMISEPHU ECOPARQUE LTDA."),
        ("Fuzubala Biometano SPE Ltda.", "FUZUBA BIOMETANO SPE LTDA."), ("Brusega GestÃ£o de ResÃ\xadduos Ltda.", "BRUSEGA GESTÃO DE RESÍDUOS LTDA."), ("VWGROTEFI ECPARQUE S.A.", "Vugrotefi Ecoparque S.A."), ("Gobetrepa Energia Re", "GOBETREPA ENERGIA RENOVÁVEL LTDA."),
        ("Raizen", "Raízen Energia S/A"), ("Usina São José Ltda", "Sao Jose"), ("GÁS VERDE S.A.", "Gas Verde"), ("Biometano Sul Ltda.", "BIOMETANO SUL S.A."), ("CRI GEO BIOGAS S.A.", "Cri Geo Biogás"), ("Vale Verde AmbientalLtda", "VALE VERDE AMBIENTAL"),
    ]
    for a, b in same:
        assert same_company(a, b, words), (a, b)
    # Short and shared words: what is left over on both sides tells them apart.
    other = [
        ("Trituleto Suinocultura e Energia Ltda.", "Tridilebro Suinocultura e Energia Ltda."), ("Vale Verde Bioenergia Ltda", "Vale Verde Laticinios SA"), ("Santa Rosa Bioenergia", "Santa Cruz Laticinios"), ("Raizen Energia SA", "Raizen Biogas Ltda"),
        ("GÁS VERDE S.A.", "BIOMETANO VERDE PAULINIA S.A."), ("BIOMETANO SUL S.A.", "CRI GEO BIOGAS S.A."), ("Sao Jose Usina", "Sao Joao Usina"), ("Santa Rosa Energia", "Santa Rita Energia"), (None, "x"), ("Ltda.", "S.A."),
    ]
    for a, b in other:
        assert not same_company(a, b, words), (a, b)
    assert same_company("", "", words) and words.profile(None) == () and words.profile("Ltda.") == ()
    assert words.read(write(words.profile("Vale Verde Ambiental"))) == words.profile("Vale Verde Ambiental")


def test_common_words_are_learned(spark):
    rows = [(f"{chr(97 + i % 26)}{'xyzuvw'[i % 6]}mira{i} {w} Ltda",) for i, w in enumerate(["gas", "energia"] * 40)]
    names = spark.createDataFrame(rows, "n string").withColumn("w", name_tokens("n"))
    counts, total = learn(names, "n", "w")
    assert total == 80 and set(counts) == {("gas", 40), ("energia", 40), ("ltda", 80)}
    assert learn(names.limit(0), "n", "w") == ((), 0)


def test_long_texts_and_distances():
    words = Vocabulary({w: 100 for w in COMMON}, 5000)
    for t in ("a" * 20000, "e" * 3000 + "biogas", "biogas" * 2000, "x" * 100 + " " + "y " * 2000):
        assert words.score(words.profile(t), words.profile(t)) > 0
    assert not words.score(words.profile("xo yo " * 1500), words.profile("xo zo " * 1500))
    assert damerau("ab" * 10000, "ab" * 9999 + "a", 2) == 1 and damerau("ab" * 100, "ba" * 100, 1) == 2 and damerau("abcd", "badc", 2) == 2 and damerau("abc", "abd", 2, swap_cost=2) == 2

    def whole(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc", k=rng.choice([rng.randint(0, 8), 70]))) for _ in range(2))
        assert damerau(a, b, 3) == min(whole(a, b) if len(a) + len(b) < 40 else damerau(a, b, 3), 4)
    long = "".join(rng.choices("abcd", k=80))
    for _ in range(50):
        other = list(long)
        for _ in range(rng.randint(1, 3)):
            other[rng.randrange(80)] = "x"
        assert damerau(long, "".join(other), 2) == min(whole(long, "".join(other)), 3)
