"""Operators against brute force and worked examples."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quercus.config import Config, check_parameters
from quercus.functions import text as T
from quercus.functions.contents import content_points, grouped_text, outline, trailing_heading
from quercus.functions.literature import Parser, learn_places, literature_entries, scan_authors, work_key
from quercus.operators import cluster as C
from quercus.operators import learn as L
from quercus.operators import pairs as P
from quercus.operators import quality as Q
from quercus.operators import sets as S
from quercus.operators import utilisation as U
from quercus.operators import vectors as V


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(expr.alias("x")).first()["x"]


def test_percentile_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, None])], "id int, v double")
    assert [r.p for r in P.percentile_rank(df, "v", "p").orderBy("id").collect()] == [0.25, 0.625, 0.625, 1.0, None]
    r = random.Random(3)
    values = [round(r.gauss(0, 1), 1) for _ in range(500)]
    got = P.percentile_rank(spark.createDataFrame(list(enumerate(values)), "id int, v double"), "v", "p").orderBy("id").collect()
    assert np.allclose([x.p for x in got], pd.Series(values).rank(pct=True))


def test_combine(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (None, None, None), (1.0, 0.0, 2.0)], "i double, k double, l double")
    got = [r.x for r in df.select(P.combine({"i": 0.45, "k": 0.35, "l": 0.2}).alias("x")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] is None and got[2] == pytest.approx(0.85)


def test_percentile_in(spark):
    v = F.array(*[F.lit(float(x)) for x in (0, 1, 1, 1, 4)])
    got = [r.x for r in spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (2.5,), (9.0,), (None,)], "z double").select(P.percentile_in(F.col("z"), v).alias("x")).collect()]
    assert got == [0.0, 0.0, 12.5, 50.0, 87.5, 100.0, None]


def test_zscore_constant(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id int, v double")
    assert [r.z for r in P.zscore(df, "v", "z").orderBy("id").collect()] == [0.0, 0.0, None]


def test_top_neighbours_and_queries(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, None)], "a int, b int, s double")
    got = {(r.a, r.rang): r.b for r in P.top_neighbours(df, "s", 1).collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 1}


def test_dice(spark):
    items = [("a", 1), ("a", 2), ("b", 2), ("c", 3), ("a", 1)]
    df = spark.createDataFrame(items, "e string, i int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "a string, b string")
    got = {(r.a, r.b): r.dice for r in S.idf_dice(pairs, df, "e", "i").collect()}
    rare = math.log(3) + 1
    common = math.log(3 / 2) + 1
    assert got["a", "b"] == pytest.approx(2 * common / (rare + 2 * common)) and got["a", "c"] == 0.0 and got["a", "d"] is None


def test_indel(spark):
    assert one(spark, T.indel_ratio(F.col("a"), F.col("b")), a="abc", b="abd") == pytest.approx(66.6667, abs=1e-3)
    assert one(spark, T.indel_ratio(F.col("a"), F.col("b")), a="ab", b="ba") == 50.0
    assert one(spark, T.indel_ratio(F.col("a"), F.col("b")), a="strategisches_management_einfuehrung", b="strategische_management_einf") == 87.5


def test_canonical(spark):
    keys = ["kuhn_einfuhrung_steuerlehre", "kuhn_einfuhrung_steuerlehren", "kuhn", "kuhm_einfuhrung_steuerlehre", None, "kuhn_einfuhrung_steuerlehre"]
    got = {r.key: r.kanon for r in S.canonical_keys(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()}
    assert got == {"kuhn_einfuhrung_steuerlehre": "kuhn_einfuhrung_steuerlehre", "kuhn_einfuhrung_steuerlehren": "kuhn_einfuhrung_steuerlehre", "kuhn": "kuhn", "kuhm_einfuhrung_steuerlehre": "kuhm_einfuhrung_steuerlehre"}
    assert S.canonical_keys(spark.createDataFrame([], "k string"), "k").count() == 0


def brute_link(n, sim, cap):
    active, members, merges = list(range(n)), {i: [i] for i in range(n)}, []
    while len(active) > 1:
        best = None
        for x, a in enumerate(active):
            for b in active[x + 1 :]:
                if cap and len(members[a]) + len(members[b]) > cap:
                    continue
                values = [sim[i, j] for i in members[a] for j in members[b]]
                m = sum(values) / len(values)
                if not math.isnan(m) and (best is None or m > best[0] + 1e-12):
                    best = (m, a, b)
        if best is None:
            break
        m, a, b = best
        c = n + len(merges)
        members[c] = members[a] + members[b]
        active = [x for x in active if x not in (a, b)] + [c]
        merges.append((a, b, m))
    return merges


@pytest.mark.parametrize("cap", [0, 2, 3, 5])
def test_linkage(cap):
    rng = np.random.default_rng(cap)
    m = rng.normal(size=(20, 20))
    m = (m + m.T) / 2
    m[3, 7] = m[7, 3] = np.nan
    got, want = C.link(20, m, cap), brute_link(20, m, cap)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    order = C.order_of(20, got, list(range(20)))
    assert sorted(order) == list(range(20)) and order[0] == 0


def test_linkage_example(spark):
    s = [[1, 0.9, 0.1, 0.1], [0.9, 1, 0.1, 0.1], [0.1, 0.1, 1, 0.8], [0.1, 0.1, 0.8, 1]]
    pairs = spark.createDataFrame([(i, j, s[i][j]) for i, j in itertools.combinations(range(4), 2)], "a int, b int, s double")
    linked = C.linkage(pairs, "s", (2, 0))
    merges = C.merges_of(linked)
    assert sorted(r.id for r in C.order_rows(linked).where("cap = 2").collect()) == [0, 1, 2, 3]
    got = [(r.cap, r.a, r.b, round(r.wert, 3)) for r in merges.orderBy("cap", "schritt").collect()]
    assert got == [(0, 0, 1, 0.9), (0, 2, 3, 0.8), (0, 4, 5, 0.1), (2, 0, 1, 0.9), (2, 2, 3, 0.8)]
    cut = {(r.cap, r.id): r.cluster for r in C.cut(merges, 4, 1).collect()}
    assert {cut[0, i] for i in range(4)} == {6} and {cut[2, i] for i in range(4)} == {4, 5}
    members = spark.createDataFrame([(i, 0) for i in range(4)], "id int, cluster int")
    tree = C.spanning_tree(C.inside_pairs(members, pairs), "cluster", "s").collect()
    assert sorted((r.a, r.b) for r in tree) == [(0, 1), (0, 2), (2, 3)]
    assert [r.nr for r in C.summary(members, pairs, "s").collect()] == [1]


def test_labels():
    assert C.tidy_labels([("supply", 3), ("geschäftsmodelle", 2), ("geschäftsmodellen", 2), ("supply chain", 2), ("chain", 2)]) == [("supply chain", 2), ("geschäftsmodelle", 2)]


def test_mix_and_totals(spark):
    m = spark.createDataFrame([(1, 9, "ACT"), (2, 9, "ACT"), (3, 9, "FIN")], "id int, cluster int, p string")
    assert C.mix(m, "p").first()["mischung"] == "ACT (2), FIN"
    r = C.totals(m, spark.createDataFrame([(1, 10), (2, 5)], "id int, n int"), "n").first()
    assert (r.summe, r.fehlend) == (15, 1)


def test_greedy(spark):
    rng = random.Random(5)
    c = [(0, 1, x, y, round(rng.random(), 3)) for x in range(9) for y in range(9)]
    got = [(r.x, r.y) for r in V.greedy_matches(spark.createDataFrame(c, "a int, b int, x int, y int, s double"), 3).orderBy("rang").collect()]
    want, xs, ys = [], set(), set()
    for _, _, x, y, s in sorted(c, key=lambda r: (-r[4], r[2], r[3])):
        if x not in xs and y not in ys and len(want) < 3:
            want.append((x, y))
            xs.add(x)
            ys.add(y)
    assert got == want


def test_embed_cache(spark):
    t = spark.createDataFrame([(1, "ab cd"), (2, "ab cd"), (3, None), (4, "xyz")], "id int, t string")
    first = V.embed_new(t.where("id < 3"), "id", "t", None)
    assert first.count() == 1 and V.embed_new(t, "id", "t", first).count() == 1
    assert sum(x * x for x in first.first()["vektor"]) == pytest.approx(1.0, abs=1e-5)


def test_utilisation(spark):
    cols = "code string, cap string, w1 string, s1 string, w2 string, s2 string"
    rows = [("A", "24", "12", " x ", "12.0", ""), ("A", "99", None, "", None, " "), (None, "5", "1", "1", "1", "1"), ("B", None, "X", "x", "Text", None)]
    got = {r.code: r for r in U.utilisation(spark.createDataFrame(rows, cols), "code", "cap", {"1": ["w1", "s1"], "2": ["w2", "s2"]}).collect()}
    a, b = got["A"], got["B"]
    assert (a.jahr_1, a.jahr_2, a.durchf, a.abgesagt, a.max_tn) == (12, 12, 2, 1, 24) and a.je_durchf == 12.0 and a.quote == 0.5
    assert (b.durchf, b.abgesagt, b.max_tn, b.je_durchf, b.quote) == (0, 2, None, None, None) and set(got) == {"A", "B"}
    assert one(spark, T.semesters(F.col("y")), y="23/24") == ["WiSe23/24", "SoSe24"]


def test_text_functions(spark):
    assert one(spark, T.clean_text(F.col("t")), t="•a\r\n –  b c \n\n-\nwider¬\nspruch[*]d­e") == "- a\n- b c\nwiderspruch\n- de"
    assert one(spark, T.sentences(F.col("t")), t="Er kam, z.B. Montag. Sie blieb bzw. Peter ging am 3. Mai. Ende!") == ["Er kam, z.B. Montag.", "Sie blieb bzw. Peter ging am 3. Mai.", "Ende!"]
    assert one(spark, T.comma_list(F.col("t")), t="Alpha, beta, Gamma") == ["Alpha, beta", "Gamma"]
    assert one(spark, T.reference_key(F.col("s"), F.col("t")), s="von Müller", t="Die Einführung in große Maße – Teil 2") == "muller_einfuhrung_grosse_masse"
    assert one(spark, T.top_share(F.col("p")), p=99.97) == "obere 0.1 %"
    assert one(spark, T.parse_matches(F.col("t")), t="[0.91] a ⟷ b || [-0.05] c ⟷ d") == [(0.91, "a", "b")]
    assert one(spark, T.cell_number(F.col("t")), t=" 2,5 ") == 2
    assert one(spark, T.clip(F.col("t"), 10), t="eins zwei drei") == "eins zwei …"


def test_dehyphenate(spark):
    known = spark.createDataFrame([("unternehmen",), ("unternehm",), ("nehmens",)], "wort string")
    t = spark.createDataFrame([(1, "Unter- nehmen und Wirtschafts- und Recht"), (2, None), (3, ""), (4, "Unter- nehm geht; Unter- nehmens bleibt")], "id int, t string")
    got = {r.id: r.t for r in L.dehyphenate(t, ["id"], "t", known).collect()}
    # a word is joined as a whole: what begins like a joined one stays
    assert got == {1: "Unternehmen und Wirtschafts- und Recht", 2: None, 3: "", 4: "Unternehm geht; Unter- nehmens bleibt"}


def test_openings(spark):
    rows = [(f"m{i}", f"Die Studierenden lernen {w}  kennen. Danach {w}. Die Studierenden erkennen und {w}. Sie können.") for i, w in enumerate(["Alpha", "Beta", "Gamma", "Delta"])]
    df = spark.createDataFrame([*rows, ("x", None), (None, "")], "m string, t string")
    phrases = L.opening_phrases(df, "m", "t", least=4)
    got = {r.phrase: r.df for r in phrases.collect() if r.df}
    assert got == {"die studierenden": 4, "die studierenden lernen": 4, "die studierenden erkennen": 4, "die studierenden erkennen und": 4}
    assert {r.phrase for r in phrases.where("df = 0").collect()} == set(L.SEEDS)
    left = {r.m: r.t for r in L.strip_openings(df, ["m"], "t", phrases).collect()}
    # white space inside stays, no cut before a conjunction, a sentence that is a phrase goes
    assert left["m0"] == "Alpha  kennen. Danach Alpha. Alpha." and set(left) == {"m0", "m1", "m2", "m3"}


def test_inverted_subject(spark):
    df = spark.createDataFrame([(1, "Darüber hinaus können sie Preise bilden.")], "id int, t string")
    phrases = spark.createDataFrame([("darüber hinaus",)], "phrase string")
    assert L.strip_openings(df, ["id"], "t", phrases).first()["t"] == "Preise bilden."


def test_cleaning(spark):
    texts = {"Stand vom 01.02.2023\nPreise [list]und\nW3M10001 // Seite 3\nRecht": "Preise\nund\nRecht", "LERNEINHEITEN UND INHALTE Recht": "Recht", "Pru\u0308fung": "Prüfung"}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    got = [r.x for r in T.compose(df.select("t", F.col("t").alias("o")), "t").select("o", T.clean_text(F.col("t")).alias("x")).collect()]
    assert sorted(got) == sorted(texts.values())


def test_hot_author(spark, monkeypatch):
    """Titles that meet by their segments are the same pairs as all with all."""
    rng = random.Random(6)
    stem = ["grundlagen_preis_menge", "einfuhrung_steuer_recht", "handbuch_markt_wert"]
    keys = []
    for _ in range(120):
        t = list(rng.choice(stem))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice(["", "x", t[k] + "y"])
        keys.append("ohneautor_" + "".join(t))
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    plain = {r.key: r.kanon for r in S.canonical_keys(df, "k").collect()}
    monkeypatch.setattr(S, "MANY", 5)
    assert {r.key: r.kanon for r in S.canonical_keys(df, "k").collect()} == plain
    assert 1 < len(set(plain.values())) < len(plain)


def test_corporate_authors():
    p = Parser()
    entries, _ = p.split("Deutsche Gesellschaft für Recht (DGR): Leitfaden, Berlin 2010\nBerg, A.: Recht, Wien 2011")
    f = [p.fields(*e) for e in entries]
    assert [x["erstautor_nachname"] for x in f] == ["Deutsche Gesellschaft für Recht (DGR)".split(" (")[0], "Berg"] and f[0]["titel"] == "Leitfaden"
    f = p.fields(*p.split("Lang, E.: Preise, Kontor Verlag, Neudorf, 2003")[0][0])
    assert (f["titel"], f["ort"], f["jahr"]) == ("Preise", "Neudorf", "2003")


def test_outline(spark):
    text = "Grundlagen:\n- Preis; Menge\n- Markt\nRecht und Pflicht: Vertrag, Haftung\n1. Teil\n- a b\nBESONDERHEITEN\nweg"
    assert outline(text) == [("Grundlagen", "Preis"), ("Grundlagen", "Menge"), ("Grundlagen", "Markt"), ("Recht und Pflicht", "Vertrag, Haftung"), ("Recht und Pflicht > 1. Teil", "a b")]
    assert outline(None) == [] and outline("  \n") == []
    assert trailing_heading("Dokumentation eines IKS Interne Revision") == ("Dokumentation eines IKS", "Interne Revision")
    df = content_points(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t")
    assert df.count() == 5 and "Grundlagen: Preis; Menge; Markt" in grouped_text(df, "id").first()["text"]


def test_authors():
    for text in ("Baetge, J.: Bilanz", "Kuckartz U. (2009): Text", "Schneider, K.: Werk", "W. S. Cleveland: Data", "Kuhn, A.; Lang, B. (2010): Buch", "Weber, Jürgen / Lang, Eva: Buch"):
        assert scan_authors(text), text
    assert scan_authors("Lehrbuch der Preise: München") is None
    p = Parser()
    entries, notes = p.split("Baetge, J. (2009): Bilanzen. Vahlen, München.\nSkript und Unterlagen\nLang, E.: „Recht“, 2. Aufl., Berlin 2010")
    assert len(entries) == 2 and len(notes) == 1
    f = p.fields(*entries[0])
    assert (f["erstautor_nachname"], f["titel"], f["jahr"], f["lit_key"], f["ort"]) == ("Baetge", "Bilanzen", "2009", "baetge_bilanzen", "München")
    f = p.fields(*entries[1])
    assert (f["titel"], f["ort"], f["jahr"], f["parse_unsicher"]) == ("Recht", "Berlin", "2010", False)
    assert work_key("", "") == "" and work_key("", "Das Recht") == "ohneautor_recht"


def test_literature(spark):
    df = literature_entries(spark.createDataFrame([(1, "Baetge, J.: Bilanzen, Berlin 2009"), (2, None), (3, "")], "id int, t string"), "id", "t")
    assert [(r.id, r.position, r.ort) for r in df.collect()] == [(1, 1, "Berlin")]
    lines = spark.createDataFrame([("A, B.: Titel, Kontor Verlag, Kleinwehr, 2001.",), ("C, D.: Werk, Kontor Verlag, Kleinwehr, 2003.",), (None,)], "t string")
    assert [r.ort for r in learn_places(lines, "t").collect()] == ["Kleinwehr"]


def test_quality(spark):
    m = spark.createDataFrame([(1, "m1", "N", "x", "x"), (2, "m2", "N", None, ""), (3, "m2", "N", " ", "y")], "zeile_id int, modulnummer string, modulname string, a string, b string")
    assert {r.feld: r.anzahl for r in Q.empty_fields(m, "zeile_id", ["a", "b"]).collect()} == {"a": 2, "b": 1}
    assert Q.shared_names(m, "modulnummer", "modulname").first()["schluessel"] == "m1; m2"
    assert [r.zeile_id for r in Q.equal_fields(m, "zeile_id", ["a", "b"]).collect()] == [1]


def test_parameters():
    c = Config()
    assert c.share("contents") == pytest.approx(0.45)
    assert check_parameters({"contents": 0, "competences": 0, "literature": 0}, 7, 500, 158, 40) == ({"contents": 45, "competences": 35, "literature": 20}, 5, 158)
    assert check_parameters({"contents": 10, "competences": 0, "literature": 100}, 8, 3, 158, 40)[2] == 118


def test_rarest_shared(spark):
    rng = random.Random(8)
    owned = {(e, i) for i in range(200) for e in rng.sample(range(9), rng.randrange(1, 8))} | {(20, 1), (21, 1), (None, 3)}
    df = spark.createDataFrame(list(owned), "e int, i int")
    got = {}
    for r in S.rarest_shared(df, "e", "i", 5).collect():
        got.setdefault((r.a, r.b), {})[r.rang] = r.i
    sets = {e: {i for x, i in owned if x == e} for e in {e for e, _ in owned if e is not None}}
    n = {i: sum(i in s for s in sets.values()) for _, i in owned}
    want = {(a, b): dict(enumerate(sorted(sets[a] & sets[b], key=lambda i: (n[i], i))[:5], 1)) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert got == want
    assert S.rarest_shared(df.limit(0), "e", "i", 5).count() == 0
