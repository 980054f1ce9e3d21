"""Operators of the llm subpackage: brute force, exact round trips, edge cases."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quercus.llm import markup as M
from quercus.llm import names as N
from quercus.llm import quality as Q
from quercus.llm import tokenise as T
from quercus.llm.components import hash_to_min, with_least
from quercus.llm.distinctive import least_weight, log_entropy
from quercus.llm.mixing import fair_mix, shares
from quercus.llm.ranges import numbered, running_size
from quercus.llm.queries import QUERIES, _module_points
from quercus.llm.scans import _convertible, repair
from quercus.llm.spectral import affinities, embed_and_split, embedding, point_tokens, spectral_clusters
from quercus.llm.sql import SQL
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert compare(df, SQL[name], connect(data)) == ""
    else:
        assert df.count() >= 0


# ---------------------------------------------------------------- names


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_segment_join(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 12))) for _ in range(160)]
    rows = [(rng.choice("xy"), w) for w in words] + [("x", None), (None, "abc"), ("x", words[0])]
    got = {(r.block, r.a, r.b) for r in N.near_strings(spark.createDataFrame(rows, "g string, s string"), "g", "s").collect()}
    kept = {(g, s) for g, s in rows if g and s and len(s) > 2}
    want = {(g, a, b) for g, a in kept for h, b in kept if g == h and a < b and edit(a, b) <= 2}
    assert got == want


def test_within_one():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(2))
        swaps = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        assert N.within_one(a, b) == (edit(a, b) <= 1 or b in swaps)


def test_people(spark):
    names = ["Prof. Dr. Franziska Sterormark", "Dr. Franziska E. Sterormark", "STERORMARK, Franziska", "Sterormark, F.", "Prof. Dr. Sören Streormark", "Prof. Dr. Magdalena Mösolmann", "Moesolmann, Lena",
             "Prof. Dr. Gesine Berger", "Prof. Dr. Gabriele Berger", "G. Berger", "Prof. Dr. Berger", "FK Handel Bad Alt", "Fachkommission Handel, Standort Bad Alt", "Fachkomm. Handel (Bad Alt)", "Fachkommission Recht Bad Alt", None, "", " "]
    groups = defaultdict(set)
    for r in N.person_groups(spark.createDataFrame([(n, 1) for n in names] * 2, "verantwortung string, gruppe int"), "verantwortung").collect():
        groups[r.gruppe].add(r.name)
    assert {frozenset(g) for g in groups.values()} == {
        frozenset(names[:4]), frozenset(names[4:5]), frozenset(names[5:7]), frozenset(names[7:8]), frozenset(names[8:9]), frozenset(names[9:10]), frozenset(names[10:11]), frozenset(names[11:14]), frozenset(names[14:15]),
    }
    assert N.person_groups(spark.createDataFrame([], "v string"), "v").count() == 0


def test_works(spark):
    cols = "lit_key string, a string, f string, t string, y string, o string, name string"
    rows = [
        ("berg_lehrbuch_preise", "Berg, A. / Tal, B.", "Berg", "Lehrbuch Preisermittlung: Marktordnung verstehen", "2001", "Ulm", "x"),
        ("berg_lb_preise", "Berg, A.", "Berg", "Lb Preisermittlung", "2001", None, "x"),
        ("tal_lehrbuch_preise", "B. Tal und A. Berg", "Tal", "Lehrbuch Preisermittlung: Marktordnung verstehen", None, "Ulm", None),
        ("berg_preise_2", "Berg A", "Berg", "Preisermittlung 2", "2001", "Ulm", "x"),
        ("berg_preise_3", "Berg A", "Berg", "Preisermittlung III", "2001", "Ulm", "x"),
        ("feld_lehrbuch_preise", "Feld, C.", "Feld", "Lehrbuch Preisermittlung: Marktordnung verstehen", "2001", "Ulm", "x"),
        ("berg_ordnung_einfuhrung", "Berg, A.", "Berg", "Haushaltsordnung, Einführung in die große", "1999", "Ulm", "x"),
        ("berg_einfuhrung_grosse", "Berg, A.", "Berg", "Einführung in die große Haushaltsordnung: Mit Aufgaben zum Recht", "1999", "Ulm", "x"),
        (None, "Berg, A.", "Berg", "Lehrbuch Preisermittlung", "2001", "Ulm", "x"),
        ("", None, None, None, None, None, None),
        ("leer", None, None, None, None, None, None),
    ]
    groups = N.work_groups(spark.createDataFrame(rows * 2, cols), "lit_key", "a", "f", "t", "y", "o")
    pairs = {(r.name_a, r.name_b) for r in N.variant_pairs(groups).collect()}
    assert pairs == {("berg_lb_preise", "berg_lehrbuch_preise"), ("berg_lb_preise", "tal_lehrbuch_preise"), ("berg_lehrbuch_preise", "tal_lehrbuch_preise"), ("berg_einfuhrung_grosse", "berg_ordnung_einfuhrung")}


# ---------------------------------------------------------------- scans


def test_works_one_word(spark):
    cols = "lit_key string, a string, f string, t string, y string, o string"
    rows = [
        ("gamirrath_markktverteilung", "Gamirrath, A.", "Gamirrath", "Markktverteilung", "2001", "Ulm"),
        ("gamirrath_marktverteilung", "Gamirath, A.", "Gamirath", "Marktverteilung", "2001", "Ulm"),
        ("gamirrath_talentberatung", "Gamirrath, A.", "Gamirrath", "Talentberatung", None, "Ulm"),
        ("gamirrath_talentbratung", "Gamirrath, A.", "Gamirrath", "Talentbratung", "2001", "Ulm"),
        ("feld_talentberatung", "Feld, C.", "Feld", "Talentberatung", "2001", "Ulm"),
    ]
    groups = N.work_groups(spark.createDataFrame(rows, cols), "lit_key", "a", "f", "t", "y", "o")
    got = {(r.name_a, r.name_b) for r in N.variant_pairs(groups).collect()}
    assert got == {("gamirrath_markktverteilung", "gamirrath_marktverteilung"), ("gamirrath_talentberatung", "gamirrath_talentbratung")}


def test_slip_join(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(150)] + ["xabcdy", "yabcdx", "abcdyx", "bcdefa", "abcdef"]
    rows = [(rng.choice("xy"), w) for w in words] + [("x", None), (None, "abc"), ("x", words[0])]
    got = {(r.block, r.a, r.b) for r in N.slip_strings(spark.createDataFrame(rows, "g string, s string"), "g", "s").collect()}
    kept = {(g, s) for g, s in rows if g and s and len(s) > 2}
    slip = lambda a, b: edit(a, b) <= 1 or (edit(a, b) == 2 and sorted(a) == sorted(b))
    assert got == {(g, a, b) for g, a in kept for h, b in kept if g == h and a < b and slip(a, b)}


WORK_COLS = "lit_key string, a string, f string, t string, y string, o string"


def test_works_of_near_surnames(spark, monkeypatch):
    """No table of surnames two edits apart, nor of works times such surnames, is kept."""
    kept, cut = [], N.cut_lineage

    def counted(df):
        df = cut(df)
        kept.append(df.count())
        return df

    monkeypatch.setattr(N, "cut_lineage", counted)
    rng = random.Random(5)
    names = [f"Ba{x}mo{y}ser" for x in "bdfgklmnprstvz" for y in "bdfgklmnprstvz"]
    rows = [(f"k{i}", f"{s}, A.", s, "".join(rng.choice("bdglmrst") + rng.choice("aiou") for _ in range(7)), "2001", "Ulm") for i, s in enumerate(names)]
    rows += [("l0", "Babmobbser, A.", "Babmobbser", rows[0][3], "2001", "Ulm"), ("l1", "Babmogser, A.", "Babmogser", rows[0][3], "2001", "Ulm")]
    groups = N.work_groups(spark.createDataFrame(rows, WORK_COLS), "lit_key", "a", "f", "t", "y", "o")
    assert {(r.name_a, r.name_b) for r in N.variant_pairs(groups).collect()} == {("k0", "l0"), ("k0", "l1")} | {("l0", "l1")}
    assert max(kept) <= len(rows)


def test_works_all_with_all(spark):
    """The groups are those of ``same_work`` asked for every pair of a volume, whatever the pair has in common."""
    rng = random.Random(6)

    def typed(word):
        i, kind = rng.randrange(1, len(word) - 1), rng.randrange(12)
        spelt = {0: word[:i] + word[i + 1 :], 1: word[:i] + word[i] + word[i:], 2: word[:i] + word[i + 1] + word[i] + word[i + 2 :], 3: word[: max(5, i)], 4: word.replace("ü", "ue").replace("ö", "oe")}
        return spelt.get(kind, word)

    surnames, nouns = ["Bauermann", "Müllerhof", "Schönleben", "Haueisen"], ["Steuerlehre", "Marktaufbau", "Kostenprüfung", "Lohnführung", "Statistik", "Handel"]
    rows = []
    for i in range(220):
        authors = " / ".join(f"{typed(s)}, A." for s in rng.sample(surnames, rng.choice([0, 1, 1, 2])))
        title = " ".join(typed(w) for w in rng.sample(nouns, rng.choice([1, 1, 2, 3]))) if rng.random() < 0.95 else rng.choice(["Das", "Marktaufbau und", "Markt aufbau"])
        rows.append((f"k{i}", authors or None, None, title + rng.choice(["", "", " 2"]), rng.choice([None, "1999", "2001", "2003"]), rng.choice([None, "Ulm", "Bonn"])))
    works = {}
    for k, a, f, t, y, o in rows:
        words, volume, kinds = N.read_title(t)
        works[k] = {"words": words, "volume": volume, "kinds": kinds, "authors": N.read_authors(a, f), "year": y or "", "place": o or ""}
    least = {k: k for k in works}
    for _ in range(9):
        for x in works:
            for y in works:
                if bool(works[x]["authors"]) == bool(works[y]["authors"]) and least[y] < least[x] and N.same_work(works[x], works[y]):
                    least[x] = least[y]
    of = lambda k: k if least[k] == k else of(least[k])
    want = {(x, y) for x in works for y in works if x < y and of(x) == of(y)}
    groups = N.work_groups(spark.createDataFrame(rows, WORK_COLS), "lit_key", "a", "f", "t", "y", "o")
    assert {(r.name_a, r.name_b) for r in N.variant_pairs(groups).collect()} == want


def test_confusions():
    assert _convertible("Grundlagen", "Grnndla9en") == 2 and _convertible("Normen", "Norrnen") == 1 and _convertible("Rahmen", "Ralimen") == 1
    assert _convertible("Haus", "Maus") == -1 and _convertible("Haus", "Haus") == 0


def test_scans(spark):
    head = ["Handbuch Wirtschaft", "Seite {} von 90"]
    rows = []
    for i in range(6):
        page = "\n".join(h.format(i + 10) for h in head)
        rows.append((i, f"Grundlagen der Kosten-\n{page}\nrechnung und Preise.\nKosten- und Nutzen", f"Sie kennen Grnndlagen der eigen- ständigen Lehre.\n{page}\nEnde", f"Berg, A.: Recht. Ulm\n{page}\n2001", "x"))
    rows += [(90, None, "", " ", None), (91, "kurz", None, None, None), (0, rows[0][1], rows[0][2], rows[0][3], "x")]
    df = spark.createDataFrame(rows, "id long, inhalte string, fachkompetenz string, literatur string, k string")
    typed = spark.createDataFrame([("Grundlagen der Kostenrechnung, Handbuch und Recht",), (None,)], "t string")
    found, texts = repair(df, "id", ["inhalte", "fachkompetenz", "literatur"], typed, "t")
    got = Counter((r.art, r.wert) for r in found.where("id = 1").collect())
    assert got == {("zeile", "Handbuch Wirtschaft"): 3, ("zeile", "Seite 11 von 90"): 3, ("wort", "Kostenrechnung"): 1, ("wort", "Grundlagen"): 1, ("wort", "eigenständigen"): 1}
    by = {(r.id, r.feld): r.text for r in texts.collect()}
    assert by[1, "inhalte"] == "Grundlagen der Kostenrechnung und Preise. Kosten- und Nutzen" and by[1, "literatur"] == "Berg, A.: Recht. Ulm 2001"
    assert by[1, "fachkompetenz"].startswith("Sie kennen Grundlagen der eigenständigen") and by[91, "inhalte"] == "kurz" and (90, "inhalte") not in by
    assert found.where("id = 0").count() == 9
    none = repair(df.limit(0), "id", ["inhalte"], typed.limit(0), "t")
    assert none[0].count() == 0 and none[1].count() == 0


def test_repaired_text_has_what_was_found(spark):
    """One cell with a misread word and one that is broken and misread; dots beside a vowel; page numbers of two kinds."""
    text = "Grnndlagen der Markt-\nS. 112\nforschnng und der Pru¨fung.\n104 |\nEnde der Markt¬\nforschung"
    typed = spark.createDataFrame([("Grundlagen der Marktforschung und der Prüfung. Ende",)] * 3, "t string")
    found, texts = repair(spark.createDataFrame([(1, text)], "id long, inhalte string"), "id", ["inhalte"], typed, "t")
    assert {(r.art, r.wert) for r in found.collect()} == {("zeile", "S. 112"), ("zeile", "104 |"), ("wort", "Grundlagen"), ("wort", "Marktforschung"), ("wort", "Prüfung")}
    assert texts.first()["text"] == "Grundlagen der Marktforschung und der Prüfung. Ende der Marktforschung"


def test_context_decides(spark):
    """Rival forms of one skeleton, and a misreading that is a word itself, go by the words beside them."""
    typed = ["Der Kunde nennt den Preis."] * 60 + ["Er kennt die Kante am Haus."] * 3 + ["Die Hans Bank"] * 3 + ["Am Haus steht er."] * 90
    typed = spark.createDataFrame([(t,) for t in typed], "t string")
    cells = {1: "Am Hans steht er.", 2: "Die Hans Bank", 3: "Der Knnde nennt", 4: "Hans"}
    found, texts = repair(spark.createDataFrame(list(cells.items()), "id long, inhalte string"), "id", ["inhalte"], typed, "t")
    assert {(r.id, r.wert) for r in found.collect()} == {(1, "Haus"), (3, "Kunde")}
    assert {r.id: r.text for r in texts.collect()} == {1: "Am Haus steht er.", 2: "Die Hans Bank", 3: "Der Kunde nennt", 4: "Hans"}


def test_confusions_in_short():
    """What is left out at both ends changes nothing: compared with the whole table."""
    from quercus.llm.scans import CONFUSIONS

    def whole(right, seen):
        if not right and not seen:
            return 0
        ways = [whole(right[1:], seen[1:])] if right and seen and right[0] == seen[0] else []
        ways += [whole(right[len(a) :], seen[len(b) :]) + 1 for a, bs in CONFUSIONS.items() if right.startswith(a) for b in bs if seen.startswith(b)]
        return min((w for w in ways if w < 99), default=99)

    rng = random.Random(4)
    for _ in range(4000):
        a, b = ("".join(rng.choice("nurmhield") for _ in range(rng.randint(1, 5))) for _ in range(2))
        w = whole(a, b)
        assert _convertible(a, b) == (-1 if w >= 99 else w), (a, b)


def test_scans_in_points(spark, tmp_path):
    page = "Handbuch Wirtschaft\n"
    rows = [(i, "scan", page + f"Grundlagen der Kosten Nummer {'abcdefgh'[i]}", page + "Sie kennen die Preise", "", page + "Berg: Recht") for i in range(8)]
    cols = "zeile_id long, herkunft string, inhalte string, fachkompetenz string, methodenkompetenz string, literatur string"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "module.parquet"))
    got = {(r.k, r.t) for r in _module_points(spark, str(tmp_path)).withColumnRenamed("zeile_id", "k").collect()}
    want = [(i, t) for i in range(8) for t in (f"Grundlagen der Kosten Nummer {'abcdefgh'[i]}", "Sie kennen die Preise")]
    assert got == {(r.k, r.t) for r in point_tokens(spark.createDataFrame(want, "id long, t string"), "id", "t").collect()}


# ---------------------------------------------------------------- markup


BLOCKS = [("ueberschrift", "Kosten & Preise"), ("listenpunkt", "A/B-Test in C# und SQL"), ("listenpunkt", "Quoten < 5 %"), ("code", "if a > b:\n    x[i] = *p"), ("formel", r"\frac{a}{b}"), ("absatz", "Über Märkte und Preise.")]
WANT = [(a.replace("listenpunkt", M.ITEM), v) for a, v in BLOCKS]
CELLS = {
    "html": '<h2>Kosten <b>&amp;</b> Preise</h2><ul><li><a href="/x">A/B-Test</a> in C# und SQL<li>Quoten &lt; 5 %</ul><script>x</script><p hidden>y</p><pre><code>if a &gt; b:\n    x[i] = *p</code></pre><div class="math">\\[\\frac{a}{b}\\]</div><p>&Uuml;ber<br/>\nMärkte und&nbsp;Preise.',
    "markdown": "## Kosten & **Preise**\n\n* A/B-Test in [C#](/x) und SQL\n* Quoten \\< 5 %\n\n```\nif a > b:\n    x[i] = *p\n```\n\n$$\\frac{a}{b}$$\n\nÜber *Märkte* und\nPreise.",
    "wiki": "== Kosten & '''Preise''' ==\n\n* [[Seite 1|A/B-Test]] in C# und SQL\n* Quoten &lt; 5 %\n\n<pre>\nif a &gt; b:\n    x[i] = *p\n</pre>\n\n<math>\\frac{a}{b}</math>\n\nÜber ''Märkte'' und Preise.",
    "latex": '\\section*{Kosten \\& \\textbf{Preise}}\n\n\\begin{itemize}\n\\item \\emph{A/B-Test} in C\\# und SQL\n\\item Quoten $<$ 5 \\%\n\\end{itemize}\n\n\\begin{verbatim}\nif a > b:\n    x[i] = *p\n\\end{verbatim}\n\n\\[ \\frac{a}{b} \\]\n\n\\"Uber M\\"arkte~und Preise.',
}


@pytest.mark.parametrize("kind", CELLS)
def test_renderers(kind):
    assert M.markup_of(CELLS[kind]) == kind
    assert M.render(CELLS[kind]) == WANT


def test_escaped_and_others():
    import html

    assert M.render(html.escape(CELLS["html"], quote=False)) == WANT
    assert M.render("[u]Über[/u] uns\n\n[list]\n[*][b]A[/b] b[*]C[/list]") == [("absatz", "Über uns"), (M.ITEM, "A b"), (M.ITEM, "C")]
    assert M.render("Titel\n------\n\n1. a\n2. b\n\n    x = 1\n      y") == [("ueberschrift", "Titel"), (M.ITEM, "a"), (M.ITEM, "b"), ("code", "x = 1\n  y")]
    assert M.render("<table><tr><th>A<th>B<tr><td>1<td>2</table>") == [("absatz", "A | B"), ("absatz", "1 | 2")]
    for plain in (None, "", " \n", "A/B-Test in C# bei Quoten < 5 %\nR&D und mehr", "2 * 3 * 4 = x_1_y"):
        assert M.render(plain) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>/lip&;*_[]#=\\{}$`'\n -1.", max_size=80))
def test_any_text_renders(text):
    assert all(a and v for a, v in M.render(text))


def test_markup_table(spark):
    df = spark.createDataFrame([(1, CELLS["html"], "x"), (1, CELLS["html"], "x"), (2, None, None), (3, "", "x"), (None, "<p>a</p>" * 5000, "x")], "id long, t string, k string")
    got = M.render_blocks(df, "id", ["t"])
    assert Counter(r.id for r in got.collect()) == {1: 12, None: 5000}
    assert M.render_blocks(df.limit(0), "id", ["t"]).count() == 0


# ---------------------------------------------------------------- components


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"k{rng.randint(0, 300):03d}", f"k{rng.randint(0, 300):03d}") for _ in range(170)]
    pairs += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(60)] + [("hub", f"h{i}") for i in range(200)] + [("selbst", "selbst"), ("", "leer"), (None, "x"), ("y", None), (None, None)] + pairs[:9]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(*p, 1) for p in pairs], "a string, b string, v int")
    assert {r.key: r.gruppe for r in hash_to_min(df, "a", "b").collect()} == {k: find(k) for k in root}
    assert hash_to_min(df.limit(0), "a", "b").count() == 0


# ---------------------------------------------------------------- spectral clusters


def partitions(df):
    """Rows of each task's output."""
    return [len(x) for x in df.rdd.glom().collect()]


@pytest.fixture
def plain_plans(spark):
    """Plans as they stand: nothing coalesced, nothing broadcast for being small."""
    for k, v in (("adaptive.enabled", "false"), ("autoBroadcastJoinThreshold", "-1"), ("shuffle.partitions", "8")):
        spark.conf.set(f"spark.sql.{k}", v)
    yield
    for k, v in (("adaptive.enabled", "true"), ("autoBroadcastJoinThreshold", "10MB"), ("shuffle.partitions", "4")):
        spark.conf.set(f"spark.sql.{k}", v)


def test_hub_is_no_task(spark, plain_plans, monkeypatch):
    """A vertex with a third of all rows stays in the tasks that hold its rows."""
    monkeypatch.setattr("quercus.llm.components.PLAIN", 0)
    rows = [(0, i) for i in range(4000)] + [(i, i) for i in range(1, 8000)]
    sets = spark.createDataFrame(rows, "v long, u long").repartition(8, "v", "u")
    got = with_least(sets, len(rows))
    assert max(partitions(got)) < len(rows) / 4
    assert got.where("v = 0").agg(F.count("*"), F.max("m")).first() == (4000, 0) and got.count() == len(rows)
    star = spark.createDataFrame([(0, i) for i in range(3000)] + [(5000 + i, 5001 + i) for i in range(0, 400, 2)], "a long, b long")
    groups = hash_to_min(star, "a", "b")
    assert groups.where("gruppe = 0").count() == 3000 and groups.count() == 3400


def test_spectral(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for g in range(12):
        base = [f"Thema {chr(97 + g)}{chr(97 + i)}mmmmm der Lehre" for i in range(14)]
        for m in range(rng.randint(1, 6)):
            i = 100 * g + m
            truth[i] = g
            points = [p if rng.random() < 0.8 else f"Eigenes {chr(97 + g)}{chr(97 + m)}{chr(97 + k)}xxxxx" for k, p in enumerate(base)]
            rows.append((i, "\n".join([*points, "Quellen werden überall geprüft und zitiert"])))
    rows += [(5000, rows[0][1]), (6000, None), (6001, ""), (6002, "Quellen werden überall geprüft und zitiert"), (5000, rows[0][1])]
    truth[5000] = truth[rows[0][0]]
    tokens = point_tokens(spark.createDataFrame([(*r, 1) for r in rows], "id long, t string, k int"), "id", "t")
    got = {r.k: r for r in spectral_clusters(tokens).collect()}
    groups = defaultdict(list)
    for i, g in truth.items():
        groups[g].append(i)
    want = {i: min(v) for v in groups.values() if len(v) > 1 for i in v}
    assert {k: r.gruppe for k, r in got.items()} == want
    assert all(r.groesse == len(groups[truth[k]]) for k, r in got.items())
    assert {k for k, r in got.items() if r.rang == 1} and spectral_clusters(tokens.limit(0)).count() == 0


def test_affinities_whole(spark):
    rng = random.Random(7)
    sets = {i: {1000 * (i // 15) + rng.randrange(40) for _ in range(25)} | {9000 + rng.randrange(30) for _ in range(3)} for i in range(90)}
    tokens = spark.createDataFrame([(k, t) for k, ts in sets.items() for t in ts], "k long, t long")
    df = Counter(t for ts in sets.values() for t in ts)
    n = math.log(len(sets))
    weigh = lambda ts: sum(n - math.log(df[t]) for t in ts)
    want = {}
    for a in sets:
        for b in range(a + 1, 90):
            common, least = weigh(sets[a] & sets[b]), min(weigh(sets[a]), weigh(sets[b]))
            if common >= 0.4 * least and common >= 1.5 * n:
                want[a, b] = common / least
    got = {(r.a, r.b): r.w for r in affinities(tokens)[1].collect()}
    assert len(want) > 300 and got.keys() == want.keys() and all(abs(got[p] - w) < 1e-9 for p, w in want.items())


def clique(vertices, w=0.8):
    return [(a, b, w + 0.001 * ((a * 7 + b) % 50)) for a in vertices for b in vertices if a < b]


def test_weak_bridge_is_split(spark):
    """The embedding decides: two dense families joined by a weak bridge are one component and two
    clusters, whatever their size; a dense family, a pair and a chain of three stay whole."""
    edges = [e for n, start in ((5, 0), (40, 100)) for e in clique(range(start, start + n)) + clique(range(start + n, start + 2 * n)) + [(start, start + n, 0.4)]]
    edges += clique(range(300, 330), 0.4) + [(400, 401, 0.4), (500, 501, 0.9), (501, 502, 0.4)]
    got = defaultdict(set)
    for r in embed_and_split(spark.createDataFrame(edges, "a long, b long, w double")).collect():
        got[r.cluster].add(r.v)
    want = [range(5), range(5, 10), range(100, 140), range(140, 180), range(300, 330), range(400, 402), range(500, 503)]
    assert sorted(map(sorted, got.values())) == sorted(map(list, want))
    assert len(hash_to_min(spark.createDataFrame(edges, "a long, b long, w double"), "a", "b").select("gruppe").distinct().collect()) == 5


def test_tight_components_end_early(spark, monkeypatch):
    """What is left out of later rounds would be no cluster to split after all of them."""
    edges = clique(range(12)) + clique(range(20, 26)) + clique(range(30, 36)) + [(20, 30, 0.4), (50, 51, 0.5)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    parts = hash_to_min(df, "a", "b").selectExpr("key AS v", "gruppe AS part")
    early = {r.v: r for r in embedding(df, parts).collect()}
    monkeypatch.setattr("quercus.llm.spectral.EVERY", 18)
    whole = {r.v: r for r in embedding(df, parts).collect()}
    assert early.keys() == whole.keys()
    for v, r in whole.items():
        if v < 20 or v >= 50:
            assert early[v].x0 == 0.0 and math.dist(r[2:], [0] * 4) < 0.5
        else:
            assert all(abs(a - b) < 1e-9 for a, b in zip(early[v][2:], r[2:]))


def test_numbers_over_ranges(spark, plain_plans):
    rng = random.Random(9)
    rows = [(g, rng.randrange(50), i) for i, g in enumerate([3] * 3000 + [rng.randrange(40) for _ in range(3000)])]
    got = numbered(spark.createDataFrame(rows, "g long, o long, i long"), "g", ["o", "i"], "n")
    assert max(partitions(got)) < 2000
    want, seen = {}, Counter()
    for g, o, i in sorted(rows):
        seen[g] += 1
        want[i] = seen[g]
    assert {r.i: r.n for r in got.collect()} == want
    assert numbered(spark.createDataFrame([], "g long, o long"), "g", ["o"], "n").count() == 0


def test_split_to_the_end(spark, monkeypatch):
    # a chain of 20: one component, far more clusters than four rounds make
    monkeypatch.setattr("quercus.llm.spectral.RADIUS", 0.0)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(19)], "a long, b long, w double")
    assert embed_and_split(edges).select("cluster").distinct().count() == 20


# ---------------------------------------------------------------- distinctive terms


def test_log_entropy(spark):
    docs = {1: "aaaa bbbb bbbb", 2: "bbbb cccc", 3: "aaaa aaaa dddd bbbb"}
    rows = [(d, w, f"g{d % 2}", "x") for d, t in docs.items() for w in t.split()] + [(None, "aaaa", "g", "x"), (4, None, "g", "x")]
    df = spark.createDataFrame(rows, "d int, w string, g string, tf string")
    tf = Counter((d, w) for d, w, *_ in rows if d and w)
    gf = Counter(w for d, w, *_ in rows if d and w)
    for group, unit, n in ((None, "d", 3), ("g", "g", 2)):
        got = {(r.d, r.w): r for r in log_entropy(df, "d", "w", group).collect()}
        spread = Counter((d if unit == "d" else g, w) for d, w, g, _ in rows if d and w)
        for (d, w), m in tf.items():
            p = [x / gf[w] for (_, v), x in spread.items() if v == w]
            weight = math.log2(1 + m) * (1 + sum(x * math.log(x) for x in p) / math.log(n))
            assert got[d, w].gewicht == pytest.approx(weight, abs=1e-9) and got[d, w].gf == gf[w]
        assert len(got) == len(tf)
    assert got[1, "aaaa"].gruppen == 1 and got[1, "bbbb"].gruppen == 2
    assert log_entropy(spark.createDataFrame([], "d int, w string"), "d", "w").count() == 0


def test_characteristic_terms_by_weight(spark, data):
    """The weight takes part in what is found: its entropy stands in the plan, and it alone loses nothing."""
    plan = QUERIES["p7_found"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "LOG2" in plan and "gewicht" not in QUERIES["p7_found"](spark, data).columns
    t = spark.createDataFrame([(r, f"t{r % k}", f"g{r % 40}") for k in (3, 7, 40) for r in range(40) for _ in range(k)], "r long, t string, g string")
    w = log_entropy(t, "r", "t", "g")
    few = w.where("gruppen <= 3")
    assert few.count() == few.where(F.col("gewicht") >= least_weight(F.col("tf"), 3, F.col("n"))).count()
    assert w.where("gruppen = 40").count() == 0 or w.where("gruppen > 12").where(F.col("gewicht") >= least_weight(F.col("tf"), 3, F.col("n"))).count() < w.where("gruppen > 12").count()


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def encoder():
    return T.BytePairEncoder(T.load_ranks())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_round_trip(encoder, text):
    assert encoder.decode(encoder.encode(text)) == text


def test_tokens_reachable(encoder):
    rng = random.Random(5)
    sample = rng.sample(list(encoder.ranks.items()), 4000)
    assert all(encoder.merge(t) == [i] for t, i in sample)


def test_against_library(encoder):
    import json  # noqa: F401

    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    for text in ("Ein Modul über Zinsen – 12,5 %!\n\n  R&D's", "日本語 <|endoftext|> \t x", "a" * 5000, "Aa1_" * 900, "\u00a0\u200b…", " ", "\n"):
        assert encoder.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_token_table(spark):
    df = spark.createDataFrame([(1, "ab cd", "x"), (1, "ab cd", "x"), (2, None, "x"), (3, "", None), (None, " ", "x")], "doc_id long, text string, ids string")
    got = T.encode_texts(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert {(r.doc_id, r.tokens) for r in T.count_tokens(df, "text").collect()} == {(1, 2), (2, 0), (3, 0), (None, 1)}
    assert T.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# ---------------------------------------------------------------- mixing


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, rng.choices("abcd", [60, 30, 5, 5])[0], rng.randint(1, 40), 1) for i in range(12_000)] + [(None, "a", 5, 1), (-1, None, 5, 1), (-2, "a", None, 1), (-3, "a", 0, 1), (-4, "unlisted", 5, 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, w int")
    goals = [("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 4), ("d", 0.1, 1), ("e", 0.0, 3), (None, 0.1, 1)]
    targets = spark.createDataFrame(goals, "source string, zielanteil double, max_wiederholung int")
    rows = sorted(fair_mix(df, targets, budget=60_000.0).collect(), key=lambda r: (r.fertig, r.source, r.doc_id, r.kopie))
    running = 0
    for r in rows:
        running += r.tokens
        assert r.bis == running
    assert running <= 60_000 < running + 41
    total = Counter()
    for r in rows:
        total[r.source] += r.tokens
    for s, w, _ in goals[:4]:
        assert total[s] / running == pytest.approx(w, abs=0.002)
    assert max(Counter((r.doc_id, r.source) for r in rows).values()) <= 4 and {r.source for r in rows} == set("abcd")
    everything = fair_mix(df, targets, budget=1e12)
    used = Counter(r.source for r in everything.collect())
    stock = Counter(s for i, s, t, _ in docs if i is not None and t)
    assert used == {"a": stock["a"], "b": 2 * stock["b"], "c": 4 * stock["c"], "d": stock["d"]}
    report = {r.source: r for r in shares(everything, df, targets).collect()}
    assert report["e"].anteil == 0.0 and sum(r.anteil for r in report.values()) == pytest.approx(1.0)
    assert fair_mix(df.limit(0), targets).count() == 0 and fair_mix(df, targets.limit(0)).count() == 0


def test_ranges_of_the_mix(spark, plain_plans):
    """A source that is far ahead in virtual time doesn't gather the others in one task."""
    docs = [(i, "gross" if i % 20 else "klein", 10) for i in range(20_000)]
    targets = spark.createDataFrame([("gross", 0.9999, 1), ("klein", 0.0001, 1)], "source string, zielanteil double, max_wiederholung int")
    mix = fair_mix(spark.createDataFrame(docs, "doc_id long, source string, tokens long"), targets)
    sizes = partitions(mix)
    assert len([n for n in sizes if n]) >= 6 and max(sizes) < 20_000 / 4
    rows = mix.orderBy("bis").collect()
    assert [r.bis for r in rows] == [10 * (i + 1) for i in range(20_000)]
    assert [(r.fertig, r.source, r.doc_id) for r in rows] == sorted((r.fertig, r.source, r.doc_id) for r in rows)
    assert running_size(spark.createDataFrame([], "a long, z long"), ["a"], "z", "s").count() == 0


# ---------------------------------------------------------------- quality


PIECES = ["Die ", "und ", "und und ", "a", "B", ".", "!", ", ", ",", '"', '","', "|", ";", "\t", " ", "  ", "\n", "\r\n", "\r", "• ", "•", "- ", "1. ", "(a) ", "[x] ", "ä", "Wort. Der ", "x" * 60, " \n ", "9", "_", "½"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 40), st.randoms())
def test_states_are_associative(pieces, size, rng):
    """A text has the same counts whole and in chunks of any size, joined in any order."""
    text = "".join(pieces)
    chunks = list(Q.cuts(text, size))
    assert "".join(text[a:b] for a, b in chunks) == text
    states = [Q.measure(text[max(0, a - Q.BEHIND) : a], text[a:b], text[b : b + Q.AHEAD]) for a, b in chunks]
    while len(states) > 1:
        k = rng.randrange(len(states) - 1)
        states[k : k + 2] = [Q.State(**states[k].flat()).merge(states[k + 1])]
    assert states[0].total() == Q.measure("", text, "").total()


def test_one_rule_at_any_length(spark):
    """Long texts give the row that they give as a whole, whatever the chunk."""
    prose = "Die Prüfung der Unterlagen ist für alle Studierenden verpflichtend und wird im Seminar besprochen. "
    texts = [prose * 1400, "test " * 40_000, "w" * 70_000 + " und die", "- Punkt eins\n" * 9_000, "a;b;c;d\n" * 9_000, " " * 70_000 + "x", "Preis Preis " + prose * 700, "ja nein " * 20_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, row string")
    whole = {i: Q.describe(Q.measure("", t, "").total()) for i, t in enumerate(texts)}
    for size in (Q.CHUNK, 1000):
        assert {r[0]: tuple(r[1:]) for r in Q.text_statistics(df, "id", "t", size).collect()} == whole
    assert whole[0][-1] == whole[6][-1] == "prosa" and whole[1][-1] == "schrott"
    assert whole[2][2] == pytest.approx((70_000 + 3 + 3) / 3)


def test_kinds(spark):
    prose = "Die Gruppe hat sich im Semester mit der Sache beschäftigt. Es wird empfohlen, die Übungen selbst zu rechnen. "
    texts = {
        1: prose * 3, 2: "\n".join(f"- Thema {w} der Lehre" for w in "abcdefgh"), 3: "Modul;TN;Note\n" + "\n".join(f"Recht;{i};1,{i}" for i in range(9)), 4: "undefined " * 40, 5: "%$ #|~ ^^ <>" * 30, 6: None, 7: "", 8: "  \n ", 9: prose * 4000, 10: "\n".join(f"- Punkt {i} der langen Liste" for i in range(9000)),
    }
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(9, texts[9], 1)], "doc_id long, text string, row int")
    rows = Q.text_statistics(df, "doc_id", "text").collect()
    assert {r.doc_id: r.art for r in rows} == {1: "prosa", 2: "liste", 3: "tabelle", 4: "schrott", 5: "schrott", 6: None, 7: None, 8: None, 9: "prosa", 10: "liste"}
    assert len(rows) == 11 and len({tuple(r) for r in rows if r.doc_id == 9}) == 1
    big = next(r for r in rows if r.doc_id == 9)
    assert (big.zeichen, big.woerter) == (len(texts[9]), 4000 * len(prose.split())) and big.zeilen == 1
    assert Q.text_statistics(df.limit(0), "doc_id", "text").count() == 0


def test_alone():
    """Nothing outside the subpackage imports it."""
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.abspath(Q.__file__)))
    for folder, _, files in os.walk(root):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"quercus\.llm|from \.+llm", open(os.path.join(folder, f)).read()), f
