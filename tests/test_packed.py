"""Packed fields: dialects, quotes, edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quercus.operators.packed import Codes, best_parse, count_cell, parse, protected, signatures, strip_value, unpack

SCHEMA = "zeile_id long, inhalte string, k string, feld int"
LIST = ["Grundlagen der Preisbildung", "Übungen zur Zinsrechnung", "Bezug zu Recht (qualitativ; quantitativ)", "A/B-Test im Handel"]


def codes():
    counts = {}
    for sep in ("\n", "; ", " | ", "\n- "):
        for shift in range(4):
            count_cell("inhalte", sep.join(LIST[shift:] + LIST[:shift]), counts)
    count_cell("inhalte", "Die Lehre führt ein. Behandelt wird: Preis und Markt. Es folgt Recht.", counts)
    return Codes([(*k, n) for k, n in counts.items()])


@pytest.mark.parametrize("sep", ["\n", "\r\n", "; ", ";\n", " | ", "|", " / ", " + ", "\t", "\n\n", ", "])
def test_separators(sep):
    assert best_parse("inhalte", sep.join(LIST), codes())[1] == LIST


@pytest.mark.parametrize("mark", ["- ", "• ", "▪", "{i}. ", "({i}) ", "[{i}] ", "{i}) "])
def test_marks(mark):
    text = "\n".join(mark.format(i=i) + v for i, v in enumerate(LIST, 1))
    assert best_parse("inhalte", text, codes())[1] == LIST
    if "{" in mark or mark == "• ":
        assert best_parse("inhalte", text.replace("\n", " "), codes())[1] == LIST


def test_mixed_and_continued():
    assert best_parse("inhalte", f"{LIST[0]}\n- {LIST[1]} | {LIST[2]}; {LIST[3]}", codes())[1] == LIST
    assert best_parse("inhalte", f"• {LIST[0]}\n• Übungen zur\n  Zinsrechnung", codes())[1] == LIST[:2]


def test_quotes():
    assert parse('"a; b"; c; „d; e“; "say ""x"""', "semicolon") == ["a; b", "c", "d; e", 'say "x"']
    assert parse('a "open; b', "semicolon") == ['a "open', "b"]
    assert strip_value('"a" and "b"') == '"a" and "b"'
    assert sum(protected("(a;b) [c")) == 5


def test_prose_is_one_value():
    assert len(best_parse("inhalte", "Die Lehre führt ein. Behandelt wird: Preis und Markt. Es folgt Recht.", codes())[1]) == 1


def test_edges(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " \n ", None, 1), (4, "- \n- ", "x", 1), (5, "; ".join(LIST), "x", 1), (5, "; ".join(LIST), "x", 1), (None, "\n".join(LIST), "x", 1), (7, "\n".join(LIST * 3000), "x", 1)]
    got = unpack(spark.createDataFrame(rows, SCHEMA), "zeile_id", ["inhalte"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.zeile_id, []).append(r)
    assert set(by) == {5, None, 7}
    assert len(by[5]) == 8 and len(by[7]) == 12000 and sorted({r.pos for r in by[5]}) == [1, 2, 3, 4]
    assert unpack(spark.createDataFrame([], SCHEMA), "zeile_id", ["inhalte"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab;,|\n\t\"„“()[]*•-1. ", max_size=60))
def test_nothing_is_lost(text):
    model = Codes([])
    _, values = best_parse("x", text, model)
    letters = [c for c in text if c in "ab"]
    assert [c for v in values for c in v if c in "ab"] == letters or any(c in text for c in "1([")
    assert all(v == v.strip() and v for v in values)


def test_signatures_of_long_tokens():
    value = "x" * 300 + " und " + "Y" * 500 + " (9) " + "z" * 400
    assert signatures(value) == ("x und Xx", "x und", "9 ) x", ") x")
    assert signatures("") == ("", "", "", "")
