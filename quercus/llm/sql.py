"""Oracles of the subpackage's queries that SQL can express."""

from quercus.llm.quality import CASED

_TERMS = r"""t AS (SELECT zeile_id, modulnummer, lower(unnest(regexp_extract_all(coalesce(modulname, '') || ' ' || coalesce(inhalte, ''), '\p{L}{4,}'))) AS begriff FROM module WHERE_)"""


def _weights(name: str, source: str, record: str, term: str) -> str:
    return f"""{name}_l AS (SELECT {record} AS r, {term} AS t, count(*) AS tf FROM {source} WHERE {record} IS NOT NULL AND {term} IS NOT NULL GROUP BY 1, 2),
{name}_n AS (SELECT greatest(count(DISTINCT r), 2)::DOUBLE AS n FROM {name}_l),
{name}_s AS (SELECT t, sum(tf)::BIGINT AS gf, count(*) AS df, sum(tf * ln(tf)) AS p FROM {name}_l GROUP BY t),
{name} AS (SELECT r, t, tf, gf, df, log2(1 + tf) * (1 - (ln(gf) - p / gf) / ln(n)) AS w FROM {name}_l JOIN {name}_s USING (t), {name}_n)"""

#: White space as Python's strip knows it.
_BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CASED = ", ".join(f"'{w}'" for w in sorted(CASED))

SQL = {
    "p5_found": """WITH RECURSIVE e AS (SELECT key_a AS a, key_b AS b FROM lit_treffer WHERE key_a IS NOT NULL AND key_b IS NOT NULL UNION SELECT key_b, key_a FROM lit_treffer WHERE key_a IS NOT NULL AND key_b IS NOT NULL),
r AS (SELECT a AS k, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.k) SELECT k AS lit_key, min(m) AS gruppe FROM r GROUP BY k""",
    "p7_found": f"""WITH {_TERMS.replace("WHERE_", "WHERE herkunft = 'formular'")}, g AS (SELECT begriff FROM t GROUP BY begriff HAVING count(DISTINCT modulnummer) <= 3)
SELECT DISTINCT 'inhalte' AS feld, modulnummer, begriff FROM (SELECT zeile_id, modulnummer, begriff FROM t GROUP BY ALL HAVING count(*) >= 3) JOIN g USING (begriff) WHERE modulnummer IS NOT NULL
UNION ALL SELECT DISTINCT 'lit_key', modulnummer, lit_key FROM literatur WHERE modulnummer IS NOT NULL AND lit_key IN (SELECT lit_key FROM literatur GROUP BY lit_key HAVING count(DISTINCT modulnummer) = 2)""",
    "p7_weights": f"""WITH {_TERMS.replace(" WHERE_", "")}, {_weights("a", "t", "zeile_id", "begriff")}, {_weights("b", "literatur", "modulnummer", "lit_key")}
SELECT 'text' AS feld, r::VARCHAR AS satz, t AS begriff, tf, gf, df, round(w, 6) AS gewicht FROM a UNION ALL SELECT 'lit_key', r, t, tf, gf, df, round(w, 6) FROM b""",
    "p10_counts": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS w, list_filter(regexp_split_to_array(t, '\r\n|\n|\r|\x{{2028}}|\x{{85}}'), lambda l: regexp_matches(l, '[^{_BLANK}]')) AS z FROM t)
SELECT doc_id, length(t) AS zeichen, len(w) AS woerter, round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / nullif(len(w), 0), 6) AS mittlere_wortlaenge, len(z) AS zeilen,
 round(len(list_filter(z, lambda l: regexp_matches(l, '[.!?][{_BLANK}]*$')))::DOUBLE / nullif(len(z), 0), 6) AS satzende_anteil, round(len(list_filter(w, lambda x: list_contains([{_CASED}], x)))::DOUBLE / nullif(len(w), 0), 6) AS haeufig_anteil FROM w""",
}
