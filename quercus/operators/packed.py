"""Several values packed in one field: dialects chosen by minimum description length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.session import spread

# What can stand before a value as a list mark or number.
MARK = r"(?:[•▪·‣◦●○■]+|[-–—*+]+(?=\s)|\[\*\]|\(\d{1,3}\)|\[\d{1,3}\]|\d{1,3}[.)](?=\s)|\([a-z]\)|[a-z]\)(?=\s))"
LEADING = re.compile(rf"\s*{MARK}\s*")
NOTHING = re.compile(rf"(?:{MARK}|[-–—*+;,|\s])*")
QUOTES = {'"': '"', "„": "“”", "“": "”", "»": "«", "«": "»", "‚": "‘"}

#: Bits of a character that stays in a value, of a value boundary never seen, of a further value.
CHAR, UNSEEN, VALUE = 4.5, 18.0, 1.0
#: Further bits, at most, of a sign of structure that stays inside a value, outside quotes and brackets.
RESIDUE = 14.0
#: Signs that also occur as text: their bits are learned from the cells that another sign separates.
LEARNED = ";,/+"
#: The learned bits of ; / and + are no fewer: mixed cells, where these part values, blur their count.
LEAST_RESIDUE = 7.0
CONTINUED = re.compile(r"\r?\n(?=(?:  |\t)\s*[^\s\-–—•▪·*])")
STRUCTURE = re.compile(r"\n|\t|\||•|▪|;|\[\*\]|,(?= )|(?<= )[/+](?= )")
STRONG = re.compile(r"\n|\t|\||•|▪|\[\*\]")

#: Separator of each dialect, and the bits to name the dialect.
DIALECTS: dict[str, tuple[re.Pattern | None, float]] = {
    "one": (None, 1.0),
    "line": (re.compile(r"(?:\r\n|\r|\n)(?!(?:  |\t)\s*[^\s\-–—•▪·*])"), 3.0),
    "blank": (re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"), 4.0),
    "semicolon": (re.compile(";"), 3.0),
    "comma": (re.compile(r",(?!\d)"), 4.0),
    "pipe": (re.compile(r"\|{1,2}"), 3.0),
    "slash": (re.compile(r"(?<=\s)/(?=\s)"), 4.0),
    "plus": (re.compile(r"(?<=\s)\+(?=\s)"), 4.0),
    "tab": (re.compile(r"\t+"), 4.0),
    "bullet": (re.compile(r"(?:^|(?<=\s))[•▪·●■◦‣](?=\s|\w)"), 4.0),
    "dash": (re.compile(r"(?:^|(?<=\s))[-–*](?=\s)"), 5.0),
    "box": (re.compile(r"\[\*\]"), 3.0),
    "(1)": (re.compile(r"(?:^|(?<=\s))\((\d{1,3})\)(?=\s)"), 4.0),
    "[1]": (re.compile(r"(?:^|(?<=\s))\[(\d{1,3})\](?=\s)"), 4.0),
    "1.": (re.compile(r"(?:^|(?<=\s))(\d{1,3})\.(?=\s)"), 4.0),
    "1)": (re.compile(r"(?:^|(?<=\s))(\d{1,3})\)(?=\s)"), 4.0),
    "a)": (re.compile(r"(?:^|(?<=\s))\(?([a-z])\)(?=\s)"), 4.0),
    "any": (re.compile(r"(?:\r\n|\r|\n)(?!(?:  |\t)\s*[^\s\-–—•▪·*])|;|\|{1,2}|\t"), 4.0),
}
#: Signs of which a cell needs one to be parted by a dialect.
HINTS = {
    "line": "\r\n", "blank": "\r\n", "semicolon": ";", "comma": ",", "pipe": "|", "slash": "/", "plus": "+", "tab": "\t", "bullet": "•▪·●■◦‣", "dash": "-–*", "box": ["[*]"],
    "(1)": ["(1)"], "[1]": ["[1]"], "1.": ["1."], "1)": ["1)"], "a)": ["a)"], "any": "\r\n;|\t",
}
ENCLOSING = re.compile("[()\\[\\]" + "".join(QUOTES) + "]")
TOKEN = re.compile(r"\w+(?:-\w+)*-?|[^\w\s]")


#: Tokens of a value's start and end that its signatures look at, and of the shorter signature.
STARTS, ENDS, SHORT = 3, 3, 2


@lru_cache(maxsize=65_536)
def shape(token: str) -> str:
    """One of some forty classes: so signatures of at most three tokens are of a bounded number."""
    if token[0].isalpha():
        if token[0].islower():
            return token if token in ("und", "der", "die", "des", "im", "in", "zur", "zu", "von", "für", "bei", "mit") else "x"
        return "X" if len(token) == 1 else "Xx"
    if token[0].isdigit():
        return "9999" if len(token) == 4 else "9"
    return token if token in ".,:;()&/-–\"'„“?!%" else "?"


def first_shapes(value: str) -> list[str]:
    return [shape(m.group()) for m in islice(TOKEN.finditer(value), STARTS)]


def last_shapes(value: str) -> list[str]:
    size = 64
    while True:
        # with more tokens than are wanted, the first of which may be cut, the last ones are whole
        found = TOKEN.findall(value[-size:])
        if len(found) > ENDS or size >= len(value):
            return list(map(shape, found[-ENDS:]))
        size *= 8


def signatures(value: str) -> tuple[str, str, str, str]:
    """How a value starts and ends, each long and short."""
    a, b = first_shapes(value), last_shapes(value)
    return " ".join(a), " ".join(a[:SHORT]), " ".join(b), " ".join(b[-SHORT:])


def protected(text: str) -> bytearray:
    """1 at every position inside quotes or matched brackets. A quote opens only at the
    start of a word and must close before one ends; an opening sign without its partner
    protects nothing."""
    mask = bytearray(len(text))
    opened = -1
    stack: list[tuple[str, int]] = []
    brackets = []
    for m in ENCLOSING.finditer(text):
        i, sign = m.start(), m.group()
        if i <= opened:
            continue
        closing = QUOTES.get(sign)
        if closing and (i == 0 or not text[i - 1].isalnum()):
            j = closing_quote(text, i, closing)
            if j:
                mask[i : j + 1] = b"\1" * (j + 1 - i)
                opened = j
                continue
        if sign in "()[]":
            brackets.append((i, sign))
    for i, sign in brackets:
        if sign in "([":
            stack.append((sign, i))
        elif stack and stack[-1][0] == "(["[sign == "]"]:
            _, j = stack.pop()
            if not stack:
                mask[j : i + 1] = b"\1" * (i + 1 - j)
    return mask


def closing_quote(text: str, at: int, closing: str) -> int:
    """Where the quote that opens at ``at`` closes, 0 if nowhere; a doubled straight quote is a sign of the text."""
    j = at + 1
    while j < len(text):
        j = min((k for k in (text.find(c, j) for c in closing) if k >= 0), default=-1)
        if j < 0:
            return 0
        if text[at] != '"' or text[j + 1 : j + 2] != '"':
            return j
        j += 2
    return 0


def strip_value(raw: str) -> str:
    """A value without marks, enclosing quotes and separators; white space as one blank."""
    v = " ".join(raw.split()).strip(";|\t ")
    if NOTHING.fullmatch(v):
        return ""
    if v.endswith(","):
        v = v[:-1].rstrip()
    while (m := LEADING.match(v)) and m.end() < len(v) and not (v[0].isalpha() and v[1:2] != ")"):
        v = v[m.end() :].strip()
    closing = QUOTES.get(v[:1])
    if closing and len(v) > 1 and v[-1] in closing:
        inner = v[1:-1]
        plain = inner.replace('""', "") if v[0] == '"' else inner
        if v[0] not in plain and not any(c in plain for c in closing) or v[0] == '"' and '"' not in plain:
            v = (inner.replace('""', '"') if v[0] == '"' else inner).strip()
    return v


def parts_of(text: str, dialect: str, mask: bytearray) -> list[tuple[int, int]]:
    """Where the parts of a cell lie under a dialect."""
    separator, _ = DIALECTS[dialect]
    if separator is None or not any(h in text for h in HINTS[dialect]):
        return [(0, len(text))]
    at, parts, expected = 0, [], None
    for m in separator.finditer(text):
        if separator.groups:
            label = m.group(1)
            follows = label == expected if expected else label in ("1", "a") and not text[: m.start()].strip()
            if not follows:
                continue
            expected = chr(ord(label) + 1) if label.isalpha() else str(int(label) + 1)
        elif dialect != "box" and mask[m.start()]:
            continue
        parts.append((at, m.start()))
        at = m.end()
    return [*parts, (at, len(text))]


def parse(text: str, dialect: str) -> list[str]:
    """The values of a cell under a dialect."""
    return [v for a, b in parts_of(text, dialect, protected(text)) if (v := strip_value(text[a:b]))]


class Codes:
    """Code lengths of value boundaries, from how often fields start and end that way."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        self.n: dict[tuple[str, str], int] = {}
        self.c: dict[tuple[str, str, str], int] = {}
        self.known: dict[tuple[str, str, str], float] = {}
        for field, kind, signature, n in counts:
            self.c[field, kind, signature] = n
            self.n[field, kind] = self.n.get((field, kind), 0) + n

    def bits(self, field: str, kind: str, long: str, short: str) -> float:
        known = self.known.get((field, kind, long))
        if known is not None:
            return known

        def share(k: str, s: str) -> float:
            return self.c.get((field, k, s), 0) / self.n.get((field, k), 1)

        p = 0.75 * share(kind, long) + 0.25 * share(kind + "1", short)
        # what few cells have not shown is no news: it costs little more than the rarest thing they have
        unseen = min(UNSEEN, 5.0 + log2(self.n.get((field, kind), 0) + 1))
        self.known[field, kind, long] = bits = min(unseen, -log2(p)) if p > 0 else unseen
        return bits

    def residue(self, field: str, sign: str) -> float:
        """Bits of a sign left inside a value: by how often it stands among the words of cells separated by others."""
        if sign not in LEARNED:
            return RESIDUE
        seen, words = self.c.get((field, "r", sign), 0), self.c.get((field, "r", "words"), 0)
        return min(RESIDUE, max(-log2((seen + 0.01) / (words + 1)), 0.0 if sign == "," else LEAST_RESIDUE))

    def length(self, field: str, value: str) -> float:
        start, start1, end, end1 = signatures(value)
        return CHAR * len(value) + VALUE + self.bits(field, "s", start, start1) + self.bits(field, "e", end, end1)


def best_parse(field: str, text: str, codes: Codes) -> tuple[str, list[str]]:
    """The cheapest dialect of a cell and its values."""
    text = CONTINUED.sub(" ", text)
    mask = protected(text)
    residues = [(m.start(), codes.residue(field, m.group())) for m in STRUCTURE.finditer(text) if not mask[m.start()]]
    known: dict[tuple[int, int], tuple[str, float]] = {}

    def priced(a: int, b: int) -> tuple[str, float]:
        if (a, b) not in known:
            v = strip_value(text[a:b])
            inner_from = a + max(0, text[a:b].find(v[:8])) if v else b
            inner_to = a + len(text[a:b].rstrip(";,|\t\r\n "))
            known[a, b] = v, (codes.length(field, v) + sum(bits for i, bits in residues if inner_from <= i < inner_to) if v else 0.0)
        return known[a, b]

    best: tuple[float, str, list[str]] | None = None
    seen: set[tuple[tuple[int, int], ...]] = set()
    for name, (_, named) in DIALECTS.items():
        parts = tuple(parts_of(text, name, mask))
        if parts in seen:
            continue
        seen.add(parts)
        cost, found = named, []
        for a, b in parts:
            v, bits = priced(a, b)
            if v:
                cost += bits + (0.1 if name == "any" else 0)
                found.append(v)
                if best is not None and cost >= best[0]:
                    break
        else:
            if found:
                best = (cost, name, found)
    return best[1:] if best else ("one", [])


def count_cell(field: str, text: str, counts: dict[tuple[str, str, str], int]) -> None:
    """Adds to ``counts`` how a cell starts and ends, and its signs that may be text."""
    pieces = [v for v in map(strip_value, re.split(r"[\r\n]+", text)) if v]
    if not pieces:
        return
    first, last = signatures(pieces[0]), signatures(pieces[-1])
    seen = [("s", first[0]), ("s1", first[1]), ("e", last[2]), ("e1", last[3])]
    if STRONG.search(text.strip()):
        mask = protected(text)
        seen += [("r", m.group()) for m in STRUCTURE.finditer(text) if m.group() in LEARNED and not mask[m.start()]]
        counts[field, "r", "words"] = counts.get((field, "r", "words"), 0) + len(text.split())
    for kind, signature in seen:
        counts[field, kind, signature] = counts.get((field, kind, signature), 0) + 1


def boundary_counts(cells: DataFrame) -> DataFrame:
    """``feld, art, sig, n``: how the cells (feld, text) of each field start and end.

    The first value of a cell starts where the cell starts and the last ends where it
    ends, whatever the dialect, so these counts need no parse. They are aggregated
    map-side; signatures are tuples of at most three of some forty classes, so there are
    fewer than 70,000 a field and kind whatever the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str, str], int] = {}
            for field, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count_cell(field, text, counts)
            columns = list(zip(*((*k, n) for k, n in counts.items()))) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["feld", "art", "sig", "n"])

    return cells.mapInArrow(run, "feld string, art string, sig string, n bigint").groupBy("feld", "art", "sig").agg(F.sum("n").alias("n"))


def unpack(df: DataFrame, key: str, fields: list[str], least: int = 2) -> DataFrame:
    """One row per value of every packed cell: ``key, feld, pos, wert, dialekt``.

    Every cell is parsed under each delimiter-and-quote dialect; the parse with the
    shortest description is kept: bits to name the dialect, for the characters of the
    values without separators, marks and quotes, and for each value's start and end,
    whose code lengths come from a distributed count over all cells of the field. A wrong
    split makes values that start or end as no cell of the field does.

    ``pos`` counts from 1. Only cells with at least ``least`` values are returned.

    Scale: two passes over the cells, no shuffle of texts but one to spread them; the
    model that is broadcast has all signatures, which are of a bounded number (see ``shape``).

    Defined cases: null, empty and blank cells, and cells of marks only, give no rows;
    text in quotes or matched brackets is not split; an unmatched quote or bracket
    protects nothing; doubled quotes inside an enclosed value become single; values that
    repeat in a cell stay repeated; repeated rows of ``df`` stay repeated; running text
    and lists of one are one value; an empty table gives no rows; other columns are
    ignored. Cells of any length are parsed whole.
    """
    kind = df.schema[key].dataType.simpleString()
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feld"), F.col(f).alias("text")) for f in fields]))
    cells = df.select(F.col(key).alias("k"), named.alias("c")).select("k", "c.feld", "c.text").where("trim(text) <> ''")
    model = df.sparkSession.sparkContext.broadcast([tuple(r) for r in boundary_counts(cells.select("feld", "text")).collect()])
    built: dict[int, Codes] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = built.setdefault(0, Codes(model.value))
        for batch in batches:
            keys, pos, fields_, values, dialects, take = batch.column(0), [], [], [], [], []
            for i, (field, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                dialect, found = best_parse(field, text, codes)
                if len(found) >= least:
                    take += [i] * len(found)
                    pos += range(1, len(found) + 1)
                    fields_ += [field] * len(found)
                    values += found
                    dialects += [dialect] * len(found)
            arrays = [keys.take(pa.array(take, pa.int32())), pa.array(fields_, pa.string()), pa.array(pos, pa.int64()), pa.array(values, pa.string()), pa.array(dialects, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "feld", "pos", "wert", "dialekt"])

    return spread(cells).mapInArrow(run, f"k {kind}, feld string, pos bigint, wert string, dialekt string").withColumnRenamed("k", key)
