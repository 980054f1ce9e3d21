"""Per-document text quality statistics from associative partial counts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import floor
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.session import cut_lineage, spread

#: Characters of a chunk, about: it ends before a word, or inside a run without white space.
CHUNK = 65_536
#: Chunk states merged by one task in one level of the tree.
FAN = 64
#: Characters before and after a chunk that its signs may look at; first characters kept of a line, of a word.
BEHIND, AHEAD, FIRST = 3, 2, 16

# The most common words of German and English running text.
COMMON = set(
    "der die das und in zu den mit von für auf ist im dem nicht ein eine des als auch an werden aus sind sie wird bei nach zur zum über oder sich es "
    "the of and to a in is that for on as with are be by this it from an or we not at which their each when have has its".split()
)
CASED = COMMON | {w.capitalize() for w in COMMON} | {w.upper() for w in COMMON}
WORD = re.compile(r"\w+")
#: A list mark at the start of a line, white space as it stands or as one blank.
START = re.compile(r"[-–—•▪·*+◦‣●]\s*(?=\S)|\[(?:\s*|[xX])\]\s*(?=\S)|\[\d{1,3}\]\s|\(?\d{1,3}[.)]\s|\(?[a-z]\)\s")
INLINE = re.compile(r"[•▪·◦‣●](?:(?<=\s.)|(?<=^.))(?=\s)")
SENTENCE = re.compile(r"[.!?](?:(?<=[a-zäöüß0-9)].)(?=\s+[A-ZÄÖÜ„\"(])|(?<=\w\w\w.)(?=[^\S\r\n]*(?:[\r\n]|\Z)))")
#: Signs counted by line. Whether one stands at a place is seen from at most BEHIND characters before it and AHEAD after it.
SIGNS = {"tab": re.compile("\t"), "strich": re.compile(r"\|"), "semikolon": re.compile(";"), "zitat": re.compile('"(?=,")'), "spalten": re.compile(r"(?<=\S)(?: {2,}|\t)(?=\S)"), "komma": re.compile(r",(?=\S)")}
HINTS = {"tab": "\t", "strich": "|", "semikolon": ";", "zitat": '","', "spalten": "  ", "komma": ","}
#: How many of a sign a line needs to count as one of cells.
LEAST = {"tab": 1, "strich": 2, "semikolon": 2, "zitat": 1, "spalten": 1, "komma": 2}
BREAK = re.compile("\r\n|\n|\r|\u2028|\x85")
SEEN = re.compile(r"\S")
#: Signs of words that are no letters.
PLAIN = re.compile("[\\d_²³¹¼-¾⁰-₉⅐-↏①-⓿]")
VOWELS = "aeiouyäöüAEIOUYÄÖÜáàâéèêëíìîïóòôúùûœæøå"

#: Counts of a text, all additive. wiederholt: words equal to the one before them.
COUNTS = ["zeichen", "leer", "buchstaben", "vokale", "woerter", "wortzeichen", "haeufig", "lang", "wiederholt", "zeilen", "marken", "markenzeichen", "klein", "satzende", "saetze", "einzeilig", *SIGNS]
#: A word is long beyond so many letters; the modulus of the words' hashes.
LONG, PRIME = 48, (1 << 61) - 1


# ------------------------------------------------------------ pieces of words


def piece(word: str) -> list:
    """A stretch of letters of any length as ``[length, first characters, hash]``."""
    return [len(word), word[:FIRST], int.from_bytes(word.encode("utf-32-be", "surrogatepass"), "big") % PRIME]


def glue(a: list, b: list) -> list:
    """The piece of two stretches one after the other."""
    return [a[0] + b[0], a[1] if a[0] >= FIRST else (a[1] + b[1])[:FIRST], (a[2] * pow(1 << 32, b[0], PRIME) + b[2]) % PRIME]


def count_word(p: list, counts: dict[str, int]) -> None:
    counts["woerter"] += 1
    counts["wortzeichen"] += p[0]
    counts["haeufig"] += p[0] <= FIRST and p[1] in CASED
    counts["lang"] += p[0] > LONG


# ------------------------------------------------------------ pieces of lines


def cut_line(whole: str, at: int, to: int) -> dict:
    """What is known of a line of which ``whole[at:to]`` is seen."""
    seen = whole[at:to]
    signs = {c: sum(1 for _ in sign.finditer(whole, at, min(len(whole), to + AHEAD))) - sum(1 for _ in sign.finditer(whole, to, min(len(whole), to + AHEAD))) for c, sign in SIGNS.items()}
    return {"zeichen": len("".join(seen.split())), "first": _start(seen), "last": seen.rstrip()[-1:], **signs}


def _start(seen: str) -> str:
    """The first FIRST characters of a line from its first visible one, white space as one blank."""
    out: list[str] = []
    for m in re.finditer(r"\s+|\S", seen.lstrip()):
        out.append(" " if m.group()[0].isspace() else m.group())
        if len(out) == FIRST:
            break
    return "".join(out)


def join_lines(a: dict, b: dict) -> dict:
    out = {c: a[c] + b[c] for c in ("zeichen", *SIGNS)}
    return {**out, "first": (a["first"] + b["first"])[:FIRST], "last": b["last"] or a["last"]}


def count_line(line: dict, counts: dict[str, int]) -> None:
    """Adds a whole line to the counts. Blank lines count for nothing."""
    if not line["last"]:
        return
    counts["zeilen"] += 1
    first = line["first"]
    if START.match(first.rstrip()):
        counts["marken"] += 1
        counts["markenzeichen"] += line["zeichen"]
    elif first[0].islower():
        counts["klein"] += 1
    counts["satzende"] += line["last"] in ".!?"
    for c, least in LEAST.items():
        counts[c] += line[c] >= least


# ------------------------------------------------------------ states


class State:
    """Counts of a stretch of text: its whole lines and words, and what is cut at its ends.

    ``head`` is the piece of line before the first line end and ``tail`` that after the
    last (None without a line end: then ``head`` is both). ``lead`` is the piece of a word
    that began before the stretch, ``trail`` of one that goes on behind it, ``bridge`` the
    stretch if it lies within one word; ``first`` and ``last`` are its first and last whole
    words. Joining two stretches completes the line and the word between them, so that
    ``merge`` is associative and a text gives the same counts wherever it is cut.
    """

    __slots__ = ("bridge", "counts", "first", "head", "last", "lead", "tail", "trail")

    def __init__(self, counts: dict[str, int], head: dict, tail: dict | None, lead=None, trail=None, bridge=None, first=None, last=None):
        self.counts, self.head, self.tail = counts, head, tail
        self.lead, self.trail, self.bridge, self.first, self.last = lead, trail, bridge, first, last

    def flat(self) -> dict:
        return {x: getattr(self, x) for x in self.__slots__}

    def merge(self, other: State) -> State:
        a, b = self, other
        counts = {c: a.counts[c] + b.counts[c] for c in COUNTS}
        out = State(counts, a.head, b.tail)
        joined = join_lines(a.tail or a.head, b.head)
        if a.tail is None:
            out.head = joined
        elif b.tail is None:
            out.tail = joined
        else:
            count_line(joined, counts)
        out.lead, out.trail, out.first, out.last = a.lead, b.trail, a.first or b.first, b.last or a.last
        if a.bridge and b.bridge:
            out.bridge = glue(a.bridge, b.bridge)
        elif a.bridge:
            out.lead = glue(a.bridge, b.lead)
        elif b.bridge:
            out.trail = glue(a.trail, b.bridge)
        elif a.trail:
            word = glue(a.trail, b.lead)
            count_word(word, counts)
            counts["wiederholt"] += (a.last == word) + (word == b.first)
            out.first, out.last = a.first or word, b.last or word
        elif a.last and b.first:
            counts["wiederholt"] += a.last == b.first
        return out

    def total(self) -> dict[str, int]:
        """The counts of a whole text: its first and last lines are whole."""
        counts = dict(self.counts)
        count_line(self.head, counts)
        if self.tail:
            count_line(self.tail, counts)
        return counts


def cuts(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Chunks of about ``size`` characters: each ends before a visible character that follows
    white space or, if there is none, inside the run of visible ones (or behind the white
    space after it). One pass, whatever the length."""
    at, n = 0, len(text)
    while n - at > size:
        to = at + size
        while to > at and not (text[to - 1].isspace() and not text[to].isspace()):
            to -= 1
        if to == at:
            to = at + size
            if text[to].isspace():
                m = SEEN.search(text, to)
                to = m.start() if m else n
        yield at, to
        at = to
    if at < n or not n:
        yield at, n


def measure(before: str, text: str, after: str) -> State:
    """The state of a chunk as ``cuts`` makes it, given BEHIND characters before it and AHEAD after it."""
    counts = dict.fromkeys(COUNTS, 0)
    whole = before + text + after if before or after else text
    counts["zeichen"] = len(text)
    counts["leer"] = len(text) - sum(map(len, text.split()))
    counts["vokale"] = sum(map(text.count, VOWELS))
    words = WORD.findall(text)
    counts["buchstaben"] = sum(map(len, words)) - len(PLAIN.findall(text))
    start, end = len(before), len(before) + len(text)
    for name, sign in (("saetze", SENTENCE), ("einzeilig", INLINE)):
        if before or after:
            counts[name] = sum(m.start() < end for m in sign.finditer(whole, start))
        elif name == "saetze" or not text.isascii():
            counts[name] = len(sign.findall(text))
    # lines
    lines, at = [], start
    for m in BREAK.finditer(whole, start, end):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, end))
    hints = {c: h for c, h in HINTS.items() if h in text or (c == "spalten" and "\t" in text)}
    for a, b in lines[1:-1] if before or after else lines:
        _whole_line(whole[a:b], hints, counts)
    if not (before or after):
        # a whole text: nothing is cut
        _count_words(words, counts)
        return State(counts, _NOTHING, None)
    state = State(counts, cut_line(whole, *lines[0]), cut_line(whole, *lines[-1]) if len(lines) > 1 else None)
    opens = bool(words and WORD.match(before[-1:]) and WORD.match(text[0]))
    goes_on = bool(words and WORD.match(after[:1]) and WORD.match(text[-1]))
    if opens and goes_on and len(words) == 1 and len(words[0]) == len(text):
        state.bridge = piece(text)
        return state
    state.lead = piece(words[0]) if opens else None
    state.trail = piece(words[-1]) if goes_on else None
    inner = words[opens : len(words) - goes_on]
    _count_words(inner, counts)
    if inner:
        state.first, state.last = piece(inner[0]), piece(inner[-1])
    return state


_NOTHING = {"zeichen": 0, "first": "", "last": "", **dict.fromkeys(SIGNS, 0)}


def _count_words(words: list[str], counts: dict[str, int]) -> None:
    sizes = list(map(len, words))
    counts["woerter"] = len(words)
    counts["wortzeichen"] = sum(sizes)
    counts["haeufig"] = sum(map(CASED.__contains__, words))
    if sizes and max(sizes) > LONG:
        counts["lang"] = sum(n > LONG for n in sizes)
    counts["wiederholt"] = sum(map(eq, words, words[1:]))


def _whole_line(line: str, hints: dict[str, str], counts: dict[str, int]) -> None:
    """What ``count_line`` does, for a line that is seen as a whole."""
    shown = line.strip()
    if not shown:
        return
    counts["zeilen"] += 1
    if START.match(shown):
        counts["marken"] += 1
        counts["markenzeichen"] += sum(map(len, line.split()))
    elif shown[0].islower():
        counts["klein"] += 1
    if shown[-1] in ".!?":
        counts["satzende"] += 1
    for c, h in hints.items():
        if h in line or c == "spalten":
            counts[c] += len(SIGNS[c].findall(line)) >= LEAST[c]


def kind_of(c: dict[str, int]) -> str | None:
    """The rule outcome: ``prosa``, ``liste``, ``tabelle``, ``schrott``; None without text."""
    visible = c["zeichen"] - c["leer"]
    if visible <= 0:
        return None
    # a record that got stuck: one word over and over
    if c["woerter"] >= 8 and c["wiederholt"] > 0.4 * c["woerter"]:
        return "schrott"
    words, lines = max(1, c["woerter"]), max(1, c["zeilen"])
    letters, common = c["buchstaben"] / visible, c["haeufig"] / words
    columns = max(c["tab"], c["strich"], c["semikolon"], c["zitat"], c["spalten"], c["komma"]) / lines
    if c["zeilen"] >= 3 and columns >= 0.6 and common < 0.1 and c["wortzeichen"] / words > 1.7 and letters > 0.3:
        return "tabelle"
    if letters < 0.55 or c["vokale"] < 0.2 * c["buchstaben"] or c["wortzeichen"] / words > 25 or c["wortzeichen"] / words < 2.6:
        return "schrott"
    if c["zeichen"] > 60 and c["leer"] < 0.03 * c["zeichen"]:
        return "schrott"
    if c["lang"] and c["lang"] * LONG > 0.5 * visible:
        return "schrott"
    per_line = c["woerter"] / lines
    if c["einzeilig"] >= 4 and c["woerter"] / c["einzeilig"] <= 14:
        return "liste"
    if c["zeilen"] >= 4 and c["marken"] / lines >= 0.6 and c["markenzeichen"] >= 0.5 * visible:
        return "liste"
    broken = c["saetze"] - c["satzende"]
    if c["zeilen"] >= 4 and per_line <= 7.5 and broken <= 0.15 * lines and c["klein"] <= 0.5 * lines and (c["satzende"] in (0, c["zeilen"], c["zeilen"] - 1) or c["satzende"] >= 0.8 * lines):
        return "liste"
    if common < 0.04 and c["zeilen"] < 4 and c["woerter"] > 12:
        return "schrott"
    return "prosa"


STATS = "zeichen long, woerter long, mittlere_wortlaenge double, symbolanteil double, zeilen long, satzende_anteil double, haeufig_anteil double, marken_anteil double, spalten_anteil double, art string"


def describe(c: dict[str, int]) -> tuple:
    visible, words_, lines = c["zeichen"] - c["leer"], c["woerter"], c["zeilen"]
    share = lambda a, b: floor(a / b * 1e6 + 0.5) / 1e6 if b else None
    columns = max(c["tab"], c["strich"], c["semikolon"], c["zitat"], c["spalten"], c["komma"])
    return (
        c["zeichen"], words_, share(c["wortzeichen"], words_), share(visible - c["buchstaben"], visible), lines,
        share(c["satzende"], lines), share(c["haeufig"], words_), share(c["marken"], lines), share(columns, lines), kind_of(c),
    )


def text_statistics(df: DataFrame, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """Statistics and kind of every text: ``key`` and the columns of ``STATS``.

    Texts longer than ``chunk`` characters are split, once each; every chunk yields a state
    of counts whose cut lines and words are completed when states are joined. Joining is
    associative, so the states of a text are merged FAN at a time in a tree. One set of
    rules holds at every length: a text gives the same row whole and in chunks.

    Scale: one pass over the table makes the rows of short texts, nearly all, and the chunks
    of long ones; it is kept in the shared folder, so that no text is read twice. Only
    chunks are shuffled after it.

    Defined cases: a null text gives nought counts, null shares and null kind, so do
    empty and blank texts (but for their number of characters); repeated rows stay
    repeated (a text is merged by row, not by key); an empty table gives no rows; other
    columns are ignored. Texts of any length, and words of any length, are read whole.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))).withColumn("row", F.monotonically_increasing_id())
    parts = "before string, chunk string, after string"

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(2)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            done = _table(batch.column(0).take(pa.array(short, pa.int32())), [describe(measure("", texts[i], "").total()) for i in short])
            nothing = [pa.nulls(len(short), pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*done.columns, ids.take(pa.array(short, pa.int32())), pa.nulls(len(short), pa.int32()), *nothing], names)
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    k, row = batch.column(0).slice(i, 1), ids.slice(i, 1)
                    for nr, (a, b) in enumerate(cuts(t, chunk)):
                        seen = [pa.array([x], pa.string()) for x in (t[max(0, a - BEHIND) : a], t[a:b], t[b : b + AHEAD])]
                        yield pa.RecordBatch.from_arrays([k, *(pa.nulls(1, f) for f in done.schema.types[1:]), row, pa.array([nr], pa.int32()), *seen], names)

    names = ["k", *(x.split()[0] for x in STATS.split(", ")), "row", "i", "before", "chunk", "after"]
    seen = cut_lineage(rows.mapInArrow(once, f"k {kind}, {STATS}, row long, i int, {parts}"))
    out = seen.where("i is null").select(*names[:-5])
    long = seen.where("i is not null").select("k", "row", "i", "before", "chunk", "after")
    if not long.isEmpty():
        out = out.unionByName(_merge_tree(spread(long, "row", "i"), kind))
    return out.withColumnRenamed("k", key)


def _table(keys, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in STATS.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in STATS.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(columns, kinds))], ["k", *names])


def _merge_tree(chunks: DataFrame, kind: str) -> DataFrame:
    """States of chunks, merged FAN at a time, and at last described."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, t, a = (batch.column(i).to_pylist() for i in (3, 4, 5))
            states = [json.dumps(measure(x, y, z).flat()) for x, y, z in zip(b, t, a)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(states, pa.string())], ["k", "row", "i", "state"])

    def join(pdf):
        pdf = pdf.sort_values("i")
        states = [State(**json.loads(s)) for s in pdf["state"]]
        total = states[0]
        for s in states[1:]:
            total = total.merge(s)
        out = pdf[["k", "row", "i"]].iloc[:1].copy()
        out["i"] = out["i"] // FAN
        out["state"] = json.dumps(total.flat())
        return out

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table(batch.column(0), [describe(State(**json.loads(s)).total()) for s in batch.column(3).to_pylist()])

    schema = f"k {kind}, row long, i int, state string"
    states = chunks.mapInArrow(first, schema)
    most = chunks.agg(F.max("i")).first()[0] + 1
    while most > 1:
        states = states.withColumn("g", F.floor(F.col("i") / FAN)).groupBy("row", "g").applyInPandas(lambda g: join(g.drop(columns="g")), schema)
        most = -(-most // FAN)
    return states.mapInArrow(last, f"k {kind}, {STATS}")
