"""Markup residue in text documents: layout-aware rendering to blocks of clean text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.session import spread

HEADING, PARAGRAPH, ITEM, CODE, FORMULA = "ueberschrift", "absatz", "listenpunkt", "code", "formel"
Block = tuple[str, str]

# Fixed values of the HTML standard: elements without content, blocks, hidden elements, and
# which open elements a start tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figure footer form header hr html main nav ol p section table tbody td tfoot th thead tr ul li h1 h2 h3 h4 h5 h6 pre".split())
HIDDEN = {"script", "style", "head", "template", "noscript", "title"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(equation|align|displaymath|gather)(\*?)\}(.+?)\\end\{\3\4\}", re.S)
TAGS = r"(?:ul|ol|li|p|h[1-6]|div|span|em|i|b|u|s|strong|a|br|hr|pre|code|table|tr|td|th|thead|tbody|dl|dt|dd|sub|sup|blockquote|img|font|center|section|article|script|style)"


def plain(text: str) -> str:
    """White space as one blank, trimmed; soft hyphens and zero-width signs go."""
    return " ".join(re.sub("[\u00ad\u200b\ufeff]", "", text).split())


def code_lines(text: str) -> str:
    """Code with its lines and indentation, without the line ends around it."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\A(?:[ \t]*\n)+", "", text).rstrip()


def with_formulas(text: str, art: str) -> list[Block]:
    """A run of text as blocks: display formulas are blocks of their own."""
    out: list[Block] = []
    at = 0
    for m in DISPLAY.finditer(text):
        out += [(art, text[at : m.start()]), (FORMULA, next(g for g in (m.group(1), m.group(2), m.group(5)) if g))]
        at = m.end()
    out.append((art, text[at:]))
    return [(a, v) for a, v in ((a, plain(v)) for a, v in out) if v]


# ---------------------------------------------------------------- HTML


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    @property
    def hidden(self) -> bool:
        style = (self.attrs.get("style") or "").replace(" ", "").lower()
        return self.tag in HIDDEN or "hidden" in self.attrs or "display:none" in style or "visibility:hidden" in style


class TreeBuilder(HTMLParser):
    """A tree from tags as they come: end tags are implied, stray ones are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.open = [self.root]

    def close_to(self, tags: set[str], within: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in IMPLIED:
            self.close_to(*IMPLIED[tag])
        if tag in BLOCKS and tag not in ("html", "body"):
            self.close_to({"p"}, {"table", "td", "th", "li", "blockquote", "div"})
        if re.fullmatch(r"h[1-6]", tag):
            self.close_to({"h1", "h2", "h3", "h4", "h5", "h6"}, {"td", "th", "div", "li"})
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def raw_text(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else raw_text(c) for c in node.children if isinstance(c, str) or not c.hidden)


class Renderer:
    """Walks a tree and collects the visible text block by block."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.run: list[str] = []

    def flush(self, art: str) -> None:
        self.blocks += with_formulas("".join(self.run), art)
        self.run = []

    def walk(self, node: Node, art: str) -> None:
        for c in node.children:
            if isinstance(c, str):
                self.run.append(c)
                continue
            tag = c.tag
            if c.hidden:
                continue
            if tag in ("br", "wbr"):
                self.run.append("\n" if tag == "br" else "")
            elif tag == "img":
                self.run.append(c.attrs.get("alt") or "")
            elif tag in ("pre", "listing", "xmp") or tag == "code" and "\n" in raw_text(c).strip() and node.tag != "pre":
                self.flush(art)
                if code := code_lines(raw_text(c)):
                    self.blocks.append((CODE, code))
            elif tag in ("math",) or "math" in (c.attrs.get("class") or "").split() and tag in BLOCKS:
                self.flush(art)
                inner = raw_text(c).strip()
                m = DISPLAY.fullmatch(inner)
                inner = plain(next(g for g in (m.group(1), m.group(2), m.group(5)) if g) if m else inner)
                if inner:
                    self.blocks.append((FORMULA, inner))
            elif tag == "tr":
                self.flush(art)
                cells = []
                for cell in c.children:
                    if not isinstance(cell, str) and cell.tag in ("td", "th") and not cell.hidden:
                        inner = Renderer()
                        inner.walk(cell, art)
                        inner.flush(art)
                        cells.append(" ".join(v for _, v in inner.blocks))
                if any(cells):
                    self.blocks.append((PARAGRAPH, plain(" | ".join(cells))))
            elif tag in BLOCKS:
                self.flush(art)
                inner_art = HEADING if re.fullmatch(r"h[1-6]", tag) else ITEM if tag in ("li", "dd", "dt") else art if art == ITEM and tag in ("p", "div", "section") else PARAGRAPH
                self.walk(c, inner_art)
                self.flush(inner_art)
            else:
                self.walk(c, art)


def from_html(text: str) -> list[Block]:
    builder = TreeBuilder()
    builder.feed(text)
    builder.close()
    renderer = Renderer()
    renderer.walk(builder.root, PARAGRAPH)
    renderer.flush(PARAGRAPH)
    return renderer.blocks


# ---------------------------------------------------------------- Markdown

ESCAPED = re.compile(r"\\([\\`*_{}\[\]()#+\-.!<>~|$&\"'])")


def markdown_inline(text: str) -> str:
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue000{len(kept) - 1}\ue001"

    text = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: keep(m.group(2).strip()), text, flags=re.S)
    text = ESCAPED.sub(lambda m: keep(m.group(1)), text)
    text = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", text)
    text = re.sub(rf"</?{TAGS}\b[^>]*>|<!--.*?-->", lambda m: " " if m.group().startswith("<br") else "", text, flags=re.S | re.I)
    text = re.sub(r"!?\[((?:[^\[\]]|\[[^\]]*\])*)\]\((?:[^()\s]|\([^)]*\))*(?:\s+\"[^\"]*\")?\)", r"\1", text)
    text = re.sub(r"!?\[([^\[\]]+)\]\[[^\]]*\]", r"\1", text)
    for mark in (r"\*\*\*", r"\*\*", r"\*"):
        text = re.sub(rf"(?<!\*){mark}(?=[^\s*])(.+?)(?<=[^\s*]){mark}(?!\*)", r"\1", text, flags=re.S)
    for mark in ("___", "__", "_"):
        text = re.sub(rf"(?<![\w_]){mark}(?=[^\s_])(.+?)(?<=[^\s_]){mark}(?![\w_])", r"\1", text, flags=re.S)
    text = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", text)
    text = html.unescape(text)
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], text)


BULLET = re.compile(r"( {0,3}|\t)([-*+•]|\d{1,3}[.)])(?:[ \t]+(.*)|$)")


def from_markdown(text: str) -> list[Block]:
    lines = text.split("\n")
    blocks: list[Block] = []
    run: list[str] = []
    art = PARAGRAPH

    def flush() -> None:
        nonlocal run, art
        for kind, v in with_formulas("\n".join(run), art):
            v = v if kind == FORMULA else plain(markdown_inline(v))
            if v:
                blocks.append((kind, v))
        run, art = [], PARAGRAPH

    i, blank, listed = 0, True, False
    while i < len(lines):
        line = lines[i]
        fence = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if fence:
            flush()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence.group(1)) and not lines[j].strip().strip(fence.group(1)[0])), len(lines))
            if code := code_lines("\n".join(lines[i + 1 : end])):
                blocks.append((CODE, code))
            i, blank, listed = end + 1, True, False
            continue
        if not line.strip():
            flush()
            blank = True
            i += 1
            continue
        if line.lstrip().startswith("$$") and "$$" not in line.lstrip()[2:]:
            end = next((j for j in range(i + 1, len(lines)) if "$$" in lines[j]), len(lines) - 1)
            flush()
            run = lines[i : end + 1]
            flush()
            i = end + 1
            continue
        item = BULLET.match(line) or (listed and re.match(r"(\s+)([-*+•]|\d{1,3}[.)])(?:\s+(.*)|$)", line))
        if blank and not item and re.match(r"(?: {4}|\t)", line) and not run and not (listed and re.match(r"\s{4,}[-*+\d]", line)):
            end = i
            while end < len(lines) and (not lines[end].strip() or re.match(r"(?: {4}|\t)", lines[end])):
                end += 1
            code = code_lines("\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[i:end]))
            blocks.append((CODE, code))
            i, blank, listed = end, True, False
            continue
        heading = re.match(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", line)
        if heading:
            flush()
            run, art = [heading.group(2)], HEADING
            flush()
            listed = False
        elif run and art == PARAGRAPH and re.fullmatch(r" {0,3}(?:=+|-{2,}) *", line):
            art = HEADING
            flush()
            listed = False
        elif re.fullmatch(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})", line):
            flush()
        elif item:
            flush()
            art, run, listed = ITEM, [item.group(3) or ""], True
        elif re.fullmatch(r"\s*\|?(?:\s*:?-{2,}:?\s*\|)+\s*(?::?-{2,}:?\s*)?", line):
            flush()
        elif re.fullmatch(r"\s*\|.*\|\s*", line):
            flush()
            run = [" | ".join(c.strip() for c in line.strip().strip("|").split("|"))]
            flush()
        else:
            run.append(re.sub(r"^\s{0,3}>\s?", "", line))
            listed = listed and art == ITEM
        blank = False
        i += 1
    flush()
    return blocks


# ---------------------------------------------------------------- MediaWiki


def wiki_inline(text: str) -> str:
    text = re.sub(r"<!--.*?-->|<ref\b[^>]*/>|<ref\b.*?</ref>", "", text, flags=re.S)
    while (t := re.sub(r"\{\{[^{}]*\}\}", "", text)) != text:
        text = t
    text = re.sub(r"\[\[(?:Datei|File|Bild|Image|Kategorie|Category):[^\]]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+\s+([^\]]*)\]", r"\1", text)
    text = re.sub(r"'{5}|'{3}|'{2}", "", text)
    text = re.sub(r"<br\s*/?>", " ", text)
    text = re.sub(r"</?(?:nowiki|small|big|sub|sup|span|div|b|i|u|s|center|code)\b[^>]*>", "", text)
    return html.unescape(text)


def from_wiki(text: str) -> list[Block]:
    blocks: list[Block] = []
    run: list[str] = []

    def flush(art: str = PARAGRAPH) -> None:
        nonlocal run
        if v := plain(wiki_inline("\n".join(run))):
            blocks.append((art, v))
        run = []

    special = re.compile(r"<(pre|syntaxhighlight|source|math)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
    at = 0
    for m in [*special.finditer(text), None]:
        for line in text[at : m.start() if m else len(text)].split("\n"):
            heading = re.fullmatch(r"\s*(={1,6})\s*(.*?)\s*\1\s*", line)
            listed = re.match(r"[*#:;]+\s*(.*)", line)
            if not line.strip():
                flush()
            elif heading:
                flush()
                run = [heading.group(2)]
                flush(HEADING)
            elif listed:
                flush()
                run = [listed.group(1)]
                flush(ITEM)
            elif re.match(r"\s*(?:\{\||\|\}|\|-|__\w+__\s*$|-{4,})", line):
                flush()
            elif re.match(r"\s*[|!]", line):
                flush()
                run = [" | ".join(re.split(r"\s*(?:\|\||!!)\s*", line.strip()[1:].strip()))]
                flush()
            else:
                run.append(line)
        if m:
            flush()
            tag, inner = m.group(1).lower(), m.group(2)
            value = plain(inner) if tag == "math" else code_lines(html.unescape(inner) if tag == "pre" else inner)
            if value:
                blocks.append((FORMULA if tag == "math" else CODE, value))
            at = m.end()
    flush()
    return blocks


# ---------------------------------------------------------------- LaTeX

# Combining signs of accent commands, and commands that stand for a sign.
ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "c": "\u0327", "v": "\u030c", "r": "\u030a"}
SIGNS = {"ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "aa": "å", "l": "ł", "i": "ı", "euro": "€", "S": "§", "dots": "…", "ldots": "…", "textbackslash": "\\", "textasciitilde": "~", "textgreater": ">", "textless": "<", "quad": " ", "qquad": " ", "LaTeX": "LaTeX", "TeX": "TeX"}


def latex_inline(text: str) -> str:
    import unicodedata

    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue000{len(kept) - 1}\ue001"

    text = re.sub(r"(?<!\\)%.*?(?:\n\s*|\Z)", "", text)
    text = re.sub(r"\\verb\*?([^\w\s])(.*?)\1", lambda m: keep(m.group(2)), text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text)
    text = re.sub(r"\\([&%$#_{}])", lambda m: keep(m.group(1)), text)
    text = re.sub(r"""\\(["'`^~])\s*(?:\{(\\?[A-Za-zıı])\}|([A-Za-z]))""", lambda m: unicodedata.normalize("NFC", (m.group(2) or m.group(3)).lstrip("\\") + ACCENTS[m.group(1)]), text)
    text = re.sub(r"\\([cvr])\{([A-Za-z])\}", lambda m: unicodedata.normalize("NFC", m.group(2) + ACCENTS[m.group(1)]), text)
    text = re.sub(r"\\([A-Za-z]+)(?:\{\}|\s+|(?![A-Za-z]))", lambda m: SIGNS[m.group(1)] if m.group(1) in SIGNS else m.group(), text)
    text = re.sub(r"(?<!\\)\$(.+?)(?<!\\)\$|\\\((.+?)\\\)", lambda m: keep((m.group(1) or m.group(2)).strip()), text, flags=re.S)
    text = re.sub(r"\\(?:label|ref|cite|index|vspace|hspace|pagestyle|input|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\(?:href|textcolor)\{[^{}]*\}", "", text)
    text = re.sub(r"\\[,;:! ]|\\(?:noindent|newline|linebreak|newpage|clearpage|centering|bfseries|itshape|small|large|Large|par)\b\s*", " ", text)
    while (t := re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)) != text:
        text = t
    text = re.sub(r"\\[A-Za-z]+\*?\s?", "", text)
    text = re.sub(r"[{}]", "", text).replace("~", " ").replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”")
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], text)


def braced(text: str, at: int) -> int:
    """The end of the group that opens at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in "{}" and (i == 0 or text[i - 1] != "\\"):
            depth += 1 if text[i] == "{" else -1
            if depth == 0:
                return i
    return len(text)


def from_latex(text: str) -> list[Block]:
    blocks: list[Block] = []
    art, run, depth = PARAGRAPH, [], 0

    def flush() -> None:
        nonlocal run
        for part in re.split(r"\n[ \t]*\n", "".join(run)):
            if v := plain(latex_inline(part)):
                blocks.append((art, v))
        run = []

    token = re.compile(
        r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(?P<code>.*?)\\end\{\1\*?\}"
        r"|\\begin\{(?P<env>equation|align|displaymath|gather|eqnarray)(?P<star>\*?)\}(?P<eq>.*?)\\end\{(?P=env)(?P=star)\}"
        r"|\\\[(?P<disp>.+?)\\\]|\$\$(?P<dd>.+?)\$\$"
        r"|\\(?P<head>chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]]*\])?\{"
        r"|\\begin\{(?P<open>\w+)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?|\\end\{(?P<close>\w+)\*?\}|\\item\b(?:\[[^\]]*\])?",
        re.S,
    )
    at = 0
    while m := token.search(text, at):
        run.append(text[at : m.start()])
        flush()
        at = m.end()
        if m.group("code") is not None:
            if code := code_lines(m.group("code")):
                blocks.append((CODE, code))
        elif (formula := m.group("eq") or m.group("disp") or m.group("dd")) is not None:
            if v := plain(re.sub(r"\\label\{[^}]*\}", "", formula)):
                blocks.append((FORMULA, v))
        elif m.group("head"):
            end = braced(text, m.end() - 1)
            if v := plain(latex_inline(text[m.end() : end])):
                blocks.append((HEADING, v))
            at = end + 1
        elif m.group("open") or m.group("close"):
            if (m.group("open") or m.group("close")) in ("itemize", "enumerate", "description", "compactitem"):
                depth += 1 if m.group("open") else -1
            art = PARAGRAPH
        else:
            art = ITEM
    run.append(text[at:])
    flush()
    return blocks


# ---------------------------------------------------------------- BBCode


def bb_inline(text: str) -> str:
    return re.sub(r"\[/?(?:b|i|u|s|size|color|font|url|email|center|quote|sub|sup|left|right|img|h\d)(?:=[^\]]*)?\]", "", text, flags=re.I)


def from_bbcode(text: str) -> list[Block]:
    blocks: list[Block] = []
    art, at = PARAGRAPH, 0

    def emit(run: str) -> None:
        nonlocal art
        for part in re.split(r"\n[ \t]*\n", run):
            blocks.extend(with_formulas(bb_inline(part), art))

    for m in re.finditer(r"\[code(?:=[^\]]*)?\](?P<code>.*?)\[/code\]|\[(?:math|tex|latex)\](?P<math>.*?)\[/(?:math|tex|latex)\]|\[h(?:\d|eading)\](?P<head>.*?)\[/h(?:\d|eading)\]|\[(?P<list>/?list)(?:=[^\]]*)?\]|\[\*\]", text, re.S | re.I):
        emit(text[at : m.start()])
        at = m.end()
        if m.group("code") is not None:
            if code := code_lines(m.group("code")):
                blocks.append((CODE, code))
        elif m.group("math") is not None:
            if v := plain(m.group("math")):
                blocks.append((FORMULA, v))
        elif m.group("head") is not None:
            if v := plain(bb_inline(m.group("head"))):
                blocks.append((HEADING, v))
        elif m.group("list"):
            art = PARAGRAPH
        else:
            art = ITEM
    emit(text[at:])
    return blocks


# ---------------------------------------------------------------- which markup

HTML = re.compile(rf"<(?:/?{TAGS}\b[^<>]*|!--.*?--)>", re.I | re.S)
HTML_ESCAPED = re.compile(rf"&lt;/?{TAGS}\b(?:(?!&lt;).)*?&gt;", re.I | re.S)
WIKI = re.compile(r"^={1,6} ?[^=\n].*?={1,6}\s*$|'''?[^'\n]+'''?|\[\[[^\]\n]+\]\]|<(?:math|syntaxhighlight|source|nowiki)\b|^\{\|", re.M)
WIKI_ONLY = re.compile(r"\A(?:[*#] ?\S.*\n)*(?:# ?\S.*\n)+(?:# ?\S.*)(?:\n|\Z)|<pre>\n", re.M)
LATEX = re.compile(r"\\(?:begin|end)\{(?!equation|align|displaymath|gather|cases|pmatrix)|\\(?:chapter|(?:sub)*section|(?:sub)?paragraph|item|emph|text(?:bf|it|tt|sc)|underline|href|footnote)\b|\\\"\{?[aouAOU]|\\[%&#](?![\w;])|\\begin\{equation\}")
BBCODE = re.compile(r"\[\*\]|\[/(?:b|i|u|s|list|code|url|quote|size|color)\]", re.I)
MARKDOWN = re.compile(
    r"^ {0,3}#{1,6} \S|^ {0,3}[-*+•] +\S|^ {0,3}\d{1,3}[.)] +\S|^ {0,3}(?:```|~~~)|^\S.*\n {0,3}(?:={3,}|-{3,}) *$|^ {0,3}> |(?<!\*)\*{1,3}[^\s*](?:[^*\n]*[^\s*])?\*{1,3}(?!\*)|\]\([^)\s]*\)|\$\$.+?\$\$|(?<![\w_])_{1,2}[^\s_](?:[^_\n]*[^\s_])?_{1,2}(?![\w_])|`[^`\n]+`|\\[<>*_#\[\]]|~~\S",
    re.M,
)


def markup_of(text: str) -> str | None:
    """The markup a cell is written in, or None for plain text."""
    if HTML_ESCAPED.search(text) and not HTML.search(text):
        return "escaped"
    wiki, tags = len(WIKI.findall(text)), len(HTML.findall(text))
    if wiki and not re.search(r"<(?:ul|ol|li|p|h[1-6]|em|b|a|div)\b", text, re.I) and not re.search(r"\]\(", text):
        return "wiki"
    if re.search(r"<pre>\n", text) and not re.search(r"</?(?:ul|ol|li|p|h[1-6]|em|b|a|div|br)\b", text, re.I):
        return "wiki"
    if tags:
        return "html"
    if LATEX.search(text):
        return "latex"
    if BBCODE.search(text):
        return "bbcode"
    if WIKI_ONLY.search(text):
        return "wiki"
    if MARKDOWN.search(text):
        return "markdown"
    if re.search(r"&(?:amp|lt|gt|quot|nbsp|[aouAOU]uml|szlig|#\d+);", text):
        return "html"
    return None


RENDERERS = {"html": from_html, "wiki": from_wiki, "latex": from_latex, "bbcode": from_bbcode, "markdown": from_markdown}


def render(text: str | None) -> list[Block]:
    """The blocks of a cell in order; no blocks for null, blank and plain cells."""
    if not text or not text.strip():
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    kind = markup_of(text)
    for _ in range(3):
        if kind != "escaped":
            break
        text = html.unescape(text)
        kind = markup_of(text)
    return RENDERERS[kind](text) if kind in RENDERERS else []


def render_blocks(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per block of every cell with markup: ``key, feld, pos, art, wert``.

    HTML (also escaped once more), Markdown, MediaWiki, LaTeX and BBCode are told apart
    by their signs. HTML goes through a tree builder with implied end tags and rules of
    visibility; every renderer keeps headings, paragraphs, list items, code and formulas
    as blocks of their own, in order; table rows are paragraphs whose cells are parted
    by ``|``. ``pos`` counts from 1.

    Scale: one pass without a shuffle but the one that spreads the cells. A cell is
    rendered whole, in time linear in its length.

    Defined cases: null, empty, blank and plain cells give no rows; signs that look like
    markup but have no partner stay text; unclosed elements end with the cell; hidden
    elements and comments give nothing; repeated rows stay repeated; an empty table gives
    no rows; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feld"), F.col(f).alias("text")) for f in fields]))
    cells = df.select(F.col(key).alias("k"), named.alias("c")).select("k", "c.feld", "c.text").where("trim(text) <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, pos, arts, values = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                blocks = render(text)
                take += [i] * len(blocks)
                pos += range(1, len(blocks) + 1)
                arts += [a for a, _ in blocks]
                values += [v for _, v in blocks]
            at = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int64()), pa.array(arts, pa.string()), pa.array(values, pa.string())], ["k", "feld", "pos", "art", "wert"])

    return spread(cells).mapInArrow(run, f"k {kind}, feld string, pos bigint, art string, wert string").withColumnRenamed("k", key)


def visible_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text``: texts with markup rendered to one line per block, without code and
    formulas; plain texts as they are. Null texts stay null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                blocks = render(t)
                out.append("\n".join(v for a, v in blocks if a not in (CODE, FORMULA)) if blocks else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["k", "t"])

    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInArrow(run, f"k {kind}, t string").select(F.col("k").alias(key), F.col("t").alias(text))
