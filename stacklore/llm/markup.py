"""Problem 4: markup residue in text documents.

A document is cut into flat blocks: code regions, displayed formulas and single lines.
Each block has its word count, its link density and its leading mark, and the word count and
link density of the blocks before and after it. A decision tree trained on the small
labelled table below tells headings, list items, code, formulas, tables, rules, running
text, text with links and rows of links (navigation, badges) apart. From the classified blocks
readable text is put together that keeps headings, lists, code, formulas and tables
in one plain notation. Links are resolved in the blocks that the tree says have them; other
marks inside the running text (element 'inline') are resolved by patterns.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stacklore.llm.tree import DecisionTree

ELEMENTS = ("heading", "list", "code", "formula", "table", "link", "inline")

# What an HTML tag builds; any other tag is inline. Fixed values.
_TAGS = {
    "heading": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol li dl dt dd menu",
    "table": "table thead tbody tfoot tr td th caption colgroup col",
    "link": "a img",
    "code": "pre",
    "formula": "math mi mo mn mrow msup msub msubsup mfrac msqrt mroot mtext mstyle munder mover munderover mtable mtr mtd semantics annotation",
}
_BUILDS = {t: k for k, v in _TAGS.items() for t in v.split()}

_CODE = re.compile(
    r"^[ ]{0,3}(?P<fence>`{3,}|~{3,})[^\n]*\n?(?P<fenced>.*?)(?:^[ ]{0,3}(?P=fence)[`~]*[ \t]*$|\Z)"
    r"|<(?P<tag>pre|syntaxhighlight|source)\b[^>]*>(?P<tagged>.*?)(?:</(?P=tag)\s*>|\Z)"
    r"|\\begin\{(?P<env>verbatim\*?|lstlisting|minted|Verbatim)\}(?P<inside>.*?)(?:\\end\{(?P=env)\}|\Z)",
    re.M | re.S | re.I,
)
_FORMULA = re.compile(
    r"\$\$(?P<dollar>[^$]+?)\$\$"
    r"|\\\[(?P<square>(?:(?!\\[\[\]]).)+)\\\]|\\\((?P<round>(?:(?!\\[()]).)+)\\\)"
    r"|\\begin\{(?P<env>equation|align|gather|multline|eqnarray|displaymath|math)(?P<star>\*?)\}(?P<inside>.*?)(?:\\end\{(?P=env)(?P=star)\}|\Z)"
    r"|<math\b[^>]*>(?P<math>.*?)(?:</math\s*>|\Z)"
    r"|(?<![\\$\w])\$(?=[^\s$])(?P<one>[^$\n]*?[^\s$\\])\$(?![\d$])",
    re.S | re.I,
)
# Bodies stop at a second opening mark, so that unclosed marks do not make the search quadratic.
_LINK = re.compile(
    r"!?\[(?P<text>[^\[\]\n]*)\](?:\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[^()\n]*)?\)|\[[^\[\]\n]*\])"
    r"|\[\[(?:[^\[\]|\n]*\|)*(?P<wiki>[^\[\]|\n]+)\]\]"
    r"|\[(?:https?|ftp)://[^\s\]]+\s*(?P<outer>[^\[\]\n]*)\]"
    r"|\\href\{[^{}\n]*\}\{(?P<href>[^{}\n]*)\}|\\url\{(?P<url>[^{}\n]*)\}|\\includegraphics(?:\[[^\]\n]*\])?\{(?P<image>[^{}\n]*)\}"
    r"|<(?P<auto>(?:https?|ftp|mailto)://?[^\s<>]+)>"
    r"|^[ ]{0,3}\[(?P<ref>[^\[\]\n]+)\]:[ \t]*\S+[^\n]*$"
    r"|<a\b[^<>]*>|</a\s*>|<img\b[^<>]*>",
    re.M | re.I,
)
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|\{\{(?P<template>[^{}]*)\}\}"
    r"|(?<![`\\])(?P<tick>`+)(?!`)(?P<ticked>[^`\n]+)(?<!`)(?P=tick)(?!`)"
    r"|(?<!\\)\*\*(?=[^\s*])(?P<strong>[^*]*?[^\s*])\*\*"
    r"|(?<![\w*\\])\*(?=[^\s*])(?P<em>[^*\n]*?[^\s*])\*(?![\w*])"
    r"|(?<![\w\\])__(?=[^\s_])(?P<under2>(?:(?!__)[^\n])*?[^\s_])__(?!\w)"
    r"|(?<![\w\\])_(?=[^\s_])(?P<under>[^_\n]*?[^\s_])_(?!\w)"
    r"|(?<!\\)~~(?=[^\s~])(?P<strike>[^~]*?[^\s~])~~"
    r"|'''(?=[^\s'])(?P<bold>(?:(?!''')[^\n])*?[^\s'])'''|(?<!')''(?=[^\s'])(?P<italic>(?:(?!'')[^\n])*?[^\s'])''(?!')"
    r"|\\(?!(?:sub)*section\b|paragraph\b|chapter\b|item\b|begin\b|end\b|href\b|url\b|includegraphics\b)(?P<command>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{(?P<argument>[^{}\n]*)\}"
    r"|&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});",
    re.S,
)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s+[^<>]*|\s*/)?>")
_SPECIAL = re.compile(r"[*_`~'{&<\\]")

#: The mark a line begins with, by the first alternative that fits.
_LEAD = re.compile(
    r"\s*(?:(?P<hash>#{1,6}(?=\s|$))|(?P<bullet>(?:[-+•]|\*+)(?=\s))|(?P<number>\d{1,4}[.)](?=\s))|(?P<colon>[;:]+\s)"
    r"|(?P<rowmark>\|-+|\{\||\|\}|\|\+|![^\[])|(?P<pipe>\|)"
    r"|(?P<wikihead>={1,6}[^=\n][^\n]*?=+\s*$)|(?P<line>(?:={3,}|-{3,}|~{3,}|\*{3,}|_{3,})\s*$)|(?P<adoc>={1,6}\s+\S)"
    r"|(?P<section>\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*\{)|(?P<item>\\item\b|\\(?:begin|end)\{(?:itemize|enumerate|description)\})"
    r"|(?P<tabular>\\(?:begin|end)\{(?:tabular[x*]?|table\*?|array|longtable)\}|\\hline)"
    r"|(?P<code>\x01)|(?P<formula>\x02(?:\d+\x02[.,;]?\s*$))"
    r"|<(?P<tag>/?[A-Za-z][A-Za-z0-9]*)\b)"
)
_KINDS = ("none", "hash", "bullet", "number", "colon", "rowmark", "pipe", "wikihead", "line", "adoc", "section", "item", "tabular", "code", "formula", "t-heading", "t-list", "t-table", "t-link", "t-formula", "t-inline")
_KIND = {k: i for i, k in enumerate(_KINDS)}
_UNDER = re.compile(r"\s*(?:={3,}|-{3,}|~{3,}|\^{3,})\s*$")
_CELLS = re.compile(r"\s&\s|(?<!^)\s\|\s|\|\||\t")
_WORD = re.compile(r"\w+")

# Labelled lines for the tree, a letter and a line each: h heading, l list, c code, f formula, t table, r rule or empty mark, x text, k text with
# links. Of k, lines that are mostly links beside others of that kind are rows of links, b.
# \x01 stands for a code region, \x020\x02 for a displayed formula. A blank line parts paragraphs.
_LABELLED = r"""
h|# Title of it
x|This is the opening paragraph of a longer page, and it says what the page is about.

h|## Usage
k|Run it, then look at the [guide](https://a.example/x) for more words on how it goes.
l|- one
l|- two small things
l|- three of the things that take a whole long line to be told about in full detail here
c|\x01
h|### Limits ###
l|* first
l|** nested below the first
l|* [only a link](https://a.example/y)
k|See [it](https://a.example/z).
k|![picture](https://a.example/p.svg)
k|[ref]: https://a.example/r

h|Overview
r|========
x|Some text that stands under an underlined heading and goes on for quite a while longer.

h|Longer heading of several words
r|-------------------------------
x|Short text.
x|Words again that run on in a paragraph, with a | bar and a = sign, without any structure.
f|\x020\x02
x|Where the value of it was given above.
l|1. first step
l|2. second step of the whole thing
l|10) later step
t|\| name \| count \|
t|\|---\|---:\|
t|\| cache \| 89 \|
t|\| a longer cell of several words \| 8 \|

h|== Heading ==
x|The '''wiki''' text goes on here for a while so that it has a fair number of words.
h|===Narrow===
l|* item
l|# counted item
l|# counted item again
l|: indented
t|{\| class="plain"
t|\|-
t|\| a \|\| 2
t|! head
t|\|}
h|= Document
x|Asciidoc text follows with some more words in it.

h|\section{Name of it}
x|LaTeX text with \emph{words} and a few more of them to make a paragraph.
h|\subsection*{Name}
l|\begin{itemize}
l|\item one
l|\item another one that is longer than the first
l|\end{itemize}
t|\begin{tabular}{lr}
t|prompt & 69 \\
t|longer prompt & 7 \\
t|\hline
t|\end{tabular}
f|\x021\x02
c|\x01

h|<h1 align="center">Name</h1>
x|<p>Running text in a paragraph, of some length, with the usual words in it.</p>
h|<H2>Other name of it</H2>
l|<ul>
l|<li>one</li>
l|<LI>another one of some length, with words</LI>
l|</ul>
t|<table><tr><td>a</td><td>6</td></tr></table>
t|<tr><td>a</td></tr>
k|<a href="https://a.example/q">guide</a>
k|<img src="https://a.example/q.png" alt="guide">
x|<div align=center>
x|<br/>
x|</p>
r|----
x|One word
x|Roughly 42 % pass, a == b holds, match *.log and *.tmp, then multiply 2 * 3.
x|The plan is $5 or $7 for all of it, and row[0] comes first.
x|https://a.example/bare
c|\x01
x|The layout is:
x|├── cache of it
x|│   └── shell
x|A word & another, R&D, and this | that.
k|[Home](https://a.example) | [Docs](https://a.example/d) | [Chat](https://a.example/c)
k|[Docs](https://a.example/d) [Chat](https://a.example/c)
k|[![build](https://a.example/b.svg)](https://a.example/b)
k|<https://a.example/auto>
k|The text of \href{https://a.example/h}{the manual} says more.
k|A page [[Other page|of the wiki]] and [https://a.example/o another one] tell more about what it is.
x|<b>Bold</b> words in a line, and an <i>odd</i> one.
"""

#: From this link density on a line is mostly links.
_DENSE = 0.5



class Block:
    __slots__ = ("density", "kind", "text", "under", "words", "cells", "blank")

    def __init__(self, text: str, blank: bool, density: float):
        m = _LEAD.match(text)
        lead = m.lastgroup if m else None
        if lead == "tag":
            lead = "t-" + _BUILDS.get(m["tag"].lstrip("/").lower(), "inline")
            lead = "none" if lead == "t-code" else lead
        self.kind = _KIND[lead or "none"]
        self.text, self.blank, self.density = text, blank, density
        self.under = bool(_UNDER.match(text))
        self.words = len(_WORD.findall(text)) if len(text) < 400 else text.count(" ") + 1
        self.cells = len(_CELLS.findall(text)) if "&" in text or "|" in text or "\t" in text else 0


#: What _features returns, in order; the leading marks follow.
FEATURES = (
    "words", "density", "words before", "density before", "words after", "density after",
    "blank before", "blank after", "same mark before", "same mark after", "no mark before", "line", "line after", "cells", "row end",
)


def _features(blocks: list[Block]) -> np.ndarray:
    """Word count and link density of each block and of the blocks before and after, how it is set off from them, and its leading mark."""
    n = len(blocks)
    own = np.array([(b.words, b.density, b.blank, b.kind, b.under, b.cells, b.text.rstrip().endswith("\\\\")) for b in blocks], float).reshape(n, 7)
    words, density, blank, kind, under, cells, end = own.T
    edge = np.array([[0, 0, 1, -1, 0, 0, 0]], float)
    before, after = np.vstack([edge, own[:-1]])[:n], np.vstack([own[1:], edge])[:n]
    same_before = (before[:, 3] == kind) & (blank == 0)
    same_after = (after[:, 3] == kind) & (after[:, 2] == 0)
    shape = [words, density, before[:, 0], before[:, 1], after[:, 0], after[:, 1], blank, after[:, 2], same_before, same_after, before[:, 3] == 0, under, after[:, 4], cells, end]
    return np.column_stack([*shape, np.eye(len(_KINDS))[kind.astype(int)]])


def _lines(text: str) -> list[Block]:
    """The lines of a text as blocks. A line's link density is the share of it that stands in links."""
    links = [m.span() for m in _LINK.finditer(text)] if "[" in text or "<" in text or "\\" in text else []
    blocks, blank, at, k = [], True, 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        inside = 0
        while k < len(links) and links[k][1] <= at:
            k += 1
        for start, stop in links[k:]:
            if start >= end:
                break
            inside += min(stop, end) - max(start, at)
        if line.strip():
            blocks.append(Block(line, blank, inside / len(line)))
        blank = not line.strip()
        at = end + 1
    return blocks


def _units() -> list[list[tuple[str, str]]]:
    """The labelled lines that belong together: an underlined heading, a counted wiki list, else one line."""
    units: list[list[tuple[str, str]]] = []
    for part in _LABELLED.strip("\n").split("\n\n"):
        for row in part.split("\n"):
            label, line = row.split("|", 1)
            line = line.replace("\\|", "|").replace("\\x01", "\x01").replace("\\x02", "\x02")
            joins = units and (label == "r" and _UNDER.match(line) and units[-1][-1][0] == "h" or line[:2] == "# " and label == "l" and units[-1][-1][1][:2] == "# ")
            if joins:
                units[-1].append((label, line))
            else:
                units.append([(label, line)])
    return units


@cache
def classifier() -> DecisionTree:
    """The tree, trained on pages put together from the labelled lines above.

    The lines are a bounded table, part of this module. They are dealt at random (fixed
    seed) to 400 pages, alone or in runs of their kind and shortened or lengthened, so
    that the tree does not rest on the neighbours and lengths they happen to have.
    """
    random, units = np.random.default_rng(4), _units()
    labels, features = [], []
    for _ in range(400):
        rows: list[tuple[str, str]] = []
        for k in random.integers(0, len(units), 12):
            unit = units[k]
            if unit[0][0] == "r":  # else the line before it would be a heading
                rows.append(("", ""))
            for _ in range(random.integers(1, 4) if unit[0][0] in "ltk" else 1):
                for label, line in unit:
                    words = line.split(" ")
                    if label == "x" and len(words) > 3 and random.random() < 0.5:
                        line = " ".join((words * 4)[: random.integers(2, 4 * len(words))])
                    elif label == "k" and len(words) > 4 and random.random() < 0.5:  # a link in a line of any length
                        line += " word" * int(3000 ** random.random())
                    elif label in "hl" and len(words) > 2 and random.random() < 0.3:
                        line = " ".join([*words[:2], *[words[1]] * random.integers(0, 12), *words[2:]])
                    rows.append((label, line))
            if random.random() < (0.6 if unit[0][0] in "hxk" else 0.8) or unit[0][0] == "r":
                rows.append(("", ""))
        blocks = _lines("\n".join(r[1] for r in rows))
        own = [r[0] for r in rows if r[1].strip()]
        mostly = [label == "k" and b.density >= _DENSE for label, b in zip(own, blocks, strict=True)]
        beside = [x or y for x, y in zip([False, *mostly[:-1]], [*mostly[1:], False], strict=True)]
        labels += ["b" if m and s else label for label, m, s in zip(own, mostly, beside, strict=True)]
        features.append(_features(blocks))
    return DecisionTree(np.vstack(features), np.array(labels))


def segment(text: str) -> tuple[list[Block], list[str], list[str]]:
    """The document's blocks, with code regions and formulas taken out into two lists."""
    codes: list[str] = []
    formulas: list[str] = []

    def code(m: re.Match) -> str:
        body = m["fenced"] if m["fence"] else m["tagged"] if m["tag"] else m["inside"]
        if m["tag"]:
            body = html.unescape(re.sub(r"</?code\b[^<>]*>", "", body, flags=re.I))
        codes.append(body.strip("\n"))
        return "\n\x01\n"

    def formula(m: re.Match) -> str:
        formulas.append(next(m[g] for g in ("dollar", "square", "round", "inside", "math", "one") if m[g] is not None).strip())
        if m["math"] is not None:
            formulas[-1] = html.unescape(_TAG.sub("", formulas[-1]))
        return f"\x02{len(formulas) - 1}\x02"

    text = text.replace("\x01", " ").replace("\x02", " ").replace("\r\n", "\n")
    if "```" in text or "~~~" in text or "<" in text or "\\begin" in text:
        text = _CODE.sub(code, text)
    if "$" in text or "\\" in text or "<math" in text or "<MATH" in text:
        text = _FORMULA.sub(formula, text)
    return _lines(text), codes, formulas


def _mark(found: set[str]):
    def replace(m: re.Match) -> str:
        found.add("inline")
        for g in ("strong", "em", "under2", "under", "strike", "bold", "italic", "ticked", "argument"):
            if m[g] is not None:
                return m[g]
        if m["template"] is not None:
            return m["template"].rsplit("|", 1)[-1]
        return html.unescape(m.group()) if m.group()[0] == "&" else ""

    return replace


def _link(found: set[str]):
    def replace(m: re.Match) -> str:
        found.add("link")
        return next((m[g] for g in ("text", "wiki", "outer", "href", "url", "image", "auto") if m[g] is not None), "")

    return replace


def _tag(found: set[str]):
    def replace(m: re.Match) -> str:
        found.add(_BUILDS.get(m[1].lower(), "inline"))
        return " " if m[1].lower() in ("br", "td", "th", "li", "tr") else ""

    return replace


def _plain(text: str, found: set[str], links: bool = True) -> str:
    """Resolves links, if there may be any, tags and inline marks; notes what there was."""
    if links and ("[" in text or "<" in text or "\\" in text):
        text = _LINK.sub(_link(found), text)
    if "<!--" in text:
        text, n = re.subn(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
        found.update(["inline"] * bool(n))
    if "<" in text:
        text = _TAG.sub(_tag(found), text)
    if _SPECIAL.search(text):
        text = _MARK.sub(_mark(found), text)
        if "*" in text or "_" in text or "`" in text:  # marks within marks
            text = _MARK.sub(_mark(found), text)
    return text


_NAMES = {"h": "heading", "l": "list", "c": "code", "f": "formula", "t": "table", "k": "link", "b": "link", "r": None, "x": None}
_HEAD = re.compile(r"^\s*(?:#{1,6}\s*|={1,6}\s*|\\[a-z]+\*?\s*\{)|\s*(?:#+|=+|\})\s*$")
_ITEM = re.compile(r"^\s*(?:[-+•*#:;]+\s+|\d{1,4}[.)]\s+|\\item(?:\[[^\]]*\])?\s*)")


def render(blocks: list[Block], labels: np.ndarray, codes: list[str], formulas: list[str]) -> tuple[str, set[str]]:
    """Readable text of classified blocks, and the elements that the document held."""
    found = {_NAMES[x] for x in set(labels.tolist())} - {None}
    if formulas:
        found.add("formula")
    out: list[str] = []
    run: list[str] = []  # lines of a running paragraph, resolved together
    linked = False
    code = iter(codes)

    def flush():
        if run:
            text = _plain("\n".join(run), found, linked)
            out.extend(["", *(s for s in (re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n")) if s)])
            run.clear()

    last = ""
    for block, label in zip(blocks, labels.tolist(), strict=True):
        if label not in "xkb" or block.blank:
            flush()
            linked = False
        if label in "xkb":
            run.append(block.text)
            linked |= label != "x"
        elif label == "c":
            out += ["", "```", next(code, ""), "```"]
        elif label == "h":
            level = len(block.text) - len(block.text.lstrip("#=")) if block.text[0] in "#=" else 2
            out += ["", "#" * min(6, level) + " " + re.sub(r"\s+", " ", _plain(_HEAD.sub("", block.text), found)).strip()]
        elif label == "l":
            item = re.sub(r"\s+", " ", _plain(_ITEM.sub("", re.sub(r"\\(?:begin|end)\{[a-z]+\}", "", block.text)), found)).strip()
            out += [""] * (last != "l") + ["- " + item] * bool(item)
        elif label == "t":
            cells = _plain(re.sub(r"\\(?:begin|end)\{[a-z*]+\}(?:\{[^}]*\})?|\\\\|\\hline|^\s*(?:\{\|.*|\|\}|\|-.*)$", "", block.text), found)
            cells = " | ".join(c.strip() for c in re.split(r"\s*(?:\|+|(?<!\w)&(?!\w)|\s{2,}|!)\s*", cells) if c.strip(" -:|"))
            out += [""] * (last != "t") + [cells] * bool(cells)
        elif label == "f":
            out += ["", block.text.strip()]
        last = label
    flush()
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
    return re.sub("\x02(\\d+)\x02", lambda m: f"${formulas[int(m[1])]}$", text), found


def clean(texts: list[str | None]) -> list[tuple[str | None, set[str]]]:
    """(readable text, elements) of each text; (None, none) for null."""
    parts = [segment(t) if t else ([], [], []) for t in texts]
    rows = [_features(p[0]) for p in parts if p[0]]
    labels = classifier().predict(np.vstack(rows)) if rows else np.array([], str)
    done, at = [], 0
    for text, (blocks, codes, formulas) in zip(texts, parts, strict=True):
        own = labels[at : at + len(blocks)]
        at += len(blocks)
        done.append((None, set()) if text is None else render(blocks, own, codes, formulas))
    return done


def _cleaner(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        done = []
        for at in range(0, len(texts), 256):
            done += clean(texts[at : at + 256])
        elements = [[e for e in ELEMENTS if e in f] for _, f in done]
        yield pa.RecordBatch.from_arrays([ids, pa.array([t for t, _ in done], pa.string()), pa.array(elements, pa.list_(pa.string()))], names=["id", "clean", "elements"])


def clean_markup(texts: DataFrame) -> DataFrame:
    """Readable text and the markup elements of texts(id bigint, text).

    Returns id, clean, elements: one row per input row. Headings become '# title', list
    items '- item', tables 'cell | cell', formulas '$...$', code stays between fences; link
    and inline marks leave their text. A null text stays null, an empty one empty, both
    without elements. Markup inside code is kept as it is and does not count.
    """
    return texts.select("id", "text").mapInArrow(_cleaner, "id bigint, clean string, elements array<string>")
