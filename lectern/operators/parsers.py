"""Documents to rows: TEI XML, LaTeX, BibTeX, compiled bibliographies, HTML, e-mail-like text.

Parsers are plain functions from a text to rows; :func:`parsed` maps one over a table. Trees are flattened: sections
carry ``path``, an array of positions whose order is reading order, and ``section_id``, the path as 1.2.3.
"""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SENTENCES = "path array<int>, section_id string, title string, para int, sent int, text string, citations array<string>"
Row = tuple

_TEI = "{http://www.tei-c.org/ns/1.0}"
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z\[(])")
# Abbreviations whose full stop ends no sentence.
_SHORT = ("e.g.", "i.e.", "et al.", "etc.", "Fig.", "Eq.", "Sec.", "Tab.", "cf.", "vs.", "Dr.", "Prof.")


def sentences(text: str) -> list[str]:
    """Sentences at . ! ? before white space and a capital; abbreviations don't end one."""
    out: list[str] = []
    for part in _SENTENCE_END.split(re.sub(r"\s+", " ", text).strip()):
        if out and out[-1].endswith(_SHORT):
            out[-1] += " " + part
        elif part:
            out.append(part)
    return out


def ascii_letters(text: str | None) -> str:
    """Transliterated to ASCII, letters and digits only, lower-cased."""
    flat = unicodedata.normalize("NFKD", (text or "").replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("æ", "ae"))
    return re.sub(r"[^0-9a-z]", "", flat.encode("ascii", "ignore").decode().lower())


def decoded(data: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


# ---------------------------------------------------------------- TEI


def _flat(e: ET.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def _cited(p: ET.Element, names: dict[str, str]) -> list[tuple[str, list[str]]]:
    """A paragraph's sentences, each with the titles that its references point to."""
    text, marks = p.text or "", []
    for child in p:
        if child.tag == f"{_TEI}ref" and child.get("type") == "bibr":
            key = (child.get("target") or "").lstrip("#")
            marks.append((len(text), names.get(key, key or _flat(child))))
        text += "".join(child.itertext()) + (child.tail or "")
    out, at = [], 0
    for s in sentences(text):
        words = [re.escape(w) for w in s.split(" ")]
        found = re.compile(r"\s+".join(words)).search(text, at)
        a, b = found.span() if found else (at, at)
        out.append((s, [n for k, n in marks if a <= k <= b and n]))
        at = b
    return out


def tei_references(root: ET.Element) -> dict[str, str]:
    out = {}
    for b in root.iter(f"{_TEI}biblStruct"):
        key = b.get("{http://www.w3.org/XML/1998/namespace}id")
        title = next((t for t in b.iter(f"{_TEI}title") if _flat(t)), None)
        if key and title is not None:
            out[key] = _flat(title)
    return out


def numbered_path(number: str | None) -> list[int]:
    return [int(x) for x in re.findall(r"\d+", number or "")]


def tei(xml: str, mode: str = "strict") -> list[Row]:
    """Rows of SENTENCES. Mode strict nests sections by their heads' numbers (levels that are missing are put in),
    casual leaves them flat. The abstract has path [0]; a broken document gives no row."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    names, rows = tei_references(root), []

    def paragraphs(e: ET.Element, path: list[int], title: str) -> None:
        for k, p in enumerate(x for x in e.iter(f"{_TEI}p")):
            for j, (s, cites) in enumerate(_cited(p, names)):
                rows.append((path, ".".join(map(str, path)), title, k, j, s, cites))

    for a in root.iter(f"{_TEI}abstract"):
        paragraphs(a, [0], "Abstract")
    body = next(root.iter(f"{_TEI}body"), None)
    last: list[int] = [0]
    for div in body.findall(f"{_TEI}div") if body is not None else []:
        head = div.find(f"{_TEI}head")
        path = numbered_path(head.get("n") if head is not None else None) if mode == "strict" else []
        if not path or path <= last:
            path = [last[0] + 1]
        paragraphs(div, path, _flat(head) if head is not None else "")
        last = path
    return rows


def tei_headings(xml: str, mode: str = "strict") -> list[Row]:
    """(path, section_id, title) of distinct sections."""
    seen = {}
    for path, section_id, title, *_ in tei(xml, mode):
        seen.setdefault(section_id, (path, section_id, title))
    return list(seen.values())


def renumbered(heads: list[tuple[str | None, str]]) -> list[list[int]]:
    """Paths of numbered and unnumbered heads in turn: a number that goes back or skips a level is mended, an
    unnumbered head comes next on the current level."""
    out: list[list[int]] = []
    last: list[int] = []
    for number, _ in heads:
        path = numbered_path(number)
        if not path or (last and path <= last):
            path = [*last[:-1], last[-1] + 1] if last else [1]
        if len(path) > len(last) + 1:
            path = [*path[: len(last) + 1]]
            while out and path <= last:
                path[-1] += 1
        out.append(path)
        last = path
    return out


# ---------------------------------------------------------------- LaTeX

# Macros.
_CITE = re.compile(r"\\(?:cite|citep|citet|citealp|citealt|citeauthor|citeyear|parencite|textcite)\*?(?:\[[^\]]*\]){0,2}\{([^}]*)\}")
_HEAD = re.compile(r"\\(section|subsection|subsubsection)\*?\{((?:[^{}]|\{[^{}]*\})*)\}")
_KEPT = ("figure", "table", "equation", "align", "algorithm", "lstlisting", "verbatim", "tabular")
_ENVIRONMENT = re.compile(r"\\begin\{(" + "|".join(_KEPT) + r")\*?\}.*?\\end\{\1\*?\}", re.S)


def without_comments(tex: str) -> str:
    return re.sub(r"(?<!\\)%[^\n]*", "", tex)


def with_inputs(name: str, files: dict[str, str], seen: tuple[str, ...] = ()) -> str:
    """A file with its \\input and \\include files in place (.tex by default); missing and circular ones vanish."""
    if name in seen:
        return ""

    def put(m: re.Match) -> str:
        other = m[1].strip()
        other = other if other in files else f"{other}.tex"
        return with_inputs(other, files, (*seen, name)) if other in files else ""

    return re.sub(r"\\(?:input|include)\{([^}]*)\}", put, without_comments(files.get(name, "")))


def tex_text(tex: str) -> str:
    """Plain text: citations and labels gone, formatting macros replaced by what they hold."""
    out = _CITE.sub("", tex)
    out = re.sub(r"\\(?:label|ref|eqref|url|href)\*?\{[^}]*\}", "", out)
    for _ in range(4):
        out = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", out)
    out = re.sub(r"\\[A-Za-z]+\*?", " ", out)
    return re.sub(r"\s+", " ", re.sub(r"[~$]", " ", re.sub(r"[{}]", "", out))).strip()


def argument(tex: str, macro: str) -> str:
    """The text of a macro's first argument, braces balanced; empty without the macro."""
    at = re.search(r"\\" + macro + r"\*?(?:\[[^\]]*\])?\{", tex)
    if not at:
        return ""
    depth, i = 1, at.end()
    while i < len(tex) and depth:
        depth += (tex[i] == "{") - (tex[i] == "}")
        i += 1
    return tex_text(tex[at.end() : i - 1])


def is_main_file(tex: str) -> bool:
    return "\\begin{document}" in tex and "\\section" in tex


def latex(tex: str) -> list[Row]:
    """Rows of SENTENCES: sections to three levels; paragraphs end at blank lines and around kept environments, each
    of which is a paragraph of one sentence; citation keys by sentence."""
    tex = without_comments(tex)
    body = tex.split("\\begin{document}", 1)[-1].split("\\end{document}", 1)[0]
    level = {"section": 1, "subsection": 2, "subsubsection": 3}
    parts, last = [], 0
    path, title = [0], ""
    for m in _HEAD.finditer(body):
        parts.append((path, title, body[last : m.start()]))
        depth = level[m[1]]
        base = [*path, *[0] * 3][:depth] if path != [0] else [0] * depth
        base[depth - 1] += 1
        path, title, last = base, tex_text(m[2]), m.end()
    parts.append((path, title, body[last:]))
    rows: list[Row] = []
    for path, title, content in parts:
        marked = _ENVIRONMENT.sub(lambda m: "\n\n\x00" + m[0].replace("\n\n", "\n") + "\n\n", content)
        paras = [p for p in re.split(r"\n\s*\n", marked) if p.strip()]
        for k, p in enumerate(paras):
            whole = p.strip().startswith("\x00")
            # the keys stay in the text, one word each, until sentences are cut
            flagged = p.strip("\x00 \n") if whole else _CITE.sub(lambda m: "".join(f" \x01{x.strip()}\x01" for x in m[1].split(",")), p)
            cut = [flagged] if whole else sentences(tex_text(flagged))
            for j, s in enumerate(cut):
                keys = [x.strip() for m in _CITE.findall(s) for x in m.split(",")] if whole else re.findall("\x01([^\x01]*)\x01", s)
                rows.append((path, ".".join(map(str, path)), title, k, j, re.sub(r"\s+", " ", re.sub("\x01[^\x01]*\x01", "", s)).strip(), keys))
    return [r for r in rows if r[5]]


def bibtex(text: str) -> list[Row]:
    """(key, kind, title, author, year), the first entry of each key."""
    out: dict[str, Row] = {}
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", text):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        body = text[m.end() : i - 1]
        fields = {}
        for f in re.finditer(r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|(\w+))", body):
            fields.setdefault(f[1].lower(), tex_text(f[2] or f[3] or f[4] or ""))
        if m[1].lower() not in ("comment", "string", "preamble"):
            out.setdefault(m[2], (m[2], m[1].lower(), fields.get("title", ""), fields.get("author", ""), fields.get("year", "")))
    return list(out.values())


def compiled_bibliography(text: str) -> list[Row]:
    """(key, text) of a .bbl file, in either of its forms."""
    if "\\entry{" in text:
        out = []
        for m in re.finditer(r"\\entry\{([^}]*)\}(.*?)\\endentry", text, re.S):
            title = re.search(r"\\field\{title\}\{((?:[^{}]|\{[^{}]*\})*)\}", m[2])
            out.append((m[1], tex_text(title[1]) if title else ""))
        return out
    parts = re.split(r"\\bibitem(?:\[(?:[^\[\]]|\[[^\]]*\])*\])?\{([^}]*)\}", text.split("\\end{thebibliography}")[0])
    return [(parts[i], tex_text(parts[i + 1].replace("\\newblock", " "))) for i in range(1, len(parts) - 1, 2)]


# ---------------------------------------------------------------- HTML


class _Main(HTMLParser):
    _SKIP = {"script", "style", "nav", "footer", "header", "aside", "noscript", "form", "svg"}
    _BREAK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "blockquote", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.skip, self.title, self.in_title = [""], 0, "", False

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIP or (tag == "div" and dict(attrs).get("class") == "ad"):
            self.skip += 1
        elif self.skip and tag == "div":
            self.skip += 1
        if tag in self._BREAK:
            self.lines.append("")
        self.in_title = tag == "title"

    def handle_endtag(self, tag):
        if self.skip and (tag in self._SKIP or tag == "div"):
            self.skip -= 1
        if tag in self._BREAK:
            self.lines.append("")
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.lines[-1] += data


def html_main(html: str | None) -> tuple[str, str]:
    """(title, main text), a line for each block; navigation, scripts, styles, advertisements and footers left out."""
    p = _Main()
    p.feed(html or "")
    p.close()
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
    return squeeze(p.title), "\n".join(x for x in map(squeeze, p.lines) if x)


def listing(html: str) -> list[Row]:
    """(id, title) of the dt / dd pairs of an archive's listing page."""
    ids = re.findall(r"<dt\b.*?/abs/([^\"'#?>\s]+).*?</dt>", html, re.S | re.I)
    titles = re.findall(r"<dd\b.*?list-title[^>]*>(.*?)</div>", html, re.S | re.I)
    clean = [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", t)).replace("Title:", "").strip() for t in titles]
    return list(zip(ids, clean, strict=False))


def abstract(html: str) -> list[Row]:
    """The abstract of an abstract page, without its label, white space squeezed; no row without one."""
    found = re.search(r"<blockquote[^>]*class=[\"'][^\"']*\babstract\b[^>]*>(.*?)</blockquote>", html, re.S | re.I)
    text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", found[1])).strip() if found else ""
    return [(re.sub(r"^Abstract:\s*", "", text),)] if text else []


def any_text(x: object) -> str:
    """Text of nested JSON: lists line by line, wrapped values unwrapped."""
    if x is None:
        return ""
    if isinstance(x, dict):
        return any_text(x["value"]) if "value" in x else "\n".join(filter(None, map(any_text, x.values())))
    if isinstance(x, list):
        return "\n".join(filter(None, map(any_text, x)))
    return str(x)


def parsed(df: DataFrame, key: str, text: str, parser: Callable[[str], list[Row]], schema: str) -> DataFrame:
    """(key, columns of the schema): the parser's rows of each text; null texts have none."""
    names = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *r) for k, t in zip(f[key], f[text], strict=True) if t is not None for r in parser(t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {schema}")
