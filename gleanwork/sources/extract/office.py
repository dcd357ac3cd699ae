"""Zipped office formats: docx, xlsx and EPUB."""

from __future__ import annotations

import html
import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from gleanwork.sources.extract.plain import decode

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def cells_line(cells) -> str:
    return " | ".join(c.strip() for c in cells if c and c.strip())


def _docx_text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def read_docx(data: bytes) -> str:
    """Paragraphs of the body, then the rows of its tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(_W + "body")
    lines = [_docx_text(p) for p in body.findall(_W + "p")]
    for table in body.findall(_W + "tbl"):
        for row in table.findall(_W + "tr"):
            lines.append(cells_line("\n".join(_docx_text(p) for p in cell.findall(_W + "p")) for cell in row.findall(_W + "tc")))
    return "\n".join(x for x in lines if x.strip())


# ---------------------------------------------------------------- spreadsheets

#: Built-in number formats that show dates or times.
_DATES = frozenset([*range(14, 23), *range(45, 48)])


def show_number(x: float, pattern: str = "", builtin: int = 0) -> str:
    """A number as its cell shows it: dates, percentages, fixed decimals, else the shortest form."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", pattern.split(";")[0])
    if builtin in _DATES or re.search(r"[yd]|h|(?<![a-z])m", bare, re.I):
        at = datetime(1899, 12, 30) + timedelta(days=x)
        return at.strftime("%H:%M:%S" if x < 1 else "%Y-%m-%d" if x == int(x) else "%Y-%m-%d %H:%M:%S")
    if builtin in (9, 10) or bare.endswith("%"):
        places = {9: 0, 10: 2}.get(builtin, len(bare.rpartition(".")[2]) - 1 if "." in bare else 0)
        return f"{x * 100:.{places}f}%"
    if builtin in (1, 2, 3, 4) or re.fullmatch(r"[#,]*0(\.0+)?", bare):
        places = {1: 0, 2: 2, 3: 0, 4: 2}.get(builtin, len(bare.rpartition(".")[2]) if "." in bare else 0)
        return f"{x:{',' if builtin in (3, 4) or ',' in bare else ''}.{places}f}"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.10g}"


class Formula:
    """Numbers, + - * / ^, brackets, cell references and a few functions over ranges."""

    TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|(\$?[A-Z]{1,3}\$?\d+(?::\$?[A-Z]{1,3}\$?\d+)?)|([A-Z]+)(?=\()|(.))")
    FUNCTIONS = {"SUM": sum, "MIN": min, "MAX": max, "AVERAGE": lambda v: sum(v) / len(v), "COUNT": len, "ABS": lambda v: abs(v[0])}

    def __init__(self, text: str, value):
        self.tokens, self.at, self.value = [m.groups() for m in self.TOKEN.finditer(text.lstrip("="))], 0, value

    def run(self) -> float:
        out = self.sum()
        if self.at < len(self.tokens):
            raise ValueError("formula not understood")
        return out

    def _sign(self, signs: str) -> str | None:
        if self.at < len(self.tokens) and (s := self.tokens[self.at][3]) and s in signs:
            self.at += 1
            return s
        return None

    def sum(self) -> float:
        out = self.product()
        while s := self._sign("+-"):
            out = out + self.product() if s == "+" else out - self.product()
        return out

    def product(self) -> float:
        out = self.power()
        while s := self._sign("*/"):
            out = out * self.power() if s == "*" else out / self.power()
        return out

    def power(self) -> float:
        out = self.atom()
        return out ** self.power() if self._sign("^") else out

    def atom(self) -> float:
        if s := self._sign("+-"):
            return self.atom() if s == "+" else -self.atom()
        if self._sign("("):
            out = self.sum()
            if not self._sign(")"):
                raise ValueError("bracket not closed")
            return out
        number, ref, name, _ = self.tokens[self.at] if self.at < len(self.tokens) else (None,) * 4
        self.at += 1
        if number:
            return float(number)
        if ref and ":" not in ref:
            return float(self.value(ref.replace("$", "")) or 0)
        if name in self.FUNCTIONS and self._sign("("):
            values: list[float] = []
            while True:
                r = self.tokens[self.at][1] if self.at < len(self.tokens) else None
                if r and ":" in r:
                    self.at += 1
                    values += [float(v) for c in span(r) if (v := self.value(c)) is not None]
                else:
                    values.append(self.sum())
                if not self._sign(","):
                    break
            if self._sign(")"):
                return float(self.FUNCTIONS[name](values))
        raise ValueError("formula not understood")


def span(ref: str) -> list[str]:
    a, b = ref.replace("$", "").split(":")
    (ca, ra), (cb, rb) = (re.fullmatch(r"([A-Z]+)(\d+)", x).groups() for x in (a, b))
    return [f"{letters(c)}{r}" for r in range(int(ra), int(rb) + 1) for c in range(column(ca), column(cb) + 1)]


def column(name: str) -> int:
    out = 0
    for c in name:
        out = out * 26 + ord(c) - 64
    return out


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def read_xlsx(data: bytes) -> str:
    """Every sheet in order, a line per row. A formula shows its value, else the stored one, else itself."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(_S + "si")]
        formats: list[tuple[int, str]] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            custom = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(_S + "numFmt")}
            formats = [(n := int(x.get("numFmtId") or 0), custom.get(n, "")) for x in styles.findall(f"{_S}cellXfs/{_S}xf")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [targets[s.get(_R + "id")] for s in ET.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")]
        lines = []
        for target in sheets:
            path = target.lstrip("/") if target.startswith("/") else "xl/" + target
            lines += _sheet_lines(ET.fromstring(z.read(path)), strings, formats)
    return "\n".join(lines)


def _sheet_lines(sheet, strings: list[str], formats: list[tuple[int, str]]) -> list[str]:
    cells = {c.get("r"): c for c in sheet.iter(_S + "c")}
    busy: set[str] = set()

    def stored(c) -> str | None:
        v, kind = c.find(_S + "v"), c.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(_S + "t"))
        if v is None or v.text is None:
            return None
        return strings[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text

    def value(ref: str):
        c = cells.get(ref)
        if c is None or ref in busy:
            return None
        f = c.find(_S + "f")
        if f is not None and f.text:
            busy.add(ref)
            try:
                return Formula(f.text, value).run()
            finally:
                busy.discard(ref)
        return stored(c)

    def shown(c) -> str:
        f, kind = c.find(_S + "f"), c.get("t", "n")
        builtin, pattern = formats[int(c.get("s") or 0)] if int(c.get("s") or 0) < len(formats) else (0, "")
        if f is not None and f.text:
            try:
                return show_number(Formula(f.text, value).run(), pattern, builtin)
            except (ValueError, TypeError, ZeroDivisionError, OverflowError, RecursionError):
                if stored(c) is None:
                    return f.text
        text = stored(c)
        if text is None:
            return ""
        return show_number(float(text), pattern, builtin) if kind == "n" else text

    return [line for row in sheet.iter(_S + "row") if (line := cells_line(shown(c) for c in row.findall(_S + "c")))]


# ---------------------------------------------------------------- EPUB


def fold(path: str) -> str:
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def strip_tags(markup: str) -> str:
    return re.sub(r"[ \t]{2,}", " ", html.unescape(re.sub(r"<[^>]+>", " ", markup)))


def _local(node, name: str):
    return [x for x in node.iter() if isinstance(x.tag, str) and x.tag.rpartition("}")[2] == name]


def _spine(z: zipfile.ZipFile, names: dict[str, str]) -> list[str]:
    """Chapters in reading order; none where the package can't be read."""
    try:
        root = _local(ET.fromstring(z.read(names["meta-inf/container.xml"])), "rootfile")[0].get("full-path")
        package = ET.fromstring(z.read(names[fold(root).lower()]))
    except (KeyError, IndexError, AttributeError, ET.ParseError):
        return []
    base = root.rpartition("/")[0]
    hrefs = {i.get("id"): i.get("href") or "" for i in _local(package, "item")}
    paths = [fold(f"{base}/{hrefs[r.get('idref')].partition('#')[0]}").lower() for r in _local(package, "itemref") if r.get("idref") in hrefs]
    return [names[p] for p in paths if p in names]


def read_epub(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {fold(n).lower(): n for n in z.namelist()}
        chapters = _spine(z, names) or [names[n] for n in sorted(names) if n.endswith((".html", ".xhtml", ".htm"))]
        texts = [strip_tags(decode(z.read(c))) for c in chapters]
    return "\n".join(t for t in texts if t.strip())
