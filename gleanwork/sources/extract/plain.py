"""Text files in Unicode or the usual legacy encodings, and RTF."""

from __future__ import annotations

import re

MAX_BYTES = 64 * 1024 * 1024
#: Tried in this order where a file has no byte order mark; the last fits every file.
ENCODINGS = ("utf-8", "gb18030", "big5", "latin-1")
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decode(data: bytes) -> str:
    for mark, encoding in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace")
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes everything")


def read_text(data: bytes) -> str:
    if len(data) > MAX_BYTES:
        raise ValueError(f"文件超过纯文本 {MAX_BYTES // 2**20} MB 上限")
    return decode(data).removeprefix("﻿")


# Destinations of the RTF specification that hold tables, properties or binary data, by its chapters.
RTF_HIDDEN = frozenset({
    # header: fonts, colours, styles, lists, revision marks, generator
    "fonttbl", "colortbl", "stylesheet", "latentstyles", "listtable", "listoverridetable", "rsidtbl", "generator",
    # document: information, XML names, theme, data
    "info", "xmlnstbl", "themedata", "colorschememapping", "datastore",
    # pictures and objects
    "pict", "object",
})
RTF_CHARS = {"par": "\n", "line": "\n", "tab": "\t"}
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = frozenset(b"0123456789")


def _rtf(data: bytes):
    """(kind, value, argument) of the parts of an RTF file: open, close, word, byte (an escaped one), sign and text."""
    at, end = 0, len(data)

    def span(start: int, allowed: frozenset) -> int:
        while start < end and data[start] in allowed:
            start += 1
        return start

    while at < end:
        char = data[at]
        if char == 0x7B or char == 0x7D:
            yield ("open" if char == 0x7B else "close"), b"", None
            at += 1
        elif char != 0x5C:
            stop = min((i for i in (data.find(c, at) for c in (b"\\", b"{", b"}")) if i >= 0), default=end)
            yield "text", data[at:stop], None
            at = stop
        elif at + 1 >= end:
            return
        elif data[at + 1] in _LETTERS:
            name = span(at + 1, _LETTERS)
            minus = data[name : name + 1] == b"-" and data[name + 1 : name + 2].isdigit()
            stop = span(name + minus, _DIGITS)
            yield "word", data[at + 1 : name].lower(), int(data[name:stop]) if stop > name else None
            at = stop + (data[stop : stop + 1] == b" ")
        elif data[at + 1] == 0x27 and all(c in b"0123456789abcdefABCDEF" for c in data[at + 2 : at + 4]) and at + 4 <= end:
            yield "byte", bytes([int(data[at + 2 : at + 4], 16)]), None
            at += 4
        else:
            yield "sign", data[at + 1 : at + 2], None
            at += 2


def _code_page(data: bytes) -> str | None:
    found = re.search(rb"\\ansicpg(\d+)", data[:512])
    if not found:
        return None
    page = found[1].decode()
    name = {"936": "gbk", "54936": "gb18030", "950": "big5", "65001": "utf-8", "10000": "mac-roman"}.get(page, f"cp{page}")
    try:
        b"".decode(name)
    except LookupError:
        return None
    return name


def read_rtf(data: bytes) -> str:
    """Running text. Escaped bytes gather until something else comes and are decoded together; a
    Unicode escape takes as many fallback characters with it as the group's \\uc says (1 at first)."""
    if not data:
        return ""
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ValueError("not an RTF file")
    page = _code_page(data)
    out: list[str] = []
    raw = bytearray()
    groups, hidden, fallback, skip = [], False, 1, 0

    def settle() -> None:
        if raw:
            out.append(bytes(raw).decode(page, "replace") if page else decode(bytes(raw)))
            raw.clear()

    for kind, value, arg in _rtf(data):
        if kind == "open":
            groups.append((hidden, fallback))
        elif kind == "close":
            skip = 0
            if groups:
                hidden, fallback = groups.pop()
        elif kind == "word":
            word = value.decode()
            if word in RTF_HIDDEN:
                hidden = True
            elif word == "uc":
                fallback = 1 if arg is None else arg
            elif word == "u" and arg is not None and not hidden:
                settle()
                out.append(chr(arg % 65536))
                skip = fallback
            elif word in RTF_CHARS and not hidden:
                settle()
                out.append(RTF_CHARS[word])
        elif kind == "sign":
            if value == b"*":
                hidden = True
            elif value in (b"\\", b"{", b"}") and not hidden:
                settle()
                out.append(value.decode())
            elif value == b"~" and not hidden:
                settle()
                out.append(" ")
        elif kind == "byte":
            if skip:
                skip -= 1
            elif not hidden:
                raw += value
        elif not hidden:
            text = value[skip:]
            skip = max(0, skip - len(value))
            if text:
                settle()
                out.append(text.decode(page or "latin-1", "replace"))
    settle()
    return re.sub(r"[\ud800-\udbff][\udc00-\udfff]", lambda p: p[0].encode("utf-16", "surrogatepass").decode("utf-16"), "".join(out)).encode("utf-8", "replace").decode().strip()
