"""Compound files of the older office formats: Word 97 documents and BIFF8 workbooks."""

from __future__ import annotations

import struct

from gleanwork.sources.extract.office import cells_line, show_number

_FREE = 0xFFFFFFF0


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    size, small = 1 << shift, 1 << small_shift
    first_dir, cutoff, first_small = struct.unpack_from("<I4xII", data, 48)
    first_more, n_more = struct.unpack_from("<II", data, 68)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    tables = list(struct.unpack_from("<109I", data, 76))
    while n_more and first_more < _FREE:
        more = struct.unpack(f"<{size // 4}I", sector(first_more))
        tables += more[:-1]
        first_more, n_more = more[-1], n_more - 1
    fat = [x for t in tables if t < _FREE for x in struct.unpack(f"<{size // 4}I", sector(t).ljust(size, b"\xff"))]

    def chain(at: int, table: list[int], read, most: int) -> bytes:
        out, seen = [], 0
        while at < _FREE and at < len(table) and seen <= most:
            out.append(read(at))
            at = table[at]
            seen += 1
        return b"".join(out)

    entries = chain(first_dir, fat, sector, len(fat))
    small_fat = list(struct.unpack(f"<{len(b) // 4}I", b)) if (b := chain(first_small, fat, sector, len(fat))) else []
    found, ministream = [], b""
    for at in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        start, bytes_ = struct.unpack_from("<IQ", entries, at + 116)
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            ministream = chain(start, fat, sector, len(fat))
        elif kind == 2:
            found.append((name, start, bytes_ & 0xFFFFFFFF))
    read_small = lambda i: ministream[i * small : (i + 1) * small]
    return {name: (chain(start, small_fat, read_small, len(small_fat)) if n < cutoff else chain(start, fat, sector, len(fat)))[:n] for name, start, n in found}


def read_doc(data: bytes) -> str:
    """The main text of a Word 97 document, by its piece table."""
    parts = streams(data)
    word = parts["WordDocument"]
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & 0x100:
        raise ValueError("encrypted document")
    table = parts["1Table" if flags & 0x200 else "0Table"]
    at, size = struct.unpack_from("<II", word, 0x1A2)
    count = struct.unpack_from("<I", word, 0x4C)[0]
    end, out = at + size, []
    while at < end and table[at] == 1:
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at >= end or table[at] != 2:
        raise ValueError("no piece table")
    n = (struct.unpack_from("<I", table, at + 1)[0] - 4) // 12
    starts = struct.unpack_from(f"<{n + 1}I", table, at + 5)
    for i in range(n):
        where = struct.unpack_from("<I", table, at + 5 + 4 * (n + 1) + 8 * i + 2)[0]
        chars = starts[i + 1] - starts[i]
        if where & 0x40000000:
            where = (where & 0x3FFFFFFF) // 2
            out.append(word[where : where + chars].decode("cp1252", "replace"))
        else:
            out.append(word[where : where + 2 * chars].decode("utf-16-le", "replace"))
    text = "".join(out)[:count] if count else "".join(out)
    return text.translate({13: "\n", 7: "\t", 11: "\n", 12: "\n", 19: None, 20: None, 21: None}).strip()


def _records(book: bytes):
    at = 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + size], at
        at += 4 + size


def _shared_strings(parts: list[bytes]) -> list[str]:
    """The string table, whose strings may be cut by continuations (each begins with its own width)."""
    total = struct.unpack_from("<I", parts[0], 4)[0]
    part, at, out = 0, 8, []

    def need() -> None:
        nonlocal part, at
        while at >= len(parts[part]) and part + 1 < len(parts):
            part, at = part + 1, 0

    def skip(n: int) -> None:
        nonlocal at
        while n > 0:
            need()
            step = min(n, len(parts[part]) - at)
            if step <= 0:
                return
            at += step
            n -= step

    for _ in range(total):
        need()
        if at + 3 > len(parts[part]):
            break
        chars, flags = struct.unpack_from("<HB", parts[part], at)
        at += 3
        runs = extra = 0
        if flags & 8:
            runs = struct.unpack_from("<H", parts[part], at)[0]
            at += 2
        if flags & 4:
            extra = struct.unpack_from("<I", parts[part], at)[0]
            at += 4
        text, wide = "", flags & 1
        while chars:
            if at >= len(parts[part]):
                if part + 1 >= len(parts):
                    break
                part, wide, at = part + 1, parts[part + 1][0] & 1, 1
            width = 2 if wide else 1
            n = min(chars, (len(parts[part]) - at) // width)
            if n <= 0:
                break
            text += parts[part][at : at + n * width].decode("utf-16-le" if wide else "latin-1", "replace")
            at += n * width
            chars -= n
        skip(4 * runs + extra)
        out.append(text)
    return out


def _short_text(b: bytes) -> str:
    n, wide = struct.unpack_from("<HB", b, 0)
    return b[3 : 3 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace")


def _rk(n: int) -> float:
    x = float(struct.unpack("<i", struct.pack("<I", n))[0] >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return x / 100 if n & 1 else x


def read_xls(data: bytes) -> str:
    """Every sheet in order, a line per row; formulas show their stored value."""
    parts = streams(data)
    book = parts.get("Workbook") or parts.get("Book")
    if book is None:
        raise ValueError("no workbook")
    strings: list[str] = []
    sheets, formats, xfs, sst, before = [], {}, [], None, 0
    for kind, b, _ in _records(book):
        if kind == 0x2F:
            raise ValueError("encrypted workbook")
        if kind == 0xFC:
            sst = [b]
        elif kind == 0x3C and before in (0xFC, 0x3C) and sst:
            sst.append(b)
        elif kind == 0x85:
            sheets.append(struct.unpack_from("<I", b, 0)[0])
        elif kind == 0x41E:
            formats[struct.unpack_from("<H", b, 0)[0]] = _short_text(b[2:])
        elif kind == 0xE0:
            xfs.append(struct.unpack_from("<H", b, 2)[0])
        before = kind
    if sst:
        strings = _shared_strings(sst)
    number = lambda x, xf: show_number(x, formats.get(f := xfs[xf] if xf < len(xfs) else 0, ""), f)
    lines = []
    for start in sheets:
        rows: dict[int, dict[int, str]] = {}
        pending = None
        for kind, b, at in _records(book[start:]):
            if kind == 0x0A and at:
                break
            if kind in (0xFD, 0x203, 0x27E, 0x204, 0x205, 0x06):
                row, col, xf = struct.unpack_from("<HHH", b, 0)
                cells = rows.setdefault(row, {})
            if kind == 0xFD:
                i = struct.unpack_from("<I", b, 6)[0]
                cells[col] = strings[i] if i < len(strings) else ""
            elif kind == 0x203:
                cells[col] = number(struct.unpack_from("<d", b, 6)[0], xf)
            elif kind == 0x27E:
                cells[col] = number(_rk(struct.unpack_from("<I", b, 6)[0]), xf)
            elif kind == 0x204:
                cells[col] = _short_text(b[6:])
            elif kind == 0x205:
                cells[col] = ("TRUE" if b[6] else "FALSE") if not b[7] else ""
            elif kind == 0xBD:
                row, col = struct.unpack_from("<HH", b, 0)
                for k in range((len(b) - 6) // 6):
                    xf, v = struct.unpack_from("<HI", b, 4 + 6 * k)
                    rows.setdefault(row, {})[col + k] = number(_rk(v), xf)
            elif kind == 0x06:
                if b[12:14] == b"\xff\xff":
                    pending = (row, col) if b[6] == 0 else None
                else:
                    cells[col] = number(struct.unpack_from("<d", b, 6)[0], xf)
            elif kind == 0x207 and pending:
                rows[pending[0]][pending[1]] = _short_text(b)
                pending = None
        lines += [line for r in sorted(rows) if (line := cells_line(rows[r][c] for c in sorted(rows[r])))]
    return "\n".join(lines)
