"""Column functions over texts, paths, sizes and times. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a run of ASCII letters and digits, or one other character that isn't white space.
TOKEN = r"[a-z0-9]+|[^\sa-z0-9]"
#: 100 ns ticks from 0001-01-01 to 1970-01-01.
EPOCH_TICKS = 621355968000000000
MARK_OPEN, MARK_CLOSE = "<mark>", "</mark>"


# What states are called, the names of their colours, and what stands in place of a preview.
STATUS_TEXT = {"Ok": "可用", "NeedsUpdate": "待更新", "Building": "构建中", "SourceUnavailable": "源盘离线（可搜索）", "Error": "索引错误"}
STATUS_TEXT_ELSE = "未知"
STATUS_BRUSH = {"Ok": "StatusOkBrush", "NeedsUpdate": "StatusNeedsUpdateBrush", "Building": "StatusBuildingBrush", "SourceUnavailable": "StatusSourceUnavailableBrush", "Error": "StatusErrorBrush"}
STATUS_BRUSH_ELSE = "TextTertiaryBrush"
NO_FRAGMENT, NO_PREVIEW = "未匹配到内容片段", "此文件类型暂不支持内容预览（仅按文件名索引）"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def analyze(text: Column | str) -> Column:
    """Lower-cased tokens in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalize_path(path: Column | str) -> Column:
    return F.translate(_c(path), "\\", "/")


def directory(path: Column | str) -> Column:
    """What stands before the last slash; '' without one."""
    p = _c(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """Lower-case extension without its dot, of the last path segment; '' without one."""
    return F.lower(F.regexp_extract(_c(path), r"\.([^./\\]*)$", 1))


def fold_path(path: Column | str) -> Column:
    """A zip entry's path without empty, '.' and '..' segments."""
    parts = F.split(F.translate(_c(path), "\\", "/"), "/")
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when((part == "") | (part == "."), kept)
            .when((part == "..") & (F.size(kept) > 0), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(part == "..", kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    return F.array_join(F.aggregate(parts, empty, step), "/")


def strip_tags(markup: Column | str) -> Column:
    """Tags become blanks, the entities of HTML's core are decoded, runs of blanks become one; line ends stay."""
    text = F.regexp_replace(_c(markup), r"<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def strip_bom(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "^﻿", "")


def parse_long(text: Column | str) -> Column:
    """The text as a 64-bit integer, or 0."""
    return F.coalesce(F.expr("NULL").cast("long") if text is None else _c(text).try_cast("long"), F.lit(0).cast("long"))


def ticks(ts: Column | str) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp")) * 10 + F.lit(EPOCH_TICKS)


def from_ticks(n: Column | str) -> Column:
    return F.timestamp_micros(F.floor((_c(n) - F.lit(EPOCH_TICKS)) / 10).cast("long"))


def humanize_bytes(n: Column | str) -> Column:
    """1024-based with B, KB, MB, GB, TB; whole bytes, one decimal else."""
    n = _c(n).cast("double")
    out = F.concat(F.format_number(n, 0), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024.0**k, F.concat(F.format_number(n / 1024.0**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def humanize_seconds(n: Column | str) -> Column:
    """Hours and minutes, minutes and seconds, or at least one second."""
    s = F.floor(_c(n)).cast("long")
    return (
        F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(" 时 "), F.floor(s % 3600 / 60).cast("string"), F.lit(" 分")))
        .when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit(" 分 "), (s % 60).cast("string"), F.lit(" 秒")))
        .otherwise(F.concat(F.greatest(s, F.lit(1)).cast("string"), F.lit(" 秒")))
    )


def percent_done(done: Column | str, total: Column | str) -> Column:
    done, total = _c(done), _c(total)
    most = F.greatest(total, done)
    return F.when(most > 0, F.least(F.lit(100.0), 100.0 * done / most)).otherwise(F.lit(0.0))


def eta_seconds(done: Column | str, total: Column | str, seconds: Column | str) -> Column:
    """Seconds left at the pace so far; null before anything is done."""
    done, total, seconds = _c(done), _c(total), _c(seconds)
    return F.when((done > 0) & (seconds > 0), F.greatest(total - done, F.lit(0)) / (done / seconds))


def join_cells(*cells: Column | str) -> Column:
    """Cells that aren't blank, with ' | ' between them."""
    return F.concat_ws(" | ", *[F.when(F.trim(_c(c)) != "", F.trim(_c(c))) for c in cells])


def highlight_words(text: Column | str, words: list[str]) -> Column:
    """Marks each of the ASCII words, whatever its case, where it is a whole word; null where none is."""
    import re

    pattern = r"(?i)\b(" + "|".join(re.escape(w) for w in words) + r")\b"
    t = _c(text)
    return F.when(t.rlike(pattern), F.regexp_replace(t, pattern, f"{MARK_OPEN}$1{MARK_CLOSE}"))


def parse_highlight(markup: Column | str) -> Column:
    """Segments (text, is_highlighted) in order. An unclosed mark's remainder is plain; no segment is empty."""
    m = F.coalesce(_c(markup), F.lit(""))
    pieces = F.split(m, MARK_OPEN, -1)

    def part(p: Column, i: Column) -> Column:
        at = F.instr(p, MARK_CLOSE)
        plain = lambda t: F.struct(t.alias("text"), F.lit(False).alias("is_highlighted"))
        closed = F.array(
            F.struct(F.substring(p, F.lit(1), at - 1).alias("text"), F.lit(True).alias("is_highlighted")),
            plain(F.substring(p, at + len(MARK_CLOSE), F.length(p))),
        )
        return F.when((i > 0) & (at > 0), closed).otherwise(F.array(plain(p)))

    return F.filter(F.flatten(F.transform(pieces, part)), lambda s: s["text"] != "")


def _named(key: Column | str, names: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), _c(key)), F.lit(other))


def status_text(status: Column | str) -> Column:
    return _named(status, STATUS_TEXT, STATUS_TEXT_ELSE)


def status_brush(status: Column | str) -> Column:
    return _named(status, STATUS_BRUSH, STATUS_BRUSH_ELSE)


def preview_hint(content_indexed: Column | str) -> Column:
    """What a result without a marked fragment shows."""
    return F.when(_c(content_indexed), NO_FRAGMENT).otherwise(NO_PREVIEW)
