"""File types: extension, category, icon, colour and how far a type is indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FULL_TEXT, NAME_ONLY = "FullText", "FileNameOnly"
DEFAULT_COLOR = "#64748B"

# Extension, category, icon label and how far the type is indexed.
ROWS = [
    ("doc", "doc", "DOC", FULL_TEXT),
    ("docx", "doc", "DOC", FULL_TEXT),
    ("rtf", "doc", "RTF", FULL_TEXT),
    ("xls", "sheet", "XLS", FULL_TEXT),
    ("xlsx", "sheet", "XLS", FULL_TEXT),
    ("csv", "sheet", "CSV", FULL_TEXT),
    ("ppt", "ppt", "PPT", NAME_ONLY),
    ("pptx", "ppt", "PPT", NAME_ONLY),
    ("pdf", "pdf", "PDF", FULL_TEXT),
    ("txt", "text", "TXT", FULL_TEXT),
    ("md", "text", "MD", FULL_TEXT),
    ("log", "text", "LOG", FULL_TEXT),
    ("epub", "text", "EPUB", FULL_TEXT),
    ("html", "code", "HTM", FULL_TEXT),
    ("json", "code", "JSON", FULL_TEXT),
    ("xml", "code", "XML", FULL_TEXT),
    ("yaml", "code", "YML", FULL_TEXT),
    ("py", "code", "PY", FULL_TEXT),
    ("java", "code", "JAVA", FULL_TEXT),
    ("c", "code", "C", FULL_TEXT),
    ("cpp", "code", "CPP", FULL_TEXT),
    ("js", "code", "JS", FULL_TEXT),
    ("ts", "code", "TS", FULL_TEXT),
    ("css", "code", "CSS", FULL_TEXT),
    ("ini", "code", "INI", FULL_TEXT),
    ("cfg", "code", "CFG", FULL_TEXT),
    ("sql", "code", "SQL", FULL_TEXT),
    ("bat", "code", "BAT", FULL_TEXT),
    ("sh", "code", "SH", FULL_TEXT),
    ("ps1", "code", "PS1", FULL_TEXT),
]
CATEGORIES = ("all", *dict.fromkeys(r[1] for r in ROWS))
EXTENSIONS = [r[0] for r in ROWS]
SCHEMA = "extension string, category string, icon_label string, strategy string"
_BY_EXTENSION = {r[0]: r for r in ROWS}


def find(extension: str) -> tuple[str, str, str, str] | None:
    """The row of an extension, with or without its dot, in any case."""
    return _BY_EXTENSION.get((extension or "").lstrip(".").lower())


def is_supported(extension: str) -> bool:
    return find(extension) is not None


def strategy(extension: str) -> str | None:
    row = find(extension)
    return row[3] if row else None


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def _lookup(extension: Column, at: int) -> Column:
    """A column of the catalog by extension, as a literal map: 30 entries need no join."""
    table = F.create_map(*[F.lit(x) for r in ROWS for x in (r[0], r[at])])
    return F.try_element_at(table, F.lower(F.ltrim(extension, F.lit("."))))


def category(extension: Column) -> Column:
    return _lookup(extension, 1)


def icon_label(extension: Column) -> Column:
    return F.coalesce(_lookup(extension, 2), F.upper(extension))


def strategy_of(extension: Column) -> Column:
    return _lookup(extension, 3)
