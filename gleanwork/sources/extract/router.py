"""One reader for each extension, and extraction of a table of files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from gleanwork import catalog
from gleanwork.sources.extract import ole, office, pdf, plain

Reader = Callable[[bytes], str]
UNKNOWN_TYPE, NAME_ONLY_REASON = "不支持的文件类型", "仅索引文件名"
PLAIN = ("txt", "md", "log", "csv", "html", "json", "xml", "yaml", "py", "java", "c", "cpp", "js", "ts", "css", "ini", "cfg", "sql", "bat", "sh", "ps1")


def nothing(data: bytes) -> str:
    """Types of which only the name is indexed."""
    return ""


DEFAULT: tuple[tuple[tuple[str, ...], Reader], ...] = (
    (PLAIN, plain.read_text),
    (("docx",), office.read_docx),
    (("doc",), ole.read_doc),
    (("xlsx",), office.read_xlsx),
    (("xls",), ole.read_xls),
    (("pdf",), pdf.read_pdf),
    (("rtf",), plain.read_rtf),
    (("epub",), office.read_epub),
    (("ppt", "pptx"), nothing),
)


class Router:
    """Readers by extension. Each extension of the catalog has exactly one."""

    def __init__(self, readers: Iterable[tuple[Iterable[str], Reader]] = DEFAULT):
        self.readers: dict[str, Reader] = {}
        for extensions, reader in readers:
            for ext in extensions:
                key = ext.lstrip(".").lower()
                if key in self.readers:
                    raise ValueError(f"two readers for {key}")
                self.readers[key] = reader
        missing = [e for e in catalog.EXTENSIONS if e not in self.readers]
        if missing:
            raise ValueError(f"no reader for {', '.join(missing)}")

    def with_reader(self, extensions: Iterable[str], reader: Reader) -> Router:
        """A router that also, or instead, uses ``reader`` for these extensions."""
        out = Router.__new__(Router)
        out.readers = self.readers | {e.lstrip(".").lower(): reader for e in extensions}
        return out

    def is_supported(self, extension: str) -> bool:
        return extension.lstrip(".").lower() in self.readers

    def strategy(self, extension: str) -> str | None:
        return catalog.strategy(extension)

    def extract(self, extension: str, data: bytes) -> tuple[bool, str, str | None]:
        """(success, content, reason). Never raises: a file that can't be read is a reason."""
        reader = self.readers.get((extension or "").lstrip(".").lower())
        if reader is None:
            return False, "", UNKNOWN_TYPE
        try:
            return True, reader(data), None
        except Exception as e:  # whatever is wrong with one file must not stop the others
            return False, "", f"{type(e).__name__}: {e}"[:500]


def extract(files: DataFrame, router: Router) -> DataFrame:
    """(path, content, success, failure_reason) of files (path, extension, content binary). The bytes
    are dropped as soon as a file is read."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [router.extract(e, bytes(c)) for e, c in zip(b["extension"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "success": [r[0] for r in rows], "content": [r[1] for r in rows], "failure_reason": [r[2] for r in rows]})

    return files.select("path", "extension", "content").mapInPandas(run, "path string, success boolean, content string, failure_reason string")
