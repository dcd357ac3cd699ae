"""The search language: AND of words, "phrases", -exclusions, * and ? wildcards, field prefixes."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from enum import Enum

from gleanwork.functions.text import TOKEN


class Scope(Enum):
    BOTH = "FileNameAndContent"
    NAME = "FileNameOnly"
    CONTENT = "ContentOnly"


class Kind(Enum):
    TERM = "Term"
    PHRASE = "Phrase"
    WILDCARD = "Wildcard"


#: White space between clauses (fixed values: the characters that Unicode calls white space).
BLANK = frozenset("\t\n\v\f\r \x85\xa0                　")
PREFIXES = (("filename:", Scope.NAME), ("name:", Scope.NAME), ("content:", Scope.CONTENT))
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯豈-﫿]")


@dataclass(frozen=True)
class Clause:
    kind: Kind
    text: str
    excluded: bool = False
    scope: Scope | None = None
    tokens: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    """Clauses that all must hold; ``scope`` is that of clauses without a prefix."""

    clauses: tuple[Clause, ...]
    scope: Scope = Scope.BOTH

    @property
    def positive(self) -> tuple[Clause, ...]:
        return tuple(c for c in self.clauses if not c.excluded)

    @property
    def negative(self) -> tuple[Clause, ...]:
        return tuple(c for c in self.clauses if c.excluded)


def analyze(text: str) -> list[str]:
    """The tokens of a text, as the index has them."""
    return re.findall(TOKEN, text.lower())


def lex(raw: str) -> list[Clause]:
    """The clauses of a query, in order. Every string is a query; nothing raises."""
    out, at, n = [], 0, len(raw)
    while at < n:
        if raw[at] in BLANK:
            at += 1
            continue
        excluded = raw[at] == "-" and at + 1 < n and raw[at + 1] not in BLANK
        at += excluded
        quoted = raw[at] == '"'
        if quoted:
            end = raw.find('"', at + 1)
            end = n if end < 0 else end
            text, at = raw[at + 1 : end], end + 1
        else:
            end = next((i for i in range(at, n) if raw[i] in BLANK), n)
            text, at = raw[at:end], end
        if all(c in BLANK for c in text):
            continue
        scope = None
        for prefix, own in PREFIXES:
            if len(text) > len(prefix) and text[: len(prefix)].lower() == prefix:
                text, scope = text[len(prefix) :], own
                break
        kind = Kind.PHRASE if quoted else Kind.WILDCARD if "*" in text or "?" in text else Kind.TERM
        out.append(Clause(kind, text, excluded, scope))
    return out


def parse(raw: str | None, scope: Scope = Scope.BOTH, analyzer=analyze) -> Query | None:
    """The query, or None where nothing is asked. A clause without tokens is dropped.

    A word of several ideographs is a phrase: the analyzer has one token for each, which must be
    neighbours for the word to occur."""
    clauses = []
    for c in lex(raw or ""):
        if c.kind is Kind.WILDCARD:
            clauses.append(replace(c, text=c.text.lower()))
            continue
        tokens = tuple(analyzer(c.text))
        if tokens:
            kind = Kind.PHRASE if c.kind is Kind.TERM and len(tokens) > 1 and _CJK.search(c.text) else c.kind
            clauses.append(replace(c, kind=kind, tokens=tokens))
    return Query(tuple(clauses), scope) if clauses else None


def wildcard_regex(pattern: str) -> str:
    """Java regular expression of a wildcard: * any run, ? one character, backslash escapes."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            c = pattern[at]
            out.append(_escape(c))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else _escape(c))
        at += 1
    return f"^(?s:{''.join(out)})$"


def _escape(c: str) -> str:
    return c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c
