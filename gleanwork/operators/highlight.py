"""Marked file names and content fragments of the documents on a result page."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from gleanwork.functions.text import MARK_CLOSE, MARK_OPEN, TOKEN
from gleanwork.plans.query import Kind, Query, wildcard_regex

FRAGMENT = 80
ANALYZED = 51200


def spans(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) of a text, as the analyzer sees it."""
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(TOKEN, text, re.I)]


def matched(query: Query, toks: list[tuple[str, int, int]]) -> dict[int, str]:
    """Numbers of the tokens to mark, each with the term it stands for. Exclusions mark nothing;
    phrases mark where their tokens are neighbours."""
    out: dict[int, str] = {}
    words = [t[0] for t in toks]
    for c in query.positive:
        if c.kind is Kind.WILDCARD:
            rx = re.compile(wildcard_regex(c.text).replace("^(?s:", "(?s:").removesuffix("$"))
            out.update({i: w for i, w in enumerate(words) if rx.fullmatch(w)})
        elif c.kind is Kind.PHRASE:
            k = len(c.tokens)
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == c.tokens:
                    out.update({i + j: c.tokens[j] for j in range(k)})
        else:
            own = set(c.tokens)
            out.update({i: w for i, w in enumerate(words) if w in own})
    return out


def mark(text: str, toks: list[tuple[str, int, int]], hits: dict[int, str], lo: int, hi: int) -> str:
    """text[lo:hi] with the hit tokens marked; neighbours without a gap share a mark."""
    out, at = [], lo
    numbers = sorted(i for i in hits if toks[i][1] >= lo and toks[i][2] <= hi)
    k = 0
    while k < len(numbers):
        start, end = toks[numbers[k]][1:]
        while k + 1 < len(numbers) and toks[numbers[k + 1]][1] == end:
            k += 1
            end = toks[numbers[k]][2]
        out += [text[at:start], MARK_OPEN, text[start:end], MARK_CLOSE]
        at = end
        k += 1
    return "".join(out) + text[at:hi]


def whole(query: Query, text: str | None) -> str | None:
    """The text with its hits marked; None without one."""
    if not text:
        return None
    toks = spans(text)
    hits = matched(query, toks)
    return mark(text, toks, hits, 0, len(text)) if hits else None


def fragment(query: Query, text: str | None, size: int = FRAGMENT) -> str | None:
    """The fragment of about ``size`` characters with the most distinct hit terms; the first of equals.

    A fragment begins at the first token that ends at or beyond the next multiple of ``size``."""
    if not text:
        return None
    toks = spans(text[:ANALYZED])
    hits = matched(query, toks)
    if not hits:
        return None
    starts, n = [0], 1
    number = []
    for i, (_, _, end) in enumerate(toks):
        if end >= size * n and i:
            starts.append(toks[i][1])
            n = end // size + 1
        number.append(len(starts) - 1)
    terms: dict[int, set[str]] = {}
    for i, term in hits.items():
        terms.setdefault(number[i], set()).add(term)
    best = min(terms, key=lambda f: (-len(terms[f]), f))
    hi = starts[best + 1] if best + 1 < len(starts) else len(text)
    return mark(text, toks, hits, starts[best], hi).strip()


def with_highlights(page: DataFrame, query: Query) -> DataFrame:
    """Add file_name_highlight and content_highlight to a page of results (k rows at most)."""

    def per(fn: Callable[[Query, str | None], str | None]):
        return F.pandas_udf(lambda texts: texts.map(lambda t: fn(query, t)), ST.StringType(), F.PandasUDFType.SCALAR)

    return page.withColumns({"file_name_highlight": per(whole)("file_name"), "content_highlight": per(fragment)("content")})


def slice_fragments(text: Column, terms: list[str], tokenizer, size: int = FRAGMENT) -> Column:
    """JVM form: (number, text, n_terms) of the best of the text's slices of ``size`` characters."""
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))
    cut = F.transform(numbers, lambda i: F.struct(i.alias("number"), F.substring(text, i * size + 1, F.lit(size)).alias("text")))
    wanted = F.array(*[F.lit(t) for t in terms])
    weighed = F.transform(cut, lambda s: F.struct(F.size(F.array_intersect(wanted, tokenizer(s["text"]))).alias("n_terms"), (-s["number"]).alias("order"), s["number"].alias("number"), s["text"].alias("text")))
    return F.array_max(weighed)
