"""Search queries as DataFrame plans over postings.

Postings are filtered to the query's terms (a predicate that reaches the Parquet scan; tables are
sorted by term), grouped once by document, and each document's few matching terms are weighed
inside the row: phrases by positions, boolean structure, TF-IDF. Only the first k documents are
joined to their stored columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.plans.query import Clause, Kind, Query, Scope, wildcard_regex
from gleanwork.schemas import CONTENT, NAME

FIELDS = {Scope.BOTH: (NAME, CONTENT), Scope.NAME: (NAME,), Scope.CONTENT: (CONTENT,)}
TOP = 200
#: Terms of a wildcard that postings are looked up by; one that has more is matched against the postings.
EXPANDED = 1000
KEYS = ("profile_id", "path")


def fields_of(clause: Clause, query: Query) -> tuple[str, ...]:
    return FIELDS[clause.scope or query.scope]


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)


def wildcard_predicate(column: Column, pattern: str) -> Column:
    """startswith, endswith and contains where the pattern is of that shape, else a regular expression."""
    body = pattern.strip("*")
    if body and not any(c in body for c in "*?\\"):
        lead, trail = pattern.startswith("*"), pattern.endswith("*")
        return column.contains(body) if lead and trail else column.endswith(body) if lead else column.startswith(body) if trail else column == body
    return column.rlike(wildcard_regex(pattern))


def expand(query: Query, terms: DataFrame | None) -> dict[str, list[str]]:
    """The terms that each content wildcard stands for, where the index has a table of terms and they are few."""
    out = {}
    for c in query.clauses if terms is not None else ():
        if c.kind is Kind.WILDCARD and CONTENT in fields_of(c, query) and c.text not in out:
            found = terms.where((F.col("field") == CONTENT) & wildcard_predicate(F.col("term"), c.text)).select("term").distinct().limit(EXPANDED + 1).collect()
            if len(found) <= EXPANDED:
                out[c.text] = sorted(r.term for r in found)
    return out


def term_filter(query: Query, expanded: dict[str, list[str]] | None = None) -> Column:
    """Postings that can matter to the query."""
    parts, expanded = [], expanded or {}
    for c in query.clauses:
        inside = F.col("field").isin(*fields_of(c, query))
        if c.kind is Kind.WILDCARD:
            if CONTENT in fields_of(c, query):
                few = expanded.get(c.text)
                parts.append((F.col("field") == CONTENT) & (wildcard_predicate(F.col("term"), c.text) if few is None else F.col("term").isin(*few) if few else F.lit(False)))
        else:
            parts.append(inside & F.col("term").isin(*dict.fromkeys(c.tokens)))
    return _any(parts)


def wanted(query: Query):
    """Whether a term can matter to the query, for tables without postings, of which few are then made."""
    tokens = list(dict.fromkeys(t for c in query.clauses for t in c.tokens))
    patterns = [c.text for c in query.clauses if c.kind is Kind.WILDCARD and CONTENT in fields_of(c, query)]
    return lambda term: _any([*([term.isin(*tokens)] if tokens else []), *(wildcard_predicate(term, p) for p in patterns)])


def fields(query: Query) -> tuple[str, ...]:
    """The fields whose postings a query reads."""
    return tuple(f for f in (NAME, CONTENT) if any(f in fields_of(c, query) for c in query.clauses)) or (CONTENT,)


def candidates(docs: DataFrame, query: Query) -> DataFrame:
    """Documents that may match, by substrings: for tables without postings, so that few texts are
    analysed. Every token of a positive clause is a substring of the lower-cased field it is in."""

    def may(c: Clause, field: str) -> Column:
        if c.kind is Kind.WILDCARD:
            parts = [] if "\\" in c.text else [x for x in c.text.replace("?", "*").split("*") if x]
        else:
            parts = list(dict.fromkeys(c.tokens))
        text = F.col("file_name_lc") if field == NAME else F.lower("content")
        return _all([text.contains(x) for x in parts])

    return docs.where(_all([_any([may(c, f) for f in fields_of(c, query)]) for c in query.positive]))


def byte_norm(length: Column) -> Column:
    """1/sqrt(length), cut off to a byte's floating point number: four steps for each power of two."""
    x = (F.lit(1.0) / F.sqrt(F.greatest(length, F.lit(1)).cast("double"))).cast("float").cast("double")
    exponent = F.floor(F.log2(x) + 1e-12)
    mantissa = F.floor((x / F.pow(F.lit(2.0), exponent)) * 4 + 1e-9) / 4
    return mantissa * F.pow(F.lit(2.0), exponent)


def norm(length: Column, kind: str) -> Column:
    return byte_norm(length) if kind == "lucene" else F.lit(1.0) / F.sqrt(F.greatest(length, F.lit(1)).cast("double"))


class Plan:
    """The parts of a search: ``matches`` (profile_id, path, score) of all hits, unordered."""

    def __init__(self, query: Query, docs: DataFrame, postings: DataFrame, norm: str = "exact", terms: DataFrame | None = None):
        self.query, self.docs, self.postings, self.norm = query, docs, postings, norm
        self.expanded = expand(query, terms)

    def _entry(self, field: str, term: str) -> Column:
        """The document's posting of a term, or null: (tf, positions, field_len)."""
        return F.try_element_at(F.col("terms"), F.lit(f"{field}\t{term}"))

    def _phrase_freq(self, field: str, tokens: tuple[str, ...]) -> Column:
        first = F.coalesce(self._entry(field, tokens[0])["positions"], F.array().cast("array<int>"))
        follow = lambda p: _all([F.coalesce(F.array_contains(self._entry(field, t)["positions"], p + i), F.lit(False)) for i, t in enumerate(tokens) if i])
        return F.size(F.filter(first, follow))

    def in_field(self, clause: Clause, field: str) -> Column:
        """Whether a clause holds within one field of the grouped document."""
        if clause.kind is Kind.WILDCARD:
            return F.col(f"wild_{field}_{self.query.clauses.index(clause)}")
        if clause.kind is Kind.PHRASE and len(clause.tokens) > 1:
            return self._phrase_freq(field, clause.tokens) > 0
        return _all([self._entry(field, t).isNotNull() for t in dict.fromkeys(clause.tokens)])

    def holds(self, clause: Clause) -> Column:
        return _any([self.in_field(clause, f) for f in fields_of(clause, self.query)])

    def _frequencies(self) -> tuple[int, dict[tuple[str, str], int]]:
        """Number of documents, and document frequencies of the query's tokens, over the selected
        profiles. One row per token reaches the driver."""
        terms = sorted({t for c in self.query.positive for t in c.tokens})
        n = self.docs.count()
        rows = self.postings.where(F.col("term").isin(*terms)).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).collect() if terms else []
        return n, {(r.field, r.term): r.df for r in rows}

    def _weight(self, clause: Clause, field: str, n: Column, df) -> Column:
        """A clause's weight in one field: tf * idf^2 * norm, summed over its tokens."""
        if clause.kind is Kind.WILDCARD:
            return F.lit(1.0)
        idf = lambda t: 1.0 + F.log(n / (df(field, t) + 1.0))
        length = F.coalesce(*[self._entry(field, t)["field_len"] for t in clause.tokens])
        if clause.kind is Kind.PHRASE and len(clause.tokens) > 1:
            total = reduce(lambda a, b: a + b, [idf(t) for t in clause.tokens])
            return F.sqrt(self._phrase_freq(field, clause.tokens).cast("double")) * total * total * norm(length, self.norm)
        parts = [F.sqrt(self._entry(field, t)["tf"].cast("double")) * idf(t) * idf(t) for t in clause.tokens]
        return reduce(lambda a, b: a + b, parts) * norm(length, self.norm)

    def score(self, n: Column, df) -> Column:
        out = F.lit(0.0)
        for c in self.query.positive:
            fields = fields_of(c, self.query)
            if len(fields) == 1:
                out = out + F.when(self.in_field(c, fields[0]), self._weight(c, fields[0], n, df)).otherwise(0.0)
            else:  # of two optional fields the share that match is a factor
                hit = [self.in_field(c, f) for f in fields]
                total = reduce(lambda a, b: a + b, [F.when(h, self._weight(c, f, n, df)).otherwise(0.0) for h, f in zip(hit, fields, strict=True)])
                out = out + total * reduce(lambda a, b: a + b, [h.cast("int") for h in hit]) / len(fields)
        return out

    def grouped(self) -> DataFrame:
        """One row per candidate document: ``terms`` maps field and term to its posting."""
        q = self.query
        wild = [(i, c) for i, c in enumerate(q.clauses) if c.kind is Kind.WILDCARD]
        # positions are read only where a phrase needs them
        phrases = any(c.kind is Kind.PHRASE and len(c.tokens) > 1 for c in q.clauses)
        entry = F.struct("tf", "field_len", *["positions"] * phrases)
        exact = _any([F.col("field").isin(*fields_of(c, q)) & F.col("term").isin(*dict.fromkeys(c.tokens)) for c in q.clauses if c.tokens])
        key = F.concat_ws("\t", "field", "term")
        content = [F.coalesce(F.bool_or((F.col("field") == CONTENT) & wildcard_predicate(F.col("term"), c.text)), F.lit(False)).alias(f"wild_{CONTENT}_{i}") for i, c in wild if CONTENT in fields_of(c, q)]
        terms = F.map_from_entries(F.collect_list(F.when(exact, F.struct(key, entry)))).alias("terms")
        rows = self.postings.where(term_filter(q, self.expanded)).groupBy(*KEYS).agg(terms, *content)
        names = [(i, c) for i, c in wild if NAME in fields_of(c, q)]
        if names or not q.positive:
            flags = [wildcard_predicate(F.col("file_name_lc"), c.text).alias(f"wild_{NAME}_{i}") for i, c in names]
            base = self.docs.select(*KEYS, *flags)
            if q.positive and all(c.kind is Kind.WILDCARD and fields_of(c, q) == (NAME,) for c in q.positive):
                base = base.where(_all([F.col(f"wild_{NAME}_{i}") for i, c in names if not c.excluded]))
            rows = base.join(rows, list(KEYS), "left")
            rows = rows.withColumns({name: F.coalesce(name, F.lit(False)) for name in rows.columns if name.startswith("wild_")})
        return rows

    def matches(self, scored: bool = True) -> DataFrame:
        q = self.query
        rows = self.grouped().where(_all([self.holds(c) for c in q.positive]) & ~_any([F.coalesce(self.holds(c), F.lit(False)) for c in q.negative]))
        if not scored:
            return rows.select(*KEYS)
        n, df = self._frequencies()
        return rows.select(*KEYS, self.score(F.lit(float(n)), lambda field, term: float(df.get((field, term), 0))).alias("score"))


def none(docs: DataFrame) -> DataFrame:
    return docs.limit(0).select(*KEYS, F.lit(0.0).alias("score"))


def top(matches: DataFrame, k: int = TOP) -> DataFrame:
    """The k best; ties by profile and path."""
    return matches.orderBy(F.desc("score"), *KEYS).limit(k)
