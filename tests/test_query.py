import fnmatch
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gleanwork.plans.query import Kind, Scope, lex, parse, wildcard_regex


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("a b", [(Kind.TERM, "a", False, None), (Kind.TERM, "b", False, None)]),
        ('-"x y" z', [(Kind.PHRASE, "x y", True, None), (Kind.TERM, "z", False, None)]),
        ("- x", [(Kind.TERM, "-", False, None), (Kind.TERM, "x", False, None)]),
        ("--x", [(Kind.TERM, "-x", True, None)]),
        ('"abc', [(Kind.PHRASE, "abc", False, None)]),
        ('filename:"a b"', [(Kind.TERM, '"a', False, Scope.NAME), (Kind.TERM, 'b"', False, None)]),
        ('"filename:a b"', [(Kind.PHRASE, "a b", False, Scope.NAME)]),
        ("filename:", [(Kind.TERM, "filename:", False, None)]),
        ('"a*b"', [(Kind.PHRASE, "a*b", False, None)]),
        ("FileName:X", [(Kind.TERM, "X", False, Scope.NAME)]),
        ("name:X content:Y", [(Kind.TERM, "X", False, Scope.NAME), (Kind.TERM, "Y", False, Scope.CONTENT)]),
        ("content:*", [(Kind.WILDCARD, "*", False, Scope.CONTENT)]),
        ('""', []),
        ("　a　b", [(Kind.TERM, "a", False, None), (Kind.TERM, "b", False, None)]),
        ("-", [(Kind.TERM, "-", False, None)]),
    ],
)
def test_lexer(raw, expected):
    assert [(c.kind, c.text, c.excluded, c.scope) for c in lex(raw)] == expected


def test_parse_simplifies():
    assert parse(None) is None and parse(" 　") is None and parse('""') is None
    assert parse("ABC*").clauses[0].text == "abc*"
    assert parse("寻迹").clauses[0].kind is Kind.PHRASE
    assert [c.text for c in parse("a -b").negative] == ["b"]


@given(st.text(alphabet='ab"-*? 　:filename', max_size=30))
def test_lexer_takes_every_string(raw):
    for c in lex(raw):
        assert c.text.strip(" 　")


@given(st.text(alphabet="ab.*?", max_size=8), st.text(alphabet="ab.", max_size=8))
def test_wildcard_is_what_fnmatch_says(pattern, text):
    python = wildcard_regex(pattern).replace("^(?s:", "(?s:").removesuffix("$")
    assert bool(re.fullmatch(python, text)) == fnmatch.fnmatchcase(text, pattern)
