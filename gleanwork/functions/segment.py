"""Word segmentation by a user's dictionary, for scripts without blanks between words.

The native analyzer has one token for each ideograph; with a word list, runs of ideographs are cut
into the words of greatest total log probability, and long words also yield the shorter words in
them (two and three characters) before themselves, as a search index wants them.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

_RUN = re.compile("[぀-ヿ㐀-鿿가-힯豈-﫿]+|[a-z0-9]+(?:\\.[0-9]+)?%?|[^\\s]")
_HAN = re.compile("[぀-ヿ㐀-鿿가-힯豈-﫿]")


class Dictionary:
    """Words with frequencies."""

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.words = {w.lower(): max(1, int(n)) for w, n in words if w}
        self.log_total = math.log(sum(self.words.values()) or 1)
        self.longest = max(map(len, self.words), default=1)

    def _cut(self, run: str) -> list[str]:
        """The most probable words of a run of ideographs; unknown characters stand alone."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            choices = [(math.log(self.words.get(run[i : i + 1], 1)) - self.log_total + best[i + 1][0], i + 1)]
            for j in range(i + 2, min(n, i + self.longest) + 1):
                f = self.words.get(run[i:j])
                if f:
                    choices.append((math.log(f) - self.log_total + best[j][0], j))
            best[i] = max(choices)
        out, at = [], 0
        while at < n:
            out.append(run[at : best[at][1]])
            at = best[at][1]
        return out

    def tokens(self, text: str) -> list[str]:
        out: list[str] = []
        for m in _RUN.finditer(text.lower()):
            if not _HAN.match(m[0]):
                out.append(m[0])
                continue
            for word in self._cut(m[0]):
                for size in (2, 3):
                    if len(word) > size:
                        out += [g for i in range(len(word) - size + 1) if (g := word[i : i + size]) in self.words]
                out.append(word)
        return out


def resolve(file_name: str, roots: Iterable[str]) -> str:
    """The first root's file of that name; an error names all places looked at."""
    places = [os.path.join(r, file_name) for r in dict.fromkeys(roots) if r]
    for p in places:
        if os.path.isfile(p):
            return p
    raise FileNotFoundError(f"{file_name} is in none of: {', '.join(places)}")


def load(path: str) -> Dictionary:
    """A word list with a word and, optionally, its frequency on each line."""
    with open(path, encoding="utf-8") as f:
        rows = [line.split() for line in f if line.strip()]
    return Dictionary((r[0], int(r[1]) if len(r) > 1 and r[1].isdigit() else 1) for r in rows)


def tokenizer(dictionary: Dictionary):
    """A function of a column for :func:`gleanwork.operators.index.postings`, in Arrow batches."""
    run = F.pandas_udf(lambda texts: texts.map(lambda t: dictionary.tokens(t or "")), ST.ArrayType(ST.StringType()), F.PandasUDFType.SCALAR)
    return lambda column: run(column if isinstance(column, Column) else F.col(column))
