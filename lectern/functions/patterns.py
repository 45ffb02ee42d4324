"""Many words at once in one pass of a text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, word in enumerate(words):
        if word:
            out.add_word(word, [*out.get(word, []), k])
    if len(out):
        out.make_automaton()
    return out


def begun_by(text: Column, words: list[str]) -> Column:
    """Places in ``words`` of those with which a word of ``text`` begins, ascending, each once: a match counts where no small letter or digit stands before it.

    One automaton over all words, built once in each worker, reads a text once, whatever the
    number of words. Empty words match nothing; a null text has none.
    """
    held: list[ahocorasick.Automaton] = []

    def of(said: str | None) -> list[int]:
        if not said or not len(held[0]):
            return []
        found: set[int] = set()
        for end, places in held[0].iter(said):
            start = end - len(words[places[0]])
            if start < 0 or not ("a" <= said[start] <= "z" or "0" <= said[start] <= "9"):
                found.update(places)
        return sorted(found)

    @F.pandas_udf(ArrayType(IntegerType()))
    def matched(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held[:] = held or [_automaton(words)]
        for part in parts:
            yield part.map(of)

    return matched(text)
