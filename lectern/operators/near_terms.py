"""Terms near other terms: a deletion neighbourhood finds candidates by equality, an alignment confirms them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Letters that near terms begin with alike, most edits, most letters of a term whose deletions are listed, pieces of a longer one.
HEAD, MOST, LONG, PIECES = 2, 2, 16, 5


def allowed(term: Column) -> Column:
    """Edits that a term's length allows."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(MOST)


def _deletions(term: str, most: int) -> set[str]:
    """The term and what is left of it without up to ``most`` letters behind its head."""
    out = layer = {term[HEAD:]}
    for _ in range(most):
        layer = {x[:i] + x[i + 1 :] for x in layer for i in range(len(x))}
        out = out | layer
    return {term[:HEAD] + x for x in out}


def _cuts(length: int) -> list[tuple[int, int]]:
    """Places of the pieces of a term of this length."""
    ends = [HEAD + (length - HEAD) * k // PIECES for k in range(PIECES + 1)]
    return [*zip(ends, ends[1:], strict=False)]


def asked_keys(term: str) -> set[str]:
    """What a near term shares with this one at least one of. Two edits, swaps included, touch four of a long term's five pieces at most."""
    if len(term) <= LONG:
        return _deletions(term, 0 if len(term) <= 2 else 1 if len(term) <= 5 else MOST)
    return {f"{term[:HEAD]} {len(term)} {k} {term[a:b]}" for k, (a, b) in enumerate(_cuts(len(term)))}


def known_keys(term: str) -> set[str]:
    """The keys of asked terms of up to ``MOST`` letters more or less that this term has: pieces stand up to ``MOST`` places off."""
    out = _deletions(term, MOST) if len(term) <= LONG + MOST else set()
    for length in range(max(LONG + 1, len(term) - MOST), len(term) + MOST + 1):
        for k, (a, b) in enumerate(_cuts(length)):
            out |= {f"{term[:HEAD]} {length} {k} {term[a + off : b + off]}" for off in range(-MOST, MOST + 1)}
    return out


def edits(a: str, b: str) -> int:
    """Letters put in, left out, changed or swapped with the next one; no letter is edited twice (optimal string alignment)."""
    two: list[int] = []
    one = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


@F.pandas_udf(IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _keyed(terms: DataFrame, name: str, known: bool) -> DataFrame:
    """Distinct ``field, term`` with each of the term's keys."""
    keys_of = known_keys if known else asked_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                keys = [sorted(keys_of(t)) for t in part.column(1).to_pylist()]
                rows = pa.array([k for k, x in enumerate(keys) for _ in x], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array([x for own in keys for x in own], pa.string())], ["field", name, "_key"])

    return terms.select("field", F.col("term").alias(name)).where(F.col(name).isNotNull()).distinct().mapInArrow(run, f"field string, {name} string, _key string")


def near(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``field, term, found, distance``: for every asked ``field, term`` the field's terms with the same first two letters, at an edit distance that the term's length allows, itself among them.

    A swap of neighbouring letters is one edit. Candidates meet by an equi-join on what is left
    of both terms without up to two letters, or on a piece of a long one; no prefix brings the
    terms that share it together. Lengths differ by two at most.
    """
    pairs = _keyed(asked, "term", False).join(_keyed(vocabulary, "found", True), ["field", "_key"]).select("field", "term", "found").distinct()
    lev = F.levenshtein("term", "found")
    close = pairs.where((F.substring("term", 1, HEAD) == F.substring("found", 1, HEAD)) & (F.abs(F.length("term") - F.length("found")) <= MOST) & (lev <= 2 * allowed(F.col("term"))))  # a swap is two edits there
    return close.withColumn("distance", F.when(lev < 2, lev).otherwise(distance("term", "found"))).where(F.col("distance") <= allowed(F.col("term")))
