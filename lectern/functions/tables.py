"""The chunkers as table functions, for SQL's LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import STRATEGIES, Layout, check_sizes, mail_chunks

SCHEMA = "chunk_index int, start int, end int, chunk string"


def _chunker(strategy: str) -> type:
    class Chunks:
        """Rows of a text's chunks; a null or blank text has none."""

        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
            check_sizes(size, overlap)
            chunks = mail_chunks(text or "", size) if strategy == "email" else Layout(text or "").packed(STRATEGIES[strategy], size, overlap)
            for at, (start, end, said) in enumerate(chunks):
                yield at, start, end, said

    return Chunks


def register(spark: SparkSession) -> list[str]:
    """Register ``chunk_<strategy>(text, size, overlap)`` for every strategy: ``chunk_index, start, end, chunk``. Rows come in Arrow batches."""
    names = []
    for strategy in STRATEGIES:
        names.append(f"chunk_{strategy}")
        spark.udtf.register(names[-1], udtf(_chunker(strategy), returnType=SCHEMA, useArrow=True))
    return names
