"""Queries on small odd tables against their SQL."""

import duckdb
import pytest

from lectern import catalog


@pytest.fixture
def same(spark, tmp_path):
    """Writes tables (name, schema, rows), then compares a query's rows with those of its SQL."""

    def check(query, **tables):
        duck = duckdb.connect()
        duck.execute("SET timezone = 'UTC'")
        for name, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        found = catalog.queries()[query](spark, str(tmp_path))
        wanted = duck.execute(catalog.oracle_sql()[query])
        order = [x[0] for x in wanted.description]
        assert sorted(found.columns) == sorted(order)
        assert sorted(map(repr, (tuple(r[c] for c in order) for r in found.collect()))) == sorted(map(repr, wanted.fetchall()))

    return check


def test_aimed_objects(same):
    """Texts without words, and those whose words are an article or a relation."""
    same("aimed_objects", documents=("doc_id long, text string", [(3, "a é 1"), (0, "sur nos toits"), (2, "la"), (5, ""), (1, "de l'eau"), (6, None), (9, "la pour eux")]))


def test_integrated_objects(same):
    """The SQL ends an object at any word that begins with "dans"."""
    same("integrated_objects", documents=("doc_id long, text string", [(0, "dansenai ment xx"), (3, "le danse vite"), (6, "eau dans"), (4, "danse vite xx"), (5, "danse"), (9, ""), (12, None), (7, None)]))


def test_question_tests(same):
    """A letter with an accent ends a word in the SQL's engine."""
    rows = [(1, 2, "Queéé. Èm"), (1, 3, "Où aller"), (1, 6, "oùa"), (1, 7, "qu'on"), (1, 10, "qu' on"), (1, 11, "Qué"), (1, 14, "canç x"), (1, 0, "le but"), (1, 1, "ever"), (1, 15, "Quelle heure")]
    same("question_tests", conversations=("conv_id long, turn long, text string", rows))


def test_means_at_their_goal(spark, tmp_path):
    """A mean of exactly 0.8 is not below 0.8, though doubles added in this order give 0.799999999999998."""
    some = [n for k in range(400) for n in (10 * k + 7, 10 * k + 8, 10 * k + 9) if n % 9]
    ids = [n for d in (9, 8, 7) for n in [x for x in some if x % 10 == d][:100]]
    total = 0.0
    for n in ids:
        total += n % 10 / 10
    assert total / len(ids) < 0.8
    spark.createDataFrame([(n, 1) for n in ids], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(n, "s") for n in ids], "doc_id long, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["metric"] for r in catalog.queries()["suggested_parameters"](spark, str(tmp_path)).collect()} == {"relevancy"}
    assert {r["metric"]: r["severity"] for r in catalog.queries()["eval_recommendations"](spark, str(tmp_path)).collect()}["faithfulness"] == "none"
