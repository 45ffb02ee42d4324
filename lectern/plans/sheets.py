"""Spreadsheet-like tables: statistics, profiles, rendering, ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets as S
from .registry import query, table

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS low, max({c}) AS high, round(avg({c}), 2) AS mean, round(sum({c}), 2) AS total, count({c})::BIGINT AS n FROM lineitem" for c in _NUMERIC))
def table_stats(spark, sf_dir):
    return S.statistics(table(spark, sf_dir, "lineitem"), _NUMERIC)


@query("""WITH v AS (SELECT name, v FROM (SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_size', 'p_retailprice', 'said', 'day']) AS name, unnest([p_name, p_brand, p_size::VARCHAR, p_retailprice::VARCHAR, '1 234,5', CASE WHEN p_partkey % 3 = 0 THEN 'n.d.' ELSE '03-12-2024' END]) AS v FROM part) QUALIFY row_number() OVER (PARTITION BY name ORDER BY p_partkey) <= 10),
s AS (SELECT name, round(avg(CASE WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}|^\\d{2}/\\d{2}/\\d{4}|^\\d{2}-\\d{2}-\\d{4}') THEN 1.0 ELSE 0.0 END), 4) AS date_share, round(avg(CASE WHEN TRY_CAST(replace(replace(v, ' ', ''), ',', '.') AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS number_share FROM v GROUP BY name)
SELECT *, CASE name WHEN 'p_size' THEN 'integer' WHEN 'p_retailprice' THEN 'decimal' ELSE CASE WHEN date_share > 0.5 THEN 'datetime' WHEN number_share > 0.7 THEN 'numeric_text' ELSE 'text' END END AS type FROM s""")
def sheet_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"said": F.lit("1 234,5"), "day": F.when(F.col("p_partkey") % 3 == 0, "n.d.").otherwise("03-12-2024")})
    return S.profile(rows, ["p_name", "p_brand", "p_size", "p_retailprice", "said", "day"], "p_partkey")


@query("SELECT name FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS name, count(DISTINCT {c}) AS d, count(*) AS n, count(*) - count({c}) AS missing FROM part" for k, c in enumerate(["p_partkey", "p_name", "p_brand", "p_type", "p_size"])) + ") WHERE d > 1 AND d < 0.2 * n AND missing < 0.1 * n ORDER BY k LIMIT 3")
def key_columns(spark, sf_dir):
    return S.key_columns(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


@query("SELECT n_nationkey AS k, 'x' AS keep FROM nation WHERE n_nationkey % 5 <> 0")
def clean_table(spark, sf_dir):
    """Empty columns and rows go, names are trimmed."""
    k = F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey"))
    raw = table(spark, sf_dir, "nation").select(k.alias(" k "), F.when(k.isNotNull(), F.lit("x")).alias("keep"), F.lit(None).cast("string").alias("nothing"))
    return S.cleaned(raw)


@query("""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, '| ' || c_custkey || ' | ' || replace(c_name, '#', '\\|') || ' | ' || CASE WHEN abs(c_acctbal) >= 1 THEN format('{:,.2f}', c_acctbal) ELSE printf('%.4f', c_acctbal) END || ' |' AS l FROM customer)
SELECT c_nationkey, '| key | name | balance |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(l, chr(10) ORDER BY n) FILTER (n <= 5) || CASE WHEN count(*) > 5 THEN chr(10) || chr(10) || '*... (' || (count(*) - 5) || ' lignes supplémentaires)*' ELSE '' END AS markdown, count(*)::BIGINT AS n_rows FROM r GROUP BY c_nationkey""")
def sheet_markdown(spark, sf_dir):
    """Customers of a nation as a sheet: pipes in names, balances with thousands, the rows left out counted."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("key"), F.replace("c_name", F.lit("#"), F.lit("|")).alias("name"), F.col("c_acctbal").alias("balance"))
    return S.markdown(rows, "c_nationkey", ["key", "name", "balance"], "key", 5)


@query("""SELECT n_nationkey, '## Tableau: ' || n_name || chr(10) || chr(10) || '**Source**: n.xlsx' || chr(10) || '**Chemin**: b/c' || chr(10) || '**Feuille**: ' || n_name || chr(10) || '**Colonnes**: ' || array_to_string(list_transform(range(1, least(10, n_nationkey) + 1), lambda i: 'c' || i), ', ') || CASE WHEN n_nationkey > 10 THEN ' (+' || (n_nationkey - 10) || ' autres)' ELSE '' END || chr(10) || '**Lignes**: 7' || chr(10) AS head FROM nation""")
def sheet_heads(spark, sf_dir):
    columns = F.when(F.col("n_nationkey") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_nationkey"))), lambda i: F.concat(F.lit("c"), i))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("sheet_name"), F.lit("/a/b/c/n.xlsx").alias("path"), columns.alias("columns"), F.lit(7).alias("n_rows"))
    return S.sheet_heads(rows).select("n_nationkey", "head")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, '- **{c}**: somme=' || format('{{:,.2f}}', round(sum({c}), 2)::DOUBLE) || ', moy=' || format('{{:,.2f}}', round(avg({c}), 2)) || ', min=' || format('{{:,.2f}}', min({c})::DOUBLE) || ', max=' || format('{{:,.2f}}', max({c})::DOUBLE) AS said FROM part" for c in ("p_size", "p_retailprice")))
def sheet_statistics_lines(spark, sf_dir):
    return S.statistics_lines(S.statistics(table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"]))


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int', true), (1, 'r_name', 'string', true)) v(place, name, type, nullable)")
def table_schema(spark, sf_dir):
    return S.schema_rows(table(spark, sf_dir, "region"))


@query("SELECT 'part' AS sheet_name, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS columns, count(*)::BIGINT AS row_count, round(sum(p_size), 2)::DOUBLE AS total_size, true AS has_sql_copy FROM part")
def sheet_metadata(spark, sf_dir):
    rows = S.metadata(table(spark, sf_dir, "part"), "part", "p_partkey", "t_part")
    size = F.filter("numeric_stats", lambda x: x["name"] == "p_size")[0]["total"]
    return rows.select("sheet_name", F.array_join("columns", ",").alias("columns"), "row_count", size.cast("double").alias("total_size"), "has_sql_copy")


@query("""WITH m AS (SELECT n_regionkey, '| k | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS t FROM nation GROUP BY n_regionkey)
SELECT string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n_regionkey) AS markdown FROM m""")
def workbook_text(spark, sf_dir):
    """A sheet for every region as one text; one more can't be opened, which its error tells."""
    nations = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    sheets = {f"sheet {r}": (lambda r=r: nations.where(F.col("n_regionkey") == r)) for (r,) in sorted(nations.select("n_regionkey").distinct().collect())}  # regions
    rows, failed = S.workbook(sheets | {"broken": lambda: nations.select("missing")}, "n_regionkey", ["k", "name"], "k")
    assert list(failed) == ["broken"]
    return S.joined_sheets(rows)


@query("SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def adhoc_sql(spark, sf_dir):
    return S.adhoc(spark, {"customer": table(spark, sf_dir, "customer")}, "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM {customer} WHERE c_acctbal > :least GROUP BY c_mktsegment", least=0)


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' OR p_brand ILIKE '%brand#1%'")
def table_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%a%") | F.col("p_brand").ilike("%brand#1%")).select("p_partkey")
