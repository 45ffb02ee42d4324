"""Operators on spreadsheet-like tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stacked(row: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    """One wide row of ``measure__column`` to a row for each column."""
    parts = ", ".join(f"'{c}', " + ", ".join(f"`{m}__{c}`" for m in measures) for c in names)
    return row.select(F.expr(f"stack({len(names)}, {parts}) AS (name, {', '.join(measures)})"))


def statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """``name, low, high, mean, total, n`` of numeric columns in one pass; all null for a column of nulls."""
    made = {"low": F.min, "high": F.max, "mean": lambda c: F.round(F.avg(c), 2), "total": lambda c: F.round(F.sum(c), 2), "n": F.count}
    row = df.select(*[F.col(c).cast("double").alias(c) for c in names]).agg(*[f(c).alias(f"{m}__{c}") for c in names for m, f in made.items()])
    return _stacked(row, names, list(made))


#: How a text begins that is a date; how many values are looked at.
DATE_HEAD = r"^\d{4}-\d{2}-\d{2}|^\d{2}/\d{2}/\d{4}|^\d{2}-\d{2}-\d{4}"
SAMPLE = 10


def profile(df: DataFrame, names: list[str], order: str) -> DataFrame:
    """``name, date_share, number_share, type`` of columns. Typed columns have their type; texts are told by their first ten values in ``order``: dates, numbers with blanks or commas, else text."""
    kinds = {c: df.schema[c].dataType for c in names}
    typed = {c: "integer" if isinstance(k, T.IntegralType) else "decimal" if isinstance(k, T.FractionalType) else "datetime" if isinstance(k, T.DateType | T.TimestampType | T.TimestampNTZType) else "boolean" if isinstance(k, T.BooleanType) else None for c, k in kinds.items()}
    firsts = [df.where(F.col(c).isNotNull()).orderBy(order).limit(SAMPLE).select(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in names]
    rows = firsts[0]
    for other in firsts[1:]:
        rows = rows.unionByName(other)
    share = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 4)
    number = F.regexp_replace(F.replace("v", F.lit(" "), F.lit("")), ",", ".").try_cast("double").isNotNull()
    told = rows.groupBy("name").agg(share(F.col("v").rlike(DATE_HEAD)).alias("date_share"), share(number).alias("number_share"))
    known = F.create_map(*[F.lit(x) for c, k in typed.items() if k for x in (c, k)]) if any(typed.values()) else F.create_map().cast("map<string,string>")
    guess = F.when(F.col("date_share") > 0.5, "datetime").when(F.col("number_share") > 0.7, "numeric_text").otherwise("text")
    return told.withColumn("type", F.coalesce(known[F.col("name")], guess))


#: Relative error of the sketches of distinct values, and how near the limit a count is made exact: five of these.
SKETCH, NEAR = 0.02, 5


def key_columns(df: DataFrame, names: list[str], most: int = 3) -> DataFrame:
    """The first columns with more than one, but few, distinct values and few nulls.

    One scan sketches every column; only those whose share of distinct values is near the limit
    are counted exactly, in a second one. A column has more than one value if its least and
    largest differ.
    """
    sketched = [x for c in names for x in (F.approx_count_distinct(c, SKETCH).alias(f"d__{c}"), F.count(F.lit(1)).alias(f"n__{c}"), F.count_if(F.col(c).isNull()).alias(f"missing__{c}"), (F.min(c) != F.max(c)).alias(f"several__{c}"))]
    row = df.agg(*sketched).first()
    open_ = [c for c in names if row[f"several__{c}"] and abs(row[f"d__{c}"] - 0.2 * row[f"n__{c}"]) <= NEAR * SKETCH * 0.2 * row[f"n__{c}"]]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in open_]).first() if open_ else {}
    good = [c for c in names if row[f"several__{c}"] and (exact[c] if c in open_ else row[f"d__{c}"]) < 0.2 * row[f"n__{c}"] and row[f"missing__{c}"] < 0.1 * row[f"n__{c}"]]
    return df.sparkSession.createDataFrame([(c,) for c in good[:most]], "name string")


def unique_names(names: list[str]) -> list[str]:
    """Second and later uses of a name get ``_1``, ``_2``, …"""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(f"{n}_{seen[n]}" if n in seen else n)
        seen[n] = seen.get(n, 0) + 1
    return out


def cleaned(df: DataFrame) -> DataFrame:
    """Without columns and rows that hold nothing; names trimmed and made unique. One aggregation finds the empty columns."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(df.columns)]).first()
    names = [c for k, c in enumerate(df.columns) if counts[k]]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(names, unique_names([c.strip() for c in names]), strict=True)]).dropna("all")


def cell(df: DataFrame, name: str):
    """A cell as Markdown: floats of 1 or more with two decimals and thousands commas, others with four, pipes escaped, nulls empty."""
    x = F.col(name)
    if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType | T.DecimalType):
        said = F.when(F.abs(x) >= 1, F.format_number(x, 2)).otherwise(F.format_string("%.4f", x.cast("double")))
        return F.when(x.isNull(), F.lit("")).otherwise(said)
    return F.coalesce(F.replace(x.cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))


def markdown(df: DataFrame, by: str, names: list[str], order: str, most: int = 50) -> DataFrame:
    """``by, markdown, n_rows``: one Markdown table for each value of ``by``, at most ``most`` rows in order, and a line that counts the rows left out."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(df, n) for n in names]), F.lit(" |"))
    w = Window.partitionBy(by).orderBy(order)
    rows = df.select(by, F.row_number().over(w).alias("_n"), line.alias("_line"))
    head = f"| {' | '.join(names)} |\n|{'---|' * len(names)}\n"
    shown = F.when(F.col("_n") <= most, F.struct("_n", "_line"))
    grouped = rows.groupBy(by).agg(F.array_sort(F.collect_list(shown)).alias("_rows"), F.count(F.lit(1)).alias("n_rows"))  # ``most`` rows
    body = F.concat(F.lit(head), F.array_join(F.transform("_rows", lambda x: x["_line"]), "\n"))
    more = F.when(F.col("n_rows") > most, F.concat(F.lit("\n\n*... ("), F.col("n_rows") - most, F.lit(" lignes supplémentaires)*"))).otherwise(F.lit(""))
    return grouped.select(by, F.concat(body, more).alias("markdown"), "n_rows")


def sheet_heads(sheets: DataFrame) -> DataFrame:
    """``sheets`` (``sheet_name, path, columns, n_rows``) with ``head``: name, file, folder, the first ten columns and how many more, rows."""
    parts = F.split("path", "/")
    folder = F.when(F.size(parts) > 3, F.array_join(F.slice(parts, -3, 2), "/")).when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    more = F.when(F.size("columns") > 10, F.concat(F.lit(" (+"), F.size("columns") - 10, F.lit(" autres)"))).otherwise(F.lit(""))
    shown = F.concat(F.array_join(F.slice("columns", 1, 10), ", "), more)
    line = lambda name, x: F.concat(F.lit(f"**{name}**: "), x)
    return sheets.withColumn("head", F.concat_ws("\n", F.concat(F.lit("## Tableau: "), "sheet_name"), F.lit(""), line("Source", F.element_at(parts, -1)), line("Chemin", folder), line("Feuille", F.col("sheet_name")), line("Colonnes", shown), line("Lignes", F.col("n_rows")), F.lit("")))


def statistics_lines(stats: DataFrame) -> DataFrame:
    """``name, said``: rows of :func:`statistics` as Markdown lines; columns of nulls have none."""
    n = lambda c: F.format_number(c, 2)
    return stats.where("total IS NOT NULL").select("name", F.concat(F.lit("- **"), "name", F.lit("**: somme="), n("total"), F.lit(", moy="), n("mean"), F.lit(", min="), n("low"), F.lit(", max="), n("high")).alias("said"))


def schema_rows(df: DataFrame) -> DataFrame:
    """``place, name, type, nullable`` of a table's columns."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, type string, nullable boolean")


def metadata(df: DataFrame, sheet_name: str, order: str, table: str | None = None) -> DataFrame:
    """One row that describes a sheet: ``sheet_name, columns, column_types, row_count, numeric_stats, key_columns, has_sql_copy, sql_table``."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    types = profile(df, df.columns, order).agg(F.map_from_entries(F.collect_list(F.struct("name", "type"))).alias("column_types"))  # a row for each column
    keys = key_columns(df, df.columns).agg(F.array_sort(F.collect_list("name")).alias("key_columns"))
    row = df.agg(F.count(F.lit(1)).alias("row_count")).crossJoin(types).crossJoin(keys)  # one row each
    if numeric:
        row = row.crossJoin(statistics(df, numeric).agg(F.array_sort(F.collect_list(F.struct("name", "low", "high", "mean", "total"))).alias("numeric_stats")))
    else:
        row = row.withColumn("numeric_stats", F.array())
    return row.select(F.lit(sheet_name).alias("sheet_name"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "column_types", "row_count", "numeric_stats", "key_columns", F.lit(table is not None).alias("has_sql_copy"), F.lit(table).alias("sql_table"))


def workbook(sheets: dict[str, Callable[[], DataFrame]], by: str, names: list[str], order: str) -> tuple[DataFrame | None, dict[str, str]]:
    """``sheet_name, markdown`` of all sheets, and the errors of those that could not be opened: one broken sheet doesn't take the others with it."""
    found, failed = None, {}
    for name, open_ in sheets.items():
        try:
            part = markdown(open_(), by, names, order).select(F.lit(name).alias("sheet_name"), "markdown")
        except Exception as why:  # the sheet's error is reported beside the others' tables
            failed[name] = f"{type(why).__name__}: {why}"
            continue
        found = part if found is None else found.unionByName(part)
    return found, failed


def joined_sheets(rows: DataFrame, name: str = "sheet_name", text: str = "markdown") -> DataFrame:
    """All sheets of a workbook as one text, by name, with a rule between them."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, text))), lambda x: x[text]), "\n\n---\n\n").alias(text))  # sheets of one workbook


def sample(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows in an order that doesn't change."""
    return df.orderBy(order).limit(n)


def adhoc(spark: SparkSession, tables: dict[str, DataFrame], sql: str, **arguments) -> DataFrame:
    """Any SELECT over named tables, ``{name}`` in the text, with ``:name`` parameters."""
    return spark.sql(sql, args=arguments, **tables)
