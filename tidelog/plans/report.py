"""Report sinks: CSV, TSV, JSON lines and Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import expressions as E

#: Markdown is for people; a longer table is refused, not cut.
MARKDOWN_ROWS = 10_000


def to_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def to_tsv(df: DataFrame, path: str) -> None:
    to_csv(df, path, sep="\t")


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_rows(*reports: DataFrame) -> DataFrame:
    """One-row reports as one table; columns that one lacks are null."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def _shown(df: DataFrame) -> list[Column]:
    """Every column as text, null for null."""
    return [F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)) if t in ("double", "float") else F.col(c).cast("string") for c, t in df.dtypes]


def csv_lines(df: DataFrame) -> DataFrame:
    """value: each row as a line of CSV, doubles with four decimals."""
    return df.select(F.concat_ws(",", *[F.coalesce(E.csv_escape(x), F.lit("")) for x in _shown(df)]).alias("value"))


def markdown(df: DataFrame) -> str:
    """The whole table in the order of df."""
    rows = markdown_lines(df).take(MARKDOWN_ROWS + 1)
    if len(rows) > MARKDOWN_ROWS:
        raise ValueError(f"more than {MARKDOWN_ROWS} rows: write CSV instead")
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(head + [r.value for r in rows]) + "\n"


def markdown_lines(df: DataFrame) -> DataFrame:
    """value: each row as a line of a Markdown table, without its head."""
    shown = [F.coalesce(E.markdown_escape(x), F.lit("")) for x in _shown(df)]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("value"))


def console_lines(report: DataFrame, title: str = "operation") -> DataFrame:
    """value: a report for people, a line for each figure of each row, behind the row's title; null figures have none."""
    names = [c for c in report.columns if c != title]
    shown = dict(zip(report.columns, _shown(report)))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), shown[n].alias("text")) for n in names]))
    rows = report.select(shown[title].alias("title"), each.alias("x")).where("x.text IS NOT NULL")
    return rows.select(F.concat(F.rpad("title", 10, " "), F.rpad("x.name", 16, " "), F.lpad("x.text", 20, " ")).alias("value"))


def console(report: DataFrame, title: str = "operation") -> str:
    """The lines in order; a longer report than MARKDOWN_ROWS lines is refused."""
    rows = console_lines(report, title).take(MARKDOWN_ROWS + 1)
    if len(rows) > MARKDOWN_ROWS:
        raise ValueError(f"more than {MARKDOWN_ROWS} lines: write CSV instead")
    return "\n".join(sorted(r.value for r in rows))
