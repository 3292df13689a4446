"""Markdown clone reports: overview, member table and code of each member; and the reports written from results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.code import strip


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text) of whole report files."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def report_overview(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, members, match_type, avg_similarity); 0, `unknown` and 0.0 where the overview lacks them."""
    t = F.col(text)
    # The labels and forms of the report.
    return reports.select(
        key,
        F.coalesce(_found(t, r"\|\s*Members\s*\|\s*([0-9]+)").try_cast("long"), F.lit(0)).alias("members"),
        F.coalesce(_found(t, r"\|\s*Match Type\s*\|\s*`([^`]+)`"), F.lit("unknown")).alias("match_type"),
        F.coalesce(_found(t, r"\|\s*Avg Similarity\s*\|\s*([0-9.]+)%").try_cast("double"), F.lit(0.0)).alias("avg_similarity"),
    )


def report_members(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, row, state, function, file, start_line, end_line, loc, revision, similarity): the well-formed rows of the member table.

    `row` counts the table's lines from 0, header and rule aside. Rows of fewer than 8 cells and rows with something else than a number
    where one belongs are left out; a single line number is both start and end.
    """
    table = F.regexp_extract(F.col(text), r"(?s)## Members.*?\n\n(.*?)(?=\n##|\z)", 1)
    lines = F.split(strip(table), "\n")
    rows = reports.select(key, F.posexplode(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))).alias("row", "line")).where(F.col("line").startswith("|"))
    parts = F.split("line", r"\|")
    cells = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), strip)
    cell = lambda i: F.get(F.col("c"), F.lit(i))
    whole = lambda x: F.when(strip(x).rlike(r"^[+-]?[0-9]+$"), strip(x).try_cast("long"))
    ends = F.split(cell(4), "-")
    start = whole(F.get(ends, F.lit(0)))
    return (
        rows.withColumn("c", cells)
        .where(F.size("c") >= 8)
        .select(
            key,
            "row",
            cell(1).alias("state"),
            F.replace(cell(2), F.lit("..."), F.lit("")).alias("function"),
            F.replace(cell(3), F.lit("..."), F.lit("")).alias("file"),
            start.alias("start_line"),
            F.when(F.size(ends) > 1, whole(F.get(ends, F.lit(1)))).otherwise(start).alias("end_line"),
            whole(cell(5)).alias("loc"),
            cell(6).alias("revision"),
            F.replace(cell(7), F.lit("%"), F.lit("")).try_cast("double").alias("similarity"),
        )
        .where("start_line is not null and end_line is not null and loc is not null and similarity is not null")
    )


def report_snippets(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, current, previous): the code of each numbered section; null where a section lacks it."""
    sections = F.split(F.col(text), r"\n### [0-9]+\.")
    rows = reports.select(key, F.posexplode(F.slice(sections, 2, F.greatest(F.size(sections) - 1, F.lit(0)))).alias("section", "s"))

    def fenced(title: str) -> Column:
        pattern = rf"(?s)#### {title}.*?```python\n(.*?)```"
        return F.when(F.col("s").rlike(pattern), strip(F.regexp_extract("s", pattern, 1)))

    return rows.select(key, "section", fenced("Current").alias("current"), fenced("Previous").alias("previous"))


def report_methods(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The members of each report, in order, beside the code of the section of the same place and the report's overview."""
    from pyspark.sql import Window

    members = report_members(reports, key, text).withColumn("section", (F.row_number().over(Window.partitionBy(key).orderBy("row")) - 1).cast("int"))
    return members.join(report_snippets(reports, key, text), [key, "section"], "left").join(report_overview(reports, key, text), key)


def render_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; an error if it has more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *[f"| {' | '.join(cell(v) for v in r)} |" for r in rows]])


def render_report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A Markdown report of small results and texts."""
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{body if isinstance(body, str) else render_table(body)}" for name, body in sections.items()]]) + "\n"
