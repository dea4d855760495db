"""Writers of results: reports, knowledge base, audit, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalars
from quern.operators import aggregates
from quern.operators.null_safe import null_safe_join


def redacted(text: Column) -> Column:
    """A text without the values of authorisation headers and keys."""
    return F.regexp_replace(text, r'(?i)("?(?:authorization|api[_-]?key|token)"?\s*[:=]\s*"?)(?:Bearer\s+)?[^",\s}]+', "$1***")


def report(findings: DataFrame, path: str) -> dict[str, str]:
    """findings.json, in report order, and summary.json: counts by facet, top and mean confidence."""
    ordered = findings.orderBy("function", "source_line", "sink_line", "category")
    ordered.write.mode("overwrite").json(f"{path}/findings")
    aggregates.summary(findings, ["severity", "confidence_level", "category", "rule_id"], "confidence").write.mode("overwrite").json(f"{path}/summary")
    return {"findings": f"{path}/findings", "summary": f"{path}/summary"}


def knowledge_base(templates: DataFrame, indexes: dict[str, DataFrame], path: str) -> None:
    """Templates partitioned by domain, and each index."""
    templates.write.mode("overwrite").partitionBy("primary_domain").parquet(f"{path}/templates")
    for name, index in indexes.items():
        index.write.mode("overwrite").parquet(f"{path}/index_{name}")


def append_log(calls: DataFrame, path: str, texts: list[str]) -> None:
    """Call records appended as JSON lines, without secrets."""
    calls.withColumns({t: redacted(F.col(t)) for t in texts}).write.mode("append").json(path)


def by_repository(rows: DataFrame, path: str, repo: str = "repo") -> None:
    rows.write.mode("overwrite").partitionBy(repo).json(path)


def collision_safe(rows: DataFrame, repo: str) -> DataFrame:
    """``rows`` with file: a safe name of the repository, with a part of its hash where an earlier one has the same."""
    repos = rows.select(repo).distinct()
    taken = F.row_number().over(Window.partitionBy(scalars.safe_name(F.col(repo), F.lit(False))).orderBy(repo)) > 1
    named = repos.withColumn("__taken", taken).select(repo, scalars.safe_name(F.col(repo), F.col("__taken")).alias("file"))
    return null_safe_join(rows, named, [repo])


def audit(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """What the rules were given, for a later look: each table as Parquet below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tables}


def candidates(rows: DataFrame, scanned: int, known: dict[str, int], dropped: int, path: str) -> None:
    """Mined candidates as JSON lines, the most frequent first, and beside them what was scanned, known and dropped."""
    rows.orderBy(F.desc("total"), "value").write.mode("overwrite").json(f"{path}/candidates")
    counts = rows.sparkSession.createDataFrame([(scanned, known, dropped)], "records_scanned long, existing_patterns map<string,long>, already_covered_dropped long")
    counts.write.mode("overwrite").json(f"{path}/scan")


def units(selected: DataFrame, verdicts: DataFrame, path: str) -> None:
    """Selected units and their verdicts, a folder a repository; ``verdicts``: repo, unit_id, verdict, rule."""
    by_repository(selected, f"{path}/selected")
    by_repository(verdicts, f"{path}/verdicts")


def validation_summary(summary: DataFrame, path: str, order: str) -> None:
    """One line an advisory, in order; ``markdown`` renders the same for people."""
    summary.orderBy(order).write.mode("overwrite").json(path)


def summary_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, columns: list[str], order: list[str], limit: int = 1000) -> str:
    """A Markdown table of the first ``limit`` rows, for people to read; a last line says how many more there are."""
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    cells = rows.orderBy(*order).limit(limit).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |")).alias("r"))
    shown = [r.r for r in cells.collect()]
    more = rows.count() - len(shown) if len(shown) == limit else 0
    return head + "\n".join(shown) + "\n" + (f"\n{more} more rows\n" if more else "")
