"""Tool output and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treescan.functions.columns import format_diag, guess_level, level_of

TRIM = r"^\s+|\s+$"
TABS = ["All", "Error", "Info", "Debug"]


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (line, is_stderr, ...) with level and message; blank lines go. Works on streams too."""
    text = F.regexp_replace("line", TRIM, "")
    parts = F.split(F.substr(F.col("_t"), F.lit(7)), "\t", -1)
    fields = F.size(parts)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    place = F.concat(at(2), F.when(at(3) != "", F.concat(F.lit(":"), at(3))).otherwise(""), F.when(at(4) != "", F.concat(F.lit(":"), at(4))).otherwise(""))
    message = F.array_join(F.slice(parts, F.lit(5), F.greatest(fields - 4, F.lit(0))), "\t")
    long_form = F.when(place == "", message).otherwise(F.concat(place, F.lit(": "), message))
    short_form = F.array_join(F.slice(parts, F.lit(2), F.greatest(fields - 1, F.lit(0))), "\t")
    structured = F.col("_t").startswith("@diag\t") & (fields >= 2)
    out = lines.withColumn("_t", text).where("_t <> ''")
    return out.withColumn("level", F.when(structured, level_of(at(1))).otherwise(guess_level(F.col("_t"), F.col("is_stderr")))).withColumn("message", F.when(structured & (fields >= 5), long_form).when(structured, short_form).otherwise(F.col("_t"))).drop("_t")


def wire_lines(diagnostics: DataFrame) -> DataFrame:
    """diagnostics (level, file, line, col, message) as one column of wire lines, ``value``."""
    return diagnostics.select(format_diag(F.col("level"), F.col("file"), F.col("line"), F.col("col"), F.col("message")).alias("value"))


def shown_level(level: Column) -> Column:
    """Warnings are shown with Info."""
    return F.when(level == "Warning", "Info").otherwise(level)


def log_tabs(entries: DataFrame) -> DataFrame:
    """Entries by source and tab; the tab All has every entry."""
    tab = F.coalesce(F.col("tab"), F.lit("All"))
    rows = entries.withColumn("tab", shown_level(F.col("level")))
    return rows.groupingSets([["source", "tab"], ["source"]], "source", "tab").agg(F.count("*").alias("n")).select("source", tab.alias("tab"), "n")


def first_errors(diagnostics: DataFrame) -> DataFrame:
    """Per tu the first error or fatal: message and file; an empty file is the tu's own."""
    bad = diagnostics.where(F.lower("level").isin("error", "fatal"))
    first = F.min(F.struct("seq", "message", "file"))
    return bad.groupBy("tu").agg(first.alias("f")).select("tu", F.col("f.seq").alias("seq"), F.when(F.coalesce("f.file", F.lit("")) == "", F.col("tu")).otherwise(F.col("f.file")).alias("file"), F.col("f.message").alias("message"))


def retain_log(entries: DataFrame, cap: int = 5000) -> DataFrame:
    """The newest cap entries of each tab (source, tab): ranked after a first cut within hash parts, so that a busy tab
    is not ranked by one task."""
    part = F.pmod(F.xxhash64("seq"), F.lit(64))
    both = entries.withColumn("tab", F.explode(F.array(F.lit("All"), shown_level(F.col("level"))))).withColumn("_part", part)
    newest = [F.col("ts").desc(), F.col("seq").desc()]
    cut = both.withColumn("_rank", F.row_number().over(Window.partitionBy("tab", "_part").orderBy(*newest))).where(F.col("_rank") <= cap).drop("_rank", "_part")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("tab").orderBy(*newest))).where(F.col("rank") <= cap)


def run_progress(events: DataFrame) -> DataFrame:
    """events (run, total, ok) to completed, failed, total and status of each run. Works on streams too."""
    s = events.groupBy("run").agg(F.count_if(F.col("ok")).alias("completed"), F.count_if(~F.col("ok")).alias("failed"), F.max("total").alias("total"))
    done = F.col("completed") + F.col("failed") >= F.col("total")
    return s.withColumn("status", F.when(~done, "running").when(F.col("failed") == F.col("total"), "error").otherwise("merged"))
