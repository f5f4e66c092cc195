"""Include events, headers of translation units (TUs), statistics, errors and the include graph.

Tables: events (tu, seq, header, direct, inclusion_kind), headers (the same, one row per tu and header), errors
(tu, err_seq, message), commands (project, cmd_seq, file, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treescan.functions.columns import is_under_root, normalize_path
from treescan.functions.storage import counted, written
from treescan.operators.paths import dense_ids


def dedupe_headers(events: DataFrame) -> DataFrame:
    """One row per tu and header: direct if any event is, kind and position of the first event."""
    return events.groupBy("tu", "header").agg(F.bool_or("direct").alias("direct"), F.min_by("inclusion_kind", "seq").alias("inclusion_kind"), F.min("seq").alias("seq"))


def first_messages(errors: DataFrame) -> DataFrame:
    return errors.groupBy("tu").agg(F.min_by("message", "err_seq").alias("error"))


def attach_errors(tus: DataFrame, errors: DataFrame) -> DataFrame:
    """tus with partial_data and the first error."""
    return tus.join(first_messages(errors), "tu", "left").withColumn("partial_data", F.col("error").isNotNull())


def dependency_stats(tus: DataFrame, headers: DataFrame, errors: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: files requested, TUs with a result (failed ones too), error rows, headers."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    names = ("total_count", "success_count", "failure_count", "total_header_count")
    rows = reduce(DataFrame.union, map(count, (requested, tus, errors, headers), names))
    return rows.groupBy().pivot("counter", list(names)).agg(F.first("n"))


def merge_stats(chunks: DataFrame) -> DataFrame:
    """Sum of the four counters over readable chunks; chunks: the counters and _corrupt_record or none."""
    names = ("total_count", "success_count", "failure_count", "total_header_count")
    good = chunks.where(F.col("_corrupt_record").isNull()) if "_corrupt_record" in chunks.columns else chunks
    sums = good.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names], F.count("*").alias("chunks"))
    return sums.withColumn("chunks", F.when(F.col("chunks") == 0, F.raise_error(F.lit("no chunk could be read"))).otherwise(F.col("chunks")))


COUNTERS = "total_count long, success_count long, failure_count long, total_header_count long, _corrupt_record string"


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (value: a JSON object of the four counters) to the counters, with _corrupt_record where one can't be read."""
    parsed = F.from_json("value", COUNTERS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return chunks.select(parsed.alias("c")).select("c.*")


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Rows of all chunks, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), chunks)


def dedupe_tus(tus: DataFrame) -> DataFrame:
    """The first row (by seq) of each normalized path."""
    first = F.row_number().over(Window.partitionBy("_path").orderBy("seq"))
    return tus.withColumn("_path", normalize_path("tu")).withColumn("_first", first).where("_first = 1").drop("_path", "_first")


def order_tus(tus: DataFrame) -> DataFrame:
    return tus.orderBy("tu")


def select_sources(commands: DataFrame, requested: DataFrame | None) -> DataFrame:
    """Commands whose file is requested; without a request all."""
    return commands if requested is None else commands.join(requested.select("file").distinct(), "file", "left_semi")


def missing_sources(commands: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.select("file").distinct().join(commands.select("file"), "file", "left_anti")


def missing_count(commands: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: files requested, commands kept, and the difference."""
    kept = select_sources(commands, requested).agg(F.count("*").alias("n")).select(F.lit("kept").alias("k"), "n")
    asked = requested.agg(F.count("*").alias("n")).select(F.lit("requested").alias("k"), "n")
    return asked.union(kept).groupBy().pivot("k", ["requested", "kept"]).agg(F.first("n")).withColumn("missing_count", F.col("requested") - F.col("kept"))


def headers_for(tus: DataFrame, headers: DataFrame) -> DataFrame:
    """Input list of each TU: the source itself (ord 0), then its normalized, non-empty headers in order."""
    own = tus.select("tu", F.lit(0).cast("long").alias("ord"), F.col("tu").alias("path"))
    rest = headers.join(tus.select("tu"), "tu", "left_semi").where("header <> ''")
    rest = rest.select("tu", F.row_number().over(Window.partitionBy("tu").orderBy("seq", "header")).cast("long").alias("ord"), normalize_path("header").alias("path"))
    return own.union(rest)


def classify_headers(headers: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Counts by tu: project or external, direct or indirect. roots: tu, root; without a root all is external."""
    rows = headers.withColumn("root", F.lit("")) if roots is None else headers.join(roots.select("tu", "root"), "tu", "left")
    place = F.when(is_under_root(F.col("header"), F.coalesce("root", F.lit(""))), "project").otherwise("external")
    kind = F.concat_ws("_", place, F.when(F.col("direct"), "direct").otherwise("indirect"))
    names = ["project_direct", "project_indirect", "external_direct", "external_indirect"]
    return rows.groupBy("tu").agg(*[F.count_if(kind == n).alias(n) for n in names])


#: Headers of a block: the bits of a long.
BLOCK = 64


def _merged(df: DataFrame) -> DataFrame:
    """df for joins that shuffle. Files of numbers are small for the rows that they hold, so by their size millions of rows
    would be sent to the driver and broadcast."""
    return df.hint("merge")


def include_closure(edges: DataFrame, mains: DataFrame) -> DataFrame:
    """edges: src, dst; mains: main. Every header that a main file reaches, with the fewest steps; direct at one step.

    Semi-naive: each round extends only pairs that the last one found. Headers are numbered in order of their names, and what
    a main reaches of a block of numbers is one row with a bit each; the steps are kept as bits of binary digits. So a round
    shuffles a row a main and block, not one a pair, and pairs are formed once, at the end. No table goes through the driver.
    """
    ids = dense_ids(edges.select(F.col("dst").alias("header")).distinct(), ["header"], "id")
    at = F.col("id") - 1
    ids = written(ids.select("header", F.floor(at / BLOCK).alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % BLOCK).cast("int")).alias("bit")), "headers")
    to = _merged(edges).join(_merged(ids), edges["dst"].eqNullSafe(ids["header"])).groupBy("src", "block").agg(F.bit_or("bit").alias("bits"))
    to = written(to, "blocks")
    inner = ids.select("header", F.col("block").alias("of"), F.col("bit").alias("when"))
    inner = written(_merged(to).join(_merged(inner), to["src"] == inner["header"]).select("of", "when", "block", "bits"), "inner")
    step, digits, none = 1, [], F.lit(0).cast("long")
    found = _merged(to).join(_merged(mains), mains["main"] == to["src"]).groupBy("main", "block").agg(F.bit_or("bits").alias("last"))
    found = found.select("main", "block", F.col("last").alias("seen"), "last")
    while True:
        digits = [f"digit{i}" for i in range(step.bit_length())]
        fresh = {d: F.col("last") if step >> i & 1 else none for i, d in enumerate(digits)}
        marked = found.withColumns({d: F.col(d).bitwiseOR(c) if d in found.columns else c for d, c in fresh.items()})
        found, more = counted(marked, "closure", rows=F.count_if(F.col("last") != 0))
        if not more["rows"]:
            break
        step += 1
        last = found.select("main", F.col("block").alias("of"), "last").where("last <> 0")
        reached = _merged(last).join(_merged(inner), (last["of"] == inner["of"]) & (F.col("last").bitwiseAND(F.col("when")) != 0))
        reached = reached.select("main", "block", none.alias("seen"), *[none.alias(d) for d in digits], F.col("bits").alias("next"))
        both = found.select("main", "block", "seen", *digits, none.alias("next")).union(reached)
        both = both.groupBy("main", "block").agg(*[F.bit_or(c).alias(c) for c in ("seen", *digits, "next")])
        new = F.col("next").bitwiseAND(F.bitwise_not("seen"))
        found = both.select("main", "block", F.col("seen").bitwiseOR(new).alias("seen"), *digits, new.alias("last"))
    pairs = _merged(found).join(_merged(ids), (found["block"] == ids["block"]) & (F.col("seen").bitwiseAND(F.col("bit")) != 0))
    steps = reduce(Column.__add__, [F.when(F.col(d).bitwiseAND(F.col("bit")) != 0, 1 << i).otherwise(0) for i, d in enumerate(digits)])
    return pairs.select("main", "header", steps.alias("steps"), (steps == 1).alias("direct"))


def reverse_dependents(headers: DataFrame) -> DataFrame:
    """TUs of each header: count, and how many include it directly. As headers has one row per tu and header, no set of
    TUs is kept."""
    return headers.groupBy("header").agg(F.count("tu").alias("n_tus"), F.count_if(F.col("direct") & F.col("tu").isNotNull()).alias("n_direct"))


def tu_status(status: DataFrame) -> DataFrame:
    """Last written flag of each TU (tu, ts, flag); '1' and 'true' are true, all else and none false."""
    last = F.max_by("flag", "ts")
    return status.groupBy("tu").agg(F.coalesce(F.lower(F.trim(last)).isin("1", "true"), F.lit(False)).alias("failed"))


def cache_collisions(tus: DataFrame, name: Column) -> DataFrame:
    """Cache names (project, name) that several TUs of a project share."""
    return tus.withColumn("cache_name", name).groupBy("project", "cache_name").agg(F.count("*").alias("n_tus")).where("n_tus > 1")
