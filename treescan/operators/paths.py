"""Files, roots and directory trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treescan.functions.columns import SOURCE_PATTERN, is_under_root, normalize_path
from treescan.functions.storage import written


def source_files(files: DataFrame, pattern: str = SOURCE_PATTERN) -> DataFrame:
    """files with is_source; all others count as headers."""
    return files.withColumn("is_source", F.col("path").rlike(pattern))


def register_files(events: DataFrame) -> DataFrame:
    """events: seq, path to file_id (1-based, dense, in order of first registration), path, ref_count.

    Ids come from counts of range partitions, so no single task numbers all files.
    """
    files = events.select("seq", normalize_path("path").alias("path")).groupBy("path").agg(F.min("seq").alias("first_seq"), F.count("*").alias("ref_count"))
    return dense_ids(files, ["first_seq", "path"], "file_id").drop("first_seq")


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with 1-based dense numbers in the order of columns."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, own.cast("long")).join(before.select("_part", "_before"), "_part").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def _components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _root_of(low: Column, high: Column, shortest: Column, all_abs: Column, any_abs: Column, n: Column, lead: Column) -> Column:
    """Common prefix of the smallest and the largest list of components, at most shortest - 1 long."""
    most = F.greatest(F.least(F.size(low), F.size(high), shortest - 1), F.lit(0))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: (i > most) | (F.try_element_at(low, i) != F.try_element_at(high, i)))
    common = F.when(most == 0, 0).when(F.size(differ) == 0, most).otherwise(F.try_element_at(differ, F.lit(1)) - 1)
    text = F.concat(lead, F.array_join(F.slice(low, 1, common), "/"))
    return F.when((all_abs != any_abs) | (common == 0), "").otherwise(text)


def common_root(files: DataFrame, by: list[str]) -> DataFrame:
    """Longest common directory of the paths of each group: by, root, n_files. One aggregation, no lists of paths."""
    parts = _components(F.col("path"))
    absolute = F.col("path").startswith("/")
    lead = F.when(F.col("path").startswith("//"), "//").when(absolute, "/").otherwise("")
    got = files.where("path <> ''").groupBy(*by).agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"), F.min(F.size(parts)).alias("n"), F.bool_and(absolute).alias("all"), F.bool_or(absolute).alias("any"), F.count("*").alias("n_files"), F.min(lead).alias("lead"))
    return got.select(*by, _root_of(F.col("lo"), F.col("hi"), F.col("n"), F.col("all"), F.col("any"), F.col("n_files"), F.col("lead")).alias("root"), "n_files")


def project_root(files: DataFrame, compdb: DataFrame | None = None) -> DataFrame:
    """files: project, path; compdb: project, path of its compile database, override or null. Root of each project:
    the override; else the common root; else that of the largest cluster of one top directory, ties to the first (by top
    directory) that is an ancestor of the database's directory, else the first."""
    whole = common_root(files, ["project"]).select("project", F.col("root").alias("whole"))
    top = F.try_element_at(_components(F.col("path")), F.lit(1))
    clusters = common_root(files.withColumn("top", top), ["project", "top"]).withColumn("root", F.when(F.col("root") == "", F.concat(F.lit("/"), F.col("top"))).otherwise(F.col("root")))
    if compdb is None:
        clusters = clusters.withColumn("dir", F.lit(None).cast("string"))
        over = None
    else:
        clusters = clusters.join(compdb.select("project", F.regexp_replace("path", "/[^/]*$", "").alias("dir")), "project", "left")
        over = compdb.select("project", "override")
    ancestor = is_under_root(F.coalesce("dir", F.lit("")), F.col("root"))
    best = clusters.groupBy("project").agg(F.min_by("root", F.struct(-F.col("n_files"), ~ancestor, F.col("top"))).alias("cluster"))
    out = whole.join(best, "project", "left")
    out = out.withColumn("override", F.lit(None).cast("string")) if over is None else out.join(over, "project", "left")
    return out.select("project", F.coalesce("override", F.when(F.col("whole") != "", F.col("whole")), "cluster").alias("root"))


def split_project_external(tus: DataFrame, root: Column) -> DataFrame:
    """tus (column tu) with is_project: a partition into project and external."""
    return tus.withColumn("is_project", is_under_root(F.col("tu"), root))


def directory_rollup(files: DataFrame) -> DataFrame:
    """files: seq, project, path (below the root) to a row per trie node: project, path, name, depth, is_file, n_files. A
    node is a file if the path that made it, the first in order of seq, ends there."""
    parts = _components(F.col("path"))
    each = files.select("seq", "project", parts.alias("parts")).where(F.size("parts") > 0).select("seq", "project", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    node = each.select("seq", "project", F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, F.col("depth")), "/")).alias("path"), F.try_element_at("parts", F.col("depth")).alias("name"), "depth", (F.col("depth") == F.size("parts")).alias("leaf"))
    return node.groupBy("project", "path", "name", "depth").agg(F.min_by("leaf", "seq").alias("is_file"), F.count("*").alias("n_files"))


def order_children(nodes: DataFrame) -> DataFrame:
    """nodes of directory_rollup with ord: place among siblings, directories first, then by name in any case."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    by = Window.partitionBy("project", "_parent").orderBy("is_file", F.lower("name"), "name")
    return nodes.withColumn("_parent", parent).withColumn("ord", F.row_number().over(by)).drop("_parent")


def filter_tree(nodes: DataFrame, needle: str) -> DataFrame:
    """nodes (project, path, name) that stay visible: those whose name has the needle, and their ancestors."""
    text = needle.strip().lower()
    if not text:
        return nodes
    hits = nodes.where(F.contains(F.lower("name"), F.lit(text)))
    parts = _components(F.col("path"))
    up = hits.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("path")).distinct()
    return nodes.join(up, ["project", "path"], "left_semi")
