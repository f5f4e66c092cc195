"""Documents at the edges: compile databases, dependency documents, nested and flat exports of trees, text and logs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treescan.functions.storage import counted, written
from treescan.operators import contraction
from treescan.operators.commands import split_command
from treescan.operators.includes import attach_errors
from treescan.operators.logs import wire_lines
from treescan.sources import nested

#: Bytes of documents from which on no more go to a task's Python at once.
BATCH_BYTES = 4 << 20
#: Nodes and characters of a tree up to which its nodes are put in order together with their texts, by one task.
NODES, CHARACTERS = 1 << 18, 32 << 20
COMMAND = "directory string, file string, command string, arguments array<string>, _corrupt_record string"
HEADER = "array<struct<path: string, direct: boolean, inclusionKind: string>>"
DOCUMENT = f"statistics struct<totalCount: long, successCount: long, failureCount: long, totalHeaderCount: long>, files array<struct<path: string, headerCount: long, headers: {HEADER}, partialData: boolean, error: string>>, errors array<struct<filePath: string, message: string>>, _corrupt_record string"


def read_compile_commands(spark: SparkSession, path: str, project: str) -> DataFrame:
    """project, cmd_seq, directory, arguments, command, file; the first command of each file. Raises ValueError for a
    document that is corrupt or has no command."""
    rows = spark.read.schema(COMMAND).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = written(rows.withColumn("cmd_seq", F.monotonically_increasing_id()), "commands")
    state = rows.agg(F.count("file").alias("n"), F.count("_corrupt_record").alias("bad")).first()
    if state["bad"] or not state["n"]:
        raise ValueError(f"no compile commands in {path}: " + ("corrupt" if state["bad"] else "empty"))
    arguments = F.coalesce("arguments", split_command(F.col("command")))
    first = F.row_number().over(Window.partitionBy("file").orderBy("cmd_seq"))
    return rows.withColumn("_n", first).where("_n = 1 and file is not null").select(F.lit(project).alias("project"), "cmd_seq", "directory", arguments.alias("arguments"), "command", "file")


def read_dependencies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers (tu, seq, header, direct, inclusion_kind), errors (tu, err_seq, message) and statistics (one row a
    document, with _corrupt_record where it can't be read) of dependency documents."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("document", F.input_file_name())
    files = docs.select("document", F.explode("files").alias("f"))
    headers = files.select(F.col("f.path").alias("tu"), F.posexplode("f.headers").alias("seq", "h")).select("tu", F.col("seq").cast("long").alias("seq"), F.col("h.path").alias("header"), F.col("h.direct").alias("direct"), F.col("h.inclusionKind").alias("inclusion_kind"))
    errors = docs.select(F.posexplode("errors").alias("err_seq", "e")).select(F.col("e.filePath").alias("tu"), F.col("err_seq").cast("long").alias("err_seq"), F.col("e.message").alias("message"))
    stats = docs.select("document", *[F.col(f"statistics.{a}").alias(b) for a, b in (("totalCount", "total_count"), ("successCount", "success_count"), ("failureCount", "failure_count"), ("totalHeaderCount", "total_header_count"))], "_corrupt_record")
    return headers, errors, stats


def dependency_documents(tus: DataFrame, headers: DataFrame, errors: DataFrame, requested: DataFrame) -> DataFrame:
    """project, value: one JSON document a project. tus, requested: project, tu; files sorted by path."""
    by_tu = headers.groupBy("tu").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("header").alias("path"), "direct", F.col("inclusion_kind").alias("inclusionKind")))).alias("h"))
    rows = attach_errors(tus.join(by_tu, "tu", "left"), errors)
    hs = F.transform(F.coalesce("h", F.array().cast("array<struct<seq: bigint, path: string, direct: boolean, inclusionKind: string>>")), lambda x: F.struct(x["path"].alias("path"), x["direct"].alias("direct"), x["inclusionKind"].alias("inclusionKind")))
    file = F.struct(F.col("tu").alias("path"), F.size(hs).cast("long").alias("headerCount"), hs.alias("headers"), F.when(F.col("partial_data"), True).alias("partialData"), F.col("error").alias("error"))
    files = rows.groupBy("project").agg(F.array_sort(F.collect_list(file)).alias("files"), F.count("*").alias("successCount"), F.sum(F.size(hs)).cast("long").alias("totalHeaderCount"))
    bad = errors.join(requested.select("project", "tu"), "tu").groupBy("project").agg(F.array_sort(F.collect_list(F.struct(F.col("tu").alias("filePath"), "err_seq", "message"))).alias("errors"))
    asked = requested.groupBy("project").agg(F.count("*").alias("totalCount"))
    full = asked.join(files, "project", "left").join(bad, "project", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    statistics = F.struct("totalCount", n("successCount").alias("successCount"), F.coalesce(F.size("errors"), F.lit(0)).cast("long").alias("failureCount"), n("totalHeaderCount").alias("totalHeaderCount"))
    errors_only = F.when(F.size("errors") > 0, F.transform("errors", lambda e: F.struct(e["filePath"].alias("filePath"), e["message"].alias("message"))))
    return full.select("project", F.to_json(F.struct(statistics.alias("statistics"), F.coalesce("files", F.array().cast(files.schema["files"].dataType)).alias("files"), errors_only.alias("errors"))).alias("value"))


def write_dependencies(tus: DataFrame, headers: DataFrame, errors: DataFrame, requested: DataFrame, path: str) -> None:
    dependency_documents(tus, headers, errors, requested).write.partitionBy("project").text(path)


def read_ast_export(docs: DataFrame, paths: bool = True) -> tuple[DataFrame, DataFrame]:
    """docs (tu, value: a JSON export {properties, sourceRange, children}) to nodes (tu, node_id, parent_id, ordinal,
    depth, path of ordinals, bag, positions) and rejects (tu, reason). Depth has no limit. Ids are paths of ordinals, which
    add up to the square of the depth; without paths they are numbers in the order of the document."""
    found = _in_python(docs.select(F.col("tu").cast("string").alias("tu"), "value"), nested.read_nodes(paths), nested.NODE)
    return _nodes(found.where("reason is null")), found.where("reason is not null").select("tu", "reason")


def read_ast_events(events: DataFrame, paths: bool = True, window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same of documents in pieces (tu, root_id, pre, text), as ast_events and read_ast_lines give them. A document is
    read by one task as its pieces come in order, so none is held whole: from ``window`` characters on a task holds so many
    of it, and what is open."""
    pieces = events.select(F.col("tu").cast("string").alias("tu"), F.col("root_id").cast("string").alias("root_id"), "pre", "text")
    pieces = pieces.repartition("tu", "root_id").sortWithinPartitions("tu", "root_id", "pre").drop("pre")
    found = _in_python(pieces, nested.read_pieces(paths, window), f"{nested.NODE}, root_id string")
    bad = found.where("reason is not null")
    fine, key = found.where("reason is null"), ("tu", "root_id")
    if not bad.isEmpty():  # what came of a document before its fault
        gone = bad.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
        fine = fine.join(gone, fine["tu"].eqNullSafe(gone["_tu"]) & fine["root_id"].eqNullSafe(gone["_root_id"]), "left_anti")
    return _nodes(fine), bad.select("tu", "reason")


def _in_python(docs: DataFrame, read, schema: str) -> DataFrame:
    spark, setting = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, BATCH_BYTES)  # so that a task holds one large document at a time
    try:
        return written(docs.mapInArrow(read, schema), "nodes", "zstd")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def _nodes(found: DataFrame) -> DataFrame:
    get = lambda end, key, kind: F.try_variant_get("at", f"$.{end}.{key}", kind)
    places = {f"{end}_{name}": F.when(F.coalesce(get(end, "valid", "boolean"), F.lit(True)) & (get(end, "fileId", "long") > 0), get(end, key, kind)) for end in ("begin", "end") for name, key, kind in (("file", "fileId", "long"), ("line", "line", "long"), ("col", "column", "long"), ("path", "filePath", "string"))}
    rows = found.withColumns({"bag": F.try_parse_json("bag"), "at": F.try_parse_json("range")})
    kind = F.try_variant_get("bag", "$.kind", "string")
    return rows.select("tu", "node_id", "parent_id", "ordinal", "depth", "path", kind.alias("kind"), "bag", *[c.alias(n) for n, c in places.items()])


def _events(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Events of ast_events: those of small trees, tree by tree in order, and those of large ones in any order, if there are any.

    A small tree goes to one task with its texts; of a large one the labels are found without them and joined with them."""
    place = lambda end: F.when(F.col(f"{end}_file") > 0, F.to_json(F.struct(F.lit(True).alias("valid"), F.col(f"{end}_file").alias("fileId"), F.col(f"{end}_line").alias("line"), F.col(f"{end}_col").alias("column"), F.col(f"{end}_path").alias("filePath")))).otherwise('{"valid":false}')
    head = F.concat(F.lit('{"properties":'), F.coalesce(F.to_json("bag"), F.lit("{}")), F.lit(',"sourceRange":{"begin":'), place("begin"), F.lit(',"end":'), place("end"), F.lit('},"children":['))
    comma = F.when((F.col("ends") > 0) & (F.col("ends") <= F.col("depth")), ",").otherwise("")
    text = F.concat("head", F.repeat(F.lit("]}"), F.col("ends")), comma)
    length = F.coalesce(F.length("head"), F.lit(0)).cast("long")
    own = nodes.select("tu", "node_id", "parent_id", F.col("ordinal").cast("long").alias("ordinal"), head.alias("head"))
    own, n = counted(own, "nodes", "zstd", all=F.count(F.lit(1)), characters=F.sum(length))
    wide = own.groupBy("tu").agg(F.count("*").alias("n"), F.sum(length).alias("m")).where((F.col("n") > NODES) | (F.col("m") > CHARACTERS))
    wide = written(wide.select("tu"), "large_trees")
    whole = wide.isEmpty()
    small = own if whole else own.join(wide, "tu", "left_anti")
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n["all"] // NODES, 2 * n["characters"] // CHARACTERS)
    kind = {c: own.schema[c].dataType.simpleString() for c in ("tu", "node_id")}
    schema = f"tu {kind['tu']}, root_id {kind['node_id']}, pre long, depth long, ends int, head string, bucket long"
    small = small.withColumn("bucket", F.pmod(F.xxhash64("tu"), F.lit(parts)))
    small = small.groupBy("bucket").applyInArrow(lambda rows: contraction.in_order_of(rows, ("head",)), schema)
    small = small.select("tu", "root_id", "pre", text.alias("text"))
    if whole:
        return small, None
    large = own.join(wide, "tu", "left_semi")
    labels = contraction.labels(large).where("root_id is not null")
    ends = labels.groupBy("tu", (F.col("pre") + F.col("size") - 1).alias("pre")).agg(F.count("*").cast("int").alias("ends"))
    rows = labels.join(ends, ["tu", "pre"], "left").select("tu", "node_id", "root_id", "pre", "depth", F.coalesce("ends", F.lit(0)).alias("ends"))
    return small, large.select("tu", "node_id", "head").join(rows, ["tu", "node_id"]).select("tu", "root_id", "pre", text.alias("text"))


def ast_events(nodes: DataFrame) -> DataFrame:
    """nodes as read_ast_export gives them to (tu, root_id, pre, text): a node's own text in the order of the tree, with as
    many ends after it as subtrees end there. The texts of a root put together are its nested document, and their length
    is that of the nodes' own texts. Parents that form a cycle are an error, of large trees at once, of small ones when the
    events are used."""
    small, large = _events(nodes)
    return small if large is None else small.unionByName(large)


def _in_order(nodes: DataFrame) -> DataFrame:
    """Events of which those of a document stand in order, those of a large one over many tasks."""
    small, large = _events(nodes)
    return small if large is None else small.unionByName(large.repartitionByRange("tu", "root_id", "pre").sortWithinPartitions("tu", "root_id", "pre"))


def _documents(events: DataFrame) -> DataFrame:
    whole = F.sort_array(F.collect_list(F.struct("pre", "text")))
    return events.groupBy("tu", "root_id").agg(whole.alias("all")).select("tu", F.array_join(F.transform("all", lambda e: e["text"]), "").alias("value"))


def ast_documents(nodes: DataFrame) -> DataFrame:
    """nodes as read_ast_export gives them to (tu, value): nested JSON of each root, children in order. A document is one
    value here; write_ast_export has no such bound."""
    return _documents(ast_events(nodes))


def write_ast_export(nodes: DataFrame, path: str) -> None:
    """Exports as compressed lines (tu, root_id, pre, text), a document's in order of place, so that many tasks write a
    large one."""
    _in_order(nodes).write.json(path, compression="gzip")


def write_ast_files(nodes: DataFrame, path: str) -> None:
    """A folder tu=... for each tu with one root: its files put together, in order of name, are the JSON document."""
    rows = _in_order(nodes).sortWithinPartitions("tu", "root_id", "pre")
    rows.select("tu", F.col("text").alias("value")).write.partitionBy("tu").text(path)


def read_ast_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines (tu, root_id, pre, text) of exports that write_ast_export wrote."""
    return spark.read.schema("tu string, root_id string, pre long, text string").json(path)


def read_ast_documents(spark: SparkSession, path: str) -> DataFrame:
    """tu and value of exports that write_ast_export wrote. A document is one value here; read_ast_events has no such bound."""
    return _documents(read_ast_lines(spark, path))


def write_flat_nodes(nodes: DataFrame, path: str) -> None:
    """The exchange format for trees of any depth: one node a line."""
    nodes.withColumn("bag", F.to_json("bag")).write.json(path)


def read_flat_nodes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Nodes that write_flat_nodes wrote; schema: theirs, with the bag as text."""
    return spark.read.schema(schema).json(path).withColumn("bag", F.try_parse_json("bag"))


def write_project_tables(df: DataFrame, root: str, project_path: str, build_dir: str, created: str, commit: str) -> None:
    """A version of a project's table under root. Files go into a folder of the commit, and once they are all there a
    marker makes them count, so a writer that fails leaves nothing to be read, and one that runs twice, or twice at once,
    under the same commit leaves one copy. The marker holds the project's metadata."""
    key = hashlib.sha256(project_path.encode()).hexdigest()[:16]
    folder = f"_project=p-{key}/_commit=c-{commit}"
    df.withColumn("project_key", F.lit(key)).write.mode("overwrite").parquet(f"{root}/data/{folder}")
    marker = df.sparkSession.range(1).select(F.lit(key).alias("project_key"), F.lit(commit).alias("commit"), F.lit(project_path).alias("path"), F.lit(build_dir).alias("build_dir"), F.lit(created).alias("created_at"))
    marker.write.mode("overwrite").json(f"{root}/commits/{folder}")


def read_projects(spark: SparkSession, root: str) -> DataFrame:
    """project_key, commit, path, build_dir, created_at: the last commit of each project (by created_at, then name)."""
    markers = spark.read.schema("project_key string, commit string, path string, build_dir string, created_at string").json(f"{root}/commits/*/*")
    last = F.max(F.struct("created_at", "commit", "path", "build_dir")).alias("m")
    return markers.groupBy("project_key").agg(last).select("project_key", "m.commit", "m.path", "m.build_dir", "m.created_at")


def read_project_tables(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last commit of each project; folders of others are pruned."""
    last = read_projects(spark, root).select(F.concat(F.lit("p-"), "project_key").alias("_project"), F.concat(F.lit("c-"), "commit").alias("_commit"))
    # the columns are those of a commit: files without a marker may have others
    one = last.first()
    if one is None:
        raise ValueError(f"no commits below {root}")
    schema = spark.read.parquet(f"{root}/data/_project={one['_project']}/_commit={one['_commit']}").schema
    rows = spark.read.schema(schema.add("_project", "string").add("_commit", "string")).parquet(f"{root}/data")
    return rows.join(last, ["_project", "_commit"], "left_semi").drop("_project", "_commit")


def read_diagnostics(spark: SparkSession, path: str, stream: bool = False, files: int | None = None) -> DataFrame:
    """Lines of tool output (line, is_stderr by a file name that ends in .err), as a table or a stream of so many files a
    batch; see logs.parse_lines."""
    reader = spark.readStream if stream else spark.read
    reader = reader.option("maxFilesPerTrigger", files) if stream and files else reader
    return reader.text(path).select(F.col("value").alias("line"), F.input_file_name().endswith(".err").alias("is_stderr"))


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    wire_lines(diagnostics).write.text(path)
