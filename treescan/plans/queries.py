"""A query for each operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treescan.functions import columns as c
from treescan.functions.storage import shared_path
from treescan.operators import commands, history, includes, logs, nodes, paths, positions, text, trees
from treescan.plans import bindings as b
from treescan.plans.bindings import table
from treescan.sources import documents
from treescan.streaming import operators as streams
from treescan.streaming import timed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _headers(s, d):
    return includes.dedupe_headers(b.include_events(s, d))


def _tus(s, d):
    return b.include_events(s, d).select("tu").distinct()


@query
def dependency_report(s, d):
    """TUs in order with the number of headers, direct ones, and the first error."""
    per = _headers(s, d).groupBy("tu").agg(F.count("*").alias("header_count"), F.count_if("direct").alias("direct_count"))
    return includes.order_tus(includes.attach_errors(per, b.tu_errors(s, d)).select("tu", "header_count", "direct_count", "partial_data", "error"))


# 2.1 sources and sinks


@query
def s1_read_compile_commands(s, d):
    """Commands of orders written as a database for each 500 of them, and read again."""
    k = F.col("o_orderkey").cast("string")
    entry = F.struct(F.lit("/work/build").alias("directory"), F.concat(F.lit("cc -I'a b' t"), k, F.lit(".cpp")).alias("command"), F.concat(F.lit("t"), k, F.lit(".cpp")).alias("file"))
    path = shared_path(s, "databases")
    table(s, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 500).alias("g")).agg(F.to_json(F.collect_list(entry)).alias("value")).write.partitionBy("g").text(path)
    return documents.read_compile_commands(s, f"{path}/g=*", "p").select("file", "directory", F.array_join("arguments", "|").alias("line"))


@query
def s4_source_lines(s, d):
    return text.source_lines(table(s, d, "documents"), "doc_id", "text")


@query
def s8_project_key(s, d):
    p = b.paths(s, d)
    return p.select("path", c.project_key(F.col("path")).alias("project_key"))


@query
def s9_tu_status(s, d):
    o = table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("tu"), F.struct("o_orderdate", "o_orderkey").alias("ts"), F.when(F.col("o_orderstatus") == "F", F.lit(" TRUE ")).when(F.col("o_orderstatus") == "O", F.lit("1")).otherwise(F.lit("no")).alias("flag"))
    return includes.tu_status(o)


@query
def s10_cache_collisions(s, d):
    return includes.cache_collisions(b.paths(s, d).withColumnRenamed("path", "tu"), c.basename(F.col("tu")))


@query
def s11_write_diagnostics(s, d):
    e = table(s, d, "events").select("event_id", F.col("event_type").alias("level"), F.concat(F.lit("f\t"), F.col("user_id")).alias("file"), (F.col("event_id") % 97).alias("line"), (F.col("event_id") % 31).alias("col"), F.col("props").alias("message"))
    return logs.wire_lines(e)


# sources and sinks as round trips; commands and bags made of orders and their lines


def _by_customer(s, d):
    """TUs of orders: project (customer), tu."""
    return table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("project"), F.concat(F.lit("/work/src/t"), F.col("o_orderkey").cast("string"), F.lit(".cpp")).alias("tu"))


@query
def s2_read_dependencies(s, d):
    """Headers written as one document for each group of customers and read again."""
    group = F.concat(F.lit("g"), (F.crc32(F.col("project").cast("binary")) % 100).cast("string"))
    requested = _by_customer(s, d).withColumn("project", group)
    tus = requested.join(_tus(s, d), "tu", "left_semi")
    path = shared_path(s, "dependencies")
    documents.write_dependencies(tus, _headers(s, d).join(tus, "tu", "left_semi"), b.tu_errors(s, d), requested, path)
    headers, _, _ = documents.read_dependencies(s, f"{path}/project=*")
    return headers.drop("seq")


@query
def s6_write_dependencies(s, d):
    requested = _by_customer(s, d)
    tus = requested.join(_tus(s, d), "tu", "left_semi")
    docs = documents.dependency_documents(tus, _headers(s, d).join(tus, "tu", "left_semi"), b.tu_errors(s, d), requested)
    n = lambda key: F.get_json_object("value", f"$.statistics.{key}").cast("long")
    return docs.select("project", n("totalCount").alias("total_count"), n("successCount").alias("success_count"), n("failureCount").alias("failure_count"), n("totalHeaderCount").alias("total_header_count"), F.get_json_object("value", "$.errors").isNotNull().alias("has_errors"))


@query
def s3_ast_export(s, d):
    """The trees of customers, orders and lines, written as nested documents and read again."""
    whole = b.tree(s, d, owner=True).where("kind in ('customer', 'order', 'line') and (kind = 'customer' or owner is not null)")
    none = F.lit(None).cast("long")
    nodes_in = whole.select(F.col("owner").alias("tu"), "node_id", F.when(F.col("kind") != "customer", F.col("parent_id")).alias("parent_id"), "ordinal", F.when(F.col("kind") == "customer", 0).when(F.col("kind") == "order", 1).otherwise(2).cast("long").alias("depth"), F.parse_json(F.to_json("props")).alias("bag"), *[none.alias(f"{e}_{n}") for e in ("begin", "end") for n in ("file", "line", "col")], *[F.lit(None).cast("string").alias(f"{e}_path") for e in ("begin", "end")])
    back, _ = documents.read_ast_events(documents.ast_events(nodes_in))
    return back.select("tu", "node_id", "kind", "depth")


@query
def s7_write_ast_export(s, d):
    """The trees of orders and their lines, written as nested documents into files and read again."""
    t = b.tree(s, d).where("kind in ('order', 'line')")
    order, none = F.col("kind") == "order", F.lit(None).cast("long")
    nodes_in = t.select(F.when(order, F.col("node_id")).otherwise(F.col("parent_id")).alias("tu"), "node_id", F.when(~order, F.col("parent_id")).alias("parent_id"), "ordinal", F.when(order, 0).otherwise(1).cast("long").alias("depth"), F.parse_json(F.to_json("props")).alias("bag"), *[none.alias(f"{e}_{n}") for e in ("begin", "end") for n in ("file", "line", "col")], *[F.lit(None).cast("string").alias(f"{e}_path") for e in ("begin", "end")])
    path = shared_path(s, "exports")
    documents.write_ast_export(nodes_in, path)
    back, _ = documents.read_ast_events(documents.read_ast_lines(s, path))
    return back.select("tu", "node_id", "kind", F.try_variant_get("bag", "$.flag", "string").alias("flag"))


@query
def s5_read_diagnostics(s, d):
    """Diagnostics written as wire lines and read again."""
    path = shared_path(s, "wire")
    e = table(s, d, "events").select(F.when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "warning").when(F.col("event_type") == "purchase", "note").otherwise("error").alias("level"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file"), (1 + F.col("event_id") % 97).alias("line"), (F.col("event_id") % 31).alias("col"), F.col("props").alias("message"))
    documents.write_diagnostics(e, path)
    return logs.parse_lines(documents.read_diagnostics(s, path)).select("level", "message")


def _commands(s, d):
    k = F.col("o_orderkey").cast("string")
    module = F.concat(F.lit("-fmodule-file=m"), (F.col("o_orderkey") % 3).cast("string"), F.lit("=../m/"), k, F.lit(".pcm"))
    words = F.array(F.lit("cc"), F.lit("-resource-dir"), F.concat(F.lit("/r"), k), module, F.concat(F.lit("-resource-dir=/s"), k), F.concat(F.lit("@flags"), (F.col("o_custkey") % 30).cast("string")), F.concat(F.lit("t"), k, F.lit(".cpp")))
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("project"), F.col("o_orderkey").alias("cmd_seq"), F.lit("/work/build").alias("directory"), words.alias("arguments"), F.concat(F.lit("t"), k, F.lit(".cpp")).alias("file"))


@query
def p7_macro_spelling_range(s, d):
    o = table(s, d, "orders").select(F.lit("t").alias("tu"), F.col("o_orderkey").alias("node_id"), (F.col("o_custkey") % 3).alias("f"), (F.col("o_orderkey") % 5).alias("l"))
    place = lambda line: F.struct(F.col("f").alias("fileId"), line.alias("line"), F.lit(1).alias("column"))
    bag = F.parse_json(F.to_json(F.struct(F.struct(place(F.col("l")).alias("begin"), place(F.col("l") + 1).alias("end")).alias("macroSpellingRange"))))
    return nodes.macro_spelling_range(o.select("tu", "node_id", bag.alias("bag"))).select("node_id", "macro_begin_file", "macro_begin_line", "macro_end_line")


@query
def p10_explode_params(s, d):
    item = F.struct(F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*b.LINE_ORDER)).alias("n"), F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("type"))
    per = table(s, d, "lineitem").select("l_orderkey", item.alias("i")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("i")).alias("params"))
    bags = per.select(F.lit("t").alias("tu"), F.col("l_orderkey").alias("node_id"), F.parse_json(F.to_json(F.struct("params"))).alias("bag"))
    return nodes.explode_params(bags).drop("tu")


@query
def p10_explode_bases(s, d):
    item = F.struct(F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*b.LINE_ORDER)).alias("n"), F.concat(F.lit("B"), F.col("l_partkey")).alias("type"), (F.col("l_returnflag") == "R").alias("isVirtual"), F.col("l_linestatus").alias("accessSpecifier"))
    per = table(s, d, "lineitem").select("l_orderkey", item.alias("i")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("i")).alias("bases"))
    bags = per.select(F.lit("t").alias("tu"), F.col("l_orderkey").alias("node_id"), F.parse_json(F.to_json(F.struct("bases"))).alias("bag"))
    return nodes.explode_bases(bags).drop("tu")


@query
def p10_explode_template_args(s, d):
    """Of each order: a type, a pack of two with a pack of its own, and an empty pack."""
    text = lambda c: F.col(c).cast("string")
    arg = lambda kind, value: F.struct(F.lit(kind).alias("kindName"), value.alias("value"))
    pack = lambda of: F.struct(F.lit("Pack").alias("kindName"), of.alias("pack"))
    inner = F.to_json(pack(F.array(arg("Integral", text("o_custkey")))))
    bag = F.concat(F.lit('{"templateArgs":['), F.to_json(arg("Type", F.col("o_orderpriority"))), F.lit(',{"kindName":"Pack","pack":['), F.to_json(arg("Type", F.col("o_orderstatus"))), F.lit(","), inner, F.lit(']},{"kindName":"Pack","pack":[]}]}'))
    bags = table(s, d, "orders").select(F.lit("t").alias("tu"), F.col("o_orderkey").alias("node_id"), F.parse_json(bag).alias("bag"))
    return nodes.explode_template_args(bags).select("node_id", F.array_join(F.transform("path", lambda i: i.cast("string")), ".").alias("path"), "kindName", "value")


@query
def p12_normalize_flags(s, d):
    return commands.normalize_flags(_commands(s, d), "/R").select("cmd_seq", F.array_join("arguments", " ").alias("line"))


@query
def p13_module_map(s, d):
    return commands.module_map(_commands(s, d)).drop("project")


@query
def p14_expand_response_files(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("/work/build/flags"), F.col("n_nationkey").cast("string")).alias("path"), F.concat(F.lit("-D'"), F.col("n_name"), F.lit(" x' \"-I a\" -O2")).alias("text"))
    return commands.expand_response_files(_commands(s, d), n).select("cmd_seq", F.array_join("arguments", "|").alias("line"))


# 2.2 projections and filters


def _requested(s, d):
    return table(s, d, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("/work/src/t"), (F.col("l_orderkey") * 2).cast("string"), F.lit(".cpp")).alias("file"))


@query
def p1_select_sources(s, d):
    return includes.select_sources(b.commands(s, d), _requested(s, d)).select("cmd_seq", "file")


@query
def p1_missing_count(s, d):
    return includes.missing_count(b.commands(s, d), _requested(s, d).distinct())


@query
def p2_search_nodes(s, d):
    return nodes.search_nodes(b.tree(s, d), "1 kind:order|line status:F").select("node_id", "kind")


@query
def p2_search_bare(s, d):
    return nodes.search_nodes(b.tree(s, d), "build.*|urgent").select("node_id", "kind")


@query
def p2_search_project(s, d):
    """Tags with a class, only in files below the root of one project."""
    files = b.paths(s, d).select(F.col("seq").alias("file_id"), "path")
    tags = b.tags(s, d).withColumn("props", F.create_map(F.lit("kind"), F.col("kind"), F.lit("attrs"), F.col("attrs")))
    root = files.agg(F.min("path")).first()[0].rsplit("/", 1)[0]
    return nodes.search_nodes(tags, "kind:p|a|div", files, root).select("node_id", "kind")


@query
def p3_is_under_root(s, d):
    p = b.paths(s, d)
    return p.select("seq", "path", c.is_under_root(F.col("path"), F.concat(F.lit("/"), F.col("host"), F.lit("/en"))).alias("under_root"))


@query
def p4_source_files(s, d):
    return paths.source_files(b.paths(s, d), b.SUFFIXES).select("path", "is_source")


@query
def p5_located_nodes(s, d):
    tags = b.tags(s, d).withColumn("begin_file", F.when(F.col("pre") % 5 != 0, F.col("begin_file")))
    return nodes.located_nodes(tags).select("node_id", "kind")


@query
def p6_files_in_tree(s, d):
    files = b.paths(s, d).select(F.col("seq").alias("file_id"), "path")
    tables = b.tags(s, d).where("kind = 'table'")
    has = nodes.files_in_tree(files, tables).withColumn("in_tree", F.lit(True))
    return has.union(nodes.files_in_tree(files, tables, False).withColumn("in_tree", F.lit(False)))


@query
def p8_node_label(s, d):
    t = b.tree(s, d)
    props = F.map_concat(F.col("props"), F.create_map(F.lit("type"), F.coalesce(F.try_element_at("props", F.lit("segment")), F.try_element_at("props", F.lit("priority")), F.lit("")), F.lit("isStatic"), (F.col("kind") == "order").cast("string"), F.lit("value"), F.coalesce(F.try_element_at("props", F.lit("flag")), F.lit(""))))
    return nodes.node_label(t.withColumn("props", props)).select("node_id", "label")


@query
def p9_typed_view(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("tu"), F.col("event_id").alias("node_id"), F.col("event_type").alias("kind"), F.try_parse_json("props").alias("bag"))
    keys = {"page": "string", "k": "int", "ref": "string"}
    return nodes.typed_view(e, "click", keys).drop("tu")


@query
def p9_typed_families(s, d):
    """Views of several families, each row's columns as one text."""
    n = b.syntax_nodes(s, d)
    shown = lambda v: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in v.columns[2:]])
    views = ((f, nodes.typed_view(n, f)) for f in ("EnumConstantDecl", "ClassTemplateSpecializationDecl", "TypedefNameDecl", "IfStmt", "BinaryOperator", "CXXNewExpr", "LambdaExpr"))
    return reduce(DataFrame.union, [v.select("node_id", F.lit(f).alias("family"), shown(v).alias("shown")) for f, v in views])


@query
def p11_flatten_properties(s, d):
    e = table(s, d, "events").select("event_id", F.try_parse_json("props").alias("bag"))
    return nodes.flatten_properties(e, ["event_id"]).select("event_id", "key", "value")


# 2.3 joins


@query
def j1_nodes_at(s, d):
    return positions.nodes_at(b.points(s, d), b.position_index(s, d)).select("point_id", "node_id")


@query
def j2_most_specific(s, d):
    return positions.most_specific(b.points(s, d), b.position_index(s, d))


@query
def j3_first_contained(s, d):
    return positions.first_contained(b.ranges(s, d), b.tags(s, d))


@query
def j4_with_file_path(s, d):
    files = b.paths(s, d).select(F.col("seq").alias("file_id"), "path")
    return positions.with_file_path(b.tags(s, d), files).select("node_id", "path")


@query
def j5_attach_errors(s, d):
    return includes.attach_errors(_tus(s, d), b.tu_errors(s, d)).select("tu", "partial_data", "error")


# kinds of declarations in place of the tree's
DECLS = {"root": "TranslationUnitDecl", "region": "NamespaceDecl", "nation": "CXXRecordDecl", "customer": "EnumDecl", "order": "FunctionDecl", "line": "ParmVarDecl"}


def _decls(s, d):
    """The tree as declarations; as a walk meets each level after the one above, the level stands for the place in it."""
    kind = F.create_map(*[F.lit(x) for pair in DECLS.items() for x in pair])[F.col("kind")]
    level = F.create_map(*[F.lit(x) for pair in zip(DECLS, range(len(DECLS)), strict=True) for x in pair])[F.col("kind")]
    return b.tree(s, d).select("tu", "node_id", kind.alias("kind"), "name", level.alias("pre"), F.lit(True).alias("is_decl"), (F.col("kind") != "line").alias("is_context"), F.col("parent_id").alias("semantic_parent"))


@query
def j6_context_chain(s, d):
    chains = trees.context_chain(_decls(s, d))
    return chains.select("node_id", F.array_join(F.transform("chain", lambda e: F.concat_ws("=", e["kind"], e["name"])), "/").alias("chain"))


@query
def j7_contexts_of_kind(s, d):
    return trees.contexts_of_kind(trees.context_chain(_decls(s, d))).drop("tu")


@query
def j8_highlight_text(s, d):
    lines = text.source_lines(table(s, d, "documents"), "doc_id", "text")
    n = table(s, d, "documents").count()
    r = table(s, d, "events").select(F.col("event_id").alias("range_id"), (F.col("event_id") % n).alias("file"), (1 + F.col("event_id") % 3).cast("int").alias("begin_line"), (1 + F.col("event_id") % 7).cast("int").alias("begin_col"), (1 + F.col("event_id") % 3 + F.col("event_id") % 2).cast("int").alias("end_line"), (9 + F.col("event_id") % 5).cast("int").alias("end_col"))
    return positions.highlight_text(r, lines)


@query
def j9_headers_for(s, d):
    return includes.headers_for(_tus(s, d), _headers(s, d))


# 2.4 aggregations


@query
def a1_dedupe_headers(s, d):
    return _headers(s, d)


@query
def a2_dependency_stats(s, d):
    return includes.dependency_stats(_tus(s, d), _headers(s, d), b.tu_errors(s, d), b.commands(s, d))


def _chunk_counts(s, d):
    """Counters of chunks of TUs by the last digit of the order."""
    chunk = F.regexp_extract("tu", r"([0-9])\.cpp$", 1)
    h = _headers(s, d).groupBy("tu").agg(F.count("*").alias("n")).join(includes.first_messages(b.tu_errors(s, d)), "tu", "left")
    return h.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("total_count"), F.count("*").alias("success_count"), F.count("error").alias("failure_count"), F.sum("n").alias("total_header_count"))


@query
def a3_merge_stats(s, d):
    return includes.merge_stats(_chunk_counts(s, d)).drop("chunks")


@query
def a3_merge_readable_chunks(s, d):
    """Chunks as JSON, of which that of the digit 3 is broken off."""
    text = F.to_json(F.struct("total_count", "success_count", "failure_count", "total_header_count"))
    return includes.merge_stats(includes.parse_chunks(_chunk_counts(s, d).select(F.when(F.col("chunk") == "3", F.left(text, F.lit(20))).otherwise(text).alias("value"))))


KINDS = ["region", "nation", "customer", "order", "line"]


@query
def a4_extraction_stats(s, d):
    return nodes.extraction_stats(b.tree(s, d), KINDS, F.col("kind"))


@query
def a4_node_statistics(s, d):
    return nodes.extraction_stats(b.syntax_nodes(s, d))


@query
def a4_fleet_stats(s, d):
    return nodes.fleet_stats(b.tags(s, d), F.col("kind"))


@query
def a5_dedupe_types(s, d):
    return nodes.dedupe_types(b.tags(s, d), ["kind", "attrs"]).select("node_id", "data_id")


@query
def a6_type_sharing_stats(s, d):
    return nodes.type_sharing_stats(b.tags(s, d), ["kind", "attrs"], F.octet_length(F.concat("kind", "attrs")) + 64)


@query
def a7_string_pool_stats(s, d):
    docs = table(s, d, "documents").select(F.explode(F.array("lang", "source")).alias("value"))
    return nodes.string_pool_stats(docs, "value")


@query
def a8_register_files(s, d):
    p = b.paths(s, d)
    return paths.register_files(p.select("seq", F.regexp_replace("path", "/[^/]*$", "").alias("path")))


@query
def a9_common_root(s, d):
    return paths.common_root(b.paths(s, d), ["host"])


@query
def a10_project_root(s, d):
    return paths.project_root(b.paths(s, d))


@query
def a10_project_root_with_database(s, d):
    """Compile databases below the last host of each project, and an override for one project."""
    p = b.paths(s, d)
    db = p.groupBy("project").agg(F.max("host").alias("host")).select("project", F.concat(F.lit("/"), F.col("host"), F.lit("/build/cc.json")).alias("path"), F.when(F.col("project").endswith(".net"), "/over/ride").alias("override"))
    return paths.project_root(p.select("project", "path").distinct(), db)


@query
def a11_classify_headers(s, d):
    h = _headers(s, d)
    return includes.classify_headers(h, h.select("tu").distinct().withColumn("root", F.lit("/work")))


@query
def a12_directory_rollup(s, d):
    return paths.directory_rollup(b.paths(s, d))


def _entries(s, d):
    return logs.parse_lines(b.log_lines(s, d))


@query
def a13_log_tabs(s, d):
    return logs.log_tabs(_entries(s, d))


@query
def a14_comment_text(s, d):
    t = table(s, d, "conversations").select(F.col("conv_id").alias("comment_id"), F.struct("turn", "role", "text").alias("seq"), "text", (F.col("turn") % 2 == 1).alias("ends_paragraph"))
    return text.comment_text(t)


@query
def a15_token_profile(s, d):
    return text.token_profile(table(s, d, "documents"), "doc_id", "text", ["the", "and", "of", "de", "la", "que", "der", "en"])


@query
def a15_token_keywords(s, d):
    """Token classes with the keywords of the languages."""
    return text.token_profile(table(s, d, "documents"), "doc_id", "text")


@query
def a16_first_errors(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("tu"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "Fatal").otherwise(F.col("event_type")).alias("level"), F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("x.h")).alias("file"), F.col("props").alias("message"))
    return logs.first_errors(e)


# 2.5 windows, 2.6 order


def _bare_tree(s, d):
    """The tree without what labels don't need."""
    return b.tree(s, d).select("tu", "node_id", "parent_id", "ordinal")


@query
def w1_child_ordinals(s, d):
    return nodes.child_ordinals(trees.label_tree(_bare_tree(s, d))).select("node_id", "row")


@query
def w2_match_cycle(s, d):
    found = nodes.search_nodes(trees.label_tree(b.tree(s, d)), "segment:.*ing").select("tu", "node_id", "pre")
    return nodes.match_cycle(found).drop("tu")


@query
def w3_nav_history(s, d):
    return history.nav_history(b.nav_events(s, d)).select("session", "seq", "file", "line", "pos")


@query
def w4_nav_history_replay(s, d):
    return history.nav_history_replay(b.nav_events(s, d))


@query
def w5_recent_queries(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("user"), "ts", F.concat(F.lit(" "), F.col("event_type"), F.lit(" "), (F.col("event_id") % 9).cast("string")).alias("query"))
    return history.recent_queries(e)


@query
def w6_retain_log(s, d):
    return logs.retain_log(_entries(s, d)).select("tab", "seq", "rank", c.format_log_line(F.col("ts"), F.col("level"), F.col("source").cast("string"), F.col("message")).alias("line"))


@query
def o1_order_tus(s, d):
    return includes.order_tus(_tus(s, d))


@query
def o2_order_directory_children(s, d):
    return paths.order_children(paths.directory_rollup(b.paths(s, d))).select("project", "path", "ord")


@query
def o3_preorder(s, d):
    return trees.preorder(trees.label_tree(_bare_tree(s, d))).select("node_id", "pre", "depth")


# 2.7 sets


@query
def u1_union_chunks(s, d):
    e = b.include_events(s, d)
    return includes.union_chunks([e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), e.where("seq = 1")])


@query
def u2_dedupe_tus(s, d):
    p = b.paths(s, d).select("seq", F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/./x/../f")).alias("tu"))
    return includes.dedupe_tus(p).select("seq", c.normalize_path("tu").alias("path"))


@query
def u3_split_project_external(s, d):
    p = b.paths(s, d).select(F.col("path").alias("tu"), "host")
    root = F.concat(F.lit("/"), F.col("host"), F.lit("/en"))
    return paths.split_project_external(p, root).select("tu", "is_project", c.display_path(F.col("tu"), root).alias("shown"))


@query
def u4_missing_sources(s, d):
    return includes.missing_sources(b.commands(s, d), _requested(s, d))


# 2.8 trees and graphs


@query
def g1_node_depth(s, d):
    return trees.node_depth(b.tree(s, d)).select("node_id", "depth")


@query
def g2_path_to_root(s, d):
    return trees.path_to_root(b.tree(s, d)).select("node_id", F.array_join("path", "/").alias("path"))


@query
def g3_subtree(s, d):
    t = trees.label_tree(b.tree(s, d))
    roots = t.where("kind = 'nation' or node_id = 'r1'").select(F.col("node_id").alias("root_id"), "tu", "node_id")
    return trees.subtree(t, roots).drop("tu")


@query
def g4_subtree_size(s, d):
    return trees.subtree_size(trees.label_tree(_bare_tree(s, d))).drop("tu")


@query
def g4_height(s, d):
    return trees.height(b.tree(s, d)).drop("tu")


@query
def g5_filter_tree(s, d):
    return paths.filter_tree(paths.directory_rollup(b.paths(s, d)), " 7 ").select("project", "path")


@query
def g6_include_closure(s, d):
    mains = table(s, d, "part").select(F.col("p_partkey").alias("main"))
    return includes.include_closure(b.include_edges(s, d), mains).select("main", "header", "direct")


@query
def g7_reverse_dependents(s, d):
    return includes.reverse_dependents(_headers(s, d))


# 2.10 text search


@query
def x1_find_text(s, d):
    return text.find_text(text.source_lines(table(s, d, "documents"), "doc_id", "text"), "er")


def _cursors(s, d):
    n = table(s, d, "documents").count()
    return table(s, d, "events").select(F.col("event_id").alias("cursor_id"), (F.col("event_id") % n).alias("file"), (1 + F.col("event_id") % 5).cast("int").alias("line"), (1 + F.col("event_id") % 40).cast("int").alias("col"))


@query
def x2_find_next(s, d):
    hits = text.find_text(text.source_lines(table(s, d, "documents"), "doc_id", "text"), "the ")
    return text.find_next(_cursors(s, d), hits)


@query
def x2_find_previous(s, d):
    hits = text.find_text(text.source_lines(table(s, d, "documents"), "doc_id", "text"), "the ")
    return text.find_next(_cursors(s, d), hits, backward=True)


# 2.11 streams


@query
def k1_reassemble_lines(s, d):
    """The log as chunks cut in the middle of lines, put together again."""
    return streams.run(streams.reassemble_lines(streams.chunks(b.log_lines(s, d, stream=True))), "append")


@query
def k2_parse_log(s, d):
    return _entries(s, d).select("seq", "level", "message")


@query
def k3_log_counts_stream(s, d):
    return streams.run(streams.log_counts(logs.parse_lines(b.log_lines(s, d, stream=True))), "complete")


@query
def k4_run_progress(s, d):
    e = b.log_lines(s, d, stream=True).select(F.col("source").alias("run"), (F.col("seq") % 5 != 0).alias("ok"), F.lit(60).alias("total"))
    return streams.run(logs.run_progress(e), "complete")


@query
def k5_nav_history_stream(s, d):
    return streams.run(streams.nav_history(b.nav_events(s, d, stream=True)), "update")


def _on_the_clock(events):
    """ts as an instant, whatever the session's time zone."""
    return events.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))


DAY = 86_400_000


@query
def w6_bounded_queue_stream(s, d):
    """The log through a queue of six entries, two of which are shown every other day."""
    lines = _on_the_clock(b.log_lines(s, d, stream=True))
    return streams.run(timed.bounded_queue(lines, pending=6, batch=2, tick=2 * DAY), "append")


@query
def k4_finished_runs_stream(s, d):
    """Runs of 20 events each, given up after two days without one."""
    e = _on_the_clock(b.log_lines(s, d, stream=True)).select(F.col("source").alias("run"), "seq", "ts", (F.col("seq") % 5 != 0).alias("ok"), F.lit(20).alias("total"))
    return streams.run(timed.finished_runs(e, 2 * DAY), "append")


@query
def k5_ended_sessions_stream(s, d):
    """Histories of sessions that end after a day without an event."""
    e = b.nav_events(s, d, stream=True).withColumn("ts", F.timestamp_micros("seq"))
    return streams.run(timed.ended_sessions(e, DAY), "append")


@query
def s3_deep_export(s, d):
    """The orders of each nation as one chain, each within the one before, written as nested documents and read again."""
    o = table(s, d, "orders").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("nation").orderBy("o_orderkey"))
    none = F.lit(None).cast("long")
    text = lambda c: F.col(c).cast("string")
    chain = o.withColumn("before", before).select(text("nation").alias("tu"), text("o_orderkey").alias("node_id"), text("before").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"), F.parse_json(F.to_json(F.struct(F.col("o_orderpriority").alias("kind")))).alias("bag"), *[none.alias(f"{e}_{n}") for e in ("begin", "end") for n in ("file", "line", "col")], *[F.lit(None).cast("string").alias(f"{e}_path") for e in ("begin", "end")])
    path = shared_path(s, "exports")
    documents.write_ast_export(chain, path)
    back, _ = documents.read_ast_events(documents.read_ast_lines(s, path), paths=False)
    return back.select("tu", "node_id", "parent_id", "depth", "kind")


@query
def a7_string_pool_estimate(s, d):
    """The pool of all lines by sketches of 16 chunks, united: exact counts, and whether estimates are within 5 in 100."""
    lines = text.source_lines(table(s, d, "documents"), "doc_id", "text").withColumn("chunk", F.col("file") % 16)
    guess = nodes.string_pool_estimate(nodes.string_pool_sketches(lines, "line", ["chunk"]), [])
    exact = nodes.string_pool_stats(lines, "line").select(F.col("unique_strings").alias("u"), F.col("shared_bytes").alias("b"), F.col("references").alias("r"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b)
    both = guess.join(exact, guess["references"] == exact["r"])
    return both.select("references", "unshared_bytes", F.col("u").alias("unique_strings"), near("unique_strings", "u").alias("unique_near"), near("shared_bytes", "b").alias("shared_near"))


@query
def s8_project_tables(s, d):
    """Files of each project, written twice under one commit, and then some of them under a later one."""
    root = shared_path(s, "projects")
    p = b.paths(s, d)
    names = [r[0] for r in p.groupBy("project").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "project").limit(3).collect()]
    for commit, created, rows in (("one", "2024-01-01", p), ("one", "2024-01-01", p), ("two", "2024-01-02", p.where("seq % 2 = 0"))):
        for name in names if commit == "one" else names[:1]:
            documents.write_project_tables(rows.where(F.col("project") == name).select("seq", "path", "project"), root, f"/{name}/cc.json", "/build", created, commit)
    files = documents.read_project_tables(s, root).groupBy("project_key", "project").agg(F.count("*").alias("n_files"), F.sum("seq").alias("sum_seq"))
    return files.join(documents.read_projects(s, root), "project_key").select("project", "path", "commit", "n_files", "sum_seq")


def _scrambled(s, d):
    """The log as numbered chunks in twenty files, in an order that is not theirs; and the schema."""
    log = b.log_lines(s, d)
    cut = streams.chunks(log, 29)
    numbered = cut.withColumn("n", F.row_number().over(Window.partitionBy("source", "fd").orderBy("seq", "part")).cast("long") - 1).select("source", "fd", "n", "chunk")
    path = shared_path(s, "chunks")
    numbered.withColumn("file", (F.col("n") * 7 + F.col("source")) % 20).repartition("file").write.partitionBy("file").json(path)
    return path, "source long, fd int, n long, chunk string"


@query
def k1_paced_chunks(s, d):
    """Chunks that come in any order, a file a batch: early ones wait for those before them."""
    path, schema = _scrambled(s, d)
    pieces = s.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").json(path)
    return streams.run(streams.reassemble_numbered(pieces), "append")


@query
def s5_diagnostics_stream(s, d):
    """Wire lines in files, read as a stream of a few files a batch and parsed."""
    path = shared_path(s, "wire")
    documents.write_diagnostics(table(s, d, "events").select(F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info").alias("level"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file"), (1 + F.col("event_id") % 97).alias("line"), F.lit(0).alias("col"), F.col("event_type").alias("message")).repartition(6), path)
    return streams.run(logs.parse_lines(documents.read_diagnostics(s, path, stream=True, files=2)).select("level", "message"), "append")
