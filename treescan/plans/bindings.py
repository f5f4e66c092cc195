"""The model tables, read from the given tables (the definitions are in FIXTURES.md)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treescan.functions.storage import shared_path, written
from treescan.operators import positions

SUFFIXES = r"(?i)\.(html)$"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tu(key: str):
    return F.concat(F.lit("/work/src/t"), F.col(key).cast("string"), F.lit(".cpp"))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def include_events(spark: SparkSession, d: str) -> DataFrame:
    """B3: tu, seq, header, direct, inclusion_kind."""
    h = F.col("l_partkey") % 20
    folder = F.when(h < 12, "/work/include/h").otherwise("/usr/include/h")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long")
    return table(spark, d, "lineitem").select(_tu("l_orderkey").alias("tu"), seq.alias("seq"), F.concat(folder, h.cast("string"), F.lit(".h")).alias("header"), (F.col("l_returnflag") == "R").alias("direct"), F.when(F.col("l_linestatus") == "O", "C_User").otherwise("C_System").alias("inclusion_kind"))


def tu_errors(spark: SparkSession, d: str) -> DataFrame:
    """B3: tu, err_seq, message."""
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(_tu("o_orderkey").alias("tu"), F.col("o_custkey").alias("err_seq"), F.col("o_orderpriority").alias("message"))


def commands(spark: SparkSession, d: str) -> DataFrame:
    """Compile commands: project, cmd_seq, file: one for each order."""
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("project"), F.col("o_orderkey").alias("cmd_seq"), _tu("o_orderkey").alias("file"))


def include_edges(spark: SparkSession, d: str) -> DataFrame:
    """B3: src, dst over parts, within blocks of 64 keys, so that no part reaches more than its block."""
    parts = table(spark, d, "part").select("p_partkey")
    p = F.col("p_partkey")
    at = lambda by, more: p - p % 64 + (p % 64 * by + more) % 64
    edges = parts.select(p.alias("src"), F.explode(F.array(at(7, 1), at(3, 2))).alias("dst"))
    parts = parts.withColumnRenamed("p_partkey", "dst").hint("merge")  # however small the file, there is a key a row
    return edges.join(parts, "dst", "left_semi").select("src", "dst")


def paths(spark: SparkSession, d: str) -> DataFrame:
    """B4: seq, path, host, project."""
    rest = F.regexp_extract("url", r"^[A-Za-z]+://([^?#]*)", 1)
    path = F.concat(F.lit("/"), F.regexp_replace(rest, "/+$", ""))
    return table(spark, d, "pages").select(F.col("page_id").alias("seq"), path.alias("path")).withColumn("host", F.split("path", "/")[1]).withColumn("project", F.regexp_extract("host", r"[^.]+\.[^.]+$", 0))


def tree(spark: SparkSession, d: str, owner: bool = False) -> DataFrame:
    """B2: tu, node_id, parent_id, ordinal, kind, name, props; with owner the customer of customers, orders and lines too."""
    t = lambda name: table(spark, d, name)
    text = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long")

    def part(df, node_id, parent_id, ordinal, kind, name, of=None, **props):
        bag = F.create_map(*[x for k, v in {"kind": F.lit(kind), "name": name, **props}.items() for x in (F.lit(k), v)])
        return df.select(F.lit("db").alias("tu"), node_id.alias("node_id"), parent_id.cast("string").alias("parent_id"), ordinal.cast("long").alias("ordinal"), F.lit(kind).alias("kind"), name.alias("name"), bag.alias("props"), *[(F.lit(None).cast("string") if of is None else of).alias("owner")] * owner)

    lines = t("lineitem").withColumn("rn", line)
    if owner:  # the lines lie and stand by l_orderkey already, so they are not shuffled again
        lines = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").hint("merge"), "l_orderkey")
    of_order = {"of": text("c", "o_custkey")} if owner else {}
    root = t("region").agg(F.min("r_regionkey"))  # one row
    return reduce(
        DataFrame.union,
        [
            part(root, F.lit("root"), F.lit(None), F.lit(0), "root", F.lit("root")),
            part(t("region"), text("r", "r_regionkey"), F.lit("root"), F.col("r_regionkey"), "region", F.col("r_name")),
            part(t("nation"), text("n", "n_nationkey"), text("r", "n_regionkey"), F.col("n_nationkey"), "nation", F.col("n_name")),
            part(t("customer"), text("c", "c_custkey"), text("n", "c_nationkey"), F.col("c_custkey"), "customer", F.col("c_name"), of=text("c", "c_custkey"), segment=F.col("c_mktsegment")),
            part(t("orders"), text("o", "o_orderkey"), text("c", "o_custkey"), F.col("o_orderkey"), "order", F.col("o_orderkey").cast("string"), **of_order, status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")),
            part(lines, F.concat(text("l", "l_orderkey"), text("_", "rn")), text("o", "l_orderkey"), F.col("rn"), "line", F.col("rn").cast("string"), **of_order, flag=F.col("l_returnflag"), linestatus=F.col("l_linestatus")),
        ],
    )


KINDS = ["FunctionDecl", "VarDecl", "EnumConstantDecl", "ClassTemplateSpecializationDecl", "TypedefDecl", "IfStmt", "BinaryOperator", "CXXNewExpr", "LambdaExpr", "PointerType", "Attr", "ConceptReference", "CXXBaseSpecifier", "CXXCtorInitializer", "LambdaCapture", "NestedNameSpecifier", "NestedNameSpecifierLoc", "TemplateArgument", "TemplateArgumentLoc", "TemplateName"]


def syntax_nodes(spark: SparkSession, d: str) -> DataFrame:
    """B9: tu (order), node_id, kind, begin_file (null for half of them), props, bag: a node for each line."""
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % len(KINDS) + 1).cast("int"))
    lines = table(spark, d, "lineitem").withColumn("rn", rn).withColumn("kind", kind)
    large = F.col("l_quantity") > 25
    bag = {"kind": F.col("kind"), "name": F.concat(F.lit("n"), F.col("l_partkey")), "initVal": F.col("l_suppkey"), "numTemplateArgs": F.col("l_linenumber"), "specializationKind": F.col("l_quantity").cast("int"), "underlyingType": F.col("l_returnflag"), "hasElse": large, "hasVar": ~large, "opcode": F.col("l_linestatus"), "opcodeValue": F.col("l_linenumber"), "isAssignment": large, "allocatedType": F.col("l_returnflag"), "isArray": large, "isMutable": ~large, "numCaptures": F.col("l_linenumber")}
    pair = lambda key, value: F.create_map(F.lit(key), F.col(value))
    props = F.when(F.col("l_linenumber") == 1, F.map_concat(pair("kind", "kind"), pair("comment", "l_returnflag"))).otherwise(pair("kind", "kind"))
    return lines.select(F.concat(F.lit("t"), F.col("l_orderkey")).alias("tu"), F.concat_ws("_", "l_orderkey", "rn").alias("node_id"), "kind", F.when(F.col("l_suppkey") % 2 == 0, 1).alias("begin_file"), props.alias("props"), F.parse_json(F.to_json(F.struct(*[v.alias(k) for k, v in bag.items()]))).alias("bag"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    """B1: tu, node_id (text), pre, kind, attrs, begin and end positions; begin_file = tu."""
    body = F.regexp_replace("html", r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<!DOCTYPE[^>]*>", "")
    each = table(spark, d, "pages").select(F.col("page_id").alias("tu"), F.posexplode(F.regexp_extract_all(body, F.lit(r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>"), F.lit(0))).alias("i", "tag"))
    named = each.select("tu", (F.col("i") + 1).cast("long").alias("seq"), F.lower(F.regexp_extract("tag", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("kind"), F.col("tag").startswith("</").alias("closing"), F.trim(F.regexp_extract("tag", r"^</?[a-zA-Z][a-zA-Z0-9]*([^>]*)>", 1)).alias("attrs"))
    w = Window.partitionBy("tu", "kind").orderBy("seq")
    paired = named.withColumn("stop", F.when(F.lead("closing").over(w), F.lead("seq").over(w)).otherwise(F.col("seq"))).where("not closing")
    at = lambda c: ((1 + F.floor(F.col(c) / 8)).cast("long"), (1 + F.col(c) % 8).cast("long"))
    (bl, bc), (el, ec) = at("seq"), at("stop")
    return paired.select("tu", F.concat_ws("_", F.col("tu"), F.col("seq")).alias("node_id"), F.col("seq").alias("pre"), "kind", "attrs", F.col("tu").alias("begin_file"), bl.alias("begin_line"), bc.alias("begin_col"), el.alias("end_line"), ec.alias("end_col"))


_INDEXES: dict[tuple, str] = {}


def position_index(spark: SparkSession, d: str) -> positions.PositionIndex:
    """The tags with their parents and depths as a stored index, written once for an application and the files of a folder."""
    key = (spark.sparkContext.applicationId, *sorted(table(spark, d, "pages").inputFiles()))
    if key not in _INDEXES:
        nodes = written(tags(spark, d), "tags")
        path = shared_path(spark, "position-index")
        positions.write_position_index(positions.smallest_enclosing(nodes), path)
        _INDEXES[key] = path
    return positions.open_position_index(spark, _INDEXES[key])


def points(spark: SparkSession, d: str) -> DataFrame:
    """B8: point_id, tu, file, line, col, seq."""
    n = table(spark, d, "pages").count()
    seq = 1 + F.col("event_id") % 60
    page = F.col("event_id") % n
    return table(spark, d, "events").select(F.col("event_id").alias("point_id"), page.alias("tu"), page.alias("file"), (1 + F.floor(seq / 8)).cast("long").alias("line"), (1 + seq % 8).cast("long").alias("col"))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """B8: ranges of 16 tags from each point on."""
    n = table(spark, d, "pages").count()
    page = F.col("event_id") % n
    at = lambda c: ((1 + F.floor(c / 8)).cast("long"), (1 + c % 8).cast("long"))
    (a, b), (c, e) = at(1 + F.col("event_id") % 60), at(17 + F.col("event_id") % 60)
    return table(spark, d, "events").select(F.col("event_id").alias("range_id"), page.alias("tu"), page.alias("file"), a.alias("from_line"), b.alias("from_col"), c.alias("to_line"), e.alias("to_col"))


def _events(spark: SparkSession, d: str, stream: bool) -> DataFrame:
    """The table of events, or a stream of its files."""
    events = table(spark, d, "events")
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d) if stream else events


def log_lines(spark: SparkSession, d: str, stream: bool = False) -> DataFrame:
    """B6: source, seq, ts, is_stderr, line; of the table, or as a stream of it."""
    events = _events(spark, d, stream)
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "signup", "note").when(kind == "view", "info").when(kind == "click", "warning")
    wire = F.concat_ws("\t", F.lit("@diag"), level, F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string"), (F.col("event_id") % 31).cast("string"), F.coalesce("props", F.lit("")))
    value = F.floor(F.coalesce("value", F.lit(0.0))).cast("long").cast("string")
    plain = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("purchase error: "), value)).otherwise(F.concat(F.lit("purchase "), value))
    return events.select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), "ts", (F.col("event_id") % 2 == 0).alias("is_stderr"), F.when(level.isNull(), plain).otherwise(wire).alias("line"))


def nav_events(spark: SparkSession, d: str, stream: bool = False) -> DataFrame:
    """B7: session, seq, file, line, col, node, version, delta: every eleventh event goes back one place."""
    code = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5)
    one = F.lit(1).cast("long")
    return _events(spark, d, stream).select(F.col("user_id").alias("session"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("seq"), code.cast("long").alias("file"), (F.col("event_id") % 2).cast("long").alias("line"), one.alias("col"), one.alias("node"), one.alias("version"), F.when(F.col("event_id") % 11 == 0, -1).otherwise(0).alias("delta"))
