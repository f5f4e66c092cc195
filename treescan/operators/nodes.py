"""Syntax-tree nodes and their property bags.

Table nodes: tu, node_id, parent_id, ordinal, kind, props (map of scalar properties as text; arrays and objects are ''),
and where needed pre, begin and end positions, data_id, bag (VARIANT).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treescan.functions.columns import enum_label, is_under_root, scalar_to_string, valid_location
from treescan.functions.storage import counted, written
from treescan.operators.paths import dense_ids


def parse_search(expression: str) -> list[tuple[str | None, str]]:
    """Terms of a search: (key, pattern), key None for a bare term. Splits at every word followed by a colon."""
    marks = list(re.finditer(r"(\w+):", expression))
    if not marks:
        return [(None, expression)]
    bare = expression[: marks[0].start()].strip()
    ends = [m.start() for m in marks[1:]] + [len(expression)]
    return [(None, bare)] * bool(bare) + [(m[1], expression[m.end() : e].strip()) for m, e in zip(marks, ends, strict=True)]


def matches(expression: str, props: str = "props") -> Column:
    """Predicate of a search over a map of properties: all terms, in any case. Raises ValueError for a bad pattern."""
    test = F.lit(True)
    for key, pattern in parse_search(expression):
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"invalid pattern: {pattern}") from e
        if key is None:
            test = test & F.exists(F.map_values(props), lambda v: (v != "") & v.rlike(f"(?i){pattern}"))  # noqa: B023
        else:
            value = F.try_element_at(F.col(props), F.lit(key))
            test = test & value.isNotNull() & (value.rlike(f"(?i)^(?:{pattern})$") if pattern else F.lit(True))
    return F.coalesce(test, F.lit(False))


def search_nodes(nodes: DataFrame, expression: str, project: DataFrame | None = None, root: str = "") -> DataFrame:
    """Matching nodes. With a root only those that begin in a file at or below it (files: file_id, path); a node that is
    filtered out does not hide its children. Sort by tu and pre for the order of the tree."""
    found = nodes.where(matches(expression))
    if project is not None and root:
        inside = project.where(is_under_root(F.col("path"), F.lit(root))).select(F.col("file_id").alias("begin_file"))
        found = found.join(inside, "begin_file", "left_semi")
    return found


def located_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that the source has a place for; others are made by the compiler."""
    return nodes.where(F.col("begin_file").isNotNull())


def files_in_tree(files: DataFrame, nodes: DataFrame, present: bool = True) -> DataFrame:
    """Files that have (or have no) located node."""
    used = located_nodes(nodes).select(F.col("begin_file").alias("file_id"))
    return files.join(used, "file_id", "left_semi" if present else "left_anti")


def macro_spelling_range(nodes: DataFrame) -> DataFrame:
    """nodes with the six numbers of macroSpellingRange in the bag; only rows where both ends are whole."""
    part = lambda end, key: F.try_variant_get("bag", f"$.macroSpellingRange.{end}.{key}", "long")
    whole = lambda end, key: F.schema_of_variant(F.coalesce(F.try_variant_get("bag", f"$.macroSpellingRange.{end}.{key}", "variant"), F.parse_json(F.lit("null")))) == "BIGINT"
    out = nodes.withColumns({f"macro_{end}_{name}": part(end, key) for end in ("begin", "end") for name, key in (("file", "fileId"), ("line", "line"), ("col", "column"))})
    ok = F.lit(True)
    for end in ("begin", "end"):
        ok = ok & valid_location(F.col(f"macro_{end}_file"), F.col(f"macro_{end}_line"), F.col(f"macro_{end}_col"))
        for key in ("fileId", "line", "column"):
            ok = ok & whole(end, key)
    return out.where(ok)


def node_label(nodes: DataFrame) -> DataFrame:
    """nodes with label: kind, name, type and details, as one line.

    Each property is looked up once: empty ones go first, so that what is absent or empty is null and drops out of its piece,
    and pieces that are needed twice are columns. Written as one expression it repeats its pieces, and the generated method
    is too long for the JVM to compile.
    """
    p = lambda key: F.try_element_at("_props", F.lit(key))
    on = lambda key: p(key) == "true"
    piece = lambda before, value, after="": F.concat(F.lit(before), value, F.lit(after))
    extra = lambda key, word: F.when(~F.col(key).eqNullSafe(F.col("_type")), piece(f" {word}: ", F.col(key)))
    flags = F.concat_ws(" ", *[F.when(on(k), F.lit(w)) for k, w in (("isConstexpr", "constexpr"), ("isStatic", "static"), ("isVirtual", "virtual"), ("isPure", "pure"), ("isInlined", "inline"))])
    args = F.col("template_args") if "template_args" in nodes.columns else F.array().cast("array<string>")
    rows = nodes.withColumn("_props", F.map_filter("props", lambda _, v: v != ""))
    rows = rows.withColumns({"_type": F.coalesce(p("type"), p("spelledType")), "_flags": flags, "_canonical": p("canonicalType"), "_desugared": p("desugaredType")})
    detail = F.concat_ws(
        "",
        extra("_canonical", "canon"),
        extra("_desugared", "desug"),
        F.when(F.col("_flags") != "", piece(" {", F.col("_flags"), "}")),
        F.when(F.size(args) > 0, piece(" <", F.array_join(args, ", "), ">")),
        F.when(on("isLValue"), " vc=lvalue").when(on("isXValue"), " vc=xvalue").when(on("isPRValue"), " vc=prvalue"),
        F.when(on("isTypeDependent") | on("isValueDependent"), " dep"),
        piece(" = ", p("value")),
    )
    rows = rows.withColumn("_detail", F.trim(detail))
    label = F.concat_ws("", p("kind"), piece(" [", F.coalesce(p("name"), p("declName"), p("memberName")), "]"), piece(" : ", F.col("_type")), F.when(F.col("_detail") != "", piece(" ", F.col("_detail"))))
    return rows.withColumn("label", label).drop("_props", "_type", "_flags", "_canonical", "_desugared", "_detail")


# Properties of each family of nodes, with their types
FAMILIES = {
    "Decl": {"isDecl": "boolean", "isDeclContext": "boolean", "name": "string", "linkage": "int", "type": "string", "comment": "string"},
    "FunctionDecl": {"name": "string", "returnType": "string", "numParams": "int", "isDefined": "boolean", "isInlined": "boolean", "isConstexpr": "boolean", "isDeleted": "boolean", "isDefaulted": "boolean", "isVirtual": "boolean", "isPure": "boolean", "isConst": "boolean", "isStatic": "boolean", "isOverride": "boolean", "refQualifier": "string"},
    "VarDecl": {"name": "string", "type": "string", "isUsed": "boolean", "isReferenced": "boolean", "hasInit": "boolean", "isConstexpr": "boolean", "initStyle": "int", "storageClass": "int", "isThreadLocal": "boolean", "isMutable": "boolean", "isBitField": "boolean", "hasDefaultArg": "boolean"},
    "CXXRecordDecl": {"name": "string", "tagKind": "int", "numBases": "int", "isReferenced": "boolean", "hasDefinition": "boolean", "isAbstract": "boolean", "isPolymorphic": "boolean", "isEmpty": "boolean", "isAggregate": "boolean", "isPOD": "boolean", "isTrivial": "boolean", "isCompleteDefinition": "boolean"},
    "EnumDecl": {"name": "string", "isScoped": "boolean", "isFixed": "boolean", "underlyingType": "string"},
    "EnumConstantDecl": {"name": "string", "initVal": "long"},
    "TemplateTypeParmDecl": {"name": "string", "depth": "int", "index": "int", "hasDefaultArgument": "boolean"},
    "ClassTemplateSpecializationDecl": {"name": "string", "numTemplateArgs": "int", "specializationKind": "int"},
    "TypedefNameDecl": {"name": "string", "underlyingType": "string"},
    "Expr": {"type": "string", "valueKind": "int", "objectKind": "int", "isTypeDependent": "boolean", "isValueDependent": "boolean", "isLValue": "boolean", "isPRValue": "boolean", "isXValue": "boolean", "isGLValue": "boolean"},
    "IfStmt": {"hasElse": "boolean", "hasInit": "boolean", "hasVar": "boolean", "isConstexpr": "boolean"},
    "BinaryOperator": {"opcode": "string", "opcodeValue": "int", "isAssignment": "boolean", "isCompound": "boolean", "isComparison": "boolean", "isLogical": "boolean"},
    "UnaryOperator": {"opcode": "string", "opcodeValue": "int", "isPrefix": "boolean", "isPostfix": "boolean", "isIncrementOp": "boolean", "isDecrementOp": "boolean"},
    "IntegerLiteral": {"value": "long"},
    "FloatingLiteral": {"value": "double", "isExact": "boolean"},
    "StringLiteral": {"byteLength": "long", "length": "long", "charWidth": "int", "value": "string", "encoding": "string"},
    "CharacterLiteral": {"value": "long"},
    "CXXBoolLiteralExpr": {"value": "boolean"},
    "DeclRefExpr": {"declName": "string"},
    "MemberExpr": {"memberName": "string", "isArrow": "boolean"},
    "CallExpr": {"type": "string", "numArgs": "int", "calleeName": "string"},
    "CastExpr": {"castKind": "string", "castKindValue": "int", "targetType": "string"},
    "CXXConstructExpr": {"constructorName": "string", "numArgs": "int", "isElidable": "boolean", "requiresZeroInit": "boolean"},
    "CXXNewExpr": {"allocatedType": "string", "isArray": "boolean", "isGlobalNew": "boolean"},
    "CXXDeleteExpr": {"isArray": "boolean", "isGlobalDelete": "boolean"},
    "LambdaExpr": {"isMutable": "boolean", "hasExplicitParams": "boolean", "hasExplicitResultType": "boolean", "numCaptures": "int"},
    "Type": {"canonicalType": "string", "typeName": "string", "size": "long"},
    "TypeLoc": {"hasLocalRange": "boolean"},
    "Attr": {"spelling": "string"},
    "ConceptReference": {"name": "string"},
    "CXXBaseSpecifier": {"baseType": "string"},
    "CXXCtorInitializer": {"member": "string"},
    "LambdaCapture": {"captureKind": "int"},
    "NestedNameSpecifier": {"qualifier": "string"},
    "TemplateArgument": {"argKind": "int", "value": "string"},
    "TemplateName": {"name": "string"},
}
# Kinds of families that have several
FAMILY_KINDS = {
    "FunctionDecl": ["FunctionDecl", "CXXMethodDecl", "CXXConstructorDecl", "CXXDestructorDecl", "CXXConversionDecl", "CXXDeductionGuideDecl"],
    "VarDecl": ["VarDecl", "FieldDecl", "ParmVarDecl"],
    "CXXRecordDecl": ["CXXRecordDecl", "ClassTemplateSpecializationDecl", "ClassTemplatePartialSpecializationDecl"],
    "ClassTemplateSpecializationDecl": ["ClassTemplateSpecializationDecl", "ClassTemplatePartialSpecializationDecl"],
    "TypedefNameDecl": ["TypedefDecl", "TypeAliasDecl", "ObjCTypeParamDecl"],
    "BinaryOperator": ["BinaryOperator", "CompoundAssignOperator"],
    "CallExpr": ["CallExpr", "CXXMemberCallExpr", "CXXOperatorCallExpr", "CUDAKernelCallExpr", "UserDefinedLiteral"],
    "CXXConstructExpr": ["CXXConstructExpr", "CXXTemporaryObjectExpr"],
    "TemplateArgument": ["TemplateArgument", "TemplateArgumentLoc"],
}
#: Families by the end of a kind. A type and its place in the source have the same kinds.
FAMILY_ENDS = {"Decl": "Decl$", "Expr": "(Expr|Operator|Literal)$", "CastExpr": "CastExpr$", "Type": "Type$", "TypeLoc": "Type$"}


def typed_view(nodes: DataFrame, family: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Nodes of a family with typed columns from the bag; a missing or unfit property is null, codes get labels."""
    columns = columns or FAMILIES[family]
    kind = F.col("kind")
    rows = nodes.where(kind.rlike(FAMILY_ENDS[family]) if family in FAMILY_ENDS else kind.isin(FAMILY_KINDS.get(family, [family])))
    if family in ("Type", "TypeLoc"):
        rows = rows.where(_has_place("bag") if family == "TypeLoc" else ~_has_place("bag"))
    typed = {k: F.try_variant_get("bag", f"$.{k}", t) for k, t in columns.items()}
    names = {f"{k}Name": enum_label(typed[k], k) for k in columns if k in ("valueKind", "objectKind", "initStyle", "storageClass", "linkage")}
    return rows.select("tu", "node_id", *[c.alias(k) for k, c in {**typed, **names}.items()])


def _has_place(bag: str) -> Column:
    return F.coalesce(F.try_variant_get(bag, "$.hasLocalRange", "boolean"), F.lit(False))


def _explode_list(nodes: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    items = F.try_variant_get("bag", f"$.{key}", "array<variant>")
    rows = nodes.select("tu", "node_id", F.posexplode(items).alias("pos", "item"))
    return rows.select("tu", "node_id", "pos", *[F.try_variant_get("item", f"$.{k}", t).alias(k) for k, t in fields.items()])


def explode_params(nodes: DataFrame) -> DataFrame:
    return _explode_list(nodes, "params", {"name": "string", "type": "string"})


def explode_bases(nodes: DataFrame) -> DataFrame:
    return _explode_list(nodes, "bases", {"type": "string", "isVirtual": "boolean", "accessSpecifier": "string"})


def explode_template_args(nodes: DataFrame) -> DataFrame:
    """One row per template argument; packs of 1 to 999 are opened in place at any depth, others stay one row. path: place
    at each level. A level is written once, its finished rows with those that are still to be opened, so each bag is read once."""
    text = lambda key: F.try_variant_get("item", f"$.{key}", "string").alias(key)
    items = F.try_variant_get("bag", "$.templateArgs", "array<variant>")
    level = nodes.select("tu", "node_id", F.posexplode(items).alias("pos", "item")).select("tu", "node_id", F.array("pos").alias("path"), "item")
    done = []
    while True:
        packed = level.withColumn("inner", F.try_variant_get("item", "$.pack", "array<variant>"))
        pack = F.when(F.size("inner").between(1, 999), F.col("inner"))
        rows, n = counted(packed.select("tu", "node_id", "path", text("kindName"), text("value"), pack.alias("pack")), "packs", open=F.count_if(F.col("pack").isNotNull()))
        done.append(rows.where("pack is null").drop("pack"))
        if not n["open"]:
            return reduce(DataFrame.union, done)
        level = rows.where("pack is not null").select("tu", "node_id", "path", F.posexplode("pack").alias("pos", "item")).select("tu", "node_id", F.concat("path", F.array("pos")).alias("path"), "item")


def flatten_properties(nodes: DataFrame, ids: list[str], bag: str = "bag") -> DataFrame:
    """A row per property at any depth: ids, path, key, value (text), value_type; containers give '(object)' or '[n items]'."""
    kind_of = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    level = nodes.select(*ids, F.lit("").alias("path"), F.lit("(root)").alias("key"), F.col(bag).alias("v")).where("v is not null")
    out = None
    while True:
        typed = level.withColumn("value_type", kind_of(F.col("v")))
        array, obj = F.col("value_type") == "ARRAY", F.col("value_type") == "OBJECT"
        hexed = F.when((F.col("key") == "nodePtr") & (F.col("value_type") == "BIGINT"), F.concat(F.lit("0x"), F.lower(F.hex(F.try_variant_get("v", "$", "long")))))
        items = F.size(F.try_variant_get("v", "$", "array<variant>"))
        text = F.when(obj, F.lit("(object)")).when(array, F.concat(F.lit("["), items.cast("string"), F.lit(" items]"))).when(F.col("value_type") == "VOID", F.lit("null"))
        value = F.coalesce(text, hexed, scalar_to_string(F.col("v"), F.col("value_type")))
        rows = typed.select(*ids, "path", "key", value.alias("value"), F.lower("value_type").alias("value_type"))
        out = rows if out is None else out.union(rows)
        inner = typed.where(array | obj)
        if inner.isEmpty():
            break
        level = written(_opened(inner, ids), "properties")
    return out.where("path <> '' or key <> '(root)'")


def _opened(inner: DataFrame, ids: list[str]) -> DataFrame:
    """Children of containers: objects by key, arrays by [i]."""
    obj = F.try_variant_get("v", "$", "map<string,variant>")
    arr = F.try_variant_get("v", "$", "array<variant>")
    of_obj = inner.where("value_type = 'OBJECT'").select(*ids, "path", F.explode(obj).alias("key", "v"))
    of_arr = inner.where("value_type = 'ARRAY'").select(*ids, "path", F.posexplode(arr).alias("i", "v")).select(*ids, "path", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("key"), "v")
    return of_obj.union(of_arr).withColumn("path", F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("key")))


# Categories of nodes in the statistics
CATEGORIES = ["decl", "stmt", "type", "typeLoc", "attr", "conceptRef", "cxxBaseSpec", "ctorInit", "lambdaCapture", "nestedNameSpec", "nestedNameSpecLoc", "tempArg", "tempArgLoc", "tempName"]
# Kinds that are a category of their own
CATEGORY_KINDS = {
    "Attr": "attr",
    "ConceptReference": "conceptRef",
    "CXXBaseSpecifier": "cxxBaseSpec",
    "CXXCtorInitializer": "ctorInit",
    "LambdaCapture": "lambdaCapture",
    "NestedNameSpecifier": "nestedNameSpec",
    "NestedNameSpecifierLoc": "nestedNameSpecLoc",
    "TemplateArgument": "tempArg",
    "TemplateArgumentLoc": "tempArgLoc",
    "TemplateName": "tempName",
}


def category_of(kind: Column, located: Column) -> Column:
    """Category of a node: declarations and types by the end of the kind, a type with a place in the source as typeLoc,
    some kinds by themselves, and statements, to which expressions count."""
    own = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in CATEGORY_KINDS.items()])
    return F.coalesce(own, F.when(kind.endswith("Decl"), "decl").when(kind.endswith("Type"), F.when(located, "typeLoc").otherwise("type")).otherwise("stmt"))


def extraction_stats(nodes: DataFrame, categories: list[str] | None = None, category: Column | None = None) -> DataFrame:
    """Per tu a counter for each category, the nodes with a comment, and the total: the sum of the categories. Without
    categories those of syntax trees, by kind and by whether the node has a begin_file."""
    if categories is None:
        categories, category = CATEGORIES, category_of(F.col("kind"), F.col("begin_file").isNotNull())
    counts = [F.count_if(category == c).alias(f"n_{c}") for c in categories]
    total = F.count_if(category.isin(categories)).alias("total")
    comments = F.count_if(F.try_element_at(F.col("props"), F.lit("comment")).isNotNull()).alias("n_comments")
    return nodes.groupBy("tu").agg(*counts, comments, total)


def fleet_stats(nodes: DataFrame, category: Column) -> DataFrame:
    """Counts by tu and category, by tu, and of all."""
    return nodes.rollup("tu", category.alias("category")).agg(F.count("*").alias("n"))


def dedupe_types(nodes: DataFrame, key: list[str], order: str = "pre") -> DataFrame:
    """data_id for each node: the first node (by order) of its tu with the same type key; its bag is the shared one."""
    first = Window.partitionBy("tu", *key)
    return nodes.withColumn("data_id", F.min(order).over(first))


def type_sharing_stats(nodes: DataFrame, key: list[str], n_bytes: Column) -> DataFrame:
    """Per tu: unique types, references, saved nodes and bytes, references a type, share saved in percent."""
    unique = nodes.groupBy("tu", *key).agg(F.count("*").alias("refs"), F.max(n_bytes).alias("bytes"))
    s = unique.groupBy("tu").agg(F.count("*").alias("unique_types"), F.sum("refs").alias("type_references"), F.sum("bytes").cast("long").alias("node_bytes"))
    average = F.when(F.col("unique_types") > 0, F.floor(F.col("node_bytes") / F.col("unique_types"))).otherwise(256)
    saved = F.greatest(F.col("type_references") - F.col("unique_types"), F.lit(0))
    would = F.col("type_references") * average
    return s.select("tu", "unique_types", "type_references", saved.alias("saved_nodes"), (saved * average).cast("long").alias("saved_bytes"), F.round(F.col("type_references") / F.col("unique_types"), 4).alias("ratio"), F.round(F.when(would > 0, 100.0 * (would - F.col("node_bytes")) / would).otherwise(0.0), 4).alias("saved_percent"))


def _saved(s: DataFrame) -> DataFrame:
    percent = F.when(F.col("unshared_bytes") > 0, 100.0 * (F.col("unshared_bytes") - F.col("shared_bytes")) / F.col("unshared_bytes")).otherwise(0.0)
    return s.withColumn("saved_percent", F.round(F.greatest(percent, F.lit(0.0)), 4))


#: Bytes of a pooled string besides its text.
OVERHEAD = 32


def string_pool_stats(strings: DataFrame, value: str) -> DataFrame:
    """One row: unique strings, references, bytes with and without sharing, share saved."""
    each = strings.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("refs")).withColumn("bytes", F.octet_length(value) + F.lit(OVERHEAD))
    return _saved(each.agg(F.count("*").alias("unique_strings"), F.coalesce(F.sum("refs"), F.lit(0)).alias("references"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("shared_bytes"), F.coalesce(F.sum(F.col("refs") * F.col("bytes")), F.lit(0)).alias("unshared_bytes")))


#: Registers of a sketch: 2^12, a standard error of 1.6 in 100 for the strings of one size.
SKETCH_BITS = 12


def string_pool_sketches(strings: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A sketch of the strings of each group and size (by, size, sketch, refs), which unite_sketches merges. Sizes are
    exact to 256 bytes and in steps of 1 in 64 above, so a group has a few hundred rows whatever it holds."""
    n = F.octet_length(value).cast("long")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)))) - 6, F.lit(0))).cast("long")
    size = F.when(n <= 256, n).otherwise(F.floor(n / step).cast("long") * step + F.floor(step / 2).cast("long"))
    rows = strings.where(F.col(value).isNotNull()).select(*by, size.alias("size"), F.col(value).alias("_value"), (n + OVERHEAD).alias("_bytes"))
    return rows.groupBy(*by, "size").agg(F.hll_sketch_agg("_value", F.lit(SKETCH_BITS)).alias("sketch"), F.count("*").alias("refs"), F.sum("_bytes").alias("bytes"))


def unite_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer groups merged to those of coarser ones."""
    return sketches.groupBy(*by, "size").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("refs").alias("refs"), F.sum("bytes").alias("bytes"))


def string_pool_estimate(sketches: DataFrame, by: list[str]) -> DataFrame:
    """string_pool_stats of each group by its sketches: references and unshared bytes are exact; unique strings and shared
    bytes have a standard error of 1.6 in 100 at most, and less where sizes differ."""
    unique = F.hll_sketch_estimate("sketch")
    each = unite_sketches(sketches, by).select(*by, "refs", "bytes", unique.alias("unique"), (unique * (F.col("size") + OVERHEAD)).alias("shared"))
    return _saved(each.groupBy(*by).agg(F.coalesce(F.sum("unique"), F.lit(0)).alias("unique_strings"), F.coalesce(F.sum("refs"), F.lit(0)).alias("references"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared_bytes"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("unshared_bytes")))


def child_ordinals(nodes: DataFrame) -> DataFrame:
    """0-based place of each node among its siblings; 0 for a root."""
    place = F.row_number().over(Window.partitionBy("tu", "parent_id").orderBy("pre")) - 1
    return nodes.withColumn("row", F.when(F.col("parent_id").isNull(), 0).otherwise(place).cast("long"))


def match_cycle(found: DataFrame) -> DataFrame:
    """Matches (tu, node_id, pre) of each tu with i of n, next and previous match; both wrap around. Numbers come from
    counts of range parts and neighbours from a join on the number, so a tu with most matches is not one task's."""
    numbered = dense_ids(found.select("tu", "node_id", "pre"), ["tu", "pre", "node_id"], "at")
    of_tu = numbered.groupBy("tu").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    rows = written(numbered.join(of_tu, "tu").select("tu", "node_id", "pre", (F.col("at") - F.col("first") + 1).alias("i"), "n"), "matches")
    at = lambda i, name: rows.select("tu", i.alias("i"), F.col("node_id").alias(name))
    n, i = F.col("n"), F.col("i")
    return rows.join(at(F.when(i == 1, n).otherwise(i - 1), "next_id"), ["tu", "i"]).join(at(i % n + 1, "previous_id"), ["tu", "i"]).select("tu", "node_id", "pre", "i", "n", "next_id", "previous_id")
