"""Operators on literal fixtures."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F
from treescan.functions import columns as c
from treescan.operators import commands, history, includes, logs, nodes, paths, positions, text, trees


def one(spark, expr, *values):
    cols = ", ".join(f"c{i} string" for i in range(len(values)))
    df = spark.createDataFrame([values], cols) if values else spark.range(1)
    return df.select(expr).first()[0]


# columns


@pytest.mark.parametrize("path, want", [("/a/./b/../c", "/a/c"), ("a//b/", "a/b"), ("/../x", "/x"), ("../x/..", ".."), ("//host/a/..", "//host"), ("", ""), (".", "."), ("a\\b", "a/b"), ("/", "/")])
def test_normalize_path(spark, path, want):
    assert one(spark, c.normalize_path("c0"), path) == want


@pytest.mark.parametrize("x, want", [(0.1, "0.1"), (1234567.0, "1.23457e+06"), (100000.0, "100000"), (0.0001, "0.0001"), (0.00001234, "1.234e-05"), (-2.5, "-2.5"), (0.0, "0"), (3.0, "3"), (999999.5, "1e+06")])
def test_format_general(spark, x, want):
    assert f"{x:g}" == want
    assert spark.createDataFrame([(x,)], "x double").select(c.format_general(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("line, err, want", [("fatal: x", False, "Error"), ("x error.", False, "Error"), ("errors", False, "Info"), ("errors", True, "Warning"), ("my_error: x", False, "Info"), ("a warn] b", False, "Warning"), ("note", False, "Debug"), ("error.x", False, "Info"), ("warning error:", False, "Error")])
def test_guess_level(spark, line, err, want):
    assert one(spark, c.guess_level(F.col("c0"), F.lit(err)), line) == want


def test_names_and_labels(spark):
    assert one(spark, c.export_name(F.col("c0"), F.col("c1")), "FunctionDecl", "operator <<x") == "FunctionDecl_operator_x.json"
    assert one(spark, c.export_name(F.col("c0"), F.col("c1")), "", "") == "ast_subtree.json"
    assert one(spark, c.enum_label(F.lit(1), "valueKind")) == "VK_LValue" and one(spark, c.enum_label(F.lit(9), "linkage")) == "Unknown"
    assert one(spark, c.format_diag(F.lit("error"), F.lit("a\tb"), F.lit(0), F.lit(3), F.lit("m\nn"))) == "@diag\terror\ta b\t\t3\tm n"
    assert one(spark, c.project_key(F.lit("/p"))) == __import__("hashlib").sha256(b"/p").hexdigest()[:16]


# includes


def test_direct_is_or_of_events(spark):
    e = spark.createDataFrame([("t", 1, "h", True, "C_User"), ("t", 2, "h", False, "C_System")], "tu string, seq long, header string, direct boolean, inclusion_kind string")
    assert [tuple(r) for r in includes.dedupe_headers(e).collect()] == [("t", "h", True, "C_User", 1)]


def test_nested_closure(spark):
    edges = spark.createDataFrame([("main", "level1"), ("main", "iostream"), ("level1", "level2"), ("level2", "vector"), ("vector", "level1")], "src string, dst string")
    got = {r.header: r.direct for r in includes.include_closure(edges, spark.createDataFrame([("main",)], "main string")).collect()}
    assert got == {"level1": True, "iostream": True, "level2": False, "vector": False}


def test_closure_writes_a_row_a_block_not_one_a_pair(spark, monkeypatch):
    """Forty files with one header that has 128 more; and the fewest steps in a graph with cycles, repeats and nulls."""
    sizes, name = [], lambda i: f"h{i:03}"

    def watch(module, function):
        real = getattr(module, function, None)

        def seen(df, *args, **kw):
            out = real(df, *args, **kw)
            sizes.append((out[0] if isinstance(out, tuple) else out).count())
            return out

        monkeypatch.setattr(module, function, seen, raising=False)

    watch(includes, "written"), watch(includes, "counted")
    schema = "src string, dst string"
    star = spark.createDataFrame([(f"m{m}", name(0)) for m in range(40)] + [(name(0), name(i)) for i in range(1, 129)], schema)
    mains = spark.createDataFrame([(f"m{m}",) for m in range(40)], "main string")
    got = includes.include_closure(star, mains).groupBy("steps").count().collect()
    assert {r.steps: r["count"] for r in got} == {1: 40, 2: 40 * 128} and max(sizes) <= 40 * 3 + 129
    monkeypatch.undo()
    edges = [(name(i), name(i + 1)) for i in range(12)] * 2 + [(name(12), name(3)), (name(7), name(10)), (name(2), None), (name(5), None), (None, name(1)), ("m1", name(11)), ("m2", name(0))]
    got = includes.include_closure(spark.createDataFrame(edges, schema), spark.createDataFrame([("m1",), ("m2",), ("m2",), (name(8),), ("m3",), (None,)], "main string")).collect()
    want = set()
    for main in ("m1", "m2", name(8)):
        steps, last, k = {}, {main}, 0
        while last:
            k += 1
            last = {d for s, d in edges if s in last and s is not None} - set(steps)
            steps.update(dict.fromkeys(last, k))
        want |= {(main, h, k, k == 1) for h, k in steps.items()}
    assert len(got) == len(want) and {(r.main, r.header, r.steps, r.direct) for r in got} == want and max(r.steps for r in got) > 8


def test_closure_broadcasts_no_table(spark, monkeypatch, tmp_path):
    """Joins of headers, edges and what is reached are shuffled, however small their files; only counts of parts are sent."""
    from treescan.plans import bindings

    plans = []

    def watch(function):
        real = getattr(includes, function)

        def seen(df, *args, **kw):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df, *args, **kw)

        monkeypatch.setattr(includes, function, seen)

    watch("written"), watch("counted")
    spark.range(130).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    edges = bindings.include_edges(spark, str(tmp_path))
    found = includes.include_closure(edges, bindings.table(spark, str(tmp_path), "part").select(F.col("p_partkey").alias("main")))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line and "_part" not in line]
    assert len(joins) > 6 and not [line for line in joins if "SortMergeJoin" not in line]


def test_merge_skips_bad_chunks_and_fails_without_good(spark):
    rows = [(1, 1, 0, 5, None), (2, 2, 1, 7, None), (None, None, None, None, "{bad")]
    schema = "total_count long, success_count long, failure_count long, total_header_count long, _corrupt_record string"
    assert tuple(includes.merge_stats(spark.createDataFrame(rows, schema)).first()) == (3, 3, 1, 12, 2)
    with pytest.raises(Exception, match="no chunk"):
        includes.merge_stats(spark.createDataFrame(rows[2:], schema)).collect()


def test_tu_status_and_dedupe(spark):
    log = spark.createDataFrame([("a", 1, "1"), ("a", 2, "no"), ("b", 1, " TRUE "), ("c", 1, None)], "tu string, ts long, flag string")
    assert {r.tu: r.failed for r in includes.tu_status(log).collect()} == {"a": False, "b": True, "c": False}
    tus = spark.createDataFrame([(1, "/tmp/a.cpp"), (2, "/tmp/./a.cpp"), (3, "/tmp/b.cpp")], "seq long, tu string")
    assert sorted(r.seq for r in includes.dedupe_tus(tus).collect()) == [1, 3]


# paths


def files(spark, *p):
    return spark.createDataFrame([(i, "p", x) for i, x in enumerate(p)], "seq long, project string, path string")


@pytest.mark.parametrize("ps, want", [(["/home/u/a.c"], "/home/u"), (["/a/b/c.c", "/a/b/d/e.c"], "/a/b"), (["/a.c", "/b.c"], ""), (["/x/a.c", "rel/b.c"], ""), (["/a/b", "/a/b/c.c"], "/a"), (["//h/a/x", "//h/a/y"], "//h/a")])
def test_common_root(spark, ps, want):
    assert paths.common_root(files(spark, *ps), ["project"]).first().root == want


def test_project_root(spark):
    split = files(spark, "/home/user/a.cpp", "/home/user/b.cpp", "/tmp/c.cpp")
    assert paths.project_root(split).first().root == "/home/user"
    tie = files(spark, "/home/user/project/src/a.cpp", "/tmp/c.cpp")
    db = spark.createDataFrame([("p", "/home/user/project/build/compile_commands.json", None)], "project string, path string, override string")
    assert paths.project_root(tie, db).first().root == "/home/user/project/src"
    over = spark.createDataFrame([("p", "/x/cc.json", "/home/user")], "project string, path string, override string")
    assert paths.project_root(split, over).first().root == "/home/user"
    tied = files(spark, "/a/x.cpp", "/b/y.cpp")
    db = spark.createDataFrame([("p", "/b/build/cc.json", None)], "project string, path string, override string")
    assert paths.project_root(tied, db).first().root == "/b"


def test_split_is_a_partition(spark):
    tus = spark.createDataFrame([("/home/user/project/a.cpp",), ("/home/user/project/b/c.cpp",), ("/home/user/project2/x.cpp",)], "tu string")
    got = paths.split_project_external(tus, F.lit("/home/user/project"))
    assert got.where("is_project").count() == 2 and got.where("not is_project").count() == 1


def test_register_files_is_dense(spark):
    e = spark.createDataFrame([(i, f"/d/{(i * 7) % 50}/./f") for i in range(400)], "seq long, path string")
    got = sorted((r.file_id, r.path, r.ref_count) for r in paths.register_files(e).collect())
    assert [g[0] for g in got] == list(range(1, 51)) and got[0][1] == "/d/0/f" and all(g[2] == 8 for g in got) and got[1][1] == "/d/7/f"


def test_tree_of_directories(spark):
    roll = paths.directory_rollup(files(spark, "/B/x.c", "/a/y.c", "/a/b/z.c", "/q.c"))
    order = [r.path for r in paths.order_children(roll).where("depth = 1").orderBy("ord").collect()]
    assert order == ["/a", "/B", "/q.c"]
    assert sorted(r.path for r in paths.filter_tree(roll, " Z ").collect()) == ["/a", "/a/b", "/a/b/z.c"]
    assert paths.filter_tree(roll, "  ").count() == roll.count()


@pytest.mark.parametrize("ps, is_file", [(["/a/b/c", "/a/b"], False), (["/a/b", "/a/b/c"], True)])
def test_the_first_path_says_whether_a_node_is_a_file(spark, ps, is_file):
    got = {r.path: (r.is_file, r.n_files) for r in paths.directory_rollup(files(spark, *ps)).collect()}
    assert got == {"/a": (False, 2), "/a/b": (is_file, 2), "/a/b/c": (True, 1)}


# nodes


BAGS = [
    ("n1", {"kind": "FunctionDecl", "name": "main", "type": "int ()", "isStatic": "true"}),
    ("n2", {"kind": "VarDecl", "name": "remainder", "type": "std::string", "value": ""}),
    ("n3", {"kind": "CallExpr", "declName": "", "memberName": "size", "templateArgs": "", "isLValue": "true", "value": "3"}),
]


@pytest.fixture(scope="module")
def bagged(spark):
    return spark.createDataFrame([("t", i, m) for i, m in BAGS], "tu string, node_id string, props map<string,string>")


@pytest.mark.parametrize("expr, want", [("name:main", ["n1"]), ("main", ["n1", "n2"]), ("MAIN", ["n1", "n2"]), ("name:main|remainder", ["n1", "n2"]), ("templateArgs:", ["n3"]), ("templateArgs:x", []), ("value:", ["n2", "n3"]), ("decl kind:.*Decl", ["n1", "n2"]), ("zz kind:.*", []), ("name:", ["n1", "n2"]), ("type:std::string", [])])
def test_search(bagged, expr, want):
    assert sorted(r.node_id for r in nodes.search_nodes(bagged, expr).collect()) == want


def test_search_terms_and_bad_pattern(bagged):
    assert nodes.parse_search("type:std::string") == [("type", ""), ("std", ":string")]
    with pytest.raises(ValueError):
        nodes.search_nodes(bagged, "name:(")


def test_label(bagged):
    got = {r.node_id: r.label for r in nodes.node_label(bagged).collect()}
    assert got == {"n1": "FunctionDecl [main] : int () {static}", "n2": "VarDecl [remainder] : std::string", "n3": "CallExpr [size] vc=lvalue = 3"}


def test_label_is_compiled_and_keeps_odd_values(spark):
    """The JVM compiles no method of more than 8,000 bytes; and absent, empty and null properties leave no piece."""
    rows = [
        ("a", {"kind": "K", "name": "", "declName": "d", "spelledType": "s", "canonicalType": "s", "desugaredType": "z"}, ["x", "y"]),
        ("b", {"type": "t", "canonicalType": "c", "isVirtual": "true", "isPure": "true", "isStatic": "false", "isXValue": "true", "isValueDependent": "true", "value": "v  "}, None),
        ("c", {"kind": "K", "name": None, "memberName": "m", "canonicalType": "c", "value": "  "}, []),
        ("d", {}, None),
        ("e", None, ["x"]),
    ]
    bags = spark.createDataFrame(rows, "node_id string, props map<string,string>, template_args array<string>")
    got = {r.node_id: r.label for r in nodes.node_label(bags).collect()}
    assert got == {"a": "K [d] : s desug: z <x, y>", "b": " : t canon: c {virtual pure} vc=xvalue dep = v", "c": "K [m] canon: c =", "d": "", "e": " <x>"}
    held, adaptive = io.StringIO(), "spark.sql.adaptive.enabled"
    plain = bags.drop("template_args").repartition(2)
    spark.conf.set(adaptive, "false")
    try:
        with contextlib.redirect_stdout(held):
            nodes.node_label(plain).explain("codegen")
    finally:
        spark.conf.unset(adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", held.getvalue())]
    assert sizes and max(sizes) < 8000


BAG = '{"kind":"FunctionDecl","name":"f","numParams":2,"isConst":true,"params":[{"name":"a","type":"int"},{"name":"b","type":"char"}],"bases":[{"type":"B","isVirtual":false,"accessSpecifier":"public"}],"templateArgs":[{"kindName":"Type","value":"int"},{"pack":[{"value":"x"},{"pack":[{"value":"y"}]}]},{"pack":[]}],"nodePtr":255,"macroSpellingRange":{"begin":{"fileId":1,"line":2,"column":3},"end":{"fileId":1,"line":2,"column":9}},"size":1.5,"none":null}'


def test_typed_and_exploded_bags(spark):
    n = spark.createDataFrame([("t", "n", "FunctionDecl", BAG), ("t", "m", "VarDecl", '{"initStyle":1,"macroSpellingRange":{"begin":{"fileId":1.5,"line":2,"column":3},"end":{"fileId":1,"line":0,"column":9}}}')], "tu string, node_id string, kind string, j string").withColumn("bag", F.parse_json("j"))
    kinds = spark.createDataFrame([("t", "a", "CompoundAssignOperator", '{"opcode":"+=","isCompound":true}'), ("t", "b", "PointerType", '{"canonicalType":"int *"}'), ("t", "c", "PointerType", '{"hasLocalRange":true}'), ("t", "d", "ImplicitCastExpr", '{"castKind":"NoOp"}'), ("t", "e", "TypeAliasDecl", '{"name":"u","linkage":6}')], "tu string, node_id string, kind string, bag string").withColumn("bag", F.parse_json("bag"))
    seen = {family: [r.node_id for r in nodes.typed_view(kinds, family).collect()] for family in ("BinaryOperator", "Type", "TypeLoc", "CastExpr", "TypedefNameDecl", "Expr", "Decl")}
    assert seen == {"BinaryOperator": ["a"], "Type": ["b"], "TypeLoc": ["c"], "CastExpr": ["d"], "TypedefNameDecl": ["e"], "Expr": ["a", "d"], "Decl": ["e"]}
    assert nodes.typed_view(kinds, "Decl").first().linkageName == "External"
    f = nodes.typed_view(n, "FunctionDecl").first()
    assert (f.name, f.numParams, f.isConst, f.isVirtual) == ("f", 2, True, None)
    assert nodes.typed_view(n, "VarDecl").first().initStyleName == "CallInit"
    assert [(r.pos, r["name"], r["type"]) for r in nodes.explode_params(n).orderBy("pos").collect()] == [(0, "a", "int"), (1, "b", "char")]
    assert [(r["type"], r.isVirtual) for r in nodes.explode_bases(n).collect()] == [("B", False)]
    assert sorted((r.path, r.value) for r in nodes.explode_template_args(n).collect()) == [([0], "int"), ([1, 0], "x"), ([1, 1, 0], "y"), ([2], None)]
    assert [r.node_id for r in nodes.macro_spelling_range(n).collect()] == ["n"]
    flat = {r.path: r.value for r in nodes.flatten_properties(n.where("node_id = 'n'"), ["tu", "node_id"]).collect()}
    assert flat["nodePtr"] == "0xff" and flat["params"] == "[2 items]" and flat["params.[0]"] == "(object)" and flat["params.[1].name"] == "b" and flat["size"] == "1.5" and flat["none"] == "null" and flat["isConst"] == "true"


def test_template_args_read_each_bag_once(spark):
    """Packs in packs, an empty one and one of 1,000; no bag is made twice."""
    made, many = spark.sparkContext.accumulator(0), ",".join(["{}"] * 1000)

    @F.udf("string")
    def bag(i):
        made.add(1)
        return f'{{"templateArgs":[{{"pack":[{{"pack":[{{"kindName":"K","value":"{i}"}}]}},{{"pack":[]}}]}},{{"kindName":"Pack","pack":[{many}]}},{{"pack":7}}]}}'

    n = spark.range(20).repartition(2).select(F.lit("t").alias("tu"), F.col("id").alias("node_id"), F.parse_json(bag("id")).alias("bag"))
    got = nodes.explode_template_args(n).collect()
    want = [(i, p, k, v) for i in range(20) for p, k, v in (([0, 0, 0], "K", str(i)), ([0, 1], None, None), ([1], "Pack", None), ([2], None, None))]
    assert sorted((r.node_id, r.path, r.kindName, r.value) for r in got) == want and made.value == 20


def test_categories_and_keywords_are_fixed(spark):
    assert len(nodes.CATEGORIES) == 14 and len(set(text.KEYWORDS)) == 68 and not {"and", "co_await", "typeid"} & set(text.KEYWORDS)
    kinds = ["CXXMethodDecl", "CallExpr", "IfStmt", "PointerType", "Attr", "ConceptReference", "CXXBaseSpecifier", "CXXCtorInitializer", "LambdaCapture", "NestedNameSpecifier", "NestedNameSpecifierLoc", "TemplateArgument", "TemplateArgumentLoc", "TemplateName"]
    rows = [("t", k, place, {"comment": "c"} if k == "IfStmt" else {}) for k in kinds for place in (None, 1)]
    s = nodes.extraction_stats(spark.createDataFrame(rows, "tu string, kind string, begin_file long, props map<string,string>")).first().asDict()
    assert s["total"] == len(rows) == sum(s[f"n_{c}"] for c in nodes.CATEGORIES) and s["n_comments"] == 2
    assert s["n_stmt"] == 4 and s["n_type"] == s["n_typeLoc"] == 1 and all(s[f"n_{c}"] == 2 for c in nodes.CATEGORIES if c not in ("stmt", "type", "typeLoc"))


def test_statistics(spark, bagged):
    n = bagged.withColumn("kind", F.col("props")["kind"])
    s = nodes.extraction_stats(n, ["FunctionDecl", "VarDecl"], F.col("kind")).first()
    assert s.total == s.n_FunctionDecl + s.n_VarDecl == 2
    strings = spark.createDataFrame([("a",), ("a",), ("bb",), (None,)], "v string")
    p = nodes.string_pool_stats(strings, "v").first()
    assert (p.unique_strings, p.references, p.shared_bytes, p.unshared_bytes) == (2, 3, 67, 100)


def test_sketches_of_chunks_unite_to_that_of_the_whole(spark):
    strings = spark.range(60_000).selectExpr("id % 9 chunk", "repeat(concat('s', id % 20000), cast(1 + id % 20000 % 150 as int)) v").union(spark.createDataFrame([(3, None), (3, "")], "chunk long, v string"))
    exact = nodes.string_pool_stats(strings, "v").first()
    whole = nodes.string_pool_estimate(nodes.string_pool_sketches(strings, "v", []), []).first()
    united = nodes.string_pool_estimate(nodes.string_pool_sketches(strings, "v", ["chunk"]), []).first()
    for guess in (whole, united):  # a sketch made by union reads a little differently
        assert (guess.references, guess.unshared_bytes) == (exact.references, exact.unshared_bytes)
        assert abs(guess.unique_strings - exact.unique_strings) < 0.02 * exact.unique_strings and abs(guess.shared_bytes - exact.shared_bytes) < 0.02 * exact.shared_bytes
    by_chunk = nodes.string_pool_estimate(nodes.string_pool_sketches(strings, "v", ["chunk"]), ["chunk"])
    assert by_chunk.count() == 9 and by_chunk.agg(F.sum("references")).first()[0] == exact.references


# positions


def test_positions_equal_theta_join(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        a, b = sorted((rng.randint(1, 60), rng.randint(1, 30)) for _ in range(2))
        rows.append(("t", f"n{i}", rng.choice([1, 2, None]), *a, *b, rng.randint(0, 5), i))
    rows.append(("t", "back", 1, 9, 9, 3, 3, 0, 999))
    n = spark.createDataFrame(rows, "tu string, node_id string, begin_file long, begin_line long, begin_col long, end_line long, end_col long, depth long, pre long")
    pts = [(i, "t", rng.choice([1, 2, 3]), rng.randint(1, 60), rng.randint(1, 30)) for i in range(200)]
    p = spark.createDataFrame(pts, "point_id long, tu string, file long, line long, col long")
    want = {(i, r[1]) for i, _, f, l, k in pts for r in rows if r[2] == f and (r[3], r[4]) <= (l, k) <= (r[5], r[6])}
    joined = positions.nodes_at(p, n)
    assert {(r.point_id, r.node_id) for r in joined.collect()} == want
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    size = lambda r: (r[5] - r[3], r[6] - r[4] if r[5] == r[3] else 0, -r[7], r[8])
    best = {i: min((r for r in rows if (i, r[1]) in want), key=size)[1] for i in {i for i, _ in want}}
    assert {r.point_id: r.node_id for r in positions.most_specific(p, n).collect()} == best
    rg = [(i, "t", f, *a, *b) for i, (f, a, b) in enumerate((rng.choice([1, 2]), *sorted((rng.randint(1, 60), rng.randint(1, 30)) for _ in range(2))) for _ in range(60))]
    ranges = spark.createDataFrame(rg, "range_id long, tu string, file long, from_line long, from_col long, to_line long, to_col long")
    first = {}
    for i, _, f, *ab in rg:
        inside = [r for r in rows if r[2] == f and (r[3], r[4]) >= tuple(ab[:2]) and (r[5], r[6]) <= tuple(ab[2:]) and (r[5], r[6]) >= (r[3], r[4])]
        if inside:
            first[i] = min(inside, key=lambda r: (r[3], r[4], r[8]))[1]
    assert {r.range_id: r.node_id for r in positions.first_contained(ranges, n).collect()} == first


def test_a_stored_index_gives_the_same_without_moving_nodes(spark, tmp_path):
    nodes_in = spark.range(4000).selectExpr("id % 7 tu", "id % 7 begin_file", "concat('n', id) node_id", "id pre", "id % 5 depth", "1 + id % 50 begin_line", "1 + id % 9 begin_col", "1 + id % 50 + id % 13 end_line", "5L end_col")
    p = spark.range(300).selectExpr("id point_id", "id % 7 tu", "id % 7 file", "1 + id % 60 line", "1 + id % 8 col")
    path = str(tmp_path / "index")
    index = positions.write_position_index(nodes_in, path, buckets=3)
    same = lambda df: sorted(map(tuple, df.collect()))
    want = same(positions.nodes_at(p, nodes_in).select("point_id", "node_id"))
    assert same(positions.nodes_at(p, index).select("point_id", "node_id")) == want and len(want) > 1000
    assert same(positions.most_specific(p, index)) == same(positions.most_specific(p, nodes_in))
    again = positions.open_position_index(spark, path)
    assert again.levels == index.levels and same(positions.nodes_at(p, again).select("point_id", "node_id")) == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = positions.nodes_at(p, index)._jdf.queryExecution().executedPlan().toString()
        some = index.only([2, 3]).table
        pruned = some._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan
    assert "PushedFilters" in pruned and "In(tu" in pruned
    assert same(positions.nodes_at(p, index.only([2, 3])).select("point_id", "node_id")) == [x for x in want if x[0] % 7 in (2, 3)]


def test_highlight_and_paths(spark):
    lines = text.source_lines(spark.createDataFrame([(1, "abc\ndef\nghi\n")], "f long, t string"), "f", "t")
    assert lines.count() == 3
    r = spark.createDataFrame([(1, 1, 1, 2, 1, 3), (2, 1, 1, 3, 3, 2), (3, 1, 3, 1, 4, 1)], "range_id long, file long, begin_line int, begin_col int, end_line int, end_col int")
    assert {x.range_id: x.text for x in positions.highlight_text(r, lines).collect()} == {1: "b", 2: "c\ndef\ng"}
    n = spark.createDataFrame([("a", 1), ("b", 7), ("c", None)], "node_id string, begin_file long")
    named = positions.with_file_path(n, spark.createDataFrame([(1, "/x.c")], "file_id long, path string"))
    assert {r.node_id: r.path for r in named.collect()} == {"a": "/x.c", "b": "", "c": ""}


# command lines


def fold(line, blanks, escape_in_single, keep_end):
    """The rules as one walk over the characters; words with None where nothing but empty quotes made them up is not told apart."""
    words, word, quote, i = [], None, "", 0
    while i < len(line):
        c = line[i]
        if c == "\\" and (quote != "'" or escape_in_single):
            word = word or ""
            if i + 1 < len(line):
                word += line[i + 1]
            elif keep_end:
                word += c
            i += 2
            continue
        if quote:
            quote, word = ("", word) if c == quote else (quote, word + c)
        elif c in "\"'":
            quote, word = c, word or ""
        elif c in blanks:
            words += [] if word is None else [word]
            word = None
        else:
            word = (word or "") + c
        i += 1
    return words + ([] if word is None else [word])


CASES = ["", " ", "a", " a  b ", "a\tb\nc", "'a b'", '"a b"', "a'b c'd", 'a"b c"d', "''", '""', "a ''b", "'' ''", '"" x', "a\\ b", "\\'a b\\'", '"a\\"b"', "'a\\'b'", "'a\\\\'", '"a\\\\"', "'a\"b'", "\"a'b\"", "'open", '"open', "a\\", '"a\\', "'a\\", "x'", 'x"', "-DX='a \"b\"' -I\"c d\"/e", "\\\\ \\a", "a\r\nb", "é'ü ß'"]


def test_words_of_command_lines(spark):
    rng = random.Random(6)
    lines = CASES + ["".join(rng.choice("ab'\"\\ \n") for _ in range(rng.randint(1, 14))) for _ in range(600)] + ["'" + "x " * 60_000 + "'", '"' + "\\y" * 900 + '" z']
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string").repartition(2)
    got = {r.i: (r.c, r.r) for r in df.select("i", commands.split_command(F.col("line")).alias("c"), commands.split_response(F.col("line")).alias("r")).collect()}
    for i, line in enumerate(lines):
        assert got[i][0] == fold(line, " ", False, False), line[:50]
        assert got[i][1] == [w for w in fold(line, " \t\r\n", True, True) if w], line[:50]


# trees


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("t", "a", None, 0), ("t", "b", "a", 0), ("t", "c", "a", 1), ("t", "d", "b", 0), ("t", "e", "b", 1), ("t", "lost", "gone", 0), ("u", "a", None, 0), ("t", "x", "y", 0), ("t", "y", "x", 0)]
    return spark.createDataFrame(rows, "tu string, node_id string, parent_id string, ordinal long")


def test_depth_and_paths(tree):
    depth = {(r.tu, r.node_id): r.depth for r in trees.node_depth(tree).collect()}
    assert depth == {("t", "a"): 0, ("t", "b"): 1, ("t", "c"): 1, ("t", "d"): 2, ("t", "e"): 2, ("t", "lost"): None, ("u", "a"): 0, ("t", "x"): None, ("t", "y"): None}
    got = {(r.tu, r.node_id): r.path for r in trees.path_to_root(tree).collect()}
    assert got[("t", "e")] == ["a", "b", "e"] and ("t", "lost") not in got and len(got) == 6


def test_labels_and_subtrees(tree):
    t = trees.label_tree(tree.where("node_id not in ('lost', 'x', 'y')"))
    got = {(r.tu, r.node_id): (r.pre, r.post, r.size, r.depth) for r in t.collect()}
    assert got[("t", "a")] == (0, 4, 5, 0) and got[("t", "e")] == (3, 3, 1, 2) and got[("t", "c")] == (4, 4, 1, 1)
    roots = t.where("node_id in ('a', 'b')").selectExpr("concat(tu, node_id) root_id", "tu", "node_id")
    sub = sorted((r.root_id, r.node_id) for r in trees.subtree(t, roots).collect())
    assert sub == [("ta", n) for n in "abcde"] + [("tb", n) for n in "bde"] + [("ua", "a")]
    sizes = {(r.tu, r.node_id): r.n_below for r in trees.subtree_size(t).collect()}
    assert sizes[("t", "b")] == 2 and {r.node_id: r.height for r in trees.height(t.where("tu = 't'")).collect()}["a"] == 2
    assert {r.node_id: r.row for r in nodes.child_ordinals(t).where("tu = 't'").collect()} == {"a": 0, "b": 0, "c": 1, "d": 0, "e": 1}


def test_deep_chains(spark):
    n = spark.range(3000).selectExpr("cast(id div 1000 as string) tu", "cast(id % 1000 as string) node_id", "if(id % 1000 = 0, null, cast(id % 1000 - 1 as string)) parent_id", "0L ordinal")
    t = trees.label_tree(n)
    assert t.agg(F.max("depth"), F.max("size"), F.max("pre")).first() == (999, 1000, 999)
    assert t.where("depth <> pre or size <> 1000 - depth").count() == 0
    assert trees.node_depth(n).agg(F.max("depth")).first()[0] == 999


def test_cycles_come_to_an_end(spark):
    n = spark.createDataFrame([("t", "a", None, 0), ("t", "b", "a", 0), ("t", "x", "y", 0), ("t", "y", "x", 0), ("t", "z", "z", 0)], "tu string, node_id string, parent_id string, ordinal long")
    for f in (trees.label_tree, trees.height):
        with pytest.raises(ValueError, match="cycle"):
            f(n)
    assert {r.node_id: r.path for r in trees.path_to_root(n).collect()} == {"a": ["a"], "b": ["a", "b"]}
    decls = n.selectExpr("tu", "node_id", "'NamespaceDecl' kind", "node_id name", "ordinal pre", "true is_decl", "true is_context", "parent_id semantic_parent")
    with pytest.raises(Exception, match="cycle"):
        trees.context_chain(decls).collect()


def test_matches_of_tus_cycle(spark):
    rows = [(f"t{i % 2}", f"n{i}", i) for i in range(25)] + [("alone", "n", 0)]
    got = {(r.tu, r.node_id): (r.i, r.n, r.next_id, r.previous_id) for r in nodes.match_cycle(spark.createDataFrame(rows, "tu string, node_id string, pre long")).collect()}
    assert got[("t0", "n0")] == (1, 13, "n2", "n24") and got[("t0", "n24")] == (13, 13, "n0", "n22") and got[("t1", "n3")] == (2, 12, "n5", "n1") and got[("alone", "n")] == (1, 1, "n", "n") and len(got) == 26


def test_context_chain(spark):
    rows = [("t", "tu", "TranslationUnitDecl", None, 0, True, True, None), ("t", "ns", "NamespaceDecl", "n", 1, True, True, "tu"), ("t", "late", "CXXRecordDecl", "L", 9, True, True, "ns"), ("t", "m", "CXXMethodDecl", "f", 5, True, True, "late"), ("t", "s", "ReturnStmt", None, 6, False, False, "m")]
    d = spark.createDataFrame(rows, "tu string, node_id string, kind string, name string, pre long, is_decl boolean, is_context boolean, semantic_parent string")
    chains = trees.context_chain(d)
    got = {r.node_id: r.chain and [(e.kind, e.node_id) for e in r.chain] for r in chains.collect()}
    assert got["m"] == [("TranslationUnitDecl", "tu"), ("NamespaceDecl", "ns"), ("CXXRecordDecl", None), ("CXXMethodDecl", "m")] and got["s"] is None
    assert {r.context_group: r.n for r in trees.contexts_of_kind(chains).collect()} == {"TranslationUnit": 4, "Namespace": 3, "Record": 2, "Function": 1}


# text


def test_find(spark):
    lines = spark.createDataFrame([(1, 1, "aAa aaa."), (1, 2, "none"), (1, 3, r"a\Qx.*aa")], "file long, line_no int, line string")
    assert sorted((r.line_no, r.col) for r in text.find_text(lines, "AA").collect()) == [(1, 1), (1, 5), (3, 7)]
    assert [(r.line_no, r.col) for r in text.find_text(lines, "x.*").collect()] == [(3, 4)]
    assert text.find_text(lines, "  ").count() == 0
    hits = text.find_text(lines, "aa")
    cur = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 2), (3, 1, 4, 1)], "cursor_id long, file long, line int, col int")
    assert {r.cursor_id: (r.line_no, r.col, r.wrapped) for r in text.find_next(cur, hits).collect()} == {1: (1, 1, False), 2: (1, 5, False), 3: (1, 1, True)}
    assert {r.cursor_id: (r.line_no, r.col, r.wrapped) for r in text.find_next(cur, hits, True).collect()} == {1: (3, 7, True), 2: (1, 1, False), 3: (3, 7, False)}


def test_many_hits_in_a_line(spark):
    """16,000 hits in one line, and letters whose lower case is longer."""
    lines = spark.createDataFrame([(1, 1, "ab" * 16_000), (1, 2, "\u0130x AB ab"), (1, 3, "é" * 3 + "AB")], "file long, line_no int, line string")
    got = [(r.line_no, r.col) for r in text.find_text(lines, "aB").orderBy("line_no", "col").collect()]
    assert got == [(1, 1 + 2 * k) for k in range(16_000)] + [(2, 4), (2, 7), (3, 4)]


def test_comments(spark):
    p = [(1, 1, "Adds", False), (1, 2, "two.", True), (1, 3, " More", True), (1, 4, "", True), (1, 5, "end\n", True)]
    assert text.comment_text(spark.createDataFrame(p, "comment_id long, seq long, text string, ends_paragraph boolean")).first().text == "Adds two.\n More\nend\n"


def test_tokens(spark):
    code = '#include <x>\n// if (a) while\nint main() { /* for\nfoo( */ return f("if (\\"x\\")", \'"\'); }\n  # define X "s"\nclass A; // "y'
    r = text.token_profile(spark.createDataFrame([(1, code)], "f long, t string"), "f", "t").first()
    assert (r.n_keyword, r.n_function, r.n_preprocessor, r.n_literal, r.n_comment) == (3, 2, 2, 3, 3)


# logs and history


def test_parse_lines(spark):
    raw = ["@diag\terror\ta.c\t3\t4\tmsg\tmore", "@diag\tnote\t\t\t\tonly", "@diag\twarn\tshort", "@diag\terror\ta.c\t3\t4\t", "@diag\tx", "  plain error: x ", "", "@diag\tremark\ta.c\t\t7\tm"]
    got = [(r.level, r.message) for r in logs.parse_lines(spark.createDataFrame([(i, x, False) for i, x in enumerate(raw)], "i long, line string, is_stderr boolean")).orderBy("i").collect()]
    assert got == [("Error", "a.c:3:4: msg\tmore"), ("Debug", "only"), ("Warning", "short"), ("Error", "a.c\t3\t4"), ("Info", "@diag\tx"), ("Error", "plain error: x"), ("Debug", "a.c:7: m")]


def test_history(spark):
    h = history.History(cap=3)
    for step in [(0, (1, 1, 1, 1, 1)), (0, (1, 1, 1, 1, 1)), (0, (2, 1, 1, 1, 1)), (-1, None), (-5, None), (0, (3, 1, 1, 1, 1)), (0, (0, 1, 1, 1, 1)), (0, (4, 1, 1, 1, 1)), (0, (5, 1, 1, 1, 1))]:
        h.apply(*step)
    assert [e[0] for e in h.entries] == [3, 4, 5] and h.cursor == 2
    rows = [(s, i, d, f, 1, 1, 1, 1) for s in (1, 2) for i, (d, f) in enumerate([(0, 1), (0, 2), (-1, 0), (0, 3), (0, 3), (-1, 0)])]
    e = spark.createDataFrame(rows, "session long, seq long, delta long, file long, line long, col long, node long, version long")
    got = sorted((r.session, r.pos, r.file, r.is_current) for r in history.nav_history_replay(e).collect())
    assert got == [(s, p, f, cur) for s in (1, 2) for p, f, cur in ((1, 1, True), (2, 3, False))]


# commands


def test_flags(spark):
    rows = [("p", 1, "/w", ["cc", "-resource-dir", "X", "a.c", "-resource-dir=Y", "--sysroot=/s"], "a.c"), ("p", 2, "/w", ["-fmodule-file=m=a.pcm", "-fmodule-file=m=../b.pcm", "-fmodule-file=bad", "-fmodule-file=n=/n.pcm"], "b.c"), ("p", 3, "/w", ["-fmodule-file=m=late.pcm"], "b.c"), ("p", 4, "/w", ["cc", "@r1", "@none", "x"], "c.c")]
    cmds = spark.createDataFrame(rows, "project string, cmd_seq long, directory string, arguments array<string>, file string")
    got = {r.cmd_seq: r.arguments for r in commands.normalize_flags(cmds, "/R").collect()}
    assert got[1] == ["cc", "a.c", "--sysroot=/s", "-resource-dir", "/R"]
    assert sorted((r.name, r.path) for r in commands.module_map(cmds).collect()) == [("m", "/b.pcm"), ("n", "/n.pcm")]
    own = spark.createDataFrame([("/w/r1", "-a @r2"), ("/w/r2", "-b @r1"), ("/w/none", "@none x")], "path string, text string")
    assert {r.cmd_seq: r.arguments for r in commands.expand_response_files(cmds, own).collect()}[4] == ["cc", "-a", "-b", "@r1", "@none", "x", "x"]
    rsp = spark.createDataFrame([("/w/r1", "-I inc \"-DX=a b\" @r2"), ("/w/r2", "-O2\n'q q'")], "path string, text string")
    assert {r.cmd_seq: r.arguments for r in commands.expand_response_files(cmds, rsp).collect()}[4] == ["cc", "-I", "inc", "-DX=a b", "-O2", "q q", "@none", "x"]


def test_reverse_dependents_keep_no_set_of_units(spark):
    from treescan.operators import includes

    rows = [("a", "h", True, "C_User", 1), ("a", "h", False, "C_User", 2), ("b", "h", False, "C_User", 1), ("b", "g", None, "C_User", 2)]
    headers = includes.dedupe_headers(spark.createDataFrame(rows, "tu string, header string, direct boolean, inclusion_kind string, seq long"))
    found = includes.reverse_dependents(headers)
    assert sorted(map(tuple, found.collect())) == [("g", 1, 0), ("h", 2, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan.lower()


def test_heights_take_leaves_off_first(spark, monkeypatch):
    rows = [("t", "r", None)] + [("t", f"c{i}", "r") for i in range(5)] + [("t", f"l{i}", f"c{i % 4}") for i in range(40)] + [("t", "x", "l0"), ("t", "lost", "gone")]
    t = spark.createDataFrame(rows, "tu string, node_id string, parent_id string")
    left, whole = [], trees._gathered_up
    monkeypatch.setattr(trees, "FEW", 2)
    monkeypatch.setattr(trees, "_gathered_up", lambda nodes, *a: left.append(nodes.count()) or whole(nodes, *a))
    got = {r.node_id: r.height for r in trees.height(t).collect()}
    assert got == {"r": 3, "x": 0, "lost": 0, **{f"c{i}": 2 if i == 0 else int(i < 4) for i in range(5)}, **{f"l{i}": int(i == 0) for i in range(40)}}
    assert left and left[0] <= 6


def test_a_position_is_looked_up_once(spark, monkeypatch):
    n = spark.createDataFrame([("t", "a", "f", 1, 1, 9, 1, 0, 0), ("t", "b", "f", 2, 1, 3, 1, 1, 1)], "tu string, node_id string, begin_file string, begin_line long, begin_col long, end_line long, end_col long, depth int, pre long")
    p = spark.range(1000).select(F.col("id").alias("point_id"), F.lit("t").alias("tu"), F.lit("f").alias("file"), (1 + F.col("id") % 2).alias("line"), F.lit(5).cast("long").alias("col"))
    asked, whole = [], positions.nodes_at
    monkeypatch.setattr(positions, "nodes_at", lambda points, nodes: asked.append(points.count()) or whole(points, nodes))
    got = {r.point_id: r.node_id for r in positions.most_specific(p, n).collect()}
    assert got == {i: "ab"[i % 2] for i in range(1000)} and asked == [2]


def test_only_response_files_leave_their_list(spark, monkeypatch):
    rows = [("p", 1, "/w", [], "a.c"), ("p", 2, "/w", ["cc", "x"], "b.c"), ("p", 3, "/w", ["@r", "cc", "@r", None, "@s"], "c.c")]
    cmds = spark.createDataFrame(rows, "project string, cmd_seq long, directory string, arguments array<string>, file string")
    files = spark.createDataFrame([("/w/r", "-a @s"), ("/w/s", ""), ("/w/none", None)], "path string, text string")
    rounds, whole = [], commands.counted
    monkeypatch.setattr(commands, "counted", lambda df, *a, **k: rounds.append(df.count()) or whole(df, *a, **k))
    got = {r.cmd_seq: r.arguments for r in commands.expand_response_files(cmds, files).collect()}
    assert got == {1: [], 2: ["cc", "x"], 3: ["-a", "cc", "-a", None]} and rounds == [1, 1]
