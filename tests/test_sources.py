"""Sources and sinks: round trips and bad documents."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from treescan.operators import logs
from treescan.sources import documents as d


def test_compile_commands(spark, tmp_path):
    good = tmp_path / "cc.json"
    good.write_text(json.dumps([{"directory": "/w", "command": "cc -I'a b' x.c", "file": "x.c"}, {"directory": "/w", "arguments": ["cc", "y.c"], "file": "y.c"}, {"directory": "/w", "command": "again", "file": "x.c"}]))
    got = {r.file: r.arguments for r in d.read_compile_commands(spark, str(good), "p").collect()}
    assert got == {"x.c": ["cc", "-Ia b", "x.c"], "y.c": ["cc", "y.c"]}
    for text in ("[]", "{broken"):
        bad = tmp_path / f"bad{len(text)}.json"
        bad.write_text(text)
        with pytest.raises(ValueError):
            d.read_compile_commands(spark, str(bad), "p")


def test_dependencies_round_trip(spark, tmp_path):
    tus = spark.createDataFrame([("p", "/b.cpp"), ("p", "/a.cpp"), ("q", "/c.cpp")], "project string, tu string")
    headers = spark.createDataFrame([("/a.cpp", 0, "h1", True, "C_User"), ("/a.cpp", 1, "h2", False, "C_System"), ("/c.cpp", 0, "h3", True, "C_User")], "tu string, seq long, header string, direct boolean, inclusion_kind string")
    errors = spark.createDataFrame([("/b.cpp", 2, "later"), ("/b.cpp", 1, "first")], "tu string, err_seq long, message string")
    out = str(tmp_path / "deps")
    d.write_dependencies(tus, headers, errors, tus, out)
    h, e, s = d.read_dependencies(spark, f"{out}/project=*")
    assert sorted(map(tuple, h.collect())) == sorted(map(tuple, headers.collect()))
    assert sorted(r.message for r in e.collect()) == ["first", "later"]
    assert sorted((r.total_count, r.success_count, r.failure_count, r.total_header_count) for r in s.collect()) == [(1, 1, 0, 1), (2, 2, 2, 2)]
    doc = json.loads(next(iter((tmp_path / "deps" / "project=p").glob("*.txt"))).read_text())
    assert [f["path"] for f in doc["files"]] == ["/a.cpp", "/b.cpp"] and doc["files"][1]["error"] == "first" and doc["files"][1]["partialData"] is True
    assert "errors" not in json.loads(next(iter((tmp_path / "deps" / "project=q").glob("*.txt"))).read_text())


def nest(depth):
    inner = []
    for k in range(depth):
        inner = [{"properties": {"kind": f"K{k}"}, "sourceRange": {"begin": {"valid": False}, "end": {"valid": False}}, "children": inner}]
    return json.dumps(inner[0])


def test_ast_export_round_trip(spark, tmp_path):
    loc = lambda line: {"valid": True, "fileId": 3, "line": line, "column": 1, "filePath": "/x.c"}
    node = lambda kind, line, *kids: {"properties": {"kind": kind, "n": line}, "sourceRange": {"begin": loc(line), "end": loc(line + 1)}, "children": list(kids)}
    doc = node("A", 1, node("B", 2, node("C", 3)), node("D", 4))
    doc["children"][1]["sourceRange"] = {"begin": {"valid": False}, "end": {"valid": False}}
    rows = [("t", json.dumps(doc)), ("bad", "{no"), ("none", None), ("ok", nest(20))]
    nodes, rejects = d.read_ast_export(spark.createDataFrame(rows, "tu string, value string"))
    assert {(r.tu, r.reason) for r in rejects.collect()} == {("none", "not JSON"), ("bad", "not JSON")}
    got = {r.node_id: (r.parent_id, r.ordinal, r.kind, r.begin_line) for r in nodes.where("tu = 't'").collect()}
    assert got == {"0": (None, 0, "A", 1), "0.0": ("0", 0, "B", 2), "0.0.0": ("0.0", 0, "C", 3), "0.1": ("0", 1, "D", None)}
    assert nodes.where("tu = 'ok'").count() == 20
    again, _ = d.read_ast_export(d.ast_documents(nodes))
    path = str(tmp_path / "exports")
    d.write_ast_export(nodes, path)
    assert sorted(r.tu for r in d.read_ast_documents(spark, path).collect()) == ["ok", "t"]
    from_files, _ = d.read_ast_export(d.read_ast_documents(spark, path))
    flat = lambda n: sorted((r.tu, r.node_id, r.kind, r.begin_file, r.end_line, str(r.begin_path), str(r.bag)) for r in n.select("*").collect())
    assert flat(again) == flat(nodes) == flat(from_files)


def test_a_chain_of_a_thousand_round_trips(spark, tmp_path):
    rows = [("deep", nest(1000)), ("half", nest(500))]
    nodes, rejects = d.read_ast_export(spark.createDataFrame(rows, "tu string, value string"), paths=False)
    assert rejects.isEmpty() and nodes.groupBy("tu").count().where("(tu = 'deep' and count = 1000) or count = 500").count() == 2
    d.write_ast_export(nodes, str(tmp_path / "exports"))
    back = {r.tu: r.value for r in d.read_ast_documents(spark, str(tmp_path / "exports")).collect()}
    assert back == {tu: value.replace(" ", "") for tu, value in rows}
    d.write_ast_files(nodes, str(tmp_path / "files"))
    for tu, value in rows:
        parts = sorted((tmp_path / "files" / f"tu={tu}").glob("part-*"))
        assert "".join(p.read_text() for p in parts).replace("\n", "") == value.replace(" ", "")
    again, _ = d.read_ast_export(spark.createDataFrame(list(back.items()), "tu string, value string"), paths=False)
    assert again.agg(F.max("depth")).first()[0] == 999 and again.count() == 1500


def test_documents_are_read_with_keys_in_any_order_or_refused(spark):
    fine = {
        "order": ('{ "children" : [ {"children":[],"properties":{"kind":"B"}} , {"properties":{"kind":"C"},"x":[{}]} ] , "properties" : {"kind":"A"} }', [("0", "A"), ("0.0", "B"), ("0.1", "C")]),
        "odd": ('{"children":[7,"a,]}",null,{}],"properties":{"kind":"A","s":"}]\\""}}', [("0", "A"), ("0.0", None), ("0.1", None), ("0.2", None), ("0.3", None)]),
        "value": ("[1, 2]", [("0", None)]),
        "none": ('{"children":{"a":1}}', [("0", None)]),
    }
    bad = ["", " ", "{", "{}{}", '{"children":[}', '{"children":[{}', '{"children":[{}}', '{"a":1,}', '{"a" 1}', '{"children":[{},]}', '{"properties":NaN}', "{'a':1}", '{"children":[{}]', "{1:2}"]
    rows = [(k, v[0]) for k, v in fine.items()] + [(f"bad{i}", t) for i, t in enumerate(bad)]
    nodes, rejects = d.read_ast_export(spark.createDataFrame(rows, "tu string, value string"))
    assert sorted(r.tu for r in rejects.collect()) == sorted(f"bad{i}" for i in range(len(bad)))
    got = {}
    for r in nodes.collect():
        got.setdefault(r.tu, []).append((r.node_id, r.kind))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: v[1] for k, v in fine.items()}


def test_flat_nodes(spark, tmp_path):
    nodes, _ = d.read_ast_export(spark.createDataFrame([("t", nest(5))], "tu string, value string"))
    path = str(tmp_path / "flat")
    d.write_flat_nodes(nodes, path)
    schema = nodes.withColumn("bag", F.to_json("bag")).schema
    assert d.read_flat_nodes(spark, path, schema).count() == 5


def test_project_tables_are_written_once(spark, tmp_path):
    root = str(tmp_path / "tables")
    put = lambda n, path, created, commit: d.write_project_tables(spark.range(n), root, path, "/b", created, commit)
    with ThreadPoolExecutor(4) as pool:  # two writers of one project, one of them twice, and one of another
        list(pool.map(lambda a: put(*a), [(3, "/p/cc.json", "2024-01-01", "a"), (4, "/p/cc.json", "2024-01-02", "b"), (5, "/q/cc.json", "2024-01-01", "a")]))
    put(4, "/p/cc.json", "2024-01-02", "b")
    spark.range(99).write.parquet(f"{root}/data/_project=p-{'0' * 16}/_commit=c-broken")  # no marker: a writer that failed
    assert sorted((r.path, r.commit, r.created_at) for r in d.read_projects(spark, root).collect()) == [("/p/cc.json", "b", "2024-01-02"), ("/q/cc.json", "a", "2024-01-01")]
    assert sorted(r["count"] for r in d.read_project_tables(spark, root).groupBy("project_key").count().collect()) == [4, 5]


def test_diagnostics_round_trip(spark, tmp_path):
    rows = [("error", "a\tb.c", 3, 0, "bad\nthing"), ("note", "", 0, 0, "")]
    path = str(tmp_path / "log")
    d.write_diagnostics(spark.createDataFrame(rows, "level string, file string, line long, col long, message string"), path)
    got = sorted((r.level, r.message) for r in logs.parse_lines(d.read_diagnostics(spark, path)).collect())
    # the second line loses its blank fields when it is trimmed, so it isn't structured any more
    assert got == [("Debug", "@diag\tnote"), ("Error", "a b.c:3: bad thing")]


def test_small_documents_share_batches_and_a_large_one_is_streamed(monkeypatch):
    """Many small documents come as few batches; the nodes of a large one come as they are read; a bad one gives no nodes."""
    import pyarrow as pa
    from treescan.sources import nested

    monkeypatch.setattr(nested, "BATCH", 100)
    monkeypatch.setattr(nested, "LARGE", 3000)
    small = '{"properties":{"kind":"A"},"children":[{"sourceRange":{"begin":{}}},{}]}'
    large = '{"properties":{"kind":"R"},"children":[' + ",".join(['{"properties":{"k":1}}'] * 400) + "]}"
    docs = [(f"s{i}", small) for i in range(90)] + [("large", large), ("bad", small[:-1]), ("large bad", large + "x"), ("none", None)]
    batch = pa.RecordBatch.from_pylist([{"tu": tu, "value": v} for tu, v in docs], schema=pa.schema([("tu", pa.string()), ("value", pa.string())]))
    out = list(nested.read_nodes(True)(iter([batch])))
    assert len(out) <= 8 and max(b.num_rows for b in out) <= 100
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["tu"] for r in rows if r["reason"]] == ["bad", "large bad", "none"]
    of = lambda tu: [(r["node_id"], r["parent_id"], r["ordinal"], r["depth"], r["path"], r["bag"], r["range"]) for r in rows if r["tu"] == tu and not r["reason"]]
    assert of("s7") == [("0.0", "0", 0, 1, [0, 0], None, '{"begin":{}}'), ("0.1", "0", 1, 1, [0, 1], None, None), ("0", None, 0, 0, [0], '{"kind":"A"}', None)]
    assert len(of("large")) == 401 and of("large")[399] == ("0.399", "0", 399, 1, [0, 399], '{"k":1}', None) and not of("bad") and not of("large bad")


def test_a_document_in_pieces_is_held_by_windows_only(monkeypatch):
    """Pieces cut anywhere give the nodes of the whole text, a bad end included; a long one is taken as it is read."""
    from itertools import chain

    import pyarrow as pa
    from treescan.sources import nested

    text = ' {"properties":{"kind":"A","s":"é]}\\""},"x":-12.5e+3 , "children":[ {"children":[7,null]} ,{}, {"sourceRange":{"begin":{}},"properties":1.25}] } '
    bad = text.rstrip()[:-1]
    rows = [("t", f"r{k}", piece) for k, t in enumerate((text, bad, text)) for piece in ([t[i : i + 1 + 2 * k] for i in range(0, len(t), 1 + 2 * k)])]
    pieces = pa.RecordBatch.from_pylist([dict(zip(("tu", "root_id", "text"), r, strict=True)) for r in rows])
    want = [r for b in nested.read_nodes(True)(iter([pa.RecordBatch.from_pylist([{"tu": "t", "value": text}])])) for r in b.to_pylist()]
    for window in (1, 9, 1 << 20):
        got = [r for b in nested.read_pieces(True, window)(iter([pieces.slice(0, 50), pieces.slice(50)])) for r in b.to_pylist()]
        of = lambda root: [{k: v for k, v in r.items() if k != "root_id"} for r in got if r["root_id"] == root]  # noqa: E731,B023
        assert of("r0") == of("r2") == want and len(want) == 6
        assert of("r1")[-1] == {**dict.fromkeys(want[0]), "tu": "t", "reason": "not JSON"} and (len(of("r1")) == 1 or window < 1 << 20)
    monkeypatch.setattr(nested, "BATCH", 100)
    taken = 0

    def long():
        nonlocal taken
        for piece in chain(['{"children":['], ["{},"] * 100_000, ["{}]}"]):
            taken += len(piece)
            yield piece

    found = nested.nodes_of(long(), 1000)
    for _ in range(500):
        next(found)
    assert taken < 5000 and sum(1 for _ in found) == 100_002 - 500


def test_a_bad_document_in_pieces_gives_no_nodes(spark):
    """Nodes that came before the fault go; a document of the same tu stays."""
    rows = [("t", "a", 0, '{"children":['), ("t", "a", 1, "{},{}"), ("t", "a", 2, "]}"), ("t", "b", 0, '{"children":['), ("t", "b", 1, "{},{}" * 40), ("t", "b", 2, "]}"), (None, None, 0, "{}")]
    for window in (4, None):
        nodes, rejects = d.read_ast_events(spark.createDataFrame(rows, "tu string, root_id string, pre long, text string"), window=window)
        assert [tuple(r) for r in rejects.collect()] == [("t", "not JSON")]
        assert sorted((r.tu or "", r.node_id) for r in nodes.collect()) == [("", "0"), ("t", "0"), ("t", "0.0"), ("t", "0.1")]


@pytest.mark.parametrize("nodes, characters", [(1 << 18, 1 << 25), (40, 1 << 25), (1 << 18, 1500), (1, 1)])
def test_exports_of_small_and_large_trees(spark, tmp_path, monkeypatch, nodes, characters):
    """Trees that go whole to a task and trees that do not give the same documents, in order, and compressed files."""
    monkeypatch.setattr(d, "NODES", nodes), monkeypatch.setattr(d, "CHARACTERS", characters)
    forest = [(f"t{i % 7}", json.dumps({"properties": {"kind": f"R{i}"}, "sourceRange": {"begin": {"valid": False}, "end": {"valid": False}}, "children": [json.loads(nest(3 + i)) for _ in range(i % 5)]})) for i in range(7)]
    read, _ = d.read_ast_export(spark.createDataFrame(forest, "tu string, value string"))
    path = str(tmp_path / "exports")
    d.write_ast_export(read, path)
    assert {p.suffix for p in (tmp_path / "exports").glob("part-*")} == {".gz"}
    assert {r.tu: r.value for r in d.read_ast_documents(spark, path).collect()} == {tu: v.replace(" ", "") for tu, v in forest}
    back, rejects = d.read_ast_events(d.read_ast_lines(spark, path), window=100)
    flat = lambda n: sorted((r.tu, r.node_id, r.parent_id, r.depth, str(r.bag)) for r in n.collect())
    assert flat(back) == flat(read) and rejects.isEmpty()
