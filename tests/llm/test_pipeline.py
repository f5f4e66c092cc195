"""The pipeline: each stage against brute force on its own input, and the registry without the subpackage."""

import base64
import os
import re
import subprocess
import sys

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from tests.llm.test_corpus import brute_components, brute_deviation
from treescan.llm import mixing, quality_rules
from treescan.llm.common import materialize, table

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def test_stages(spark, steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "byte_level_bpe"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    given, quality, exact, near, mixed, coded = steps
    judged = quality_rules.judge(given, table(spark, SF, "labels"))
    assert {r.doc_id for r in quality.collect()} == {r.doc_id for r in judged.collect() if r.quality.kept}
    first = {}
    for r in quality.collect():
        key = re.sub(rb"[\x20\x09-\x0D]+", b" ", (r.text or "").encode())
        first[key] = min(r.doc_id, first.get(key, r.doc_id))
    assert sorted(r.doc_id for r in exact.collect()) == sorted(first.values())
    comps = brute_components([(r.doc_id, r.text) for r in exact.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, root) in comps.items() if i == root)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, near.collect()))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in coded.collect():
        assert r.ids == enc.encode_ordinary(r.text)
    assert coded.count() == mixed.count()


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in steps[-1].select("doc_id").collect())


def test_order_of_the_mix_survives(spark, monkeypatch):
    """run() over stages that keep all rows of three unequal sources: by position, each prefix has the weights' shares."""
    sizes = {"a": 400, "b": 100, "c": 25}
    rows = [(i, f"text {i}", "en", s, 6) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows))) and {r.doc_id for r in got} == set(range(len(rows)))
    weights = mixing.tempered(sizes)
    assert weights == {"a": 16, "b": 8, "c": 4}
    blocks = {r.slot: r.source for r in got if r.phase == 0}
    order = [blocks[k] for k in sorted(blocks)]
    assert brute_deviation(order, weights) < 1 and order != ["a", "b", "c"][: len(order)]
    want = sorted(mixing.mix(docs, mixing.tempered).collect(), key=lambda r: r.mix.position)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]


def test_registry_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", ".git", "treescan"):
            (tmp_path / name).symlink_to(os.path.join(ROOT, name))
    os.mkdir(tmp_path / "treescan")
    for name in os.listdir(os.path.join(ROOT, "treescan")):
        if name != "llm":
            (tmp_path / "treescan" / name).symlink_to(os.path.join(ROOT, "treescan", name))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60, check=True).stdout
    n, llm = said.split()
    assert int(n) > 60 and llm == "False"
