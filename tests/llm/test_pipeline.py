"""The pipeline's stages against brute force, the registered queries against SQL, and the import guard."""

from __future__ import annotations

import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from basinflow.llm import quality
from basinflow.llm.queries import ORACLE_SQL, QUERIES
from tests import parity
from tests.llm import fixtures as fx

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    parity.check(spark, QUERIES[name], ORACLE_SQL[name])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "source mixing", "packing"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{parity.DATA}/documents.parquet")


def test_quality_stage(spark, docs):
    kept = STAGES["quality classifier"](spark, docs, parity.DATA)
    model = quality.train_quality(docs, spark.read.parquet(f"{parity.DATA}/labels.parquet"))
    features = quality.Features()
    want = {r.doc_id for r in docs.collect() if model.score(features(r.text)) >= 0.7}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_exact_stage(spark, docs):
    kept = STAGES["exact dedup"](spark, docs, parity.DATA)
    last = {}
    for r in docs.collect():
        text = fx.lower(r.text)
        last[text] = max(last.get(text, -1), r.doc_id)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(last.values())


def test_near_stage(spark, docs):
    """Of each component of five-word likeness 0.8 or more, the smallest doc_id stays."""
    kept = STAGES["simhash near-dedup"](spark, docs, parity.DATA)
    rows = docs.collect()

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", fx.lower(text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in rows}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    comp = fx.linked(sets, alike)
    assert len(set(comp.values())) < len(rows)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))


def test_mixing_stage_is_the_sql_query(spark, docs):
    mixed = STAGES["source mixing"](spark, docs, parity.DATA)
    names, rows = parity.oracle_rows(ORACLE_SQL["op4_mixing"])
    at = names.index("doc_id")
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(r[at] for r in rows)


def test_run(spark):
    pieces = corpus_pipeline.run(spark, parity.DATA).collect()
    total = {(p.doc_id, p.doc_row): p.doc_tokens for p in pieces}
    assert sum(p.length for p in pieces) == sum(total.values()) and len({p.sequence_id for p in pieces}) == len(pieces)


def test_stages_take_odd_and_empty_tables(spark, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda *_: labels)
    rows = fx.odd_documents(spark)
    for some in (rows, []):
        frame = fx.frame(spark, some)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, "nowhere")
            if name != "packing":
                assert out.columns == frame.columns
            assert (out.count() > 0) == bool(some)


def test_the_rest_imports_without_this_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    (tmp_path / "basinflow").mkdir()
    for p in (root / "basinflow").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "basinflow" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import __spark_entry__ as e; assert 'pricing_summary' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
