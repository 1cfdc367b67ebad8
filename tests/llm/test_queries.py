"""The package's queries against their reference SQL, and the pipeline, on the smallest tables."""

import zlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from voxtally.llm.queries import ORACLE, QUERIES

from ..test_catalog import SF, canonical, duck  # noqa: F401
from . import test_decontaminate, test_near_dedup, test_short_lines

pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):  # noqa: F811
    assert canonical(QUERIES[name](spark, str(SF)).toArrow()) == canonical(duck.sql(ORACLE[name]).to_arrow_table())


def test_near_dedup_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op1_near_dedup"](spark, str(SF)).collect()}
    assert got == test_near_dedup.brute(docs, 3, 85)


def test_language_query(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op10_language"](spark, str(SF)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out) and len(out) == len(langs)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.9 * len(held)


def test_all_are_registered():
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, steps = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(SF))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        steps[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = map(text, steps["language"])
    assert len(before) - len(after) <= 0.02 * len(before) and after.items() <= before.items()
    before, after = map(text, steps["lines"])
    want = test_short_lines.brute(before.items())
    assert after == {d: t for d, (t, _, dropped) in want.items() if not dropped or t.split()}
    before, after = map(text, steps["near_duplicates"])
    want = test_near_dedup.brute(before.items(), 5, 80)
    assert after == {d: t for d, t in before.items() if want[d][2]}
    before, after = map(text, steps["decontamination"])
    want = test_decontaminate.brute(before.items(), items, 10)
    assert after == {d: t for d, t in before.items() if not want[d][3]}
    before, after = steps["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    whole = corpus_pipeline.run(spark, str(SF))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after.collect()))
