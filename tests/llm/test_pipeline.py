"""Every stage of the pipeline against a plain version, and odd input through all of them."""

import duckdb
import pytest
from conftest_llm import by_row
from test_contracts import overlaps_plain, spans_plain
from test_near_dups import classes_plain

import corpus_pipeline
from canvass.llm import oracles, packing
from canvass.llm.common import stage
from canvass.llm.queries import tokenizer_path


def staged(spark, docs, sf_dir):
    """(name, table before, table after) of each stage."""
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, sf_dir), "test-stage")
        yield name, docs, out
        docs = out


def test_stages_match_plain_versions(spark, sf_dir, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, before, after in staged(spark, small, sf_dir):
        old = {r.doc_id: r for r in before.collect()}
        if name != "packing":
            assert after.columns == before.columns
            new = {r.doc_id: r for r in after.collect()}
        if name == "quality rules":
            con = duckdb.connect()
            con.register("documents", before.toPandas())
            kept = {r[0] for r in con.execute(f"select doc_id from ({oracles.QUALITY}) where kept").fetchall()}
            assert set(new) == kept
        elif name == "MinHash near-dedup":
            kept = {d for d, c in map(eval, classes_plain([(r.doc_id, r.text) for r in old.values()])) if d == c}
            assert set(new) == kept
        elif name == "benchmark decontamination":
            hits = map(eval, overlaps_plain([(r.doc_id, r.text) for r in old.values()], bench))
            assert set(new) == {h[0] for h in hits if h[2] == 0}
        elif name == "secret scans":
            assert set(new) == set(old)
            for d, r in new.items():
                if not spans_plain(old[d].text):
                    assert r == old[d]
                else:
                    assert r.n_chars == len(r.text) or r == old[d]
        else:
            whole = packing.WordIds(tokenizer_path())
            want = {d: len(whole.batch([r.text or ""])[0]) // 4 + 1 for d, r in old.items()}
            got = {}
            for r in after.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == want


@pytest.mark.parametrize("which", ["odd", "clashing", "none"])
def test_odd_input_passes_through(spark, sf_dir, which, request):
    docs = request.getfixturevalue(which)
    for name, before, after in staged(spark, docs, sf_dir):
        assert after.count() <= before.count() or name == "packing"
        if name != "packing":
            assert after.columns == docs.columns


def test_run_gives_the_last_stage(spark, sf_dir):
    assert by_row(corpus_pipeline.run(spark, sf_dir).groupBy().count()) != ["(0,)"]
