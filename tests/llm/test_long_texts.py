"""Texts that hold very many of what an operator looks for."""

import time

from canvass.llm import licenses, secrets


def test_an_spdx_line_of_many_terms(spark):
    text = "# SPDX-License-Identifier: MIT" + " OR MIT" * 100_000 + "\n"
    files = spark.createDataFrame([(1, "a/b.py", text), (2, "a/c.py", "# SPDX-License-Identifier: (MIT OR Apache-2.0)")],
                                  "doc_id long, path string, text string")
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(files).collect()}
    assert got[1].startswith("MIT OR MIT") and got[2] == "(MIT OR Apache-2.0)"


def test_a_text_of_many_checksums(spark):
    spark.createDataFrame([(0, "0" * 30)], "doc_id long, text string").count()
    docs = spark.createDataFrame([(1, "".join(f"file {i:040x}\n" for i in range(100_000))), (2, "a"), (3, "f" * 24)],
                                 "doc_id long, text string")
    begin = time.perf_counter()
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert time.perf_counter() - begin < 60
    assert [(s["start"], s["end"], s["value"]) for s in got[1]] == [
        (46 * i + 5, 46 * i + 45, f"{i:040x}") for i in range(100_000)]
    assert got[2] == [] and [(s["start"], s["end"]) for s in got[3]] == [(0, 24)]
