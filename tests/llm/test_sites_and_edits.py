"""Licences, the quality classifier and token counts against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import by_row
from pyspark.sql import functions as F

from canvass.llm import classifier, licenses, token_counts
from canvass.llm.queries import mail_edits, tokenizer_path


# --- licences
def scan_plain(files):
    cue, word, name_is = (re.compile(p) for p in (licenses.CUES, licenses.WORD, licenses.LICENCE_FILE))
    notices = {}
    for i, (_, _, text) in enumerate(files):
        for line in (text or "").split("\n"):
            if cue.search(line):
                notices.setdefault(i, []).append(Counter(word.findall(line.lower())))
    flat = [n for ns in notices.values() for n in ns if n]
    df = Counter(t for n in flat for t in n)
    idf = lambda t: math.log((1 + len(flat) + len(licenses.TEMPLATES)) / (1 + df[t])) + 1
    templates = [(name, Counter(word.findall(text.lower()))) for name, text in licenses.TEMPLATES]
    size = lambda v: math.sqrt(sum((c * idf(t)) ** 2 for t, c in v.items()))
    own = {}
    for i, ns in notices.items():
        found = [(round(sum(c * v[t] * idf(t) ** 2 for t, c in n.items()) / size(n) / size(v), 6), name)
                 for n in ns if n for name, v in templates if set(n) & set(v)]
        found = [f for f in found if f[0] >= licenses.THRESHOLD]
        if found:
            own[i] = max(found)
    speaks = {}
    for i, (_, path, _) in enumerate(files):
        if path is not None and i in own and name_is.search(path.rpartition("/")[2]):
            d = path.rpartition("/")[0]
            speaks[d] = max(own[i], speaks.get(d, own[i]))
    out = []
    for i, (doc, path, _) in enumerate(files):
        inherited = None
        if path is not None:
            parts = path.split("/")[:-1]
            for n in range(len(parts), -1, -1):
                if "/".join(parts[:n]) in speaks:
                    inherited = speaks["/".join(parts[:n])][1]
                    break
        mine = own.get(i, (None, None))[1]
        out.append((doc, path, mine, inherited, mine or inherited))
    return sorted(map(repr, out))


FILES = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.txt", "prose"), (3, "a/b/d/COPYING", "no notice"),
    (4, "a/b/d/e.txt", "x\nReleased under the MIT License.\ny"), (5, "f.txt", None), (6, "a/b/License.md", "This work is licensed "
     "under the GNU General Public License, version 3."), (7, "a/b/z/y/x/w.txt", ""), (8, None, "Licensed under CC BY-NC 4.0."),
    (9, "", "copyright"), (10, "licence", "Released under the MIT License."), (10, "licence", "Released under the MIT License."),
    (11, "q/LICENSE", "Released under the MIT License."), (12, "q/COPYING", "Licensed under CC BY 4.0."), (13, "q/r", "license " * 5000),
    (None, "q/r/s", "licensed"), (14, "//x//", "copyright ©"), (15, "a/LICENSE.txt/in", "t")]


def test_licences(spark):
    files = spark.createDataFrame(FILES, "doc_id long, path string, text string")
    got = licenses.scan(files).select("doc_id", "path", "own", "inherited", "licence")
    assert by_row(got) == scan_plain(FILES)
    assert licenses.scan(files.where("false")).count() == 0


def test_headers_and_whole_licence_files(spark):
    bsd = ("Copyright (c) 2020, A. Author\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions are met:\n" + licenses._BSD[148:] + licenses._BSD_NO_WARRANTY)
    gnu = licenses._GNU.format(what="program", mark=":", name="General Public License", n="3")
    files = [
        ("BSD-2-Clause", "a/LICENSE", bsd), ("MIT", "b/LICENSE", "Copyright (c) 2021 B\n\n" + licenses._MIT + licenses._NO_WARRANTY),
        ("GPL-3.0", "c/COPYING", (licenses.TEXTS / "GPL-3.0.txt").read_text()),
        ("Apache-2.0", "d/LICENSE", (licenses.TEXTS / "Apache-2.0.txt").read_text()),
        ("LGPL-2.1", "d2/COPYING", (licenses.TEXTS / "LGPL-2.1.txt").read_text()),
        ("BSD-2-Clause", "e/x.py", "#!/bin/python\n" + "\n".join("# " + x for x in bsd.split("\n")) + "\nimport os\n"),
        ("GPL-3.0", "f/x.c", "/* Copyright (C) 2019\n *\n * " + gnu.replace("\n", "\n * ") + "\n */\nint x;"),
        ("Apache-2.0", "g/x.c", "// SPDX-License-Identifier: Apache-2.0\nint x;"), ("EPL-2.0", "h/x", "# SPDX-License-Identifier: EPL-2.0"),
        ("GPL-2.0", "i/x.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */"), ("GPL-3.0", "j/x", "prose\nLicensed under the GPL v3\nprose"),
        ("GPL-3.0", "k/x", "License: GPLv3"), ("LGPL-2.1", "l/x", "License: LGPL-2.1"), ("GPL-2.0", "m/x", "Licensed under the GPL-2.0."),
        ("proprietary", "n/x", "Copyright. All rights reserved."), (None, "o/x.py", "# a comment\n" * 20000 + "x = 1"), (None, "p/LICENSE", "prose")]
    table = spark.createDataFrame([(i, path, text) for i, (_, path, text) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own for r in licenses.scan(table).collect()}
    assert [(p, got[i]) for i, (_, p, _) in enumerate(files)] == [(p, want) for want, p, _ in files]


def test_licences_of_the_table(small):
    files = small.select("doc_id", F.concat_ws("/", "source", "lang", F.when(F.col("text").startswith("Licensed"), "LICENSE")
                                             .otherwise(F.col("doc_id").cast("string"))).alias("path"), "text")
    got = licenses.scan(files).select("doc_id", "path", "own", "inherited", "licence")
    assert by_row(got) == scan_plain([tuple(r) for r in files.collect()])


# --- classifier
def eb_plain(rows):
    """Rates of (host, path) from documents' own probabilities."""
    def strength(groups):
        n = sum(g[0] for g in groups)
        noise = sum(p * (1 - p) for _, _, p in groups) / n
        spread = sum(k * (s / k - p) ** 2 for k, s, p in groups) / n - noise
        inside = sum(k * p * (1 - p) for k, _, p in groups) / n
        return max(0.0, min(1e9, inside / spread - 1 if spread > inside / 1e9 else 1e9))

    hosts, paths = {}, {}
    for h, p, own in rows:
        for d, k in ((hosts, h), (paths, (h, p))):
            d.setdefault(k, []).append(own)
    base = sum(r[2] for r in rows) / len(rows)
    pull = strength([(len(v), sum(v), base) for v in hosts.values()])
    host = {h: (sum(v) + pull * base) / (len(v) + pull) for h, v in hosts.items()}
    near = strength([(len(v), sum(v), host[k[0]]) for k, v in paths.items()])
    return base, host, {k: (sum(v) + near * host[k[0]]) / (len(v) + near) for k, v in paths.items()}


def check_rates(got):
    base, host, path = eb_plain([(r.host, r.path, r.own) for r in got])
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        assert r.host_rate == pytest.approx(host[r.host], rel=1e-6)
        assert r.path_rate == pytest.approx(path[r.host, r.path], rel=1e-6)
        z = logit(r.own) + logit(min(max(r.path_rate, 1e-4), 1 - 1e-4)) - logit(min(max(base, 1e-4), 1 - 1e-4))
        assert r.good == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6) and r.kept == (r.good >= 0.5)


@pytest.mark.parametrize("which", ["odd", "small", "clashing", "none"])
def test_rates_are_drawn_to_those_above(which, spark, sf_dir, request):
    docs, labels = request.getfixturevalue(which), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = classifier.classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len(got) == docs.count()
    if got:
        check_rates(got)


def test_sparse_sites_lean_on_the_corpus(spark):
    rng, rows = random.Random(2), []
    for h in range(12):
        bad = h % 2
        for i in range(200):
            rows.append((f"h{h}", f"h{h}/p{i % 2}", 0.2 + 0.1 * rng.random() if bad else 0.8 + 0.1 * rng.random()))
    rows += [("new", "new/p", 0.1)]
    got = {r._p: r for r in classifier.sites(spark.createDataFrame(rows, "host string, path string, own double")).collect()}
    assert abs(got["h0/p0"].path_rate - 0.85) < 0.05 and abs(got["h1/p0"].path_rate - 0.25) < 0.05
    assert 0.1 < got["new/p"].path_rate < 0.55


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables have 200 labels at most
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = classifier.classify(docs, train, F.col("source"), F.concat_ws("/", "source", "lang")).join(test, "doc_id")
    junk, good = got.where("quality = 0"), got.where("quality = 1 and toxic = 0")
    assert junk.where("not kept").count() >= 0.95 * junk.count()
    assert good.where("kept").count() >= 0.95 * good.count()


def test_no_labels_no_evidence(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = classifier.classify(odd, labels, F.col("source"), F.col("lang")).collect()
    assert {round(r.own, 9) for r in got} == {0.5} and all(r.kept for r in got)


# --- token counts
def plain_count(text):
    import public_tokenizers

    c = token_counts.Counter(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return len(c.pattern.findall(text)), len(c.encoder.encode_ordinary(text))


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return token_counts.Counter(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_edits_keep_the_tree_right(counter, monkeypatch):
    rng = random.Random(11)
    alphabet = ["a", "bc", " ", "  ", "\n", "\n\n", "'", "'s", "'l", "l", "9", "é", "\U0001f600", "-", "don't", "\t ", "Z"]
    for leaf in (1, 2, 5, 32):
        monkeypatch.setattr(token_counts, "LEAF", leaf)
        for _ in range(120):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))
            tree = token_counts.Tree.build(p := counter.pattern.findall(text), counter.counts(p))
            for _ in range(5):
                a = rng.randrange(len(text) + 1)
                b = min(len(text), a + rng.choice([0, 1, 2, 9, 40]))
                text, tree, _ = token_counts.edit(
                    text, tree, a, b, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 30]))), counter)
                chars, tokens, pieces = (s[1] for s in tree.sums)
                assert (chars, pieces, tokens) == (len(text), len(counter.pattern.findall(text)),
                                                   len(counter.encoder.encode_ordinary(text)))
                for s in tree.sums:
                    assert all(s[i] == s[2 * i] + s[2 * i + 1] for i in range(1, tree.size))
                edges = np.cumsum([0, *tree.sums[0][tree.size:]])
                starts = {m.start() for m in counter.pattern.finditer(text)} | {len(text)}
                assert set(edges.tolist()) <= starts


def test_only_what_an_edit_touches_is_encoded_again(counter):
    text = "some words in a row " * 3000
    tree = token_counts.Tree.build(p := counter.pattern.findall(text), counter.counts(p))
    _, _, again = token_counts.edit(text, tree, 30000, 30004, "other", counter)
    assert again <= 3 * token_counts.LEAF


@pytest.mark.parametrize("which", ["odd", "small", "clashing", "none"])
def test_counts_after_edits(which, request, counter):
    import public_tokenizers

    docs = request.getfixturevalue(which)
    got = token_counts.counts_after_edits(docs, mail_edits(F.col("text")), tokenizer_path("byte_bpe_50k.tiktoken"),
                                          public_tokenizers.PATTERN)
    mail, want = re.compile(r"[A-Za-z0-9._-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"), []
    for doc, text in docs.select("doc_id", "text").collect():
        after, n = mail.subn("[mail]", text or "")
        want.append((doc, len(counter.pattern.findall(text or "")), len(counter.encoder.encode_ordinary(text or "")), n,
                     len(counter.pattern.findall(after)), len(counter.encoder.encode_ordinary(after)), len(after)))
    assert by_row(got.drop("n_encoded_again")) == sorted(map(repr, want))


def test_edits_may_be_odd(spark):
    import public_tokenizers

    rows = [(1, "abc def", [(2, 5, "X"), (4, 6, "Y"), (None, 1, "Z"), (6, 99, None), (-3, 1, "Q")]), (2, "abc", None), (3, None, [(0, 5, "in")])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, e {token_counts.EDITS}")
    got = {r.doc_id: r for r in token_counts.counts_after_edits(docs, F.col("e"), tokenizer_path("byte_bpe_50k.tiktoken"),
                                                                public_tokenizers.PATTERN).collect()}
    assert (got[1].n_edits, got[1].n_chars_after) == (3, len("QbXe"))
    assert (got[2].n_edits, got[2].n_chars_after, got[3].n_chars_after) == (0, 3, 2)
