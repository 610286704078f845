"""What goes through the disk: shuffle files of staged frames go, rows without a partner stay where they are."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from canvass.llm import lm_trie, near_dups
from canvass.llm.common import marked, stage


def shuffle_files(spark) -> set:
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(held.size()) if (name := held.apply(i).getName()).startswith("shuffle_")}


def test_staged_frames_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    staged = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert sorted(map(tuple, staged.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_marked_misses_no_partner_and_few_others_are_marked(spark):
    rows = spark.range(-3000, 3000).select(F.xxhash64("id").alias("x"), "id").unionByName(
        spark.createDataFrame([(-1, 10**9), (None, 10**9 + 1), (2**63 - 1, 10**9 + 2)], "x long, id long"))
    wanted = rows.where("id % 3 = 0 or id >= 1000000000").select("x").unionByName(rows.select("x").limit(5))
    got = marked(rows, "x", wanted, "may").collect()
    held = {r[0] for r in wanted.collect()}
    assert len(got) == 6003
    assert all(r.may for r in got if r.x in held and r.x is not None)
    assert sum(r.may for r in got if r.x not in held) < 20


def test_sketches_are_dealt_out_once(spark):
    rows = [(1, 11, 5, [1, 2]), (2, 12, 5, [2, 3]), (3, 11, 5, [1, 2]), (4, 13, 5, [9]), (None, 14, 5, [2])]
    sketched = spark.createDataFrame(rows, "doc_id long, t long, n_words long, sketches array<long>").withColumn(
        "t", F.col("t").cast("decimal(38,0)"))
    shared = near_dups.shared_sketches(sketched)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1
    assert sorted((r.key, int(r.doc), int(r.leader)) for r in shared.collect()) == [(2, 11, 11), (2, 12, 11)]


def test_ngrams_of_several_blocks_are_one_key():
    keys = [np.array([3, 12, 40], np.uint64), np.array([12, 40, 41], np.uint64)]
    frame = pd.DataFrame({
        "block": [0, 1], "keys": [lm_trie.sorted_planes(k) for k in keys],
        "counts": [lm_trie.planes([1, 2, 0], np.uint32), lm_trie.planes([1, 0, 3], np.uint32)],
        "totals": [lm_trie.planes([5, 6, 7], np.int64), lm_trie.planes([6, 7], np.int64)]})
    packed, own, asked = lm_trie.pack_shard(frame, 10)
    assert own.tolist() == [3, 12, 40, 41]
    assert [own[a].tolist() for a in asked] == [k.tolist() for k in keys]
    place = lm_trie.Successors(packed).place(own // np.uint64(10), own % np.uint64(10))
    assert place.tolist() == [0, 1, -1, 2]


def test_shards_keep_the_order_of_their_members():
    shard = np.array([5, 1, 70000, 1, 5, 5])
    assert [(s, m.tolist()) for s, m in lm_trie.by_shard(shard)] == [(1, [1, 3]), (5, [0, 4, 5]), (70000, [2])]
    assert lm_trie.by_shard(np.zeros(0, np.int64)) == []


def test_blocks_split_at_ascii_space_only(spark):
    texts = ["", "  a B\ta\x0b\x0cb\n", "a b  ", " ", "É é A\x1cb"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in lm_trie.score(docs).collect()}
    assert got == {i: len((t or "").encode().lower().split()) + 1 for i, t in [*enumerate(texts), (9, None)]}
