"""Batch order, ties, boundaries and malformed input."""

import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from canvass import session
from canvass.operators import counts, eligibility, keyed, lookups, pages, proposals, record
from canvass.schema import TABLE
from canvass.sources import adapters


def day(n):
    return datetime(2024, 1, n, tzinfo=timezone.utc)


def batch(spark, *rows):
    return spark.createDataFrame([("s", "k", name, day(n)) for name, n in rows],
                                 "source_id string, native_id string, award_name string, run_ts timestamp")


def test_batches_may_come_in_any_order(spark):
    empty = spark.createDataFrame([], TABLE)
    batches = [batch(spark, ("old", 1)), batch(spark, ("new A", 9), ("new B", 9)), batch(spark, ("new C", 9), ("mid", 5))]
    seen = set()
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        table = empty
        for i in order:
            table = keyed.upsert_full(table, batches[i])
        r = table.first()
        seen.add((r.award_name, r.indexed_at, r.scraped_at))
    assert len(seen) == 1 and next(iter(seen))[0] == "new C"


def test_a_group_of_exactly_the_cap_is_kept(spark):
    rows = spark.range(300).select(F.lit("a").alias("x"), F.col("id").cast("string").alias("y"))
    got = counts.split_depth(rows, [["x"], ["y"]], cap=300).collect()
    assert [(r.depth, r.n, r.incomplete) for r in got] == [(1, 300, False)]
    assert counts.split_depth(rows, [["x"], ["y"]], cap=299).count() == 300


def test_one_verdict_for_odd_entries(spark):
    texts = ['{"shoe_size": {"value": 9, "confidence": 1, "src": "x"}}', "{}", None, "broken",
             '{"full_time": true, "residency": {"value": ["AB"], "confidence": 0.9, "src": "x"}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", record.parse_eligibility("t").alias("eligibility"), F.lit(None).cast("string").alias("application_type"))
    person = {"residency": ["ON"]}
    full = {r.i: r.verdict for r in eligibility.match_profile(df, person).collect()}
    short = {r.i: r.verdict for r in eligibility.with_verdict(df, "eligibility", eligibility.literal_answers(person)).collect()}
    assert full == short == {0: "eligible", 1: "unknown", 2: "unknown", 3: "unknown", 4: "excluded"}


def test_only_text_is_a_proposed_value(spark):
    df = spark.createDataFrame([('{"term": ["Fall", 3, "Fall", null, true, ["x"]], "level": "UG"}',)], "p string")
    row = df.select(*proposals.proposed_values(F.col("p"))).first()
    assert [v for v in row["term"] if v] == ["Fall", "Fall"] and len(row["term"]) == 6 and row["level"] is None
    vocabulary = spark.createDataFrame([("term", "Fall"), ("term", "3")], "filter_key string, value string")
    got = proposals.proposal_validate(df.select(*proposals.proposed_values(F.col("p"))), vocabulary).first()
    assert got["term"] == ["Fall"] and got["dropped"] == 5


def test_near_values_contain_the_request(spark):
    known = [("f", "Applied Maths", 3), ("f", "Mathematics", 9), ("f", "Pure maths", 3), ("f", "Art", 1), ("g", "Maths", 5)]
    counted = spark.createDataFrame(known, "facet string, value string, n long")
    asked = spark.createDataFrame([("f", "math"), ("f", "MATHS"), ("f", "zz"), ("f", "a"), ("f", ""), ("f", "Art"), ("h", "x")],
                                  "facet string, value string")
    got = {(r.facet, r.value): r.near for r in lookups.vocab_unknown(asked, counted).collect()}
    assert got == {("f", "math"): "Mathematics, Applied Maths", ("f", "MATHS"): "Applied Maths, Pure maths", ("f", "zz"): "",
                   ("f", "a"): "Mathematics, Applied Maths", ("f", ""): "Mathematics, Applied Maths", ("h", "x"): ""}


def test_a_card_without_a_group_does_not_shift_the_others(spark):
    html = ('<div class="card"><h2 class="scholarship-title">A</h2></div><div class="card"><h2 class="scholarship-title">B</h2>'
            '<p class="scholarship-group">Graduate</p></div>')
    fetched = spark.createDataFrame([(1, "s", "https://x.example.org", html)], "page_id long, source_id string, url string, html string")
    got = {r.award_name: r.career for r in adapters.ingest("cards", fetched).collect()}
    assert got["A"] is None and got["B"] == "Graduate"


def test_unclosed_blocks_take_linear_time(spark):
    def seconds(n):
        begin = time.perf_counter()
        pages._Blocks().run("<li>x" * n).value()
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(32_000) < 40 * max(seconds(2_000), 0.005)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_crawl_rules_of_one_host_meet_by_prefix(spark):
    """Many rules of one host: the first that matches decides, whatever its length; repeated and null urls stay."""
    from canvass.operators import lookups

    rules = [("a.org", i, f"/p{i}/", i % 2 == 0, True) for i in range(300)]
    rules += [("a.org", 300, "/p1", False, True), ("a.org", 301, "/", True, True), ("b.org", 1, "/", True, False)]
    paths = ["/p7/x", "/p8/", "/p1", "/p1x", "", "/other", "/p299/y#f", "/p300/"]
    urls = [(f"https://a.org{p}",) for p in paths] + [("https://a.org/p8/",), ("https://b.org/x",), ("https://c.org/",), (None,)]

    def plain(url):
        if url is None or "c.org" in url:
            return True
        if "b.org" in url:
            return False
        path = url[len("https://a.org"):].split("#")[0] or "/"
        return next(allow for _, _, prefix, allow, _ in rules if path.startswith(prefix))

    got = lookups.crawl_policy_gate(
        spark.createDataFrame(urls, "url string"),
        spark.createDataFrame(rules, "host string, rule_no int, prefix string, allow boolean, readable boolean")).collect()
    assert sorted((r["url"] or "", r["allowed"]) for r in got) == sorted((u or "", plain(u)) for u, in urls)
