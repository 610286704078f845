"""Jobs end to end: tables, ids, samples, publishing, ingestion."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from canvass import config as C
from canvass.operators import keyed, proposals, publish, ranking, sampling
from canvass.plans import ingest as ingest_plan
from canvass.registry import base
from canvass.schema import TABLE
from canvass.sources import adapters, readers, standin

T1, T2 = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 2, 1, tzinfo=timezone.utc)


def test_numbering_a_hot_group_equals_the_window(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < .6 else f"k{rng.randint(0, 9)}", rng.randint(0, 40), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    window = Window.partitionBy("k").orderBy("v", "i")
    plain = {(r["i"], r["rn"]) for r in df.withColumn("rn", F.row_number().over(window)).collect()}
    split = {(r["i"], r["rn"]) for r in ranking.numbered(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    assert plain == split and len(plain) == 2000


def test_ids_do_not_depend_on_row_order(spark):
    rows = [("A Prize", "second", "u1"), ("A Prize", "first", "u2"), ("B Prize", None, "u3")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "award_name string, award_description string, award_uid string")
        got = {r["award_uid"]: r["stable_id"] for r in ranking.stable_native_id(df).collect()}
        assert got == {"u1": "a-prize-2", "u2": "a-prize", "u3": "b-prize"}


def empty_table(spark):
    return spark.createDataFrame([], TABLE)


def test_upsert_keeps_first_index_time_and_takes_the_latest(spark):
    one = spark.createDataFrame([("s", "1", "old", T1)], "source_id string, native_id string, award_name string, run_ts timestamp")
    two = spark.createDataFrame(
        [("s", "1", "older", T1), ("s", "1", "new", T2), ("s", "2", "other", T2)], one.schema)
    first = keyed.upsert_full(empty_table(spark), one)
    errors = spark.createDataFrame([("s", "1", "timeout")], "source_id string, native_id string, error string")
    marked = keyed.mark_error(first, errors)
    second = {r["native_id"]: r for r in keyed.upsert_full(marked, two).select(
        "native_id", "award_name", F.unix_seconds("indexed_at").alias("i"), F.unix_seconds("scraped_at").alias("s"), "scrape_error").collect()}
    assert second["1"]["award_name"] == "new" and second["1"]["scrape_error"] is None
    assert second["1"]["i"] == int(T1.timestamp()) and second["1"]["s"] == int(T2.timestamp())
    assert second["2"]["i"] == int(T2.timestamp())


def test_unknown_columns_are_refused(spark):
    bad = spark.createDataFrame([("s", "1", "x")], "source_id string, native_id string, colour string")
    with pytest.raises(keyed.UnknownColumns):
        keyed.upsert_full(empty_table(spark), bad)


def test_gates_keep_the_last_good_version(spark, tmp_path):
    good = spark.createDataFrame([("a",), ("b",)], "award_uid string")
    root = str(tmp_path / "site")
    publish.staged_publish({"full": good}, [good.where("false")], root, "v1")
    with pytest.raises(publish.PublishRefused):
        publish.staged_publish({"full": good.limit(0)}, [good], root, "v2")
    assert publish.current_version(spark, root) == "v1"
    publish.staged_publish({"full": good.limit(1)}, [good.where("false")], root, "v3")
    assert publish.published(spark, root, "full").count() == 1


def test_publish_all(spark, sf_dir, tmp_path):
    table = standin.award_rows(spark, sf_dir).where("source_id in ('s0', 's4', 's6')")
    reg = base.registry(spark).where("source_id in ('s0', 's4', 's6')").withColumn("min_scraped_fraction", F.lit(0.5))
    base_dir = ingest_plan.publish_all(table, reg, str(tmp_path / "site"), "v1")
    assert spark.read.parquet(f"{base_dir}/slim").count() == table.count()


def test_delivery_split_prunes(spark, sf_dir, tmp_path):
    records = base.records(spark, sf_dir).select("award_uid", "source_id")
    path = publish.write_core_and_shards(records, base.registry(spark), str(tmp_path / "out"))
    assert readers.read_core(spark, path).select("source_id").distinct().count() == 2
    assert readers.read_shards(spark, path, ["s1"]).count() == records.where("source_id = 's1'").count()


def test_filters_and_columns_reach_the_scan(spark, sf_dir, tmp_path):
    from canvass.operators import facets

    base.records(spark, sf_dir).drop("eligibility").write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    picked = facets.structured_filters(stored, {"career": ["Undergraduate"], "amount": {"min": 500}}).select("award_uid")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = picked._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(amount_max,500)" in plan and "IsNull(career)" in plan
    scan = plan[plan.index("ReadSchema"):].split(">")[0]
    assert "award_description" not in scan


def test_sample_fills_quotas_without_repeats(spark):
    probes = [("a", 3, "apple"), ("b", 3, "apple|pear"), ("rest", 4, None)]
    rows = [(f"u{i}", "apple" if i < 5 else "pear" if i < 7 else "plum" if i < 20 else " ") for i in range(30)]
    df = spark.createDataFrame(rows, "award_uid string, t string")
    got = [(r["concept"], r["award_uid"]) for r in sampling.stratified_sample(df, "t", probes).collect()]
    assert len({u for _, u in got}) == len(got) == 10
    texts = dict(rows)
    assert all(texts[u] == "apple" for c, u in got if c == "a")
    again = [(r["concept"], r["award_uid"]) for r in sampling.stratified_sample(df.repartition(7), "t", probes).collect()]
    assert sorted(again) == sorted(got)


def test_relaxation_equals_replay(spark):
    rng = random.Random(4)
    some = lambda xs, p=.6: [x for x in xs if rng.random() < p]
    facets = {"career": ["U", "G"], "levels": ["1", "2"], "award_types": ["x", "y"], "terms": ["F", "W"],
              "affiliations": ["w"], "areas_of_study": ["m", "n", "o"]}
    records = [{f: (rng.choice(vs + [None]) if f == "career" else some(vs, .4)) for f, vs in facets.items()} for _ in range(40)]
    keys = {"career": "career", "level": "levels", "awardType": "award_types", "term": "terms", "affiliation": "affiliations",
            "areaOfStudy": "areas_of_study"}
    asks = [{"question_id": i, **{k: (some(facets[f] + ["zz"], .3)) for k, f in keys.items()}} for i in range(30)]

    def passes(record, ask):
        for k, f in keys.items():
            stated = ([record[f]] if record[f] else []) if f == "career" else record[f]
            if not ask[k]:
                continue
            if not stated and k != "affiliation":
                continue
            if not set(stated) & set(ask[k]):
                return False
        return True

    want = {}
    for ask in asks:
        work, relaxed = dict(ask), []
        while True:
            n = sum(passes(r, work) for r in records)
            nxt = next((k for k in C.RELAX_ORDER if work[k] and k not in relaxed), None)
            if n or not nxt:
                want[ask["question_id"]] = (relaxed, n)
                break
            work[nxt] = []
            relaxed = [*relaxed, nxt]
    r_schema = "career string, " + ", ".join(f"{f} array<string>" for f in list(facets)[1:])
    q_schema = "question_id int, " + ", ".join(f"{k} array<string>" for k in keys)
    got = proposals.relax_ladder(spark.createDataFrame(asks, q_schema), spark.createDataFrame(records, r_schema))
    assert {r["question_id"]: (r["relaxed"], r["n_records"]) for r in got.collect()} == want


def test_question_keys(spark):
    df = spark.createDataFrame([("Find me  awards for CS students?!",), ("awards for CS students",), ("Can you list CS",)], "q string")
    got = [r[0] for r in df.select(proposals.question_key_text(proposals.question_norm("q"))).collect()]
    assert got == ["awards for cs students", "awards for cs students", "cs"]


def test_listing_ingestion(spark):
    html = ("<table><tr><td>Faculty of Law</td><th><a href='/opportunities/12'>Doctoral Prize</a><div>About it</div></th>"
            "<td>Deadline 01/15/2027</td><td>$1 000 minimum</td><td>Archived</td></tr></table>")
    fetched = spark.createDataFrame([(1, "s", "https://s.example.org/opportunities?page=1", html),
                                     (2, "s", "https://s.example.org/opportunities?page=2", html)],
                                    "page_id long, source_id string, url string, html string")
    rows = adapters.ingest("listing", fetched).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["native_id"], r["career"], r["amount_max"], r["deadline_date"], r["application_status"], r["source_url"]) == (
        "12", "Graduate", 1000, "2027-01-15", "Ended", "https://s.example.org/opportunities/12")
    table = ingest_plan.refresh(empty_table(spark), "listing", fetched, F.lit(T1))
    assert table.count() == 1


def test_wide_table_and_cards(spark):
    html = ("<table><tr><td>A Prize</td><td>A Prize Value: 1 at $2,000.</td><td>ESSAY REQUIRED</td><td>SEPTEMBER 30</td></tr>"
            "<tr><td>A Prize</td><td>Another.</td></tr><tr><td></td><td>x</td></tr></table>"
            "<div class='scholarship'><h3 class='scholarship-title'>Card One</h3><i class='scholarship-group'>High school students</i></div>")
    fetched = spark.createDataFrame([(1, "w", "https://w.example.org/", html)], "page_id long, source_id string, url string, html string")
    rows = {r["native_id"]: r for r in adapters.ingest("wide_table", fetched).collect()}
    assert set(rows) == {"a-prize", "a-prize-2"}
    assert rows["a-prize-2"]["amount_max"] == 2000 and rows["a-prize-2"]["deadline_raw"] == "SEPTEMBER 30"
    card = adapters.ingest("cards", fetched).first()
    assert (card["native_id"], card["career"], card["level"]) == ("card-one", "Undergraduate", "UG Entering Year 1")
