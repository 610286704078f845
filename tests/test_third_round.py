"""Costly steps are done once, and on every core."""

import random

from pyspark.sql import functions as F

from canvass.functions import fields as fx
from canvass.functions.text import lines
from canvass.operators import keyed, pages, publish
from canvass.sources import readers
from canvass.streaming import stateful


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_label_lines_are_made_once(spark):
    text = "\n".join(f"Value:\n{i}\nrow {i}" for i in range(300))
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = df.select(pages.label_value_lines(lines("t"), {"value": "value", "n": "number"}).alias("g"))
    assert plan(got).count("split(") == 1
    full, none = [r[0] for r in got.collect()]
    assert (full["value"], full["n"]) == ("299", None) and full["body"].count("\n") == 299
    assert tuple(none) == (None, None, None)


def test_rows_are_spread_by_key_before_costly_work(spark):
    one = spark.range(0, 1000, 1, 1)
    few = readers.spread_by(one, "id").join(spark.range(5).withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left")
    assert few.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


def test_cells_are_tidied_once(spark):
    df = spark.createDataFrame([(["Law", " ", "Open", "closed", "$5", "01/02/2027", "Arts", None],), (None,)], "c array<string>")
    got = df.select(fx.classify_cells("c").alias("g"))
    assert plan(got).count("translate(") == 1
    assert [tuple(r[0]) for r in got.collect()] == [("Law", "closed", "$5", "01/02/2027"), (None,) * 4]
    assert plan(df.select(fx.classify_extra_cells("c").alias("g"))).count("translate(") == 1


def test_body_lines_are_made_once(spark):
    df = spark.createDataFrame(
        [("Sign In\nFor: A\none\nOurs\ntwo\nAward\nx", "A"), ("one\ntwo", "B"), ("Donor\nx", "B"), (None, "B"), ("one", None)], "t string, n string")
    got = df.select(pages.body_between(lines("t"), "n").alias("g"))
    assert plan(got).count("split(") == 1
    assert [r[0] for r in got.collect()] == ["one\ntwo", "one\ntwo", None, None, "one"]


PIECES = ["<div>", "</div>", '<p class="a b">', "</p>", "<br/>", "<tr>", "<td>", "</td>", "</tr>", "<th>", '<a href="/x?a=1&amp;b">',
          '<a href="/x">', "</a>", "<a href='q\"=z'>", "<a href=u/>", "<b ID=x>", "text ", "two\n words", "&amp;", "&amp", "&", "&#65;",
          "&#x41;", "<", ">", "<script>", 'a="<b>";', "a && b", "</script>", "<!-- c -->", "<!-- -- x -->", "<!-->", "<!DOCTYPE html>",
          "<?php x ?>", "</ p>", "</>", "<title>", "</title>", "<input disabled>", '<i class="b"id=z>', "é\x00"]


class ByParser(pages._Rows):
    """Leaves every token to HTMLParser."""

    def plain(self, html):
        return 0


def test_plain_markup_is_read_as_the_parser_reads_it():
    draw = random.Random(3)
    for _ in range(3000):
        html = "".join(draw.choice(PIECES) for _ in range(draw.randint(1, 12)))
        assert pages._Rows().run(html).rows == ByParser().run(html).rows, html
    page = '<!DOCTYPE html><html><script>if (a) b()</script><p class="x" id=y>One &amp; two<br/></p><!-- no --></html>'
    assert pages._Text().plain(page) == len(page)
    assert pages._Text().run(page).value() == "One & two"


def test_page_without_id_keeps_its_rows(spark):
    df = spark.createDataFrame([(None, "<p>x</p>"), (2**60 + 1, None)], "page_id long, html string")
    assert [tuple(r) for r in pages.page_text(df).collect()] == [(None, "x"), (2**60 + 1, "")]


def test_slim_is_made_from_what_was_written(spark, tmp_path):
    calls = []

    def narrow(written):
        calls.append(written.inputFiles())
        return written.select("a")

    publish.staged_publish({"full": spark.createDataFrame([(1, 2)], "a int, b int"), "slim": narrow}, [], str(tmp_path), "v1")
    assert all("/versions/v1/full/" in f for f in calls[0])
    assert publish.published(spark, str(tmp_path), "slim").collect() == [(1,)]


def test_stream_writes_the_table_once(spark, tmp_path):
    columns = [*keyed.KEY, "award_name", "application_status", "amount_max", "run_ts"]
    batches = [[("s", "1", "b", "Open", 2, "2026-02-01")], [("s", "1", "a", "Open", 9, "2026-01-01"), ("s", "2", "c", "Open", 3, "2026-01-05")],
               [("s", "1", "z", "Open", 1, "2026-02-01"), ("t", "1", "d", "Open", 1, "2026-01-07")]]
    for rows in batches:
        spark.createDataFrame(rows, columns).withColumn("run_ts", F.col("run_ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in")
    incoming = spark.read.parquet(f"{tmp_path}/in")
    table = spark.createDataFrame(
        [("s", "1", "old", "Ended", 1, "x", "2026-01-15", "2026-01-15", "e"), ("s", "2", "kept", "Open", 1, "y", None, "2026-03-01", "e")],
        "source_id string, native_id string, award_name string, application_status string, amount_max long, raw_fields_json string, "
        "indexed_at string, scraped_at string, scrape_error string")
    table = table.withColumns({c: F.col(c).cast("timestamp") for c in ("indexed_at", "scraped_at")})
    stream = spark.readStream.schema(incoming.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = stateful.incremental_upsert(stream, table, f"{tmp_path}/out")
    want = keyed.upsert_full(table, incoming)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v-")]) == 2
