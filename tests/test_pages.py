from pyspark.sql import functions as F

from canvass.functions.text import lines
from canvass.operators import pages


def one(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


def test_text_breaks_at_blocks_and_survives_bad_markup(spark):
    html = ("<html><head><style>p{}</style><script>var t='</p>';</script></head><body><p>One <b>two</b>&amp;&#233;<div>three"
            "<br>four</span></p><noscript>no</noscript>  five  six</body>")
    assert pages.page_text(one(spark, html)).first()["text"] == "One two & é\nthree\nfour\nfive six"
    assert pages.page_text(one(spark, "")).first()["text"] == ""


def test_block_text_lets_inline_flow(spark):
    html = "<div><p>See the <a href='x'>applicable office</a>.</p><ul><li>One</li><li><p>Two</p> tail</li></ul></div>"
    assert pages.page_block_text(one(spark, html)).first()["text"] == "See the applicable office.\nOne\nTwo"
    assert pages.page_block_text(one(spark, "plain <b>text</b>  here")).first()["text"] == "plain text here"


def test_rows_close_cells_implicitly(spark):
    html = ("<table><tr><td>h</td></tr><tr><td>Law<td>Open<th><a href='/opportunities/7'>Prize</a><div>for\nall</div></th></tr></table>")
    got = pages.listing_rows(pages.page_table_rows(one(spark, html)), r"^/opportunities/(\d+)$").collect()
    assert [(r["native_id"], r["name"], r["category"], r["status"]) for r in got] == [("7", "Prize", "Law", "Open")]


def test_elements_by_class_and_id(spark):
    html = ("<div class='a b'>x<div class='b'>y</div></div><span class='b'> </span><i id='f-ONE-e'>1</i><i id='f--e'>2</i>")
    both = pages.page_elements(one(spark, html), classes=("b",)).orderBy("pos").collect()
    assert [r["text"] for r in both] == ["x\ny", "y"]
    assert [r["text"] for r in pages.page_elements(one(spark, html), classes=("a", "b")).collect()] == ["x\ny"]
    named = pages.page_elements(one(spark, html), id_prefix="f-", id_suffix="-e").collect()
    assert [(r["name"], r["text"]) for r in named] == [("ONE", "1")]


def test_label_value(spark):
    df = spark.createDataFrame([("Value:\n$500",), ("loose",), ("x: ",)], "t string")
    got = [r[0] for r in df.select(pages.label_value("t")).collect()]
    assert [tuple(g) if g else None for g in got] == [("value", "$500"), None, None]


def test_sections(spark):
    t = "intro\nEligibility Criteria:\none\ntwo\nValue\n$5\nELIGIBILITY CRITERIA\nthree"
    df = spark.createDataFrame([(t,)], "t string")
    heads = ["Eligibility Criteria:", "Value", "ELIGIBILITY CRITERIA"]
    got = df.select(F.inline(pages.sections(lines("t"), lambda x: x.isin(heads)))).collect()
    assert {r["heading"]: r["body"] for r in got} == {"": "intro", "eligibility criteria": "one\ntwo\nthree", "value": "$5"}


def test_values_belong_to_the_label_before(spark):
    t = "Scholarship Value: $\n3,500\nScholarships Available:\n2\nFor all.\n7"
    df = spark.createDataFrame([(t,)], "t string")
    got = df.select(pages.label_value_lines(lines("t"), {"value": "scholarship value", "n": "scholarships available"})).first()[0]
    assert tuple(got) == ("3,500", "2", "For all.\n7")


def test_paging_stops_at_a_repeat(spark):
    rows = [("t", p, i) for p, ids in {1: [1, 2], 2: [3, 4], 3: [3, 4], 4: [5, 6]}.items() for i in ids]
    df = spark.createDataFrame(rows, "tenant string, page int, item int")
    assert pages.paging_end(df, ["tenant"], "item", "page", 2).first()["last_page"] == 3
