from pyspark.sql import functions as F

from canvass.functions import fields as fx
from canvass.functions import money, text


def values(spark, inputs, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_amounts(spark):
    cases = {
        "Up to $2,500 per year": (2500, 2500, "Up to $2,500 per year"),
        "Varies": (None, None, "Varies"),
        "": (None, None, None),
        "$1 000 minimum": (1000, 1000, "$1 000 minimum"),
        "$15,707.96": (15707, 15707, "$15,707.96"),
        "$500 to $1 000": (500, 1000, "$500 to $1 000"),
        "$1 250 000": (1250000, 1250000, "$1 250 000"),
        "$25 000 ($12 500 in Fall; $12 500 in Winter)": (12500, 25000, "$25 000 ($12 500 in Fall; $12 500 in Winter)"),
        "$2500 flat": (2500, 2500, "$2500 flat"),
        "$0.00 up to $1 500": (1500, 1500, "$0.00 up to $1 500"),
        "$0.01": (None, None, "$0.01"),
    }
    got = values(spark, list(cases), money.parse_amounts("v"))
    assert [tuple(g) for g in got] == list(cases.values())


def test_long_prose_gives_figures_only(spark):
    prose = "A prize of $1,000 is given to the first. " * 2 + "The second takes $2,500 home in the autumn of each year, gladly."
    silent = "Given for standing and for service to others, year upon year, " * 3
    first, second = values(spark, [prose, silent], money.parse_amounts("v"))
    assert tuple(first) == (1000, 2500, "$1,000; $2,500")
    assert tuple(second) == (None, None, None)


def test_status(spark):
    got = values(spark, ["Open", "ENDED", " closed ", "Upcoming", "draft", None, "", "  ", "Whatever"], fx.normalize_status("v"))
    assert got == ["Open", "Ended", "Ended", "Upcoming", None, None, None, None, None]


def test_career(spark):
    rows = [
        ("Doctoral Recruitment Prize", None, "Graduate"), ("Master's Entrance Prize", None, "Graduate"),
        ("PhD Prize", "undergraduate", "Graduate"), ("First Year Entrance Bursary", None, "Undergraduate"),
        ("Law Prize", None, None), ("Smith Prize", "For those in a graduate program.", "Graduate"),
        ("Undergraduate and Graduate Prize", "For graduate students", None),
        ("Undergraduate Travel Prize", "Graduate students apply elsewhere", "Undergraduate"),
    ]
    df = spark.createDataFrame(rows, "t string, b string, want string")
    bad = df.where(~fx.infer_career("t", "b").eqNullSafe(F.col("want"))).collect()
    assert bad == []


def test_categories(spark):
    cases = {
        "Faculty of Medicine and Dentistry": "Faculty of Medicine & Dentistry",
        "Faculty of Kinesiology, Sport, and Recreation, Faculty of Science, Alberta School of Business":
            "Faculty of Kinesiology Sport and Recreation, Faculty of Science, Alberta School of Business",
        "$2,700.00": None, "1,250.00": None, "Up to $2 000": None, "  ": None,
        "Faculty of Arts or Humanities": "Faculty of Arts or Humanities",
        "College of Science or School of Business": "College of Science, School of Business",
        "Office of the Vice President, Research": "Office of the Vice President Research",
        "Business": "Business", "Faculty of Business": "Alberta School of Business",
    }
    assert values(spark, list(cases), fx.canonical_category("v")) == list(cases.values())


def test_clean_text(spark):
    got = values(spark, ["a\x0bb", "who:\x0b� is in\x0b� is out", "  hello   world  ", "a\r\n\n\n\n b\rc", " \n ", None],
                 text.clean_text("v"))
    assert got == ["a\nb", "who:\nis in\nis out", "hello world", "a\n\nb\nc", None, None]


def test_tokens_cut_at_accents(spark):
    got = values(spark, ["Élève of Café_Bar", "naïve straße"], text.tokenize("v"))
    assert got == [["cafe", "bar"], ["nai", "stra"]]
    full = values(spark, ["Élève of Café_Bar", "naïve straße"], text.tokenize("v", full=True))
    assert full == got
    assert values(spark, ["Café_Bar x"], text.words("v"))[0][0] == "cafe"


def test_slugs(spark):
    assert values(spark, ["Prix d'Excellence É", "", None, "--", "x" * 90], text.slugify("v")) == [
        "prix-d-excellence-e", "unknown", "unknown", "unknown", "x" * 80]


def test_cells(spark):
    row = spark.range(1).select(fx.classify_cells(F.array(*[F.lit(c) for c in (
        "Faculty of Law", "Open", "Ended", "Deadline 01/15/2027", "$1 000 minimum", "other")])).alias("c")).first()[0]
    assert tuple(row) == ("Faculty of Law", "Ended", "$1 000 minimum", "01/15/2027")
    extra = spark.range(1).select(fx.classify_extra_cells(F.array(F.lit("ESSAY REQUIRED"), F.lit("SEPTEMBER 30"))).alias("c")).first()[0]
    assert tuple(extra) == ("SEPTEMBER 30", "ESSAY REQUIRED")


def test_name_prefix(spark):
    df = spark.createDataFrame([("A Prize", "A Prize For all."), ("A Prize", "A Prize"), ("B", "text")], "n string, b string")
    assert [r[0] for r in df.select(fx.strip_name_prefix("n", "b")).collect()] == ["For all.", None, "text"]
