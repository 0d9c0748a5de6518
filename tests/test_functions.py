from pyspark.sql import functions as F

from talentloom.functions import cleaning, text
from talentloom.functions.months import month_number, parse_month
from talentloom.functions.skills import proficiency, spelling_variants
from talentloom.functions.strings import half_even


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expression.alias("y")).first()["y"]


def test_parse_month(spark):
    cases = {
        "2020-03": month_number("2020-03"), " 2020/3 ": month_number("2020-03"), "2020.13": month_number("2020-12"),
        "2020": month_number("2020-01"), "Present": month_number("2024-05"), "": None, "soon": None, "0000-01": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r["x"]: r["m"] for r in df.select("x", parse_month("x", "2024-05").alias("m")).collect()}
    assert got == cases


def test_degree_rules_are_ordered(spark):
    cases = {
        "PhD": "phd", "Master of Science": "master", "BEng": "bachelor", "Associate": "associate",
        "phổ thông": "high_school", "Bootcamp": "other", "": None, "Doctor of Business (MBA)": "phd",
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["d"] for r in df.select("x", cleaning.degree("x").alias("d")).collect()} == cases


def test_min_years(spark):
    cases = {"": 0, "1.2": 2, "3": 3, "abc": 0, "-2": 0, "nan": 0}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", cleaning.min_years("x").alias("y")).collect()} == cases


def test_rounding_follows_the_binary_value(spark):
    df = spark.createDataFrame([(2.675,), (2.25,), (0.35,)], "x double")
    got = [tuple(r) for r in df.select(half_even("x", 2), half_even("x", 1)).collect()]
    assert got == [(round(x, 2), round(x, 1)) for x in (2.675, 2.25, 0.35)]


def test_spelling_variants(spark):
    got = one(spark, " ASP.NET Core ", spelling_variants("x"))
    assert got == ["asp.net core", "asp.net-core", "asp.netcore", "aspnet core", "aspnet-core", "aspnetcore"]


def test_proficiency(spark):
    cases = {
        "JLPT N2": ("jlpt", 4.0), "hsk 5": ("hsk", 5.0), "IELTS 6.5": ("ielts", 6.5), "toeic 835": ("toeic", 835.0),
        "TOEFL iBT 90": ("toefl", 90.0), "french b2": ("cefr", 4.0), "python": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r["x"]: tuple(r["p"]) if r["p"] else None for r in df.select("x", proficiency("x").alias("p")).collect()}
    assert got == cases


def test_weights(spark):
    good = {"semantic": 0.3, "skills": 0.3, "experience": 0.25, "education": 0.1, "location": 0.05}
    rows = [(good,), ({**good, "skills": 0.5},), ({"skills": 1.0},), ({**good, "skills": 1.3, "semantic": -0.7},), (None,)]
    df = spark.createDataFrame(rows, "w map<string,double>")
    assert [r[0] for r in df.select(cleaning.weights_problem("w")).collect()] == [None, "sum", "keys", "range", None]


def test_text_quality_counts_every_signal(spark):
    df = spark.createDataFrame([("",), ("� " * 60,), ("ordinary words here " * 20,)], "x string")
    q = text.text_quality("x")
    got = [tuple(r) for r in df.select(q["score"], q["word_count"]).collect()]
    assert got == [(10, 0), (50, 0), (100, 60)]


def test_filename(spark):
    df = spark.createDataFrame(
        [
            ("https://a/b/cv.pdf?x=1", "", ""),
            ("https://a/b/cv/", "", "application/x-docx"),
            ("https://a/b", 'attachment; filename="my cv.docx"', ""),
        ],
        "u string, d string, c string",
    )
    assert [r[0] for r in df.select(cleaning.filename("u", "d", "c")).collect()] == ["cv.pdf", "cv.docx", "my cv.docx"]


def test_generic_skills(spark):
    df = spark.createDataFrame([("Problem-Solving",), ("Team  Player!",), ("Python",)], "x string")
    assert [r[0] for r in df.select(cleaning.is_generic_skill(F.col("x"))).collect()] == [True, True, False]
