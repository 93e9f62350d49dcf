"""texts that a JavaScript date accepts (in UTC), checked by hand."""

from pyspark.sql import functions as F

from botlens.functions.dates import parse_js_date

DAY, NOON = "2024-03-07 00:00:00", "2024-03-07 13:05:09"
TEXTS = {
    "2024-03-07": DAY, "2024-03-07T13:05:09Z": NOON, "2024-03": "2024-03-01 00:00:00",
    "March 7, 2024": DAY, "march 7 2024": DAY, "Mar. 7, 2024": DAY, "Thu, Mar 7, 2024": DAY, "7 March 2024": DAY,
    "07-Mar-2024 13:05:09": NOON, "2024 Mar 7": DAY, "2024/3/7": DAY, "3/7/2024": DAY, "3-7-2024": DAY, "3/7/24": DAY,
    "3/7/99": "1999-03-07 00:00:00", "3/7/2024 1:05:09 PM": NOON, "3/7/2024, 1:05:09 pm": NOON,
    "March 7, 2024 12:00 AM": DAY, "March 7, 2024 12:30 PM": "2024-03-07 12:30:00",
    "Thu, 07 Mar 2024 13:05:09 GMT": NOON, "Thu Mar 07 2024 13:05:09 GMT+0000 (Coordinated Universal Time)": NOON,
    "Thu Mar 07 2024 15:05:09 GMT+0200": NOON, "Mar 7 2024 08:05:09 EST": NOON, "Mar 7 2024 18:35:09 +05:30": NOON,
    "Mar 7 2024 24:00": "2024-03-08 00:00:00", "Mar 7 2024 13:05:09.25": "2024-03-07 13:05:09.250000",
    "February 30, 2024": "2024-03-01 00:00:00", "  March   7,2024 ": DAY,
    "not a date": None, "": None, "13/7/2024": None, "March 32, 2024": None, "0 March 2024": None, "March 7": None,
    "Mar 7 2024 25:00": None, "Mar 7 2024 12:61": None, "Mar 7 2024 13:00 PM": None, "Mar 7 2024 24:01": None,
    "tomorrow": None, "Smarch 7, 2024": None, "7 March 2024 x": None, "12:30": None,
}


def test_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: None if r.at is None else str(r.at) for r in df.select("t", F.col("t").alias("u"), parse_js_date(F.col("t")).alias("at"))
           .select("t", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).collect()}
    want = {t: None if v is None else (v if "." in v else v + ".000000") for t, v in TEXTS.items()}
    assert got == want


def test_null_stays_null(spark):
    assert spark.range(1).select(parse_js_date(F.lit(None).cast("string")).alias("a")).first().a is None
