import hashlib
import hmac
from decimal import Decimal

from pyspark.sql import functions as F

from botlens.functions import exprs as X


def test_helpers(spark):
    df = spark.createDataFrame([("  ab ﻿", "hello", 3, 1), ("\U0001F600", "x", 1, 32), ("@Foo ", "", 0, 0)],
                               "s string, m string, c long, p long")
    r = df.select(X.js_trim("s").alias("t"), X.utf16_length("s").alias("n"),
                  X.normalize_username("s").alias("u"), X.hmac_sha256_hex("m", "k").alias("h"),
                  X.pct_change("c", "p").alias("pct")).collect()
    assert r[0].t == "ab" and r[1].n == 2 and r[2].u == "foo"
    assert r[0].h == hmac.new(b"k", b"hello", hashlib.sha256).hexdigest()
    assert [x.pct for x in r] == [Decimal("200.00"), Decimal("-96.88"), Decimal("0.00")]


def test_fallback_params(spark):
    df = spark.createDataFrame([("payment", "Payment of 12.30 USD"), ("message", "Message received from 7"),
                                ("user_joined", "nope"), ("other", "x")], "t string, d string")
    code, params = X.activity_fallback("t", "d")
    r = df.select(code.alias("c"), params.alias("p")).collect()
    assert [(x.c, x.p) for x in r] == [("payment.received", '{"amount":12.3,"currency":"USD"}'),
                                      ("message.received", '{"user":"7"}'), ("user.joined", "{}"),
                                      ("other", "{}")]
    assert F is not None
