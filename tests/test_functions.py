"""Known values, errors and coercion of worksheet functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.functions import fn

D = dt.date
NUMBERS = {
    "round": (lambda: fn.ROUND(-2.5, 0), -3.0),
    "mround": (lambda: fn.MROUND(10, 3), 9.0),
    "mod_sign": (lambda: fn.MOD(-3, 2), 1.0),
    "combin": (lambda: fn.COMBIN(8, 2), 28.0),
    "gcd": (lambda: fn.GCD(24, 36), 12.0),
    "pmt": (lambda: fn.PMT(0.08 / 12, 10, 10000), -1037.0320893591636),
    "fv": (lambda: fn.FV(0.06 / 12, 10, -200, -500, 1), 2581.4033740601195),
    "nper": (lambda: fn.NPER(0.01, -100, -1000, 10000, 1), 59.67386567),
    "sln": (lambda: fn.SLN(30000, 7500, 10), 2250.0),
    "ddb": (lambda: fn.DDB(2400, 300, 10, 1, 2), 480.0),
    "price": (lambda: fn.PRICE(D(2008, 2, 15), D(2017, 11, 15), 0.0575, 0.065, 100, 2, 0), 94.63436162132213),
    "yield": (lambda: fn.YIELD(D(2008, 2, 15), D(2016, 11, 15), 0.0575, 95.04287, 100, 2, 0), 0.065000006880768),
    "duration": (lambda: fn.DURATION(D(2018, 7, 1), D(2048, 1, 1), 0.08, 0.09, 2, 1), 10.9191452815919),
    "norm_s_dist": (lambda: fn.NORM_S_DIST(1.333333, True), 0.9087887256),
    "norm_inv": (lambda: fn.NORM_INV(0.908789, 40, 1.5), 42.000002),
    "binom": (lambda: fn.BINOM_DIST(6, 10, 0.5, False), 0.205078125),
    "poisson": (lambda: fn.POISSON_DIST(2, 5, True), 0.12465201948308),
    "t_dist_2t": (lambda: fn["T.DIST.2T"](1.959999998, 60), 0.0546449),
    "gammaln": (lambda: fn.GAMMALN(4.5), 2.453736571),
    "erf": (lambda: fn.ERF(0.745), 0.707928920),
    "besselj": (lambda: fn.BESSELJ(1.9, 2), 0.329925829),
    "hex2dec": (lambda: fn.HEX2DEC("FFFFFFFF5B"), -165.0),
    "convert": (lambda: fn.CONVERT(1, "lbm", "kg"), 0.45359237),
    "arabic": (lambda: fn.ARABIC("LVII"), 57.0),
    "blank_is_zero": (lambda: fn.ABS(F.lit(None).cast("string")), 0.0),
    "text_number": (lambda: fn.ABS("-3"), 3.0),
    "yearfrac": (lambda: fn.YEARFRAC(D(2012, 1, 1), D(2012, 7, 30)), 0.58055556),
    "networkdays": (lambda: fn.NETWORKDAYS(D(2012, 10, 1), D(2013, 3, 1)), 110.0),
    "weeknum": (lambda: fn.WEEKNUM(D(2012, 3, 9)), 10.0),
    "find": (lambda: fn.FIND("M", "Miriam McGovern", 3), 8.0),
    "iferror": (lambda: fn.IFERROR(fn.LN(-1), 7), 7.0),
}
TEXTS = {
    "div0": (lambda: fn.QUOTIENT(1, 0), "#DIV/0!"),
    "num": (lambda: fn.SQRT(-1), "#NUM!"),
    "value": (lambda: fn.ABS("x"), "#VALUE!"),
    "first_error_wins": (lambda: fn.POWER(fn.SQRT(-1), fn.ABS("x")), "#NUM!"),
    "na": (lambda: fn.IFNA(fn.NA(), "none"), "none"),
    "proper": (lambda: fn.PROPER("2-way street"), "2-Way Street"),
    "roman": (lambda: fn.ROMAN(499, 0), "CDXCIX"),
    "base": (lambda: fn.BASE(15, 2, 10), "0000001111"),
    "substitute": (lambda: fn.SUBSTITUTE("Quarter 1, 2008", "1", "2", 1), "Quarter 2, 2008"),
    "textbefore": (lambda: fn.TEXTBEFORE("a-b-c", "-"), "a"),
    "imsum": (lambda: fn.IMSUM("3+4i", "5-3i"), "8+i"),
    "if_blank": (lambda: fn.IF(False, "a", "b"), "b"),
    "dec2bin": (lambda: fn.DEC2BIN(9, 4), "1001"),
    "address": (lambda: fn.ADDRESS(2, 3), "$C$2"),
}


@pytest.mark.parametrize("name", NUMBERS)
def test_number(spark, name):
    make, want = NUMBERS[name]
    x = make()
    got = spark.range(1).select(x.value.cast("double").alias("v"), x.struct()["error"].alias("e")).first()
    assert got.e is None and got.v == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("name", TEXTS)
def test_text(spark, name):
    make, want = TEXTS[name]
    assert spark.range(1).select(make().shown().alias("v")).first().v == want


def test_scripts_in_order_and_depreciation_errors(spark):
    texts = {"가あ": "ko", "あ中": "ja", "中a": "zh", "да": "ru", "ab": "en", "12": "und", "": "und"}
    made = [fn.DETECTLANGUAGE(t).shown().alias(f"t{i}") for i, t in enumerate(texts)]
    day, later = D(2020, 1, 1), D(2020, 12, 31)
    for f in (fn.AMORLINC, fn.AMORDEGRC):
        wrong = [(0, day, later, 0, 1, 0.2, 0), (100, day, later, -1, 1, 0.2, 0), (100, day, later, 100, 1, 0.2, 0), (100, later, later, 0, 1, 0.2, 0), (100, day, later, 0, 1, 0.2, 2)]
        made += [f(*args).shown().alias(f"e{len(made) + i}") for i, args in enumerate(wrong)]
    got = list(spark.range(1).select(*made).first())
    assert got[: len(texts)] == list(texts.values()) and set(got[len(texts) :]) == {"#NUM!"}
