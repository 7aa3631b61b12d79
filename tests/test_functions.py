from pyspark.sql import functions as F

from lexgrid.functions import dates, ids
from lexgrid.functions import text as T


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column).first()[0]


def test_codes_with_lists(spark):
    assert one(spark, ids.codes(F.col("s")), s="x FF 2023 1; 2023 22; RU 1999 3") == ["FF 2023 1", "FF 2023 22", "RU 1999 3"]
    assert one(spark, ids.codes(F.col("s")), s="RS 0.101.09 and XRU 1 2") == ["RS 0.101.09"]


def test_roman_and_uris(spark):
    for roman, value in (("XIV", 14), ("MCMXCIX", 1999), ("IZ", None), ("", 0)):
        assert one(spark, ids.roman_value(F.col("s")), s=roman) == value
    for tail, code in (("/cc/1974/2151_2151_2151", "RS 1974 2151"), ("/cc/2003/396", "RS 2003 396"), ("/cc/1/116_97_116", "RS 1 116"), ("/cc/1950/__630", "RS 1950 630"), ("bad.uri/format", "UNKNOWN_URI_FORMAT")):
        assert one(spark, ids.act_code(F.col("s"), "cc", "RS"), s=tail) == code


def test_file_names(spark):
    get = lambda name, category: spark.createDataFrame([(name, category)], "n string, c string").select(ids.file_code(F.col("n"), F.col("c"), ["concessioni"])).first()[0]
    assert get("act-2001-12_34_56.pdf", "Leggi") == "RU 2001 56"
    assert get("x-1999-7.pdf", "CONCESSIONI") == "FF 1999 7"
    assert get("other.pdf", "Leggi") == "other.pdf"


def test_annex_of_file_name(spark):
    annex, parent = ids.annex(F.col("s"))
    assert one(spark, annex, s="RU 1998 2847_Allegato_1.json") == "RU 1998 2847_Allegato_1"
    assert one(spark, parent, s="RU 1998 2847_Allegato_1.json") == "RU 1998 2847"


def test_context_window(spark):
    text = "a" * 150 + " [FN_1] " + "b" * 150
    assert one(spark, T.context(F.col("s"), F.lit("[FN_1]")), s=text) == "a" * 99 + " [FN_1] " + "b" * 99
    assert one(spark, T.context(F.col("s"), F.lit("[FN_2]")), s="whole") == "whole"


def test_array_statistics(spark):
    assert one(spark, T.median(F.col("v")), v=[3.0, 1.0, 2.0]) == 2.0
    assert one(spark, T.median(F.col("v")), v=[4.0, 1.0]) == 2.5
    assert one(spark, T.median(F.col("v")), v=[]) is None
    assert one(spark, T.deviation(F.col("v")), v=[1.0, 3.0]) == 2**0.5


def test_clean_and_dates(spark):
    for raw, value in (("  x ", "x"), (" ", None), ("nan", None), ("", None)):
        assert one(spark, T.clean(F.col("s")), s=raw) == value
    assert one(spark, dates.italian(dates.iso(F.col("s"))), s="1999-04-18 00:00") == "18 aprile 1999"
    assert one(spark, dates.iso(F.col("s")), s="18.4.1999") is None
