from pyspark.sql import functions as F

from tallyweave import presets
from tallyweave.functions import columns as C
from tallyweave.functions import expressions as X


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,), ("25.7",), (" 8 ",), ("-3",)], "a string")
    assert values(df, X.as_int("a")) == [5, None, None, 25, 8, -3]
    assert values(df, X.as_double("a")) == [5.0, None, None, 25.7, 8.0, -3.0]


def test_padded_code_cuts_long_codes_and_keeps_null(spark):
    df = spark.createDataFrame([("1",), ("01",), ("1701",), (None,)], "a string")
    assert values(df, X.padded_code("a", 2)) == ["01", "01", "17", None]
    ints = spark.createDataFrame([(170150,)], "a int")
    assert values(ints, X.parent_code(X.padded_code("a", 6), 4)) == ["1701"]


def test_code_comparison_with_numbers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert values(df, X.flag(X.code_is("a", "1"))) == [1, 0, 0]


def test_regex_ignores_case(spark):
    df = spark.createDataFrame([("Educacion SUPERIOR",), ("post-grado",), ("nada",), (None,)], "a string")
    assert values(df, X.flag(X.matches_any("a", presets.HIGHER_EDUCATION))) == [1, 1, 0, 0]


def test_bands_are_half_open(spark):
    df = spark.createDataFrame([(14,), (15,), (119,), (120,), (None,)], "a int")
    got = values(df, X.in_bands(F.col("a"), presets.AGE_BANDS))
    assert got == ["MENOR_15", "JOVEN_15_24", "ADULTO_MAYOR_65", None, None]


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ID_VIV int, nivel_Educacion int, es_x int")
    assert C.present(df, ["a", "es_x"]) == ["es_x"]
    assert C.first_present(df, ["a"]) is None
    assert C.containing(df.columns, ["educacion"]) == ["nivel_Educacion"]
    assert C.containing(["dependientes_hogar", "es_x"], ["es_"]) == ["dependientes_hogar", "es_x"]
    assert C.starting(["dependientes_hogar", "es_x"], ["es_"]) == ["es_x"]
    assert C.renamed({"ID_VIV": "viv", "falta": "f"}, df.columns) == ["`ID_VIV` AS `viv`"]
