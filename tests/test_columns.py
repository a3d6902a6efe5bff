import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.fixed import Weights
from gaugeworks.functions import columns as C


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_timestamps(spark):
    rows = ["1704067200", "05.02.2024 10:11:12", "5.2.2024 10:11", "05.02.2024", "2024-02-05 10:11:12", "2024-02-05", "05/02/2024", "13/02/2024 01:02:03", "02/13/2024", "2024-02-05T10:11:12Z", "2024-02-05T10:11:12+03:00", "soon", "", None, "999"]
    got = values(spark, rows, lambda c: F.date_format(C.parse_ts(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-01 00:00:00", "2024-02-05 10:11:12", "2024-02-05 10:11:00", "2024-02-05 00:00:00", "2024-02-05 10:11:12", "2024-02-05 00:00:00", "2024-02-05 00:00:00", "2024-02-13 01:02:03", "2024-02-13 00:00:00", "2024-02-05 10:11:12", "2024-02-05 07:11:12", None, None, None, None]


def test_codes(spark):
    rows = ["C6000", " c-6000 ", "error: SC543", "Ошибка J1234 (lot)", "75-530-00", "see 07-535-00!", "75 530 00", "X1", "", None]
    assert values(spark, rows, C.norm_code) == ["C6000", "C6000", "SC543", "J1234", "75-530-00", "07-535-00", None, None, None, None]
    assert values(spark, ["75 530 00", "75_530_00"], lambda c: C.norm_code(c, lenient=True)) == ["75-530-00", "75-530-00"]


@pytest.mark.parametrize("text,expected", [("45", 45), ("0.5", 0), ("1.5", 2), ("2.5", 2), ("-3", 0), ("5000", 100), ("bad", None), ("nan", None), (None, None)])
def test_levels(spark, text, expected):
    assert values(spark, [text], C.coerce_level) == [expected]


def test_severity_words(spark):
    assert values(spark, ["MAJOR", " minor", "Warning", "critical", "odd", None], C.coerce_severity) == ["High", "Low", "Medium", "Critical", None, None]


def test_coefficients(spark):
    w = Weights()
    assert values(spark, [0, 1, 2, 4, 1000], lambda c: F.round(C.coef_r(c, w), 4), "int") == [1.0, 1.0, 2.0, 3.0, 5.0]
    assert values(spark, [[], [1.2], [1.5, 1.3]], lambda c: F.round(C.coef_c(c, w), 4), "array<double>") == [1.0, 1.2, 1.5]
    assert values(spark, [0, 14], lambda c: F.round(C.coef_a(c, w), 4), "int") == [1.0, 0.3679]
    assert values(spark, ["Critical", "High", "odd", None], lambda c: C.weight_s(c, w)) == [60.0, 20.0, 10.0, 10.0]
    assert values(spark, [100, 75, 74, 40, 39], lambda c: C.zone(c, w), "int") == ["green", "green", "yellow", "yellow", "red"]
    assert values(spark, [0.85, 0.6, 0.59], C.confidence_zone, "double") == ["high", "medium", "low"]


def test_text(spark):
    assert values(spark, ["un-\nknown  x\ty\x01z\n\n\n\nend ", "слово-\nформа"], C.clean_text) == ["unknown x\ty z\n\nend", "словоформа"]
    assert values(spark, ["call +7 (912) 345-67-89 or a.b@c.de"], C.redact_personal) == ["call [PHONE] or [EMAIL]"]
    assert values(spark, ["C1234 e100 SC543 err-777 ERR-777 12-345-67"], C.codes_in) == [["12-345-67", "C1234", "C543", "ERR-777", "SC543"]]
    assert values(spark, ["OPC drum and Печка", "nothing"], C.components_in) == [["drum", "fuser"], []]
    assert values(spark, ["Xerox AltaLink B8090", "", None], C.model_slug) == ["altalink_b8090", "unknown", "unknown"]


def test_redaction_takes_steps_in_proportion_to_a_run(spark):
    """The same as the plain pattern, also behind a match inside a run; a long run without an address ends soon."""
    plain = (C.PERSONAL[0][:2], (r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]"))
    texts = ["a@b.c+d@e.f", "x@y", "@a.b", "a.b@c-d.e.f, +7 (912) 345-67-89 q@w.e", "é@ü.ß-@z.z", "a@b@c.d", "+7 9123456789@mail.ru", "a@@b.c", "a+@b.c@d.e+f@g.h", "", None, "日本@語.jp日+本@a.b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(C.redact_personal(F.col("t")).alias("a"), C.redact_personal(F.col("t"), plain).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] == "[EMAIL][EMAIL]"
    start = time.monotonic()
    assert spark.range(1).select(F.concat(F.repeat(F.lit("x"), 300_000), F.lit(" a@b.c")).alias("t")).select(F.right(C.redact_personal(F.col("t")), F.lit(8)).alias("t")).first()["t"] == "x [EMAIL]"[1:]
    assert time.monotonic() - start < 20


def test_components_lower_a_text_once(spark):
    rows = spark.createDataFrame([("The FUSER Unit and ITB",), ("",), (None,), ("Тонер, wi-fi",)], "t string")
    out = rows.select(C.components_in(F.col("t")).alias("c"))
    assert [r["c"] for r in out.collect()] == [["fuser", "transfer"], [], [], ["network", "toner"]]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 1
