import datetime as dt
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kairograph.functions import temporal, text


def plain_normalize(x):
    return re.sub(r"[^\w\s]", "", x.lower()).strip()


def test_normalize_names(spark):
    names = ["a b", "A B", "a_b", "a-b", "!", "A  b", "\t a\xa0", "½", "it's", "Ünïcode—dash", "", " "]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, x string").select("i", text.normalize(F.col("x")).alias("n"), text.slug(F.col("x")).alias("s")).orderBy("i").collect()
    assert [r.n for r in rows] == [plain_normalize(x) for x in names]
    assert [r.s for r in rows] == [plain_normalize(x).replace(" ", "_") for x in names]


def test_normalize_every_letter_of_the_first_plane(spark):
    known = spark._jvm.java.lang.Character.isDefined  # code points newer than the JVM's tables are no letters to it
    cps = [c for c in range(1, 0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn") and known(c)]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in cps], "c int, x string").select("c", text.normalize(F.col("x")).alias("n")).collect()
    wrong = [r.c for r in rows if r.n != plain_normalize(f"a{chr(r.c)}b")]
    assert not wrong, [hex(c) for c in wrong[:20]]


def test_word_count(spark):
    texts = [None, "", "  ", "a", " a\tb\n c  ", "x\xa0y"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.word_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len((t or "").split()) for t in texts]


@pytest.mark.parametrize("age", [0, 364, 365, 435, 1971, 11315, 19635])
def test_score_rounds_half_to_even(spark, age):
    now = dt.datetime(2025, 1, 1)
    row = spark.range(1).select(temporal.utc(now - dt.timedelta(days=age)).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    got = row.select(temporal.score(temporal.utc(now)).alias("s")).select("s", F.bround("s", 4).alias("r")).first()
    assert got.s == 1 / (1 + age / 365) and got.r == round(got.s, 4)


def test_score_edges_of_its_domain(spark):
    now = dt.datetime(2025, 1, 1)
    cases = [None, now + dt.timedelta(days=365), now + dt.timedelta(seconds=1), now - dt.timedelta(hours=23)]
    rows = spark.createDataFrame([(i, c, None) for i, c in enumerate(cases)], "i int, valid_from timestamp, valid_until timestamp")
    got = [r.s for r in rows.select("i", temporal.score(temporal.utc(now)).alias("s")).orderBy("i").collect()]
    assert got == [None, None, 1 / (1 + -1 / 365), 1.0]


def test_times(spark):
    raw = ["2025-01-10T00:00:00Z", "2025-01-10T09:00:00+09:00", "2025-01-10", "", "no"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, x string").select("i", temporal.iso(temporal.parse_time(F.col("x"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == ["2025-01-10T00:00:00"] * 3 + [None, None]


def test_templates_and_lines(spark):
    row = spark.range(1).select(text.fill("{a} {b} {a}", a=F.lit("x"), b=F.lit("y")).alias("f"), text.numbered_lines(F.array(F.lit("p"), F.lit("q"))).alias("n"), text.first_truthy(F.lit(None).cast("string"), F.lit(""), F.lit("z")).alias("t")).first()
    assert (row.f, row.n, row.t) == ("x y x", '1. "p"\n2. "q"', "z")
