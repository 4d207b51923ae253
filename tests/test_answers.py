"""Golden rows for answer extraction, normalization and matching, derived by hand."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import text as T

FINAL = [
    (r"The answer is \boxed{42}.", "42"),
    (r"so x = \boxed{\frac{1}{2}}", "1/2"),
    ("Steps\n#### 1,234", "1,234"),
    ("The answer is 3.14", "3"),
    ("also 7 apples", "7"),
    ("x = 5", "5"),
    ("5-3", "-3"),
    ("Paris\nFrance", "France"),
    ("", None),
    ("   ", None),
    (r"cost \$5", "5"),
    ("1/3", "1/3"),
    ("1/0", "1/0"),
    ("0.30000000000000004", "0.30000000000000004"),
    ("1e5", "5"),
    ("nan", "nan"),
    ("Answer: A", "A"),
    ("therefore the answer is\n12", "the answer is"),
    ("a = b = 9", "9"),
    ("12.", "12"),
    (r"\text{Yes}", "Yes"),
    ("x^2+1", "+1"),
    (r"\boxed{}", r"\boxed{}"),
    ("answer is  .\nq", ""),
    (r"\boxed{1} then \boxed{2}", "2"),
    ("a #### b #### c", "c"),
    (None, None),
    ("first second\x85third", "third"),
    ("FINAL ANSWER = 12 kg", "12"),
]

NORMAL = [
    ("1,234", "1234"),
    ("2.0", "2"),
    ("-0.0", "0"),
    ("1/3", "0.3333333333"),
    ("0.30000000000000004", "0.3"),
    ("1/0", "1/0"),
    ("nan", "nan"),
    ("Answer: A", "a"),
    ("x^2+1", "1"),
    ("", None),
    (r"\boxed{\frac{1}{2}}", "0.5"),
    ("0.5", "0.5"),
    ("#### 1,234", "1234"),
    ("The answer is 7", "7"),
    ("0.3333333", "0.3333333"),
    (r"\boxed{1e5}", "100000"),
    (r"\boxed{2.5e-7}", "2.5e-07"),
    (r"\boxed{ x = Y. }", "x = y"),
    (r"\boxed{1_000}", "1000"),
    (r"\boxed{5d}", "5d"),
    (r"\boxed{infinity}", "infinity"),
    (r"\boxed{1e999}", "1e999"),
    (r"\boxed{3.5/2}", "3.5/2"),
    (r"\boxed{6 / 4}", "1.5"),
    (r"\boxed{(1/2)}", "(1/2)"),
    ("123456.7890123", "123456.789"),
    ("12345678901.5", "1.23456789e+10"),
    ("2432902008176640000", "2432902008176640000"),
    ("12345678901234567890", "12345678901234567168"),
    ("123456789012345678901234567890", str(int(float("123456789012345678901234567890")))),
    (r"\boxed{A   B,C}", "a bc"),
]

MATCH = [
    (r"\boxed{\frac{1}{2}}", ["0.5"], True),
    ("#### 1,234", ["1234"], True),
    ("The answer is 7", ["8", "7"], True),
    ("0.3333333", ["1/3"], True),
    ("0.333", ["1/3"], False),
    (None, ["1"], False),
    ("1", [], False),
    ("1", None, False),
    ("1", [None, "1"], True),
    ("", [""], False),
]

EXTRACT = [
    (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"),
    (r"\boxed{}", ""),
    ("The answer is: $5$.", "5"),
    ("no result", ""),
    (r"\boxed{a} and \boxed{b{c}d{e}}", "b{c}d{e}"),
    (r"\boxed{a{b{c}}} answer: 4", "4"),
    ("the  answer\nis x, answer y\nanswer", "x, answer y"),
]


def _wrong(spark, rows, expression):
    df = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(rows)], "i int, t string, e string")
    got = df.withColumn("got", expression("t"))
    return got.filter(~F.col("got").eqNullSafe(F.col("e"))).select("t", "e", "got").collect()


def test_final_answer(spark):
    assert _wrong(spark, FINAL, A.extract_final_answer) == []


def test_normalize(spark):
    assert _wrong(spark, NORMAL, A.normalize_answer) == []


def test_normalized_numbers_are_stable(spark):
    def boxed(column):
        return F.concat(F.lit(r"\boxed{"), column, F.lit("}"))

    numbers = spark.range(2000).select((F.rand(7) * F.pow(10.0, F.col("id") % 19 - 9)).cast("string").alias("t"))
    once = numbers.select(A.normalize_answer(boxed("t")).alias("a"))
    twice = once.select("a", A.normalize_answer(boxed("a")).alias("b"))
    assert twice.filter("a <> b").count() == 0


def test_ten_digits_as_python_prints_them(spark):
    rows = spark.range(3000).select((F.randn(3) * F.pow(10.0, F.col("id") % 40 - 20)).alias("x"))
    got = rows.select("x", A.ten_digit_text(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [f"{r.x:.10g}" for r in got]


def test_ten_digits_of_ties_and_their_neighbours(spark):
    import random
    from math import nextafter

    draw = random.Random(1)
    ties = [draw.randrange(10**9, 10**10) + 0.5 for _ in range(200)] + [12345678.125, 12345678.375, 0.5, 2.5, 1e9 + 0.5]
    ties += [draw.randrange(10**9, 10**10) / 10**k + 5 / 10 ** (k + 1) for k in range(1, 19) for _ in range(60)]
    ties += [(2 * draw.randrange(2**20) + 1) / 2**k for k in range(1, 40) for _ in range(10)]
    ties += [10.0**k for k in range(-9, 16)] + [9.9999999995 * 10.0**k for k in range(-9, 15)]
    values = [s * v for x in ties for v in (nextafter(x, 0), x, nextafter(x, 1e300)) for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", A.ten_digit_text(F.col("x")).alias("s")).collect()
    assert [(r.x, r.s) for r in got if r.s != f"{r.x:.10g}"] == []


def test_whole_numbers_of_any_size(spark):
    values = [s * x for e in range(0, 309, 3) for x in (float(f"1e{e}"), float(f"7.3{e:03d}1e{e}")) for s in (1, -1)]
    values = [float(int(v)) for v in values if abs(v) < 1.79e308] + [2.0**63, 2.0**62, 9.0e18, 1.7976931348623157e308, 2.0**1023]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", A.whole_number_text(F.col("x")).alias("s")).collect()
    assert [(r.x, r.s) for r in got if r.s != str(int(r.x))] == []
    for text, whole in ((r"\boxed{1e38}", "99999999999999997748809823456034029568"), (r"\boxed{12345678.125}", "12345678.12")):
        assert spark.range(1).select(A.normalize_answer(F.lit(text)).alias("a")).first().a == whole


@pytest.mark.parametrize("text,targets,expected", MATCH)
def test_match(spark, text, targets, expected):
    df = spark.createDataFrame([(text, targets)], "t string, g array<string>")
    assert df.select(A.answers_match("t", "g")).first()[0] is expected


def test_extract(spark):
    df = spark.createDataFrame(EXTRACT, "t string, e string")
    got = [r.g for r in df.select(A.extract_answer("t").alias("g")).collect()]
    assert got == [e for _, e in EXTRACT]


def test_extract_survives_many_nested_groups(spark):
    body = "{x}" * 50000
    df = spark.createDataFrame([(r"\boxed{" + body + "}",)], "t string")
    assert df.select(A.extract_answer("t")).first()[0] == body


def test_clean(spark):
    rows = ["$ x $", " : $5$ ", "::y", "$:$z", ""]
    expected = []
    for r in rows:
        s = r.strip().strip("$").strip()
        expected.append(s.lstrip(":").strip().strip("$").strip())
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r.g for r in df.select(A.clean_answer("t").alias("g")).collect()] == expected


def test_strip_equals_python(spark):
    texts = [c + "a" + c + "b" + c for c in map(chr, range(1, 0x3002)) if not 0xD800 <= ord(c) < 0xE000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.strip("t").alias("s"), T.words("t").alias("w"), T.lines("t").alias("l")).collect()
    assert all(r.s == r.t.strip() for r in got)
    assert all(r.w == r.t.split() for r in got)
    for r in got:
        # splitlines() drops a final empty line
        assert (r.l[:-1] if r.l[-1] == "" else r.l) == r.t.splitlines()


@pytest.mark.parametrize(
    "value,expected",
    [('["4","5"]', ["4", "5"]), ('"x"', ["x"]), ('""', None), ("null", None), ("[4, 5.5]", ["4", "5.5"]), ("7", ["7"]),
     ('"[0, 1)"', ["[0, 1)"]), ('"[4"', ["[4"]), ('"[a] x"', ["[a] x"]), ('"[0,1]"', ["[0,1]"]), ("[]", [])],
)
def test_mixed_targets(spark, value, expected):
    df = spark.createDataFrame([(value,)], "t string").select(F.parse_json("t").alias("t"))
    assert df.select(A.target_array("t").alias("g")).first().g == expected


def test_digits_of_any_script(spark):
    df = spark.createDataFrame([("٣",), ("१२.५",), ("３/４",), ("x",)], "t string")
    assert [r.n for r in df.select(A.to_number("t").alias("n")).collect()] == [3.0, 12.5, 0.75, None]
    assert df.select(A.answers_match(F.lit("٣"), F.array(F.lit("3"))).alias("m")).first().m


def test_plain_integers_take_the_short_way_and_others_do_not(spark):
    texts = ["0", "-0", "007", "-12", "+12", "999999999999999", "1234567890123456", "12\n", "1,234", "٣", "So \\boxed{12}", "ÀB c", None]
    want = ["0", "0", "7", "-12", "12", "999999999999999", "1234567890123456", "12", "1234", "3", "12", "àb c", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", A.normalize_answer("t").alias("n"), A.normal_form("t").alias("f"), A.normal_form("t")["normal"].alias("only")).orderBy("i").collect()
    assert [r.n for r in rows] == [r.f.normal for r in rows] == [r.only for r in rows] == want
    assert [r.f.number for r in rows][:11] == [0, 0, 7, -12, 12, 999999999999999, 1234567890123456, 12, 1234, 3, 12]
    plan = df.select(A.normalize_answer("t").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[1-9][0-9]{0,14}" in plan  # and not every step for a text that is its own normal form
