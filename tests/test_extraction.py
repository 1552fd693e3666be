import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quillspark.functions import extraction as X
from quillspark.functions import text as T


def run(spark, column, rows, schema="text string, name string"):
    df = spark.createDataFrame(rows, schema).withColumn("i", F.monotonically_increasing_id()).coalesce(1)
    return [r[0] for r in df.select(column.alias("x"), "i").orderBy("i").collect()]


def test_filename_dates(spark):
    cases = {
        "20250221_377.pdf": "2025-02-21", "2026.05 - X.pdf": "2026-05-01", "2025-3-4 x.pdf": "2025-03-04", "2025_12_31.pdf": "2025-12-31",
        "2025-3-45 x.pdf": "2025-03-01", "20251399-x.pdf": None, "2025 bill.pdf": None, "x 2025-01-01.pdf": None, "20250221x.pdf": None, None: None,
    }
    assert run(spark, X.date_from_filename(F.col("name")), [(None, n) for n in cases]) == list(cases.values())


def test_text_dates(spark):
    cases = {
        "21/02/2025": "2025-02-21", "02/21/2025": "2025-02-21", "45/45/2025 then 1/2/2024": "2024-01-02",
        "Billing Period: Dec 15 - Jan 14, 2026": "2026-12-15", "Invoice 12 2024 then April 8, 2026": "2024-01-01",
        "on April 8 2026": "2026-04-08", "Sept 8, 2026": "2026-01-01", "iso 2024-99-01": "2024-99-01", "tax 1999": "1999-01-01",
        "Date of Birth: 01/02/1970 issued 2024-05-06": "2024-05-06", "nothing": None,
        "dob 01/02/1970" + " " * 300 + "03/04/2020": "2020-03-04",
    }
    assert run(spark, X.date_from_text(F.col("text")), [(t, "") for t in cases]) == list(cases.values())


def test_year_only(spark):
    cases = [("tax form 2021", True), ("on January 1, 2021", False), ("jan. 1 2021", False), ("on 11/1/2021 and 2021", False)]
    got = run(spark, X.year_only(F.lit("2021-01-01"), F.col("text")), [(t, "") for t, _ in cases])
    assert got == [w for _, w in cases]


def test_amounts(spark):
    cases = {
        "Statement Balance: $1,234.56": ("1234.56", False),
        "Credit line S/ 2,800.00\nPAGO  DEL MES (Suma de subtotales) " + "-" * 200 + " = 0.00 0.00": (None, True),
        "Amount due 0.00 and New Balance: 12.5": ("12.5", False),
        "paid $55.10": ("55.10", False),
        "paid $0.50 then $9.00": (None, False),
        "amount due: , then": (None, False),
        "none": (None, False),
        "DEUDA TOTAL (x) === 77": ("77", False),
    }
    assert [tuple(r) for r in run(spark, X.amount(F.col("text")), [(t, "") for t in cases])] == list(cases.values())


def test_currency(spark):
    cases = {"$1 $2 €3": "$", "€1 $1": "$", "S/ 1 S/.2 $3": "S/", "12 € 13€ $1": "€", "£5": "£", "": "$", "€1 £1": "€"}
    assert run(spark, X.currency(F.col("text")), [(t, "") for t in cases]) == list(cases.values())


def test_account_owner_issuer(spark):
    cases = {
        "Account number: 123456": ("123456", False, 6), "acct # 12-3456": ("3456", True, 4), "card ending in 1234": ("1234", True, 4),
        "last 3 digits: 123": ("123", True, 3), "xx**987": ("987", True, 3), "nothing": (None, False, 0),
    }
    assert [tuple(r) for r in run(spark, X.account(F.col("text")), [(t, "") for t in cases])] == list(cases.values())
    owners = {"Dear John Smith, hi": "John Smith", "Cardholder: Mary": "Mary", "dear john": None}
    assert run(spark, X.owner(F.col("text")), [(t, "") for t in owners]) == list(owners.values())
    issuers = {"AT&T bill": "AT&T", "in seattle": None, "purchase": None, "chaseonline": "Chase", "x" * 1600 + " chase": "Chase", "y" * 1600 + " chase" + "z" * 1100: None}
    known = {"att": "AT&T", "chase": "Chase", "chase gold": "Chase Gold"}
    assert run(spark, X.issuer(F.col("text"), F.col("name"), known), [(t, "") for t in issuers]) == list(issuers.values())
    assert run(spark, X.issuer(F.col("text"), F.col("name"), known), [("the chase gold", ""), ("", "2020 Chase.pdf")]) == ["Chase Gold", "Chase"]


LABEL = re.compile(X.BIRTH_LABEL, re.I)
DATE = re.compile(X.BIRTH_DATE)


def blanked(text):
    labels = [m.start() for m in LABEL.finditer(text)]
    near = lambda m: any(abs(m.start() - p) <= 200 for p in labels)
    return DATE.sub(lambda m: " " * len(m[0]) if near(m) else m[0], text)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["dob", "1/2/1970", "11-12-2001", "born on", "x" * 90, " ", "é", "3/4/20"]), max_size=12).map("".join), min_size=1, max_size=12))
def test_birth_dates_against_python(spark, texts):
    assert run(spark, X.without_birth_dates(F.col("text")), [(t, "") for t in texts]) == [blanked(t) for t in texts]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", "b")], "text string, name string").select(X.metadata(F.col("text"), F.col("name")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_names_and_hash(spark):
    names = {"a.b.pdf": ("a.b", ".pdf"), ".pdf": (".pdf", ""), "x": ("x", "")}
    for n, want in names.items():
        assert tuple(run(spark, F.struct(T.stem(F.col("name")), T.suffix(F.col("name"))), [("", n)])[0]) == want
    assert run(spark, T.confidence(F.col("text")), [("x" * 2500, ""), (None, ""), ("x" * 9999, "")]) == [0.5, 0.0, 1.0]
    assert run(spark, T.control_free(F.col("text")), [("a\x00b\tc\x0bd", "")]) == ["ab\tcd"]
