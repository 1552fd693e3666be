"""Birth dates of texts in ASCII, by one pass for labels and one for dates."""

import re

from pyspark.sql import functions as F

from quillspark.functions import extraction as X

LABEL, DATE = re.compile(X.BIRTH_LABEL, re.I), re.compile(X.BIRTH_DATE)


def blanked(text):
    labels = [m.start() for m in LABEL.finditer(text)]
    return DATE.sub(lambda m: " " * len(m[0]) if any(abs(m.start() - p) <= 200 for p in labels) else m[0], text)


def test_one_pass_each_gives_the_same(spark):
    texts = ["", "DOB 1/2/1970", "1/2/19703-4-1980 d.o.b.", "Date \t of\nbirth" + "x" * 190 + "11/12/2001" + " " * 200 + "3/4/1980", "born on" + "y" * 193 + "1/2/1970 1/2/1970", "no label 1/2/1970"]
    texts += ["dob\x001/2/1970", "é DOB 1/2/1970", "birth  date" * 3 + "3/4/1980" * 3]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.select(X.without_birth_dates(F.col("text"))).collect()] == [blanked(t) for t in texts]
    simple = rows.where(~F.contains("text", F.lit(X.MARK)) & (F.length("text") == F.octet_length("text")))
    assert all(r[1] == blanked(r[0]) for r in simple.select("text", X._blanked_ascii(F.col("text"))).collect())
