import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from quillspark.llm import private
from quillspark.llm.queries import OP13_SQL, op13_private_data

#: The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(kind, m.group())]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found))


def card(rng, n=16):
    body = [rng.randrange(10) for _ in range(n - 1)]
    return next(c for x in range(10) if passes("card", c := "".join(map(str, [*body, x]))))


ODD = [
    None, "", "a@b.c%x@d.e", "x@y", "é.a@b.co.uk.", "a.b+c%d@e-f.g..h@i.j", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.0003.255 1.2.3", "99999999999999999999.1.1.1",
    "4417744280351547", "4417 7442-8035 1547", "4417  7442 8035 1547", "4417744280351547 161.17.88.162 +1 (487) 555-7209", "1 4417744280351547", "+1", "+1 2", "+12 (345) 678-90--1",
    "+1 555 555 5555+44 20 7946 0958", "+(1) 222", "a+1.2.3.4.5.6.7.8.9.0.1", "١٢٣ 😀 10.0.0.1 😀 j@k.lm", "5" * 5000, "1 " * 5000, "1.1.1.1 " * 3000, "a@b.c " * 3000, "+1 2345678901 " * 600,
]


def soup(seed, n=300):
    rng = random.Random(seed)
    bits = ["a", "b@", "@", ".", "c.d", "1", "23", "255", "256", " ", "-", "+", "(", ")", "+1 ", "4417744280351547", "é", "\n", "%", "x@y.z", "10.1.1.1", "  "]
    return ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(n)]


def planted(seed=0, kinds=60):
    """Texts in which words before an identifier tell what it is, for base strings and for others."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["sun", "moon", "tree", "lake", "stone", "bird", "road", "hill"]) + rng.choice(["s", "", "ly"])
    out = []
    for i in range(kinds):
        digits = "".join(str(rng.randrange(10)) for _ in range(7))
        say = {
            "dial number": (f"+1 (017) {digits[:3]}-{digits[3:]}", f"555 {digits[:3]} {digits[3:]}"),
            "card number:": (card(rng), f"4{digits}{digits}1"),
            "from host": (f"10.{i}.{rng.randrange(256)}.9", f"10.{i}.300.{rng.randrange(256)}"),
            "write to": (f"who{i}@mail.example.com", f"who{i} (at) mail (dot) example"),
        }
        for lead, (known, unseen) in say.items():
            out.append(f"{word()} {word()} {lead} {known} {word()} {word()}.")
            if i % 8 == 0:
                out.append(f"{word()} {lead} {unseen} {word()} {word()}")
        out.append(f"{word()} of {rng.randrange(10**7, 10**8)} {word()}")  # a number that no pattern claims
    return out


def answers(spark, folder, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    return {r.doc_id: r for r in op13_private_data(spark, str(folder)).collect()}


def parts(spans):
    return set(spans.split(",")) - {""}


def by_sql(folder):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        cursor = db.execute(OP13_SQL)
        names = [c[0] for c in cursor.description]
        return {r[names.index("doc_id")]: dict(zip(names, r, strict=True)) for r in cursor.fetchall()}


def test_base_spans_equal_plain_matching(spark, tmp_path):
    texts = ODD + soup(1) + ODD[:5]
    got = answers(spark, tmp_path, texts)
    for i, text in enumerate(texts):
        expected = base(text)
        assert got[i].base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [expected.count(f"{k}:") for k in PATTERNS]
        assert parts(expected) <= parts(got[i].spans)


def test_unseen_identifiers_are_found_as_in_sql(spark, tmp_path):
    texts = planted() + soup(2, 40) + [None, ""] + planted()[:7]
    got, sql = answers(spark, tmp_path, texts), by_sql(tmp_path)
    assert {i: r.asDict() for i, r in got.items()} == sql
    for i, text in enumerate(texts):
        new = sorted(parts(got[i].spans) - parts(base(text)))
        lead = re.search(r"(dial number|card number:|from host|write to) (.*?)(?= [a-z]+ [a-z]+$)", text or "")
        kind = {"dial number": "phone", "card number:": "card", "from host": "ip", "write to": "email"}.get(lead and lead.group(1))
        if kind and not base(text):
            assert new == [f"{kind}:{lead.start(2)}:{lead.end(2)}"], text
        elif lead or (text or "").count(" of "):
            assert not new, text


@pytest.mark.parametrize("bound", [0, 10**6])
def test_bounds_names_and_copies(spark, monkeypatch, bound):
    monkeypatch.setattr(private, "BROADCAST_FOUND", bound)
    texts = planted(3)
    rows = [(i, t, "x", 7, 1) for i, t in enumerate(texts)] + [(None, texts[1], "x", 7, 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, key_a string, Private int, found_a int")
    out = private.find_private(docs)
    assert out.columns == ["doc_id", "text", "key_a", "found_a", "private"]
    found = out.select("doc_id", "text", "key_a", F.size("private.spans").alias("n"), F.size("private.base").alias("b")).collect()
    assert len(found) == len(rows) and {r.key_a for r in found} == {"x"}
    assert sum(r.n > r.b for r in found) >= 32 and all(r.n == found[-1].n for r in found if r.text == texts[1])


def test_copies_of_one_identifier_make_no_pattern(spark):
    texts = ["call the desk +1 (017) 555-0101 now please"] * 50 + ["call the desk 555 0199 12 now please"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.private.spans for r in private.find_private(docs).where("doc_id = 50").collect()] == [[]]


def test_mixed_company_is_not_trusted(spark):
    rng = random.Random(4)
    texts = [f"seen near the +1 (017) 555-{i:04} yes it is" for i in range(20)] + [f"seen near the {rng.randrange(10**8, 10**9)} yes it is" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert private.find_private(docs).where("size(private.spans) > size(private.base)").count() == 0


def test_very_long_texts(spark):
    texts = ["x" * 3_000_000 + " a@b.cd", "7" * 2_000_000, "9 " * 300_000, "a." * 500_000, "+" * 1_000_000, "1.1.1.1 , " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = private.find_private(docs).select("doc_id", F.size("private.base").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 60_000}


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id int, text string").select("doc_id", F.concat("text", F.lit("")).alias("text"))
    plan = private.find_private(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a@b.cd").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert private.find_private(docs.limit(0)).count() == 0
