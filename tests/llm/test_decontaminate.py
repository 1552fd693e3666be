import random
import re

from pyspark.sql import functions as F
from quillspark.llm import decontaminate
from quillspark.llm.common import materialize

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        i = words(t)
        n = min(10, len(i))
        for a in range(len(i) - n + 1 if n else 0):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == i[a : a + n]:
                    hit.update(range(s, s + n))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, n_words string, w int")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(d, b).orderBy("doc_id").collect()
    assert len(out) == len(docs)
    for r, t in zip(out, docs, strict=True):
        assert tuple(r.contamination) == expected(t, items), t


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["a", "B", "c9", "é", "ß.", "漢"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, make(30)), (2, make(14)), (2, make(10)), (3, make(9)), (4, make(2)), (None, make(12)), (5, ""), (6, None), (7, "A A A")]
    docs = [None, "", "a", make(200), items[0][1], f"{make(20)} {items[1][1]} {make(5)}", "a " * 500, items[2][1].upper()]
    docs += [make(rng.randint(1, 60)) for _ in range(30)]
    docs += [f"{make(rng.randint(0, 30))}, {items[0][1][k : k + 40]} {make(9)}" for k in range(0, 12, 3)]
    check(spark, docs + docs[:5], items)


def test_without_broadcast_and_empty(spark, monkeypatch):
    docs = ["one two three four five six seven eight nine ten eleven", "one two"]
    check(spark, docs, [(1, docs[0]), (2, "TWO")])
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_SUSPECTS", 0)
    check(spark, docs, [(1, docs[0]), (2, "TWO")])
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), items).count() == 0
    assert decontaminate.contamination(d, items.limit(0)).first().contamination.n_hit == 0


def shuffled(spark):
    """Bytes written to shuffles so far."""
    jvm = spark.sparkContext._jvm
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_do_not_travel_with_fingerprints(spark, monkeypatch):
    for bound in ("BROADCAST_WINDOWS", "BROADCAST_TEXTS", "BROADCAST_SUSPECTS"):
        monkeypatch.setattr(decontaminate, bound, 0)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(30)]
    docs = [(i, " ".join([*(word() for _ in range(4000)), items[i][1], *(word() for _ in range(4000))])) for i in range(20)]
    size = sum(len(t) for _, t in docs)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    d, b = materialize(d, "docs"), materialize(b, "items")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        found = decontaminate.contamination(d, b).select("doc_id", "contamination").collect()
        assert all(r.contamination.n_hit == 40 and r.contamination["items"] == [str(r.doc_id)] for r in found) and len(found) == 20
        assert shuffled(spark) - before < 3 * size
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_python_on_the_main_path(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("z", F.lit(1))
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate.contamination(d, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_capitals_whose_lower_case_depends_on_neighbours(spark):
    """A capital sigma, a dotted I, and points and quotes that end words but not the reach of case mapping."""
    item = "alpha beta gamma delta ΟΔΟΣ Αθήνα epsilon zeta eta theta"
    docs = [item.replace(" ", sep) for sep in (" ", ".", "'", "·", ":", "\u00ad ")]
    docs += [item.upper(), item.replace("ΟΔΟΣ", "ΟΔΟς"), item.replace("alpha", "ALPHA").replace("eta", "ETA")]
    check(spark, docs, [(1, item), (2, "İstanbul KELVIN \u212a I.İ'Σ.Σ"), (3, "Σ")])
    check(spark, ["a.Σ'b", "Σ Σ. Σ", "İ i̇ I", "İSTANBUL kelvin \u212a i.İ'Σ.Σ"], [(2, "İstanbul KELVIN \u212a I.İ'Σ.Σ"), (3, "Σ.Σ"), (4, "i İ")])


def test_very_long_text_and_clashing_names(spark):
    passage = " ".join(f"word{i}" for i in range(10))
    docs = [(1, "filler " * 300_000 + passage, 5, "x", 1), (2, None, None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, Contamination int, hit_a string, key_a int")
    out = {r.doc_id: r for r in decontaminate.contamination(d, spark.createDataFrame([(9, passage)], "item_id long, text string")).collect()}
    assert out[1].__fields__ == ["doc_id", "text", "hit_a", "key_a", "contamination"]
    assert (out[1].contamination.n_words, out[1].contamination.n_hit, out[1].hit_a, out[1].key_a) == (300_010, 10, "x", 1)
    assert tuple(out[2].contamination) == (0, 0, [])
