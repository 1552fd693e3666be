from pyspark.sql import functions as F
from quillspark.config import BANK, CREDIT_CARDS, RoutingConfig, load_config, save_config
from quillspark.functions import routing as R
from quillspark.operators import collisions, folders
from quillspark.plans.plan import actions, destinations, plan

META = "struct<date:string,date_year_only:boolean,amount:string,amount_zero:boolean,currency:string,account:string,account_masked:boolean,account_digits:int,owner:string,issuer:string>"


def one(spark, column, meta, category=CREDIT_CARDS, name="scan.pdf"):
    keys = ["date", "date_year_only", "amount", "amount_zero", "currency", "account", "account_masked", "account_digits", "owner", "issuer"]
    row = tuple(meta.get(k, {"date_year_only": False, "amount_zero": False, "currency": "$", "account_masked": False, "account_digits": 0}.get(k)) for k in keys)
    df = spark.createDataFrame([(category, row, name)], f"category string, m {META}, name string")
    return df.select(column).first()[0]


def names(spark, meta, category=CREDIT_CARDS, name="scan.pdf"):
    new = one(spark, R.normalized_filename(F.col("name"), F.col("category"), F.col("m")), meta, category, name)
    return new, one(spark, R.route_path(F.col("category"), F.col("m")), meta, category, name)


def test_names_and_routes(spark):
    zero = {"date": "2025-02-21", "amount_zero": True, "issuer": "Interbank"}
    assert names(spark, zero) == ("2025.02 - Interbank Statement.pdf", "Credit Card Statements\\Interbank\\2025")
    new, route = names(spark, {"date": "2025-02-21", "issuer": "Interbank"})
    assert new == "2025.02.21 - Interbank Contract.pdf" and route == "Credit Card Statements\\Interbank"
    assert names(spark, {"date": "2025-02-21", "amount": "980", "currency": "S/", "account": "1234", "account_masked": True, "account_digits": 4, "issuer": "X"})[0] == "2025.02 - X Statement - (Last4 1234) - S_980.00.pdf"
    assert names(spark, {"date": "2021-01-01", "date_year_only": True}, "Tax Returns") == ("2021 - Return.pdf", "Tax Returns\\Forms")
    assert names(spark, {}, "Other", "My scan.PDF") == ("My scan.PDF", "Other")
    assert names(spark, {"date": "2024-05-06", "amount": "5"}, "Mortgage & Home Equity Accounts")[1] == "Mortgage & Home Equity Accounts\\2024"


def test_classification_ties_and_threshold(spark):
    config = RoutingConfig(categories={"A": ("one", "two"), "B": ("two", "three"), "C": ("one", "two", "four")})
    texts = {"One two": "A", "two three": "B", "one two four": "C", "one": "Uncategorized", "": "Uncategorized"}
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert [r[0] for r in df.select(R.classify(F.col("text"), config)).collect()] == list(texts.values())


def test_decision_rule(spark):
    rows = [("A", "B", 0.5, "I"), ("A", "A", 0.6, "I"), ("Uncategorized", "B", 0.9, "I"), ("A", "B", 0.6, None), ("A", "A", 0.1, "I")]
    df = spark.createDataFrame(rows, "k string, v string, c double, i string").coalesce(1)
    got = [tuple(r[0]) for r in df.select(R.decide(F.col("k"), F.col("v"), F.col("c"), F.col("i"), 0.6)).collect()]
    assert got == [
        ("keyword-llm-low-conf", "A", None, "LLM suggests B (0.50)"), ("agree", "A", "I", None), ("hybrid-llm", "B", "I", None),
        ("hybrid-llm-disagree", "B", None, "LLM says B (0.60), keyword says A"), ("keyword-llm-low-conf", "A", None, None),
    ]


def greedy(batch, existing):
    taken, out = set(existing), {}
    for i, d, n in sorted(batch):
        head, dot, tail = n.rpartition(".")
        name, k = n, 2
        while (d, name) in taken:
            name, k = f"{head} - {k}{dot}{tail}", k + 1
        taken.add((d, name))
        out[i] = name
    return out


def test_collisions_as_if_one_by_one(spark):
    batch = [(i, f"d{i % 2}", ["x.pdf", "x - 2.pdf", "y.pdf", "x - 2 - 2.pdf", "x.txt", "y.pdf"][i * 7 % 6]) for i in range(40)]
    existing = [("d0", "x.pdf"), ("d0", "x - 3.pdf"), ("d1", "y - 2.pdf")]
    df = spark.createDataFrame(batch, "batch_index int, dest_dir string, filename string")
    there = spark.createDataFrame(existing, "dest_dir string, filename string")
    assert {r.batch_index: r.resolved for r in collisions.resolve(df, there).collect()} == greedy(batch, existing)
    assert {r.batch_index: r.resolved for r in collisions.resolve(df).collect()} == greedy(batch, [])


def test_folders(spark):
    known = spark.createDataFrame([("A",), ("A\\2023",), ("B",), ("B\\x",), ("C\\2020",)], "folder string")
    routes = spark.createDataFrame([("A\\2023",), ("A\\2024",), ("B\\2024",), ("D\\2024",), ("B\\new",), ("2024",)], "route string")
    got = {r.route: (r.status, r.destination) for r in folders.resolve(routes, known).collect()}
    assert got == {
        "A\\2023": ("exact", "A\\2023"), "A\\2024": ("created", "A\\2024"), "B\\2024": ("flat", "B"), "D\\2024": ("suggest", "D\\2024"),
        "B\\new": ("created", "B\\new"), "2024": ("suggest", "2024"),
    }


def test_labels_from_paths(spark):
    cases = {
        "/d/Bills/FPL/2026/a.pdf": ("Bills", "FPL", "2026", "Bills/FPL/2026", "a.pdf"),
        "/d/Paystubs/2026/a.pdf": ("Paystubs", None, "2026", "Paystubs/2026", "a.pdf"),
        "/d/Bank/_ Closed Accounts _/Old/2018/a.pdf": ("Bank", "Old", "2018", "Bank/_ Closed Accounts _/Old/2018", "a.pdf"),
        "/d/a.pdf": (None, None, None, "", "a.pdf"),
        "/e/x/a.pdf": (None, None, None, "/e/x", "a.pdf"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string").coalesce(1)
    assert [tuple(r[0]) for r in df.select(R.infer_label(F.col("path"), F.lit("/d"))).collect()] == list(cases.values())


def test_plan_and_actions(spark):
    rows = [(1, "a.pdf", "amount due billing period: Amount due: $5.00 on 1/2/2024", "Bills", None, 0.9), (2, "b.pdf", "", None, None, None), (3, "a.pdf", "amount due, due date 1/2/2024 total due 5", BANK, "Z", 0.9)]
    docs = spark.createDataFrame(rows, "index int, name string, text string, llm_category string, llm_issuer string, llm_confidence double")
    p = {r["index"]: r for r in destinations(plan(docs)).collect()}
    assert set(p) == {1, 3} and p[1].backend == "agree" and p[3].backend == "hybrid-llm-disagree" and len(p[3].issues) == 1
    assert p[3].metadata.issuer == "Z" and p[1].final_name.startswith("2024.01")
    idx = lambda *n: spark.createDataFrame([(i,) for i in n], "index int")
    assert {r["index"]: r.action for r in actions(plan(docs), idx(1), idx(3)).collect()} == {1: "move", 3: "park"}


def test_config_round_trip(tmp_path):
    tree = RoutingConfig().with_rules({"new co": "New"}, {"Bills": ["due date", "extra"]})
    save_config(tree, tmp_path / "c.yaml")
    read = load_config(tmp_path / "c.yaml", honour_amount_labels=True)
    assert read.known_issuers["new co"] == "New" and read.categories["Bills"][-1] == "extra" and read.categories["Bills"].count("due date") == 1
    assert list(read.categories) == list(tree.categories) and read.issuer_keys()[0] == "bank of america"
    assert RoutingConfig.of(None).monthly_categories == ("Bills",) and RoutingConfig.of({"own": 1}).extra == {"own": 1}
