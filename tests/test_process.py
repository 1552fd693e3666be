"""Whole batches, second opinions, outside services and name clashes."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from quillspark.config import RoutingConfig, SecondOpinionConfig
from quillspark.functions import replies as L
from quillspark.functions import routing as R
from quillspark.operators import backends, collisions, feedback, services, vectors
from quillspark.plans import plan as P
from quillspark.scratch import drop_since, materialize, ordinals, written

CONFIG = RoutingConfig(categories={"Bills": ("amount due", "due date"), "Receipts": ("subtotal", "order number")})


def log(spark, rows):
    return spark.createDataFrame([(i, e, n, "t", "") for i, (e, n) in enumerate(rows)], "seq long, event string, original_filename string, ts string, note string")


def test_process_numbers_before_it_looks_at_texts(spark):
    bill = "amount due $12.00, due date 1/2/2024"
    rows = [("/in/b.pdf", bill), ("/in/a.pdf", bill), ("/in/c.pdf", ""), ("/in/d.pdf", None), ("/in/e.pdf", bill), ("/in/e_ocr.pdf", bill), ("/in/p.pdf", bill), ("/in/z.pdf", "nothing")]
    files = spark.createDataFrame([(p, "/in", p[4:], t) for p, t in rows], "path string, parent string, name string, text string")
    done, unread = P.process(files, log(spark, [("parked", "p.pdf")]), CONFIG, max_files=5)
    got = {r["index"]: (r.name, r.category, r.final_name) for r in done.collect()}
    name = got[1][2]
    assert got == {1: ("a.pdf", "Bills", name), 2: ("b.pdf", "Bills", name.replace(".pdf", " - 2.pdf")), 5: ("e.pdf", "Bills", name.replace(".pdf", " - 3.pdf"))}
    assert sorted((r["index"], r.name) for r in unread.collect()) == [(3, "c.pdf"), (4, "d.pdf")]
    done, _ = P.process(files.limit(0), log(spark, []), CONFIG)
    assert done.count() == 0


def test_second_opinions(spark):
    docs = spark.createDataFrame([(1, "amount due", "a.pdf"), (2, "other words", "b.pdf"), (3, " ", "c.pdf"), (4, None, "d.pdf")], "doc_id long, text string, name string")
    embed = backends.stub_embedding()
    kept = spark.createDataFrame([(10, "amount due", "Bills", "FPL"), (11, "other words", "Made up", None), (12, "far", "Receipts", "—")], "vec_id long, text_excerpt string, category string, issuer string")
    kept = kept.withColumn("embedding", embed(F.col("text_excerpt")))
    ask = lambda **more: {r.doc_id: r for r in P.second_opinions(docs, kept, embed, backends.EchoOpinion(), config=CONFIG, **more).collect()}
    got = ask()
    assert (got[1].llm_category, got[1].llm_issuer, got[1].llm_confidence, got[1].llm_reasons, got[1].llm_fewshot_count) == ("Bills", "FPL", 0.9, ["as before"], 3)
    assert (got[2].llm_category, got[2].llm_error) == (None, "category not allowed: Made up")
    assert [(got[i].llm_category, got[i].llm_error, got[i].llm_fewshot_count) for i in (3, 4)] == [(None, "no example", 0)] * 2
    assert ask(extra_categories=["Made up"])[2].llm_category == "Made up"
    none = P.second_opinions(docs, kept, embed, backends.NullOpinion(), config=CONFIG).collect()
    assert {(r.llm_error, r.llm_fewshot_count) for r in none} == {("no model", 0)}
    off = RoutingConfig(categories=CONFIG.categories, second_opinion=SecondOpinionConfig(fewshot_k=0))
    assert {r.llm_error for r in P.second_opinions(docs, kept, embed, backends.EchoOpinion(), config=off).collect()} == {"no example"}
    opined = P.second_opinions(docs, kept, embed, backends.EchoOpinion(), config=CONFIG)
    assert {r.doc_id: r.category for r in P.plan(opined, CONFIG).collect()}[1] == "Bills"


class Server(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "prompt" in body:
            answer = {"embedding": [float(len(body["prompt"])), 1.0]} if body["prompt"] != "bad" else {}
        elif "boom" in body["messages"][1]["content"]:
            answer = {}
        else:
            assert body["format"] == "json" and body["options"] == {"temperature": 0, "num_ctx": 4096}
            answer = {"message": {"content": '{"category": "Bills", "confidence": 0.75}'}}
        raw = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


def test_model_server(spark):
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}"
    try:
        docs = spark.createDataFrame([(1, "words", "a"), (2, "boom", "b")], "doc_id long, text string, name string")
        got = {r.doc_id: (r.llm_category, r.llm_error) for r in P.second_opinions(docs, None, None, services.HttpOpinion(host=host), config=CONFIG).collect()}
        assert got == {1: ("Bills", None), 2: (None, "the model gave no answer")}
        embed = services.http_embedding(host=host)
        texts = spark.createDataFrame([("four",), ("bad",), ("",), (None,)], "t string")
        assert {r.t: r.v for r in texts.select("t", embed(F.col("t")).alias("v")).collect()} == {"four": [4.0, 1.0], "bad": None, "": None, None: None}
    finally:
        server.shutdown()
    down = P.second_opinions(docs, None, None, services.HttpOpinion(host=host, timeout_s=1), config=CONFIG).collect()
    assert all(r.llm_category is None and r.llm_error for r in down)


def test_recognition_by_a_command(spark):
    files = spark.createDataFrame([("a", bytearray(b"scan")), ("b", bytearray(b"x"))], "path string, content binary")
    copy = services.CommandRecognizer(("cp",))
    assert {r.path: (bytes(r.content), r.issues) for r in backends.recognize(files, copy).collect()} == {"a": (b"scan", []), "b": (b"x", [])}
    for broken in (services.CommandRecognizer(("false",)), services.CommandRecognizer(("no-such-command",))):
        assert {r.issues[0] for r in backends.recognize(files, broken).collect()} == {"OCR/compression failed"}


def test_rules_of_a_reply(spark):
    planned = spark.createDataFrame([(1, "New_Bank-2.PDF"), (3, "x.pdf")], "index int, name string")
    rules = spark.createDataFrame([(1, "issuer", "FPL"), (1, "category", "Bills"), (2, "issuer", "gone"), (3, "other", "y")], "file_index int, kind string, value string")
    assert {tuple(r) for r in P.intent_rules(planned, rules).collect()} == {(1, "issuer", "new_bank-2", "FPL"), (1, "category", "new bank 2", "Bills")}
    typed = spark.createDataFrame([("issuer= FPL ",), ("CATEGORY=a=b",), ("skip",), ("",), ("other=x",), (None,)], "t string").coalesce(1)
    assert [r[0] and tuple(r[0]) for r in typed.select(L.typed_rule(F.col("t"))).collect()] == [("issuer", "FPL"), ("category", "a=b"), None, None, None, None]


def test_summaries(spark):
    row = spark.range(1).select(F.struct(F.lit("2024-05-06").alias("date"), F.lit("1234.5").alias("amount"), F.lit("S/").alias("currency"), F.lit("FPL").alias("issuer")).alias("m"))
    say = lambda c: row.select(R.content_summary(F.lit(c), F.col("m"))).first()[0]
    assert say("Paystubs") == "FPL paycheck — period 2024-05-06, net S/1234.50"
    assert say("Tax Returns") == "Tax document — year 2024" and say("Odd") == "Odd document — 2024-05-06"


def test_counters(spark):
    rows = [("matched", "t", True, False, None), ("pending", " ", True, True, "bad"), ("already_logged", "t", True, True, "x")]
    got = feedback.bootstrap_counters(spark.createDataFrame(rows, "outcome string, text string, ocr_run boolean, ocr_failed boolean, error string")).first()
    assert (got.scanned, got.appended, got.text_extracted, got.ocr_run, got.ocr_failed, got.errors) == (3, 2, 1, 2, 1, 1)
    store = spark.createDataFrame([("b", "1", [1.0, 2.0], "m2"), ("a", "2", [1.0], "m1")], "original_filename string, ts string, embedding array<float>, embed_model string")
    assert tuple(vectors.store_info(store).first()) == (2, 1, "m1")
    assert tuple(vectors.store_info(store.limit(0)).first()) == (0, None, None)
    assert [r.original_filename for r in feedback.parked_list(log(spark, [("parked", "b"), ("parked", "a")])).collect()] == ["a", "b"]


def greedy(batch, there):
    taken, out = set(there), []
    for d, name in batch:
        head, dot, tail = name.rpartition(".")
        head, tail = (head, dot + tail) if head and dot else (name, "")
        candidate, n = name, 2
        while (d, candidate) in taken:
            candidate, n = f"{head} - {n}{tail}", n + 1
        taken.add((d, candidate))
        out.append(candidate)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clashing_names_against_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    names = ["x.pdf", "x - 2.pdf", "x - 2 - 2.pdf", "x - 3.pdf", "y.pdf", "y", "y - 2", ".hidden", "z.tar.gz"]
    batch = [(rng.choice("ab"), rng.choice(names)) for _ in range(300)] + [("hot", "x.pdf") for _ in range(2000)] + [("hot", "x - 7.pdf")]
    there = [("a", "x.pdf"), ("a", "y - 2"), ("hot", "x - 1999.pdf"), ("c", "x.pdf")]
    df = spark.createDataFrame([(i, d, n) for i, (d, n) in enumerate(batch)], "batch_index int, dest_dir string, filename string").repartition(4)
    got = {r.batch_index: r.resolved for r in collisions.resolve(df, spark.createDataFrame(there, "dest_dir string, filename string")).collect()}
    assert [got[i] for i in range(len(batch))] == greedy(batch, there)


def test_ordinals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert sorted((r.k, r.n) for r in ordinals(df, [F.col("k")], "n").collect()) == [(i, i) for i in range(1000)]
    assert ordinals(df.limit(0), [F.col("k")], "n").count() == 0


def test_superseded_scratch_tables_go(spark):
    before, mark = materialize(spark.range(3), "kept"), written()
    tables = [materialize(spark.range(n), "step") for n in range(1, 4)]
    other = []
    thread = threading.Thread(target=lambda: other.append(materialize(spark.range(5), "other")))
    thread.start()
    thread.join()
    drop_since(spark, mark)
    assert written() == mark + 1 and [df.count() for df in (before, tables[2], other[0])] == [3, 3, 5]
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|PATH_NOT_FOUND|FAILED_READ"):
        tables[0].count()
