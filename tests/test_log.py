import json

from pyspark.sql import functions as F
from quillspark.functions import replies as L
from quillspark.operators import backends, evaluation, feedback, history, markers, vectors
from quillspark.sources import paths, readers, sinks
from quillspark.streaming import inbox


def log(spark, rows):
    return spark.createDataFrame([(i, e, n, f"t{i}") for i, (e, n) in enumerate(rows)], "seq long, event string, original_filename string, ts string").withColumn("note", F.lit(""))


def test_parked_is_the_latest(spark):
    rows = [("parked", "a"), ("unparked", "a"), ("parked", "a"), ("parked", "b"), ("confirmed", "b"), ("parked", "c"), ("skipped", "c"), ("parked", "d"), ("rule_added", "d")]
    assert {r[0] for r in feedback.parked(log(spark, rows)).collect()} == {"a", "d"}
    files = spark.createDataFrame([("a",), ("b",), ("e",)], "name string")
    assert {r[0] for r in feedback.without_parked(files, log(spark, rows)).collect()} == {"b", "e"}


def test_read_log_passes_over_bad_lines(spark, tmp_path):
    good = {"event": "confirmed", "original_filename": "a.pdf", "extra": {"k": "v"}}
    (tmp_path / "log.jsonl").write_text(json.dumps(good) + "\n\n{bad\n" + json.dumps(good | {"event": "parked"}) + "\n")
    got = readers.read_log(spark, str(tmp_path / "log.jsonl")).orderBy("seq").collect()
    assert [(r.seq, r.event) for r in got] == [(0, "confirmed"), (3, "parked")] and got[0].extra == {"k": "v"}
    assert readers.read_log(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_append_goes_on_counting(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("x", "1"), ("y", "2")], "original_filename string, ts string")
    records = rows.select(*feedback.record(F.lit("confirmed"), F.col("original_filename"), F.lit("t" * 3000), ts=F.col("ts"), note=F.lit(" why ")))
    assert sinks.append_log(records, path) == 2 and sinks.append_log(records, path) == 2
    got = readers.read_log(spark, path).orderBy("seq").collect()
    assert [(r.seq, r.original_filename) for r in got] == [(0, "x"), (1, "y"), (2, "x"), (3, "y")] and len(got[0].text_excerpt) == 2000 and got[0].note == "why"


def test_append_read_parked(spark, tmp_path):
    """What is latest follows the order in which records were appended, however they are read and dealt out."""
    path = str(tmp_path / "log")
    for at, (event, name) in enumerate([("parked", "a"), ("parked", "b"), ("unparked", "a"), ("parked", "a"), ("confirmed", "b"), ("parked", "c")]):
        rows = spark.createDataFrame([(event, name)], "e string, n string")
        sinks.append_log(rows.select(*feedback.record(F.col("e"), F.col("n"), F.lit("t"), ts=F.lit(f"2024-01-0{6 - at}"))), path)
    got = readers.read_log(spark, path).repartition(3, F.rand(1))
    assert sorted(r.seq for r in got.collect()) == list(range(6))
    assert {(r.original_filename, r.seq) for r in feedback.parked(got).collect()} == {("a", 3), ("c", 5)}
    assert [r.seq for r in feedback.tail(got, 2).collect()] == [5, 4]


def test_line_numbers_over_parts_and_files(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"event": "parked", "original_filename": f"{name}{i}", "note": "x" * 200}) + "\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = readers.lines_in_order(spark, str(tmp_path)).collect()
        assert all(json.loads(r.line)["original_filename"] == f"{r.file[-7]}{r.line_no}" for r in lines) and len(lines) == 1000
        got = {r.seq: r.original_filename for r in readers.read_log(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: f"a{i}" for i in range(500)} | {500 + i: f"b{i}" for i in range(500)}


def test_tracked_files_are_read_whole(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.py", "sub/b.md", "c.bin", "d.py"):
        (tmp_path / name).write_text("one\nlong number 1234567\n")
    got = readers.read_tracked(spark, str(tmp_path), skip=("d.py",))
    found = markers.scan(got, [(r"\b\d{6,}\b", "number")], id_col="path").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.line_no) for r in found) == [("a.py", 2), ("b.md", 2)]
    listed = spark.createDataFrame([("sub/b.md",)], "path string")
    assert [r.path[-4:] for r in readers.read_tracked(spark, str(tmp_path), tracked=listed).collect()] == ["b.md"]


def test_merge_examples_outlives_a_cut(spark, tmp_path):
    path = str(tmp_path / "examples")
    make = lambda rows: spark.createDataFrame(rows, "original_filename string, ts string, category string, embedding array<float>, dim int")
    sinks.merge_examples(make([("a", "1", "x", [1.0], 1), ("b", "1", "y", [2.0], 2)]), path)
    sinks.merge_examples(make([("a", "1", "z", [3.0], 1)]), path)
    assert sorted((r.original_filename, r.category) for r in spark.read.parquet(path).collect()) == [("a", "z"), ("b", "y")]
    assert [(r.original_filename, r.category) for r in readers.read_examples(spark, path, "z").collect()] == [("a", "z")]
    (tmp_path / "examples").rename(tmp_path / "examples-old")  # as a merge that was cut short leaves it
    sinks.merge_examples(make([("c", "1", "x", [1.0], 1)]), path)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "examples-old").exists()


def test_history_file_days_and_title(spark, tmp_path):
    path = str(tmp_path / "out" / "PROCESSED_PDFS.md")
    make = lambda day, time, name: spark.createDataFrame(
        [(day, time, "move", 1, name, "Bills", None, "new.pdf", "$1.00", "Bills/FPL")],
        "day string, time string, action_mode string, position int, original_filename string, category string, issuer string, new_filename string, amount string, destination string",
    )
    for day, time, name in (("2024-01-02", "10:00", "a.pdf"), ("2024-01-03", "09:00", "b|c.pdf"), ("2024-01-02", "11:00", "d.pdf"), ("2024-01-03", "12:00", "e.pdf")):
        sinks.write_history(make(day, time, name), path)
    text = open(path).read()
    assert text.startswith("# Processed PDFs\n") and text.count("# Processed PDFs") == 1 and text.count("## 2024-01-02") == 1 and text.count("## 2024-01-03") == 1
    got = history.parse(readers.read_history(spark, path)).orderBy("line_no").collect()
    assert [(r.original_filename, r.day) for r in got] == [("a.pdf", "2024-01-02"), ("d.pdf", "2024-01-02"), ("b|c.pdf", "2024-01-03"), ("e.pdf", "2024-01-03")]


def test_manifest_export_and_apply(spark, tmp_path):
    entries = spark.createDataFrame([(f"f{i}.pdf", "Bills", "x", "o", "1", "2024-01-01", "1.00", 0.5, "r", "t", "moved") for i in range(30)], readers.MANIFEST_SCHEMA)
    sinks.append_manifest(entries.coalesce(1), str(tmp_path / "csv"), str(tmp_path / "json"))
    assert readers.read_manifest(spark, str(tmp_path / "json")).count() == 30
    assert [r.filename for r in readers.review(spark, str(tmp_path / "json")).collect()] == [f"f{i}.pdf" for i in range(20)]
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == list(sinks.CSV_COLUMNS)
    events = log(spark, [("parked", "a"), ("skipped", 'b"')])
    for rows in (events, events.limit(0), events.limit(1)):
        sinks.export_log(rows, str(tmp_path / "export"), array=True)
        parts = "".join(p.read_text() for p in sorted((tmp_path / "export").glob("part-*")))
        assert [x["original_filename"] for x in json.loads(parts)] == [r.original_filename for r in rows.orderBy("seq").collect()]
    for name in ("a.pdf", "b.pdf", "there.pdf"):
        (tmp_path / name).write_text(name)
    (tmp_path / "to").mkdir()
    (tmp_path / "to" / "x.pdf").write_text("old")
    to = str(tmp_path / "to" / "x.pdf")
    done = sinks.apply_plan([(str(tmp_path / "a.pdf"), to), (str(tmp_path / "none.pdf"), to), (str(tmp_path / "b.pdf"), to)], archive=str(tmp_path / "old"))
    assert [d[1] and d[1].rsplit("/", 1)[1] for d in done] == ["x - 2.pdf", None, "x - 3.pdf"] and done[1][2]
    assert (tmp_path / "to" / "x.pdf").read_text() == "old" and (tmp_path / "to" / "x - 3.pdf").read_text() == "b.pdf" and (tmp_path / "old" / "a.pdf").exists()
    assert sinks.apply_plan([(str(tmp_path / "there.pdf"), str(tmp_path / "y.pdf"))], rename=True)[0][1].endswith("y.pdf")


HISTORY = """# Log
## 2026-05-15 — 2 files
| # | Original | Category | Issuer | New | Amount | Destination |
| --- | --- | --- | --- | --- | --- | --- |
| 1 | a \\| b.pdf (OCR) | Bills | — | new.pdf | $1.00 | Bills/FPL |
### 10:30 — 1 file(s) renamed in place
| 2 | c.pdf | Bills | FPL | same | - | /abs |
### Duplicates deleted
| 3 | d.pdf | Bills | FPL | x | - | /abs |
## undated
| 4 | e.pdf | Bills | FPL | x | - | /abs |
## Session 3 — 2026-05-25
| 5 | a \\| b.pdf | Bills | FPL | x | - | DELETED |
| 6 | c.pdf | Notices | FPL | x | - | /new |
| 7 | short | row | here |
"""


def test_history(spark, tmp_path):
    (tmp_path / "2026 PROCESSED_PDFS.md").write_text(HISTORY)
    entries = history.parse(readers.read_history(spark, str(tmp_path)))
    got = [(r.original_filename, r.issuer, r.new_filename, r.amount, r.day, r.action_mode) for r in entries.orderBy("line_no").collect()]
    assert got == [
        ("a | b.pdf", None, "new.pdf", "$1.00", "2026-05-15", "move"), ("c.pdf", "FPL", "c.pdf", None, "2026-05-15", "rename"), ("c.pdf", "FPL", "x", None, "2026-05-25", "move"),
    ]
    assert {r.original_filename: r.destination for r in history.latest(entries).collect()} == {"a | b.pdf": "Bills/FPL", "c.pdf": "/new"}
    out = history.to_markdown(entries.withColumn("time", F.lit("10:30")).withColumn("position", F.col("line_no")))
    again = history.parse(history.lines_of(out.select(F.col("day").alias("file"), F.col("markdown").alias("value"))))
    assert sorted((r.original_filename, r.day, r.action_mode) for r in again.collect()) == sorted((a, d, m) for a, _, _, _, d, m in got)


def test_vectors(spark):
    store = spark.createDataFrame([("a", "1", "x", [1.0, 0.0]), ("b", "1", "y", [0.0, 1.0]), ("c", "1", "x", [0.0, 0.0])], "original_filename string, ts string, category string, embedding array<float>")
    q = F.array(F.lit(2.0), F.lit(0.1))
    top = vectors.search(store, q, k=2, id_col="original_filename").collect()
    assert [r.original_filename for r in top] == ["a", "b"]
    assert [r.original_filename for r in vectors.search(store, q, category="y", id_col="original_filename").collect()] == ["b"]
    assert vectors.search(store, F.array(F.lit(0.0), F.lit(0.0)), id_col="original_filename").count() == 0
    events = spark.createDataFrame(
        [(0, "confirmed", "n1", "1", "text"), (1, "confirmed", "n2", "1", " "), (2, "skipped", "n3", "1", "t"), (3, "confirmed", "a", "1", "t"), (4, "confirmed", "n1", "1", "later")],
        "seq long, event string, original_filename string, ts string, text_excerpt string",
    )
    for c in ("final_category", "final_issuer", "final_folder", "final_filename", "backend"):
        events = events.withColumn(c, F.lit("z"))
    assert tuple(vectors.index_counters(vectors.index_outcomes(events, store)).first()) == (5, 1, 1, 1, 2, 0)
    merged = vectors.index(events, store, backends.stub_embedding(4), "stub")
    assert merged.count() == 4 and merged.where("original_filename = 'n1'").first().text_excerpt == "later"


def test_evaluation(spark):
    rows = [("1", "en", "x", "en", None, 0.9), ("2", "en", "x", "de", None, 0.9), ("3", "de", "", "de", None, 0.9), ("4", "de", "x", None, None, None)]
    samples = spark.createDataFrame(rows, "path string, truth_category string, text string, llm_category string, llm_issuer string, llm_confidence double")
    audit = evaluation.evaluate(samples, keyword=F.lit("de"))
    total = evaluation.overall(audit).first()
    assert (total.n_total, total.n_evaluated, total.n_skipped, total.llm_attempted, total.keyword_correct, total.llm_correct, total.hybrid_correct) == (4, 3, 1, 2, 1, 1, 2)
    assert {(r.path, r.effect) for r in evaluation.helped_and_hurt(audit).collect()} == {("1", "helped")}
    assert {tuple(r) for r in evaluation.confusion(audit).collect()} == {("en", "en", 1), ("en", "de", 1), ("de", "de", 1)}
    assert evaluation.overall(evaluation.evaluate(samples.limit(0), keyword=F.lit("de"))).first().hybrid_accuracy == 0
    many = spark.range(100).withColumn("c", F.when(F.col("id") < 90, "a").otherwise("b"))
    chosen = evaluation.stratified_sample(many, "c", "id", 20).collect()
    assert len(chosen) == 20 and sum(r.c == "b" for r in chosen) == 2
    assert evaluation.stratified_sample(many, "c", "id", 200).count() == 100


def test_replies(spark):
    valid = F.array(*[F.lit(i) for i in (1, 2, 4)])
    cases = {"": ([1, 2, 4], [], ""), "skip 2": ([1, 4], [], ""), "park 4 note: Later": ([1, 2], [4], "Later"), "1, 2": ([1, 2], [], ""), "q": ([], [], "")}
    df = spark.createDataFrame([(c,) for c in cases], "r string").coalesce(1)
    assert [tuple(r[0]) for r in df.select(L.literal_reply(F.col("r"), valid)).collect()] == list(cases.values())
    long = spark.createDataFrame([("a" * 3000 + "b" * 2000,)], "t string").select(L.excerpt(F.col("t"))).first()[0]
    assert long == "a" * 2500 + "\n…[1500 chars omitted]…\n" + "b" * 1000
    prompt = spark.createDataFrame([("text", "f.pdf")], "t string, n string").select(L.user_prompt(F.col("t"), F.col("n"), F.array(F.lit("- shot")), F.array(F.lit("B"), F.lit("A"), F.lit("A")))).first()[0]
    assert "most similar documents:\n- shot" in prompt and "A, B" in prompt and "Filename: f.pdf" in prompt
    assert "- Bills" in L.system_prompt(["Bills"])


def test_backends(spark):
    prompts = spark.createDataFrame([("a",), ("boom",)], "user string")

    class Stub:
        label = "stub"

        def chat(self, system, user):
            if user == "boom":
                raise RuntimeError("down")
            return '{"category": "A", "confidence": 1}'

    got = {r.user: (r.answer, r.error) for r in backends.ask(prompts, Stub(), "s").collect()}
    assert got == {"a": ('{"category": "A", "confidence": 1}', None), "boom": (None, "down")}
    assert {r.error for r in backends.ask(prompts, backends.NullOpinion(), "s").collect()} == {"no model"}


def test_paths():
    assert paths.feedback_log({"feedback": None}, {}) == "data/_feedback/corrections.jsonl"
    assert paths.feedback_log({"feedback": {"path": "p"}}, {"OCR_FEEDBACK_DIR": "d"}) == "p"
    assert paths.feedback_log({"feedback": {"path": "p"}}, {"OCR_FEEDBACK_LOG": "e"}) == "e"
    assert paths.examples_store({}, {"OCR_FEEDBACK_DIR": "d"}) == "d/examples.sqlite"
    assert paths.history_file({"history": {"monthly": True}}, "out", "2026.05") == "out/2026.05 - PROCESSED_PDFS.md"
    assert paths.history_file({"history": {"path": "h.md"}}, "out", "2026.05") == "h.md"


def test_markers_and_artifacts(spark):
    docs = spark.createDataFrame([(1, "a@b.com\nplain 1234567")], "doc_id int, text string")
    assert {(r.line_no, r.reason) for r in markers.scan(docs, [(r"\w+@\w+\.\w+", "mail"), (r"\b\d{6,}\b", "number")]).collect()} == {(1, "mail"), (2, "number")}
    files = spark.createDataFrame([("p", "x.pdf"), ("p", "x_ocr.pdf"), ("p", "y_ocr.pdf"), ("q", "x_ocr.pdf")], "parent string, name string")
    assert {tuple(r) for r in feedback.without_ocr_artifacts(files).collect()} == {("p", "x.pdf"), ("p", "y_ocr.pdf"), ("q", "x_ocr.pdf")}


def test_tree_bootstrap(spark):
    rows = [("/d/Bills/FPL/2024/a.pdf", "t"), ("/d/.git/x/b.pdf", "t"), ("/d/c.pdf", "t"), ("/d/Bills/known.pdf", "t")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = feedback.bootstrap_tree(files, "/d", log(spark, [("confirmed", "known.pdf")])).collect()
    assert [(r.original_filename, r.final_category, r.final_issuer) for r in got] == [("a.pdf", "Bills", "FPL")]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("amount due, due date 1/2/2024")
    files = readers.list_files(spark, str(tmp_path / "in"), "*.txt")
    assert [r.name for r in files.collect()] == ["a.txt"]
    texts = readers.read_texts(spark, str(tmp_path / "in"), lambda b: b.decode() if b else 1 / 0, "*.txt").first()
    assert texts.text.startswith("amount") and texts.extract_error is None
    seen = []
    stream = inbox.planned(inbox.inbox(spark, str(tmp_path / "in")))
    q = inbox.start(stream, lambda df, n: seen.extend(r.category for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert seen == ["Bills"]
