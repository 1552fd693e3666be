import os
import threading
import time

import pytest
from pyspark.sql import functions as F
from quillspark.operators import backends
from quillspark.operators.backends import Calls
from quillspark.sources import store


def rows(spark, names, category):
    made = [(n, "t", category, [1.0], i) for i, n in enumerate(names)]
    return spark.createDataFrame(made, "original_filename string, ts string, category string, embedding array<float>, seq long")


def held(spark, root, version=None):
    return {r.original_filename: r.category for r in store.read_store(spark, root, version).collect()}


def test_merges_versions_and_readers(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, root)
    names = [f"n{i}" for i in range(200)]
    assert store.merge_store(rows(spark, names, "a"), root, n_buckets=16) == 1
    pinned = store.read_store(spark, root)
    assert store.merge_store(rows(spark, ["n3", "new", "n3"], "b"), root) == 2
    assert held(spark, root) == {n: "a" for n in names} | {"n3": "b", "new": "b"} and held(spark, root, 1) == {n: "a" for n in names}
    assert pinned.where("category = 'b'").count() == 0 and pinned.count() == 200
    assert {r.original_filename for r in store.read_store(spark, root, category="b").collect()} == {"n3", "new"}
    assert store.merge_store(rows(spark, [], "b"), root) == 2
    changed = rows(spark, ["n5"], "c").withColumn("more", F.lit("x"))
    assert store.merge_store(changed, root) == 3 and held(spark, root)["n5"] == "c"
    store.drop_versions(spark, root, keep=1)
    assert held(spark, root)["n5"] == "c" and len(held(spark, root)) == 201 and os.listdir(f"{tmp_path}/store/versions") == ["000000000003.json"]


def test_bytes_written_follow_the_batch(spark, tmp_path):
    root = f"{tmp_path}/store"
    store.merge_store(rows(spark, [f"n{i}" for i in range(3000)], "a"), root)
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))
    before = size()
    store.merge_store(rows(spark, ["n7"], "b"), root)
    assert size() - before < before / 20


def test_two_writers_lose_nothing(spark, tmp_path):
    root = f"{tmp_path}/store"
    store.merge_store(rows(spark, ["n0"], "a"), root, n_buckets=1)
    both, tried = threading.Barrier(2, timeout=60), []

    def wait(number):
        tried.append(number)
        if number == 2:
            both.wait()  # each has read version 1 before one of them publishes

    work = [threading.Thread(target=lambda n=n: store.merge_store(rows(spark, [n, "n0"], n), root, before_publishing=wait)) for n in ("x", "y")]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert sorted(tried) == [2, 2, 3] and store.latest_version(spark, root) == 3
    assert set(held(spark, root)) == {"n0", "x", "y"}


def test_a_merge_that_was_cut_leaves_the_store_as_it_was(spark, tmp_path):
    root = f"{tmp_path}/store"
    store.merge_store(rows(spark, ["n0"], "a"), root)

    def cut(number):
        raise OSError("gone")

    with pytest.raises(OSError):
        store.merge_store(rows(spark, ["n1"], "a"), root, before_publishing=cut)
    assert held(spark, root) == {"n0": "a"}
    store.merge_store(rows(spark, ["n1"], "b"), root)
    assert held(spark, root) == {"n0": "a", "n1": "b"}


class Slow:
    label = "slow"

    def __init__(self):
        self.seen, self.lock, self.now, self.most = {}, threading.Lock(), 0, 0

    def chat(self, system, user):
        with self.lock:
            self.seen[user] = self.seen.get(user, 0) + 1
            self.now += 1
            self.most = max(self.most, self.now)
        time.sleep(0.05)
        with self.lock:
            self.now -= 1
        if int(user) % 10 == 3 and self.seen[user] < 2:
            raise RuntimeError("try again")
        if int(user) % 10 == 7:
            raise RuntimeError("no")
        return f"answer {user}"


@pytest.mark.parametrize("bound", [1, 10])
def test_calls_in_flight(bound):
    server = Slow()
    caller = backends._Caller(lambda t: server.chat("", t), Calls(in_flight=bound, attempts=2, pause_s=0.01))
    began = time.monotonic()
    got = list(caller.all([str(i) for i in range(40)]))
    took = time.monotonic() - began
    assert [g[0] for g in got] == [None if i % 10 == 7 else f"answer {i}" for i in range(40)]  # in order
    assert {g[1] for i, g in enumerate(got) if i % 10 == 7} == {"no"} and server.most == bound
    assert took < 1.2 if bound == 10 else took > 2
    assert all(server.seen[str(i)] == 2 for i in (3, 13, 7, 17))


def test_a_service_that_is_down_is_left_alone():
    asked = []

    def call(text):
        asked.append(text)
        raise RuntimeError("down")

    caller = backends._Caller(call, Calls(in_flight=1, attempts=1, breaker=3, cool_s=0.3))
    got = list(caller.all("abcdefgh"))
    assert asked == ["a", "b", "c"] and [g[1] for g in got] == ["down"] * 3 + ["service down"] * 5
    time.sleep(0.35)
    caller.call = lambda text: "up"
    assert [g[0] for g in caller.all("xyz")] == ["up"] * 3


def test_deadlines_end_retries():
    caller = backends._Caller(lambda text: 1 / 0, Calls(attempts=50, pause_s=0.05, deadline_s=0.2))
    began = time.monotonic()
    assert next(caller.all(["a"]))[1] == "division by zero" and time.monotonic() - began < 1


def test_ask_in_spark(spark):
    class Fussy:
        label = "fussy"

        def chat(self, system, user):
            time.sleep(0.01)
            if int(user) % 10 == 7:
                raise RuntimeError("no")
            return f"answer {user}"

    prompts = spark.range(30).select(F.col("id").cast("string").alias("user"), "id").repartition(2)
    out = backends.ask(prompts, Fussy(), "", calls=Calls(in_flight=5, attempts=2, pause_s=0.01)).collect()
    assert {r.id: r.answer for r in out} == {i: None if i % 10 == 7 else f"answer {i}" for i in range(30)}
    assert all(r.error == "no" and r.duration_ms > 0 for r in out if r.id % 10 == 7)
