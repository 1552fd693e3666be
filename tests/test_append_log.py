import threading

import pytest
from quillspark.sources import readers, sinks

SCHEMA = "event string, original_filename string, ts string"


def rows(spark, names):
    return spark.createDataFrame([("parked", n, f"t{i}") for i, n in enumerate(names)], SCHEMA)


def held(spark, path):
    return [(r.seq, r.original_filename) for r in readers.read_log(spark, path).orderBy("seq").collect()]


def test_numbers_go_on_without_reading(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/log"
    assert sinks.append_log(rows(spark, ["a", "b"]), path) == 2
    with monkeypatch.context() as m:
        m.setattr(sinks, "read_log", lambda *_: pytest.fail("the log is read"))
        assert sinks.append_log(rows(spark, ["c"]), path) == 1 and sinks.append_log(rows(spark, []), path) == 0
    assert held(spark, path) == [(0, "a"), (1, "b"), (2, "c")]


def test_a_log_without_reservations_is_read_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows(spark, ["a", "b", "c"]).coalesce(1).write.json(path)
    assert sinks.append_log(rows(spark, ["d"]), path) == 1
    assert held(spark, path)[-1] == (3, "d")


def test_writers_at_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    work = [threading.Thread(target=lambda n=n: sinks.append_log(rows(spark, [f"{n}{i}" for i in range(5)]), path)) for n in "abc"]
    for t in work:
        t.start()
    for t in work:
        t.join()
    found = held(spark, path)
    assert [s for s, _ in found] == list(range(15)) and len({n for _, n in found}) == 15
