import os

import pytest
from quillspark.sources import journal

STEPS = ["target claimed", "target copied", "target linked", "archive claimed", "archive copied", "archive linked", "removed"]


class Cut(BaseException):
    """As good as a lost machine."""


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names}


@pytest.mark.parametrize("rename", [False, True])
@pytest.mark.parametrize("at", STEPS)
def test_a_cut_after_every_step(tmp_path, at, rename):
    put(f"{tmp_path}/in/a.pdf", "own")
    put(f"{tmp_path}/out/a.pdf", "own")  # the same content, but another's file
    move = lambda **more: journal.move("k", f"{tmp_path}/in/a.pdf", f"{tmp_path}/out/a.pdf", f"{tmp_path}/claims", archive=f"{tmp_path}/old", rename=rename, **more)

    def step(done):
        if done == at:
            raise Cut

    try:
        move(step=step)
    except Cut:
        pass
    assert move() == f"{tmp_path}/out/a - 2.pdf"
    assert files(f"{tmp_path}/out").items() >= {"a.pdf": "own", "a - 2.pdf": "own"}.items()
    assert [f for f in files(f"{tmp_path}/out") if not f.endswith(".part")] == sorted(["a.pdf", "a - 2.pdf"], key=[f for f in files(f"{tmp_path}/out")].index)
    assert files(f"{tmp_path}/in") == {} and (rename or [f for f in files(f"{tmp_path}/old") if not f.endswith(".part")] == ["a.pdf"])


def test_a_name_that_is_taken_meanwhile(tmp_path):
    put(f"{tmp_path}/in/a.pdf", "own")

    def step(done):
        if done == "target copied" and not os.path.exists(f"{tmp_path}/out/a.pdf"):
            put(f"{tmp_path}/out/a.pdf", "other")

    assert journal.move("k", f"{tmp_path}/in/a.pdf", f"{tmp_path}/out/a.pdf", f"{tmp_path}/claims", step=step) == f"{tmp_path}/out/a - 2.pdf"
    assert files(f"{tmp_path}/out") == {"a.pdf": "other", "a - 2.pdf": "own"}


def test_a_journal_goes_on(spark, tmp_path):
    for i in range(20):
        put(f"{tmp_path}/in/{i}.pdf", f"text {i}")
    rows = [(f"{tmp_path}/in/{i}.pdf", f"{tmp_path}/out/{'same' if i < 5 else i}.pdf") for i in range(22)]
    plan = spark.createDataFrame(rows, "source string, target string").repartition(3)
    call = lambda p=None: {r.source: (r.target, r.error) for r in journal.apply_journal(spark, f"{tmp_path}/journal", f"{tmp_path}/claims", p, archive=f"{tmp_path}/old").collect()}
    first = call(plan)
    assert sum(e is not None for _, e in first.values()) == 2 and len(files(f"{tmp_path}/out")) == 20 and files(f"{tmp_path}/in") == {}
    assert sorted(files(f"{tmp_path}/out").values()) == sorted(f"text {i}" for i in range(20)) and len(files(f"{tmp_path}/old")) == 20
    put(f"{tmp_path}/in/20.pdf", "late")
    again = call()
    assert {s: t for s, (t, _) in again.items() if t} == {s: t for s, (t, _) in first.items() if t} | {f"{tmp_path}/in/20.pdf": f"{tmp_path}/out/20.pdf"}
    assert sum(e is not None for _, e in again.values()) == 1
    assert len(files(f"{tmp_path}/out")) == 21
