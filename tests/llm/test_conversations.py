import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F
from quillspark.llm import conversations
from quillspark.llm.conversations import Costs
from quillspark.llm.queries import op12_conversation_repair

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def brute(rows, costs=Costs()):
    """One conversation's rows, plainly: least cost, then the least audit, over all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(i, state, added):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if added < 4:
            for x, role in (("u", "user"), ("a", "assistant")):
                if (state, x) in step:
                    c, a, m = best(i, step[state, x], added + 1)
                    found.append((c + costs.insert, "I" + a, (f"{role}:", *m)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, m = best(i + 1, state, 0)
            found.append((c + costs.delete, "D" + a, m))
            if faults[i] not in ("blank", "duplicate"):
                extra = costs.truncated if faults[i] else 0
                if (state, role[:1]) in step:
                    c, a, m = best(i + 1, step[state, role[:1]], 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *m)))
                for x, new in (("u", "user"), ("a", "assistant")):
                    if (state, x) in step:
                        c, a, m = best(i + 1, step[state, x], 0)
                        found.append((c + extra + costs.rerole, "R" + a, (f"{new}:{text}", *m)))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), 0, -1):  # from the end, so that recursion stays flat
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, made = best(0, "", 0)
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit), hashlib.sha256("\n".join(made).encode()).hexdigest()


def made_up(seed, n=60, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", "a. ", " ", "", None, "é!\n\t", "ok?", "x\x0b", "\xa0", "Long. " * 3, str(rng.random()) + "."])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 8]), role, text))
    return rows + rows[::7]


def frame(spark, rows):
    kind = "conv_id long, turn long, role string, text string, part int, Made string"
    return spark.createDataFrame([(*r, 1, "x") for r in rows], kind).repartition(3)


def checked(spark, rows, costs=Costs()):
    plain = {}
    for r in rows:
        plain.setdefault(r[0], []).append((r[0], r[1], *(" " if x is None else x for x in r[2:])))
    found, repaired = conversations.repair(frame(spark, rows), costs=costs)
    digest = {r.conv_id: r.repaired_sha256 for r in conversations.digests(repaired).collect()}
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert set(got) == set(plain)
    for conv, own in plain.items():
        expected, sha = brute(own, costs)
        assert got[conv] == expected, (conv, own)
        assert digest.get(conv, hashlib.sha256(b"").hexdigest()) == sha, (conv, own)


@pytest.mark.parametrize("costs", [Costs(), Costs(2, 7, 1, 1), Costs(3, 3, 3, 0)])
def test_equals_brute_force(spark, monkeypatch, costs):
    checked(spark, made_up(costs.rerole), costs)


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_long_conversation_in_many_ranges(spark, many_ranges):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "user", "assistant", "tool"]), rng.choice(["a.", "b", f"{t}!", ""])) for t in range(400)]
    rows += [(7, t, "user", "same.") for t in range(30)] * 2 + [(c, 1, "user", "x.") for c in range(20)]
    pieces = conversations.repair(frame(spark, rows))[0]
    assert pieces.count() == 20
    checked(spark, rows)


@pytest.mark.parametrize("costs", [Costs(), Costs(2, 7, 1, 1), Costs(1, 4, 3, 2)])
def test_blocks_and_pieces_agree_with_the_whole(costs):
    rng = random.Random(3)
    for _ in range(150):
        codes = [rng.choice([0, 1, 2, 3, 4, 9, 10, 11, 12]) for _ in range(rng.randrange(1, 25))]
        whole = conversations.solve(codes, costs, 1000)
        assert conversations.solve(codes, costs, 3) == whole
        cut = rng.randrange(len(codes) + 1)
        head, tail = codes[:cut], codes[cut:]
        if not head or not tail:
            continue
        ending = conversations._ending(costs)
        behind = conversations.matrix(tail, costs, 3)
        to_go = [min(behind[q][t] + ending[t] for t in range(4)) for q in range(4)]
        first, state = conversations.piece(head, to_go, costs, False, 4, [0])[0]
        assert first + conversations.piece(tail, ending, costs, True, 4)[state][0] == whole


def test_layers_stay_few_on_a_long_run():
    layers = conversations._to_go([2] * 6400, conversations._ending(Costs()), Costs(), 64)[0]
    assert max(map(len, layers)) < 2 * 64 and len(layers) == 100


def test_the_query_with_damage(spark, tmp_path):
    rng = random.Random(1)
    rows = made_up(9, 40) + [(c, t, "user" if t % 2 == 0 else "assistant", f"{rng.random()}.") for c in range(100, 160) for t in range(6)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    by_conv = {}
    for r in damaged(rows):
        by_conv.setdefault(r[0], []).append(r)
    for conv, r in got.items():
        expected, sha = brute(by_conv[conv]) if conv in by_conv else ((0, 0, 0, 0, 0, 0, ""), hashlib.sha256(b"").hexdigest())
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == expected
        assert r.repaired_sha256 == sha


def test_empty_and_very_long_texts(spark):
    none = frame(spark, []).limit(0)
    found, repaired = conversations.repair(none)
    assert found.count() == 0 and conversations.digests(repaired).count() == 0
    long = "word " * 400_000
    found, repaired = conversations.repair(frame(spark, [(1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 2, "user", long)]))
    assert found.first().audit == "DDD" and repaired.count() == 0


def test_names_pass(spark):
    rows = frame(spark, [(1, 0, "user", "a."), (1, 1, "assistant", "b.")]).select(F.col("conv_id").cast("string").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    found, repaired = conversations.repair(rows, conv_col="c", turn_col="t", role_col="r", text_col="x")
    assert found.first().audit == "KK" and [(r.role, r.text) for r in repaired.orderBy("place").collect()] == [("user", "a."), ("assistant", "b.")]
