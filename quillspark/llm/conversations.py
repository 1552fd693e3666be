"""Conversation structure repair by layers of cost.

A repaired conversation's role initials are empty, or alternate ``ua`` after at most one ``s``.  Four grammar states say
what has been read: nothing, ``s``, ``u``, ``a``; they are bits.  Layer c holds, for every place between turns, the states
from which the rest can be repaired at a cost of exactly c.  A layer follows from earlier ones by an edit that costs
something, and from itself by keeping a turn; the first layer that has the opening state at the first place gives the
cost, and walking the bits forward, the least letter first, gives the least audit.

A conversation may be of any length.  Equal rows of a turn are one run with a count.  Runs are dealt out in ranges of
their order, so that a long conversation is spread; each range of it becomes one piece.  A piece that is a whole
conversation is solved at once.  Of the others, at most one to a border between ranges, pieces first yield the cost from
each state to each state; the costs to go at every border follow from those, backwards; then each piece is walked from
each of the four states, and the states at the borders follow forwards.  Layers run over ``BLOCK`` turns at a time,
counted from the cheapest state, and so stay few.

Defined cases: null roles and texts are one space; a null conversation id is a conversation; turns go in order, nulls
first, rows of one turn by role, then by the SHA-256 of their text (lowercase hex); equal rows of a turn all but the first
are duplicates; a role that is empty or starts otherwise than with ``s``, ``u`` or ``a`` can be reroled or deleted only;
texts of any length; other columns, whatever their names, take no part; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

BLOCK = 64
#: White space of the contract, and the ends of a whole text.
SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

_FORCED, _TRUNCATED = 0, 8  # a turn's code: 0 if it must go, else the number of its initial, plus 8 if it is truncated
_OTHER = 4
_INF = 1 << 60
_START, _S, _U, _A = range(4)


@dataclass(frozen=True)
class Costs:
    """What edits cost; all but ``truncated`` must cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damage(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text), damaged by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2
    removes its ``.!?``, 3 repeats it, 4 sets its role to ``user``; nulls in role and text become one space."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = (F.crc32(named.cast("binary")) % 20).alias("fault")
    read = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")
    return read.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def _any(b: int) -> int:
    """States before an added or reroled turn: each has one role that goes on."""
    u = (b >> _U) & 1
    return u | (u << _S) | (u << _A) | (((b >> _A) & 1) << _U)


def _kept(letter: int, b: int) -> int:
    """States before a turn of that initial that is kept."""
    if letter == 1:
        return (b >> _S) & 1
    if letter == 2:
        u = (b >> _U) & 1
        return u | (u << _S) | (u << _A)
    return ((b >> _A) & 1) << _U if letter == 3 else 0


#: What the two functions give for every set of states, and the state after a kept turn or after an added one.
_ANY = [_any(b) for b in range(16)]
_KEPT = [[_kept(letter, b) for b in range(16)] for letter in range(5)]
_NEXT = {(_START, 1): _S, (_START, 2): _U, (_S, 2): _U, (_A, 2): _U, (_U, 3): _A}
_ON = (_U, _U, _A, _U)


def _layers(codes: list[int], to_go: list[int], costs: Costs, last: bool, whole: bool) -> tuple[list[bytearray], int]:
    """Layers over a block's turns that need not go, counted from the least cost to go; ``last``: turns may be added
    behind; ``whole``: the opening state alone counts, else all states that can be reached."""
    n, base = len(codes), min(to_go)
    layers: list[bytearray] = []
    blank = bytearray(n + 1)
    layer = lambda c: layers[c] if c >= 0 else blank
    wanted, seen = 1 if whole else 15, 0
    limit = costs.delete * n + 4 * costs.insert + max((g - base for g in to_go if g < _INF), default=0)
    while seen & wanted != wanted and len(layers) <= limit:
        c = len(layers)
        now = bytearray(n + 1)
        layers.append(now)
        removed, added = layer(c - costs.delete), layer(c - costs.insert)
        changed, kept_cut, changed_cut = layer(c - costs.rerole), layer(c - costs.truncated), layer(c - costs.rerole - costs.truncated)
        b = sum(1 << q for q in range(4) if to_go[q] - base == c)
        now[n] = b = b | _ANY[added[n]] if last else b
        for i in range(n - 1, -1, -1):
            code = codes[i]
            if code < _TRUNCATED:
                b = _KEPT[code][b] | _ANY[changed[i + 1]] | removed[i + 1] | _ANY[added[i]]
            else:
                letter = _KEPT[code - _TRUNCATED]
                b = letter[kept_cut[i + 1] if costs.truncated else b] | _ANY[changed_cut[i + 1]] | removed[i + 1] | _ANY[added[i]]
            now[i] = b
        seen |= b
    return layers, base


def _walk(codes: list[int], layers: list[bytearray], state: int, spent: int, costs: Costs, last: bool) -> tuple[list[tuple[str, str]], str, int]:
    """The least letters from a state with so much to spend: (letters, what is made) per turn, what is added behind, and
    the last state.  Made: ``u`` and ``a`` for added turns, ``K`` for one kept, ``U`` and ``A`` for one reroled."""
    has = lambda c, i, q: 0 <= c < len(layers) and layers[c][i] >> q & 1
    out, letters, made = [], "", ""
    i, n = 0, len(codes)
    while i < n:
        letter, extra = codes[i] % _TRUNCATED, costs.truncated if codes[i] >= _TRUNCATED else 0
        kept = _NEXT.get((state, letter), -1)
        if has(spent - costs.delete, i + 1, state):
            spent, done, new = spent - costs.delete, "D", ""
        elif has(spent - costs.insert, i, _ON[state]):
            spent, state = spent - costs.insert, _ON[state]
            letters, made = letters + "I", made + ("u" if state == _U else "a")
            continue
        elif kept >= 0 and has(spent - extra, i + 1, kept):
            spent, state, done, new = spent - extra, kept, "K", "K"
        else:
            spent, state = spent - costs.rerole - extra, _ON[state]
            done, new = "R", "U" if state == _U else "A"
        out.append((letters + done, made + new))
        letters, made, i = "", "", i + 1
    behind = ""
    while last and spent > 0:
        spent, state = spent - costs.insert, _ON[state]
        behind += "u" if state == _U else "a"
    return out, behind, state


def _ending(costs: Costs) -> list[int]:
    """Cost to go behind the last turn: an open ``s`` or ``u`` is closed by added turns."""
    return [0, 2 * costs.insert, costs.insert, 0]


def _to_go(codes: list[int], to_go: list[int], costs: Costs, block: int) -> tuple[list[list[bytearray]], list[list[int]]]:
    """Layers of every block of a piece, and the cost to go from each state before every block and behind the last."""
    cuts = list(range(0, len(codes), block))
    kept, before = [], [to_go]
    for at in reversed(cuts):
        layers, base = _layers(codes[at : at + block], before[-1], costs, False, False)
        kept.append(layers)
        before.append([next((base + c for c, x in enumerate(layers) if x[0] >> q & 1), _INF) for q in range(4)])
    return kept[::-1], before[::-1]


def solve(codes: list[int], costs: Costs, block: int = BLOCK) -> list[tuple[str, str]]:
    """(letters, made) of every turn of a whole conversation; turns of code 0 must go."""
    free = [c for c in codes if c != _FORCED]
    if len(free) <= block:
        layers, _ = _layers(free, [0, _INF, _INF, 0], costs, True, True)
        found, behind, _ = _walk(free, layers, _START, len(layers) - 1, costs, True)
        return _spread(codes, found, behind)
    return piece(codes, _ending(costs), costs, True, block, [_START])[_START][0]


def piece(codes: list[int], to_go: list[int], costs: Costs, last: bool, block: int = BLOCK, states=range(4)) -> dict[int, tuple[list[tuple[str, str]], int]]:
    """(letters, made) of every turn, and the state behind, from each state before a piece of a conversation."""
    free = [c for c in codes if c != _FORCED]
    kept, before = _to_go(free, to_go, costs, block)
    out = {}
    for first in states:
        state, found = first, []
        for k, layers in enumerate(kept):
            spent = before[k][state] - min(before[k + 1])
            part, _, state = _walk(free[k * block : (k + 1) * block], layers, state, spent, costs, False)
            found += part
        behind = ("ua" if state == _S else "a" if state == _U else "") if last else ""
        out[first] = _spread(codes, found, behind), state
    return out


def _spread(codes: list[int], found: list[tuple[str, str]], behind: str) -> list[tuple[str, str]]:
    """Letters of all turns from those of the turns that need not go."""
    rest = iter(found)
    out = [("D", "") if c == _FORCED else next(rest) for c in codes]
    if out and behind:
        out[-1] = (out[-1][0] + "I" * len(behind), out[-1][1] + behind)
    return out


def matrix(codes: list[int], costs: Costs, block: int = BLOCK) -> list[list[int]]:
    """Cost from each state before a piece to each state behind it, without the turns that must go."""
    free = [c for c in codes if c != _FORCED]
    gone = costs.delete * len(free)
    best_s = min((gone - costs.delete + (costs.truncated if c >= _TRUNCATED else 0) for c in free if c % _TRUNCATED == 1), default=_INF)
    out = [[_INF] * 4 for _ in range(4)]
    out[_START][_START], out[_S][_S], out[_START][_S] = gone, gone, best_s  # all else is deleted
    for end in (_U, _A):
        _, before = _to_go(free, [0 if q == end else _INF for q in range(4)], costs, block)
        for q in range(4):
            out[q][end] = before[0][q]
    return out


def _costs_of(letters: str, code: int, costs: Costs) -> int:
    price = {"D": costs.delete, "I": costs.insert, "K": 0, "R": costs.rerole}
    stays = code >= _TRUNCATED and ("K" in letters or "R" in letters)
    return sum(price[x] for x in letters) + (costs.truncated if stays else 0)


_KEYS = ["no_conv", "conv"]
_RUN = ["no_conv", "conv", "has_turn", "turn", "role", "sha"]


def _edited(costs: Costs, states: bool):
    """Pieces to their edits; ``states``: pieces of a split conversation, with the cost to go and the state before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name != "conv"}
            letters, made, cost = [], [], []
            for i, codes in enumerate(cols["codes"]):
                if states:
                    first = cols["state"][i]
                    found = piece(codes, cols["to_go"][i], costs, cols["is_last"][i], states=[first])[first][0]
                else:
                    found = solve(codes, costs)
                copies = cols["copies"][i]
                # copies stand right behind the first, before anything that is added behind
                every = [_with_copies(x, m) for (x, _), m in zip(found, copies, strict=True)]
                letters.append(every)
                made.append([x[1] for x in found])
                cost.append(sum(_costs_of(x, c, costs) for x, c in zip(every, codes, strict=True)))
            names = ["no_conv", "conv", "part", "letters", "made", "cost"]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("no_conv"), batch.column("conv"), batch.column("part"),
                    pa.array(letters, pa.list_(pa.string())), pa.array(made, pa.list_(pa.string())), pa.array(cost, pa.int64()),
                ],
                names,
            )

    return run


def _with_copies(letters: str, copies: int) -> str:
    at = len(letters.rstrip("I"))
    return letters[:at] + "D" * (copies - 1) + letters[at:]


def _borders(costs: Costs, forward: bool):
    """Per split conversation, with an entry to a piece in order: the cost to go behind each piece, from their matrices;
    or, forward, the state before each piece, from the states behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch.column("pieces").to_pylist():
                if forward:
                    found, state = [], _START
                    for p in pieces:
                        found.append([state])
                        state = p["found"][state]
                else:
                    found, now = [], _ending(costs)
                    for p in reversed(pieces):
                        found.append(now)
                        now = [min(min(p["found"][4 * q + t] + now[t] for t in range(4)), _INF) for q in range(4)]
                    found.reverse()
                out.append([{"part": p["part"], "found": f, "is_last": i == len(pieces) - 1} for i, (p, f) in enumerate(zip(pieces, found, strict=True))])
            kind = pa.list_(pa.struct([("part", pa.int32()), ("found", pa.list_(pa.int64())), ("is_last", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("no_conv"), batch.column("conv"), pa.array(out, kind)], ["no_conv", "conv", "pieces"])

    return run


def _summed(costs: Costs, walked: bool):
    """Pieces to their matrices, or, with the cost to go behind them, to the state behind from each state before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name != "conv"}
            found = []
            for i, codes in enumerate(cols["codes"]):
                if walked:
                    by_state = piece(codes, cols["to_go"][i], costs, cols["is_last"][i])
                    found.append([by_state[q][1] for q in range(4)])
                else:
                    found.append([x for row in matrix(codes, costs) for x in row])
            yield pa.RecordBatch.from_arrays(
                [batch.column("no_conv"), batch.column("conv"), batch.column("part"), pa.array(found, pa.list_(pa.int64()))], ["no_conv", "conv", "part", "found"]
            )

    return run


def _at_borders(pieces: DataFrame, conv: str, costs: Costs, walked: bool) -> DataFrame:
    """(no_conv, conv, part, found, is_last) of the pieces of split conversations."""
    summed = pieces.mapInArrow(_summed(costs, walked), f"no_conv boolean, conv {conv}, part int, found array<long>")
    # as many entries as ranges at most
    per = summed.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("part", "found"))).alias("pieces"))
    kind = f"no_conv boolean, conv {conv}, pieces array<struct<part: int, found: array<long>, is_last: boolean>>"
    return per.mapInArrow(_borders(costs, walked), kind).select(*_KEYS, F.inline("pieces"))


def _initial(role: Column) -> Column:
    return F.left(role, F.lit(1))


def _legal(before: Column, after: Column) -> Column:
    return F.concat(before, after).isin("su", "ua", "au")


def repair(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs()
) -> tuple[DataFrame, DataFrame]:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; and the repaired rows: conv_id,
    place (a struct that orders them), role, text."""
    conv_type = rows.schema[conv_col].dataType.simpleString()
    zero = F.lit(0 if conv_type not in ("string", "binary") else "").cast(conv_type)
    text = F.coalesce(F.col(text_col), F.lit(" "))
    read = rows.select(
        F.col(conv_col).isNull().alias("no_conv"),
        F.coalesce(F.col(conv_col), zero).alias("conv"),
        F.col(turn_col).isNotNull().alias("has_turn"),  # nulls first
        F.coalesce(F.col(turn_col), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.sha2(text, 256).alias("sha"),
        text.alias("text"),
    )
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    faults = read.select(*_RUN, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("truncated"))
    runs = faults.groupBy(*_RUN).agg(F.count(F.lit(1)).alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    runs = materialize(runs, "turn-runs")
    first = runs.where(~F.col("blank")).groupBy("no_conv", "conv", "role", "sha").agg(F.min(F.struct("has_turn", "turn")).alias("first"))
    seen = runs.join(first, ["no_conv", "conv", "role", "sha"], "left").withColumn("again", ~F.col("blank") & (F.struct("has_turn", "turn") != F.col("first")))
    initial = _initial(F.col("role"))
    letter = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(_OTHER)
    code = F.when(F.col("blank") | F.col("again"), _FORCED).otherwise(letter + F.when(F.col("truncated"), _TRUNCATED).otherwise(0))
    ordered = seen.withColumn("code", code).repartitionByRange(*_RUN).withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "turn-order")
    in_piece = Window.partitionBy("part", *_KEYS).orderBy("has_turn", "turn", "role", "sha")
    placed = ordered.withColumn("n", F.row_number().over(in_piece) - 1).withColumn("before", F.lag(_initial(F.col("role"))).over(in_piece))
    free = ~F.col("blank") & ~F.col("again")
    own = F.col("copies") - 1
    pieces = placed.groupBy("part", *_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("n", "code", "copies"))).alias("turns"),  # a range's share of a conversation
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("n_blank"),
        F.sum(F.when(F.col("again"), F.col("copies")).when(free, own).otherwise(0)).alias("n_duplicate"),
        F.sum((free & F.col("truncated")).cast("long")).alias("n_truncated"),
        F.sum(own + F.coalesce((~_legal(F.col("before"), _initial(F.col("role")))).cast("long"), F.lit(0))).alias("n_illegal"),
        F.min_by(_initial(F.col("role")), "n").alias("head"),
        F.max_by(_initial(F.col("role")), "n").alias("tail"),
    )
    pieces = pieces.select("part", *_KEYS, "turns.code", "turns.copies", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "head", "tail").withColumnRenamed("code", "codes")
    pieces = materialize(pieces, "turn-pieces")
    split = pieces.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEYS)
    split = F.broadcast(materialize(split, "split"))  # at most one to a border between ranges
    solved = f"no_conv boolean, conv {conv_type}, part int, letters array<string>, made array<string>, cost long"
    whole = pieces.join(split, _KEYS, "left_anti").select(*_KEYS, "part", "codes", "copies")
    edits = whole.mapInArrow(_edited(costs, False), solved)
    if not split.isEmpty():
        torn = materialize(pieces.join(split, _KEYS, "left_semi").select(*_KEYS, "part", "codes", "copies"), "torn")
        ends = _at_borders(torn, conv_type, costs, False).withColumnRenamed("found", "to_go")
        torn = materialize(torn.join(ends, [*_KEYS, "part"]), "torn-to-go")
        states = _at_borders(torn, conv_type, costs, True).select(*_KEYS, "part", F.col("found")[0].alias("state"))
        edits = edits.unionByName(torn.join(states, [*_KEYS, "part"]).mapInArrow(_edited(costs, True), solved))
    edits = materialize(edits, "edits")
    audits = edits.select(*_KEYS, "part", F.array_join("letters", "").alias("audit"), "cost")
    audits = audits.groupBy(*_KEYS).agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "audit")))["audit"], "").alias("audit"), F.sum("cost").alias("cost"))
    ends = F.array_sort(F.collect_list(F.struct("part", "head", "tail")))  # as many as ranges at most
    borders = F.expr("aggregate(sequence(1, size(ends)), 0L, (x, i) -> x + if(i < size(ends) and not concat(ends[i - 1].tail, ends[i].head) in ('su', 'ua', 'au'), 1, 0))")
    totals = pieces.groupBy(*_KEYS).agg(*[F.sum(f"n_{x}").alias(x) for x in ("blank", "duplicate", "truncated", "illegal")], ends.alias("ends"))
    totals = totals.withColumn("illegal", F.col("illegal") + borders).drop("ends")
    dated = runs.where("has_turn").groupBy(*_KEYS).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    every = totals.join(audits, _KEYS).join(dated, _KEYS, "left")
    conv_id = F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    conversations = every.select(conv_id, *counts, "audit")
    changes = edits.select(*_KEYS, "part", F.posexplode("made").alias("n", "made")).where("made <> ''")
    changes = changes.join(placed.select("part", "n", *_RUN), [*_KEYS, "part", "n"]).select(*_RUN, "made")
    texts = read.groupBy(*_RUN).agg(F.any_value("text").alias("text"))
    turns = changes.join(texts, _RUN).select(*_RUN, "text", F.posexplode(F.split("made", "")).alias("at", "x"))
    role = F.when(F.col("x") == "K", F.col("role")).when(F.lower("x") == "u", F.lit("user")).otherwise(F.lit("assistant"))
    place = F.struct("has_turn", "turn", "role", "sha", "at").alias("place")
    new_text = F.when(F.col("x").isin("u", "a"), F.lit("")).otherwise(F.col("text")).alias("text")
    return conversations, turns.select(conv_id, place, role.alias("role"), new_text)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows, ``role:text`` joined by newlines; a digest has to read a conversation
    from its start to its end, so rows pass one after the other, and none is held."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    dealt = repaired.withColumn("no_conv", F.col("conv_id").isNull()).repartition("no_conv", "conv_id").sortWithinPartitions("no_conv", "conv_id", "place")
    return dealt.select("conv_id", "role", "text").mapInArrow(_digested, f"conv_id {kind}, repaired_sha256 string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, running = None, None
    for batch in batches:
        done = []
        for i, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if running is None or i != now:
                if running is not None:
                    done.append((now, running.hexdigest()))
                now, running = i, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode("utf-8", "replace"))
        yield _digest_batch(done, batch.schema.field(0).type)
        kind = batch.schema.field(0).type
    if running is not None:
        yield _digest_batch([(now, running.hexdigest())], kind)


def _digest_batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
