"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Spans of fixed patterns (e-mail, IP, card, phone) are the base.  Every number and every address-like string of the corpus is
an instance; the two words before it, the word before and after it, and the two words after it are its patterns, cut off at
other identifiers; one word at least is needed.  Base strings are seeds.  Spark scores the graph of patterns and distinct instances in rounds: a
pattern's confidence for a kind is the score of its instances over their number plus one, so that whatever else stands
there counts against it; an instance that is no seed, but has the kind's shape, takes the greatest confidence among the
patterns that are trusted: those with ``LEAST`` scored instances and ``TRUSTED`` parts in a thousand.  Scores are whole
numbers, so that results do not depend on the order of sums.  After ``ROUNDS`` every occurrence of a scored instance is a
span of its kind, beside the base spans, which stay.

Runs of digits and what may stand among them are cut out first, and the patterns of numbers matched within these: no match
reaches beyond its run.  All patterns run without recursion or repeated scans, so that texts may be of any length.

Defined cases: a null text is empty and has no spans; repeated rows and copies of a text share a result; distinct instances
count once for a pattern, however often they occur; an instance that holds a base span is no instance to find; an instance
two kinds claim with equal scores goes to the kind listed first; columns of ``docs`` are kept whatever their names, but for
one that is called like the result, which takes its place; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let
from quillspark.llm.common import ascii_lower, materialize, numbered, text_key
from quillspark.scratch import drop_since, written

#: The kinds, in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")
LEAST, TRUSTED, ROUNDS = 5, 700, 3
SURE = 1000  # a seed's score
CONTEXT = 64  # characters of a context that are looked at for words
BROADCAST_FOUND = 200_000  # instances found, or texts that hold them, of at most ``BROADCAST_CHARS`` characters
BROADCAST_CHARS = 16_000_000
_SUMS = 256

#: The base patterns, possessive, and started only where an earlier start would not have matched too.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What numbers are made of, and strings that are like addresses.
RUN = r"[0-9+][0-9\x20().+-]*+"
ADDRESS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?+(?:@|[(\[]at[)\]])\x20?+[A-Za-z0-9-]++"
    r"(?:\x20?+(?:\.|[(\[]dot[)\]])\x20?+[A-Za-z0-9-]++)*+"
)
_SPACE = r"[\x20\x09-\x0D]+"
_MARKS = r"\A[LMR] [\^#$] [\^#$]\z"  # a pattern without any word
_IN_WORD = r"[A-Za-z_@\x{80}-\x{10FFFF}]"
_ADDRESS_SIGNS = ("@", "(at)", "[at]")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda x, y: x + y)


def _before(sizes: Column) -> Column:
    """The sum of what stands before each of the numbers, by blocks, so that work grows gently with their number."""
    n = F.size(sizes)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(_SUMS)), lambda at: F.slice(sizes, at + 1, _SUMS))
    inner = lambda block, start: F.transform(block, lambda x, j: start + _sum(F.slice(block, 1, j)))
    by_block = lambda blocks, sums: F.flatten(F.transform(blocks, lambda b, i: let(_sum(F.slice(sums, 1, i)), lambda s: inner(b, s))))
    return let(cut, lambda blocks: let(F.transform(blocks, _sum), lambda sums: by_block(blocks, sums)))


def _matches(text: Column, pattern: str) -> Column:
    """Matches in order: v, the code points before it (s), and the texts between it and its neighbours (before, after)."""
    placed = lambda gaps, found: let(
        _before(F.transform(found, lambda v, i: F.length(v) + F.length(gaps[i]))),
        lambda starts: F.transform(
            found, lambda v, i: F.struct(v.alias("v"), (starts[i] + F.length(gaps[i])).alias("s"), gaps[i].alias("before"), gaps[i + 1].alias("after"), i.alias("i"))
        ),
    )
    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(gaps, found)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(F.try_to_number(c, F.lit("9")).cast("int"), lambda x: F.when(i % 2 == 1, doubled(x)).otherwise(x)))
    return _sum(places) % 10 == 0


def _is_ip(v: Column) -> Column:
    bare = lambda p: F.ltrim(p, F.lit("0"))
    fits = lambda p: F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), F.left(bare(p), F.lit(3))).cast("int") <= 255).otherwise(F.lit(False))
    return F.forall(F.split(v, r"\."), fits)


def _is_card(v: Column) -> Column:
    return let(_digits(v), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))


def _is_phone(v: Column) -> Column:
    return F.length(_digits(v)).between(10, 15)


def _spans(v: Column, start: Column, pattern: str, kind: str, passes) -> Column:
    found = F.filter(_matches(v, pattern), lambda m: passes(m["v"]))
    number = F.lit(KINDS.index(kind))
    return F.transform(found, lambda m: F.struct((start + m["s"]).alias("start"), number.alias("kind"), (start + m["s"] + F.length(m["v"])).alias("end")))


_NO_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _number_spans(v: Column, start: Column) -> Column:
    parts = [_spans(v, start, IP, "ip", _is_ip), _spans(v, start, CARD, "card", _is_card), _spans(v, start, PHONE, "phone", _is_phone)]
    return F.when(F.length(v) >= 7, F.concat(*parts)).otherwise(F.array().cast(_NO_SPANS))  # the least IP address has 7 characters


def _numbers(text: Column) -> Column:
    """Runs of digits, none for a text without digits."""
    none = F.array().cast("array<struct<v: string, s: int, before: string, after: string, i: int>>")
    return F.when(text.rlike("[0-9]"), _matches(text, RUN)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Base spans of a text that is not null, as an array of (start, kind, end) in order; kinds by number."""
    numbers = F.flatten(F.transform(_numbers(text), lambda m: _number_spans(m["v"], m["s"])))
    mails = F.when(F.contains(text, F.lit("@")), _spans(text, F.lit(0), EMAIL, "email", lambda v: F.lit(True))).otherwise(F.array().cast(_NO_SPANS))
    return F.array_sort(F.concat(mails, numbers))


def _words_of(context: Column) -> Column:
    return F.filter(F.split(ascii_lower(context), _SPACE), lambda w: w != "")


def _contexts(m: Column, n: Column) -> Column:
    """The patterns of a match: words around it, with a mark where the text or the way to the next match ends."""
    left = F.concat(F.when(m["i"] == 0, F.lit("^ ^ ")).otherwise(F.lit("# # ")), F.right(m["before"], F.lit(CONTEXT)))
    right = F.concat(F.left(m["after"], F.lit(CONTEXT)), F.when(m["i"] == n - 1, F.lit(" $ $")).otherwise(F.lit(" # #")))
    named = lambda le, ri: F.array(
        F.concat_ws(" ", F.lit("L"), F.element_at(le, -2), F.element_at(le, -1)),
        F.concat_ws(" ", F.lit("M"), F.element_at(le, -1), ri[0]),
        F.concat_ws(" ", F.lit("R"), ri[0], ri[1]),
    )
    worded = lambda found: F.filter(found, lambda p: ~p.rlike(_MARKS))
    return worded(let(_words_of(left), lambda le: let(_words_of(right), lambda ri: named(le, ri))))


def _slots(text: Column) -> Column:
    """Instances of a text: v (A-Z lower-cased), s, e, whether address-like, and their patterns."""

    def slot(m: Column, v: Column, n: Column, address: bool) -> Column:
        return F.struct(ascii_lower(v).alias("v"), m["s"].alias("s"), (m["s"] + F.length(v)).alias("e"), F.lit(address).alias("address"), _contexts(m, n).alias("patterns"))

    trimmed = lambda m: F.rtrim(m["v"], F.lit(" ().+-"))
    open_left = lambda m: ~F.right(m["before"], F.lit(1)).rlike(_IN_WORD)
    open_right = lambda m: (trimmed(m) != m["v"]) | ~F.left(m["after"], F.lit(1)).rlike(_IN_WORD)
    alone = lambda found: F.filter(found, lambda m: (trimmed(m) != "") & open_left(m) & open_right(m))
    numbers = let(_numbers(text), lambda found: F.transform(alone(found), lambda m: slot(m, trimmed(m), F.size(found), False)))
    mails = let(_matches(text, ADDRESS), lambda found: F.transform(found, lambda m: slot(m, m["v"], F.size(found), True)))
    some = F.contains(text, F.lit(_ADDRESS_SIGNS[0])) | F.contains(text, F.lit(_ADDRESS_SIGNS[1])) | F.contains(text, F.lit(_ADDRESS_SIGNS[2]))
    none = F.array().cast("array<struct<v: string, s: int, e: int, address: boolean, patterns: array<string>>>")
    return F.concat(numbers, F.when(some, mails).otherwise(none))


def _seed(v: Column, address: Column) -> Column:
    """The number of the kind whose base pattern the whole string fits, else null."""
    whole = lambda p: v.rlike(rf"\A(?:{p})\z")
    return (
        F.when(address, F.when(whole(EMAIL), 0))
        .when(whole(IP) & _is_ip(v), 1)
        .when(whole(CARD) & _is_card(v), 2)
        .when(whole(PHONE) & _is_phone(v), 3)
    )


def _shapes(v: Column, address: Column) -> Column:
    """Numbers of the kinds that a string without base spans could be."""
    digits = F.length(_digits(v))
    quad, line = v.rlike(rf"\A(?:{IP})\z"), v.rlike(rf"\A(?:{CARD})\z")
    kinds = [
        F.when(address & ~v.rlike(EMAIL), 0),
        F.when(~address & quad, 1),
        F.when(~address & line & digits.between(12, 19), 2),
        F.when(~address & ~quad & digits.between(7, 15), 3),
    ]
    free = address | (F.size(_number_spans(v, F.lit(0))) == 0)
    return F.when(free, F.filter(F.array(*kinds), lambda k: k.isNotNull())).otherwise(F.array().cast("array<int>"))


def discover(slots: DataFrame, *, least: int = LEAST, trusted: int = TRUSTED, rounds: int = ROUNDS) -> DataFrame:
    """(v, address, kind, score) of the instances found, from rows (v, address, patterns)."""
    spark = slots.sparkSession
    edges = slots.select("v", "address", F.explode("patterns").alias("pattern")).distinct()
    edges = edges.withColumn("seed", _seed(F.col("v"), F.col("address")))
    edges = materialize(edges.withColumn("shapes", F.when(F.col("seed").isNull(), _shapes(F.col("v"), F.col("address")))), "edges")
    seeds = [F.sum((F.coalesce("seed", F.lit(-1)) == k).cast("long")).alias(f"s{k}") for k in range(len(KINDS))]
    patterns = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *seeds).where(F.col("n") >= least)
    patterns = patterns.select("pattern", "n", F.posexplode(F.array(*[f"s{k}" for k in range(len(KINDS))])).alias("kind", "seeds"))
    patterns = materialize(patterns, "patterns")
    unseen = edges.where(F.size("shapes") > 0).select("v", "address", "pattern", F.explode("shapes").alias("kind"))
    unseen = materialize(unseen.join(patterns.select("pattern").distinct(), "pattern", "left_semi"), "unseen")
    found = materialize(unseen.select("v", "address", "kind", F.lit(0).cast("long").alias("score")).limit(0), "found")
    mark = written()
    for _ in range(rounds):
        held = unseen.join(found, ["v", "address", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("more"), F.count(F.lit(1)).alias("new"))
        judged = patterns.join(held, ["pattern", "kind"], "left")
        support = F.col("seeds") * SURE + F.coalesce("more", F.lit(0))
        sure = judged.select("pattern", "kind", F.floor(support / (F.col("n") + 1)).alias("score"), (F.col("seeds") + F.coalesce("new", F.lit(0))).alias("scored"))
        sure = sure.where((F.col("scored") >= least) & (F.col("score") >= trusted)).select("pattern", "kind", "score")
        # a crowd of instances of one pattern is the large side of a join with the patterns, of which few are trusted
        best = unseen.join(sure, ["pattern", "kind"]).groupBy("v", "address").agg(F.max(F.struct("score", (-F.col("kind")).alias("first"))).alias("b"))
        found = materialize(best.select("v", "address", (-F.col("b.first")).alias("kind"), "b.score"), "found")
        drop_since(spark, mark)
        if found.isEmpty():
            break
    return found


def find_private(docs: DataFrame, *, text_col: str = "text", info_col: str = "private", **options) -> DataFrame:
    """``docs`` with a struct column ``private``: base and all spans, as arrays of (start, kind, end) in order; kinds are
    numbers of ``KINDS``, places count code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slots = docs.select(*text_key(F.col(text_col)), F.explode(_slots(text)).alias("x")).select("key_a", "key_b", "x.*")
    slots = materialize(slots, "slots")
    found = discover(slots, **options)
    if found.count() <= BROADCAST_FOUND:
        found = F.broadcast(found)
    spans = slots.join(found, ["v", "address"]).select("key_a", "key_b", F.struct(F.col("s").alias("start"), "kind", F.col("e").alias("end")).alias("span"))
    per_text = spans.groupBy(F.col("key_a").alias("found_a"), F.col("key_b").alias("found_b")).agg(F.collect_set("span").alias("added"))  # a text's own
    per_text = materialize(per_text, "found-spans")
    bound = per_text.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("added")).alias("spans")).first()
    if bound.n <= BROADCAST_FOUND and (bound.spans or 0) * 12 <= BROADCAST_CHARS:
        per_text = F.broadcast(per_text)
    held, names, kept = numbered(docs, info_col)
    own = F.coalesce(F.col(names[docs.columns.index(text_col)]), F.lit(""))
    key_a, key_b = text_key(own)
    read = held.select(*[n for n, _ in kept], key_a, key_b, base_spans(own).alias("base"))
    joined = read.join(per_text, (F.col("key_a") == F.col("found_a")) & (F.col("key_b") == F.col("found_b")), "left")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast(_NO_SPANS)))))
    return joined.select(*[F.col(n).alias(c) for n, c in kept], F.struct(F.col("base"), every.alias("spans")).alias(info_col))


def named_spans(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"], x["end"])), ",")
