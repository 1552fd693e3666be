"""Metadata of a document's text as column expressions: currency, dates, amounts, account, owner, issuer.

Every function takes columns and returns a column; nothing is collected and no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.config import AMOUNT_LABELS, DEFAULT, MONTHS, RoutingConfig
from quillspark.functions.text import folded, found, let, quote, rx, stem

#: What the matchers accept.
CURRENCY = {"$": r"\$\s*[\d,]+", "S/": r"\bS/\.?\s*[\d,]+", "€": r"€\s*[\d,]+|[\d,]+\s*€", "£": r"£\s*[\d,]+"}
NUMBER = r"([\d,]+(?:\.\d{1,2})?)"
SIGN = r"(?:\$|S/\.?|€|£)?\s*"
BIRTH_LABEL = r"(?:date\s+of\s+birth|d\.?o\.?b\.?|birth\s+date|born\s+on)"
BIRTH_DATE = r"\d{1,2}[/\-]\d{1,2}[/\-]\d{4}"
BIRTH_LABEL_ASCII = r"[bd](?:(?<=d)(?:ate\s+of\s+birth|\.?o\.?b\.?)|(?<=b)(?:irth\s+date|orn\s+on))"  # the same, of lower case
MARK = "\x00"  # stands between parts of a text
BIRTH_REACH = 200
PERIOD = r"(?:billing period|service period|statement period)[:\s]+([A-Za-z]{3,9})\s+(\d{1,2})\s*[-–—to]+\s*[A-Za-z]{3,9}\s+\d{1,2}[,\s]+(\d{4})"
NAMED_DATE = r"\b([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})\b"
NUMERIC_DATE = r"\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})\b"
ISO_DATE = r"\b(\d{4})-(\d{2})-(\d{2})\b"
BARE_YEAR = r"\b(20\d{2}|19\d{2})\b"
FIRST_OF_JANUARY = r"january\s+1|jan\.?\s+1\b|1/1/"
BARE_AMOUNT = r"(?:\$|S/\.?)\s*([\d,]+\.\d{2})"
ACCOUNT_FULL = r"(?:account|acct|account\s*#|account\s*number)[:\s#]*(\d{6,})"
ACCOUNT_ENDING = r"(?:ending\s+in|last\s+(\d+)\s+digits?)[:\s]*(\d{3,4})"
ACCOUNT_MASKED = r"(?:[Xx*#]{2,})(\d{3,4})"
ACCOUNT_SHORT = r"(?:account|acct)[\s#]*[\dX*#\s\-]*?(\d{4})\b"
OWNER = (
    r"(?:Dear|Greetings)[,\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
    r"(?:Cardholder|Account Holder|Account Owner|Holder)[:\s]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
)
HEADER_CHARS, FOOTER_CHARS = 1500, 1000
NAMED_WHOLE = r"^(\d{4})(\d{2})(\d{2})(?:[_\-]|$)"
NAMED_FULL = r"^(\d{4})[\-._](\d{1,2})[\-._](\d{1,2})(?:\D|$)"
NAMED_SHORT = r"^(\d{4})[\-._](\d{1,2})(?:\D|$)"
#: Strings of which a text that a pattern matches holds one; they are cheap to look for.
HINTS = {
    PERIOD: ("billing period", "service period", "statement period"),
    ACCOUNT_FULL: ("account", "acct"),
    ACCOUNT_ENDING: ("ending", "last"),
    ACCOUNT_SHORT: ("account", "acct"),
    BIRTH_LABEL: ("birth", "born", "dob", "d.ob", "do.b", "d.o.b"),
}


def _hinted(folded_text: Column, pattern: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(folded_text, F.lit(x)) for x in HINTS[pattern]])


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The first ``n`` groups of the first match, empty without one; the pattern is matched no more once it fails."""
    first = F.regexp_extract(text, pattern, 0)
    return let(first, lambda m: F.when(m == "", F.array(*[F.lit("")] * n)).otherwise(F.array(*[F.regexp_extract(text, pattern, g) for g in range(1, n + 1)])))


def currency(text: Column) -> Column:
    """The sign that stands by most numbers; the dollar if none does or none has more."""
    count = lambda sign, p: F.when(F.contains(text, F.lit(sign)), F.regexp_count(text, F.lit(rx(p)))).otherwise(F.lit(0))
    counts = F.struct(*[count(sign, p).alias(f"n{i}") for i, (sign, p) in enumerate(CURRENCY.items())])
    return let(counts, lambda c: _most_frequent({sign: c[f"n{i}"] for i, sign in enumerate(CURRENCY)}))


def _most_frequent(n: Mapping[str, Column]) -> Column:
    most = F.greatest(*n.values())
    out = F.when(n["$"] >= most, F.lit("$"))
    for sign in ("S/", "€"):
        out = out.when(n[sign] == most, F.lit(sign))
    return out.otherwise(F.lit("£"))


def _iso(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day))


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _fits(month: Column, day: Column | None = None) -> Column:
    fine = _int(month).between(1, 12)
    return fine if day is None else fine & _int(day).between(1, 31)


def date_from_filename(name: Column) -> Column:
    """The date a file name starts with: YYYYMMDD, year-month-day or year-month."""

    def read(s: Column) -> Column:
        whole = let(_groups(s, rx(NAMED_WHOLE), 3), lambda g: F.when(_fits(g[1], g[2]), _iso(g[0], g[1], g[2])))
        full = let(_groups(s, rx(NAMED_FULL), 3), lambda g: F.when(_fits(g[1], g[2]), _iso(g[0], g[1], g[2])))
        short = let(_groups(s, rx(NAMED_SHORT), 2), lambda g: F.when(_fits(g[1]), _iso(g[0], g[1], F.lit("1"))))
        return F.when(s.rlike(rx(r"^\d{4}")), F.coalesce(whole, full, short))

    return let(stem(F.coalesce(name, F.lit(""))), read)


def _starts(pieces: Column, matches: Column) -> Column:
    """Where the matches start, from what stands between them."""
    step = lambda acc, i: F.struct(
        F.concat(acc["at"], F.array(acc["n"] + F.length(F.get(pieces, i)))).alias("at"),
        (acc["n"] + F.length(F.get(pieces, i)) + F.length(F.get(matches, i))).alias("n"),
    )
    begin = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))
    indices = F.filter(F.sequence(F.lit(0), F.size(matches)), lambda i: i < F.size(matches))
    return F.aggregate(indices, begin, step, lambda acc: acc["at"])


def _blanked_ascii(text: Column) -> Column:
    """``without_birth_dates`` of a text in ASCII without the mark: one pass for labels, one for dates."""
    parts = F.split(F.regexp_replace(F.lower(text), BIRTH_LABEL_ASCII, f"{MARK}$0"), MARK, -1)

    def blanked(labels: Column) -> Column:
        step = lambda acc, p: F.struct(
            F.concat(acc["out"], F.when(acc["date"] & F.exists(labels, lambda x: F.abs(acc["n"] - x) <= BIRTH_REACH), F.repeat(F.lit(" "), F.length(p))).otherwise(p)).alias("out"),
            (acc["n"] + F.length(p)).alias("n"),
            (~acc["date"]).alias("date"),
        )
        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("date"))
        pieces = F.split(F.regexp_replace(text, BIRTH_DATE, f"{MARK}$0{MARK}"), MARK, -1)
        return F.when(F.size(labels) > 0, F.aggregate(pieces, begin, step, lambda acc: acc["out"])).otherwise(text)

    ends = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.array().cast("array<int>"),
        lambda acc, p: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.length(p))),
    )
    return let(ends, blanked)


def without_birth_dates(text: Column, plain: Column | None = None) -> Column:
    """Blanks dates within 200 characters of a date-of-birth label; everything keeps its place.  ``plain`` is the text
    as ``folded`` gives it, where that is known already."""
    pieces, dates = F.split(text, rx(BIRTH_DATE), -1), F.regexp_extract_all(text, F.lit(rx(BIRTH_DATE)), F.lit(0))
    label_pieces = F.split(text, rx(BIRTH_LABEL, "i"), -1)
    labels = _starts(label_pieces, F.regexp_extract_all(text, F.lit(rx(BIRTH_LABEL, "i")), F.lit(0)))
    near = lambda at: F.exists(labels, lambda x: F.abs(at - x) <= BIRTH_REACH)
    blanked = F.zip_with(dates, _starts(pieces, dates), lambda d, at: F.when(near(at), F.repeat(F.lit(" "), F.length(d))).otherwise(d))
    joined = F.array_join(F.zip_with(pieces, blanked, lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")
    hinted = _hinted(folded(text) if plain is None else plain, BIRTH_LABEL)
    simple = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit(MARK))
    return F.when(hinted & simple, _blanked_ascii(text)).when(hinted & text.rlike(rx(BIRTH_LABEL, "i")), joined).otherwise(text)


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, F.lower(name))


def date_from_text(text: Column, *, blanked: bool = False, plain: Column | None = None) -> Column:
    """Start of a period, else a named date, else a numeric one, else ISO, else the first year on its own.

    Only the first named date counts: if its word is no month, named dates are passed over.  Numeric dates are read
    month first where that is possible, and the first possible one counts.  Periods take the year from their end.
    """
    plain = folded(text) if plain is None else plain
    both = F.struct((text if blanked else without_birth_dates(text, plain)).alias("t"), plain.alias("p"))
    return let(both, lambda x: _date_from_blanked(x["t"], x["p"]))


def _date_from_blanked(t: Column, plain: Column) -> Column:
    part = lambda p, g: F.regexp_extract(t, rx(p), g)
    by_name = lambda p: let(
        _groups(t, rx(p, "i"), 3), lambda g: F.when(g[0] != "", let(_month(g[0]), lambda m: F.when(m.isNotNull(), _iso(g[2], m, g[1]))))
    )
    period = F.when(_hinted(plain, PERIOD), by_name(PERIOD))
    named = by_name(NAMED_DATE)
    every = lambda g: F.regexp_extract_all(t, F.lit(rx(NUMERIC_DATE)), F.lit(g))
    dates = F.arrays_zip(every(1).alias("a"), every(2).alias("b"), every(3).alias("y"))
    read = F.transform(
        dates,
        lambda d: F.when(_fits(d["a"], d["b"]), _iso(d["y"], d["a"], d["b"])).when(_fits(d["b"], d["a"]), _iso(d["y"], d["b"], d["a"])),
    )
    numeric = F.get(F.filter(read, lambda d: d.isNotNull()), 0)
    iso = F.nullif(part(ISO_DATE, 0), F.lit(""))
    year = let(part(BARE_YEAR, 1), lambda y: F.when(y != "", F.concat(y, F.lit("-01-01"))))
    return F.coalesce(period, named, numeric, iso, year)


def year_only(date: Column, text: Column) -> Column:
    """Whether a date is a first of January that the text does not spell out."""
    spelled = F.lower(text).rlike(rx(FIRST_OF_JANUARY))
    return F.coalesce(date.endswith("-01-01") & ~spelled, F.lit(False))


def valid_amount(raw: Column) -> Column:
    # an empty string is no number either way, but a cast that fails is dear
    return F.when(raw != "", F.coalesce(F.replace(raw, F.lit(","), F.lit("")).try_cast("double") >= 1.0, F.lit(False))).otherwise(F.lit(False))


def _labelled(text: Column, pattern: str, flags: str, labels: Sequence[str], plain: Column | None = None) -> Column:
    """By label that occurs, the number that the pattern finds after it, or an empty string."""

    def numbers(plain: Column) -> Column:
        read = lambda label: F.replace(F.regexp_extract(text, rx(quote(label) + pattern, flags), 1), F.lit(","), F.lit(""))
        return F.array_compact(F.array(*[F.when(F.contains(plain, F.lit(label.lower())), read(label)) for label in labels]))

    return let(folded(text) if plain is None else plain, numbers)


def amount_strict(text: Column, labels: Sequence[str] = AMOUNT_LABELS, plain: Column | None = None) -> Column:
    """The numbers right after the first occurrences of labels, in the order of the labels."""
    return _labelled(text, r"[:\s]*" + SIGN + NUMBER, "i", labels, plain)


def amount_loose(text: Column, labels: Sequence[str] = AMOUNT_LABELS) -> Column:
    """The numbers after ``=`` or ``:`` within 150 characters of labels, rules and spaces collapsed."""
    short = F.regexp_replace(text, r"([-=_.])\1{2,}", "$1")
    short = F.regexp_replace(short, rx(r"\s+"), " ")
    return let(short, lambda t: _labelled(t, r".{0,150}?[=:]\s*" + SIGN + NUMBER, "is", labels))


def first_valid(candidates: Column) -> Column:
    return F.get(F.filter(candidates, valid_amount), 0)


def _any_zero(candidates: Column) -> Column:
    return F.exists(candidates, lambda c: F.when(c != "", F.coalesce(c.try_cast("double") == 0, F.lit(False))).otherwise(F.lit(False)))


def amount(text: Column, labels: Sequence[str] = AMOUNT_LABELS, plain: Column | None = None) -> Column:
    """Struct of amount and amount_zero: labelled, else loosely labelled; a labelled zero stops the search, else the
    first number with a sign and cents, if it is at least 1."""
    one = lambda value, zero: F.struct(value.alias("amount"), zero.alias("amount_zero"))
    signed = F.contains(text, F.lit("$")) | F.contains(text, F.lit("S/"))
    bare = F.when(signed, F.replace(F.regexp_extract(text, rx(BARE_AMOUNT), 1), F.lit(","), F.lit("")))

    def unlabelled(zero: Column) -> Column:
        found = let(bare, lambda b: F.when(valid_amount(b), b))
        return F.when(zero, one(F.lit(None).cast("string"), F.lit(True))).otherwise(one(found, F.lit(False)))

    def loosely(strict: Column) -> Column:
        return let(amount_loose(text, labels), lambda loose: labelled(loose, lambda: unlabelled(_any_zero(strict) | _any_zero(loose))))

    def labelled(numbers: Column, otherwise: Callable[[], Column]) -> Column:
        return let(first_valid(numbers), lambda v: F.when(v.isNotNull(), one(v, F.lit(False))).otherwise(otherwise()))

    return let(amount_strict(text, labels, plain), lambda strict: labelled(strict, lambda: loosely(strict)))


def account(text: Column, plain: Column | None = None) -> Column:
    """Struct of value, masked and digits: a full number, an ending, a masked number, or four digits by a label."""
    plain = folded(text) if plain is None else plain

    def read(x: Column) -> Column:
        part = lambda p, g, f: F.regexp_extract(text, rx(p, f), g)
        hinted = lambda p, g: F.when(_hinted(x, p), part(p, g, "i")).otherwise(F.lit(""))
        none = F.lit(None).cast("string")
        one = lambda v, m, d: F.struct(v.alias("value"), F.lit(m).alias("masked"), d.cast("int").alias("digits"))
        short = let(hinted(ACCOUNT_SHORT, 1), lambda v: F.when(v != "", one(v, True, F.lit(4))).otherwise(one(none, False, F.lit(0))))
        masked = let(part(ACCOUNT_MASKED, 1, ""), lambda v: F.when(v != "", one(v, True, F.length(v))).otherwise(short))
        shown = F.coalesce(_int(part(ACCOUNT_ENDING, 1, "i")), F.lit(4))
        ending = let(hinted(ACCOUNT_ENDING, 2), lambda v: F.when(v != "", one(v, True, shown)).otherwise(masked))
        return let(hinted(ACCOUNT_FULL, 1), lambda v: F.when(v != "", one(v, False, F.length(v))).otherwise(ending))

    return let(plain, read)


def owner(text: Column) -> Column:
    greeted = F.contains(text, F.lit("Dear")) | F.contains(text, F.lit("Greetings"))
    held = F.contains(text, F.lit("older")) | F.contains(text, F.lit("Owner"))
    return F.coalesce(F.when(greeted, found(text, rx(OWNER[0]))), F.when(held, found(text, rx(OWNER[1]))))


def normalized(text: Column) -> Column:
    """For issuer names: lower case, without ``&`` and ``-``, dots and commas as spaces, spaces squeezed."""
    t = F.translate(F.lower(text), "&-", "")
    t = F.translate(t, ".,", "  ")
    return F.trim(F.regexp_replace(t, rx(r"\s+"), " "))


def _plain(text: str) -> str:
    out = text.lower().replace("&", "").replace("-", "").replace(".", " ").replace(",", " ")
    return " ".join(out.split())


def places(text: Column, name: Column) -> Column:
    """Where an issuer is looked for: header, footer and file name, normalized, a line each."""
    t = F.coalesce(text, F.lit(""))
    parts = F.array(
        normalized(F.left(t, F.lit(HEADER_CHARS))),
        F.when(F.length(t) > HEADER_CHARS, normalized(F.right(t, F.lit(FOOTER_CHARS)))).otherwise(F.lit("")),
        normalized(F.coalesce(name, F.lit(""))),
    )
    return F.array_join(parts, "\n")


def issuer(text: Column, name: Column, issuers: Mapping[str, str] = DEFAULT.known_issuers) -> Column:
    """The issuer whose key starts a word in the header, the footer or the file name; the longest key first.

    Every key is an expression; for tables of them see ``operators.lookups.issuers_by``."""
    # keys hold no line end, so no match reaches across
    return let(places(text, name), lambda p: _first_issuer(p, issuers))


def _first_issuer(places: Column, issuers: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key in reversed(sorted(issuers, key=len, reverse=True)):
        starts_word = places.rlike(rx(r"\b" + quote(_plain(key))))
        out = F.when(F.contains(places, F.lit(_plain(key))) & starts_word, F.lit(issuers[key])).otherwise(out)
    return out


def metadata(text: Column, name: Column, config: RoutingConfig = DEFAULT) -> Column:
    """All extracted fields as one struct."""
    known = lambda t: F.struct(t.alias("t"), name.alias("n"), folded(t).alias("p"))
    return let(let(F.coalesce(text, F.lit("")), known), lambda x: _metadata(x["t"], x["n"], x["p"], config))


def _metadata(t: Column, name: Column, plain: Column, config: RoutingConfig) -> Column:
    found = F.coalesce(date_from_filename(name), date_from_text(t, plain=plain))
    dated = let(found, lambda d: F.struct(d.alias("date"), year_only(d, t).alias("year_only")))
    parts = F.struct(dated.alias("d"), amount(t, config.amount_labels, plain).alias("m"), account(t, plain).alias("a"))
    return let(parts, lambda p: _fields(p["d"], p["m"], p["a"], t, name, config))


def _fields(dated: Column, money: Column, number: Column, t: Column, name: Column, config: RoutingConfig) -> Column:
    return F.struct(
        dated["date"].alias("date"),
        dated["year_only"].alias("date_year_only"),
        money["amount"].alias("amount"),
        money["amount_zero"].alias("amount_zero"),
        currency(t).alias("currency"),
        number["value"].alias("account"),
        number["masked"].alias("account_masked"),
        number["digits"].alias("account_digits"),
        owner(t).alias("owner"),
        issuer(t, name, config.known_issuers).alias("issuer"),
    )
