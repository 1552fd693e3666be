"""Prompts, verdicts and confirm replies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import blank, given, literal

#: Words that mean no issuer, and actions of a reply.
NO_ISSUER = ("", "none", "null", "unknown", "n/a", "—", "-")
ACTIONS = ("move_all", "move_some", "skip_some", "park_some", "quit")
NEEDS_INDICES = ("move_some", "skip_some", "park_some")
VERDICT_SCHEMA = "category string, issuer string, confidence string, reasons string"
INTENT_SCHEMA = (
    "action string, indices array<string>, note string, file_notes array<struct<file_index: string, note: string>>, "
    "rules array<struct<file_index: string, kind: string, value: string>>"
)


def excerpt(text: Column, head: int = 2500, tail: int = 1000) -> Column:
    """A long text's start and end, with a mark that tells how much is left out."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    mark = F.concat(F.lit("\n…["), (F.length(t) - head - tail).cast("string"), F.lit(" chars omitted]…\n"))
    end = F.right(t, F.lit(tail)) if tail > 0 else F.lit("")
    return F.when(F.length(t) <= head + tail, t).otherwise(F.concat(F.left(t, F.lit(head)), mark, end))


def neighbour_line(text: Column, category: Column, issuer: Column, limit: int = 400) -> Column:
    """An earlier decision as an example in a prompt, as literals, so that no text ends its quotation or adds a line."""
    t = F.replace(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r")), F.lit("\n"), F.lit(" "))
    cut = F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("…"))).otherwise(t)
    return F.concat(
        F.lit("- Text: "), literal(cut), F.lit("\n  → category="), literal(category), F.lit(", issuer="), literal(F.coalesce(given(issuer), F.lit("—")))
    )


def system_prompt(categories: list[str]) -> str:
    """What the model is asked to do; the answer is one JSON object."""
    listed = "\n".join(f"- {c}" for c in categories)
    return (
        "Classify one household or finance document from its text. Choose one of these categories and no other:\n"
        f"{listed}\n"
        'Answer with a JSON object only: {"category": string, "issuer": string or null, "confidence": number from 0 to 1, '
        '"reasons": one to three short strings}. If no category fits well, give the closest and a confidence below 0.5.'
    )


def user_prompt(text: Column, name: Column, examples: Column, issuers: Column, head: int = 2500, tail: int = 1000) -> Column:
    """Earlier decisions (an array of lines), issuer names (an array, the first 30 of its sorted values), the document."""
    count = F.size(F.coalesce(examples, F.array().cast("array<string>")))
    shots = F.when(count > 0, F.concat(F.lit("Past confirmed decisions on the "), count.cast("string"), F.lit(" most similar documents:\n"), F.array_join(examples, "\n"), F.lit("\n")))
    names = F.slice(F.array_sort(F.array_distinct(F.coalesce(issuers, F.array().cast("array<string>")))), 1, 30)
    hint = F.when(F.size(names) > 0, F.concat(F.lit("Known issuer names: "), F.array_join(names, ", "), F.lit("\n")))
    body = F.concat(F.lit('Filename: '), name, F.lit('\nDocument text:\n"""\n'), excerpt(text, head, tail), F.lit('\n"""\n'))
    return F.concat_ws("\n", shots, hint, body, F.lit("Return the JSON object."))


def verdict(answer: Column, allowed: Column | None = None) -> Column:
    """A model's JSON answer, checked: struct of category, issuer, confidence, reasons and error.

    A category is required, and a confidence from 0 to 1; with ``allowed`` (an array) other categories are refused.
    """
    raw = F.from_json(answer, VERDICT_SCHEMA)
    category, score = F.trim(raw["category"]), raw["confidence"].try_cast("double")
    issuer = F.trim(raw["issuer"])
    several = F.from_json(raw["reasons"], "array<string>")
    one = F.when(blank(F.trim(raw["reasons"])), F.array().cast("array<string>")).otherwise(F.array(F.trim(raw["reasons"])))
    many = F.filter(F.transform(several, lambda r: F.trim(r)), lambda r: r != "")
    reasons = F.coalesce(F.when(raw["reasons"].startswith("["), many), one)
    error = (
        F.when(raw.isNull() | F.get_json_object(answer, "$").isNull(), F.lit("no JSON object"))
        .when(category.isNull(), F.lit("no category"))
        .when(score.isNull() | (score < 0) | (score > 1), F.lit("no confidence from 0 to 1"))
    )
    if allowed is not None:
        error = F.coalesce(error, F.when(~F.array_contains(allowed, category), F.concat(F.lit("category not allowed: "), category)))
    fine = error.isNull()
    return F.struct(
        F.when(fine, category).alias("category"),
        F.when(fine & ~F.lower(issuer).isin(*NO_ISSUER), issuer).alias("issuer"),
        F.when(fine, score).alias("confidence"),
        F.when(fine, reasons).alias("reasons"),
        error.alias("error"),
    )


def allowed_categories(categories: Column, extra: Column) -> Column:
    """Configured categories and more, in order and once each."""
    return F.array_union(categories, F.coalesce(extra, F.array().cast("array<string>")))


def intent(answer: Column, valid: Column) -> Column:
    """A reply's JSON intent: struct of action, indices, note, file_notes, rules and error; numbers that are not in
    ``valid`` are dropped, and an action that is left without any it needs is an error."""
    raw = F.from_json(answer, INTENT_SCHEMA)
    numbers = F.transform(F.coalesce(raw["indices"], F.array().cast("array<string>")), lambda x: x.try_cast("int"))
    indices = F.filter(numbers, lambda x: F.coalesce(F.array_contains(valid, x), F.lit(False)))
    known = lambda x: F.coalesce(F.array_contains(valid, x["file_index"].try_cast("int")), F.lit(False))
    notes = F.transform(
        F.filter(raw["file_notes"], known),
        lambda x: F.struct(x["file_index"].try_cast("int").alias("file_index"), F.coalesce(x["note"], F.lit("")).alias("note")),
    )
    rules = F.transform(
        F.filter(raw["rules"], lambda x: known(x) & x["kind"].isin("issuer", "category") & ~blank(x["value"])),
        lambda x: F.struct(x["file_index"].try_cast("int").alias("file_index"), x["kind"].alias("kind"), x["value"].alias("value")),
    )
    error = (
        F.when(raw.isNull() | ~F.coalesce(raw["action"].isin(*ACTIONS), F.lit(False)), F.lit("no valid action"))
        .when(raw["action"].isin(*NEEDS_INDICES) & (F.size(indices) == 0), F.lit("no valid indices"))
    )
    fine = error.isNull()
    return F.struct(
        F.when(fine, raw["action"]).alias("action"),
        F.when(fine, indices).alias("indices"),
        F.when(fine, F.trim(F.coalesce(raw["note"], F.lit("")))).alias("note"),
        F.when(fine, F.coalesce(notes, F.array().cast("array<struct<file_index: int, note: string>>"))).alias("file_notes"),
        F.when(fine, F.coalesce(rules, F.array().cast("array<struct<file_index: int, kind: string, value: string>>"))).alias("rules"),
        error.alias("error"),
    )


def note_for(index: Column, file_notes: Column, note: Column) -> Column:
    """A file's own first note, else the note of the batch."""
    own = F.filter(file_notes, lambda x: (x["file_index"] == index) & (x["note"] != ""))
    return F.coalesce(F.get(own, 0)["note"], note)


def intent_summary(parsed: Column, n_files: Column) -> Column:
    """What a reply is taken to mean, in one line."""
    listed = F.array_join(F.transform(F.array_sort(parsed["indices"]), lambda x: x.cast("string")), ", ")
    told = {"move_some": "Only these are moved: ", "skip_some": "All are moved but these: ", "park_some": "These stay where they are, the others are moved: "}
    says = F.when(parsed["action"] == "move_all", F.concat(F.lit("All files are moved: "), n_files.cast("string")))
    for action, text in told.items():
        says = says.when(parsed["action"] == action, F.concat(F.lit(text), listed))
    says = says.otherwise(F.lit("Nothing is moved"))
    rule = lambda r: F.concat(r["file_index"].cast("string"), F.lit(": "), r["kind"], F.lit(" is "), r["value"])
    rules = given(F.array_join(F.transform(parsed["rules"], rule), ", "))
    return F.concat_ws(". ", says, F.concat(F.lit("Note: "), given(parsed["note"])), F.concat(F.lit("New rules: "), rules))


def numbers_in(text: Column) -> Column:
    """The whole numbers in a list parted by commas and spaces, each once."""
    parts = F.filter(F.split(text, "[ ,]"), lambda p: p.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(parts, lambda p: p.cast("int")))


def literal_reply(reply: Column, valid: Column) -> Column:
    """A typed reply: struct of approved, parked and note.

    Blank approves all; ``skip`` and ``park`` with numbers approve the rest; numbers approve only those; ``q`` none.
    A `` note:`` after it, in any case, is kept as it is.
    """
    raw = F.trim(F.coalesce(reply, F.lit("")))
    at = F.instr(F.lower(raw), " note:")
    head = F.when(at > 0, F.trim(F.substring(raw, F.lit(1), at - 1))).otherwise(raw)
    note = F.when(at > 0, F.trim(F.substring(raw, at + 6, F.length(raw)))).otherwise(F.lit(""))
    kind, rest = F.lower(F.left(head, F.lit(5))), numbers_in(F.substring(head, 6, 1_000_000))
    none = F.array().cast("array<int>")
    parked = F.when(kind == "park ", F.array_intersect(valid, rest)).otherwise(none)
    approved = (
        F.when(head == "", valid)
        .when(F.lower(head).isin("q", "quit"), none)
        .when(kind == "skip ", F.array_except(valid, rest))
        .when(kind == "park ", F.array_except(valid, parked))
        .otherwise(numbers_in(head))
    )
    return F.struct(F.array_sort(approved).alias("approved"), F.array_sort(parked).alias("parked"), note.alias("note"))


def rule_keyword(name_stem: Column) -> Column:
    """The keyword that a category rule for this file adds."""
    return F.lower(F.trim(F.translate(name_stem, "-_", "  ")))


def rule_key(kind: Column, name_stem: Column) -> Column:
    """What a rule is kept under: the file's stem for an issuer, a keyword made of it for a category."""
    return F.when(kind == "issuer", F.lower(name_stem)).when(kind == "category", F.lower(F.translate(name_stem, "-_", "  ")))


def typed_rule(reply: Column) -> Column:
    """A rule that was typed, ``issuer=...`` or ``category=...``: struct of kind and value, null for any other text."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    kind = F.lower(F.substring_index(text, "=", 1))
    value = F.trim(F.substring(text, F.length(kind) + 2, F.length(text)))
    return F.when(F.contains(text, F.lit("=")) & kind.isin("issuer", "category"), F.struct(kind.alias("kind"), value.alias("value")))
