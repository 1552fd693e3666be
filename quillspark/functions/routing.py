"""Classification, routes, file names and labels as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.config import BANK, CREDIT_CARDS, DEFAULT, MORTGAGE, TAXES, UNCATEGORIZED, RoutingConfig
from quillspark.functions.text import base_name, blank, given, let, stem, suffix

#: Folders that are no issuers, and top folders that a tree scan passes over.
NON_ISSUERS = ("_ Closed Accounts _", "Closed Accounts", "Forms")
TREE_EXCLUDES = (
    "__downloads__", "_processed-originals", "_feedback", ".git", ".vscode", "OneNote Notebooks",
    "Custom Office Templates", "node_modules", "venv", "env", ".venv",
)
YEAR = r"^(19|20)\d{2}$"


def category_scores(text: Column, categories: Mapping[str, Sequence[str]] = DEFAULT.categories, *, lowered: bool = False) -> Column:
    """Array of (score, order, category): how many keywords of each category occur in the text."""
    t = text if lowered else F.lower(F.coalesce(text, F.lit("")))
    rows = []
    for order, (name, words) in enumerate(categories.items()):
        score = F.lit(0)
        for w in words:
            score = score + t.contains(w.lower()).cast("int")
        rows.append(F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(name).alias("category")))
    return F.array(*rows)


def classify(text: Column, config: RoutingConfig = DEFAULT) -> Column:
    """The category with most keywords, if they are enough; the first of equals."""
    scores = lambda t: F.array_max(category_scores(t, config.categories, lowered=True))
    fits = lambda best: F.when(best["score"] >= config.min_classification_score, best["category"]).otherwise(F.lit(UNCATEGORIZED))
    return let(let(F.lower(F.coalesce(text, F.lit(""))), scores), fits)


def decide(keyword: Column, verdict: Column, confidence: Column, issuer: Column, threshold: float | Column) -> Column:
    """Struct of backend, category, issuer and issue: the keyword's category against a second opinion."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    none = F.lit(None).cast("string")
    shown = F.format_string("%.2f", confidence.cast("double"))
    one = lambda b, c, i, s: F.struct(F.lit(b).alias("backend"), c.alias("category"), i.alias("issuer"), s.alias("issue"))
    hint = F.when(~blank(verdict) & ~verdict.eqNullSafe(keyword), F.concat(F.lit("LLM suggests "), verdict, F.lit(" ("), shown, F.lit(")")))
    flag = F.concat(F.lit("LLM says "), verdict, F.lit(" ("), shown, F.lit("), keyword says "), keyword)
    return (
        F.when(confidence < limit, one("keyword-llm-low-conf", keyword, none, hint))
        .when(verdict.eqNullSafe(keyword), one("agree", keyword, issuer, none))
        .when(blank(keyword) | (keyword == UNCATEGORIZED), one("hybrid-llm", verdict, issuer, none))
        .otherwise(one("hybrid-llm-disagree", verdict, issuer, flag))
    )


def is_contract(category: Column, amount: Column, amount_zero: Column) -> Column:
    """A card or bank document without an amount that is not a zero balance."""
    return F.coalesce(category.isin(CREDIT_CARDS, BANK), F.lit(False)) & blank(amount) & ~F.coalesce(amount_zero, F.lit(False))


def _lookup(key: Column, table: Mapping[str, str], default: Column) -> Column:
    out = default
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: (p != "") & (p != "Unknown"))
    return F.array_join(parts, "\\")


def route_path(category: Column, meta: Column, config: RoutingConfig = DEFAULT) -> Column:
    """The destination: tax forms, contracts at their issuer, else the category's template filled in."""
    templates = dict(config.route_templates)
    default = templates.pop("default", "{category}/{issuer}/{year}")
    template = _lookup(category, templates, F.lit(default))
    date = F.coalesce(meta["date"], F.lit(""))
    or_unknown = lambda c: F.coalesce(given(c), F.lit("Unknown"))
    values = {
        "category": F.coalesce(given(category), F.lit(UNCATEGORIZED)),
        "issuer": or_unknown(meta["issuer"]),
        "owner": or_unknown(meta["owner"]),
        "account": or_unknown(meta["account"]),
        "year": F.when(F.length(date) >= 4, F.left(date, F.lit(4))).otherwise(F.lit("Unknown")),
        "date": date,
        "amount": F.coalesce(meta["amount"], F.lit("")),
    }
    filled = template
    for k, v in values.items():
        filled = F.replace(filled, F.lit("{" + k + "}"), v)
    contract = F.replace(F.replace(template, F.lit("/{year}"), F.lit("")), F.lit("{issuer}"), values["issuer"])
    forms = (category == TAXES) & F.coalesce(meta["date_year_only"], F.lit(False)) & blank(meta["amount"])
    return (
        F.when(forms, F.lit(f"{TAXES}\\Forms"))
        .when(is_contract(category, meta["amount"], meta["amount_zero"]), _segments(contract))
        .otherwise(_segments(filled))
    )


def date_part(category: Column, meta: Column, contract: Column, config: RoutingConfig = DEFAULT) -> Column:
    date = F.coalesce(meta["date"], F.lit(""))
    year, month, day = F.left(date, F.lit(4)), F.substring(date, 6, 2), F.substring(date, 9, 2)
    has_month, has_day = F.length(date) >= 7, F.length(date) >= 10
    monthly = F.coalesce(category.isin(*config.monthly_categories), F.lit(False)) & ~(contract & category.isin(CREDIT_CARDS, BANK))
    by_month = F.when(has_month, F.concat_ws(".", year, month)).otherwise(year)
    return (
        F.when(F.length(date) < 4, F.lit(None).cast("string"))
        .when(F.coalesce(meta["date_year_only"], F.lit(False)), year)
        .when(monthly, by_month)
        .when(has_day, F.concat_ws(".", year, month, day))
        .otherwise(by_month)
    )


def normalized_filename(name: Column, category: Column, meta: Column, config: RoutingConfig = DEFAULT) -> Column:
    """``date - issuer type - (account) - amount.suffix`` of what there is."""
    contract = is_contract(category, meta["amount"], meta["amount_zero"])
    kind = F.when(contract, F.lit("Contract")).otherwise(_lookup(category, config.doc_types, F.lit("")))
    smart = given(F.concat_ws(" ", given(F.trim(meta["issuer"])), given(kind)))
    smart = F.coalesce(smart, F.left(stem(base_name(name)), F.lit(50)))
    number = given(F.trim(meta["account"]))
    shown = F.coalesce(F.nullif(meta["account_digits"], F.lit(0)), F.lit(4)).cast("string")
    wrapped = F.when(meta["account_masked"], F.concat(F.lit("(Last"), shown, F.lit(" "), number, F.lit(")"))).otherwise(F.concat(F.lit("("), number, F.lit(")")))
    number = F.when(category.isin(*config.account_in_filename_categories), wrapped)
    value = meta["amount"].try_cast("decimal(38,2)")
    money = F.when(~F.coalesce(category.isin(*config.no_amount_categories), F.lit(False)) & (value > 0), F.concat(F.coalesce(meta["currency"], F.lit("$")), value.cast("string")))
    joined = F.concat_ws(" - ", given(date_part(category, meta, contract, config)), given(smart), number, money)
    return F.concat(F.regexp_replace(joined, r'[<>:"/\\|?*]', "_"), suffix(base_name(name)))


def suggest_message(route: Column) -> Column:
    return F.concat(F.lit("Suggested new folder: "), route)


def relative_path(path: Column, base: Column) -> Column:
    """The path below ``base`` if it is there, else the whole path."""
    root = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)


def infer_label(path: Column, root: Column) -> Column:
    """Struct of category, issuer, year, final_folder and final_filename, from where a file lies."""
    name, parent = base_name(path), F.regexp_replace(path, r"/[^/]*$", "")
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    inside = F.startswith(path, base)
    relative = F.substring(path, F.length(base) + 1, F.length(path))
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    middle = F.slice(folders, 2, F.greatest(F.size(folders) - 1, F.lit(0)))
    last = lambda a: F.when(F.size(a) > 0, F.try_element_at(a, F.lit(-1)))
    years = F.filter(middle, lambda p: p.rlike(YEAR))
    names = F.filter(middle, lambda p: ~p.rlike(YEAR) & ~p.isin(*NON_ISSUERS))
    ok = inside & (F.size(folders) > 0)
    return F.struct(
        F.when(ok, F.get(folders, 0)).alias("category"),
        F.when(ok, last(names)).alias("issuer"),
        F.when(ok, last(years)).alias("year"),
        F.when(~inside, parent).otherwise(F.array_join(folders, "/")).alias("final_folder"),
        name.alias("final_filename"),
    )


def backend_badge(backend: Column, keyword: Column, verdict: Column, confidence: Column, error: Column) -> Column:
    """How a decision came about, in a few words."""
    shown = F.coalesce(F.format_string("%.2f", confidence.cast("double")), F.lit("?"))
    return (
        F.when(~blank(error), F.concat(F.lit("llm err "), F.left(error, F.lit(18))))
        .when(verdict.isNull(), F.lit("keyword"))
        .when(F.startswith(backend, F.lit("hybrid-llm")), F.concat(F.lit("LLM ✱ "), shown))
        .when(backend == "keyword-llm-low-conf", F.concat(F.lit("kw (LLM low) "), shown))
        .when(keyword == verdict, F.concat(F.lit("agree ✓ "), shown))
        .otherwise(F.concat(F.lit("kw LLM "), shown))
    )


#: What a document of a category is called, before and after its date, and whether its amount is told, and how.
SUMMARIES = {
    "Bills": ("{issuer} service bill — {date}", None),
    CREDIT_CARDS: ("{issuer} credit card statement — {date}", ", balance "),
    BANK: ("{issuer} bank statement — {date}", None),
    MORTGAGE: ("{issuer} mortgage/HELOC statement — {date}", None),
    "HSA & FSA Transactions": ("HSA/FSA transactions — {date}", None),
    "Health Statements & Results": ("{issuer} explanation of benefits — service {date}", ", billed "),
    "Insurance": ("{issuer} insurance policy/document — {date}", None),
    TAXES: ("Tax document — year {year}", None),
    "Paystubs": ("{issuer} paycheck — period {date}", ", net "),
    "Receipts": ("{issuer} purchase receipt — {date}", ", "),
    "Real Estate & HOA": ("{issuer} HOA document — {date}", None),
    "Notices": ("Notice/letter — {date}", None),
}
OTHER_SUMMARY = "{category} document — {date}"


def content_summary(category: Column, meta: Column) -> Column:
    """One line about a document, by the template of its category; spaces and dashes at the ends go."""
    text = lambda c: F.coalesce(c, F.lit(""))
    cents = meta["amount"].try_cast("decimal(38,2)")
    money = F.when(~blank(meta["amount"]) & cents.isNotNull(), F.concat(F.coalesce(meta["currency"], F.lit("$")), cents.cast("string")))
    out = _lookup(category, {k: t for k, (t, _) in SUMMARIES.items()}, F.lit(OTHER_SUMMARY))
    date = F.left(text(meta["date"]), F.lit(10))
    for name, value in (("category", text(category)), ("issuer", text(meta["issuer"])), ("date", date), ("year", F.left(date, F.lit(4)))):
        out = F.replace(out, F.lit("{" + name + "}"), value)
    before = _lookup(category, {k: m for k, (_, m) in SUMMARIES.items() if m}, F.lit(None).cast("string"))
    return F.btrim(F.concat(out, F.coalesce(F.concat(before, money), F.lit(""))), F.lit(" —"))
