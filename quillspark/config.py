"""Routing configuration: an ordered dataclass, read from YAML, with the defaults of the data model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

#: Labels of amounts, most specific first.
AMOUNT_LABELS = (
    "total amount due", "amount due", "total due", "inv total", "invoice total", "new balance", "statement balance",
    "balance due", "payment due", "net pay", "pago del mes", "deuda total", "monto a pagar", "total a pagar",
)
#: Names of months.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
UNCATEGORIZED = "Uncategorized"
CREDIT_CARDS, BANK = "Credit Card Statements", "Bank Account & Statements"
MORTGAGE, TAXES = "Mortgage & Home Equity Accounts", "Tax Returns"
#: The categories with their keywords; the order breaks ties.
CATEGORIES = {
    CREDIT_CARDS: ("credit card", "statement balance", "minimum payment due", "available credit"),
    "Bills": ("amount due", "billing period", "service address", "due date"),
    BANK: ("checking account", "savings account", "beginning balance", "ending balance"),
    MORTGAGE: ("mortgage", "loan number", "principal", "escrow"),
    "Health Statements & Results": ("explanation of benefits", "claim number", "provider name"),
    "Insurance": ("policy number", "deductible", "premium"),
    TAXES: ("form 1040", "adjusted gross income", "internal revenue service"),
    "Paystubs": ("earnings statement", "pay period", "net pay"),
    "Receipts": ("order number", "order confirmation", "subtotal"),
    "Notices": ("no action required", "important notice", "informational update"),
    "Auto Documentation": (
        "vehicle identification number", "vin number", "lease agreement", "certificate of title", "bill of sale",
        "odometer disclosure", "msrp", "trade-in",
    ),
}
#: Routes, document types and issuers.
ROUTE_TEMPLATES = {
    "default": "{category}/{issuer}/{year}",
    "Bills": "Bills/{issuer}/{year}",
    CREDIT_CARDS: "Credit Card Statements/{issuer}/{year}",
    BANK: "Bank Account & Statements/{issuer}/{year}",
    MORTGAGE: "Mortgage & Home Equity Accounts/{account}/{year}",
    "Health Statements & Results": "Health Statements & Results/{year}",
    "Insurance": "Insurance/{year}",
    TAXES: "Tax Returns/{year} Tax Return Related Documents",
    "Paystubs": "Paystubs/{year}",
    "Receipts": "Receipts/{year}",
    "Notices": "Notices/{year}",
    "Auto Documentation": "Auto Documentation",
}
DOC_TYPES = {
    "Bills": "Monthly", CREDIT_CARDS: "Statement", BANK: "Statement", MORTGAGE: "Statement",
    "Health Statements & Results": "EOB", "Insurance": "Policy", TAXES: "Return", "Notices": "Notice",
    "Paystubs": "Paycheck", "Receipts": "Receipt",
}
ISSUERS = {
    "bank of america": "Bank of America", "chase": "Chase", "amex": "AMEX", "citibank": "Citibank",
    "wells fargo": "Wells Fargo", "discover": "Discover", "allstate": "Allstate", "geico": "GEICO", "adp": "ADP",
}


@dataclass(frozen=True)
class SecondOpinionConfig:
    """Settings of the second-opinion model."""

    enabled: bool = False
    confidence_threshold: float = 0.6
    fewshot_k: int = 5
    model: str = "llama3.2:3b"
    host: str | None = None
    timeout_s: int = 30
    embed_model: str = "nomic-embed-text"
    embed_host: str | None = None
    first_chars: int = 2500
    last_chars: int = 1000

    @classmethod
    def of(cls, block: Mapping[str, Any] | None) -> SecondOpinionConfig:
        block = block or {}
        local, embedder = block.get("local") or {}, block.get("embedder") or {}
        given = {
            "enabled": block.get("enabled"),
            "confidence_threshold": block.get("confidence_threshold"),
            "fewshot_k": block.get("fewshot_k"),
            "model": local.get("model"),
            "host": local.get("host"),
            "timeout_s": local.get("timeout_s"),
            "embed_model": embedder.get("model"),
            "embed_host": embedder.get("host"),
            "first_chars": block.get("text_first_chars"),
            "last_chars": block.get("text_last_chars"),
        }
        return cls(**{k: v for k, v in given.items() if v is not None})

    def to_block(self) -> dict[str, Any]:
        return {
            "enabled": self.enabled,
            "confidence_threshold": self.confidence_threshold,
            "fewshot_k": self.fewshot_k,
            "local": {"model": self.model, "host": self.host, "timeout_s": self.timeout_s},
            "embedder": {"model": self.embed_model, "host": self.embed_host},
            "text_first_chars": self.first_chars,
            "text_last_chars": self.last_chars,
        }


def _overlaid(tree: Mapping[str, Any], new: Mapping[str, Any]) -> dict[str, Any]:
    """``tree`` with the values of ``new``, block by block."""
    out = dict(tree)
    for k, v in new.items():
        out[k] = _overlaid(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _plain(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {k: _plain(v) for k, v in value.items()}
    return list(value) if isinstance(value, tuple) else value


@dataclass(frozen=True)
class RoutingConfig:
    """What the operators need to know; ``extra`` keeps keys that none of them reads."""

    categories: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(CATEGORIES))
    route_templates: Mapping[str, str] = field(default_factory=lambda: dict(ROUTE_TEMPLATES))
    known_issuers: Mapping[str, str] = field(default_factory=lambda: dict(ISSUERS))
    doc_types: Mapping[str, str] = field(default_factory=lambda: dict(DOC_TYPES))
    monthly_categories: tuple[str, ...] = ("Bills", CREDIT_CARDS, MORTGAGE, BANK)
    account_in_filename_categories: tuple[str, ...] = (CREDIT_CARDS, MORTGAGE)
    no_amount_categories: tuple[str, ...] = (TAXES, "Notices")
    owners: tuple[str, ...] = ("Default",)
    min_classification_score: int = 2
    amount_labels: tuple[str, ...] = AMOUNT_LABELS
    second_opinion: SecondOpinionConfig = field(default_factory=SecondOpinionConfig)
    extra: Mapping[str, Any] = field(default_factory=dict)
    source: Mapping[str, Any] | None = field(default=None, compare=False, repr=False)  # the tree as it was read

    @classmethod
    def of(cls, tree: Mapping[str, Any] | None, *, honour_amount_labels: bool = False) -> RoutingConfig:
        """From a parsed YAML tree.

        A missing key takes the operators' own default, which for monthly and account categories is not that of a
        full configuration.  Amount labels of the file are dropped unless asked for.
        """
        source = dict(tree or {})
        tree = dict(source)
        patterns = tree.pop("extraction_patterns", None) or {}
        labels = patterns.get("amount_labels") if honour_amount_labels else None
        known = {
            "categories": {k: tuple(v or ()) for k, v in (tree.pop("categories", None) or {}).items()},
            "route_templates": dict(tree.pop("route_templates", None) or {}),
            "known_issuers": dict(tree.pop("known_issuers", None) or {}),
            "doc_types": dict(tree.pop("doc_types", None) or {}),
            "monthly_categories": tuple(tree.pop("monthly_categories", None) or ("Bills",)),
            "account_in_filename_categories": tuple(tree.pop("account_in_filename_categories", None) or ("Bills", CREDIT_CARDS, MORTGAGE)),
            "no_amount_categories": tuple(tree.pop("no_amount_categories", None) or ()),
            "owners": tuple(tree.pop("owners", None) or ()),
            "min_classification_score": int(tree.pop("min_classification_score", None) or 2),
            "amount_labels": tuple(labels) if labels else AMOUNT_LABELS,
            "second_opinion": SecondOpinionConfig.of(tree.pop("llm", None)),
        }
        return cls(**known, extra=tree, source=source)

    def to_tree(self) -> dict[str, Any]:
        """The tree that was read, with what has changed since; without one, everything."""
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("source", "extra")}
        if self.source is not None:
            as_read = [RoutingConfig.of(self.source, honour_amount_labels=honour) for honour in (False, True)]
            own = {k: v for k, v in own.items() if all(v != getattr(x, k) for x in as_read)}
        new = {k: _plain(v) for k, v in own.items() if k not in ("amount_labels", "second_opinion")}
        if "amount_labels" in own:
            new["extraction_patterns"] = {"amount_labels": list(own["amount_labels"])}
        if "second_opinion" in own:
            new["llm"] = own["second_opinion"].to_block()
        tree = dict(self.source or {})
        for k in ("extraction_patterns", "llm"):
            if k in new:
                new[k] = _overlaid(tree.get(k) or {}, new[k])
        return tree | new | dict(self.extra)

    def issuer_keys(self) -> list[str]:
        """Longest first; of equal length, as configured."""
        return sorted(self.known_issuers, key=len, reverse=True)

    def with_rules(self, issuers: Mapping[str, str] | None = None, keywords: Mapping[str, list[str]] | None = None) -> RoutingConfig:
        """Issuers added or overwritten; keywords appended where absent."""
        categories = {k: list(v) for k, v in self.categories.items()}
        for category, words in (keywords or {}).items():
            own = categories.setdefault(category, [])
            own += [w for w in dict.fromkeys(words) if w not in own]
        return replace(
            self, known_issuers={**self.known_issuers, **(issuers or {})}, categories={k: tuple(v) for k, v in categories.items()}
        )


DEFAULT = RoutingConfig()


def load_config(path: str | Path, **options) -> RoutingConfig:
    """Read a YAML file; a missing file is an error, an empty one gives the operators' defaults."""
    import yaml

    return RoutingConfig.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")), **options)


def save_config(config: RoutingConfig, path: str | Path) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(config.to_tree(), sort_keys=False, allow_unicode=True), encoding="utf-8")
