"""Options of a ledger."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

# fixed values: names of options that a ledger may set, and that it may not
KNOWN = (
    "title", "name_assets", "name_liabilities", "name_equity", "name_income", "name_expenses", "account_previous_balances",
    "account_previous_earnings", "account_previous_conversions", "account_current_earnings", "account_current_conversions",
    "account_rounding", "conversion_currency", "inferred_tolerance_default", "inferred_tolerance_multiplier",
    "infer_tolerance_from_cost", "documents", "operating_currency", "render_commas", "plugin_processing_mode",
    "long_string_maxlines", "booking_method", "allow_pipe_separator", "allow_deprecated_none_for_tags_and_links", "insert_pythonpath",
)
RESERVED = ("filename", "include", "input_hash", "dcontext", "commodities", "plugin")
BOOKINGS = ("STRICT", "NONE", "FIFO", "LIFO", "HIFO", "AVERAGE")


@dataclass
class Config:
    title: str = ""
    roots: tuple[str, ...] = ("Assets", "Liabilities", "Equity", "Income", "Expenses")
    multiplier: Decimal = Decimal("0.5")
    defaults: dict[str, Decimal] = field(default_factory=dict)
    booking: str = "STRICT"
    currencies: list[str] = field(default_factory=list)
    documents: list[str] = field(default_factory=list)

    def tolerance(self, currency: str) -> Decimal:
        return self.defaults.get(currency, self.defaults.get("*", Decimal(0)))


def config_of(options: list[tuple[str, str, int]]) -> tuple[Config, list[tuple[int, str]]]:
    """The configuration and (line, message) of every option that is wrong."""
    out, wrong = Config(), []
    for name, value, line in options:
        if name not in KNOWN:
            wrong.append((line, f"option {name!r} may not be set" if name in RESERVED else f"invalid option: {name!r}"))
            continue
        try:
            if name == "title":
                out.title = value
            elif name.startswith("name_"):
                place = [f"name_{r}" for r in ("assets", "liabilities", "equity", "income", "expenses")].index(name)
                out.roots = (*out.roots[:place], value, *out.roots[place + 1 :])
            elif name == "inferred_tolerance_multiplier":
                out.multiplier = Decimal(value)
            elif name == "inferred_tolerance_default":
                currency, _, number = value.partition(":")
                out.defaults[currency.strip()] = Decimal(number.strip())
            elif name == "booking_method":
                if value.upper() not in BOOKINGS:
                    raise ValueError(value)
                out.booking = value.upper()
            elif name == "operating_currency":
                out.currencies.append(value)
            elif name == "documents":
                out.documents.append(value)
        except (InvalidOperation, ValueError):
            wrong.append((line, f"invalid value of option {name}: {value!r}"))
    return out, wrong
