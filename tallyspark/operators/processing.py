"""Checks, completes and books the directives of one ledger in order.

Each transaction is checked on its own (accounts, currencies, what may be left out, weights within
tolerance), then booked on the accounts it touches, which take back what it did unless all of that
holds. Balance assertions see the accounts at the start of their day, and pads fill what they lack.
"""

from __future__ import annotations

import datetime as dt
from copy import copy
from dataclasses import dataclass, field
from decimal import Decimal
from pathlib import PurePosixPath

from tallyspark.operators.booking import BookingError, Holdings, LotCost, Wanted
from tallyspark.sources.config import BOOKINGS, Config
from tallyspark.sources.ledger_text import Amount, Cost, Directive, Posting

PRIORITY = {"open": -2, "balance": -1, "document": 1, "close": 2}


@dataclass
class Account:
    opened: dt.date
    closed: dt.date | None = None
    currencies: tuple[str, ...] = ()
    booking: str = "STRICT"
    holdings: Holdings = field(default_factory=Holdings)


@dataclass
class Diagnostic:
    severity: str
    code: str
    message: str
    filename: str
    line: int
    date: dt.date | None = None
    account: str | None = None


def _has_empty(meta: list) -> bool:
    return any(kind == "string" and value == "" for _, (kind, value) in meta)


def _copied(p: Posting) -> Posting:
    """A posting of its own down to its amounts; metadata is shared, as booking never changes it."""
    units, price = p.units and Amount(p.units.number, p.units.currency), p.price and Amount(p.price.number, p.price.currency)
    return Posting(p.account, units, p.cost and copy(p.cost), price, p.price_total, p.flag, p.meta, p.line)


def digits(x: Decimal) -> int:
    return max(0, -x.as_tuple().exponent)


def unit_cost(cost: Cost, units: Decimal) -> Decimal | None:
    """Per-unit number of a cost: as given, a total's share, or both together."""
    if cost.is_total:
        return cost.number / abs(units) if cost.number is not None and units else None
    if cost.total is not None:
        return (cost.number or Decimal(0)) + (cost.total / abs(units) if units else Decimal(0))
    return cost.number


class Ledger:
    """State of the accounts while directives are processed."""

    def __init__(self, config: Config, files: set[str] | None = None):
        self.config, self.files = config, files
        self.accounts: dict[str, Account] = {}
        self.diagnostics: list[Diagnostic] = []
        self.prices: list[tuple[dt.date, str, str, Decimal]] = []
        self.pads: dict[str, dict] = {}
        self.padding: list[Directive] = []
        self.invalid: set[int] = set()
        self.errors = 0

    def report(self, d: Directive, code: str, message: str, account: str | None = None, severity: str = "error") -> None:
        self.errors += severity == "error"
        self.diagnostics.append(Diagnostic(severity, code, message, d.filename, d.line, d.date, account))

    def active(self, account: str, date: dt.date, closed_too: bool = False) -> str | None:
        """Why the account can't be used on a date; None if it can."""
        a = self.accounts.get(account)
        if a is None or date < a.opened:
            return "the account is not open"
        if not closed_too and a.closed and date > a.closed:
            return "the account is closed"
        return None

    def process(self, directives: list[Directive]) -> list[Directive]:
        order = sorted(range(len(directives)), key=lambda i: (directives[i].date, PRIORITY.get(directives[i].kind, 0), directives[i].line, i))
        out = [directives[i] for i in order]
        for d in out:
            if not self.take(d):
                self.invalid.add(id(d))
        for pad in self.pads.values():
            if not pad["used"]:
                self.report(pad["directive"], "unused_pad", "the pad is not used", pad["directive"].account, "warning")
        merged = out + self.padding
        return sorted(merged, key=lambda d: (d.date, PRIORITY.get(d.kind, 0), d.line))

    def take(self, d: Directive) -> bool:
        """Processes one directive; whether it is without error."""
        before = self.errors
        keys = [k for k, _ in d.meta]
        if len(keys) != len(set(keys)):
            self.report(d, "duplicate_metadata", "a metadata key is given twice")
        if d.date.year < 1:
            self.report(d, "date", "the date is out of range")
        if d.kind == "transaction" and _has_empty(d.meta):
            self.report(d, "empty_metadata", "a metadata value is empty")
        if before == self.errors:
            getattr(self, f"on_{d.kind}")(d)
        return before == self.errors

    @property
    def ok(self) -> bool:
        return not self.diagnostics

    # directives other than transactions

    def on_open(self, d: Directive) -> None:
        if d.account.split(":")[0] not in self.config.roots:
            return self.report(d, "account_root", f"{d.account} is of no account type", d.account)
        if d.account in self.accounts:
            return self.report(d, "already_open", f"{d.account} was opened before", d.account)
        if d.booking and d.booking.upper() not in BOOKINGS:
            return self.report(d, "booking_method", f"unknown booking method {d.booking}", d.account)
        self.accounts[d.account] = Account(d.date, None, tuple(d.currencies), (d.booking or self.config.booking).upper())

    def on_close(self, d: Directive) -> None:
        a = self.accounts.get(d.account)
        if a is None or a.closed or d.date < a.opened:
            return self.report(d, "not_open", f"{d.account} is not open", d.account)
        a.closed = d.date

    def on_commodity(self, d: Directive) -> None:
        seen = self.__dict__.setdefault("commodities", set())
        if d.currency in seen:
            self.report(d, "duplicate_commodity", f"{d.currency} was declared before")
        seen.add(d.currency)

    def on_price(self, d: Directive) -> None:
        if not d.amount.number:
            return self.report(d, "price", "the price is zero")
        self.prices.append((d.date, d.currency, d.amount.currency, d.amount.number))

    def _known_account(self, d: Directive) -> None:
        if why := self.active(d.account, d.date, closed_too=True):
            self.report(d, "not_open", f"{d.account}: {why}", d.account)

    on_note = _known_account

    def on_document(self, d: Directive) -> None:
        self._known_account(d)
        if self.files is not None and str(PurePosixPath(d.filename).parent / d.path) not in self.files:
            self.report(d, "document", f"{d.path} does not exist", d.account)

    def on_event(self, d: Directive) -> None:
        if not d.name:
            self.report(d, "event", "the event has no name")

    def on_query(self, d: Directive) -> None:
        pass

    on_custom = on_query

    def on_pad(self, d: Directive) -> None:
        for name in (d.account, d.source):
            if why := self.active(name, d.date):
                return self.report(d, "not_open", f"{name}: {why}", name)
        if d.account == d.source:
            return self.report(d, "pad", "an account can't pad itself", d.account)
        old = self.pads.get(d.account)
        if old and not old["used"]:
            self.report(old["directive"], "unused_pad", "the pad is not used", d.account, "warning")
        self.pads[d.account] = {"directive": d, "used": set()}

    def on_balance(self, d: Directive) -> None:
        if why := self.active(d.account, d.date, closed_too=True):
            return self.report(d, "not_open", f"{d.account}: {why}", d.account)
        account = self.accounts[d.account]
        if account.currencies and d.currency not in account.currencies:
            return self.report(d, "currency", f"{d.account} doesn't hold {d.currency}", d.account)
        tolerance = d.tolerance
        if tolerance is None:
            tolerance = Decimal(1).scaleb(-digits(d.number)) * self.config.multiplier * 2 if digits(d.number) else Decimal(0)
        lacking = d.number - account.holdings.total(d.currency)
        pad = self.pads.get(d.account)
        if pad and pad["directive"].date < d.date and d.currency not in pad["used"]:
            pad["used"].add(d.currency)
            if abs(lacking) > tolerance:
                self._fill(pad["directive"], d, lacking)
                lacking = Decimal(0)
        if abs(lacking) > tolerance:
            self.report(d, "balance", f"{d.account} holds {d.number - lacking} {d.currency}, not {d.number}", d.account)

    def _fill(self, pad: Directive, d: Directive, lacking: Decimal) -> None:
        text = f"(Padding inserted for Balance of {d.number} {d.currency} for difference {lacking} {d.currency})"
        legs = [Posting(pad.account, Amount(lacking, d.currency)), Posting(pad.source, Amount(-lacking, d.currency))]
        self.padding.append(Directive("transaction", pad.date, "", 0, values={"flag": "P", "payee": "", "narration": text, "tags": [], "links": []}, postings=legs))
        for leg in legs:
            self.accounts[leg.account].holdings.add(d.currency, leg.units.number, None)

    # transactions

    def on_transaction(self, d: Directive) -> None:
        for p in d.postings:
            if why := self.active(p.account, d.date):
                self.report(d, "not_open", f"{p.account}: {why}", p.account)
                return
            keys = [k for k, _ in p.meta]
            if len(keys) != len(set(keys)):
                return self.report(d, "duplicate_metadata", "a metadata key is given twice", p.account)
            if _has_empty(p.meta):
                return self.report(d, "empty_metadata", "a metadata value is empty", p.account)
            if p.cost and (why := self._cost_fault(p)):
                return self.report(d, "cost", why, p.account)
            if p.price and p.price_total and p.units and p.units.number is not None and not p.units.number:
                return self.report(d, "price", "a total price of zero units", p.account)
            if p.price and p.price.number is not None and p.price.number < 0:
                return self.report(d, "price", "a negative price", p.account)
        trial = [_copied(p) for p in d.postings]
        held = {p.account: self.accounts[p.account].holdings for p in trial}
        for holdings in held.values():
            holdings.begin()
        done = False
        try:
            booked = self._booked(trial, d, held)
            for p in booked:
                allowed = self.accounts[p.account].currencies
                if allowed and p.units.currency not in allowed:
                    return self.report(d, "currency", f"{p.account} doesn't hold {p.units.currency}", p.account)
            d.postings, done = booked, True
        except (BookingError, BalanceError) as e:
            return self.report(d, e.code if isinstance(e, BalanceError) else "booking", str(e))
        finally:
            for holdings in held.values():
                holdings.end(done)

    @staticmethod
    def _cost_fault(p: Posting) -> str | None:
        c = p.cost
        if c.label is not None and not c.label.strip():
            return "the label is blank"
        if c.is_total and c.total is not None:
            return "a total cost can't have a second number"
        if c.is_total and p.units and p.units.number is not None and not p.units.number:
            return "a total cost of zero units"
        if (c.number is not None and c.number < 0) or (c.total is not None and c.total < 0):
            return "a negative cost"
        if c.merge and (c.number is not None or c.total is not None):
            return "a merged cost can't have a number"
        return None

    def _booked(self, postings: list[Posting], d: Directive, held: dict[str, Holdings]) -> list[Posting]:
        """The postings completed, reductions split by the lots they take; ``held`` changes along."""
        weights: dict[str, Decimal] = {}
        fill, out, unnamed = None, [], []

        def weigh(number: Decimal, currency: str) -> None:
            weights[currency] = weights.get(currency, Decimal(0)) + number

        def unknown(p: Posting, what: str) -> None:
            nonlocal fill
            if fill is not None:
                raise BalanceError("incomplete", "more than one part of the transaction is left out")
            fill = (p, what)

        for p in postings:
            if p.units is None or p.units.number is None:
                unknown(p, "units")
                out.append([p])
            elif p.units.currency is None or (p.price and p.price.number is not None and p.price.currency is None and not (p.cost and p.cost.currency)):
                unnamed.append((p, len(out)))
                out.append([p])
            else:
                out.append(self._one(p, d, held, weigh, unknown))
        for p, at in unnamed:
            if p.units.currency is None:
                p.units.currency = self._only_currency(weights, p)
            elif p.price.currency is None:
                p.price.currency = self._only_currency(weights, p)
            out[at] = self._one(p, d, held, weigh, unknown)
        if fill is not None:
            p, what = fill
            at = next(i for i, parts in enumerate(out) if any(x is p for x in parts))
            out[at] = self._filled(p, what, d, weights, held, weigh)
        tolerances: dict[str, Decimal] = {}
        for p in postings:
            if p.units and p.units.number is not None and p.units.currency and not getattr(p, "filled", False) and digits(p.units.number):
                tolerances[p.units.currency] = max(tolerances.get(p.units.currency, Decimal(0)), Decimal(1).scaleb(-digits(p.units.number)) * self.config.multiplier)
        for currency, number in weights.items():
            if abs(number) > tolerances.get(currency, self.config.tolerance(currency)):
                raise BalanceError("unbalanced", f"the transaction doesn't balance: {number} {currency}")
        return [p for parts in out for p in parts]

    @staticmethod
    def _only_currency(weights: dict[str, Decimal], p: Posting) -> str:
        open_ = [c for c, n in weights.items() if n] or list(weights)
        if len(open_) != 1:
            raise BalanceError("incomplete", "a currency is left out and can't be told")
        return open_[0]

    def _one(self, p: Posting, d: Directive, held: dict[str, Holdings], weigh, unknown) -> list[Posting]:
        n, currency = p.units.number, p.units.currency
        account = self.accounts[p.account]
        if p.price is not None and p.price.number is None:
            if p.cost is None:
                unknown(p, "price")
                return [p]
            p.price = None
        if p.price is not None and p.price.currency is None:
            p.price.currency = p.cost.currency if p.cost and p.cost.currency else None
            if p.price.currency is None:
                raise BalanceError("incomplete", "the price has no currency")
        if p.price is not None and p.price_total:
            p.price, p.price_total = Amount(p.price.number / abs(n), p.price.currency), False
            weight_by_price = p.price.number * n
        elif p.price is not None:
            weight_by_price = p.price.number * n
        if p.cost is None:
            held[p.account].add(currency, n, None)
            if p.price is not None:
                weigh(weight_by_price, p.price.currency)
            else:
                weigh(n, currency)
            return [p]
        unit = unit_cost(p.cost, n)
        if n < 0 and account.booking != "NONE" and (held[p.account].any_at_cost(currency) or p.cost.empty or unit is None or p.cost.merge):
            wanted = Wanted(unit, p.cost.currency, p.cost.date, p.cost.label, p.cost.merge)
            parts = []
            for units, cost in held[p.account].reduce(currency, -n, wanted, account.booking):
                parts.append(Posting(p.account, Amount(-units, currency), Cost(cost.number, None, cost.currency, cost.date, cost.label), p.price, False, p.flag, p.meta, p.line))
                if not p.cost.merge:  # what merging gives up has no stated weight
                    weigh(-units * cost.number, cost.currency)
            return parts
        if n < 0 and account.booking != "NONE":
            raise BookingError(f"no lots of {currency} to reduce")
        if unit is None:
            unknown(p, "cost")
            return [p]
        return self._augment(p, unit, d, held, weigh)

    @staticmethod
    def _augment(p: Posting, unit: Decimal, d: Directive, held: dict[str, Holdings], weigh) -> list[Posting]:
        if p.cost.currency is None:
            raise BalanceError("incomplete", "the cost has no currency")
        cost = LotCost(unit, p.cost.currency, p.cost.date or d.date, p.cost.label)
        held[p.account].add(p.units.currency, p.units.number, cost)
        weigh(p.units.number * unit, p.cost.currency)
        p.cost = Cost(unit, None, cost.currency, cost.date, cost.label)
        return [p]

    def _filled(self, p: Posting, what: str, d: Directive, weights: dict[str, Decimal], held: dict[str, Holdings], weigh) -> list[Posting]:
        """The one part that was left out, from what the others leave open."""
        if what == "units":
            named = p.units.currency if p.units else None
            if p.cost is not None and not p.cost.empty:
                raise BalanceError("incomplete", "the units of a posting with a cost are left out")
            currency = named or self._only_currency(weights, p)
            number = -weights.get(currency, Decimal(0))
            p.units = Amount(_plain(number), currency)
            p.filled = True
            held[p.account].add(currency, p.units.number, None)
            weigh(p.units.number, currency)
            return [p]
        currency = (p.price.currency if what == "price" else p.cost.currency) or self._only_currency(weights, p)
        unit = abs(weights.get(currency, Decimal(0)) / p.units.number) if p.units.number else Decimal(0)
        if what == "price":
            p.price = Amount(unit, currency)
            held[p.account].add(p.units.currency, p.units.number, None)
            weigh(-weights.get(currency, Decimal(0)), currency)
            return [p]
        p.cost.number, p.cost.currency = unit, currency
        open_ = weights.get(currency, Decimal(0))
        out = self._augment(p, unit, d, held, lambda n, c: None)
        weigh(-open_, currency)
        return out


class BalanceError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _plain(x: Decimal) -> Decimal:
    """Zero keeps no sign."""
    return x if x else abs(x)
