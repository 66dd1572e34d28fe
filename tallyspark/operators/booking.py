"""Lots of one account: additions, and reductions by the account's booking method.

A failed transaction leaves every account as it was: what it did is taken back.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal


class BookingError(ValueError):
    pass


@dataclass(frozen=True)
class LotCost:
    number: Decimal
    currency: str
    date: dt.date | None = None
    label: str | None = None


@dataclass
class Lot:
    units: Decimal
    cost: LotCost | None


@dataclass(frozen=True)
class Wanted:
    """What a reduction says about the lots it may take; None: anything."""

    number: Decimal | None = None
    currency: str | None = None
    date: dt.date | None = None
    label: str | None = None
    merge: bool = False

    def fits(self, cost: LotCost | None) -> bool:
        return cost is not None and all(w is None or w == c for w, c in ((self.number, cost.number), (self.currency, cost.currency), (self.date, cost.date), (self.label, cost.label)))


_ORDERS: dict[str, tuple[Callable, bool]] = {
    "FIFO": (lambda lot: (lot.cost.date is not None, lot.cost.date or dt.date.min), False),
    "AVERAGE": (lambda lot: (lot.cost.date is not None, lot.cost.date or dt.date.min), False),
    "LIFO": (lambda lot: (lot.cost.date is not None, lot.cost.date or dt.date.min), True),
    "HIFO": (lambda lot: lot.cost.number, True),
}


class Holdings:
    """Lots by currency and cost, in the order in which they came; totals by currency.

    Between ``begin`` and ``end`` every change is noted, so that a failed transaction can be taken back without
    copying an account's lots for each transaction."""

    def __init__(self):
        self.lots: dict[str, dict[LotCost | None, Lot]] = {}
        self.totals: dict[str, Decimal] = {}
        self.log: list[tuple] | None = None

    def begin(self) -> None:
        self.log = []

    def end(self, keep: bool) -> None:
        for currency, cost, units, total in reversed(self.log or []) if not keep else ():
            if isinstance(units, list):
                self.lots[currency] = {x.cost: x for x in units}
            elif units is None:
                self.lots[currency].pop(cost, None)
            else:
                self.lots[currency][cost].units = units
            self.totals[currency] = total
        self.log = None

    def _note(self, currency: str, cost: LotCost | None, units) -> None:
        if self.log is not None:
            self.log.append((currency, cost, units, self.total(currency)))

    def _note_all(self, currency: str) -> None:
        """Before lots go, or change in number: all of the currency, in their order."""
        if self.log is not None:
            self._note(currency, None, [replace(x) for x in self.lots.get(currency, {}).values()])

    def total(self, currency: str) -> Decimal:
        return self.totals.get(currency, Decimal(0))

    def any_at_cost(self, currency: str) -> bool:
        return any(x.cost and x.units > 0 for x in self.lots.get(currency, {}).values())

    def add(self, currency: str, units: Decimal, cost: LotCost | None) -> None:
        lots = self.lots.setdefault(currency, {})
        lot = lots.get(cost)
        if lot is not None and lot.units + units == 0:
            self._note_all(currency)
            del lots[cost]
        elif lot is not None:
            self._note(currency, cost, lot.units)
            lot.units += units
        elif units:
            self._note(currency, cost, None)
            lots[cost] = Lot(units, cost)
        self.totals[currency] = self.total(currency) + units

    def reduce(self, currency: str, units: Decimal, wanted: Wanted, method: str) -> list[tuple[Decimal, LotCost]]:
        """Takes ``units`` (positive) out of fitting lots; returns what was taken from which."""
        self._note_all(currency)
        lots = self.lots.setdefault(currency, {})
        held = [x for x in lots.values() if x.cost is not None and x.units > 0]
        if wanted.merge:
            held = [self._average(currency, held)]
            lots = self.lots[currency]
        else:
            held = [x for x in held if wanted.fits(x.cost)]
        available = sum((x.units for x in held), Decimal(0))
        if available < units:
            raise BookingError(f"not enough {currency} to reduce: {available} of {units}")
        if method == "STRICT" and not wanted.merge and len(held) > 1 and available != units:
            raise BookingError(f"ambiguous lots of {currency}: {len(held)} match")
        if method in _ORDERS and len(held) > 1:
            key, down = _ORDERS[method]
            held = sorted(held, key=key, reverse=down)
        taken = []
        for lot in held:
            n = min(units, lot.units)
            if n:
                taken.append((n, lot.cost))
                lot.units -= n
                units -= n
                self.totals[currency] = self.total(currency) - n
            if not lot.units:
                del lots[lot.cost]
        return taken

    def _average(self, currency: str, held: list[Lot]) -> Lot:
        if not held:
            raise BookingError(f"no lots of {currency} to merge")
        if len({x.cost.currency for x in held}) > 1:
            raise BookingError(f"lots of {currency} have costs in several currencies")
        units = sum(x.units for x in held)
        cost = LotCost(sum(x.units * x.cost.number for x in held) / units, held[0].cost.currency, min((x.cost.date for x in held if x.cost.date), default=None))
        lot = Lot(units, cost)
        rest = {c: x for c, x in self.lots[currency].items() if not any(x is h for h in held)}
        if cost in rest:
            raise BookingError(f"a lot of {currency} at the average cost exists already")
        self.lots[currency] = rest | {cost: lot}
        return lot
