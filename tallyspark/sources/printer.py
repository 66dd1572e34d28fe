"""Directives as ledger text."""

from __future__ import annotations

from decimal import Decimal

from tallyspark.sources.ledger_text import Amount, Cost, Directive, Posting

_WIDTH = 50


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def number(x: Decimal) -> str:
    return format(x, "f")


def value(item) -> str:
    kind, v = item
    match kind:
        case "string":
            return quoted(v)
        case "bool":
            return "TRUE" if v else "FALSE"
        case "amount":
            return f"{number(v.number)} {v.currency}"
        case "number":
            return number(v)
        case "tag":
            return f"#{v}"
        case "link":
            return f"^{v}"
        case "none":
            return ""
    return str(v)


def cost(c: Cost) -> str:
    parts = ["*"] if c.merge else []
    if c.number is not None or c.total is not None:
        n = " # ".join(number(x) for x in (c.number, c.total) if x is not None)
        parts.append(f"{n} {c.currency}" if c.currency else n)
    parts += [str(c.date)] if c.date else []
    parts += [quoted(c.label)] if c.label else []
    return f"{'{{' if c.is_total else '{'}{', '.join(parts)}{'}}' if c.is_total else '}'}"


def amount(a: Amount) -> str:
    return " ".join(x for x in (number(a.number) if a.number is not None else "", a.currency or "") if x)


def posting_line(account: str, flag: str, n: str, currency: str) -> str:
    head = f"  {flag + ' ' if flag else ''}{account}"
    return f"{head}  {n:>{max(0, _WIDTH - len(head) - 2)}} {currency}".rstrip()


def posting(p: Posting) -> str:
    if p.units is None:
        return f"  {p.flag + ' ' if p.flag else ''}{p.account}"
    out = posting_line(p.account, p.flag, number(p.units.number) if p.units.number is not None else "", p.units.currency or "")
    if p.cost is not None:
        out += f" {cost(p.cost)}"
    if p.price is not None:
        out += f" {'@@' if p.price_total else '@'} {amount(p.price)}".rstrip()
    return out


def directive_text(d: Directive) -> str:
    """One directive with its metadata and postings, lines joined by newlines."""
    v = d.values
    labels = "".join([f" #{t}" for t in v.get("tags", ())] + [f" ^{x}" for x in v.get("links", ())])
    match d.kind:
        case "transaction":
            payee = f" {quoted(d.payee)}" if d.payee else ""
            body = f"{d.flag}{payee} {quoted(d.narration)}{labels}"
        case "open":
            body = " ".join(x for x in ("open", d.account, ",".join(d.currencies), quoted(d.booking) if d.booking else "") if x)
        case "close":
            body = f"close {d.account}"
        case "commodity":
            body = f"commodity {d.currency}"
        case "balance":
            tolerance = f" ~ {number(d.tolerance)}" if d.tolerance is not None else ""
            body = f"balance {d.account}  {number(d.number)}{tolerance} {d.currency}"
        case "pad":
            body = f"pad {d.account} {d.source}"
        case "note":
            body = f"note {d.account} {quoted(d.comment)}"
        case "document":
            body = f"document {d.account} {quoted(d.path)}{labels}"
        case "price":
            body = f"price {d.currency}  {amount(d.amount)}"
        case "event":
            body = f"event {quoted(d.name)} {quoted(d.value)}"
        case "query":
            body = f"query {quoted(d.name)} {quoted(d.text)}"
        case "custom":
            body = " ".join(["custom", quoted(d.type), *map(value, d.custom)])
    lines = [f"{d.date} {body}", *[f"  {k}: {value(x)}".rstrip() for k, x in d.meta]]
    for p in d.postings:
        lines += [posting(p), *[f"    {k}: {value(x)}".rstrip() for k, x in p.meta]]
    return "\n".join(lines)
