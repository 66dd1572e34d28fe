"""Ledgers from Python values, and generated ones for load tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.ledger_text import Amount, Cost, Directive, Posting
from tallyspark.sources.printer import directive_text


def amount(number: str | Decimal, currency: str) -> Amount:
    return Amount(Decimal(number), currency)


def posting(account: str, units: Amount | None = None, *, cost: Cost | None = None, price: Amount | None = None, total: bool = False, flag: str = "", **meta: str) -> Posting:
    return Posting(account, units, cost, price, total, flag, [(k, ("string", v)) for k, v in meta.items()])


def transaction(date: dt.date, narration: str, *postings: Posting, payee: str = "", flag: str = "*", tags: tuple[str, ...] = (), links: tuple[str, ...] = (), **meta: str) -> Directive:
    values = {"flag": flag, "payee": payee, "narration": narration, "tags": list(tags), "links": list(links)}
    return Directive("transaction", date, "", 0, meta=[(k, ("string", v)) for k, v in meta.items()], values=values, postings=list(postings))


def opened(date: dt.date, account: str, *currencies: str, booking: str = "") -> Directive:
    return Directive("open", date, "", 0, values={"account": account, "currencies": list(currencies), "booking": booking})


def _of(kind: str, date: dt.date, **values) -> Directive:
    return Directive(kind, date, "", 0, values=values)


def closed(date: dt.date, account: str) -> Directive:
    return _of("close", date, account=account)


def commodity(date: dt.date, currency: str) -> Directive:
    return _of("commodity", date, currency=currency)


def balance(date: dt.date, account: str, units: Amount, tolerance: Decimal | None = None) -> Directive:
    return _of("balance", date, account=account, number=units.number, currency=units.currency, tolerance=tolerance)


def pad(date: dt.date, account: str, source: str) -> Directive:
    return _of("pad", date, account=account, source=source)


def price(date: dt.date, currency: str, quote: Amount) -> Directive:
    return _of("price", date, currency=currency, amount=quote)


def note(date: dt.date, account: str, comment: str) -> Directive:
    return _of("note", date, account=account, comment=comment)


def document(date: dt.date, account: str, path: str, tags: tuple[str, ...] = (), links: tuple[str, ...] = ()) -> Directive:
    return _of("document", date, account=account, path=path, tags=list(tags), links=list(links))


def event(date: dt.date, name: str, value: str) -> Directive:
    return _of("event", date, name=name, value=value)


def query(date: dt.date, name: str, text: str) -> Directive:
    return _of("query", date, name=name, text=text)


def custom(date: dt.date, kind: str, *values: tuple[str, object]) -> Directive:
    return _of("custom", date, type=kind, custom=list(values))


def ledger_text(*directives: Directive) -> str:
    """The directives as they stand in a ledger file."""
    return "\n".join(directive_text(d) + "\n" * (d.kind == "transaction") for d in directives) + "\n"


def categorised(payee: Column, other: str, categories: dict[str, str]) -> Column:
    """Account of the first pattern that the payee matches, whatever its case; else ``other``."""
    out = F.lit(other)
    for pattern, account in reversed(categories.items()):
        out = F.when(payee.rlike(f"(?i){pattern}"), F.lit(account)).otherwise(out)
    return out


def from_bank_csv(spark: SparkSession, path: str, account: str, other: str, currency: str, categories: dict[str, str] | None = None) -> DataFrame:
    """Posting rows of a bank's CSV with columns Date, Payee and Amount: each line is a transaction of two postings, the
    second on ``other`` or on the account that ``categories`` (patterns of payees) give."""
    lines = spark.read.schema("Date date, Payee string, Amount decimal(18,2)").csv(path, header=True)
    key = F.monotonically_increasing_id()
    key = F.when(key < 1 << 44, key).otherwise(F.raise_error(F.lit("too many parts of a CSV file to number its lines")).cast("bigint"))
    lines = lines.select(key.alias("entry_id"), F.col("Date").alias("date"), F.trim("Payee").alias("payee"), F.lit("").alias("narration"), F.lit("*").alias("flag"), F.lit(currency).alias("currency"), F.lit(2).alias("scale"), F.array(F.lit(account), categorised(F.trim("Payee"), other, categories or {})).alias("accounts"), "Amount")
    legs = F.array(F.struct(F.lit(account).alias("account"), F.col("Amount").alias("number")), F.struct(F.col("accounts")[1].alias("account"), (-F.col("Amount")).cast("decimal(18,2)").alias("number")))
    day = F.shiftleft(F.datediff("date", F.lit("1970-01-01")).cast("bigint"), 46)
    return lines.select("*", F.posexplode(legs).alias("nth", "leg")).select((day + F.col("entry_id") * 2 + F.col("nth")).alias("ord"), "*", "leg.*").drop("leg", "nth", "Amount")


def generated(spark: SparkSession, transactions: int, accounts: int = 100, seed: int = 1) -> DataFrame:
    """Posting rows of balanced random transactions, the same for the same seed."""
    ids = spark.range(transactions).select(F.col("id").alias("entry_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100_000)).alias("r"))
    n = (F.col("r") / 100 + 1).cast("decimal(18,2)")
    date = F.date_add(F.lit(dt.date(2020, 1, 1)), F.floor(F.col("entry_id") * 1000 / max(1, transactions)).cast("int"))
    spent = F.concat(F.lit("Expenses:Kind"), (F.col("r") % accounts).cast("string"))
    legs = F.array(F.struct(spent.alias("account"), n.alias("number")), F.struct(F.lit("Assets:Cash").alias("account"), (-n).cast("decimal(18,2)").alias("number")))
    rows = ids.select("entry_id", date.alias("date"), F.lit("*").alias("flag"), F.lit("Payee").alias("payee"), F.concat(F.lit("Purchase "), F.col("entry_id").cast("string")).alias("narration"), F.lit("USD").alias("currency"), F.lit(2).alias("scale"), F.array(spent, F.lit("Assets:Cash")).alias("accounts"), F.posexplode(legs).alias("nth", "leg"))
    return rows.select((F.col("entry_id") * 2 + F.col("nth")).alias("ord"), "*", "leg.*").drop("leg", "nth")


_BLOCKS = (
    '{d} * "Shop" "Groceries {i}"\n  Expenses:Food  {a} USD\n  Assets:Checking',
    '{d} * "Cafe" "Lunch {i}"\n  place: "corner {i}"\n  Expenses:Food  {a} USD\n    receipt: "{i}"\n  Assets:Checking  -{a} USD',
    '{d} * "Broker" "Buy {i}"\n  Assets:Stock  2 ACME {{{a} USD}}\n  Assets:Checking',
    '{d} * "Bank" "Exchange {i}"\n  Assets:Savings  100.00 EUR @ 1.25 USD\n  Assets:Checking  -125.00 USD',
    '{d} ! "Trip" "Hotel and train {i}" #trip-{t} ^bill-{i}\n  Expenses:Hotel  {a} USD\n  Expenses:Train  {a} USD\n  Liabilities:Card',
    '{d} balance Assets:Untouched  0.00 USD',
    '{d} price ACME  {a} USD',
)
_SHARES = (0, 0, 1, 1, 2, 2, 3, 4, 5, 6)  # of ten directives, how many are of which kind
GENERATED_HEAD = "\n".join(f"2019-12-31 open {a}" for a in ("Expenses:Food", "Expenses:Hotel", "Expenses:Train", "Assets:Checking", "Assets:Stock", "Assets:Savings", "Assets:Untouched", "Liabilities:Card"))


def generated_text(spark: SparkSession, directives: int, seed: int = 1) -> DataFrame:
    """Ledger text for load tests, a block of lines (``value``) per directive of mixed kinds, the same for the same seed; to be
    written as text files and included from a root file that starts with GENERATED_HEAD."""
    ids = spark.range(directives).withColumn("r", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)))
    date = F.date_format(F.date_add(F.lit(dt.date(2020, 1, 1)), F.floor(F.col("id") / 3).cast("int")), "yyyy-MM-dd")
    parts = {"d": date, "i": F.col("id").cast("string"), "a": (F.col("r") % 90_000 / 100 + 1).cast("decimal(18,2)").cast("string"), "t": (F.col("r") % 50).cast("string")}
    text = F.element_at(F.array(*[F.lit(b) for b in _BLOCKS]), F.element_at(F.array(*[F.lit(x + 1) for x in _SHARES]), (F.col("r") % 10 + 1).cast("int")))
    for name, value in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    text = F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    return ids.select(F.concat(text, F.lit("\n")).alias("value"))
