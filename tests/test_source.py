import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyspark.operators.booking import BookingError, Holdings, LotCost, Wanted
from tallyspark.operators.processing import Ledger
from tallyspark.sources import ledger_text as T
from tallyspark.sources.config import config_of
from tallyspark.sources.printer import directive_text
from tallyspark.sinks.formatter import formatted

OPEN = "2020-01-01 open Assets:Cash\n2020-01-01 open Assets:Stock\n2020-01-01 open Income:Gain\n2020-01-01 open Expenses:Food\n2020-01-01 open Equity:Open\n"


def checked(text: str, start: str = OPEN):
    parsed = T.parse(start + text)
    config, wrong = config_of(parsed.options)
    process = Ledger(config)
    return process.process(parsed.directives), process, wrong


def codes(text: str, start: str = OPEN) -> list[str]:
    return [d.code for d in checked(text, start)[1].diagnostics]


def test_parses_every_kind():
    text = '''option "title" "T"
plugin "p" "c"
include "other.file"
pushtag #trip
2020-01-02 * "Payee" "Text \\"quoted\\"" #a ^l
  key: "v"
  Assets:Cash  -(1 + 2) * 2.5 USD
    leg: 3
  ! Expenses:Food
poptag #trip
pushmeta who: "me"
2020-01-03 txn "only narration"
  Assets:Cash  1,234.50 USD @ 2 EUR
  Assets:Stock  10 HOOL {5 # 1 USD, 2020-01-01, "lot"} @@ 60 USD
popmeta who:
2020-01-04 balance Assets:Cash  1 ~ 0.5 USD
2020-01-05 pad Assets:Cash Equity:Open
2020-01-06 note Assets:Cash "n"
2020-01-07 document Assets:Cash "d.pdf" #t
2020-01-08 price HOOL 1.5 USD
2020-01-09 event "place" "here"
2020-01-10 query "q" "SELECT 1"
2020-01-11 custom "b" TRUE 1 USD Assets:Cash "x"
2020-01-12 commodity USD
2020-01-13 open Assets:New USD,EUR "FIFO"
2020-01-14 close Assets:New
* outline heading
'''
    f = T.parse(text)
    assert [d.kind for d in f.directives] == ["transaction", "transaction", "balance", "pad", "note", "document", "price", "event", "query", "custom", "commodity", "open", "close"]
    a, b = f.directives[:2]
    assert a.tags == ["a", "trip"] and a.narration == 'Text "quoted"' and a.postings[0].units.number == Decimal("-7.5") and a.postings[0].meta == [("leg", ("number", Decimal(3)))]
    assert b.meta == [("who", ("string", "me"))] and b.postings[0].units.number == Decimal("1234.50") and b.postings[1].cost.total == 1 and b.postings[1].price_total
    assert f.includes == [("other.file", 3)] and f.options[0][:2] == ("title", "T")
    again = T.parse("\n".join(map(directive_text, f.directives)))
    assert [directive_text(d) for d in again.directives] == [directive_text(d) for d in f.directives]


@pytest.mark.parametrize("text", ["2020-01-02 * 3\n", "2020-13-02 close Assets:A\n", '2020-01-02 * "a" "b" "c"\n', "2020-01-02 price USD\n", '2020-01-02 note Assets:A "x\\q"\n', "2020-01-02 * \"x\"\n  Assets:A 1 / 0 USD\n", "poptag #x\n", "opened\n"])
def test_parse_errors(text):
    with pytest.raises(T.ParseError):
        T.parse(text)


@given(st.text(alphabet='2019-/*! "\\{}@#^~;:\n\tabAB,.()0123456789', max_size=120))
def test_parser_never_crashes(text):
    try:
        T.parse(text)
    except T.ParseError:
        pass


def test_interpolation():
    done, process, _ = checked('2020-02-01 * "x"\n  Expenses:Food  4.50 USD\n  Assets:Cash\n')
    assert process.ok and done[-1].postings[1].units == T.Amount(Decimal("-4.50"), "USD")
    done, process, _ = checked('2020-02-01 * "x"\n  Assets:Stock  10 HOOL {}\n  Assets:Cash  -50 USD\n')
    assert process.ok and done[-1].postings[0].cost.number == 5
    done, process, _ = checked('2020-02-01 * "x"\n  Assets:Stock  10 EUR @ USD\n  Assets:Cash  -11 USD\n')
    assert process.ok and done[-1].postings[0].price.number == Decimal("1.1")
    assert codes('2020-02-01 * "x"\n  Expenses:Food\n  Assets:Cash\n') == ["incomplete"]
    assert codes('2020-02-01 * "x"\n  Expenses:Food  1 USD\n  Assets:Stock  1 EUR\n  Assets:Cash\n') == ["incomplete"]


@pytest.mark.parametrize("units, code", [("-4.505", []), ("-4.51", ["unbalanced"]), ("-4.5", [])])
def test_tolerance_follows_digits(units, code):
    assert codes(f'2020-02-01 * "x"\n  Expenses:Food  4.50 USD\n  Assets:Cash  {units} USD\n') == code


def test_lifecycle_and_options():
    assert codes('2019-01-01 * "early"\n  Assets:Cash  1 USD\n  Equity:Open  -1 USD\n') == ["not_open"]
    assert codes("2020-02-01 close Assets:Cash\n2020-02-02 * \"late\"\n  Assets:Cash  1 USD\n  Equity:Open  -1 USD\n") == ["not_open"]
    assert codes("2020-02-01 open Assets:Cash\n") == ["already_open"]
    assert codes("2020-02-01 open Other:Cash\n") == ["account_root"]
    assert checked('option "nonsense" "1"\n')[2] and not checked('option "operating_currency" "USD"\n')[2]


_LOTS = '2020-02-01 * "a"\n  Assets:Stock  10 HOOL {100 USD}\n  Assets:Cash\n2020-03-01 * "b"\n  Assets:Stock  10 HOOL {120 USD}\n  Assets:Cash\n'


def test_booking_methods():
    sell = '2020-04-01 * "s"\n  Assets:Stock  -5 HOOL {}\n  Assets:Cash\n'
    assert codes(_LOTS + sell) == ["booking"]
    for method, cost in (("FIFO", 100), ("LIFO", 120), ("HIFO", 120)):
        done, process, _ = checked(_LOTS + sell, OPEN.replace("Assets:Stock", f'Assets:Stock HOOL "{method}"'))
        assert process.ok and done[-1].postings[0].cost.number == cost
    done, process, _ = checked(_LOTS + sell.replace("-5 HOOL {}", "-20 HOOL {}"))
    assert process.ok and [p.units.number for p in done[-1].postings] == [-10, -10, 2200]
    assert codes(_LOTS + sell.replace("-5 HOOL {}", "-11 HOOL {100 USD}")) == ["booking"]


def test_failed_transaction_changes_nothing():
    _, process, _ = checked(_LOTS + '2020-04-01 * "s"\n  Assets:Stock  -5 HOOL {100 USD}\n  Assets:Cash  1 USD\n')
    assert process.accounts["Assets:Stock"].holdings.total("HOOL") == 20


def test_average_and_merge():
    h = Holdings()
    h.add("X", Decimal(10), LotCost(Decimal(1), "USD", dt.date(2020, 1, 1)))
    h.add("X", Decimal(10), LotCost(Decimal(3), "USD", dt.date(2020, 1, 2)))
    assert h.reduce("X", Decimal(5), Wanted(merge=True), "STRICT") == [(Decimal(5), LotCost(Decimal(2), "USD", dt.date(2020, 1, 1)))]
    with pytest.raises(BookingError):
        h.reduce("X", Decimal(50), Wanted(), "FIFO")


def test_balance_and_pad():
    assert codes("2020-02-01 balance Assets:Cash  5 USD\n") == ["balance"]
    done, process, _ = checked("2020-02-01 pad Assets:Cash Equity:Open\n2020-03-01 balance Assets:Cash  5.00 USD\n")
    assert process.ok and process.padding[0].postings[0].units.number == 5 and process.padding[0].date == dt.date(2020, 2, 1)
    assert codes("2020-02-01 pad Assets:Cash Equity:Open\n") == ["unused_pad"]


def test_formatter_aligns_and_is_idempotent():
    text = '2020-01-01 * "x"\n  Assets:Cash 1.00 USD ; note\n  Expenses:Longer:Name -10.25 USD\n\n; comment 1 USD\n'
    once = formatted(text)
    assert once == formatted(once)
    assert len({line.index(" USD") for line in once.split("\n")[1:3]}) == 1 and "; comment 1 USD" in once
