"""Builders, generated text, error rendering, sources as JSON, the shell, the graph of prices and the tree of accounts."""

import datetime as dt
import io
import json
from decimal import Decimal
from types import SimpleNamespace

import pytest

from tallyspark import cli
from tallyspark.operators import tree
from tallyspark.sinks import errors, sources
from tallyspark.sinks.formatter import format_files, formatted
from tallyspark.sources import builders, loader

DAY = dt.date(2021, 3, 4)


def test_builders_of_all_kinds_parse_back(spark):
    text = builders.ledger_text(
        builders.opened(DAY, "Assets:Here", "EUR"), builders.opened(DAY, "Equity:Start"), builders.commodity(DAY, "ACME"), builders.price(DAY, "ACME", builders.amount("7.50", "EUR")),
        builders.pad(DAY, "Assets:Here", "Equity:Start"), builders.note(DAY, "Assets:Here", 'say "hi"'), builders.event(DAY, "place", "home"), builders.query(DAY, "all", "SELECT account"),
        builders.custom(DAY, "budget", ("string", "food"), ("number", Decimal("12.5"))), builders.balance(dt.date(2021, 4, 1), "Assets:Here", builders.amount("3.00", "EUR")),
        builders.transaction(dt.date(2021, 5, 1), "move", builders.posting("Assets:Here", builders.amount("-3.00", "EUR")), builders.posting("Equity:Start"), tags=("t",)), builders.closed(dt.date(2021, 6, 1), "Assets:Here"),
    )
    ledger = loader.load_text(spark, text)
    assert ledger.diagnostics.count() == 0
    kinds = {r.type: r["count"] for r in ledger.entries.groupBy("type").count().collect()}
    assert kinds == {"open": 2, "commodity": 1, "price": 1, "pad": 1, "note": 1, "event": 1, "query": 1, "custom": 1, "balance": 1, "transaction": 2, "close": 1}
    assert [r.number for r in ledger.postings.filter("flag = 'P' AND account = 'Assets:Here'").collect()] == [Decimal("3")]
    assert builders.ledger_text(builders.document(DAY, "Assets:Here", "a.pdf", ("x",))) == '2021-03-04 document Assets:Here "a.pdf" #x\n'


def test_generated_text_loads_without_fault(spark):
    blocks = [r.value for r in builders.generated_text(spark, 400).collect()]
    ledger = loader.load_text(spark, "\n".join([builders.GENERATED_HEAD, *blocks]))
    assert ledger.diagnostics.count() == 0 and {r.type for r in ledger.entries.select("type").distinct().collect()} == {"open", "transaction", "balance", "price"}
    assert blocks == [r.value for r in builders.generated_text(spark, 400).collect()] != [r.value for r in builders.generated_text(spark, 400, 2).collect()]


def test_import_with_categories(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text("Date,Payee,Amount\n2020-01-01,Corner SHOP,-5.25\n2020-01-02,Boss,100.00\n2020-01-03,Else,-1.00\n")
    rows = builders.from_bank_csv(spark, str(path), "Assets:Bank", "Expenses:Other", "USD", {"shop": "Expenses:Food", "boss": "Income:Work"})
    assert {r.account: r.number for r in rows.filter("account <> 'Assets:Bank'").collect()} == {"Expenses:Food": Decimal("5.25"), "Income:Work": Decimal("-100.00"), "Expenses:Other": Decimal("1.00")}


TEXT = """2020-01-01 open Assets:A
2020-01-01 open Equity:B

2020-02-01 * "wrong"
  Assets:A  1.00 EUR
  Equity:B  -2.00 EUR

2020-02-02 note Assets:None "x"
"""


def test_errors_with_their_lines(spark):
    ledger = loader.load_text(spark, TEXT, "book")
    first, second = errors.errors_text(ledger, {"book": TEXT})
    assert first.split("\n") == ["book:4: error: the transaction doesn't balance: -1.00 EUR", "", "   2020-01-01 open Equity:B", "", '   2020-02-01 * "wrong"', "     Assets:A  1.00 EUR", "     Equity:B  -2.00 EUR"]
    assert second.startswith("book:8: error: Assets:None")
    assert [json.loads(x)["type"] for x in errors.errors_json(ledger)] == ["unbalanced", "not_open"]
    assert errors.rendered("bad", "f", 1, "a\tb c", 4).split("\n") == ["f:1: bad", "", "   a\tb c", "    \t ^"] and errors.rendered("bad", "", 0) == "bad"


def test_sources_are_read_and_written_with_a_fingerprint(spark, tmp_path):
    (tmp_path / "main.ledger").write_text('include "a.ledger"\n')
    (tmp_path / "a.ledger").write_text("2020-01-01 open Assets:A\n")
    (tmp_path / "other.ledger").write_text("")
    root, path = str(tmp_path / "main.ledger"), str(tmp_path / "a.ledger")
    seen = sources.source(spark, root, path)
    assert seen["source"] == "2020-01-01 open Assets:A\n"
    now = sources.write_source(spark, root, "2020-01-01 open Assets:B\n", seen["fingerprint"], path)
    assert now["source"] == (tmp_path / "a.ledger").read_text() == "2020-01-01 open Assets:B\n"
    with pytest.raises(sources.Conflict):
        sources.write_source(spark, root, "x", seen["fingerprint"], path)
    with pytest.raises(PermissionError):
        sources.source(spark, root, str(tmp_path / "other.ledger"))
    assert sources.accounts(loader.load(spark, root)) == [{"name": "Assets:B", "type": "assets", "open": "2020-01-01", "close": None}]


def test_shell_answers_line_by_line(spark):
    out = io.StringIO()
    args = SimpleNamespace(format="text", numberify=False)
    cli.shell(loader.load_text(spark, TEXT), args, io.StringIO("SELECT bogus\n\nSELECT count(date) AS n FROM is_bad\nPRINT FROM type = 'note'\nquit\nSELECT account\n"), out)
    lines = out.getvalue().split("\n")
    assert lines[0].startswith("ERROR: Invalid column name 'bogus'") and lines[1].startswith("ERROR: ") and lines[2] == '2020-02-02 note Assets:None "x"' and lines[3:] == [""]


def test_formatter_indents_postings_alike():
    text = '2020-01-01 * "x"\n      Assets:A   1.00 EUR\n Equity:B\n'
    assert formatted(text) == '2020-01-01 * "x"\n      Assets:A  1.00 EUR\n      Equity:B\n'  # equally frequent: the widest
    assert formatted(text, indent=2).split("\n")[2] == "  Equity:B"
    assert formatted(text + "\n" + text.replace("      ", " ")).split("\n")[1] == " Assets:A       1.00 EUR"
    assert formatted("") == "" and formatted("; only") == "; only\n"


FORMATTED = """2021-02-03 * "Füllung 日本" "x"  #t ; head
  kind: "a"
  ! Assets:日本:X                      10 ACME {1.50 USD, 2020-01-01, "l"} @ 3 USD  ref: "R"  ; c
  Assets:Cash                   -1,550.00 USD
  Equity:None
  ; inner
  Assets:E                        (1 + 2) USD

2021-02-04 balance Assets:Cash   5 ~ 0.01 USD
2021-02-05 price ACME                 2.5 USD ; p
2021-02-06 note Assets:Cash "a \\"q\\"\\nb\\tc"
2021-02-06 open Assets:Z      USD
"""


def test_formatter_aligns_spaces_and_escapes():
    loose = FORMATTED.replace(" " * 22 + "10 ACME {1.50 USD, 2020-01-01, ", " 10  ACME { 1.50 USD,2020-01-01 , ").replace("} @ 3 USD  ref", "}@ 3  USD ref")
    loose = loose.replace("Cash" + " " * 19, "Cash  ").replace(" " * 24 + "(", "   (").replace("Cash   5", "Cash 5").replace("ACME" + " " * 17, "ACME ").replace("\\nb\\t", "\nb\t")
    assert loose != FORMATTED and formatted(loose) == FORMATTED == formatted(FORMATTED) == formatted(loose, style="escaped")
    literal = formatted(FORMATTED, style="literal")
    assert '"a \\"q\\"\nb\tc"' in literal and formatted(literal) == FORMATTED
    bare = formatted(FORMATTED, comments=False, blanks=False)
    assert ";" not in bare and "\n\n" not in bare and len(bare.splitlines()) == 10
    with pytest.raises(ValueError):
        formatted("", style="none")


def test_formatter_columns():
    text = '2021-01-01 * "x"\n  Assets:Bank  1.00 USD\n  Income:Pay  -1.00 USD\n'
    at = lambda **o: {line.index("USD") + 1 for line in formatted(text, **o).splitlines()[1:]}
    assert at() == {22} and at(column=60) == {60} and at(prefix_width=40, num_width=12) == {56}
    assert at(prefix_width=40) == {49} and at(num_width=15) == {32} and at(column=70, prefix_width=40) == {70}
    assert formatted(text, column=3).splitlines()[1:] == ["  Assets:Bank  1.00 USD", "  Income:Pay  -1.00 USD"]  # never less than two spaces


def test_format_files(spark):
    files = spark.createDataFrame([("a", bytearray(FORMATTED.encode())), ("b", bytearray(b"\xff")), ("c", None)], "path string, content binary")
    assert {r.path: r.text for r in format_files(files).collect()} == {"a": FORMATTED, "b": None, "c": None}


def test_graph_and_tree(spark):
    ledger = loader.load_text(spark, "2020-01-01 price A  2 B\n2020-01-02 price A  3 B\n2020-01-02 price C  3 B\n".replace(" A ", " AA ").replace(" B", " BB").replace(" C ", " CC ") + "2020-01-01 open Assets:X:Y\n2020-01-01 open Assets:Z\n")
    assert ledger.price_book.stats() == {"currencies": 3, "pairs": 4, "quotes": 6}
    assert {tuple(r) for r in tree.parents(ledger.accounts).collect()} == {("Assets", None), ("Assets:X", "Assets"), ("Assets:X:Y", "Assets:X"), ("Assets:Z", "Assets")}
    assert sorted(r.account for r in tree.children(ledger.accounts, "Assets").collect()) == ["Assets:X", "Assets:Z"]
