import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.language.syntax import QueryError
from tallyspark.operators import inventory, prices, tree
from tallyspark.plans.rows import position
from tallyspark.sinks.layout import csv_lines, text_table
from tallyspark.sinks.printing import printed
from tallyspark.sources import builders, loader
from tallyspark.ledger import Ledger
from tallyspark.streaming.watch import watch

TEXT = """option "title" "Small"
2022-12-28 open Assets:Cash USD
2022-12-28 open Assets:Bank USD
2022-12-28 open Assets:Stock
2022-12-28 open Income:Work
2022-12-28 open Income:Gains
2022-12-28 open Expenses:Food
2022-12-28 open Equity:Opening

2023-01-01 * "Opening"
  Assets:Cash  200.00 USD
  Assets:Bank  3000.00 USD
  Equity:Opening

2023-01-15 * "Acme" "Pay" #pay ^jan
  Assets:Bank  2500.00 USD
  Income:Work

2023-02-01 ! "Cafe" "Coffee" #food
  kind: "drink"
  Expenses:Food  4.50 USD
  Assets:Cash

2023-03-10 * "Broker" "Buy"
  Assets:Stock  8 ACME {520.00 USD}
  Assets:Bank  -4160.00 USD

2023-05-20 * "Broker" "Sell"
  Assets:Stock  -3 ACME {520.00 USD} @ 610.00 USD
  Assets:Bank  1830.00 USD
  Income:Gains  -270.00 USD

2023-06-01 price ACME 640.00 USD
2024-01-15 * "Acme" "Pay"
  Assets:Bank  2600.00 USD
  Income:Work
2024-05-01 note Assets:Cash "counted"
"""
TODAY = dt.date(2024, 6, 1)


@pytest.fixture(scope="module")
def ledger(spark):
    return loader.load_text(spark, TEXT, "small")


def rows(ledger, text):
    return [tuple(r) for r in ledger.query(text, TODAY).df.collect()]


def held(inv):
    return [(p.number, p.currency, p.cost.number if p.cost else None) for p in inv]


def test_loads_without_fault(ledger):
    assert ledger.diagnostics.count() == 0 and ledger.postings.count() == 14 and ledger.title == "Small"


def test_inventories(ledger):
    found = {a: held(i) for a, i in rows(ledger, "SELECT account, sum(position)")}
    assert found["Assets:Stock"] == [(5, "ACME", 520)] and found["Assets:Bank"] == [(5770, "USD", None)]
    assert [held(i)[0][:2] for a, i in rows(ledger, "BALANCES AT cost") if a == "Assets:Stock"] == [(2600, "USD")]
    assert [a for a, _ in rows(ledger, "BALANCES")][-1] == "Expenses:Food"


def test_sum_of_nothing_and_empty_groups(ledger):
    assert rows(ledger, "SELECT sum(number), count(date) WHERE account = 'x'") == []
    assert rows(ledger, "SELECT sum(cost_number) WHERE account = 'Assets:Cash'") == [(0,)]


def test_running_balance(ledger):
    assert [held(b)[0][0] for _, b in rows(ledger, "SELECT date, balance WHERE account = 'Assets:Cash'")] == [200, Decimal("195.5")]
    assert held(rows(ledger, "SELECT balance")[-1][0]) == [(5, "ACME", 520), (-2600, "USD", None)]


def test_balance_is_the_same_for_any_number_of_buckets(ledger):
    want = None
    for bucket_rows in (1, 2, 5, 64):
        got = [(r.ord, r.b) for r in inventory.running(ledger.postings, position(), "b", bucket_rows).select("ord", "b").orderBy("ord").collect()]
        want = want or got
        assert got == want


def test_open_close_clear(ledger):
    found = rows(ledger, "SELECT date, flag, account, number FROM OPEN ON 2024-01-01 WHERE flag = 'S' ORDER BY account")
    assert {(r[2], r[3]) for r in found if r[2].startswith("Equity:Earnings")} == {("Equity:Earnings:Previous", Decimal("-2765.5"))} and found[0][0] == dt.date(2023, 12, 31)
    assert len(rows(ledger, "SELECT date FROM CLOSE ON 2023-02-01")) == 5
    cleared = dict(rows(ledger, "SELECT account, number(only('USD', sum(position))) FROM CLEAR GROUP BY account"))
    assert cleared["Income:Work"] == 0 and cleared["Expenses:Food"] == 0 and cleared["Equity:Earnings:Current"] == Decimal("-5365.5")
    assert {r[0] for r in rows(ledger, "SELECT date FROM CLEAR WHERE flag = 'T'")} == {dt.date(2024, 5, 1)}


def test_prices(ledger):
    assert [a[0].number for a in rows(ledger, "SELECT convert(units(position), 'USD', 2023-12-31) WHERE currency = 'ACME'")] == [5120, -1920]
    assert [a[0].currency for a in rows(ledger, "SELECT convert(units(position), 'USD', 2023-01-01) WHERE currency = 'ACME'")] == ["ACME", "ACME"]
    assert rows(ledger, "SELECT DISTINCT getprice('USD', 'ACME'), getprice('ACME', 'XYZ')") == [(Decimal("0.0015625"), None)]
    assert held(rows(ledger, "SELECT value(sum(position)) WHERE account = 'Assets:Stock'")[0][0]) == [(3200, "USD", None)]
    assert [r[0].number for r in rows(ledger, "SELECT convert(units(position), 'USD', date_add(date, 400)) WHERE currency = 'ACME'")] == [5120, -1920]


def test_price_paths():
    edges = [("A", "B", Decimal(2), 0), ("B", "C", Decimal(3), 1), ("A", "D", Decimal(5), 2), ("D", "C", Decimal(7), 3)]
    assert prices.paths(edges)[("A", "C")] == 6
    assert ("C", "A") not in prices.paths(edges)


def test_newer_inverse_beats_older_direct(spark):
    table = spark.createDataFrame([(dt.date(2020, 1, 1), "A", "B", Decimal(2), 0), (dt.date(2020, 2, 1), "B", "A", Decimal(4), 1), (dt.date(2020, 2, 1), "B", "A", Decimal(5), 2)], "date date, base string, quote string, rate decimal(28,10), ord long")
    assert prices.PriceBook(table).at(dt.date(2020, 3, 1))[("A", "B")] == Decimal("0.25")
    assert prices.PriceBook(table).at(dt.date(2020, 1, 5))[("A", "B")] == 2


def test_operators(ledger):
    one = lambda e: rows(ledger, f"SELECT {e} LIMIT 1")[0][0]
    assert one("NULL = NULL") is True and one("cost_number < 1") is False and one("NOT cost_number < 1") is True
    assert one("1 / 0") is None and one("safediv(1.0, 0)") == 0 and one("1 + 2") == 3 and one("date + 1") is None
    assert one("'a(' ~ 'a('") is False and one("'ab' ~ 'b$'") is True and one("'food' in tags") is False
    assert one("0 OR ''") is False and one("1 AND 'x'") is True and one("str(TRUE)") == "True" and one("-3") == -3


def test_functions(ledger):
    one = lambda e: rows(ledger, f"SELECT {e} LIMIT 1")[0][0]
    assert one("date(2024, 13, 35)") == dt.date(2025, 2, 4) and one("date('2024/02/30')") is None
    assert one("maxwidth('one two  three', 11)") == "one [...]" and one("maxwidth('abcdefghij', 4)") == "[...]" and one("length('ä')") == 2
    assert one("grepn('(a)(b)?', 'a', 2)") == "" and one("grep('x*', 'abc')") is None and one("subst('(a)', '${1}1', 'aba')") == "a1ba1"
    assert one("root('A:B:C', 2)") == "A:B" and one("root('A', 0)") == "" and one("account_sortkey('X:Y')") == "5-X:Y"
    assert rows(ledger, "SELECT DISTINCT any_meta('kind') WHERE any_meta('kind') != NULL")[0][0].s == "drink"
    assert rows(ledger, "SELECT open_date(account), close_date(account) LIMIT 1") == [(dt.date(2022, 12, 28), None)]
    assert rows(ledger, "SELECT joinstr(tags), findfirst('^p', tags) WHERE 'jan' IN links LIMIT 1") == [("pay", "pay")]


def test_order_distinct_limit(ledger):
    assert rows(ledger, "SELECT date, account ORDER BY date DESC LIMIT 2") == [(dt.date(2024, 1, 15), "Assets:Bank"), (dt.date(2024, 1, 15), "Income:Work")]
    assert rows(ledger, "SELECT DISTINCT payee ORDER BY date DESC") == [("Acme",), ("Broker",), ("Cafe",), ("",)]
    assert rows(ledger, "SELECT flag, count(date) GROUP BY flag ORDER BY count(date)") == [("!", 2), ("*", 12)]


@pytest.mark.parametrize(
    "text, message",
    [
        ("SELECT bogus", "Invalid column name 'bogus' in targets/column context."), ("SELECT bogusfn(date)", "Invalid function 'bogusfn(date)' in targets/column context."),
        ("SELECT date GROUP BY narration", "All non-aggregates must be covered"), ("SELECT date WHERE sum(number)", "Aggregates are disallowed in WHERE clause."),
        ("SELECT date, sum(number) GROUP BY sum(number)", "GROUP-BY expressions may not be aggregates."), ("SELECT account, sum(number) GROUP BY 9", "Invalid GROUP-BY column index 9"),
        ("SELECT account, sum(number) GROUP BY 1 PIVOT BY account", "The PIVOT BY clause is not supported yet."), ("SELECT sum(account)", "Invalid function 'sum(str)'"),
    ],
)
def test_planner_errors(ledger, text, message):
    with pytest.raises(QueryError, match=None) as e:
        ledger.query(text, TODAY)
    assert message in str(e.value)


def test_text_table_and_csv(ledger):
    assert list(text_table(ledger.query("SELECT account, sum(position) WHERE account ~ 'Stock|Bank' GROUP BY account", TODAY))) == [
        "  account          sum_position       ",
        "------------ -------------------------",
        "Assets:Bank  5770.00 USD              ",
        "Assets:Stock    5    ACME {520.00 USD}",
    ]
    assert list(text_table(ledger.query("SELECT account WHERE account = 'x'", TODAY))) == ["(empty)"]
    assert list(csv_lines(ledger.query("SELECT account, sum(position) WHERE account ~ 'Stock|Bank' GROUP BY account", TODAY), numberify=True)) == [
        "account,sum_position (USD),sum_position (ACME)\r\n", "Assets:Bank ,5770.00, \r\n", "Assets:Stock,       ,5\r\n",
    ]


def test_print(ledger):
    lines = list(printed(ledger, "PRINT FROM year = 2024"))
    assert lines[0] == "" and lines[1].startswith('2024-01-15 * "Acme" "Pay"') and lines[-1] == '2024-05-01 note Assets:Cash "counted"'


def test_tree_sums_ancestors(ledger):
    nodes = {(r.account, r.currency): r.number for r in tree.tree(ledger.postings, ledger.accounts).collect()}
    assert nodes[("Assets", "USD")] == Decimal("5965.5") and nodes[("Assets", "ACME")] == 5 and ("Equity:Opening", None) in nodes
    assert tree.as_json(tree.tree(ledger.postings)).count() == 11


def test_includes_documents_and_cycles(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "main.ledger").write_text('include "sub/a.ledger"\n2020-01-01 open Assets:A\n2020-01-03 document Assets:A "there.txt"\n2020-01-03 document Assets:A "missing.txt"\n')
    (tmp_path / "sub/a.ledger").write_text('include "../main.ledger"\n2020-01-01 open Equity:B\n2020-01-02 * "x"\n  Assets:A  1 USD\n  Equity:B\n')
    (tmp_path / "there.txt").write_text("x")
    found = loader.load(spark, str(tmp_path / "main.ledger"), keep=str(tmp_path / "kept"))
    assert found.postings.count() == 2 and [r.message for r in found.diagnostics.collect()] == ["missing.txt does not exist"]


def test_files_are_parsed_where_they_are_read(spark, tmp_path):
    names = [f"part{i:02d}.ledger" for i in range(30)]
    (tmp_path / "main.ledger").write_text("".join(f'include "{n}"\n' for n in names) + "2020-01-01 open Assets:A\n2020-01-01 open Equity:B\n")
    for i, n in enumerate(names):
        push = "pushtag #pushed\n" if i == 3 else ""
        (tmp_path / n).write_text(f'{push}2020-02-{i % 28 + 1:02d} * "n{i}"\n  Assets:A  {i + 1}.00 EUR\n  Equity:B\n')
    (tmp_path / names[7]).write_bytes(b"2020-01-01 open Assets:A\n; \xff\n")
    (tmp_path / names[8]).write_text('2020-02-01 * "no end\n')
    found = loader.load(spark, str(tmp_path / "main.ledger"))
    assert found.postings.count() == 2 * 28
    assert {r.narration for r in found.entries.filter("array_contains(tags, 'pushed')").collect()} == {"n3"}
    wrong = {(r.filename.rsplit("/")[-1], r.lineno, r.code) for r in found.diagnostics.collect()}
    assert wrong == {(names[7], 2, "syntax"), (names[8], 1, "syntax")}
    files = spark.createDataFrame([("l", 0, "a", bytearray(b"")), ("l", 1, "b", None)], "ledger string, nth int, path string, content binary")
    assert "Exchange" not in loader.parse_files(files)._jdf.queryExecution().executedPlan().toString()
    assert [r.part for r in loader.tables(files).collect()] == ["config"] and loader.tables(files.limit(0)).count() == 0


def test_watch_reloads(spark, tmp_path):
    import time

    folder = tmp_path / "books"
    folder.mkdir()
    main = folder / "main.ledger"
    main.write_text("2020-01-01 open Assets:A\n")
    seen = []
    query = watch(spark, str(folder), str(main), lambda l, n: seen.append(l.accounts.count()), str(tmp_path / "state"))
    try:
        for text in (None, "2020-01-01 open Assets:A\n2020-01-01 open Assets:B\n", "2020-01-01 open Assets:A\n2020-01-01 open Assets:B\n2020-01-01 open Assets:C\n"):
            if text:
                main.write_text(text)
            want, began = (text or "x open").count("open"), time.time()
            while (not seen or seen[-1] != want) and time.time() - began < 60:
                time.sleep(0.2)
            assert seen[-1] == want
    finally:
        query.stop()


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "good.ledger").write_text('2020-01-01 open Assets:A\n2020-01-01 open Equity:B\n2020-01-02 * "x"\n  Assets:A  1 USD\n  Equity:B\n')
    (tmp_path / "bad.ledger").write_bytes(b"2020-01-01 open Assets:A\n2020-01-02 note Assets:A \"\xff\"\n")
    found = loader.load(spark, str(tmp_path / "bad.ledger"))
    assert [(r.code, r.lineno) for r in found.diagnostics.collect()] == [("syntax", 2)]
    many = loader.load_many(spark, str(tmp_path))
    assert many.filter("part = 'posting'").count() == 2 and many.filter("part = 'diagnostic'").count() == 1


def test_missing_documents_folder(spark, tmp_path):
    (tmp_path / "main.ledger").write_text('option "documents" "nowhere"\n2020-01-01 open Assets:A\n')
    found = loader.load(spark, str(tmp_path / "main.ledger"))
    assert [r.message for r in found.diagnostics.collect()] == ["the folder nowhere does not exist"]


PERIOD = """2020-01-01 open Assets:Cash
2020-01-01 open Income:Work
2020-01-01 open Expenses:Food
2020-02-01 * "Work"
  Assets:Cash  100.00 EUR
  Income:Work
2021-02-01 * "Food"
  Expenses:Food  40.50 EUR
  Assets:Cash
"""


def test_print_after_open_and_clear(spark):
    ledger = loader.load_text(spark, PERIOD)
    plain, cleared, opened = (list(printed(ledger, f"PRINT {x}")) for x in ("", "FROM CLEAR", "FROM OPEN ON 2021-01-01"))
    assert cleared[: len(plain)] == plain
    assert cleared[len(plain) :][1].startswith('2021-02-01 T "Transfer balance for \'Expenses:Food\'') and [x.split() for x in cleared[len(plain) :][2:4]] == [["Expenses:Food", "-40.50", "EUR"], ["Equity:Earnings:Current", "40.50", "EUR"]]
    assert sum(x.startswith("2021-02-01 T") for x in cleared) == 2
    assert opened[1].startswith('2020-12-31 S "Opening balance for \'Assets:Cash\'') and not any("2020-02-01" in x for x in opened)
    assert sum(" open " in x for x in opened) == 3 and [x.split() for x in opened[2:4]] == [["Assets:Cash", "100.00", "EUR"], ["Equity:Opening-Balances", "-100.00", "EUR"]]


def test_undated_lots_take_dates_in_queries(spark):
    rows_ = spark.sql("""SELECT * FROM VALUES (1L, DATE '2020-01-01', 5, DATE '2020-01-01'), (2L, DATE '2020-02-01', 5, DATE '2020-02-01'), (3L, DATE '2020-03-01', -5, CAST(NULL AS DATE)) AS t(ord, date, n, lot)""")
    rows_ = rows_.selectExpr("ord", "ord AS entry_id", "date", "'Assets:A' AS account", "CAST(n AS DECIMAL(28,10)) AS number", "'X' AS currency", "named_struct('number', CAST(2 AS DECIMAL(28,10)), 'scale', 0, 'currency', 'EUR', 'date', lot, 'label', CAST(NULL AS STRING)) AS cost")
    ledger = Ledger.of(rows_).checked()
    assert ledger.has_undated_costs
    assert [r[0] for r in ledger.query("SELECT cost_date").df.collect()] == [dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 1, 1)]
    with pytest.raises(ValueError):
        Ledger.of(rows_.unionByName(rows_)).checked()


def test_patterns_that_differ_by_row(spark):
    ledger = loader.load_text(spark, PERIOD)
    found = ledger.query("SELECT DISTINCT account, grep(root(account, 1), account) AS g, subst(root(account, 1), leaf(account), account) AS s, grepn(leaf(account), account, 0) AS n").df.collect()
    assert {tuple(r) for r in found} == {(a, a.split(":")[0], f"{a.split(':')[1]}:{a.split(':')[1]}", a.split(":")[1]) for a in ("Assets:Cash", "Income:Work", "Expenses:Food")}


def test_booking_stays_linear():
    import time

    from tallyspark.operators.booking import BookingError, Holdings, LotCost, Wanted

    def seconds(n):
        held, began = Holdings(), time.perf_counter()
        for i in range(n):
            held.begin()
            held.add("X", Decimal(1), LotCost(Decimal(i), "EUR", dt.date(2020, 1, 1)))
            held.end(i % 10 != 9)
        assert held.total("X") == n - n // 10 == len(held.lots["X"])
        return time.perf_counter() - began

    assert seconds(20_000) < 40 * seconds(2_000)
    held = Holdings()
    for i in range(4):
        held.add("X", Decimal(2), LotCost(Decimal(i), "EUR", dt.date(2020, 1, 4 - i)))
    before = [(x.cost, x.units) for x in held.lots["X"].values()]
    held.begin()
    held.reduce("X", Decimal(3), Wanted(), "FIFO")
    held.add("X", Decimal(-1), LotCost(Decimal(0), "EUR", dt.date(2020, 1, 4)))
    with pytest.raises(BookingError):
        held.reduce("X", Decimal(50), Wanted(), "FIFO")
    held.end(False)
    assert [(x.cost, x.units) for x in held.lots["X"].values()] == before and held.total("X") == 8


@pytest.mark.parametrize("options", [{"bucket_rows": 7}, {"bucket_rows": 7, "few_lots": 0}, {"bucket_rows": 1}, {}])
def test_running_balance_in_buckets(spark, options):
    from tallyspark.operators import inventory
    from tallyspark.plans import rows as R

    rows_ = Ledger.of(builders.generated(spark, 120, 5)).postings.withColumn("currency", F.when(F.col("ord") % 3 == 0, "EUR").otherwise("USD"))
    found = {r.ord: {p.currency: p.number for p in r.balance} for r in inventory.running(rows_, R.position(), "balance", **options).collect()}
    total = {}
    for r in rows_.orderBy("ord").collect():
        total[r.currency] = total.get(r.currency, 0) + r.number
        assert found[r.ord] == {c: n for c, n in total.items() if n}


def test_builders_and_generator(spark, tmp_path):
    from tallyspark.operators import checks

    rows_ = builders.generated(spark, 50)
    made = Ledger.of(rows_)
    assert checks.unbalanced(made.postings).count() == 0 and made.postings.count() == 100
    path = tmp_path / "bank.csv"
    path.write_text("Date,Payee,Amount\n2020-01-01,Shop,-5.25\n2020-01-02,Boss,100.00\n")
    bank = Ledger.of(builders.from_bank_csv(spark, str(path), "Assets:Bank", "Expenses:Other", "USD"))
    assert [held(i)[0][0] for a, i in [tuple(r) for r in bank.query("BALANCES").df.collect()]] == [Decimal("94.75"), Decimal("-94.75")]
    leg = builders.posting("Assets:A", builders.amount("1.50", "USD"))
    assert builders.transaction(dt.date(2020, 1, 1), "x", leg).postings[0].units.number == Decimal("1.50")
