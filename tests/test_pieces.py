"""A ledger in pieces gives what the same text in one file gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.processing import Account
from tallyspark.sources import ledger_text as T
from tallyspark.sources import loader, pieces, runs

HEAD = """option "title" "Pieces"
option "inferred_tolerance_default" "*:0.001"
pushtag #all
2020-01-01 open Assets:Stock "FIFO"
2020-01-01 open Assets:Other "STRICT"
2020-01-01 open Assets:None "NONE"
2020-01-01 open Assets:Cash USD, EUR
2020-01-01 open Equity:Rest
2020-01-01 open Equity:Rest
2021-06-01 close Assets:None
"""
BODY = (
    '2020-03-{d} * "Pay\\"ee" "buy" #t{i} ^l\n  kk: {i}\n  Assets:Stock  {i} AB {{{i}.50 USD}}\n    note: "x"\n  Equity:Rest\n',
    '2020-04-{d} ! "three for a total"\n  Assets:Stock  3 AB {{{{10 USD}}}}\n  Equity:Rest\n',
    '2020-05-{d} * "sell"\n  Assets:Stock  -2 AB {{}} @ 7 USD\n  Assets:Cash  (2 * 7 - 1/3) USD\n  Equity:Rest\n',
    '2020-05-{d} txn "moved"\n  Assets:Stock  -1 AB {{}}\n  Assets:Other  1 AB {{{i}.25 USD, 2019-01-0{e}}}\n  Equity:Rest\n',
    '2020-06-{d} * "too many"\n  Assets:Other  -900 AB {{}}\n  Equity:Rest\n',
    '2020-06-{d} * "merged"\n  Assets:Other  -1 AB {{*}}\n\npushmeta from: "piece {i}"\n2020-06-{d} note Assets:Cash "noted"\npopmeta from:\n',
    '2020-07-{d} * "closed"\n  Assets:None  -1 AB {{1.00 USD}}\n  Equity:Rest\n2021-07-{d} * "late"\n  Assets:None  1 USD\n  Equity:Rest\n',
    '2020-07-{d} * "several\nlines" ; comment\n  Assets:Cash  1,000.00 USD @@ 5 EUR\n  Assets:Cash  -5 EUR\n* heading\n',
    '2020-07-{d} price AB  {i}.5 USD\n2020-07-{d} price AB  0 USD\n2020-07-{d} commodity C{i}\n2020-08-01 commodity C0\n',
    '2020-08-{d} P "wrong"\n  Assets:Cash  {i}.001 USD\n  Equity:Rest  -{i} USD\n2019-08-{d} * "early"\n  Assets:Cash  1 USD\n  Equity:Rest\n',
)


def made(n=60):
    return [HEAD, *[BODY[i * 7 % len(BODY)].format(i=i, d=10 + i % 15, e=1 + i % 9) for i in range(n)], "poptag #all"]


def in_pieces(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "place long, text string").repartition(5, "text")
    return pieces.load_pieces(spark, rows, ["place"], "book")


def content(ledger):
    out = {}
    for name in ("entries", "postings", "prices", "diagnostics", "accounts"):
        df = getattr(ledger, name)
        if "ord" in df.columns:
            df = df.orderBy("ord").drop("ord")
        found = [str(r) for r in df.select(sorted(df.columns)).collect()]
        out[name] = found if "ord" in getattr(ledger, name).columns else sorted(found)
    return out | {"title": ledger.title, "roots": ledger.roots}


@pytest.mark.parametrize("chunk", [1, 1 << 19])
def test_as_one_file(spark, monkeypatch, chunk):
    monkeypatch.setattr(pieces, "_CHUNK", chunk)
    found, want = content(in_pieces(spark, made())), content(loader.load_text(spark, "\n".join(made()) + "\n", "book"))
    assert len(want["diagnostics"]) > 15 and any("booking" in x for x in want["diagnostics"])
    assert found == want


def test_reductions_are_booked_by_account(spark):
    ledger = in_pieces(spark, made())
    assert ledger.postings.filter("account = 'Assets:Stock' AND number < 0").count() > 5
    assert ledger.checked() is ledger  # every posting has an ord of its own


def test_assertions_and_faults(spark):
    texts = [*made(20), "2021-01-01 pad Assets:Cash Equity:Rest\n2021-02-01 balance Assets:Cash  77 USD\n2021-02-01 balance Assets:Stock  1 AB"]
    assert content(in_pieces(spark, texts)) == content(loader.load_text(spark, "\n".join(texts) + "\n", "book"))
    texts = [*made(20), '2021-01-01 * "x"\n  Assets:Cash  1 USD USD', *made(5), "2021-02-30 note Assets:Cash"]
    assert content(in_pieces(spark, texts)) == content(loader.load_text(spark, "\n".join(texts) + "\n", "book"))


@pytest.mark.parametrize(
    "line",
    ['2020-01-01 * "a" "b" #t ^l', '2020-01-01 * "a\\"\\n"', "2020-01-01 P", "2020-01-01 txn", '2020-01-01 * "a" #t #u ', "2020-01-01 *  ", '2020-01-01 * "a\\\\" "b"'],
)
@pytest.mark.parametrize(
    "under",
    ["  Assets:A  1 USD", "\t! Assets:A  -1.50 USD {2 EUR, 2020-01-02} @ 3 GBP", "  Assets:A  (1 + 2) * 3 USD", "  Assets:A  (1 + 2 - 4/3) USD {}", "  kk: 5", '  kk: "v"', "  Assets:A", "  Assets:A  -0 USD {*}", "  ", "  Assets:A  (.5 * -2.) USD"],
)
def test_common_lines_as_by_tokens(monkeypatch, line, under):
    text = f"{line}\n{under}\r\n{under}\n  mm: 1.5\n\n"
    quick = T.parse(text, "f", 7, ["pushed"], [("by", ("none", None))])
    never = T.re.compile(r"(?!)")
    for name in ("_PLAIN_HEAD", "_PLAIN_POSTING", "_PLAIN_META", "_BLANK"):
        monkeypatch.setattr(T, name, never)
    assert T.parse(text, "f", 7, ["pushed"], [("by", ("none", None))]) == quick


PLAIN = (
    '2020-03-01 * "a \\"b\\"" "c\\\\d" #t #all ^l\n  key: 7\n  name: "x"\n  Assets:Cash  (12.50 + 3 - 5 * 2.10) USD\n  ! Equity:Rest\n\n',
    '2020-03-02 ! "n"\n  Assets:Stock  3 AB {1.50 USD}\n  Equity:Rest',
    '2020-03-03 P "n"\n  Assets:Other  2 AB {0.25 USD, 2019-05-06} @ 7.5 EUR\n  Equity:Rest\n\n',
    '2020-03-04 *\n  Assets:Cash  1 EUR @ 9.10 USD\n  Equity:Rest  -9.10 USD',
    '2020-03-05 * "zero is left"\n  Assets:Cash  1.00 EUR\n  Equity:Rest  -1 EUR\n  Equity:Rest',
    '2020-03-06 * "wide"\n  Assets:Cash  (-(2)) USD\n  Assets:Cash  (2.50) USD\n  Assets:None  1 AB {3 USD}\n  Equity:Rest',
)
OTHER = (
    '2020-04-01 * "other currency"\n  Assets:Cash  1 GBP\n  Equity:Rest',
    '2020-04-02 * "not open"\n  Assets:Nowhere  1 USD\n  Equity:Rest',
    '2020-04-03 * "within"\n  Assets:Cash  1.00 USD\n  Equity:Rest  -1.001 USD',
    '2020-04-04 * "two open"\n  Assets:Cash  1 USD\n  Assets:Cash  1 EUR\n  Equity:Rest',
    '2020-04-05 * "twice"\n  kk: 1\n  kk: 1\n  Assets:Cash  1 USD\n  Equity:Rest',
    '2020-04-06 * "below"\n  Assets:Cash  1 USD\n    kk: "of the posting"\n  Equity:Rest',
    '2020-04-07 * "later"\n  Assets:Cash  1 USD\n\n  Equity:Rest\n\n   ; said\n  Equity:Rest  0 USD',
    '2020-04-08 * "nothing"\n  Assets:Cash  (1 - 1) USD\n  Equity:Rest  -0.00 USD',
    '2020-04-09 * "long"\n  Assets:Cash  (123456.1234567 * 3.1234567) USD\n  Equity:Rest',
    '2020-04-10 * "wrong"\n  Assets:Cash  1 EUR @ -9.10 USD\n  Equity:Rest',
    '2020-04-11 * "negative"\n  Assets:Other  1 XX {-1.00 USD}\n  Equity:Rest',
    '2020-04-12 * "third"\n  Assets:Cash  (1/3) USD\n  Equity:Rest',
)


@pytest.mark.parametrize("pushed", ["", "pushmeta by: 1\n"])
def test_plain_transactions_as_any_other(spark, pushed):
    texts = [HEAD.rstrip("\n"), *PLAIN, *OTHER, *(pushed + x for x in PLAIN), *(["popmeta by:"] * len(PLAIN) if pushed else []), "poptag #all"]
    assert content(in_pieces(spark, texts)) == content(loader.load_text(spark, "\n".join(texts) + "\n", "book"))


def test_plain_transactions_are_taken_at_once():
    config, _ = pieces.config_of([])
    process = pieces.Process(config)
    process.process(T.parse(HEAD, "book").directives)
    plain = pieces.Plain(config, process.accounts, "book")
    for some, want in ((PLAIN, True), (OTHER, False)):
        for text in some:
            assert [type(d) is tuple for d in T.parse(text + "\n", "book", plain=plain).directives] == [want], text


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_two_postings_at_once_as_one_by_one(monkeypatch, end):
    config, _ = pieces.config_of([])
    process = pieces.Process(config)
    process.process(T.parse(HEAD, "book").directives)
    plain, two, taken = pieces.Plain(config, process.accounts, "book"), pieces.Plain._two, []
    sums = ("(1.50 + 2*3 - .5)", "(2.50)", "( 2. * 3.10 )", "(7 - 3.005)", "-4.10", "(1 - 1)", "(99999.5 * 3 * 0 + 2)", "(12345678901.25)")
    more = [f'2020-03-0{i + 1} {"*!P"[i % 3]} "a \\"b\\"" "c" #t ^l\n  key: {i}\n  Assets:Cash  {n} USD\n  ! Equity:Rest\n' for i, n in enumerate(sums)]
    more += ['2020-03-09 * "priced"\n  Assets:Stock  3 AB {0.25 USD} @ 7.5 EUR\n  Equity:Rest\n\n', '2020-03-09 * "late"\n  Equity:Rest  1 USD\n  Assets:None\n\n  ; said\n']
    text = "\n".join([*PLAIN, *OTHER, *more, ""]).replace("\n", end)
    monkeypatch.setattr(pieces.Plain, "_two", lambda self, *at: taken.append(two(self, *at)) or taken[-1])
    found = T.parse(text, "book", 1, ["all"], (), plain).directives
    assert sum(x is not None for x in taken) > 8
    monkeypatch.setattr(pieces.Plain, "_two", lambda self, *at: None)
    monkeypatch.setattr("tallyspark.sources.plain._FLAT", T.re.compile(r"(?!)"))
    assert [repr(x) for x in T.parse(text, "book", 1, ["all"], (), plain).directives] == [repr(x) for x in found]


RUN = (
    '{d} {f} "Pay\\"ee" "n" #p{e} ^l{i}\n  key: {i}\n  Assets:Cash  ({i}.50 + 10.00 - 5 * 2) USD\n  ! Equity:Rest\n',
    '{d} {f} "one"\n  name: "x é"\n  Assets:Stock  {e} AB {{{i}.25 USD}}\n  Equity:Rest',
    '{d} {f} "back\\\\slash" "" ^l{i} #p{e} ^k #p{e}\n  Assets:Cash  -{e}.10 EUR @ 0{e}.50 USD\n  Equity:Rest\n\n   \n',
    '{d} {f}\n  Assets:Other  (1.0*{e}) AB {{{i}.50 USD, 2019-01-0{e}}} @ 9 EUR\n  Assets:Cash\n',
    '{d} {f} "a\\nb" ""\n  zero: 0{i}\n  Assets:None  {e}.000 AB {{{i} USD}}\n  Assets:Cash\n',
    '{d} {f} "odd" "numbers"\n  Equity:Rest  {n} USD\n  Equity:Rest',
    '{d} {f} "sell"\n  Assets:Stock  -1 AB {{}}\n  Equity:Rest\n',
    '{d} {f} "three"\n  Assets:Cash  1 USD\n  Assets:Cash  2 USD\n  Equity:Rest\n',
)
ODD = ("0", "(1 - 1)", "1.00000000001", "(2.500 * 4)", "(2.500)", "9999999999999999", "-10000000000000000", "922337203.6854775807", "1,000.00", "(.5*3 - 2.)", "(9999999 * 99999)", "(1000000000000 * 0.001)", "(1/3)", "0.0000001", "-0.50", "(1 + (2 - 3) * 4)", "12345678901234567.8")


def made_runs(n=400):
    head = HEAD.replace("2020-01-01 open", "2000-01-01 open")
    days = ("2001-02-28", "2004-02-29", "1999-12-31", "2021-06-01", "2021-06-02")
    return [head, *[RUN[i % 6 if i < 300 else i * 5 % 8].format(i=i, e=1 + i % 9, f="*!P"[i % 3], n=ODD[i // 6 % len(ODD)], d=days[i // 7 % 5] if i % 7 == 3 else f"20{10 + i % 9}-03-{10 + i % 3}") for i in range(n)], "poptag #all"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_runs_of_transactions_as_one_by_one(spark, end):
    texts = [x.replace("\n", end) + end[:-1] for x in made_runs()]
    found = content(in_pieces(spark, texts))
    assert len(found["entries"]) > 400 and found == content(loader.load_text(spark, "\n".join(texts) + "\n", "book"))


def test_texts_of_small_numbers(spark):
    texts = ["2020-01-01 open Assets:A\n2020-01-01 open Assets:B", *[f"2020-03-01 * \"small\"\n  Assets:A  {n} USD\n  Assets:B\n" for n in ("0.0000001", "-0.0000000100", "12.50", "-3", "922337203.6854775") * 5]]
    want = [r.text for r in loader.load_text(spark, "\n".join(texts) + "\n", "book").entries.orderBy("ord").collect()]
    spark.conf.set("spark.sql.ansi.enabled", "false")  # where a cast to text gives 1.000E-7
    try:
        assert [r.text for r in in_pieces(spark, texts).entries.orderBy("ord").collect()] == want
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("chunk", [1, 3000])
def test_short_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(pieces, "_CHUNK", chunk)
    assert content(in_pieces(spark, made_runs(200))) == content(loader.load_text(spark, "\n".join(made_runs(200)) + "\n", "book"))


def test_runs_are_taken_at_once():
    config, _ = pieces.config_of([])
    process = pieces.Process(config)
    process.process(T.parse(HEAD, "book").directives)
    text = "\n".join(RUN[i % 4].format(i=i + 1, e=1 + i % 9, f="*", n=1, d="2020-03-01") for i in range(100)) + "\n"
    found = T.parse(text, "book", 5, ("all",), (), runs.Runs(config, process.accounts, "book")).directives
    assert [type(x) for x in found] == [runs.Run]  # else a directive each and (found[0].first, found[0].last) == (0, 100)
    assert found[0].table.columns["entry"]["lineno"].to_pylist()[:3] == [5, 10, 14]
    n, scale, fine = runs._sums(["(2 * 3.50 - 1)", None, "(1.5 + 2*2 - 0.25 * 3)", "(1 - 1)", "(2.50)"])
    assert list(zip(n.tolist(), scale.tolist()))[::2] == [(6, 0), (475, 2), (250, 2)] and fine.tolist() == [True, False, True, False, True]


def test_reductions_without_lots_are_not_one_task(spark):
    vain = ['2020-06-{d} * "no lots"\n  Assets:Other  -{i} YY {{}}\n  Equity:Rest\n', '2020-06-{d} * "one of two"\n  Assets:Other  -{i} YY {{}}\n  Assets:Stock  -900 AB {{}}\n  Equity:Rest\n']
    texts = [*made(30), *[vain[i % 2].format(d=10 + i % 15, i=i + 1) for i in range(60)]]
    assert content(in_pieces(spark, texts)) == content(loader.load_text(spark, "\n".join(texts) + "\n", "book"))
    d = T.parse(vain[0].format(d=10, i=1), "book").directives[0]
    account = {"Assets:Other": Account(dt.date(2020, 1, 1))}
    assert pieces.needed(d, account) == ["Assets:Other YY"] and pieces.held_by(d) == []
    rows = spark.createDataFrame([(1, ["A YY"], []), (2, ["A AB"], []), (3, ["A YY", "A AB"], []), (4, None, []), (5, ["B CD"], ["B"])], "lineno long, tags array<string>, links array<string>")
    gains = spark.createDataFrame([(["A AB"],)], "links array<string>")
    assert sorted(r.lineno for r in pieces._in_vain(spark, rows, gains).filter("vain").collect()) == [1]


@pytest.mark.parametrize("few", [0, 50_000])
def test_few_and_many_reductions(spark, monkeypatch, few):
    monkeypatch.setattr(pieces, "_FEW", few)
    vain, kept = [], pieces._in_vain
    monkeypatch.setattr(pieces, "_in_vain", lambda *given: vain.append(1) or kept(*given))
    texts = [*made(30), *made_runs(330)[1:-1], '2022-01-01 * "no lots"\n  Assets:Other  -1 YY {}\n  Equity:Rest']
    assert content(in_pieces(spark, texts)) == content(loader.load_text(spark, "\n".join(texts) + "\n", "book"))
    assert len(vain) == (few == 0)  # needs joins that a few can do without


def test_dates_of_lots_by_heaps():
    import random
    import time
    from decimal import Decimal

    import pyarrow as pa

    from tallyspark.operators import lots

    def dates(rows):
        return [d for b in lots._fold([pa.RecordBatch.from_pylist(rows)]) for d in b.column(1).to_pylist()]

    def plainly(rows):
        key, held, out = None, {}, []
        for r in rows:
            if r["key"] != key:
                key, held = r["key"], {}
            d = r["cost_date"]
            if d is None:
                d = min((x for x, units in held.items() if units and (units > 0) != (r["number"] > 0)), default=r["date"])
                out.append(d)
            held[d] = held.get(d, 0) + r["number"]
        return out

    at, start = random.Random(5), dt.date(2020, 1, 1)
    day = lambda n: start + dt.timedelta(at.randrange(n))
    rows = [{"key": str(k), "ord": i, "date": day(40), "number": Decimal(at.randrange(-3, 4)), "cost_date": day(40) if at.random() < 0.5 else None} for k in range(40) for i in range(120)]
    assert dates(rows) == plainly(rows)
    rows = [{"key": "one", "ord": i, "date": start + dt.timedelta(i % 20_000), "number": Decimal(5), "cost_date": None} for i in range(60_000)]
    began = time.process_time()
    assert dates(rows) == [r["date"] for r in rows] and time.process_time() - began < 10
