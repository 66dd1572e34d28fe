"""Queries over ledger text that is written from the order tables, then parsed, checked and booked like any other.

Each ledger's text is made by one SQL query that gives a block of lines per row of a table, and is loaded once a session.
The blocks are one text in their order, which stays a table of pieces on the executors.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.ledger import Ledger
from tallyspark.sinks.layout import csv_lines, text_table
from tallyspark.sinks.printing import printed
from tallyspark.sources.pieces import load_pieces

TODAY = dt.date(2024, 2, 1)
_LOADED: dict[tuple[str, str, str], Ledger] = {}

# What stands before, the block of lines of each row (with its place in the file), what stands after.
_HEAD = {
    "orders": ['option "title" "Orders"', "pushtag #all", "1990-01-01 open Assets:Paid", "1990-01-01 open Assets:Due", "1990-01-01 open Income:Sales", ""],
    "faults": ["1980-01-01 open Assets:Only USD", "1980-01-01 open Assets:Any", "1980-01-01 open Equity:Rest", "1980-01-01 open Assets:Closed", "1985-01-01 close Assets:Closed", ""],
    "kinds": [],
    "pads": ["1990-01-01 open Equity:Open"],
    "lots": ["1990-01-01 open Equity:Cash"],
}
_ORDER = """SELECT o_orderkey AS place, concat_ws('\n',
  concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' ', CASE o_orderstatus WHEN 'F' THEN '*' WHEN 'O' THEN '!' ELSE 'P' END, ' "Cust \\\\"', o_custkey, '\\\\"" "', o_orderpriority, '" #p', substr(o_orderpriority, 1, 1),
         if(o_orderkey % 5 = 0, ' #five', ''), ' ^o', o_orderkey),
  concat('  key: ', o_orderkey),
  if(o_orderkey % 4 = 1, concat('  Assets:Due  1 EUR @ ', cast(o_totalprice AS DECIMAL(18,2)), ' USD'), concat('  Assets:Paid  (', cast(o_totalprice AS DECIMAL(18,2)), ' + 10.00 - 5 * 2) USD')),
  concat('  ', if(o_orderkey % 3 = 0, '! ', ''), 'Income:Sales'), '') AS block FROM orders"""
_FAULT = """SELECT o_orderkey AS place, concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' * "x"\n', CASE o_orderkey % 12
  WHEN 0 THEN '  Assets:Any  5.00 USD\n  Equity:Rest'
  WHEN 1 THEN '  Assets:Any  5.00 USD\n  Equity:Rest  -6.00 USD'
  WHEN 2 THEN '  Assets:Nowhere  5.00 USD\n  Equity:Rest'
  WHEN 3 THEN '  Assets:Only  5.00 EUR\n  Equity:Rest'
  WHEN 4 THEN '  kind: 1\n  kind: 2\n  Assets:Any  5.00 USD\n  Equity:Rest'
  WHEN 5 THEN '  Assets:Any\n  Equity:Rest'
  WHEN 6 THEN '  kind: ""\n  Assets:Any  5.00 USD\n  Equity:Rest'
  WHEN 7 THEN '  Assets:Closed  5.00 USD\n  Equity:Rest'
  WHEN 8 THEN '  Assets:Any  5 XX {-1.00 USD}\n  Equity:Rest'
  WHEN 9 THEN '  Assets:Any  5 EUR @ -1.00 USD\n  Equity:Rest'
  WHEN 10 THEN '  Assets:Any  -5 YY {}\n  Equity:Rest'
  ELSE '  Assets:Any  5.004 USD\n  Equity:Rest  -5.00 USD' END, '\n') AS block FROM orders"""
_KIND = """SELECT n_nationkey AS place, concat('1990-01-01 commodity N', n_nationkey, 'X\n1990-01-01 open Assets:N', n_nationkey, '\n1991-01-01 event "nation" "', n_name,
  '"\n1992-01-01 note Assets:N', n_nationkey, ' "noted"\n', if(n_nationkey % 2 = 0, concat('2000-01-01 close Assets:N', n_nationkey, '\n'), ''),
  '1993-01-01 price N', n_nationkey, 'X  ', n_nationkey + 1, '.50 USD\n1994-01-01 query "q', n_nationkey, '" "SELECT account"\n1995-01-01 custom "budget" ', n_nationkey, '\n') AS block FROM nation"""
_PAD = """SELECT n_nationkey AS place, concat('1990-01-01 open Assets:N', n_nationkey, '\n2000-01-01 pad Assets:N', n_nationkey, ' Equity:Open\n2000-02-01 balance Assets:N', n_nationkey, '  ', n_nationkey * 10, '.00 USD\n',
  '2000-02-15 * "more"\n  Assets:N', n_nationkey, '  5.00 USD\n  Equity:Open\n2000-03-01 balance Assets:N', n_nationkey, '  ', n_nationkey * 10 + 5 + if(n_nationkey % 4 = 0, 1, 0), '.00 USD\n',
  if(n_nationkey % 5 = 0, concat('2001-01-01 pad Assets:N', n_nationkey, ' Equity:Open\n'), '')) AS block FROM nation"""
_METHODS = "CASE user_id % 6 WHEN 0 THEN 'FIFO' WHEN 1 THEN 'LIFO' WHEN 2 THEN 'HIFO' WHEN 4 THEN 'NONE' ELSE 'STRICT' END"
_LOT = f"""SELECT -1 AS place, concat('1990-01-01 open Assets:U', user_id, ' "', {_METHODS}, '"') AS block FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT event_id, concat(date_format(ts, 'yyyy-MM-dd'), ' * "buy"\n  Assets:U', user_id, '  ', 1 + event_id % 7, ' ', upper(event_type), ' {{', cast(value AS DECIMAL(18,2)), ' USD}}\n  Equity:Cash') FROM events WHERE cast(value AS DECIMAL(18,2)) > 0
UNION ALL SELECT 1000000000000 + user_id, concat('2100-01-01 * "sell"\n  Assets:U', user_id, '  -', CASE user_id % 6 WHEN 3 THEN concat(total, ' ', c, ' {{}}\n  Equity:Cash') WHEN 4 THEN concat('1 ', c, ' {{7.00 USD, 2099-01-01}}\n  Equity:Cash')
    WHEN 5 THEN concat(total div 2, ' ', c, ' {{*}}') ELSE concat(total div 2, ' ', c, ' {{}}\n  Equity:Cash') END)
  FROM (SELECT user_id, upper(event_type) AS c, sum(1 + event_id % 7) AS total FROM events WHERE cast(value AS DECIMAL(18,2)) > 0 GROUP BY user_id, event_type) WHERE total > 1 AND NOT (user_id % 6 = 3 AND length(c) % 2 = 0)"""
_BLOCKS = {"orders": _ORDER, "faults": _FAULT, "kinds": _KIND, "pads": _PAD, "lots": _LOT}


def pieces_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The text as a table: section (before the blocks, blocks, after them), place, text."""
    for table in ("orders", "nation", "events"):
        if f"FROM {table}" in _BLOCKS[name]:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    blocks = spark.sql(_BLOCKS[name]).select(F.lit(1).alias("section"), F.col("place").cast("bigint").alias("place"), F.col("block").alias("text"))
    ends = [(0, i, line) for i, line in enumerate(_HEAD[name])] + [(2, 0, "poptag #all" if name == "orders" else "")]
    return blocks.unionByName(spark.createDataFrame(ends, "section int, place bigint, text string"))


def ledger(spark: SparkSession, sf_dir: str, name: str) -> Ledger:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LOADED:
        _LOADED[key] = load_pieces(spark, pieces_of(spark, sf_dir, name), ["section", "place", "text"], name)
    return _LOADED[key]


def _query(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tallyspark.queries import flat

        return flat(ledger(spark, sf_dir, name).query(text, TODAY))

    return run


def _codes(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: ledger(spark, sf_dir, name).diagnostics.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def _lines(make: Callable[[Ledger], list[str]], name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(i, x.rstrip("\r\n")) for i, x in enumerate(make(ledger(spark, sf_dir, name)))], "nth long, line string")

    return run


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir, "kinds").entries.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _held(*kinds: int) -> Callable[[SparkSession, str], DataFrame]:
    """What the accounts of users with these remainders hold, by lot."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = ledger(spark, sf_dir, "lots").postings.filter("account LIKE 'Assets:U%'").filter((F.substring("account", 9, 20).cast("long") % 6).isin(*kinds))
        cost = F.round(F.col("cost.number").cast("double"), 4).alias("cost")
        return rows.groupBy("account", "currency", cost, F.col("cost.date").alias("date")).agg(F.sum("number").cast("double").alias("units")).filter("units <> 0")

    return run


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank's CSV, written from the orders and imported."""
    import tempfile

    from tallyspark.sources.builders import from_bank_csv

    folder = (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}").rstrip("/") + "/tallyspark-bank-csv"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.concat(F.lit(" "), "o_orderpriority").alias("Payee"), F.col("o_totalprice").cast("decimal(18,2)").alias("Amount"))
    lines.write.mode("overwrite").csv(folder, header=True)
    rows = from_bank_csv(spark, folder, "Assets:Bank", "Income:Orders", "USD")
    return rows.groupBy("account", "payee").agg(F.sum("number").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.language.syntax import QueryError

    texts = ("SELECT date GROUP BY narration", "SELECT account, sum(number) GROUP BY 1 PIVOT BY account", "SELECT year(account)", "SELECT bogus", "SELECT date WHERE sum(number)", "SELECT account, sum(number) GROUP BY 9")
    out = []
    for text in texts:
        try:
            ledger(spark, sf_dir, "kinds").query(text, TODAY)
            out.append((text, "no error"))
        except QueryError as e:
            out.append((text, str(e)))
    return spark.createDataFrame(out, "query string, message string")


_O = """o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN '*' WHEN 'O' THEN '!' ELSE 'P' END AS flag, 'Cust "' || o_custkey || '"' AS payee, o_orderpriority AS narration,
  CAST(o_totalprice AS DECIMAL(18,2)) AS price, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
p AS (SELECT *, CASE WHEN k % 4 = 1 THEN 'Assets:Due' ELSE 'Assets:Paid' END AS account, CASE WHEN k % 4 = 1 THEN 1 ELSE price END AS number, CASE WHEN k % 4 = 1 THEN 'EUR' ELSE 'USD' END AS currency, '' AS pflag, 9 + 5 * i AS line FROM o
  UNION ALL SELECT *, 'Income:Sales', -price, 'USD', CASE WHEN k % 3 = 0 THEN '!' ELSE '' END, 10 + 5 * i FROM o)"""
_BOUGHT = """e AS (SELECT event_id, 'Assets:U' || user_id AS account, user_id % 6 AS m, upper(event_type) AS currency, CAST(ts AS DATE) AS date, CAST(value AS DECIMAL(18,2)) AS cost, 1 + event_id % 7 AS u FROM events WHERE CAST(value AS DECIMAL(18,2)) > 0),
l AS (SELECT account, m, currency, cost, date, sum(u) AS u, min(event_id) AS ins FROM e GROUP BY ALL),
t AS (SELECT account, m, currency, sum(u) AS total, sum(u * cost) / sum(u) AS average, min(date) AS first FROM e GROUP BY ALL)"""
_TAKEN = """, r AS (SELECT l.*, coalesce(sum(l.u) OVER (PARTITION BY l.account, l.currency ORDER BY
    CASE m WHEN 0 THEN 0 WHEN 1 THEN -(date - DATE '1970-01-01') ELSE -cost END, date, ins ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CASE WHEN total > 1 THEN CASE m WHEN 3 THEN total * (length(currency) % 2) ELSE total // 2 END ELSE 0 END AS sold
  FROM l JOIN t USING (account, m, currency))
SELECT account, currency, CAST(cost AS DOUBLE) AS cost, date, CAST(u - least(u, greatest(0, sold - before)) AS DOUBLE) AS units FROM r WHERE m IN ({}) AND u > greatest(0, sold - before)"""
_KINDS_SQL = "SELECT * FROM (SELECT unnest(['commodity', 'open', 'event', 'note', 'price', 'query', 'custom']) AS type, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT 'close', count(*) FROM nation WHERE n_nationkey % 2 = 0)"
_TABLE = "SELECT flag, count(date) AS n, sum(number) AS total WHERE account = 'Income:Sales' GROUP BY flag ORDER BY flag"

# name: (query, SQL)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "src02_ledger_text": (_query("orders", "SELECT date, flag, payee, narration, account, number, currency"), f"WITH {_O} SELECT date, flag, payee, narration, account, CAST(number AS DOUBLE) AS number, currency FROM p"),
    "src04_number_expressions": (_query("orders", "SELECT account, currency, sum(number) AS t GROUP BY account, currency"), f"WITH {_O} SELECT account, currency, CAST(sum(number) AS DOUBLE) AS t FROM p GROUP BY ALL"),
    "src05_string_escapes": (_query("orders", "SELECT DISTINCT payee"), f"WITH {_O} SELECT DISTINCT payee FROM o"),
    "src06_directive_kinds": (_kinds, _KINDS_SQL),
    "src11_pushed_tags": (_query("orders", "SELECT joinstr(tags) AS t, joinstr(links) AS l, length(tags) AS n"), f"WITH {_O} SELECT 'all,' || CASE WHEN k % 5 = 0 THEN 'five,' ELSE '' END || 'p' || substr(narration, 1, 1) AS t, 'o' || k AS l, CASE WHEN k % 5 = 0 THEN 3 ELSE 2 END AS n FROM p"),
    "src13_bank_csv": (_imported, "SELECT a AS account, o_orderpriority AS payee, CAST(s * sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders, (VALUES ('Assets:Bank', 1), ('Income:Orders', -1)) v(a, s) GROUP BY a, s, o_orderpriority"),
    "snk01_text_table": (
        _lines(lambda l: list(text_table(l.query(_TABLE, TODAY))), "orders"),
        f"""WITH {_O}, c AS (SELECT flag, CAST(count(*) AS VARCHAR) AS n, CAST(sum(number) AS VARCHAR) AS t FROM p WHERE account = 'Income:Sales' GROUP BY flag), w AS (SELECT max(length(n)) AS wn, max(length(t)) AS wt FROM c)
        SELECT 0 AS nth, 'f ' || repeat(' ', (wn - 1) // 2) || 'n' || repeat(' ', wn - 1 - (wn - 1) // 2) || ' ' || repeat(' ', (wt - 5) // 2) || 'total' || repeat(' ', wt - 5 - (wt - 5) // 2) AS line FROM w
        UNION ALL SELECT 1, '- ' || repeat('-', wn) || ' ' || repeat('-', wt) FROM w
        UNION ALL SELECT 1 + row_number() OVER (ORDER BY flag), flag || ' ' || lpad(n, CAST(wn AS INTEGER), ' ') || ' ' || lpad(t, CAST(wt AS INTEGER), ' ') FROM c, w""",
    ),
    "snk02_csv": (
        _lines(lambda l: list(csv_lines(l.query("SELECT narration, count(date) AS n WHERE account = 'Income:Sales' GROUP BY narration ORDER BY narration", TODAY))), "orders"),
        "WITH c AS (SELECT o_orderpriority AS a, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1), w AS (SELECT CAST(max(length(a)) AS INTEGER) AS wa, CAST(max(length(n)) AS INTEGER) AS wn FROM c) SELECT 0 AS nth, 'narration,n' AS line UNION ALL SELECT row_number() OVER (ORDER BY a), rpad(a, wa, ' ') || ',' || lpad(n, wn, ' ') FROM c, w"),
    "snk05_print": (
        _lines(lambda l: list(printed(l, "PRINT FROM type = 'price'")), "kinds"),
        "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS nth, '1993-01-01 price N' || n_nationkey || 'X  ' || (n_nationkey + 1) || '.50 USD' AS line FROM nation",
    ),
    "st10_error_messages": (
        _errors,
        """SELECT * FROM (VALUES ('SELECT date GROUP BY narration', 'All non-aggregates must be covered by GROUP-BY clause in aggregate query; the following targets are missing: "date".'),
        ('SELECT account, sum(number) GROUP BY 1 PIVOT BY account', 'The PIVOT BY clause is not supported yet.'), ('SELECT year(account)', 'Invalid function ''year(str)'' in targets/column context.'),
        ('SELECT bogus', 'Invalid column name ''bogus'' in targets/column context.'), ('SELECT date WHERE sum(number)', 'Aggregates are disallowed in WHERE clause.'),
        ('SELECT account, sum(number) GROUP BY 9', 'Invalid GROUP-BY column index 9')) v(query, message)""",
    ),
    "st17_print_all": (
        _lines(lambda l: sorted(x for x in printed(l, "PRINT") if " event " in x or " close " in x), "kinds"),
        """SELECT row_number() OVER (ORDER BY line) - 1 AS nth, line FROM (SELECT '1991-01-01 event "nation" "' || n_name || '"' AS line FROM nation UNION ALL SELECT '2000-01-01 close Assets:N' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)""",
    ),
    "st18_case_and_semicolon": (_query("orders", "select account, CoUnT(date) aS n gRoUp bY account oRdEr By account;"), f"WITH {_O} SELECT account, count(*) AS n FROM p GROUP BY account"),
    "o10_null_arithmetic": (_query("orders", "SELECT account, count(date) AS n WHERE number + cost_number = NULL AND NOT -cost_number GROUP BY account"), f"WITH {_O} SELECT account, count(*) AS n FROM p GROUP BY account"),
    "c06_price": (_query("orders", "SELECT date, price WHERE currency = 'EUR'"), f"WITH {_O} SELECT date, CAST(price AS DOUBLE) AS price_number, 'USD' AS price_currency FROM p WHERE currency = 'EUR'"),
    "c08_posting_flag": (_query("orders", "SELECT posting_flag, count(date) AS n GROUP BY posting_flag"), f"WITH {_O} SELECT pflag AS posting_flag, count(*) AS n FROM p GROUP BY pflag"),
    "c10_location": (_query("orders", "SELECT location"), f"WITH {_O} SELECT 'orders:' || line || ':' AS location FROM p"),
    "c12_entry_id_by_line": (_query("orders", "SELECT DISTINCT id, lineno, filename"), f"WITH {_O} SELECT md5('orders:' || (7 + 5 * i)) AS id, 7 + 5 * i AS lineno, 'orders' AS filename FROM o"),
    "f07_today": (_query("orders", "SELECT DISTINCT today() AS t, date_diff(today(), date) AS d"), f"WITH {_O} SELECT DISTINCT DATE '2024-02-01' AS t, CAST(DATE '2024-02-01' - date AS BIGINT) AS d FROM p"),
    "f16_close_date": (
        _query("faults", "SELECT DISTINCT account, open_date(account) AS d, close_date(account) AS e"),
        """SELECT account, CASE WHEN account <> 'Assets:Nowhere' THEN DATE '1980-01-01' END AS d, CASE WHEN account = 'Assets:Closed' THEN DATE '1985-01-01' END AS e
        FROM (SELECT DISTINCT CASE o_orderkey % 12 WHEN 2 THEN 'Assets:Nowhere' WHEN 3 THEN 'Assets:Only' WHEN 7 THEN 'Assets:Closed' ELSE 'Assets:Any' END AS account FROM orders UNION SELECT 'Equity:Rest' FROM orders)""",
    ),
    "v01_diagnostics": (
        _codes("faults"),
        """SELECT 'error' AS severity, code, count(*) AS n FROM (SELECT CASE o_orderkey % 12 WHEN 1 THEN 'unbalanced' WHEN 2 THEN 'not_open' WHEN 3 THEN 'currency' WHEN 4 THEN 'duplicate_metadata' WHEN 5 THEN 'incomplete'
        WHEN 6 THEN 'empty_metadata' WHEN 7 THEN 'not_open' WHEN 8 THEN 'cost' WHEN 9 THEN 'price' WHEN 10 THEN 'booking' END AS code FROM orders) WHERE code IS NOT NULL GROUP BY code""",
    ),
    "v10_interpolation": (_query("orders", "SELECT year(date) AS y, sum(number) AS t, count(date) AS n WHERE account = 'Income:Sales' GROUP BY 1"), f"WITH {_O} SELECT year(date) AS y, CAST(sum(number) AS DOUBLE) AS t, count(*) AS n FROM p WHERE account = 'Income:Sales' GROUP BY ALL"),
    "v15_strict": (_held(3), f"WITH {_BOUGHT}{_TAKEN.format(3)}"),
    "v16_lifo_hifo": (_held(0, 1, 2), f"WITH {_BOUGHT}{_TAKEN.format('0, 1, 2')}"),
    "v17_none": (_held(4), f"WITH {_BOUGHT} SELECT account, currency, CAST(cost AS DOUBLE) AS cost, date, CAST(u AS DOUBLE) AS units FROM l WHERE m = 4 UNION ALL SELECT account, currency, 7.0, DATE '2099-01-01', -1.0 FROM t WHERE m = 4 AND total > 1"),
    "v19_merge": (
        _held(5),
        f"WITH {_BOUGHT} SELECT account, currency, CAST(cost AS DOUBLE) AS cost, date, CAST(u AS DOUBLE) AS units FROM l WHERE m = 5 UNION ALL SELECT account, currency, round(CAST(average AS DOUBLE), 4), first, CAST(-(total // 2) AS DOUBLE) FROM t WHERE m = 5 AND total > 1",
    ),
    "v22_balances_and_pads": (
        _codes("pads"),
        "SELECT * FROM (SELECT 'error' AS severity, 'balance' AS code, count(*) AS n FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'warning', 'unused_pad', count(*) FROM nation WHERE n_nationkey % 5 = 0) WHERE n > 0",
    ),
    "v23_padded_postings": (
        _query("pads", "SELECT date, account, number WHERE flag = 'P' AND account ~ 'Assets'"),
        "SELECT DATE '2000-01-01' AS date, 'Assets:N' || n_nationkey AS account, CAST(n_nationkey * 10 AS DOUBLE) AS number FROM nation WHERE n_nationkey > 0",
    ),
}
