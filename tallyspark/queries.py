"""The ledger queries that the driver runs, each with the SQL that gives the same rows in DuckDB.

Most are texts of the query language over the ledger that ``sources.tpch`` makes of the order tables;
amounts, positions and inventories are flattened to plain columns, numbers to doubles.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import text_queries
from tallyspark.operators import checks, prices, tree
from tallyspark.plans.planner import Result
from tallyspark.plans.values import Kind
from tallyspark.sources import tpch

TODAY = dt.date(2024, 2, 1)

ENTRY = """entry AS (SELECT o.o_orderkey AS entry_id, CAST(o.o_orderdate AS DATE) AS date,
  CASE o.o_orderstatus WHEN 'F' THEN '*' WHEN 'O' THEN '!' ELSE 'P' END AS flag, c.c_name AS payee, o.o_orderpriority AS narration, c.c_mktsegment AS segment, n.n_regionkey AS regionkey
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
POSTING = f"""{ENTRY},
leg AS (SELECT e.entry_id, e.date, e.flag, e.payee, e.narration, concat('Expenses:', p.p_type, ':', p.p_brand) AS exp_account, concat('Assets:', e.segment) AS cash_account,
  CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice ELSE l.l_extendedprice END AS DECIMAL(18,2)) AS amount,
  CASE e.regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' ELSE 'CAD' END AS currency,
  row_number() OVER (ORDER BY e.date, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) AS leg_no
  FROM lineitem l JOIN entry e ON l.l_orderkey = e.entry_id JOIN part p ON l.l_partkey = p.p_partkey),
posting AS (SELECT entry_id, date, flag, payee, narration, exp_account AS account, cash_account AS other, amount AS number, currency, 2 * leg_no AS ord FROM leg
  UNION ALL SELECT entry_id, date, flag, payee, narration, cash_account, exp_account, -amount, currency, 2 * leg_no + 1 FROM leg)"""
PRICE = """price AS (SELECT CAST(ts AS DATE) AS date, upper(event_type) AS base, 'USD' AS quote, CAST(value AS DECIMAL(18,2)) AS rate, event_id AS ord FROM events WHERE value > 0 AND CAST(value AS DECIMAL(18,2)) <> 0),
daily AS (SELECT date, base, arg_min(rate, ord) AS rate FROM price GROUP BY date, base)"""
LOT = """lot AS (SELECT event_id AS ord, CAST(ts AS DATE) AS date, concat('Assets:User:', CAST(user_id AS VARCHAR)) AS account, upper(event_type) AS currency,
  CAST(1 + event_id % 7 AS DECIMAL(18,2)) AS units, CAST(value AS DECIMAL(18,2)) AS cost_number, props FROM events)"""
_WITH = {"posting": POSTING, "lot": f"{LOT}, {PRICE}", "both": f"{POSTING}, {LOT}, {PRICE}", "entry": ENTRY}


def flat(result: Result) -> DataFrame:
    """A result with plain columns only; an inventory gives a row per position."""
    df, out = result.df, []
    for name, kind in zip(df.columns, result.kinds, strict=True):
        if kind is Kind.INVENTORY:
            df = df.withColumn(name, F.explode(name))
    for name, kind in zip(df.columns, result.kinds, strict=True):
        c = F.col(f"`{name}`")
        if kind is Kind.DECIMAL:
            out.append(c.cast("double").alias(name))
        elif kind in (Kind.AMOUNT, Kind.POSITION, Kind.INVENTORY):
            out += [c["number"].cast("double").alias(f"{name}_number"), c["currency"].alias(f"{name}_currency")]
        elif kind is Kind.SET:
            out.append(F.array_join(c, ",").alias(name))
        elif kind is Kind.ANY:
            out.append(c["s"].alias(name))
        else:
            out.append(c.alias(name))
    return df.select(*out)


# name: (ledger, query text, SQL after the views)
TEXTS: dict[str, tuple[str, str, str | None]] = {
    "st02_select_star": ("posting", "SELECT *", "SELECT date, flag, payee, narration, CAST(number AS DOUBLE) AS position_number, currency AS position_currency FROM posting"),
    "st04_from_filter": ("posting", "SELECT account, count(date) AS n FROM year = 1996 AND flag = '!' GROUP BY account", "SELECT account, count(*) AS n FROM posting WHERE year(date) = 1996 AND flag = '!' GROUP BY account"),
    "st09_group_by": ("posting", "SELECT year(date) AS y, flag, sum(number) AS total GROUP BY 1, 2 ORDER BY 1, 2", "SELECT year(date) AS y, flag, CAST(sum(number) AS DOUBLE) AS total FROM posting GROUP BY ALL"),
    "st11_order_desc_limit": ("posting", "SELECT date, account, number ORDER BY date, number DESC LIMIT 50", "SELECT date, account, CAST(number AS DOUBLE) AS number FROM posting ORDER BY date DESC, posting.number DESC, ord LIMIT 50"),
    "st12_distinct": ("posting", "SELECT DISTINCT flag, currency", "SELECT DISTINCT flag, currency FROM posting"),
    "st13_limit_order": ("posting", "SELECT date, account, number WHERE number > 100 LIMIT 25", "SELECT date, account, CAST(number AS DOUBLE) AS number FROM posting WHERE number > 100 ORDER BY ord LIMIT 25"),
    "st15_balances": ("posting", "BALANCES FROM year = 1997", "SELECT account, CAST(sum(number) AS DOUBLE) AS sum_position_number, currency AS sum_position_currency FROM posting WHERE year(date) = 1997 GROUP BY account, currency HAVING sum(number) <> 0"),
    "st15_balances_at_cost": ("lot", "BALANCES AT cost", "SELECT account, CAST(sum(units * cost_number) AS DOUBLE) AS sum_cost_position_number, 'USD' AS sum_cost_position_currency FROM lot GROUP BY account HAVING sum(units * cost_number) <> 0"),
    "st16_journal": (
        "posting", "JOURNAL 'Assets:BUILDING' FROM year = 1995",
        """, j AS (SELECT * FROM posting WHERE account = 'Assets:BUILDING' AND year(date) = 1995),
           b AS (SELECT j.*, c.currency AS bc, sum(CASE WHEN j.currency = c.currency THEN number ELSE 0 END) OVER (PARTITION BY c.currency ORDER BY ord) AS held
                 FROM j CROSS JOIN (SELECT DISTINCT currency FROM j) c)
           SELECT date, flag, payee AS maxwidth_payee_c48, narration AS maxwidth_narration_c80, account, CAST(number AS DOUBLE) AS position_number, currency AS position_currency,
                  CAST(held AS DOUBLE) AS balance_number, bc AS balance_currency FROM b WHERE held <> 0""",
    ),
    "o01_truthiness": ("posting", "SELECT count(date) AS n WHERE number AND narration AND NOT tags", "SELECT count(*) AS n FROM posting WHERE number <> 0 AND narration <> ''"),
    "o02_null_safe_eq": ("posting", "SELECT cost_number = NULL AS no_cost, payee != NULL AS named, count(date) AS n GROUP BY 1, 2", "SELECT true AS no_cost, payee IS NOT NULL AS named, count(*) AS n FROM posting GROUP BY ALL"),
    "o03_cmp_nulls": ("posting", "SELECT count(date) AS n WHERE NOT cost_number < 1", "SELECT count(*) AS n FROM posting"),
    "o04_regex_match": ("posting", "SELECT account, count(date) AS n WHERE account ~ 'S(MALL|TAND).*1$' GROUP BY account", "SELECT account, count(*) AS n FROM posting WHERE regexp_matches(account, 'S(MALL|TAND).*1$') GROUP BY account"),
    "o05_in_set": ("posting", "SELECT currency, count(date) AS n WHERE 'Assets:BUILDING' IN other_accounts GROUP BY currency", "SELECT currency, count(*) AS n FROM posting WHERE other = 'Assets:BUILDING' GROUP BY currency"),
    "o06_arith": ("posting", "SELECT currency, sum(number * 2 + 1) AS t, sum(year(date) - 1) AS y GROUP BY currency", "SELECT currency, CAST(sum(number * 2 + 1) AS DOUBLE) AS t, CAST(sum(year(date) - 1) AS BIGINT) AS y FROM posting GROUP BY currency"),
    "o07_div_zero": ("posting", "SELECT flag, sum(number / 0) AS z, sum(safediv(number, 0)) AS s, count(number / 0) AS n GROUP BY flag", "SELECT flag, CAST(0 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS s, count(*) AS n FROM posting GROUP BY flag"),
    "o08_unary": ("posting", "SELECT currency, sum(-number) AS t, sum(+number) AS u GROUP BY currency", "SELECT currency, CAST(sum(-number) AS DOUBLE) AS t, CAST(sum(number) AS DOUBLE) AS u FROM posting GROUP BY currency"),
    "c03_running_balance": (
        "posting", "SELECT date, account, balance WHERE currency = 'JPY' AND number < 0",
        "SELECT date, account, CAST(sum(number) OVER (ORDER BY ord) AS DOUBLE) AS balance_number, 'JPY' AS balance_currency FROM posting WHERE currency = 'JPY' AND number < 0",
    ),
    "c05_cost_columns": ("lot", "SELECT account, cost_number, cost_currency, cost_date", "SELECT account, CAST(cost_number AS DOUBLE) AS cost_number, 'USD' AS cost_currency, date AS cost_date FROM lot"),
    "c07_weight": ("lot", "SELECT account, sum(weight) AS w GROUP BY account", "SELECT account, CAST(sum(units * cost_number) AS DOUBLE) AS w_number, 'USD' AS w_currency FROM lot GROUP BY account HAVING sum(units * cost_number) <> 0"),
    "c09_other_accounts": ("posting", "SELECT DISTINCT account, other_accounts", "SELECT DISTINCT account, other AS other_accounts FROM posting"),
    "c11_description": ("posting", "SELECT DISTINCT description WHERE flag = 'P'", "SELECT DISTINCT payee || ' | ' || narration AS description FROM posting WHERE flag = 'P'"),
    "c12_entry_id_md5": ("posting", "SELECT DISTINCT id, flag", "SELECT DISTINCT md5(':0') AS id, flag FROM posting"),
    "f01_abs": ("posting", "SELECT account, sum(abs(number)) AS t GROUP BY account", "SELECT account, CAST(sum(abs(number)) AS DOUBLE) AS t FROM posting GROUP BY account"),
    "f02_neg": ("posting", "SELECT account, sum(neg(position)) AS t GROUP BY account", "SELECT account, CAST(sum(-number) AS DOUBLE) AS t_number, currency AS t_currency FROM posting GROUP BY account, currency HAVING sum(number) <> 0"),
    "f03_date_parts": ("posting", "SELECT DISTINCT year(date) AS y, month(date) AS m, day(date) AS d", "SELECT DISTINCT year(date) AS y, month(date) AS m, day(date) AS d FROM posting"),
    "f04_quarter": ("posting", "SELECT DISTINCT quarter(date) AS q", "SELECT DISTINCT year(date) || '-Q' || quarter(date) AS q FROM posting"),
    "f05_weekday": ("posting", "SELECT weekday(date) AS w, count(date) AS n GROUP BY 1", "SELECT strftime(date, '%a') AS w, count(*) AS n FROM posting GROUP BY 1"),
    "f06_ymonth": ("posting", "SELECT ymonth(date) AS m, count(date) AS n GROUP BY 1", "SELECT CAST(date_trunc('month', date) AS DATE) AS m, count(*) AS n FROM posting GROUP BY 1"),
    "f08_make_date_overflow": ("posting", "SELECT DISTINCT date(year(date), month(date) + 12, 1) AS d", "SELECT DISTINCT CAST(make_date(year(date) + 1, month(date), 1) AS DATE) AS d FROM posting"),
    "f09_parse_date": ("posting", "SELECT DISTINCT date(str(date)) AS d, date(narration) AS none", "SELECT DISTINCT date AS d, CAST(NULL AS DATE) AS none FROM posting"),
    "f10_date_add": ("posting", "SELECT DISTINCT date_add(date, 40) AS d", "SELECT DISTINCT date + 40 AS d FROM posting"),
    "f11_date_diff": ("posting", "SELECT DISTINCT date_diff(date, 1995-01-01) AS d", "SELECT DISTINCT CAST(date - DATE '1995-01-01' AS BIGINT) AS d FROM posting"),
    "f12_parent": ("posting", "SELECT DISTINCT account, parent(account) AS p", "SELECT DISTINCT account, regexp_extract(account, '^(.*):', 1) AS p FROM posting"),
    "f13_leaf": ("posting", "SELECT DISTINCT leaf(account) AS l", "SELECT DISTINCT string_split(account, ':')[-1] AS l FROM posting"),
    "f14_root": ("posting", "SELECT DISTINCT root(account, 2) AS r2, root(account, 0) AS r0", "SELECT DISTINCT array_to_string(string_split(account, ':')[1:2], ':') AS r2, '' AS r0 FROM posting"),
    "f15_account_sortkey": ("posting", "SELECT DISTINCT account_sortkey(account) AS k", "SELECT DISTINCT CASE WHEN account LIKE 'Assets:%' THEN '0-' ELSE '4-' END || account AS k FROM posting"),
    "f16_open_date": ("posting", "SELECT DISTINCT account, open_date(account) AS d, close_date(account) AS e", "SELECT account, min(date) AS d, CAST(NULL AS DATE) AS e FROM posting GROUP BY account"),
    "f17_has_account": ("posting", "SELECT flag, count(date) AS n FROM has_account('HOUSEHOLD') GROUP BY flag", "SELECT flag, count(*) AS n FROM posting WHERE account LIKE '%HOUSEHOLD%' OR other LIKE '%HOUSEHOLD%' GROUP BY flag"),
    "f18_amount_fields": ("lot", "SELECT commodity(cost(position)) AS c, currency(units(position)) AS u, sum(number(cost(position))) AS t GROUP BY 1, 2", "SELECT 'USD' AS c, currency AS u, CAST(sum(units * cost_number) AS DOUBLE) AS t FROM lot GROUP BY currency"),
    "f19_units": ("lot", "SELECT account, units(sum(position)) AS u GROUP BY account", "SELECT account, CAST(sum(units) AS DOUBLE) AS u_number, currency AS u_currency FROM lot GROUP BY account, currency HAVING sum(units) <> 0"),
    "f20_cost": ("lot", "SELECT account, cost(sum(position)) AS c GROUP BY account", "SELECT account, CAST(sum(units * cost_number) AS DOUBLE) AS c_number, 'USD' AS c_currency FROM lot GROUP BY account HAVING sum(units * cost_number) <> 0"),
    "f21_only": ("posting", "SELECT account, number(only('USD', sum(position))) AS usd GROUP BY account", "SELECT account, CAST(coalesce(sum(number) FILTER (currency = 'USD'), 0) AS DOUBLE) AS usd FROM posting GROUP BY account"),
    "f22_filter_currency": ("posting", "SELECT account, sum(filter_currency(position, 'EUR')) AS eur GROUP BY account", "SELECT account, CAST(sum(number) AS DOUBLE) AS eur_number, 'EUR' AS eur_currency FROM posting WHERE currency = 'EUR' GROUP BY account HAVING sum(number) <> 0"),
    "f23_getprice": ("lot", "SELECT DISTINCT currency, getprice(currency, 'USD', 2024-01-15) AS p", ", r AS (SELECT base, arg_max(rate, date) AS rate FROM daily WHERE date <= DATE '2024-01-15' GROUP BY base) SELECT DISTINCT currency, CAST(rate AS DOUBLE) AS p FROM lot LEFT JOIN r ON base = currency"),
    "f24_convert": (
        "lot", "SELECT account, sum(convert(units(position), 'USD', date)) AS v GROUP BY account",
        ", c AS (SELECT account, units * rate AS v FROM lot ASOF JOIN daily ON lot.currency = daily.base AND lot.date >= daily.date) SELECT account, CAST(sum(v) AS DOUBLE) AS v_number, 'USD' AS v_currency FROM c GROUP BY account HAVING sum(v) <> 0",
    ),
    "f25_value": (
        "lot", "SELECT account, sum(value(position, 2024-01-20)) AS v WHERE date <= 2024-01-20 GROUP BY account",
        ", r AS (SELECT base, arg_max(rate, date) AS rate FROM daily WHERE date <= DATE '2024-01-20' GROUP BY base) SELECT account, CAST(sum(units * rate) AS DOUBLE) AS v_number, 'USD' AS v_currency FROM lot JOIN r ON base = currency WHERE date <= DATE '2024-01-20' GROUP BY account HAVING sum(units * rate) <> 0",
    ),
    "f26_possign": ("posting", "SELECT account, sum(possign(number, account)) AS t, sum(possign(number, 'Income:X')) AS u GROUP BY account", "SELECT account, CAST(sum(number) AS DOUBLE) AS t, CAST(sum(-number) AS DOUBLE) AS u FROM posting GROUP BY account"),
    "f27_safediv": ("posting", "SELECT currency, sum(safediv(number, 4)) AS q GROUP BY currency", "SELECT currency, CAST(sum(CAST(number AS DECIMAL(18,4)) * 0.25) AS DOUBLE) AS q FROM posting GROUP BY currency"),
    "f28_str": ("posting", "SELECT DISTINCT str(date) AS d, str(flag = '*') AS b, str(42) AS i", "SELECT DISTINCT CAST(date AS VARCHAR) AS d, CASE WHEN flag = '*' THEN 'True' ELSE 'False' END AS b, '42' AS i FROM posting"),
    "f29_length_bytes": ("posting", "SELECT DISTINCT account, length(account) AS n, length(other_accounts) AS m", "SELECT DISTINCT account, CAST(strlen(account) AS BIGINT) AS n, CAST(1 AS BIGINT) AS m FROM posting"),
    "f30_maxwidth": (
        "posting", "SELECT DISTINCT narration, maxwidth(narration, 12) AS s",
        """, n AS (SELECT DISTINCT narration, string_split(narration, ' ') AS w FROM posting)
           SELECT narration, CASE WHEN length(narration) <= 12 THEN narration
             ELSE coalesce(list_max(list_filter(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[1:i], ' ') || ' [...]'), lambda x: length(x) <= 12)), '[...]') END AS s FROM n""",
    ),
    "f31_case": ("posting", "SELECT DISTINCT upper(account) AS u, lower(account) AS l", "SELECT DISTINCT upper(account) AS u, lower(account) AS l FROM posting"),
    "f32_grep": ("posting", "SELECT DISTINCT account, grep('[A-Z]+$', account) AS g", "SELECT DISTINCT account, nullif(regexp_extract(account, '[A-Z]+$'), '') AS g FROM posting"),
    "f33_grepn": ("posting", "SELECT DISTINCT account, grepn('(\\w+):(\\w+)', account, 2) AS g", "SELECT DISTINCT account, regexp_extract(account, '(\\w+):(\\w+)', 2) AS g FROM posting"),
    "f34_subst": ("posting", "SELECT DISTINCT subst('^(\\w+):', '${1}/', account) AS s", "SELECT DISTINCT regexp_replace(account, '^(\\w+):', '\\1/') AS s FROM posting"),
    "f35_findfirst": ("posting", "SELECT DISTINCT account, findfirst('^Assets', other_accounts) AS f", "SELECT DISTINCT account, CASE WHEN other LIKE 'Assets%' THEN other END AS f FROM posting"),
    "f36_joinstr": ("posting", "SELECT DISTINCT joinstr(other_accounts) AS j", "SELECT DISTINCT other AS j FROM posting"),
    "f37_coalesce": ("posting", "SELECT DISTINCT coalesce(cost_currency, currency) AS c", "SELECT DISTINCT currency AS c FROM posting"),
    "f38_meta": ("lot", "SELECT account, any_meta('k') AS k, meta('none') AS none, entry_meta('k') AS e", "SELECT account, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS none, CAST(NULL AS VARCHAR) AS e FROM lot"),
    "a01_count": ("posting", "SELECT flag, count(cost_number) AS n GROUP BY flag", "SELECT flag, count(*) AS n FROM posting GROUP BY flag"),
    "a02_first_last": ("posting", "SELECT account, first(date) AS f, last(number) AS l GROUP BY account", "SELECT account, arg_min(date, ord) AS f, CAST(arg_max(number, ord) AS DOUBLE) AS l FROM posting GROUP BY account"),
    "a03_min_max": ("posting", "SELECT currency, min(number) AS lo, max(number) AS hi, min(narration) AS a, max(date) AS d GROUP BY currency", "SELECT currency, CAST(min(number) AS DOUBLE) AS lo, CAST(max(number) AS DOUBLE) AS hi, min(narration) AS a, max(date) AS d FROM posting GROUP BY currency"),
    "a04_sum_int": ("posting", "SELECT flag, sum(day(date)) AS s GROUP BY flag", "SELECT flag, CAST(sum(day(date)) AS BIGINT) AS s FROM posting GROUP BY flag"),
    "a05_sum_number": ("posting", "SELECT currency, sum(number) AS total WHERE number > 0 GROUP BY currency", "SELECT currency, CAST(sum(number) AS DOUBLE) AS total FROM posting WHERE number > 0 GROUP BY currency"),
    "a06_sum_position": ("posting", "SELECT account, sum(position) GROUP BY account ORDER BY account", "SELECT account, CAST(sum(number) AS DOUBLE) AS sum_position_number, currency AS sum_position_currency FROM posting GROUP BY account, currency HAVING sum(number) <> 0"),
    "a06_sum_position_by_lot": ("lot", "SELECT account, sum(position) AS p, count(date) AS n GROUP BY account", "SELECT account, CAST(sum(units) AS DOUBLE) AS p_number, currency AS p_currency, any_value(n) AS n FROM lot JOIN (SELECT account, count(*) AS n FROM lot GROUP BY account) USING (account) GROUP BY account, currency, cost_number, date HAVING sum(units) <> 0"),
    "a07_two_inventories": ("lot", "SELECT account, number(only('USD', sum(weight))) AS w, sum(number) AS u GROUP BY account", "SELECT account, CAST(sum(units * cost_number) AS DOUBLE) AS w, CAST(sum(units) AS DOUBLE) AS u FROM lot GROUP BY account"),
    "a08_implicit_group": ("posting", "SELECT flag, currency, count(date) AS n", "SELECT flag, currency, count(*) AS n FROM posting GROUP BY ALL"),
    "a09_nested_in_scalar": ("posting", "SELECT currency, abs(sum(number)) + 1 AS t GROUP BY currency", "SELECT currency, CAST(abs(sum(number)) + 1 AS DOUBLE) AS t FROM posting GROUP BY currency"),
    "t01_empty_global_agg": ("posting", "SELECT count(date) AS n, sum(number) AS t WHERE account = 'nowhere'", "SELECT n, t FROM (SELECT account, count(*) AS n, CAST(sum(number) AS DOUBLE) AS t FROM posting WHERE account = 'nowhere' GROUP BY account)"),
    "x05_close_on": ("posting", "SELECT account, sum(position) AS p FROM CLOSE ON 1998-01-01 GROUP BY account", "SELECT account, CAST(sum(number) AS DOUBLE) AS p_number, currency AS p_currency FROM posting WHERE date < DATE '1998-01-01' GROUP BY account, currency HAVING sum(number) <> 0"),
    "x04_open_on": (
        "posting", "SELECT date, flag, narration, account, position FROM OPEN ON 1999-01-01 WHERE flag = 'S'",
        """, e AS (SELECT CASE WHEN account LIKE 'Expenses:%' THEN 'Equity:Earnings:Previous' ELSE account END AS a, currency, sum(number) AS n FROM posting WHERE date < DATE '1999-01-01' GROUP BY ALL HAVING sum(number) <> 0),
           l AS (SELECT a AS src, a AS account, n, currency FROM e UNION ALL SELECT a, 'Equity:Opening-Balances', -n, currency FROM e)
           SELECT DATE '1998-12-31' AS date, 'S' AS flag, 'Opening balance for ''' || src || ''' (Summarization)' AS narration, account, CAST(n AS DOUBLE) AS position_number, currency AS position_currency FROM l""",
    ),
    "x06_clear": (
        "posting", "SELECT account, sum(position) AS p FROM CLEAR GROUP BY account",
        """, c AS (SELECT CASE WHEN account LIKE 'Expenses:%' THEN 'Equity:Earnings:Current' ELSE account END AS account, currency, number FROM posting)
           SELECT account, CAST(sum(number) AS DOUBLE) AS p_number, currency AS p_currency FROM c GROUP BY account, currency HAVING sum(number) <> 0""",
    ),
    "x01_open_close_clear": (
        "posting", "SELECT account, sum(position) AS p FROM OPEN ON 1996-01-01 CLOSE ON 1999-01-01 CLEAR GROUP BY account",
        """, c AS (SELECT CASE WHEN account NOT LIKE 'Expenses:%' THEN account WHEN date < DATE '1996-01-01' THEN 'Equity:Earnings:Previous' ELSE 'Equity:Earnings:Current' END AS account, currency, number FROM posting WHERE date < DATE '1999-01-01'),
           o AS (SELECT currency, -sum(number) AS number FROM posting WHERE date < DATE '1996-01-01' GROUP BY currency)
           SELECT account, CAST(sum(number) AS DOUBLE) AS p_number, currency AS p_currency FROM (SELECT * FROM c UNION ALL SELECT 'Equity:Opening-Balances', currency, number FROM o) GROUP BY account, currency HAVING sum(number) <> 0""",
    ),
}


def _text_query(ledger: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = tpch.lot_ledger(spark, sf_dir) if ledger == "lot" else tpch.ledger(spark, sf_dir)
        return flat(made.query(text, TODAY))

    return run


def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpch.ledger(spark, sf_dir).postings


def p02_inverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.edges(tpch.prices(spark, sf_dir)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"))


def p03_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = tpch.ledger(spark, sf_dir).price_book
    dates = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 3 DAYS)) AS date")
    return book.direct_by_date(dates).filter("target = 'USD'").select("date", "source", F.col("rate").cast("double").alias("rate"))


def p04_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates between commodities that are quoted in a third currency only."""
    book = tpch.ledger(spark, sf_dir).price_book
    rates = book.by_date(spark.sql("SELECT DATE '2024-01-15' AS date"))
    pairs = rates.select(F.explode("rates").alias("target", "by")).select("target", F.explode("by").alias("source", "rate"))
    return pairs.filter("target <> 'USD' AND source <> 'USD'").select("source", "target", F.round(F.col("rate").cast("double"), 2).alias("rate"))


def x07_lot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.operators.lots import inherited_dates

    rows = tpch.lot_ledger(spark, sf_dir).postings
    sold = rows.withColumn("number", F.when(F.col("ord") % 5 == 0, -F.col("number")).otherwise(F.col("number"))).withColumn("cost", F.col("cost").withField("number", F.lit(10).cast("decimal(28,10)")))
    sold = sold.withColumn("cost", F.when(F.col("ord") % 5 == 0, F.col("cost").withField("date", F.lit(None).cast("date"))).otherwise(F.col("cost")))
    return inherited_dates(sold).select("ord", "account", "currency", F.col("number").cast("double").alias("number"), F.col("cost.date").alias("cost_date"))


def v03_account_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completed(spark, sf_dir)
    spans = rows.groupBy("account").agg(F.date_add(F.min("date"), 400).alias("open"), F.lit(dt.date(2000, 1, 1)).alias("close"))
    return checks.outside_lifetime(rows, spans).groupBy("account").agg(F.count(F.lit(1)).alias("n"))


def v08_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.weights(tpch.lot_ledger(spark, sf_dir).postings).select("entry_id", "currency", F.col("weight").cast("double").alias("weight"))


def v11_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.tolerances(_completed(spark, sf_dir)).select("entry_id", "currency", F.col("tolerance").cast("double").alias("tolerance"))


def v12_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completed(spark, sf_dir).filter("NOT (account LIKE 'Assets:%' AND entry_id % 50 = 0)")
    return checks.unbalanced(rows).select("entry_id", "currency", F.col("weight").cast("double").alias("weight"))


def v16_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each user's holdings of a commodity sold at the end, oldest lots first."""
    lots = tpch.lot_ledger(spark, sf_dir).postings.select(F.concat_ws("/", "account", "currency").alias("key"), "ord", F.col("number").alias("units"), F.col("cost.number").alias("cost"))
    sales = lots.groupBy("key").agg(F.floor(F.sum("units") / 2).cast("decimal(28,10)").alias("units"), F.max("ord").alias("ord")).filter("units > 0")
    taken = checks.held_by_rule(lots, sales)
    return taken.select("key", "lot", F.col("units").cast("double").alias("units"), F.col("cost").cast("double").alias("cost"))


def _assertions(rows: DataFrame) -> DataFrame:
    dates = F.array(*[F.lit(dt.date(y, 1, 1)) for y in (1996, 1998, 2000)])
    return rows.filter("account LIKE 'Assets:%'").select("account", "currency").distinct().withColumn("date", F.explode(dates)).withColumn("number", F.lit(0))


def v22_balance_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completed(spark, sf_dir)
    return checks.asserted(rows, _assertions(rows)).select("account", "currency", "date", F.col("held").cast("double").alias("held"))


def v23_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _completed(spark, sf_dir)
    pads = rows.filter("account LIKE 'Assets:%'").select("account").distinct().select("account", F.lit("Equity:Opening").alias("source"), F.lit(dt.date(1997, 6, 1)).alias("date"))
    return checks.padded(rows, pads, _assertions(rows)).select("date", "account", "source", "currency", F.col("number").cast("double").alias("number"))


def v26_period_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.balances(_completed(spark, sf_dir), dt.date(1996, 3, 1), dt.date(1997, 2, 28))
    return found.select("account", "currency", F.col("number").cast("double").alias("number"))


def v27_balance_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.tree(_completed(spark, sf_dir))
    return nodes.select("name", "account", F.col("depth").cast("bigint").alias("depth"), "currency", F.col("number").cast("double").alias("number"))


_TREE = "SELECT string_split(node, ':')[-1] AS name, node AS account, CAST(len(string_split(node, ':')) AS BIGINT) AS depth, currency, CAST(sum(number) AS DOUBLE) AS number FROM (SELECT array_to_string(string_split(account, ':')[1:i], ':') AS node, currency, number FROM posting, range(1, 10) r(i) WHERE i <= len(string_split(account, ':'))) GROUP BY node, currency"
_ASSERT = "a AS (SELECT DISTINCT account, currency, d AS date FROM posting, (VALUES (DATE '1996-01-01'), (DATE '1998-01-01'), (DATE '2000-01-01')) v(d) WHERE account LIKE 'Assets:%'), h AS (SELECT a.account, a.currency, a.date, coalesce(sum(p.number), 0) AS held FROM a LEFT JOIN posting p ON p.account = a.account AND p.currency = a.currency AND p.date < a.date GROUP BY ALL)"
FUNCTIONS: dict[str, tuple[Callable, str | None]] = {
    "p02_inverse_edges": (p02_inverse_edges, f"WITH {PRICE} SELECT base AS source, quote AS target, count(*) AS n, min(date) AS first FROM price GROUP BY ALL UNION ALL SELECT quote, base, count(*), min(date) FROM price GROUP BY ALL"),
    "p03_forward_fill": (p03_forward_fill, f"WITH {PRICE}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 3 DAYS)) AS DATE) AS date), g AS (SELECT d.date, base FROM d CROSS JOIN (SELECT DISTINCT base FROM daily)) SELECT g.date, g.base AS source, CAST(daily.rate AS DOUBLE) AS rate FROM g ASOF JOIN daily ON g.base = daily.base AND g.date >= daily.date"),
    "p04_two_hop": (
        p04_two_hop,
        f"""WITH {PRICE}, r AS (SELECT base, arg_max(rate, date) AS rate FROM daily WHERE date <= DATE '2024-01-15' GROUP BY base)
        SELECT s.base AS source, t.base AS target, round(CAST(s.rate AS DOUBLE) * round(1 / CAST(t.rate AS DOUBLE), 10), 2) AS rate FROM r s JOIN r t ON s.base <> t.base""",
    ),
    "x07_lot_dates": (
        x07_lot_dates,
        f"""WITH RECURSIVE {LOT}, r AS (SELECT ord, date, account, currency, CASE WHEN ord % 5 = 0 THEN -units ELSE units END AS n,
  CASE WHEN ord % 5 <> 0 THEN date END AS cost_date, row_number() OVER (PARTITION BY account, currency ORDER BY ord) AS k FROM lot),
s AS (SELECT k, ord, account, currency, n, coalesce(cost_date, date) AS found, [{{'d': coalesce(cost_date, date), 'u': n}}] AS lots FROM r WHERE k = 1
  UNION ALL SELECT k, ord, account, currency, n, found,
    list_append(list_filter(lots, lambda x: x.d <> found), {{'d': found, 'u': CAST(n + coalesce(list_sum(list_transform(list_filter(lots, lambda x: x.d = found), lambda x: x.u)), 0) AS DECIMAL(18,2))}})
  FROM (SELECT r.k, r.ord, r.account, r.currency, r.n, s.lots,
      coalesce(r.cost_date, list_min(list_transform(list_filter(s.lots, lambda x: x.u <> 0 AND (x.u > 0) <> (r.n > 0)), lambda x: x.d)), r.date) AS found
    FROM s JOIN r ON r.account = s.account AND r.currency = s.currency AND r.k = s.k + 1) AS step)
SELECT ord, account, currency, CAST(n AS DOUBLE) AS number, found AS cost_date FROM s""",
    ),
    "v03_account_lifecycle": (v03_account_lifecycle, f"WITH {POSTING}, s AS (SELECT account, min(date) + 400 AS o FROM posting GROUP BY account) SELECT account, count(*) AS n FROM posting JOIN s USING (account) WHERE date < o OR date > DATE '2000-01-01' GROUP BY account"),
    "v08_weights": (v08_weights, f"WITH {LOT} SELECT ord AS entry_id, 'USD' AS currency, CAST(units * cost_number AS DOUBLE) AS weight FROM lot"),
    "v11_tolerance": (v11_tolerance, f"WITH {POSTING} SELECT DISTINCT entry_id, currency, CAST(0.005 AS DOUBLE) AS tolerance FROM posting"),
    "v12_balanced": (v12_balanced, f"WITH {POSTING} SELECT entry_id, currency, CAST(sum(number) AS DOUBLE) AS weight FROM posting WHERE NOT (account LIKE 'Assets:%' AND entry_id % 50 = 0) GROUP BY ALL HAVING abs(sum(number)) > 0.005"),
    "v16_fifo": (
        v16_fifo,
        f"""WITH {LOT}, r AS (SELECT account || '/' || currency AS key, ord, units, cost_number, sum(units) OVER (PARTITION BY account, currency ORDER BY ord) AS upto, floor(sum(units) OVER (PARTITION BY account, currency) / 2) AS sold FROM lot)
        SELECT key, ord AS lot, CAST(least(upto, sold) - (upto - units) AS DOUBLE) AS units, CAST(cost_number AS DOUBLE) AS cost FROM r WHERE upto - units < sold AND units > 0""",
    ),
    "v22_balance_assertion": (v22_balance_assertion, f"WITH {POSTING}, {_ASSERT} SELECT account, currency, date, CAST(held AS DOUBLE) AS held FROM h"),
    "v23_pad": (v23_pad, f"WITH {POSTING}, {_ASSERT} SELECT DATE '1997-06-01' AS date, account, 'Equity:Opening' AS source, currency, CAST(-held AS DOUBLE) AS number FROM h WHERE date = DATE '1998-01-01' AND held <> 0"),
    "v26_period_balance": (v26_period_balance, f"WITH {POSTING} SELECT account, currency, CAST(sum(number) AS DOUBLE) AS number FROM posting WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28' GROUP BY ALL"),
    "v27_balance_tree": (v27_balance_tree, f"WITH {POSTING} {_TREE}"),
}

_WRITTEN = {name: f for name, (f, _) in text_queries.QUERIES.items()}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = _WRITTEN | {name: _text_query(kind, text) for name, (kind, text, _) in TEXTS.items()} | {name: f for name, (f, _) in FUNCTIONS.items()}


def _sql(kind: str, rest: str) -> str:
    return f"WITH {_WITH[kind]}{rest if rest.startswith(',') else ' ' + rest}"


ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in text_queries.QUERIES.items()} | {name: _sql(kind, sql.strip()) for name, (kind, _, sql) in TEXTS.items() if sql} | {name: sql for name, (_, sql) in FUNCTIONS.items() if sql}
