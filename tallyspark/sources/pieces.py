"""A ledger of one text that is given as a table of pieces in order, parsed and booked side by side.

Each piece is a whole number of directives. What one depends on in others is found first: the line at which it
starts and the tags and metadata pushed there, and what is opened, closed and declared, whose directives meet on the
driver (a few per account or commodity). With these any transaction is checked and balanced on its own, unless
it reduces lots: such transactions meet by account, with what the account's lots gained, and are booked in ledger order;
accounts that one of them joins are booked together. Numbers of entries follow from counts by day and task. A ledger
with balance assertions or pads is parsed side by side, but booked as a file is: in one task.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyspark.ledger import Ledger
from tallyspark.operators.booking import Holdings, LotCost
from tallyspark.operators.processing import PRIORITY, Diagnostic
from tallyspark.operators.processing import Ledger as Process
from tallyspark.plans.rows import ENTRY, POSTING
from tallyspark.sources import ledger_text as T
from tallyspark.sources.config import config_of
from tallyspark.sources.plain import Columns, Plain, gain, gained
from tallyspark.sources.runs import Run, Runs, batch, gained_of, gains_of, text_of
from tallyspark.sources.loader import FORM, Unread, _number, as_ledger, read_file, rows_of, rows_of_directive

STATE = ("open", "close", "commodity")
_MET_WORDS = (*STATE, "balance", "pad", "option", "include", "plugin")
_MET = re.compile(r"(?:^|[\r\n])\d{4}[-/]\d{2}[-/]\d{2}[ \t]+(?:open|close|commodity|balance|pad)\b|(?:^|[\r\n])(?:option|include|plugin)\b")
_PUSHED = re.compile(r"(?:^|[\r\n])(?:push|pop)(?:tag|meta)\b")
_CHUNK = 1 << 19  # characters parsed at once
_ROWS, _LEAST = 10_000, 4000  # rows of a batch, at most, and of one of plain transactions, at least
_FEW = 50_000  # transactions that reduce lots
_KEY = ("pid", "priority", "rank")
_PICKLED = b"\x80"  # with which pickles begin, and no currency does
_PLACES = 24  # bits of a posting's place in its entry
_OWN = {c: t for c, t in POSTING.items() if c not in ENTRY and c != "ord"}
_MORE = {"pid": "int", "priority": "int", "rank": "bigint", "payload": "binary", "marks": "string", "postings": f"array<struct<{','.join(f'{c}:{t}' for c, t in _OWN.items())}>>"}
_LEFT = ("ledger", "ord", "entry_id", *[c for c in _OWN if c not in ("account", "number", "currency")], "open", "close", "currencies", "booking")
_SCHEMA = ", ".join(f"`{c}` {t}" for c, t in (FORM | _MORE).items() if c not in _LEFT)


def _chunk(pid: int, nth: int, texts: list[str]) -> dict:
    text = "\n".join(texts) + "\n"
    pushes = T.pushes(text) if ("push" in text or "pop" in text) and _PUSHED.search(text) else []  # words first: most texts hold none
    met = any(word in text for word in _MET_WORDS) and bool(_MET.search(text))
    return {"pid": pid, "nth": nth, "text": text, "lines": T.line_breaks(text), "pushes": pickle.dumps(pushes) if pushes else None, "met": met}


_CHUNK_FORM = "pid int, nth int, text string, lines bigint, pushes binary, met boolean"


def _arrow(form: str):
    """The Arrow schema of a form; on the driver only."""
    return to_arrow_schema(StructType.fromDDL(form))


def _chunks(schema):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, nth, texts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts.append(text or "")
                size += len(texts[-1])
                if size >= _CHUNK:
                    yield pa.RecordBatch.from_pylist([_chunk(pid, nth, texts)], schema)
                    nth, texts, size = nth + 1, [], 0
        if texts:
            yield pa.RecordBatch.from_pylist([_chunk(pid, nth, texts)], schema)

    return run


def _starts(heads: list) -> dict[tuple[int, int], tuple]:
    """By chunk: the line where it starts, the tags and the metadata pushed there."""
    out, line, tags, metas = {}, 1, [], []
    for h in sorted(heads, key=lambda h: (h.pid, h.nth)):
        out[h.pid, h.nth] = (line, tuple(tags), tuple(metas))
        line += h.lines
        for word, value in pickle.loads(h.pushes) if h.pushes else ():
            if word == "pushtag":
                tags.append(value)
            elif word == "pushmeta":
                metas.append(value)
            elif word == "poptag" and value in tags:
                tags.remove(value)
            elif word == "popmeta" and (at := [i for i, (k, _) in enumerate(metas) if k == value]):
                del metas[at[-1]]
    return out


def _parsed(name: str, starts, batches, plain: Plain | None = None):
    """(pid, nth, File or Unread) of each chunk."""
    for batch in batches:
        for pid, nth, text in zip(*[batch.column(c).to_pylist() for c in ("pid", "nth", "text")], strict=True):
            yield pid, nth, read_file(name, text, *starts.value[pid, nth], plain)


_MET_FORM = "pid int, nth int, file binary"


def _meet(name: str, starts):
    """What all of a ledger depends on, of chunks that may hold some."""
    schema = _arrow(_MET_FORM)

    def run(batches):
        import pyarrow as pa

        for pid, nth, f in _parsed(name, starts, batches):
            if isinstance(f, T.File):
                kept = [d for d in f.directives if d.kind in (*STATE, "balance", "pad")]
                yield pa.RecordBatch.from_pylist([{"pid": pid, "nth": nth, "file": pickle.dumps((kept, f.options))}], schema)

    return run


class _Apart(Holdings):
    """Holdings that keep nothing but what is gained at cost in one transaction."""

    def __init__(self):
        super().__init__()
        self.gained: list[tuple] = []

    def begin(self) -> None:
        self.gained = []

    def end(self, keep: bool) -> None:
        if not keep:
            self.gained = []

    def add(self, currency, units, cost) -> None:
        if cost is not None:
            self.gained.append((currency, units, cost))


def reducing(accounts: dict, d: T.Directive) -> list[str]:
    """The accounts whose lots a transaction depends on; none, if it reduces nothing."""
    at_cost = [p for p in d.postings if p.cost is not None and p.account in accounts and accounts[p.account].booking != "NONE"]
    if any(p.units is not None and p.units.number is not None and p.units.number < 0 for p in at_cost):
        return sorted({p.account for p in at_cost})
    return []


def needed(d: T.Directive, accounts: dict) -> list[str] | None:
    """Of a transaction that reduces lots: the lots ("account currency") without which it fails; None, if that can't be told."""
    at_cost = [p for p in d.postings if p.cost is not None and p.account in accounts and accounts[p.account].booking != "NONE"]
    if any(p.units is None or p.units.number is None or p.units.currency is None for p in at_cost):
        return None
    return [f"{p.account} {p.units.currency}" for p in at_cost if p.units.number < 0]


def held_by(d: T.Directive) -> list[str]:
    """The lots ("account currency", "account" if the currency is not stated) that a transaction may add to."""
    out = set()
    for p in d.postings:
        if p.cost is not None and not (p.units and p.units.number is not None and p.units.number < 0):
            out.add(f"{p.account} {p.units.currency}" if p.units and p.units.currency else p.account)
    return sorted(out)


class _Rows:
    """Rows on their way out, a column at a time."""

    def __init__(self, schema):
        self.schema, self.rows = schema, []

    def directive(self, d: T.Directive, valid: bool, key: dict) -> None:
        entry, more, postings = rows_of_directive(d, valid)
        if len(postings) >> _PLACES:
            raise ValueError(f"an entry of more than {1 << _PLACES} postings")
        self.rows.append({"part": "entry", **key, **entry, **more, "postings": postings})

    def found(self, process: Process, key: dict) -> None:
        """Diagnostics and prices of the directive just processed."""
        for x in process.diagnostics:
            self.rows.append(_diagnostic(x))
        for date, base, quote, rate in process.prices:
            self.rows.append({**key, "part": "price", "date": date, "base": base, "quote": quote, "rate": _number(rate)})
        process.diagnostics.clear()
        process.prices.clear()

    def batches(self, least: int = 1):
        import pyarrow as pa

        while len(self.rows) >= least:
            some, self.rows = self.rows[:_ROWS], self.rows[_ROWS:]
            used = set().union(*some)
            columns = [pa.array([r.get(f.name) for r in some], f.type) if f.name in used else pa.nulls(len(some), f.type) for f in self.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _diagnostic(x: Diagnostic) -> dict:
    return {"part": "diagnostic", "severity": x.severity, "code": x.code, "message": x.message, "filename": x.filename, "lineno": x.line, "date": x.date, "account": x.account}


def _each(name: str, starts, known):
    """Chunks to rows. A transaction that reduces lots is a row of its own, ``reducing``; so is what others gain, ``gained``."""
    schema = _arrow(_SCHEMA)

    def run(batches):
        config, files, accounts, invalid = known.value
        process, out, counts, last = Process(config, files), _Rows(schema), Counter(), None
        added, undated = set(), False
        process.accounts = accounts = {n: type(a)(a.opened, a.closed, a.currencies, a.booking, _Apart()) for n, a in accounts.items()}
        plain, quick = Runs(config, accounts, name), Columns(schema, name)
        for pid, _, f in _parsed(name, starts, batches, plain):
            last = pid
            if isinstance(f, Unread):
                out.rows.append({"part": "error", "message": f.message, "lineno": f.line})
                continue
            tables = []
            for d in f.directives:
                if type(d) is Run:
                    if not tables or tables[-1] is not d.table:
                        tables.append(d.table)
                    d.table.take(d, counts)
                    continue
                if type(d) is tuple:
                    date = d[0][0]
                    rank = counts[date, 0]
                    counts[date, 0] += 1
                    quick.add(d, (pid, 0, rank))
                    continue
                priority = PRIORITY.get(d.kind, 0)
                rank = counts[d.date, priority]
                counts[d.date, priority] += 1
                key = {"pid": pid, "priority": priority, "rank": rank}
                if d.kind == "transaction" and (touched := reducing(accounts, d)):
                    out.rows.append({**key, "part": "reducing", "date": d.date, "lineno": d.line, "accounts": touched, "payload": pickle.dumps(d), "tags": needed(d, accounts), "links": held_by(d)})
                    continue
                valid = d.line not in invalid if d.kind in STATE else process.take(d)
                out.found(process, key)
                out.directive(d, valid, key)
                undated = undated or any(p["cost"] is not None and p["cost"]["date"] is None for p in out.rows[-1]["postings"])
                if valid and any(p.cost is not None for p in d.postings):
                    for account in {p.account for p in d.postings if p.cost is not None}:
                        a = accounts[account]
                        if a.booking != "NONE" and a.holdings.gained:
                            gains = [gain(currency, units, c.number, c.currency, c.date, c.label) for currency, units, c in a.holdings.gained]
                            out.rows.append({"part": "gained", "date": d.date, "lineno": d.line, "account": account, "payload": pickle.dumps(gains), "links": sorted({f"{account} {g[0]}" for g in gains})})
                if len(out.rows) >= _ROWS:
                    yield from out.batches(_ROWS)
            for table in tables:
                added.update(table.lots())
                yield batch(table, schema, name, pid)
            if len(added) >= _ROWS:
                out.rows.append({"part": "adds", "links": sorted(added)})
                added.clear()
            yield from quick.batches(_LEAST)
        yield from quick.batches()
        if added:
            out.rows.append({"part": "adds", "links": sorted(added)})
        if undated:
            out.rows.append({"part": "undated"})
        for (date, priority), n in counts.items():
            out.rows.append({"part": "count", "date": date, "priority": priority, "pid": last, "rank": n})
        yield from out.batches()

    return run


def _in_order(known):
    """Transactions that reduce lots, and what their accounts gain from others, by group and in ledger order."""
    schema = _arrow(_SCHEMA)

    def run(batches):
        config, files, accounts, _ = known.value
        process, out, group, touched = Process(config, files), _Rows(schema), None, set()
        process.accounts = {n: type(a)(a.opened, a.closed, a.currencies, a.booking) for n, a in accounts.items()}
        for some in batches:
            for part, grp, account, payload, *key in zip(*[some.column(c).to_pylist() for c in ("part", "grp", "account", "payload", *_KEY)], strict=True):
                if grp != group:
                    for n in touched:
                        process.accounts[n].holdings = Holdings()
                    group, touched = grp, set()
                if part == "gained":
                    touched.add(account)
                    add = process.accounts[account].holdings.add
                    for currency, units, cost in [gained_of(payload)] if payload[:1] != _PICKLED else ((c, n, LotCost(*more)) for c, n, *more in gained(payload)):
                        add(currency, units, cost)
                    continue
                d, key = pickle.loads(payload), dict(zip(_KEY, key, strict=True))
                touched.update(p.account for p in d.postings if p.account in process.accounts)
                valid = process.take(d)
                out.found(process, key)
                out.directive(d, valid, key)
                if len(out.rows) >= _ROWS:
                    yield from out.batches(_ROWS)
        yield from out.batches()

    return run


def _groups(links: list[list[str]]) -> list[tuple[str, str]]:
    """(account, group) of accounts that are booked together."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for first, *rest in links:
        for x in rest:
            a, b = sorted((root(first), root(x)))
            parent[b] = a
    return [(x, root(x)) for x in list(parent)]


def _in_vain(spark: SparkSession, reducers: DataFrame, added: DataFrame) -> DataFrame:
    """The reducers with a column ``vain``: whether nothing in the ledger adds to any of the lots that one reduces.

    It then fails and changes nothing, and needs not be booked in order with others of its account."""
    wanted = reducers.select("lineno", F.explode("tags").alias("lots"))
    added = reducers.select("links").unionByName(added.select("links")).select(F.explode("links").alias("lots")).distinct().persist()
    whole = F.substring_index("lots", " ", 1)  # what adds to an account in a currency not stated may add to any of its lots
    lots = wanted.select("lots").distinct().join(added, "lots", "left_anti")
    lacking = lots.join(added.withColumnRenamed("lots", "account"), whole == F.col("account"), "left_anti").withColumn("lacking", F.lit(True))
    lines = wanted.join(lacking, "lots", "left").groupBy("lineno").agg(F.bool_and(F.coalesce("lacking", F.lit(False))).alias("vain"))
    lines = lines.filter("vain").persist()
    return reducers.join(lines, "lineno", "left").withColumn("vain", F.coalesce("vain", F.lit(False)))


def _reduced(spark: SparkSession, rows: DataFrame, known, few: bool) -> DataFrame:
    """``few``: whether the transactions that reduce lots are few enough for one task, should they all meet, and their accounts for the driver."""
    columns = ["part", "date", "lineno", "account", *_KEY, "payload"]
    reducers = rows.filter("part = 'reducing'")
    gains = rows.filter("part = 'gained'").select("part", "date", "lineno", "account", "payload").unionByName(gains_of(rows))
    parts = 4 * spark.sparkContext.defaultParallelism
    if few:
        met = [r.accounts for r in reducers.select("accounts").distinct().collect()]
        together = dict(_groups([x for x in met if len(x) > 1]))
        groups = spark.createDataFrame([(x, together.get(x, x)) for x in sorted(set().union(*met))], "account string, grp string")
        moves = reducers.withColumn("account", F.col("accounts")[0]).select(columns).unionByName(gains, allowMissingColumns=True).join(F.broadcast(groups), "account")
    else:
        every = _in_vain(spark, reducers, rows.filter("part IN ('gained', 'adds')"))
        alone = every.filter("vain").withColumn("account", F.lit(None).cast("string")).select(columns)
        reducers = every.filter("NOT vain")
        touched = reducers.select(F.explode("accounts").alias("account")).distinct()
        moves = reducers.withColumn("account", F.col("accounts")[0]).select(columns).unionByName(gains.join(touched, "account", "left_semi"), allowMissingColumns=True)
        links = [r.accounts for r in reducers.filter("size(accounts) > 1").select("accounts").distinct().collect()]
        if links:
            groups = spark.createDataFrame(_groups(links), "account string, grp string")
            moves = moves.join(F.broadcast(groups), "account", "left").withColumn("grp", F.coalesce("grp", "account"))
        else:
            moves = moves.withColumn("grp", F.col("account"))
        alone = alone.withColumn("grp", F.concat(F.lit("\n"), F.pmod("lineno", F.lit(parts)).cast("string")))  # no account has such a name
        moves = moves.unionByName(alone)
    moves = moves.repartition(parts, "grp").sortWithinPartitions("grp", "date", "lineno")
    return moves.mapInArrow(_in_order(known), _SCHEMA)


def _numbered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Entries in ledger order: days, kinds of a day, tasks, places in a task."""
    counts = counts.filter("part = 'count'").select("date", "priority", "pid", F.col("rank").alias("n")).repartition(1).persist()  # a row a day and task, read by every query
    by_day = counts.groupBy("date", "priority").agg(F.sum("n").alias("n"))
    days = Window.orderBy("date", "priority").rowsBetween(Window.unboundedPreceding, -1)
    tasks = Window.partitionBy("date", "priority").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = by_day.select("date", "priority", F.coalesce(F.sum("n").over(days), F.lit(0)).alias("day"))
    base = counts.join(F.broadcast(before), ["date", "priority"]).select("date", "priority", "pid", (F.col("day") + F.coalesce(F.sum("n").over(tasks), F.lit(0))).alias("earlier")).coalesce(1).persist()
    rows = rows.filter("part IN ('entry', 'price')").join(F.broadcast(base), ["date", "priority", "pid"])
    return rows.withColumn("entry_id", F.col("earlier") + F.col("rank"))


def _one_task(chunks: DataFrame, name: str, starts, options: list) -> DataFrame:
    """All rows, booked as one file."""
    schema = _arrow("pid int, nth int, parsed binary")

    def parsed(batches):
        import pyarrow as pa

        for pid, nth, f in _parsed(name, starts, batches):
            yield pa.RecordBatch.from_pylist([{"pid": pid, "nth": nth, "parsed": pickle.dumps(f)}], schema)

    def book(rows):
        import pandas as pd

        files = [pickle.loads(p) for p in rows.sort_values(["pid", "nth"])["parsed"]]
        unread = [f for f in files if isinstance(f, Unread)]
        whole = [_first(unread)] if unread else [T.File(name, [d for f in files for d in f.directives], options)]
        return pd.DataFrame([[r.get(c) for c in FORM] for r in rows_of(name, whole)], columns=list(FORM), dtype=object)

    return chunks.mapInArrow(parsed, "pid int, nth int, parsed binary").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(book, ", ".join(f"`{c}` {t}" for c, t in FORM.items()))


def _first(unread: list[Unread]) -> Unread:
    """The fault that parsing the whole would meet first: control characters are looked for before all else."""
    return min(unread, key=lambda f: (not f.message.startswith("control character"), f.line))


def load_pieces(spark: SparkSession, pieces: DataFrame, order: list[str], name: str = "<text>") -> Ledger:
    """The ledger of the column ``text``'s pieces in the order of ``order``, each without its last line break."""
    parts = 4 * spark.sparkContext.defaultParallelism
    ordered = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chunks = ordered.select("text").mapInArrow(_chunks(_arrow(_CHUNK_FORM)), _CHUNK_FORM).persist(StorageLevel.MEMORY_AND_DISK)
    starts = spark.sparkContext.broadcast(_starts(chunks.select("pid", "nth", "lines", "pushes").collect()))
    met = sorted((r.pid, r.nth, r.file) for r in chunks.filter("met").select("pid", "nth", "text").mapInArrow(_meet(name, starts), _MET_FORM).collect())
    met = [pickle.loads(file) for *_, file in met]
    directives, options = [d for x in met for d in x[0]], [o for x in met for o in x[1]]
    if any(d.kind not in STATE for d in directives):
        return as_ledger(_one_task(chunks, name, starts, options).persist())
    config, wrong = config_of(options)
    process = Process(config)
    ordered_state = process.process(directives)
    known = spark.sparkContext.broadcast((config, None, process.accounts, {d.line for d in ordered_state if id(d) in process.invalid}))
    rows = chunks.mapInArrow(_each(name, starts, known), _SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
    present = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    if "error" in present:
        unread = _first([Unread(name, r.message, r.lineno) for r in rows.filter("part = 'error'").select("message", "lineno").collect()])
        return as_ledger(spark.createDataFrame([tuple(r.get(c) for c in FORM) for r in rows_of(name, [unread])], ", ".join(f"`{c}` {t}" for c, t in FORM.items())))
    chunks.unpersist()
    every = rows.unionByName(_reduced(spark, rows, known, present["reducing"] <= _FEW).persist(StorageLevel.MEMORY_AND_DISK)) if "reducing" in present else rows
    numbered = _numbered(every, rows)
    entries, prices = (numbered.filter(F.col("part") == x).withColumn("ord", F.col("entry_id")) for x in ("entry", "price"))
    own = [F.col("posting")[c].alias(c) for c in _OWN]
    postings = entries.select(*ENTRY, F.posexplode("postings").alias("place", "posting")).withColumn("ord", F.shiftleft("entry_id", _PLACES) + F.col("place") + 1).select("ord", *ENTRY, *own)
    accounts = [(n, a.opened, a.closed, list(a.currencies), a.booking) for n, a in process.accounts.items()]
    out = Ledger(
        postings=postings.select(*POSTING), entries=entries.select("ord", *ENTRY, F.when(F.col("marks").isNull(), F.col("text")).otherwise(text_of()).alias("text"), "account", "number", "currency", "detail"), prices=prices.select("date", "base", "quote", "rate", "ord"),
        accounts=spark.createDataFrame(accounts, "account string, open date, close date, currencies array<string>, booking string"), roots=tuple(config.roots),
    )
    found = [_diagnostic(x) for x in [Diagnostic("error", "option", message, name, line) for line, message in wrong] + process.diagnostics]
    faults = ["severity", "code", "message", "filename", "lineno", "date", "account"]
    small = spark.createDataFrame([tuple(x[c] for c in faults) for x in found], "severity string, code string, message string, filename string, lineno bigint, date date, account string")
    out.diagnostics = every.filter("part = 'diagnostic'").select(*faults).unionByName(small)
    if "reducing" not in present:  # else it is looked for, where it is asked for
        out.has_undated_costs = "undated" in present
    out.operating_currencies, out.title = list(config.currencies), config.title
    return out
