"""Sums of positions into inventories, and the running balance."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyspark.plans import values as V
from tallyspark.plans.values import Kind, Typed

BUCKETS, BUCKET_ROWS, GRID, FEW_LOTS = 4096, 100_000, 64, 32
_SEED = -(1 << 63)  # ord of what a bucket starts with


def positions_of(x: Typed) -> Column:
    """An array of the positions that a value stands for."""
    if x.kind is Kind.INVENTORY:
        return x.col
    if x.kind is Kind.AMOUNT:
        one = F.struct(x.col["number"].alias("number"), x.col["scale"].alias("scale"), x.col["currency"].alias("currency"), F.lit(None).cast(V.COST).alias("cost"))
    else:
        one = x.col
    return F.when(x.col.isNotNull(), F.array(one)).cast(V.INVENTORY)


def gathered() -> Column:
    """Inventory of the rows (currency, cost, number, scale) of a group, without zeros, in canonical order."""
    one = F.when((F.col("number") != 0) & F.col("currency").isNotNull(), F.struct(F.col("number").cast(V.NUMBER).alias("number"), F.col("scale"), F.col("currency"), F.col("cost")))
    return V.ordered(F.collect_list(one))


def summed(rows: DataFrame, keys: list[str], positions: str, name: str) -> DataFrame:
    """keys, ``name`` (inventory), __first (least ord): partial sums per lot, then one inventory a group."""
    flat = rows.select(*keys, "ord", F.explode_outer(positions).alias("p")).select(*keys, "ord", F.col("p.currency").alias("currency"), F.col("p.cost").alias("cost"), F.col("p.number").alias("number"), F.col("p.scale").alias("scale"))
    lots = flat.groupBy(*keys, "currency", "cost").agg(F.sum("number").alias("number"), F.max("scale").alias("scale"), F.min("ord").alias("ord"))
    return lots.groupBy(*keys).agg(gathered().alias(name), F.min("ord").alias("__first"))


def _bucket(cuts: list[int]) -> Column:
    """Number of cuts below ord, found by a coarse grid first."""
    at = F.col("ord")
    below = lambda values: F.size(F.filter(F.array(*[F.lit(c) for c in values]).cast("array<bigint>"), lambda c: c < at))
    if len(cuts) <= GRID:
        return below(cuts)
    parts = [cuts[i : i + GRID] for i in range(0, len(cuts), GRID)]
    coarse = below([p[-1] for p in parts])  # so many whole parts lie below
    fine = F.element_at(F.array(*[F.array(*[F.lit(c) for c in p]).cast("array<bigint>") for p in parts]), F.least(coarse + 1, F.lit(len(parts))))
    return F.when(coarse == len(parts), F.lit(len(cuts))).otherwise(coarse * GRID + F.size(F.filter(fine, lambda c: c < at)))


def _held(lots: dict) -> list[dict]:
    names = ("number", "scale", "currency", "date", "label")
    return [{"number": n, "scale": s, "currency": c, "cost": None if k is None else dict(zip(names, k, strict=True))} for (c, k), (n, s) in lots.items()]


def _fold(batches, form) -> Iterator:
    """ord, held of rows that come sorted by bucket and ord, each bucket's seeds first; holds the lots of one bucket."""
    import pyarrow as pa

    bucket, lots = None, {}
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            ords, held = [], []
            for row in batch.slice(start, 1000).to_pylist():
                if row["bucket"] != bucket:
                    bucket, lots = row["bucket"], {}
                if row["currency"] is not None:
                    at = (row["currency"], None if row["cost"] is None else tuple(row["cost"].values()))
                    n, scale = lots.get(at, (Decimal(0), 0))
                    total, scale = n + row["number"], max(scale, row["scale"]) if n else row["scale"]
                    if total:
                        lots[at] = (total, scale)
                    else:
                        lots.pop(at, None)
                if row["ord"] != _SEED:
                    ords.append(row["ord"])
                    held.append(_held(lots))
            yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array(held, form)], names=["ord", "held"])


def running(rows: DataFrame, position: Column, name: str, bucket_rows: int = BUCKET_ROWS, few_lots: int = FEW_LOTS) -> DataFrame:
    """``rows`` with the inventory of all positions up to each, in order of ``ord``.

    The rows are cut into buckets of about ``bucket_rows`` (at most BUCKETS of them) at quantiles of ord; sums per lot
    and bucket, added up over the buckets before, are what each bucket starts with. Up to ``few_lots`` lots in
    all (a ledger of some currencies without costs), the balance is one running sum a lot over the bucket, by built-in
    windows; else one ordered pass over the bucket keeps its lots, a row at a time.
    """
    grid = [i / BUCKETS for i in range(1, BUCKETS)]
    n, cuts = rows.agg(F.count("ord"), F.percentile_approx("ord", grid, 20_000)).first()
    want = max(1, min(BUCKETS, -(-n // bucket_rows)))
    cuts = sorted({cuts[-(-i * len(cuts) // want) - 1] for i in range(1, want)}) if cuts else []
    bucket = _bucket(cuts)
    flat = rows.select("ord", bucket.alias("bucket"), position.alias("p"))
    lot = [F.col("p.currency").alias("currency"), F.col("p.cost").alias("cost"), F.col("p.number").cast("decimal(38,10)").alias("number"), F.col("p.scale").alias("scale")]
    flat = flat.select("ord", "bucket", *lot)
    sums = flat.filter("currency IS NOT NULL").groupBy("bucket", "currency", "cost").agg(F.sum("number").alias("number"), F.max("scale").alias("scale"))
    before = Window.partitionBy("currency", "cost").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    carried = sums.select("bucket", "currency", "cost", F.sum("number").over(before).alias("number"), F.max("scale").over(before).alias("scale"))
    following = Window.partitionBy("currency", "cost").orderBy("bucket")
    carried = carried.withColumn("until", F.coalesce(F.lead("bucket").over(following), F.lit(len(cuts))))
    carried = carried.select(F.explode(F.sequence(F.col("bucket") + 1, F.greatest("until", F.col("bucket") + 1))).alias("bucket"), "currency", "cost", "number", "scale").persist()
    lots = [(r.currency, r.cost) for r in carried.select("currency", "cost").distinct().limit(few_lots + 1).collect()]
    if len(lots) <= few_lots and all(cost is None for _, cost in lots):
        return _windowed(rows, bucket, position, carried, sorted(c for c, _ in lots), name)
    seeds = carried.filter("number <> 0").select(F.lit(_SEED).alias("ord"), "bucket", "currency", "cost", "number", "scale")
    every = flat.unionByName(seeds).repartition(max(1, len(cuts) + 1), "bucket").sortWithinPartitions("bucket", "ord")
    form = to_arrow_type(rows.select(F.lit(None).cast(V.INVENTORY).alias("held")).schema[0].dataType)
    held = every.mapInArrow(lambda batches: _fold(batches, form), f"ord long, held {V.INVENTORY}")
    return rows.join(held.select("ord", V.ordered(F.col("held")).alias(name)), "ord")


def _windowed(rows: DataFrame, bucket: Column, position: Column, carried: DataFrame, currencies: list[str], name: str) -> DataFrame:
    """Running sums of a few currencies: a window per bucket, and what each bucket starts with from a small table."""
    seeds = carried.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("currency", F.struct("number", "scale")))).alias("__seeds"))
    out = rows.withColumn("__bucket", bucket).withColumn("__p", position)
    out = out.join(F.broadcast(seeds.withColumnRenamed("bucket", "__bucket")), "__bucket", "left")  # a row a bucket
    upto = Window.partitionBy("__bucket").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    held = []
    for c in currencies:
        mine, seed = F.col("__p.currency") == c, F.try_element_at("__seeds", F.lit(c))
        total = F.coalesce(F.sum(F.when(mine, F.col("__p.number").cast("decimal(28,10)"))).over(upto), F.lit(0)) + F.coalesce(seed["number"], F.lit(0))
        scale = F.greatest(F.max(F.when(mine, F.col("__p.scale"))).over(upto), seed["scale"])
        held.append(F.when(total != 0, F.struct(total.cast(V.NUMBER).alias("number"), scale.cast("int").alias("scale"), F.lit(c).alias("currency"), F.lit(None).cast(V.COST).alias("cost"))))
    inventory = F.filter(F.array(*held), lambda p: p.isNotNull()) if held else F.array()
    return out.withColumn(name, V.ordered(inventory.cast(V.INVENTORY))).drop("__bucket", "__p", "__seeds")
