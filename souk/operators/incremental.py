"""Seller and product marts kept up to date from changed orders.

A store holds two tables. ``pairs`` has what each (order, entity) contributes
to its entity's sums; ``totals`` has the sums of each entity. Both only grow,
a batch at a time; ``changed`` names the orders of each batch, and ``commits``
the batches that are whole. A batch that was cut short is written over, so a
refresh may be repeated after a failure.

A refresh is told which orders changed: new, late, corrected or emptied of
their items. Only those are read from the base tables. What they contributed
before is looked up in ``pairs`` and taken back, what they contribute now is
added, and the entities met by either get a new row of totals. Counts, money
and times are exact integers and decimals, so taking back leaves no residue.
First and last dates can't be taken back: where one that an entity's order
leaves was the entity's first (or last), its dates are found again from its
pairs. A pair counts if its order was not changed by a later batch.

The mart is made from the current totals by the same code as the full build.

Rows without an order id contribute to their entity in the first build and are
never changed. A changed order id that exists nowhere is ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.operators import products, sellers
from souk.operators.economics import DEFAULT_RATES, Rates, ReviewCost
from souk.plans.skew import in_tasks, salted_join, tasks_for
from souk.sources.catalog import Marketplace

ORDER = "order_id"

@dataclass(frozen=True)
class MartSpec:
    """What a store keeps: the pairs' sums (name -> column of ``pairs``), their
    first and last dates, and how totals become the mart."""

    key: str
    pairs: Callable[[Marketplace, Rates], DataFrame]
    sums: tuple[str, ...]
    first: tuple[str, ...]
    last: tuple[str, ...]
    finish: Callable[[DataFrame, Marketplace, Rates], DataFrame]


def _review_cost(rates: ReviewCost) -> Column:
    """Summed review costs from the counts of each score."""
    return (
        F.col("n_one_star") * F.lit(rates.low_base)
        + F.col("n_two_star") * F.lit(rates.low_base / 2)
        + F.col("n_three_star") * F.lit(rates.mid)
    )


def _review_means() -> dict[str, Column]:
    return {
        "share_of_one_stars": F.try_divide("n_one_star", "n_reviews"),
        "share_of_five_stars": F.try_divide("n_five_star", "n_reviews"),
        "review_score": F.try_divide("score_sum", "n_scored"),
    }


def _finish_sellers(totals: DataFrame, m: Marketplace, rates: Rates) -> DataFrame:
    per_seller = totals.withColumns(
        _review_means()
        | {
            "quantity": F.col("n_items"),
            "_sales": F.col("price_sum"),
            "_n_delivered": F.col("n_delivered"),
            "_n_wait": F.col("n_wait"),
            "date_first_sale": F.col("first_approved"),
            "date_last_sale": F.col("last_approved"),
            "_n_reviews": F.col("n_reviews"),
            "_review_costs": _review_cost(rates.seller_review),
        }
    )
    return sellers.mart_of(per_seller, m, rates)


def _finish_products(totals: DataFrame, m: Marketplace, rates: Rates) -> DataFrame:
    per_product = totals.withColumns(
        _review_means()
        | {
            "_wait_w": F.col("wait_w"),
            "price": F.try_divide(F.col("price_sum").cast("double"), F.col("n_priced")),
            "costs": _review_cost(rates.product_review),
            "quantity": F.col("n_items"),
            "_sales": F.col("price_sum"),
            "_n_delivered": F.col("n_delivered"),
            "_n_reviews": F.col("n_reviews"),
        }
    )
    return products.mart_of(per_product, m, rates)


_REVIEW_SUMS = ("n_reviews", "n_one_star", "n_two_star", "n_three_star", "n_five_star", "score_sum", "n_scored")
SELLERS = MartSpec(
    "seller_id",
    sellers.pair_sums,
    ("n_items", "price_sum", "n_delivered", "delay_s", "delay_us", "wait_s", "wait_us", "n_wait", *_REVIEW_SUMS),
    ("first_approved",),
    ("last_approved",),
    _finish_sellers,
)
PRODUCTS = MartSpec(
    "product_id",
    products.pair_sums,
    ("n_items", "price_sum", "n_priced", "n_delivered", "wait_s", "wait_us", "wait_w", *_REVIEW_SUMS),
    (),
    (),
    _finish_products,
)


class MartStore:
    """The state of one mart below ``path`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, path: str, spec: MartSpec, rates: Rates = DEFAULT_RATES):
        self.spark, self.path, self.spec, self.rates = spark, path.rstrip("/"), spec, rates
        self.dates = {c: F.min for c in spec.first} | {c: F.max for c in spec.last}

    # --- tables ---------------------------------------------------------------

    def batches(self) -> int:
        """The number of whole batches (0: nothing is built)."""
        try:
            return self.spark.read.schema("batch int").parquet(f"{self.path}/commits/*").count()
        except Exception as error:  # the folder does not exist yet
            if "PATH_NOT_FOUND" in str(error):
                return 0
            raise

    def _write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = f"{self.path}/{table}/{batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, table: str, batches: range) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{table}/{b}" for b in batches))

    def _tasks(self, table: str, batches: int) -> int | None:
        """Partitions for work on all rows of a table (counted in the files' footers)."""
        return tasks_for(self.spark, self._read(table, range(batches)).count())

    def _commit(self, batch: int) -> None:
        self._write(self.spark.range(1).select(F.lit(batch).alias("batch")), "commits", batch)

    # --- pairs and totals -----------------------------------------------------

    def _contributions(self, m: Marketplace, batch: int) -> DataFrame:
        s = self.spec
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return s.pairs(m, self.rates).select(
            ORDER, s.key,
            F.col(ORDER).isNotNull().cast("long").alias("n_orders"),
            F.lit(1).cast("long").alias("n_pairs"),
            *(zero(c) for c in s.sums), *self.dates,
            F.lit(batch).alias("batch"),
        )

    @property
    def _sums(self) -> list[str]:
        return ["n_orders", "n_pairs", *self.spec.sums]

    def _totals_of(self, pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(self.spec.key).agg(
            *(F.sum(c).alias(c) for c in self._sums), *(f(c).alias(c) for c, f in self.dates.items())
        )

    def _current_pairs(self, pairs: DataFrame, batches: int) -> DataFrame:
        """Those of ``pairs`` whose order no later batch changed."""
        if batches < 2:
            return pairs
        tasks = self._tasks("pairs", batches)
        changed = in_tasks(self._read("changed", range(1, batches)), tasks, ORDER)
        last = changed.groupBy(ORDER).agg(F.max("batch").alias("_last"))
        known = salted_join(pairs, last, ORDER, "left", spread_by=[self.spec.key], other_unique=True, tasks=tasks)
        return known.filter(F.col("_last").isNull() | (F.col("batch") == F.col("_last"))).drop("_last")

    def totals(self) -> DataFrame:
        """The current sums of each entity that has a pair."""
        return self._totals(self.batches())

    def _totals(self, batches: int) -> DataFrame:
        key = self.spec.key
        rows = self._read("totals", range(batches))
        rest = [c for c in rows.columns if c not in (key, "batch")]
        # a row for each batch at most, so that no entity has many
        latest = in_tasks(rows, self._tasks("totals", batches), key).groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_t"))
        return latest.select(key, "_t.*").filter("n_pairs > 0")

    # --- operations -----------------------------------------------------------

    def build(self, m: Marketplace) -> None:
        """Everything from the base tables, as the first batch."""
        pairs = self._write(self._contributions(m, 0), "pairs", 0)
        self._write(self._totals_of(pairs).withColumn("batch", F.lit(0)), "totals", 0)
        self._commit(0)

    def refresh(self, m: Marketplace, changed: DataFrame) -> None:
        """``m`` as it is now; ``changed`` holds the ids of all orders that have
        rows that are not as they were at the last batch."""
        batch = self.batches()
        if not batch:
            raise ValueError("nothing is built yet")
        key = self.spec.key
        ids = self._write(
            in_tasks(changed.select(ORDER).dropna(), m.order_tasks(), ORDER).distinct().withColumn("batch", F.lit(batch)), "changed", batch
        ).drop("batch")
        now = self._write(self._contributions(_only(m, ids), batch), "pairs", batch)
        old = self._read("pairs", range(batch))
        was = self._current_pairs(self._among(old, ids, ORDER, [key], self._tasks("pairs", batch)), batch)
        both = now.withColumn("_sign", F.lit(1)).unionByName(was.withColumn("_sign", F.lit(-1)))
        added, gone = F.col("_sign") == 1, F.col("_sign") == -1
        change = both.groupBy(key).agg(
            *(F.sum(F.col("_sign") * F.col(c)).alias(f"_d_{c}") for c in self._sums),
            *(f(F.when(added, F.col(c))).alias(f"_new_{c}") for c, f in self.dates.items()),
            *(f(F.when(gone, F.col(c))).alias(f"_gone_{c}") for c, f in self.dates.items()),
        )
        before = self._totals(batch)
        sums = [
            (F.coalesce(before[c], F.lit(0)) + F.col(f"_d_{c}")).cast(before.schema[c].dataType).alias(c) for c in self._sums
        ]
        dates, doubts = [], F.lit(False)
        for c, f in self.dates.items():
            nearer = F.least if f is F.min else F.greatest
            new, left = F.col(f"_new_{c}"), F.col(f"_gone_{c}")
            lost = left.eqNullSafe(before[c]) & left.isNotNull() & ~F.coalesce(nearer(new, left) == new, F.lit(False))
            doubts = doubts | lost
            dates.append(nearer(before[c], new).alias(c))
        merged = change.join(before, key, "left").select(change[key], *sums, *dates, doubts.alias("_doubt"))
        if self.dates:
            merged = self._write(merged, "merged", batch)  # read twice
            again = self._dates_again(merged.filter("_doubt").select(key), batch)
            known = [c for c in merged.columns if c not in self.dates]
            merged = merged.join(again, key, "left").select(
                *known, *(F.when(F.col("_doubt"), F.col(f"_a_{c}")).otherwise(F.col(c)).alias(c) for c in self.dates)
            )
        merged = merged.drop("_doubt").withColumn("batch", F.lit(batch))
        self._write(merged.select(self._read("totals", range(1)).columns), "totals", batch)
        self._commit(batch)

    def _among(self, rows: DataFrame, ids: DataFrame, key: str, spread_by: list[str], tasks: int | None) -> DataFrame:
        """The rows whose ``key`` is one of ``ids``, which are distinct."""
        return salted_join(rows, ids, key, spread_by=spread_by, tasks=tasks)

    def _dates_again(self, keys: DataFrame, batch: int) -> DataFrame:
        tasks = self._tasks("pairs", batch + 1)
        pairs = self._among(self._read("pairs", range(batch + 1)), keys, self.spec.key, [ORDER], tasks)
        return self._current_pairs(pairs, batch + 1).groupBy(self.spec.key).agg(
            *(f(c).alias(f"_a_{c}") for c, f in self.dates.items())
        )

    def mart(self, m: Marketplace) -> DataFrame:
        """The mart; ``m`` gives the entities' own columns."""
        return self.spec.finish(self.totals(), m, self.rates)

    def compacted(self, path: str) -> "MartStore":
        """The current state as one batch below a new path."""
        new = MartStore(self.spark, path, self.spec, self.rates)
        batches = self.batches()
        pairs = self._current_pairs(self._read("pairs", range(batches)), batches)
        new._write(pairs.withColumn("batch", F.lit(0)), "pairs", 0)
        new._write(self._totals(batches).withColumn("batch", F.lit(0)), "totals", 0)
        new._commit(0)
        return new


def _only(m: Marketplace, ids: DataFrame) -> Marketplace:
    """The marketplace with the orders ``ids``, their items and reviews."""
    def among(df: DataFrame, spread_by: list[str], table: str | None) -> DataFrame:
        hot = m.hot(table, ORDER) if table else None
        return salted_join(df, ids, ORDER, spread_by=spread_by, hot=hot).select(df.columns)

    return replace(
        m,
        orders=m.orders.join(in_tasks(ids, m.order_tasks(), ORDER), ORDER, "left_semi"),
        order_items=among(m.order_items, ["order_item_id", "product_id", "seller_id"], "order_items"),
        order_reviews=among(m.order_reviews, ["review_id"], "order_reviews"),
    )
