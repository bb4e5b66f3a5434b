"""Ordered computations over keys of any size.

A plain window partitioned by a key puts the whole key into one task, which fails once a single run,
host or conversation holds a large share of the table. Here the keys with very many rows are found by a
count and cut into consecutive chunks of their order column. A partial aggregate summarises each chunk, a
window over those few summaries carries what precedes the chunk, and the carried row joins its chunk as a
first row. All rows are shuffled once, by key and chunk; keys of ordinary size are one chunk and need no
summary, so that a table without hot keys costs a plain window and the count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 65_536
"""Chunk length for dense positions such as turn or line numbers (unique per key)."""

HOT_ROWS = 1_000_000
"""Rows from which a key is cut into chunks; fewer are left to one task."""

MICROS = 1_000_000

SAMPLE_ONE_IN = 4_096
MAX_CHUNKS = 512


@dataclass(frozen=True)
class EvenChunks:
    """Chunks of about equal numbers of rows along ``position`` (a number or time that does not decrease along the order).

    The bounds of a hot key come from a sample of its positions, one row in ``one_in`` by a hash of ``spread``, taken in
    the pass that counts the key: a burst within a second is spread as well as a quiet month. A sample decides where a
    key is cut, never what comes out.
    """

    position: str
    spread: tuple[str, ...]
    rows: int = ROWS_PER_CHUNK
    one_in: int = SAMPLE_ONE_IN

    def number(self) -> Column:
        column = F.col(self.position)
        return F.unix_micros(column.cast("timestamp"))

    def sample(self) -> Column:
        drawn = F.pmod(F.xxhash64(*self.spread), F.lit(self.one_in)) == 0
        return F.array_sort(F.collect_list(F.when(drawn, self.number()))).alias("_sample")

    def bounds(self) -> Column:
        """Every so many-th position of the sample; for a key of very many rows the chunks grow instead of their number."""
        wanted = F.least(F.lit(MAX_CHUNKS), F.ceil(F.col("_rows") / self.rows))
        step = F.greatest(F.lit(1), F.ceil(F.size("_sample") / wanted)).cast("int")
        return F.array_distinct(F.filter("_sample", lambda x, i: (i % step == 0) & (i > 0)))

    def chunk(self) -> Column:
        return F.size(F.filter("_bounds", lambda bound: bound <= self.number())).cast("bigint")


def position_chunk(position: str | Column, length: int = ROWS_PER_CHUNK) -> Column:
    """Chunk number of an integer position."""
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(length)).cast("bigint")


def mark_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int, sized_by: DataFrame | None = None, even: EvenChunks | None = None,
) -> DataFrame:
    """Adds ``_hot``, true for the rows of keys with more than ``hot_rows`` rows and NULL for the others.

    There are at most ``rows / hot_rows`` such keys, which bounds what is broadcast. ``sized_by`` is
    another table to count, where one with at least as many rows per key is cheaper to read. With ``even``, also the
    ``_bounds`` of their chunks.
    """
    more = [even.sample()] if even else []
    counts = (df if sized_by is None else sized_by).groupBy(*keys).agg(F.count("*").alias("_rows"), *more)
    hot = counts.where(F.col("_rows") > hot_rows).select(
        *[F.col(key).alias(f"_hot_{key}") for key in keys], F.lit(True).alias("_hot"),
        *([even.bounds().alias("_bounds")] if even else []),
    )
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_hot_{key}")) for key in keys])
    return df.join(F.broadcast(hot), same, "left").drop(*[f"_hot_{key}" for key in keys])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | EvenChunks,
    *,
    running: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    last_known: dict[str, Column] | None = None,
    totals: dict[str, tuple[str, Column]] | None = None,
    descending: bool = False,
    hot_rows: int = HOT_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Adds order-dependent columns to ``df`` without holding a hot key in one task.

    ``running``     inclusive running sum per key
    ``previous``    value on the preceding row of the key
    ``last_known``  latest non-null value on any earlier row of the key
    ``totals``      ``(sum | min | max, column)`` over the whole key

    ``order`` must be unique per key and ``chunk`` must not decrease along it; :class:`EvenChunks` are cut by rows. With ``descending`` the
    key is read from its last row to its first, so "previous" means the following row. ``hot_rows`` and
    ``sized_by`` are those of :func:`mark_hot`.
    """
    running, previous = running or {}, previous or {}
    last_known, totals = last_known or {}, totals or {}
    keys, order = list(keys), list(order)
    latest = F.min_by if descending else F.max_by

    def directed(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    even = chunk if isinstance(chunk, EvenChunks) else None
    marked = mark_hot(df, keys, hot_rows, sized_by, even)
    if even:
        marked = marked.withColumn("_chunk", F.when(F.col("_hot"), even.chunk())).drop("_bounds")
    else:
        marked = marked.withColumn("_chunk", F.when(F.col("_hot"), chunk))
    rows = marked.withColumns(
        {"_is_row": F.lit(True)}
        | {f"_run_{name}": column for name, column in running.items()}
        | {f"_known_{name}": F.when(column.isNotNull(), F.struct(column.alias("v")))
           for name, column in last_known.items()}
        | {f"_whole_{name}": column for name, (_, column) in totals.items()}
        | ({"_prev": F.struct(*[column.alias(name) for name, column in previous.items()])} if previous else {})
    )

    position = F.struct(*[F.col(name) for name in order])
    folds = [F.sum(f"_run_{name}").alias(f"_run_{name}") for name in running]
    if previous:
        folds.append(latest("_prev", position).alias("_prev"))
    for name in last_known:
        known = F.col(f"_known_{name}")
        folds.append(latest(known, F.when(known.isNotNull(), position)).alias(f"_known_{name}"))
    folds += [getattr(F, kind)(f"_whole_{name}").alias(f"_total_{name}") for name, (kind, _) in totals.items()]
    summaries = rows.where("_hot").groupBy(*keys, "_chunk").agg(*folds)

    along = Window.partitionBy(*keys).orderBy(directed("_chunk"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = [F.coalesce(F.sum(f"_run_{name}").over(before), F.lit(0)).alias(f"_run_{name}")
               for name in running]
    if previous:
        carried.append(F.lag("_prev").over(along).alias("_prev"))
    carried += [F.last(f"_known_{name}", ignorenulls=True).over(before).alias(f"_known_{name}")
                for name in last_known]
    carried += [getattr(F, kind)(f"_total_{name}").over(whole).alias(f"_total_{name}")
                for name, (kind, _) in totals.items()]
    carries = summaries.select(*keys, "_chunk", F.lit(False).alias("_is_row"), *carried)

    chunk_rows = Window.partitionBy(*keys, "_chunk")
    local = chunk_rows.orderBy("_is_row", *[directed(name) for name in order])
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = local.rowsBetween(Window.unboundedPreceding, -1)
    results = {f"_run_{name}": F.sum(f"_run_{name}").over(upto) for name in running}
    if previous:
        results["_prev"] = F.lag("_prev").over(local)
    results |= {f"_known_{name}": F.last(f"_known_{name}", ignorenulls=True).over(prior)
                for name in last_known}
    results |= {f"_total_{name}": F.coalesce(F.first(f"_total_{name}").over(upto),
                                             getattr(F, kind)(f"_whole_{name}").over(chunk_rows))
                for name, (kind, _) in totals.items()}
    scanned = rows.unionByName(carries, allowMissingColumns=True).withColumns(results).where("_is_row")

    replaced = {*running, *previous, *last_known, *totals}
    return scanned.select(
        *[F.col(name) for name in df.columns if name not in replaced],
        *[F.col(f"_run_{name}").alias(name) for name in running],
        *[F.col(f"_prev.{name}").alias(name) for name in previous],
        *[F.col(f"_known_{name}.v").alias(name) for name in last_known],
        *[F.col(f"_total_{name}").alias(name) for name in totals],
    )


def with_totals(
    df: DataFrame, keys: Sequence[str], spread: Sequence[str], totals: dict[str, tuple[str, Column]],
    parts: int = 256, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attaches whole-key aggregates to every row, with each hot key spread over ``parts`` chunks.

    ``spread`` names the columns that decide a row's part; they should be (nearly) unique per key.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(parts))
    return ordered_scan(df, keys, list(spread), part, totals=totals, hot_rows=hot_rows)


def number_rows(
    df: DataFrame, order: Sequence[str], chunk_keys: Sequence[str], name: str = "number"
) -> DataFrame:
    """Numbers the rows of a whole table from 1 along ``order``, with no single-task window over rows.

    ``chunk_keys`` (leading part of the order) cut the table into chunks. Rows are ranked inside their
    chunk; only the chunk counts pass through one ordered running sum.
    """
    sizes = df.groupBy(*chunk_keys).agg(F.count("*").alias("_rows"))
    ahead = Window.orderBy(*chunk_keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *chunk_keys, F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_offset"),
        F.lit(False).alias("_is_row"),
    )
    local = Window.partitionBy(*chunk_keys).orderBy("_is_row", *order)
    return (
        df.withColumn("_is_row", F.lit(True))
        .unionByName(offsets, allowMissingColumns=True)
        .withColumns({
            "_offset": F.first("_offset").over(local.rowsBetween(Window.unboundedPreceding, 0)),
            "_rank": F.row_number().over(local),
        })
        .where("_is_row")
        .select(*df.columns, (F.col("_offset") + F.col("_rank") - 1).cast("bigint").alias(name))
    )
