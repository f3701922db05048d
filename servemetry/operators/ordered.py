"""Running values along an order, safe for a key that holds most of the rows.

A window over one key is one task. Here the rows are range-partitioned by key
and order, so a hot key covers many slices; each slice is walked on its own and
what other slices contribute is added from the row at the edge of each. The
walked rows are pinned in reliable storage: range bounds come from sampling, and
the rows and the edges must agree on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import pin

_SLICE = "_slice"
#: Marks of the last and of the first row of a key in its slice.
_EDGES = ("_is_last", "_is_first")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, str] | None = None,
    sums_through: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
    lasts_through: Mapping[str, str] | None = None,
    nexts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running columns, given as {new column: input column}.

    sums, lasts: total and latest non-null value over the rows before this one.
    sums_through, lasts_through: the same, this row included.
    nexts: earliest non-null value over the rows after this one.
    Keys must not be null and `order` must tell all rows of a key apart.
    """
    sums, sums_through = dict(sums or {}), dict(sums_through or {})
    lasts, lasts_through = dict(lasts or {}), dict(lasts_through or {})
    nexts = dict(nexts or {})
    all_sums, all_lasts = {**sums, **sums_through}, {**lasts, **lasts_through}

    ranged = df.repartitionByRange(*keys, *order).withColumn(_SLICE, F.spark_partition_id())
    walk = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    before = walk.rowsBetween(Window.unboundedPreceding, -1)
    through = walk.rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead is looking back along the reverse order: Spark walks such a
    # frame once, but starts anew at every row for one that ends at the last row.
    back = Window.partitionBy(*keys, _SLICE).orderBy(*[F.desc(c) for c in order])
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_l_{out}": F.sum(src).over(before) for out, src in sums.items()}
    local |= {f"_l_{out}": F.sum(src).over(through) for out, src in sums_through.items()}
    local |= {f"_l_{out}": F.last(src, ignorenulls=True).over(before) for out, src in lasts.items()}
    local |= {f"_l_{out}": F.last(src, ignorenulls=True).over(through) for out, src in lasts_through.items()}
    local |= {f"_l_{out}": F.last(src, ignorenulls=True).over(after) for out, src in nexts.items()}
    local[_EDGES[0]] = F.lead(F.lit(True)).over(walk).isNull()
    if nexts:
        local[_EDGES[1]] = F.lag(F.lit(True)).over(walk).isNull()
    walked = pin(ranged.withColumns(local))

    zero = F.lit(0)
    upto = {out: F.coalesce(f"_l_{out}", zero) + F.coalesce(src, zero) for out, src in sums.items()}
    upto |= {out: F.coalesce(src, f"_l_{out}") for out, src in {**lasts, **nexts}.items()}

    def carried(edge: str, names: Sequence[str], slices: Column) -> DataFrame:
        """What the slices ahead in the order `slices` give to each; none for the first of a key.

        A slice holds but one key that another slice holds ahead of it, so there are no more of these
        rows than slices, and they can be broadcast.
        """
        ahead = Window.partitionBy(*keys).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)
        at_edge = walked.where(edge).select(*keys, _SLICE, *[upto.get(out, F.col(f"_l_{out}")).alias(f"_c_{out}") for out in names])
        given = {f"_c_{out}": (F.sum if out in all_sums else _latest)(f"_c_{out}").over(ahead) for out in names}
        return at_edge.withColumns({**given, _EDGES[0]: F.count(F.lit(1)).over(ahead)}).where(f"{_EDGES[0]} > 0").drop(_EDGES[0])

    joined = walked
    for edge, names, slices in zip(_EDGES, ([*all_sums, *all_lasts], [*nexts]), (F.asc(_SLICE), F.desc(_SLICE)), strict=True):
        if names:
            joined = joined.join(F.broadcast(carried(edge, names, slices)), [*keys, _SLICE], "left")
    done = {out: F.coalesce(f"_l_{out}", zero) + F.coalesce(f"_c_{out}", zero) for out in all_sums}
    done |= {out: F.coalesce(f"_l_{out}", f"_c_{out}") for out in [*all_lasts, *nexts]}
    scratch = [f"{p}{out}" for out in done for p in ("_l_", "_c_")]
    return joined.withColumns(done).drop(_SLICE, *_EDGES, *scratch)


def _latest(column: str) -> Column:
    return F.last(column, ignorenulls=True)
