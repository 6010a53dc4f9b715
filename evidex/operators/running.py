"""Running sums and looks back or ahead along the rows of a key, for keys that may hold any number of rows.

A window over a whole key is one task a key. Here a key's rows are cut in segments of a fixed span of their place; windows run
within segments, which many tasks share; each segment is summed up in one row (its sum, its last and its first value), what the
segments before or behind bring along is a window over these few rows, and a join by segment adds it. The result is that of
the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Of a place counted in characters: about a thousand lines.
SPAN = 1 << 16


def running(rows: DataFrame, at: str, ties: tuple[str, ...] = (), sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, by: tuple[str, ...] = ("document_id",), span: int = SPAN) -> DataFrame:
    """rows with columns that look along the rows of a key (by), in the order of the whole number `at` and then of ties.

    sums: the sum over the rows before (0 for the first); lasts: the last value that is not null at or before a row; nexts: the
    first value that is not null behind it. Nulls in `at` come first, in a segment of their own. Rows that agree in `at` lie in one segment.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    values = {f"_v{k}": v for k, v in enumerate([*sums.values(), *lasts.values(), *nexts.values()])}
    names = dict(zip([*sums, *lasts, *nexts], values))
    placed = rows.withColumns({"_segment": F.floor(F.col(at) / span), **values})
    order, key = [at, *ties], [*by, "_segment"]

    ahead, behind = W.partitionBy(*key).orderBy(*order), W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    earlier, upto = ahead.rowsBetween(W.unboundedPreceding, -1), ahead.rowsBetween(W.unboundedPreceding, 0)
    later = behind.rowsBetween(W.unboundedPreceding, -1)
    own = {f"_own{n}": F.sum(names[n]).over(earlier) for n in sums} | {f"_own{n}": F.last(names[n], True).over(upto) for n in lasts}
    out = placed.withColumns(own) if own else placed
    if nexts:
        out = out.withColumns({f"_own{n}": F.last(names[n], True).over(later) for n in nexts})

    where = F.struct(*order)
    known = lambda n: F.when(F.col(names[n]).isNotNull(), where)
    whole = [F.sum(names[n]).alias(f"_of{n}") for n in sums] + [F.max_by(names[n], known(n)).alias(f"_of{n}") for n in lasts] + [F.min_by(names[n], known(n)).alias(f"_of{n}") for n in nexts]
    before, after = (W.partitionBy(*by).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("_segment", F.desc("_segment")))
    carried = placed.groupBy(*key).agg(*whole).select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)],
        *[F.sum(f"_of{n}").over(before).alias(f"_in{n}") for n in sums],
        *[F.last(f"_of{n}", True).over(before).alias(f"_in{n}") for n in lasts],
        *[F.last(f"_of{n}", True).over(after).alias(f"_in{n}") for n in nexts],
    )
    met = None
    for i, c in enumerate(key):
        same = F.col(c).eqNullSafe(F.col(f"_key{i}"))
        met = same if met is None else met & same
    joined = out.join(carried, met)
    made = {n: F.coalesce(f"_own{n}", F.lit(0)) + F.coalesce(f"_in{n}", F.lit(0)) for n in sums} | {n: F.coalesce(f"_own{n}", f"_in{n}") for n in [*lasts, *nexts]}
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in made], *[v.alias(n) for n, v in made.items()])
