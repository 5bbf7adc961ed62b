"""Running numbers over a whole table without a single task that sees it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def running_number(rows: DataFrame, order: str, name: str, parts: int = 64) -> DataFrame:
    """The position of each row from 0 in ascending order of `order`, a number without nulls; equal values share no number but their order is open.

    Rows are dealt to ranges of the order by approximate quantiles; the counts of the ranges, `parts` rows, give each range its start.
    """
    cuts = sorted({int(c) for c in rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.001)}) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = rows.withColumn("_part", part)
    counts = {r[0]: r[1] for r in rows.groupBy("_part").count().collect()}
    start, table = 0, []
    for p in sorted(counts):
        table += [F.lit(p), F.lit(start)]
        start += counts[p]
    if not table:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("_part")
    w = Window.partitionBy("_part").orderBy(order)
    return rows.withColumn(name, F.row_number().over(w) - 1 + F.element_at(F.create_map(*table), F.col("_part"))).drop("_part")
