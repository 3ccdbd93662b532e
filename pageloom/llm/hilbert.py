"""Shards cut from a Hilbert curve over several metadata dimensions. DataFrame functions only.

Each dimension is quantised to a few bits by table-wide quantiles that keep its order, the cell's place on the curve is its index, rows are sorted by that index
and the order is cut into runs. Rows close in all dimensions lie in the same shard, so a filter on any of them
skips most files by their minima and maxima. The order spans the table: it is numbered over
range-partitioned slices, so neither one cell nor one group of copies is a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.ordered import running_sum
from pageloom.session import stage

BITS = 5


def hilbert_index(cell: str, axes: int, bits: int) -> Column:
    """Place on the Hilbert curve of ``cell``, a column with an array of coordinates of ``bits`` bits each.

    The transpose form of Skilling (2004): undo the turns from the top bit down, Gray-code, interleave the bits.
    """
    q, place = f"shiftleft(1, {bits - 1} - s DIV {axes})", f"CAST(s % {axes} AS INT)"
    own, has = f"x[{place}]", f"(x[{place}] & {q}) <> 0"
    swap = f"((x[0] ^ {own}) & ({q} - 1))"
    turned = (
        f"aggregate(sequence(0, {axes * (bits - 1) - 1}), {cell}, (x, s) -> transform(x, (v, j) -> CASE "
        f"WHEN j = 0 THEN x[0] ^ IF({has}, {q} - 1, {swap}) WHEN j = {place} AND NOT {has} THEN v ^ {swap} ELSE v END))"
        if bits > 1
        else cell
    )
    coded = f"transform(array({turned}), x -> transform(x, (v, j) -> aggregate(slice(x, 1, j + 1), 0, (a, w) -> a ^ w)))[0]"
    flips = (
        f"aggregate(sequence(1, {bits - 1}), 0, (a, k) -> a ^ IF((x[{axes - 1}] & shiftleft(1, k)) <> 0, shiftleft(1, k) - 1, 0))"
        if bits > 1
        else "0"
    )
    woven = (
        f"aggregate(sequence(0, {axes * bits - 1}), 0L, (a, s) -> a * 2 + "
        f"((shiftright(x[CAST(s % {axes} AS INT)] ^ {flips}, {bits - 1} - CAST(s DIV {axes} AS INT))) & 1))"
    )
    return F.expr(f"transform(array({coded}), x -> {woven})[0]")


def _is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "timestamp") or kind.startswith("decimal")


def _number(column: str, kind: str) -> Column:
    """The column as double, null where it is not finite."""
    value = F.col(column).cast("int").cast("double") if kind == "boolean" else F.col(column).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def cuts(docs: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> dict[str, list]:
    """Per dimension at most 2**bits - 1 ascending values that cut the whole table into parts of like many rows.

    Numbers by their quantiles, all other kinds by the running count of their distinct values in order. A value that many rows
    share is never cut, so a part may be larger, and there are fewer cuts than asked for.
    """
    kinds, parts = dict(docs.dtypes), 1 << bits
    numbers = [c for c in dimensions if _is_number(kinds[c])]
    found: dict[str, list] = {c: [] for c in dimensions}
    if numbers:
        shares = [i / parts for i in range(1, parts)]
        row = docs.agg(*(F.percentile_approx(_number(c, kinds[c]), shares).alias(f"q{i}") for i, c in enumerate(numbers))).first()
        found |= {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(numbers)}
    for c in dimensions:
        if c in numbers:
            continue
        counted = docs.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
        upto = running_sum(counted, [], [F.col("value")], F.col("n"), "upto")
        total = upto.agg(F.sum("n")).first()[0]
        if total:
            part = F.expr(f"CAST((CAST(upto - n AS DECIMAL(28,0)) * {parts}) DIV CAST({total} AS DECIMAL(28,0)) AS INT)")
            # one row a part
            firsts = upto.groupBy(part.alias("part")).agg(F.min("value").alias("value")).filter("part > 0").collect()
            found[c] = sorted(bytes(r.value) if kinds[c] == "binary" else r.value for r in firsts)
    return found


def _quantised(column: str, kind: str, cut: Sequence) -> Column:
    """A cell from 0 on, the number of cuts that the value reaches; null and what is not finite are cell 0.

    Cells keep the order of values, so the minima and maxima of a run of the curve tell which values it cannot hold.
    """
    if not cut:
        return F.lit(0)
    value = _number(column, kind) if _is_number(kind) else F.col(column)
    return F.coalesce(F.when(value.isNotNull(), F.size(F.filter(F.array(*map(F.lit, cut)), lambda x: x <= value))), F.lit(0))


def hilbert_shards(
    docs: DataFrame,
    dimensions: Sequence[str],
    shards: int,
    law: str = "rows",
    weight: Column | None = None,
    ties: Sequence[Column] = (),
    bits: int = BITS,
) -> DataFrame:
    """All columns of ``docs`` with ``curve`` (index), ``shard`` and ``slot`` (place in the shard, gapless from 0).

    Law ``rows``: shard sizes in rows are at most one apart. Law ``bytes``: runs of near equal ``weight``, which is
    a positive long; a row is in the shard in which its first unit falls. ``ties`` orders rows of one cell; rows equal in
    those too are interchangeable. Each dimension is quantised by cuts of the whole table into 2**bits parts of like many rows, in
    the order of its values (``cuts``); null, NaN and infinities are in cell 0. Repeated rows each have a slot. An empty table gives no rows. Columns named as the
    added ones are replaced.
    """
    kinds = dict(docs.dtypes)
    cut = cuts(docs, dimensions, bits)
    cells = [_quantised(c, kinds[c], cut[c]) for c in dimensions]
    rows = docs.withColumn("_cell", F.array(*(c.cast("int") for c in cells)))
    rows = rows.withColumn("curve", hilbert_index("_cell", len(cells), bits)).drop("_cell")
    unit = F.lit(1).cast("long") if law == "rows" else weight
    rows = running_sum(rows.withColumn("_weight", unit), [], [F.col("curve"), *ties], F.col("_weight"), "_upto")
    total = rows.agg(F.sum("_weight")).first()[0] or 1
    wide = "CAST({} AS DECIMAL(28,0))"
    before, whole, parts = wide.format("_upto - _weight"), wide.format(total), f"CAST({shards} AS DECIMAL(9,0))"
    rows = rows.withColumn("shard", F.expr(f"CAST({before} * {parts} DIV {whole} AS INT)"))
    if law == "rows":
        first = F.expr(f"({wide.format('shard')} * {whole} + {shards - 1}) DIV {parts}")
        return rows.withColumn("slot", F.col("_upto") - 1 - first).drop("_weight", "_upto")
    rows = stage(rows, "sharded")
    heads = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), [], [F.col("_upto"), *ties], F.col("_one"), "_place")
    firsts = heads.groupBy("shard").agg(F.min("_place").alias("_first"))
    return heads.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_place") - F.col("_first")).drop(
        "_weight", "_upto", "_one", "_place", "_first"
    )
