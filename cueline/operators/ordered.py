"""Places, running sums, next rows and last values along an order within items, for items of any size.

A window by item gathers an item's rows in one task. Here a range sort deals all rows by (item, order), so that an item
that holds a third of them is dealt to a third of the tasks. Each task passes its rows once and writes them with
what it knows from its own rows. One row for each task says what its first and last items bring across its borders; added up in
order, these are the carries, which every task's rows may have, as they are as few as the tasks.

The rows are written to the folder that the cluster shares before they are read with their carries, so that a lost executor or a
second sort cannot change which rows a task had.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from cueline.functions.workers import reach_package, written


def apart(columns: Iterable[str], *names: str) -> dict[str, str]:
    """A name for each of ``names`` that none of ``columns`` has (compared without case)."""
    taken, out = {c.lower() for c in columns}, {}
    for name in names:
        out[name] = next(x for x in (f"_{name}{'_' * i}" for i in range(1, len(taken) + 3)) if x.lower() not in taken)
    return out


def _opens(item: pa.Array) -> np.ndarray:
    """Whether each row but the first is of another item than the row before; nulls are one item."""
    if len(item) < 2:
        return np.zeros(0, bool)
    a, b = item.slice(0, len(item) - 1), item.slice(1)
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return other | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def _flat(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def _passed(rows: DataFrame, item: str, place: str, sums: Mapping[str, str], leads: Mapping[str, str], fills: Mapping[str, str], source: str | None, has: str, part: str, at: str) -> DataFrame:
    """The sorted rows with what their task knows of them: see :func:`in_order`."""
    schema = StructType(list(rows.schema.fields)).add(place, LongType())
    for name in sums:
        schema = schema.add(name, LongType())
    for names in (leads, fills):
        for name, column in names.items():
            schema = schema.add(name, rows.schema[column].dataType)
    schema = schema.add(has, BooleanType()).add(part, LongType()).add(at, LongType())
    taken, told_names = rows.columns, schema.fieldNames()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        seen, waiting = 0, None  # rows that were passed on, and the last row, which waits for its next one
        last, count, totals = None, 0, dict.fromkeys(sums, 0)  # item, rows and sums up to the last row passed on
        filled: dict[str, pa.Array] | None = None

        def told(table: pa.Table, more: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            nonlocal seen, last, count, totals, filled
            n = table.num_rows - more  # the last row of ``more`` only shows what comes next
            own = _flat(table.column(item))
            opens = np.append(True if last is None else bool(_opens(pa.concat_arrays([last, own.slice(0, 1)]))[0]), _opens(own))[:n]
            begins = np.flatnonzero(opens)
            group = np.cumsum(opens) - 1  # -1: goes on from before
            start = np.where(group >= 0, begins[np.maximum(group, 0)] if len(begins) else 0, 0)
            columns = [_flat(table.column(c)).slice(0, n) for c in taken]
            columns.append(pa.array(np.arange(n) - start + np.where(group < 0, count, 0)))
            for name, column in sums.items():
                value = pc.fill_null(table.column(column), 0).to_numpy()[:n].astype(np.int64)
                before = np.cumsum(value) - value
                run = before - before[start] + np.where(group < 0, totals[name], 0)
                columns.append(pa.array(run))
                totals[name] = int(run[-1] + value[-1])
            for column in leads.values():
                ahead = np.arange(1, n + 1)
                other = np.append(_opens(own), True)[:n]
                columns.append(_flat(table.column(column)).take(pa.array(np.where(other, 0, ahead), mask=other)))
            found = np.zeros(n, bool)
            if source is not None:
                marks = pc.fill_null(table.column(source), False).to_numpy()[:n].astype(bool)
                at_mark = np.maximum.accumulate(np.where(marks, np.arange(n), -1))
                inside = at_mark >= start
                carried = (group < 0) & ~inside & (filled is not None)
                found = inside | carried
                index = pa.array(np.where(inside, at_mark + 1, 0), mask=~found)
                fresh = {}
                for name, column in fills.items():
                    values = _flat(table.column(column)).slice(0, n)
                    head = filled[name] if filled is not None else values.slice(0, 1)
                    columns.append(pa.concat_arrays([head, values]).take(index))
                    fresh[name] = columns[-1].slice(n - 1, 1)
                filled = fresh if found[-1] else None
            columns += [pa.array(found), pa.array(np.full(n, number)), pa.array(np.arange(seen, seen + n))]
            last, count, seen = own.slice(n - 1, 1), int(columns[len(taken)][-1].as_py()) + 1, seen + n
            return pa.RecordBatch.from_arrays(columns, names=told_names), table.slice(n) if more else None

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                waiting = table if waiting is None else pa.concat_tables([waiting, table])
                if waiting.num_rows > 1:
                    out, waiting = told(waiting, True)
                    yield out
        if waiting is not None:
            yield told(waiting, False)[0]

    reach_package(rows.sparkSession)
    return rows.mapInArrow(scan, schema)


def in_order(
    df: DataFrame,
    item: str,
    order: Sequence[Column | str],
    place: str | None = None,
    sums: Mapping[str, str] | None = None,
    leads: Mapping[str, str] | None = None,
    fills: Mapping[str, str] | None = None,
    source: str | None = None,
) -> DataFrame:
    """``df`` with results along ``order`` within each ``item`` (a column; null is an item).

    ``place`` names the row's place from 0. ``sums`` maps a name to a whole-number column: its sum over the
    rows before (null counts 0). ``leads`` maps a name to a column: its value in the next row, or null. ``fills`` maps a name to a column: its value in the last row up
    to this one for which the boolean column ``source`` is true, or null. Rows that tie in ``order`` are in some order. An empty table gives an empty result.
    """
    sums, leads, fills = dict(sums or {}), dict(leads or {}), dict(fills or {})
    columns = list(df.columns)
    n = apart([*columns, *sums, *leads, *fills, place or ""], "place", "from", "has", "part", "at")
    own = place or n["place"]
    # Rows that tie are parted by where they came from, so that many of them do not meet in one task.
    keyed = df.withColumn(n["from"], F.monotonically_increasing_id()).orderBy(F.col(item).asc_nulls_first(), *order, n["from"]).drop(n["from"])
    table = written(_passed(keyed, item, own, sums, leads, fills, source, n["has"], n["part"], n["at"]))

    part, at, first, last = n["part"], n["at"], "first_item", "last_item"
    held = {f"s{i}": (name, column) for i, (name, column) in enumerate(sums.items())}
    ends = table.groupBy(F.col(part).alias("part")).agg(
        F.min_by(F.struct(item), at).alias(first),
        F.max_by(F.struct(item), at).alias(last),
        F.max(at).alias("end"),
        (F.max_by(own, at) + 1).alias("n"),
        *(F.max_by(F.col(name) + F.coalesce(F.col(column), F.lit(0)), at).alias(s) for s, (name, column) in held.items()),
        F.min_by(F.struct(*(F.col(c).alias(f"l{i}") for i, c in enumerate(leads.values())), F.lit(0).alias("any")), at).alias("ahead"),
        F.max_by(F.when(F.col(n["has"]), F.struct(*(F.col(c).alias(f"f{i}") for i, c in enumerate(fills)), F.lit(0).alias("any"))), at).alias("kept"),
    )
    # One row for each task of the sort.
    so_far = Window.partitionBy(last).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sides = Window.orderBy("part")
    carried = ends.select("*", *(F.sum(c).over(so_far).alias(f"{c}_all") for c in ("n", *held)), F.last("kept", ignorenulls=True).over(so_far).alias("kept_all"))
    same = F.lag(last).over(sides).eqNullSafe(F.col(first))
    goes_on = F.lead(first).over(sides).eqNullSafe(F.col(last))
    carries = carried.select(
        "part", "end", F.col(first)[item].alias("of"),
        *(F.when(same, F.lag(f"{c}_all").over(sides)).alias(f"{c}_in") for c in ("n", *held)),
        F.when(same, F.lag("kept_all").over(sides)).alias("kept_in"),
        F.when(goes_on, F.lead("ahead").over(sides)).alias("ahead_in"),
    )
    names = {c: f"{part}_{c}" for c in carries.columns}
    joined = table.join(F.broadcast(carries.select(*(F.col(c).alias(names[c]) for c in carries.columns))), F.col(part) == F.col(names["part"]))
    here = F.col(item).eqNullSafe(F.col(names["of"]))
    plus = lambda name, c: (F.col(name) + F.when(here, F.coalesce(F.col(names[f"{c}_in"]), F.lit(0))).otherwise(0)).alias(name)
    border = F.col(at) == F.col(names["end"])
    out = [F.col(c) for c in columns] + ([plus(place, "n")] if place else [])
    out += [plus(name, s) for s, (name, _) in held.items()]
    out += [F.when(border, F.col(names["ahead_in"])[f"l{i}"]).otherwise(F.col(name)).alias(name) for i, name in enumerate(leads)]
    out += [F.when(~F.col(n["has"]) & here, F.col(names["kept_in"])[f"f{i}"]).otherwise(F.col(name)).alias(name) for i, name in enumerate(fills)]
    return joined.select(*out)


def as_of(
    left: DataFrame,
    right: DataFrame,
    item: str,
    time: str,
    values: Sequence[str],
    order: Sequence[str] = (),
    tolerance: Column | None = None,
    earlier: bool = False,
    matched: str | None = None,
) -> DataFrame:
    """Rows of ``left`` with ``values`` of the last row of ``right`` of the same ``item`` at their ``time`` or before; null where there is none.

    With ``earlier`` it has to be before. Of right rows of one time the last by ``order`` counts. ``tolerance``
    is an interval (or number, as ``time`` is) that the right row's time may lie back. ``matched`` names a column for the right row's time. A null time matches nothing. Rows of both
    sides are sorted as one table, so that neither has to fit a task.
    """
    n = apart([*left.columns, *right.columns, matched or ""], "right", "row", "found", "order", "time")
    kind = dict(left.dtypes)[item]
    keys = [F.col(c).alias(f"{n['order']}{i}") for i, c in enumerate(order)]
    none = [F.lit(None).cast(dict(right.dtypes)[c]).alias(f"{n['order']}{i}") for i, c in enumerate(order)]
    own = F.struct(*(F.col(c) for c in left.columns))
    theirs = F.struct(F.col(time).alias(n["time"]), *(F.col(c).alias(f"v{i}") for i, c in enumerate(values)))
    a = left.select(F.col(item).alias(item), F.col(time).alias(n["time"]), *none, F.lit(False).alias(n["right"]), own.alias(n["row"]))
    b = right.filter(F.col(time).isNotNull()).select(F.col(item).cast(kind).alias(item), F.col(time).alias(n["time"]), *keys, F.lit(True).alias(n["right"]), theirs.alias(n["found"]))
    both = a.withColumn(n["found"], F.lit(None).cast(b.schema[n["found"]].dataType)).unionByName(b.withColumn(n["row"], F.lit(None).cast(a.schema[n["row"]].dataType)))
    side = F.col(n["right"]).asc() if earlier else F.col(n["right"]).desc()
    placed = in_order(both, item, [n["time"], side, *(f"{n['order']}{i}" for i in range(len(order)))], fills={f"{n['found']}f": n["found"]}, source=n["right"])
    found = F.col(f"{n['found']}f")
    fits = F.col(n["time"]).isNotNull() & F.col(item).isNotNull()
    if tolerance is not None:
        fits = fits & (F.col(n["time"]) <= found[n["time"]] + tolerance)
    rows = placed.filter(~F.col(n["right"])).select(n["row"], F.when(fits, found).alias(n["found"]))
    time_too = [F.col(n["found"])[n["time"]].alias(matched)] if matched else []
    return rows.select(f"{n['row']}.*", *time_too, *(F.col(n["found"])[f"v{i}"].alias(c) for i, c in enumerate(values)))
