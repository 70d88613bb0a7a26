"""Repair of conversations at the least cost, by layers of equal cost over sets of grammar states.

The turns that a repaired conversation may have are ``(s?(ua)+)?`` by the initials of their roles: a system turn
or none, then user and assistant in turn, or nothing at all. Rows may stay (0), get another role (1) or go (2), and
turns without text may be put in (5); a row with a fault of :data:`FAULTS` must go, or costs more.

1. A range sort gives every row its place; runs of up to ``run`` rows are the units of work, so that a
   conversation of any length is dealt to many tasks. Rows become codes of initial and fault.
2. For each cost from 0 a *layer* holds, for every place in a run, the set of states (bits) from which the
   run's rest can be repaired for no more than that cost; a layer follows from the layers 1, 2, 5 and 6 below it by shifts. All
   runs of a batch, and all states that a run may end in, advance at once. The first layer that holds a state is its cost.
3. From a conversation's last run to its first, costs of runs are added up (four numbers each), which gives what is left to pay behind each run.
4. Then the layers are traced from the first run to the last: of the edits on a cheapest way the one whose initial comes first in
   ASCII is taken. A state and a letter determine the next state, so the trace is the least audit.

Only steps 3 and 4 pass a conversation's runs one after the other, as streams of a few numbers per run; so does the hash
of its repaired text.

Defined results: a null role or text counts as one blank; a null id is a conversation of its own; null turn numbers come
first and do not count for gaps. Rows of equal number are ordered by role and text. A role without a letter, or with one
that is none of s, u and a (case counts), can only be changed or deleted. Gaps beyond 64 bits are the largest such number. An empty table gives an
empty result. Other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm.tables import apart_from_its_rows, numbered, settled, small_batches

#: Rows to a run.
RUN = 64
#: Costs: another role, deletion, insertion, and what a truncated row that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Faults; a row counts for the first that it has. The first two must go.
FAULTS = ("blank", "duplicate", "truncated")
# Initials with a meaning, the roles that an edit can give, and blanks and ends of sentences.
INITIALS = "sua"
ROLES = {2: "user", 3: "assistant"}
BLANKS, ENDS = " \t\n\v\f\r", ".!?"

#: States: nothing yet, after a system turn, after a user's, after an assistant's. The first and the last may end a conversation.
_ENDING = (0, 3)
#: Next state for each initial (s, u, a, other) and state; -1 for none.
_NEXT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: The state that an inserted or changed turn leads to.
_FORWARD = np.array([2, 2, 3, 2])
#: A row's code is three times its initial's number, and 1 more if it must go or 2 if it is truncated. Behind a run's end there is nothing.
_MUST, _CUT, _NOTHING = 1, 2, 12
_NEVER = 1 << 40
#: Runs that advance at once.
_TOGETHER = 512


def _before(states: np.ndarray, initial: int) -> np.ndarray:
    """The states from which a turn of that initial leads to one of ``states`` (four bits to a lane)."""
    if initial == 0:
        return states >> 1 & 0x1111
    if initial == 2:
        return states >> 1 & 0x4444
    after_user = states >> 2 & 0x1111
    return after_user | after_user << 1 | after_user << 3


def layers(codes: np.ndarray, final: np.ndarray) -> np.ndarray:
    """For each cost, place and run: the states from which the rest of the run, and then ``final``, costs no more.

    ``codes`` has a row for each run; ``final`` has for each run and lane the cost of each of the four states at the run's end.
    """
    n, length = codes.shape
    lanes = final.shape[1]
    most = 2 * length + 12 + int(np.where(final < _NEVER, final, 0).max(initial=0))
    bits = np.uint16(1) << np.arange(4 * lanes, dtype=np.uint16)
    flat = final.reshape(n, 4 * lanes)
    initial, kind = codes // 3, codes % 3
    none = np.zeros(n, np.uint16)
    out = np.zeros((most + 1, length + 1, n), np.uint16)
    at = lambda cost, place: out[cost, place] if cost >= 0 else none
    for cost in range(most + 1):
        for place in range(length, -1, -1):
            put_in = at(cost - INSERT, place)
            found = _before(put_in, 1) | _before(put_in, 2)
            if place == length:
                found = found | ((flat <= cost) * bits).sum(axis=1, dtype=np.uint16)
            else:
                first, fault = initial[:, place], kind[:, place]
                stay = np.where(fault == _CUT, at(cost - TRUNCATED, place + 1), out[cost, place + 1])
                other = np.where(fault == _CUT, at(cost - TRUNCATED - REROLE, place + 1), at(cost - REROLE, place + 1))
                kept = np.where(first == 0, _before(stay, 0), np.where(first == 1, _before(stay, 1), np.where(first == 2, _before(stay, 2), 0)))
                free = kept | _before(other, 1) | _before(other, 2)
                found = found | at(cost - DELETE, place + 1) | np.where(fault == _MUST, 0, free)
                found = np.where(codes[:, place] == _NOTHING, out[cost, place + 1], found)
            out[cost, place] = found
    return out


def _padded(codes: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(codes), max(map(len, codes), default=0)), _NOTHING, np.int64)
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


def _distinct(rows: list[bytes]) -> tuple[list[int], list[int]]:
    """One place of each different row, and for each row the number of its like: runs of the same codes are common."""
    number: dict[bytes, int] = {}
    of = [number.setdefault(r, len(number)) for r in rows]
    first = dict(zip(reversed(of), range(len(of) - 1, -1, -1), strict=True))
    return [first[k] for k in range(len(number))], of


def _in_groups(codes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Numbers of runs of about equal length, a bounded number at a time."""
    order = np.argsort([len(c) for c in codes], kind="stable")
    for low in range(0, len(order), _TOGETHER):
        yield order[low : low + _TOGETHER]


def run_costs(codes: list[np.ndarray]) -> np.ndarray:
    """For each run the least cost from each state at its begin to each at its end."""
    out = np.full((len(codes), 4, 4), _NEVER)
    one_each = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    for some in _in_groups(codes):
        ways = layers(_padded([codes[i] for i in some]), np.broadcast_to(one_each, (len(some), 4, 4)))[:, 0]
        for start in range(4):
            for end in range(4):
                there = ways >> (4 * end + start) & 1 == 1
                out[some, start, end] = np.where(there.any(axis=0), there.argmax(axis=0), _NEVER)
    return out


def traces(codes: list[np.ndarray], final: np.ndarray) -> Iterator[tuple[int, int, int, int, str, list[int], list[int]]]:
    """Of each run and start: run, start, cost (with what follows), state at the end, audit, and for each turn that is left the row's number (-1: put in) and the role's state (0: its own)."""
    for some in _in_groups(codes):
        own = [codes[i] for i in some]
        padded, lengths = _padded(own), np.array([len(c) for c in own])
        base = final[some].min(axis=1)
        rest = np.minimum(final[some] - base[:, None], _NEVER)
        ways = layers(padded, rest[:, None, :])
        run, state = np.repeat(np.arange(len(some)), 4), np.tile(np.arange(4), len(some))
        length, padded = lengths[run], np.append(padded, np.full((len(some), 1), _NOTHING), axis=1)
        holds = lambda cost, place, q: (cost >= 0) & (ways[np.maximum(cost, 0), np.minimum(place, ways.shape[1] - 1), run] >> np.maximum(q, 0) & 1 == 1) & (q >= 0)
        first = ways[:, 0, :][:, run] >> state & 1 == 1
        cost, reached = first.argmax(axis=0), first.any(axis=0)
        total, place = cost + base[run], np.zeros(len(run), np.int64)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            done = ~reached | ((place == length) & (rest[run, state] == cost))
            if done.all():
                break
            code = padded[run, place]
            inside, extra = (place < length), np.where(code % 3 == _CUT, TRUNCATED, 0)
            free = inside & (code % 3 != _MUST)
            ahead, kept = _FORWARD[state], _NEXT[np.minimum(code // 3, 3), state]
            options = [
                inside & holds(cost - DELETE, place + 1, state),
                holds(cost - INSERT, place, ahead),
                free & holds(cost - extra, place + 1, kept),
                free & holds(cost - extra - REROLE, place + 1, ahead),
            ]
            edit = np.where(done, 4, np.select(options, [0, 1, 2, 3], 4))
            taken.append((edit, place.copy(), np.where(edit == 2, 0, ahead)))
            cost = cost - np.select([edit == 0, edit == 1, edit == 2, edit == 3], [DELETE, INSERT, extra, extra + REROLE], 0)
            state = np.select([edit == 2, (edit == 1) | (edit == 3)], [kept, ahead], state)
            place = place + ((edit == 0) | (edit == 2) | (edit == 3))
        edits, places, roles = (np.array([x[k] for x in taken]).reshape(len(taken), len(run)).T for k in range(3))
        for i in np.flatnonzero(reached):
            e, left = edits[i], (edits[i] > 0) & (edits[i] < 4)
            audit = "".join("DIKR"[k] for k in e[e < 4].tolist())
            yield int(some[run[i]]), i % 4, int(total[i]), int(state[i]), audit, np.where(e == 1, -1, places[i])[left].tolist(), roles[i][left].tolist()


def _tasks(runs: DataFrame) -> int:
    return int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array(c, np.int64) for c in batch.column("codes").to_pylist()]


def _with_rest(runs: DataFrame) -> DataFrame:
    """``conv``, ``run``, ``codes`` and ``rest``: what each state at the run's end has still to pay."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(4, np.int64)
        over = np.array([0 if q in _ENDING else _NEVER for q in range(4)])
        for batch in batches:
            rest: list[np.ndarray] = []
            codes = _codes(batch)
            one_each, like = _distinct([c.tobytes() for c in codes])
            found = run_costs([codes[i] for i in one_each])[like]
            for conv, costs in zip(batch.column("conv").to_pylist(), found, strict=True):
                rest.append(carried if conv == last else over)
                last, carried = conv, np.minimum((costs + rest[-1]).min(axis=1), _NEVER)
            columns = [batch.column(c) for c in ("conv", "run", "codes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tolist() for x in rest], pa.list_(pa.int64()))], names=["conv", "run", "codes", "rest"])

    # All runs of a conversation pass one task, as a stream of small rows. They are few bytes and much work: Spark would join their tasks if it chose the number.
    light = runs.select("conv", "run", "codes").repartition(_tasks(runs), "conv").sortWithinPartitions("conv", F.desc("run"))
    return light.mapInArrow(add, "conv string, run long, codes array<int>, rest array<long>")


def _planned(runs: DataFrame) -> DataFrame:
    """``conv``, ``run``, ``cost`` (the conversation's, in its first run; else 0), ``audit``, ``illegal``, and ``rows`` and ``roles`` of the turns that are left."""
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True

    def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, initial = None, 0, 3
        for batch in batches:
            codes = _codes(batch)
            final = np.array(batch.column("rest").to_pylist(), np.int64).reshape(-1, 4)
            more = np.where(final < _NEVER, final - final.min(axis=1, keepdims=True), _NEVER)
            one_each, like = _distinct([c.tobytes() + m.tobytes() for c, m in zip(codes, more, strict=True)])
            found = {(x[0], x[1]): x[2:] for x in traces([codes[i] for i in one_each], more[one_each])}
            out: list[tuple] = []
            for i, conv in enumerate(batch.column("conv").to_pylist()):
                initials = codes[i] // 3
                bad = int((~legal[initials[:-1], initials[1:]]).sum())
                if conv != last:
                    state = 0
                elif len(initials):
                    bad += not legal[initial, initials[0]]
                cost, end, audit, rows, roles = found[like[i], state]
                out.append((cost + int(final[i].min()) if conv != last else 0, audit, bad, rows, [ROLES.get(r) for r in roles]))
                last, state, initial = conv, end, initials[-1]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("run"), *columns], names=["conv", "run", "cost", "audit", "illegal", "rows", "roles"])

    ordered = _with_rest(runs).repartition(_tasks(runs), "conv").sortWithinPartitions("conv", "run")
    return ordered.mapInArrow(plan, "conv string, run long, cost long, audit string, illegal long, rows array<int>, roles array<string>")


def _conv(conv_id: Column) -> Column:
    """A conversation's name, which null ids have as well."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("-"))


def _faults(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """All rows with ``conv``, their ``number`` in a total order and their ``fault`` (a place in ``FAULTS``, or null)."""
    rows = conversations.select(
        _conv(F.col(conv_col)).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    rows = numbered(rows, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "number")
    # A row is told by 256 bits of its role and text. The 64 bits are there for the join to be dealt by.
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("said", said).withColumn("key", F.xxhash64("conv", "said"))
    firsts = rows.groupBy("key", "conv", "said").agg(F.min("number").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(firsts.select(apart_from_its_rows("key"), "conv", "said", "first"), ["key", "conv", "said"], "left")
    stripped = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(stripped == "", 0).when(F.col("first") < F.col("number"), 1).when(~F.right(stripped, F.lit(1)).isin(*ENDS), 2)
    return rows.select("conv", "turn", "number", "role", "text", fault.alias("fault"))


def repaired_runs(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", run: int = RUN
) -> DataFrame:
    """A row for each run of rows of a conversation, in the order of ``run``.

    ``conv`` (its name: see :func:`_conv`), ``run``, ``turns`` (the rows), ``audit`` (the edits' initials), ``cost`` (the conversation's, in its first run), ``illegal`` and
    ``lines``: role and text of the turns that are left.
    """
    rows = _faults(conversations, conv_col, turn_col, role_col, text_col)
    initial = F.coalesce(*(F.when(F.left("role", F.lit(1)) == c, i) for i, c in enumerate(INITIALS)), F.lit(3))
    kind = F.when(F.col("fault") < 2, _MUST).when(F.col("fault") == 2, _CUT).otherwise(0)
    coded = rows.withColumn("code", (initial * 3 + kind).cast("int")).withColumn("run", F.floor(F.col("number") / run))
    gathered = coded.groupBy("conv", "run").agg(F.array_sort(F.collect_list(F.struct("number", "code", "turn", "role", "text", "fault"))).alias("turns"))
    runs = settled(gathered.withColumn("codes", F.col("turns.code")))
    planned = _planned(small_batches(runs))
    line = lambda row, role: F.struct(F.coalesce(role, F.get(F.col("turns.role"), row)).alias("role"), F.when(row < 0, "").otherwise(F.get(F.col("turns.text"), F.greatest(row, F.lit(0)))).alias("text"))
    return runs.join(planned, ["conv", "run"]).select("conv", "run", "turns", "audit", "cost", "illegal", F.zip_with("rows", "roles", line).alias("lines"))


def repaired_turns(conversations: DataFrame, **options: object) -> DataFrame:
    """The repaired conversations: ``conv_id`` (as a string), ``run`` and ``place`` (together the order), ``role`` and ``text``."""
    runs = repaired_runs(conversations, **options)
    named = F.when(F.startswith("conv", F.lit("=")), F.substring("conv", 2, 1 << 30)).alias("conv_id")
    return runs.select(named, "run", F.posexplode("lines").alias("place", "line")).select("conv_id", "run", "place", "line.role", "line.text")


def _digests(runs: DataFrame) -> DataFrame:
    """``conv`` and ``sha256`` of its lines ``role:text``, joined by line feeds; they pass one task as a stream."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running, some = None, hashlib.sha256(), False
        for batch in batches:
            done: list[tuple[str, str]] = []
            for conv, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "text", "n")), strict=True):
                if conv != last:
                    if last is not None:
                        done.append((last, running.hexdigest()))
                    last, running, some = conv, hashlib.sha256(), False
                if n:
                    running.update((("\n" if some else "") + text).encode())
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(2)], names=["conv", "sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([running.hexdigest()])], names=["conv", "sha256"])

    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    ordered = runs.select("conv", "run", text.alias("text"), F.size("lines").alias("n")).repartition("conv").sortWithinPartitions("conv", "run")
    return small_batches(ordered).mapInArrow(digest, "conv string, sha256 string")


def repair(conversations: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", **options: object) -> DataFrame:
    """Per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    ``ids`` may name more conversations (column ``conv_col``); those without a row have no faults and nothing to repair.
    """
    runs = settled(repaired_runs(conversations, conv_col=conv_col, **options))
    faults = F.col("turns.fault")
    number = lambda k: F.size(F.filter(faults, lambda x: x == k)).cast("bigint")
    counts = runs.groupBy("conv").agg(
        *(F.sum(number(k)).alias(c) for k, c in enumerate(FAULTS)),
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    turns = runs.select("conv", F.explode("turns.turn").alias("turn")).filter("turn IS NOT NULL").groupBy("conv", "turn").count()
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count("*"))
    gaps = turns.groupBy("conv").agg(F.least(gaps, wide(F.lit((1 << 63) - 1))).cast("bigint").alias("gaps"))
    named = (conversations if ids is None else ids).select(F.col(conv_col).alias("conv_id")).distinct().withColumn("conv", _conv(F.col("conv_id")))
    out = named.join(counts, "conv", "left").join(gaps, "conv", "left").join(_digests(runs), "conv", "left")
    zero = F.lit(0).cast("bigint")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` after faults that a hash of id and turn chooses: a row in twenty each goes, loses its text, loses its ends of sentences, comes twice, or becomes a user's."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chosen = F.crc32(F.concat(or_blank(conv_col), F.lit(":"), or_blank(turn_col))) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), or_blank(role_col).alias("role"), or_blank(text_col).alias("text"), chosen.alias("chosen"))
    rows = rows.filter("chosen <> 0").withColumn("copy", F.explode(F.when(F.col("chosen") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("chosen") == 1, "").when(F.col("chosen") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("chosen") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
