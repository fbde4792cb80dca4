"""A guarded ledger: a withdrawal above the balance is rejected, so each decision depends on all before it.

Moves are dealt in ranges of account and order. Within a range only the first account may have begun before; all
others are decided on the way. What the first one's moves do is kept as a function: the closing balance for
each opening one, which is piecewise opening + constant. The functions of an account's ranges are evaluated one
after the other, a search each, and give every range its opening balance; then its moves are decided, too. So an
account of any size is dealt over as many tasks as its rows need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.sources.tables import scratch_dir

#: Moves and pieces of a segment at most; a function with more is cut, and its moves go on in another segment.
MOVES, PIECES = 50_000, 1_000
#: Beyond any balance.
FAR = 1 << 61


class BalanceMap:
    """The closing balance for each opening one: opening + shift + offset of the piece that it lies in."""

    def __init__(self):
        self.starts, self.offsets, self.shift = np.array([-FAR]), np.array([0]), 0

    def move(self, units: int) -> None:
        if units >= 0:
            self.shift += units
            return
        least = -units - self.shift - self.offsets  # the least opening of each piece that covers the withdrawal
        ends = np.append(self.starts[1:], FAR)
        cut = np.clip(least, self.starts, ends)
        starts, offsets = np.empty((2, 2 * len(cut)), np.int64)
        starts[0::2], starts[1::2] = self.starts, cut
        offsets[0::2], offsets[1::2] = self.offsets, self.offsets + units
        some = np.empty(2 * len(cut), bool)
        some[0::2], some[1::2] = cut > self.starts, cut < ends
        starts, offsets = starts[some], offsets[some]
        new = np.concatenate(([True], offsets[1:] != offsets[:-1]))
        self.starts, self.offsets = starts[new], offsets[new]

    def table(self) -> tuple[list[int], list[int]]:
        return self.starts.tolist(), (self.offsets + self.shift).tolist()


def closing(opening: int, starts: np.ndarray, offsets: np.ndarray) -> int:
    return opening + int(offsets[np.searchsorted(starts, opening, "right") - 1])


def decide(balance: int, units: int | None) -> tuple[bool, int]:
    ok = units is not None and (units > 0 or (units < 0 and -units <= balance))
    return ok, balance + (units if ok else 0)


def _first_pass(width: int, first_opening: int):
    """Rows of a range (width columns and their units): decided ones, open ones with their segment, and notes for the chain."""

    def run(batches):
        from pyspark import TaskContext

        part, began, now, open_run = TaskContext.get().partitionId(), False, None, False
        balance, segment, moves, state, names = first_opening, 0, 0, None, None
        types = None

        def note(account, seg, end, pieces):
            row = [[account], *([None] for _ in range(width - 1)), [None], [1], [part], [seg], [None], [None], [end], [pieces and pieces[0]], [pieces and pieces[1]]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=names)

        def finish():
            """The note on the account that ends."""
            return note(now, segment, None, state.table()) if open_run else note(now, None, balance, None)

        for batch in batches:
            if types is None:
                types = [*(c.type for c in batch.columns), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = [*batch.schema.names, "kind", "part", "segment", "place", "accepted", "balance", "starts", "offsets"]
            segs, places, oks, after, notes = [], [], [], [], []
            for who, units in zip(batch.column(0).to_pylist(), batch.column(width).to_pylist()):
                if not began or who != now:
                    if began and open_run:
                        notes.append(finish())  # other accounts end in this range, and nothing follows
                    open_run = not began
                    began, now, balance, segment, moves, state = True, who, first_opening, 0, 0, BalanceMap()
                if not open_run:
                    ok, balance = decide(balance, units)
                    segs.append(None)
                    places.append(None)
                    oks.append(ok)
                    after.append(balance)
                    continue
                if moves == MOVES or len(state.starts) > PIECES:
                    notes.append(finish())
                    segment, moves, state = segment + 1, 0, BalanceMap()
                if units is not None:
                    state.move(units)
                segs.append(segment)
                places.append(moves)
                oks.append(None)
                after.append(None)
                moves += 1
            n = len(batch)
            made = [pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(segs, pa.int32()), pa.array(places, pa.int64()), pa.array(oks, pa.bool_()), pa.array(after, pa.int64()), pa.nulls(n, types[-2]), pa.nulls(n, types[-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)
            yield from notes
        if began:
            yield finish()

    return run


def _chain(first_opening: int):
    """(part, segment, opening) of every open segment from notes(account, segment, balance, starts, offsets, part) in order."""

    def run(batches):
        now, balance = None, first_opening
        for batch in batches:
            out = []
            accounts, segments, ends, starts, offsets, parts = (batch.column(i) for i in range(6))
            for i, who in enumerate(accounts.to_pylist()):
                if who != now:
                    now, balance = who, first_opening
                segment = segments[i].as_py()
                if segment is None:
                    balance = ends[i].as_py()
                    continue
                out.append((parts[i].as_py(), segment, balance))
                balance = closing(balance, starts[i].values.to_numpy(), offsets[i].values.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["part", "segment", "opening"])

    return run


def _second_pass(width: int):
    """accepted and balance of the moves of open segments, which come in order with their opening."""

    def run(batches):
        now, balance = None, 0
        for batch in batches:
            oks, after = [], []
            units, part, segment, opening = (batch.column(width + i).to_pylist() for i in range(4))
            for u, key, first in zip(units, zip(part, segment), opening):
                if key != now:
                    now, balance = key, first
                ok, balance = decide(balance, u)
                oks.append(ok)
                after.append(balance)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(oks, pa.bool_()), pa.array(after, pa.int64())], names=[*batch.schema.names[:width], "accepted", "balance"])

    return run


def ledger_guarded(moves: DataFrame, account: str, order: list[str], amount: str, opening: float = 0.0, digits: int = 2) -> DataFrame:
    """(account, order..., amount, accepted, balance): a withdrawal (a negative amount) above the balance is rejected.

    Amounts count to `digits` decimals, in whole numbers of the last one, so sums are exact. Amounts of 0, null or
    that are no numbers are rejected; rows without account are left out. Moves equal in account and order go in any order.
    """
    cols = [account, *order, amount]
    spark, width = moves.sparkSession, len(cols)
    unit = 10**digits
    units = F.round(F.col(amount).try_cast("decimal(30,8)") * F.lit(unit)).cast("long").alias("__units")
    names = [f"__{i}" for i in range(width)]  # columns may be called as the helpers are
    rows = moves.where(F.col(account).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip(cols, names)), units)
    fields = ", ".join(f"{n} {moves.schema[c].dataType.simpleString()}" for n, c in zip(names, cols))
    keys = names[:-1]
    first = int(round(opening * unit))

    path = scratch_dir(spark, "ledger")
    schema = f"{fields}, __units long, kind int, part long, segment int, place long, accepted boolean, balance long, starts array<long>, offsets array<long>"
    passed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_first_pass(width, first), schema)
    passed.write.parquet(path)
    table = spark.read.parquet(path)

    # a few notes for each range
    notes = table.where("kind = 1").select("__0", "segment", "balance", "starts", "offsets", "part")
    notes = notes.repartition("__0").sortWithinPartitions("__0", "part", "segment")
    openings = notes.mapInArrow(_chain(first), "part long, segment int, opening long")
    undecided = table.where("kind = 0 AND segment IS NOT NULL").join(openings, ["part", "segment"])
    undecided = undecided.select(*names, "__units", "part", "segment", "opening", "place").repartition("part", "segment").sortWithinPartitions("part", "segment", "place")
    late = undecided.mapInArrow(_second_pass(width), f"{fields}, accepted boolean, balance long")
    decided = table.where("kind = 0 AND segment IS NULL").select(*names, "accepted", "balance")
    return decided.union(late).withColumn("balance", F.col("balance") / unit).toDF(*cols, "accepted", "balance")
