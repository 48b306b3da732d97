"""Order books from snapshots and deltas: one sequential fold per instrument.

The same fold serves batch (rows streamed in sorted order through
``mapInPandas``) and streaming (``transformWithStateInPandas``): sequence
checks, buffering of deltas until a snapshot, gaps that end trust until the
next snapshot, zero quantities that delete a level.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_NEXT, RANGE_CONTAINS_NEXT, PREVIOUS_FINAL = "exact_next", "range_contains_next", "previous_final"
#: Deltas kept while there is no snapshot.
BUFFER = 4096

SCHEMA = (
    "instrument string, t long, seq long, status string, last_sequence long, best_bid double, best_bid_qty double, best_ask double, best_ask_qty double, "
    "bid_levels long, ask_levels long, gaps long, duplicates long"
)


def follows(policy: str, current: int, first: int, last: int, previous: int | None, first_replayed: bool) -> bool:
    """Whether a delta continues a book at sequence ``current``."""
    if policy == PREVIOUS_FINAL and not first_replayed:
        return previous == current
    if policy == EXACT_NEXT:
        return first == current + 1
    return first <= current + 1 <= last


@dataclass
class Book:
    """State of one instrument."""

    policy: str = RANGE_CONTAINS_NEXT
    depth: int = 1000
    bids: dict[float, float] = field(default_factory=dict)
    asks: dict[float, float] = field(default_factory=dict)
    sequence: int | None = None
    first_replayed: bool = False
    waiting: list = field(default_factory=list)
    gaps: int = 0
    duplicates: int = 0

    def _apply(self, levels, side: dict[float, float], best_first_descending: bool) -> None:
        for price, quantity in levels or ():
            if quantity == 0:
                side.pop(price, None)
            else:
                side[price] = quantity
        if len(side) > self.depth:
            for price in sorted(side, reverse=best_first_descending)[self.depth :]:
                del side[price]

    def snapshot(self, bids, asks, sequence: int) -> str:
        self.bids, self.asks = {}, {}
        self._apply(bids, self.bids, True)
        self._apply(asks, self.asks, False)
        self.sequence, self.first_replayed = sequence, True
        held, self.waiting = self.waiting, []
        status = self.classify()
        for delta in held:
            status = self.delta(*delta)
        return status

    def delta(self, bids, asks, first: int, last: int, previous: int | None) -> str:
        if self.sequence is None:
            if len(self.waiting) < BUFFER:
                self.waiting.append((bids, asks, first, last, previous))
                return "waiting"
            self.waiting = []
            return "overflow"
        if last <= self.sequence:
            self.duplicates += 1
            return "duplicate"
        if not follows(self.policy, self.sequence, first, last, previous, self.first_replayed):
            self.gaps += 1
            self.sequence, self.bids, self.asks = None, {}, {}
            return "gap"
        self._apply(bids, self.bids, True)
        self._apply(asks, self.asks, False)
        self.sequence, self.first_replayed = last, False
        return self.classify()

    def classify(self) -> str:
        if not self.bids or not self.asks:
            return "one_sided"
        bid, ask = max(self.bids), min(self.asks)
        return "crossed" if bid > ask else "locked" if bid == ask else "normal"

    def view(self, status: str) -> tuple:
        bid, ask = max(self.bids, default=None), min(self.asks, default=None)
        return (
            status, self.sequence, bid, self.bids.get(bid), ask, self.asks.get(ask), len(self.bids), len(self.asks), self.gaps, self.duplicates,
        )

    def to_json(self) -> str:
        state = {k: getattr(self, k) for k in ("sequence", "first_replayed", "waiting", "gaps", "duplicates")}
        return json.dumps(state | {"bids": list(self.bids.items()), "asks": list(self.asks.items())})

    def load(self, text: str) -> Book:
        state = json.loads(text)
        self.bids, self.asks = dict(map(tuple, state.pop("bids"))), dict(map(tuple, state.pop("asks")))
        for k, v in state.items():
            setattr(self, k, v)
        return self


def _levels(value) -> list[tuple[float, float]]:
    return [(float(x["price"]), float(x["qty"])) for x in value] if value is not None else []


def _step(book: Book, row) -> str:
    bids, asks = _levels(row.bids), _levels(row.asks)
    if row.kind == "snapshot":
        return book.snapshot(bids, asks, int(row.last_sequence))
    previous = None if pd.isna(row.previous_sequence) else int(row.previous_sequence)
    return book.delta(bids, asks, int(row.first_sequence), int(row.last_sequence), previous)


def replay(events: DataFrame, policy: str = RANGE_CONTAINS_NEXT, depth: int = 1000, partitions: int | None = None) -> DataFrame:
    """Book after each event, in order of ``(t, seq)`` within an instrument.
    ``events``: ``instrument``, ``t``, ``seq``, ``kind`` (snapshot or delta),
    ``bids``, ``asks`` (arrays of price and qty), ``first_sequence``,
    ``last_sequence``, ``previous_sequence``."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, book = None, Book(policy, depth)
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.instrument != now:
                    now, book = row.instrument, Book(policy, depth)
                out.append((row.instrument, row.t, row.seq, *book.view(_step(book, row))))
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            made = pd.DataFrame(out, columns=names)
            yield made.astype({"last_sequence": "Int64"})

    dealt = events.repartition(partitions, "instrument") if partitions else events.repartition("instrument")
    return dealt.sortWithinPartitions("instrument", "t", "seq").mapInPandas(fold, SCHEMA)


def processor(policy: str = RANGE_CONTAINS_NEXT, depth: int = 1000):
    """A stateful processor for ``groupBy('instrument').transformWithStateInPandas``:
    one value state per instrument.  Rows of a batch are ordered before they
    are applied; a late row is a duplicate or a gap, never a silent change."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("book", "json string")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            book = Book(policy, depth)
            if self.state.exists():
                book.load(self.state.get()[0])
            frame = pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable")
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            out = [(key[0], r.t, r.seq, *book.view(_step(book, r))) for r in frame.itertuples(index=False)]
            self.state.update((book.to_json(),))
            yield pd.DataFrame(out, columns=names).astype({"last_sequence": "Int64"})

        def close(self) -> None:
            pass

    return Processor()


def latest(views: DataFrame) -> DataFrame:
    """The newest view of each instrument."""
    return views.groupBy("instrument").agg(F.max_by(F.struct(*views.columns), F.struct("t", "seq")).alias("v")).select("v.*")
