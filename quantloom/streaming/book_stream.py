"""The order book as a stateful stream: a state for each connection, level by level, equal to the batch replay."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantloom.operators.book import Book, BookError, Session, Side

OUT = "connection_id string, product string, updates long, errors long, digest string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENCODING = "spark.sql.streaming.stateStore.encodingFormat"
#: What the state of a connection holds. With the Avro encoding, fields may be added at the end later.
CONNECTION = "sequence long, beat long, errors long, stale boolean"
BOOK = "ready boolean, updates long, time string, beat long"


class BookProcessor(StatefulProcessor):
    """Levels, books and the connection's counters as typed states: a batch writes the levels that its messages touched, not
    the whole book. stale_ms: a connection without messages for so long loses its books; only its errors stay."""

    def __init__(self, products: list[str] | None = None, stale_ms: int | None = None) -> None:
        self.products, self.stale_ms = products, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.connection = handle.getValueState("connection", CONNECTION)
        self.books = handle.getMapState("books", "product string", BOOK)
        self.levels = handle.getMapState("levels", "product string, side string, price string", "size string")

    def loaded(self) -> tuple[Session, int]:
        session, errors = Session(self.products), 0
        if self.connection.exists():
            session.sequence, session.beat, errors, *_ = self.connection.get()
        for (product,), (ready, updates, time, beat) in self.books.iterator():
            book = session.books[product] = Book()
            book.ready, book.updates, book.beat, book.time = ready, updates, beat, time and datetime.fromisoformat(time)
        sides: dict[tuple[str, str], dict[Decimal, Decimal]] = {}
        for (product, side, price), (size,) in self.levels.iterator():
            sides.setdefault((product, side), {})[Decimal(price)] = Decimal(size)
        for (product, side), levels in sides.items():
            session.books[product].sides[side] = Side(levels)
        return session, errors

    def stored(self, session: Session, errors: int, before: dict[tuple[str, str], Side]) -> None:
        """Write what differs from the sides loaded before."""
        self.connection.update(self.counters(session, errors))
        for product, book in session.books.items():
            self.books.updateValue((product,), (book.ready, book.updates, book.time and book.time.isoformat(), book.beat))
            for name, side in book.sides.items():
                old = before.get((product, name))
                gone = set() if old is side or old is None else {*old.sizes} | old.touched
                for price in (side.touched if old is side else {*side.sizes} | side.touched | gone):
                    key = product, name, str(price)
                    if price in side.sizes:
                        self.levels.updateValue(key, (str(side.sizes[price]),))
                    elif self.levels.containsKey(key):
                        self.levels.removeKey(key)

    def counters(self, session: Session, errors: int) -> tuple:
        return session.sequence, session.beat, errors, False

    def forget(self) -> None:
        self.books.clear()
        self.levels.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, errors = self.loaded()
        before = {(p, n): s for p, b in session.books.items() for n, s in b.sides.items()}
        for row in pd.concat(list(rows)).sort_values("line").itertuples():
            if row.event == "connection_start":
                session, errors, before = Session(self.products), 0, {}
                self.forget()
            elif row.event == "message":
                try:
                    session.apply(row.raw_text)
                except BookError:
                    errors += 1
        self.stored(session, errors, before)
        if self.stale_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)
        out = [(key[0], p, b.updates, errors, b.digest()) for p, b in sorted(session.books.items()) if b.ready]
        yield pd.DataFrame(out, columns=["connection_id", "product", "updates", "errors", "digest"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        errors = self.connection.get()[2]
        self.forget()
        self.connection.update((None, None, errors, True))
        yield pd.DataFrame([(key[0], None, None, errors, None)], columns=["connection_id", "product", "updates", "errors", "digest"])

    def close(self) -> None:
        pass


def book_states(log: DataFrame, products: list[str] | None = None, stale_ms: int | None = None) -> DataFrame:
    """connection_id, product, updates, errors, digest after each micro-batch of a streaming log (line, event, raw_text).

    A connection's messages must arrive in order of their lines across batches; inside a batch they are sorted. A connection
    without messages for stale_ms gives a row without product, and starts anew with its next snapshot. Typed states need the
    session's RocksDB state store: it is chosen here unless the session names another.
    """
    conf = log.sparkSession.conf
    if "RocksDB" not in conf.get(PROVIDER, ""):
        conf.set(PROVIDER, ROCKSDB)
        conf.set(ENCODING, "avro")
    return stateful(log, BookProcessor(products, stale_ms))


def stateful(log: DataFrame, processor: BookProcessor) -> DataFrame:
    keyed = log.where("connection_id is not null").groupBy("connection_id")
    return keyed.transformWithStateInPandas(processor, OUT, "Update", "None" if processor.stale_ms is None else "ProcessingTime")
