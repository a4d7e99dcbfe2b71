"""Level-2 order books: ordered replay of feed logs, last levels by aggregation, top levels."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scans import running_sums, span_of

EVENT_SCHEMA = "line long, event string, received_at_utc string, connection_id string, reason string, raw_text string"
ROWS_SCHEMA = "source string, epoch long, line long, product string, side string, level int, price decimal(38,18), size decimal(38,18), updates long"
TOPS_SCHEMA = "source string, epoch long, product string, side string, level int, price decimal(38,18), size decimal(38,18)"
COUNTS_SCHEMA = "source string, epoch long, messages long, snapshots long, updates long, heartbeats long, errors long"
STATE_SCHEMA = "source string, epoch long, product string, ready boolean, updates long, errors long, last_error string, digest string"


class BookError(ValueError):
    """A message that breaks the feed's rules; the book stays as it was."""


def decimal(text: object, zero: bool = False) -> Decimal:
    try:
        value = Decimal(str(text))
    except InvalidOperation:
        raise BookError(f"not a number: {text!r}") from None
    if not value.is_finite() or value < 0 or (value == 0 and not zero):
        raise BookError(f"out of range: {text!r}")
    return value


def event_time(text: object) -> datetime:
    """A UTC time of the feed, to the microsecond."""
    if not isinstance(text, str):
        raise BookError("no time")
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise BookError(f"not a time: {text!r}") from None
    if found.utcoffset() != timedelta(0):
        raise BookError(f"not a time in UTC: {text!r}")
    return found


def whole(value: object, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise BookError(f"no {what}: {value!r}")
    return value


def rows_of(value: object, width: int, what: str, empty: bool = False) -> list:
    """A list of lists of so many values."""
    if not isinstance(value, list) or not (value or empty) or any(not isinstance(x, list) or len(x) != width for x in value):
        raise BookError(f"malformed {what}")
    return value


def canonical(value: Decimal) -> str:
    """A price or size without trailing zeros: equal values have equal texts."""
    text = format(value.normalize(), "f")
    return text if text != "-0" else "0"


class Side:
    """One side of a book: its sizes by price, its prices in order, and the prices that messages touched."""

    def __init__(self, levels: dict[Decimal, Decimal] | None = None) -> None:
        self.sizes = dict(levels or {})
        self.prices = sorted(self.sizes)
        self.touched: set[Decimal] = set()

    def put(self, price: Decimal, size: Decimal | None) -> Decimal | None:
        """Set a size, or remove it by None; returns what stood there."""
        old = self.sizes.get(price)
        self.touched.add(price)
        if size is None:
            if old is not None:
                del self.sizes[price], self.prices[bisect_left(self.prices, price)]
        else:
            if old is None:
                insort(self.prices, price)
            self.sizes[price] = size
        return old


class Book:
    """Both sides of one product; every message applies whole or not at all. What a message changes is noted in undo, so that
    it costs its own levels and not the book's."""

    def __init__(self) -> None:
        self.sides = {"bid": Side(), "ask": Side()}
        self.ready, self.updates, self.time, self.beat = False, 0, None, None

    def snapshot(self, levels: list[tuple[str, object, object]], time: datetime | None = None, undo: list | None = None) -> None:
        given: dict[str, dict[Decimal, Decimal]] = {"bid": {}, "ask": {}}
        for side, price, size in levels:
            at = decimal(price)
            if at in given[side]:
                raise BookError("a price comes twice")
            given[side][at] = decimal(size)
        sides = {k: Side(v) for k, v in given.items()}
        self.checked(sides)
        if undo is not None:
            undo.append(partial(self.__dict__.update, self.__dict__.copy()))
        self.sides, self.ready, self.updates, self.time = sides, True, 0, time

    def update(self, levels: list[tuple[str, object, object]], time: datetime, undo: list | None = None) -> None:
        if not self.ready:
            raise BookError("update before snapshot")
        if self.time is not None and time < self.time:
            raise BookError("time goes back")
        changes = [(self.sides[side], decimal(price), decimal(size, zero=True)) for side, price, size in levels]
        done: list = [(side, price, side.put(price, size or None)) for side, price, size in changes]

        def back(before: tuple = (self.time, self.updates)) -> None:
            for side, price, old in reversed(done):
                side.put(price, old)
            self.time, self.updates = before

        try:
            self.checked(self.sides)
        except BookError:
            back()
            raise
        if undo is not None:
            undo.append(back)
        self.time, self.updates = time, self.updates + 1

    @staticmethod
    def checked(sides: dict[str, Side]) -> None:
        if not sides["bid"].prices or not sides["ask"].prices:
            raise BookError("one side is empty")
        if sides["bid"].prices[-1] >= sides["ask"].prices[0]:
            raise BookError("the book is crossed")

    def top(self, depth: int) -> list[tuple[str, int, Decimal, Decimal]]:
        """(side, level from 1, price, size): bids from the highest, asks from the lowest."""
        out = []
        for side, down in (("bid", True), ("ask", False)):
            held = self.sides[side]
            prices = held.prices[::-1][:depth] if down else held.prices[:depth]
            out += [(side, k, p, held.sizes[p]) for k, p in enumerate(prices, 1)]
        return out

    def digest(self) -> str:
        """SHA-256 of all levels in price order, as canonical text."""
        levels = [[s, canonical(p), canonical(q)] for s in ("bid", "ask") for p, q in sorted(self.sides[s].sizes.items())]
        return hashlib.sha256(json.dumps(levels).encode()).hexdigest()


class Session:
    """One connection: its products' books, the connection-wide sequence and the heartbeat counter. A gap stays: the last
    good number does not move, so that every later message fails until a new connection. A message of several events
    applies to all of its books or to none; its sequence number counts either way."""

    def __init__(self, products: list[str] | None = None) -> None:
        self.books: dict[str, Book] = {}
        self.products, self.sequence, self.beat = products, None, None

    def apply(self, text: object) -> list[tuple[str, str]]:
        """Apply one feed text; returns (product, snapshot, update or heartbeat) of what it held. What is malformed raises."""
        if not isinstance(text, str):
            raise BookError("no text")
        try:
            message = json.loads(text)
        except ValueError:
            raise BookError("not JSON") from None
        if not isinstance(message, dict):
            raise BookError("not an object")
        return self.envelope(message) if "channel" in message else self.plain(message)

    def known(self, product: object) -> bool:
        return isinstance(product, str) and (self.products is None or product in self.products)

    def envelope(self, message: dict) -> list[tuple[str, str]]:
        channel, number = message["channel"], message.get("sequence_num")
        if number is not None:
            number = whole(number, "sequence number")
            if self.sequence is not None and number != self.sequence + 1:
                raise BookError(f"sequence gap: {self.sequence} to {number}")
            self.sequence = number
        if channel not in ("l2_data", "heartbeats"):
            return []
        if number is None:
            raise BookError("no sequence number")
        events = message.get("events")
        if not isinstance(events, list) or not events or any(not isinstance(x, dict) for x in events):
            raise BookError("malformed events")
        if channel == "heartbeats":
            for event in events:
                beat = whole(event.get("heartbeat_counter"), "heartbeat counter")
                if self.beat is not None and beat != self.beat + 1:
                    raise BookError("heartbeat gap")
                self.beat = beat
            return [("", "heartbeat")] * len(events)
        time, undo, done = event_time(message.get("timestamp")), [], []
        try:
            for event in events:
                product, kind, levels = event.get("product_id"), event.get("type"), event.get("updates")
                if not self.known(product):
                    continue
                if kind not in ("snapshot", "update") or not isinstance(levels, list) or not levels:
                    raise BookError("malformed event")
                if any(not isinstance(x, dict) or x.get("side") not in ("bid", "offer") for x in levels):
                    raise BookError("malformed level")
                if product not in self.books:
                    self.books[product] = Book()
                    undo.append(partial(self.books.pop, product))
                book = self.books[product]
                changes = [("bid" if x["side"] == "bid" else "ask", x.get("price_level"), x.get("new_quantity")) for x in levels]
                (book.snapshot if kind == "snapshot" else book.update)(changes, time, undo)
                done.append((product, kind))
        except BookError:
            for back in reversed(undo):
                back()
            raise
        return done

    def plain(self, message: dict) -> list[tuple[str, str]]:
        product, kind = message.get("product_id"), message.get("type")
        if not self.known(product):
            return []
        book = self.books.setdefault(product, Book())
        if kind == "snapshot":
            book.snapshot([(side, *x) for side, key in (("bid", "bids"), ("ask", "asks")) for x in rows_of(message.get(key), 2, "snapshot", True)])
            return [(product, "snapshot")]
        if kind == "l2update":
            changes = rows_of(message.get("changes"), 3, "changes")
            if not book.ready:
                raise BookError("update before snapshot")
            time = event_time(message.get("time"))
            if any(x[0] not in ("buy", "sell") for x in changes):
                raise BookError("malformed changes")
            book.update([("bid" if x[0] == "buy" else "ask", *x[1:]) for x in changes], time)
            return [(product, "update")]
        if kind == "heartbeat":
            beat = whole(message.get("sequence"), "heartbeat sequence")
            if book.beat is not None and beat < book.beat:
                raise BookError("heartbeat goes back")
            book.beat = beat
            return [(product, "heartbeat")]
        return []


    def written(self) -> str:
        """The session as JSON of plain values."""
        books = {p: {"sides": {s: [[str(x), str(q)] for x, q in v.sizes.items()] for s, v in b.sides.items()}, "ready": b.ready, "updates": b.updates, "time": b.time and b.time.isoformat(), "beat": b.beat} for p, b in self.books.items()}
        return json.dumps({"products": self.products, "sequence": self.sequence, "beat": self.beat, "books": books})

    @staticmethod
    def read(text: str) -> Session:
        told = json.loads(text)
        out = Session(told["products"])
        out.sequence, out.beat = told["sequence"], told["beat"]
        for product, x in told["books"].items():
            book = out.books[product] = Book()
            book.sides = {s: Side({Decimal(p): Decimal(q) for p, q in v}) for s, v in x["sides"].items()}
            book.ready, book.updates, book.beat = x["ready"], x["updates"], x["beat"]
            book.time = x["time"] and datetime.fromisoformat(x["time"])
        return out


#: A source's lines are counted in segments of so many.
LINES = 1 << 20


def with_epoch(log: DataFrame) -> DataFrame:
    """log (source, line, event) with epoch: how many connections its source has begun up to the line. A long source is
    counted in segments of LINES lines, in as many tasks."""
    started = (F.col("event") == "connection_start").cast("long")
    return running_sums(log, ["source"], {"lines": span_of("line", LINES)}, ["line"], {"epoch": started})


class Pass:
    """One connection's messages in order, with what is counted of them."""

    def __init__(self, source: str, epoch: int, products: list[str] | None) -> None:
        self.source, self.epoch, self.session = source, epoch, Session(products)
        self.errors, self.last_error, self.messages, self.snapshots, self.updates, self.heartbeats = 0, None, 0, 0, 0, 0

    def message(self, line: int, text: str | None) -> list[tuple[str, str]]:
        self.messages += 1
        try:
            done = self.session.apply(text)
        except BookError as wrong:
            self.errors, self.last_error = self.errors + 1, f"{line}: {wrong}"
            return []
        for _, kind in done:
            self.snapshots += kind == "snapshot"
            self.updates += kind == "update"
            self.heartbeats += kind == "heartbeat"
        return done


def passes(log: DataFrame, products: list[str] | None, schema: str, each: Callable[[Pass, int, list[tuple[str, str]]], list[tuple]], end: Callable[[Pass], list[tuple]]) -> DataFrame:
    """One ordered pass over every connection of a log (source, line, event, raw_text): rows of schema from each message (each)
    and from each connection's end. Connections are dealt out by source and epoch and sorted in their partition; a task runs
    through one after another and holds the books of one."""
    names = [part.split()[0] for part in schema.replace("decimal(38,18)", "decimal").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Pass | None = None
        for batch in batches:
            out: list[tuple] = []
            for source, epoch, line, event, text in zip(*(batch[c] for c in ("source", "epoch", "line", "event", "raw_text")), strict=True):
                if now is None or (source, epoch) != (now.source, now.epoch):
                    out += end(now) if now else []
                    now = Pass(source, epoch, products)
                if event == "message":
                    out += each(now, line, now.message(line, text))
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None and (out := end(now)):
            yield pd.DataFrame(out, columns=names)

    rows = with_epoch(log.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "line", "event", "raw_text"))
    return rows.repartition("source", "epoch").sortWithinPartitions("source", "epoch", "line").mapInPandas(run, schema)


def replay(log: DataFrame, products: list[str] | None = None, depth: int = 5, every: int = 1) -> DataFrame:
    """Top levels after each snapshot and each every-th update of a log. Bad lines change nothing; a null source is ''."""

    def each(p: Pass, line: int, done: list[tuple[str, str]]) -> list[tuple]:
        out = []
        for product, kind in done:
            book = p.session.books.get(product)
            if kind == "snapshot" or (kind == "update" and book.updates % every == 0):
                out += [(p.source, p.epoch, line, product, *level, book.updates) for level in book.top(depth)]
        return out

    return passes(log, products, ROWS_SCHEMA, each, lambda p: [])


def last_tops(log: DataFrame, products: list[str] | None = None, depth: int = 5) -> DataFrame:
    """source, epoch, product, side, level, price, size: top levels at the end of each connection."""
    end = lambda p: [(p.source, p.epoch, x, *level) for x, b in sorted(p.session.books.items()) if b.ready for level in b.top(depth)]
    return passes(log, products, TOPS_SCHEMA, lambda *_: [], end)


def final_states(log: DataFrame, products: list[str] | None = None) -> DataFrame:
    """source, epoch, product, ready, updates, errors (of the connection), last_error, digest at the end of each connection of
    each source. Messages that break a rule count as errors and change nothing."""
    end = lambda p: [(p.source, p.epoch, x, b.ready, b.updates, p.errors, p.last_error, b.digest() if b.ready else None) for x, b in sorted(p.session.books.items())]
    return passes(log, products, STATE_SCHEMA, lambda *_: [], end)


def session_counts(log: DataFrame, products: list[str] | None = None) -> DataFrame:
    """source, epoch, messages, snapshots, updates, heartbeats, errors of each connection."""
    end = lambda p: [(p.source, p.epoch, p.messages, p.snapshots, p.updates, p.heartbeats, p.errors)]
    return passes(log, products, COUNTS_SCHEMA, lambda *_: [], end)


def session_verdict(counts: DataFrame) -> DataFrame:
    """source, connections, messages, errors, ok: a source is good if messages came, none broke a rule and it never began a
    connection anew."""
    out = counts.where("epoch > 0").groupBy("source").agg(F.count("*").alias("connections"), F.sum("messages").alias("messages"), F.sum("errors").alias("errors"))
    return out.withColumn("ok", (F.col("messages") > 0) & (F.col("errors") == 0) & (F.col("connections") == 1))


def sequence_gaps(rows: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """Rows whose number is not one more than the row before in the keys."""
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("previous", before).where(F.col(number) != F.col("previous") + 1)


def last_levels(changes: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """Standing levels of absolute size changes (keys, price, size): the last size of each price, 0 deletes. Needs no order
    of rows: one aggregation with map-side combining."""
    last = changes.groupBy(*keys, "price").agg(F.max_by("size", order).alias("size"))
    return last.where("size > 0")


def top_levels(levels: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The best levels of each side, numbered from 1: bids by falling, asks by rising price."""
    price = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return levels.withColumn("level", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(price))).where(F.col("level") <= depth)
