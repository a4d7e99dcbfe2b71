"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize

TOKENIZER = "byte_bpe_50k.json"
#: Control strings. None holds white space, and none begins with another's end, so they never overlap.
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|turn|>", "<|text|>", "<|end|>", "<|endoftext|>")
_ANY = "|".join(map(re.escape, CONTROLS))
ESCAPE, UNESCAPE = re.compile(rf"(\\*)({_ANY})"), re.compile(rf"\\(\\*)({_ANY})")
LIVE = re.compile(rf"(?<!\\)(?:{_ANY})")
FRAMES = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" <|text|> ", " </s>\n")}
#: Whole conversations leave a task together once they have so many characters.
RUN_CHARS = 1 << 18
TRAINED = "assistant"


def escape(text: str) -> str:
    """Every control string gets one more backslash before it; unescape() takes it away again."""
    return ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def frame(role: str | None) -> tuple[str, str]:
    """What stands before and after a turn's text. Any other role is written out, escaped; no role has none."""
    if role in FRAMES:
        return FRAMES[role]
    return ("<|turn|> <|text|> " if role is None else f"<|turn|> .{escape(role)} <|text|> "), " <|end|>\n"


def render(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the sorted spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        before, after = frame(role)
        body = escape(text)
        if role == TRAINED:
            spans.append((at + len(before), at + len(before) + len(body)))
        parts += (before, body, after)
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def loss_ranges(spans: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(lo, hi, a, b) for each turn span that tokens meet: the tokens lo to hi - 1 cover its characters a to b.

    Both ends are found by binary search of the span in the sorted token spans. A token that reaches over a span's edge
    carries only the part inside; tokens of one character's bytes have equal spans. An empty span meets no token.
    """
    if not spans or not len(start):
        return []
    a, b = np.array(spans).T
    lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
    met = np.flatnonzero(hi > lo)
    lo, hi = lo[met], hi[met]
    return list(zip(lo.tolist(), hi.tolist(), np.maximum(a[met], start[lo]).tolist(), np.minimum(b[met], end[hi - 1]).tolist(), strict=True))


def loss_tokens(spans: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(token, start, end) of the tokens that meet turn spans, each cut to its span."""
    start, end = np.array(offsets, int).reshape(-1, 2).T
    return [(t, max(a, int(start[t])), min(b, int(end[t]))) for lo, hi, a, b in loss_ranges(spans, start, end) for t in range(lo, hi)]


def under_mask(text: str, mask: np.ndarray, spans: list[dict]) -> str:
    """The characters under the loss mask, each once, in order. A span whose tokens the mask leaves out is an error."""
    told = np.zeros_like(mask)
    for s in spans:
        told[s["lo"] : s["hi"]] = True
    if (told != mask).any():
        raise ValueError("mask and spans differ")
    return "".join(text[s["start"] : s["end"]] for s in spans)


def parse(text: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    opens = {v[0]: (k, v[1]) for k, v in FRAMES.items()}
    while at < len(text):
        for before, (role, after) in opens.items():
            if text.startswith(before, at):
                break
        else:
            if not text.startswith("<|turn|> ", at):
                raise ValueError(f"no turn at {at}")
            named = text[at + 9] == "."
            role_end = LIVE.search(text, at + 9).start()
            role = unescape(text[at + 10 : role_end - 1]) if named else None
            before, after = text[at : role_end + 8] + " ", " <|end|>\n"
        begin = at + len(before)
        end = LIVE.search(text, begin).start() - 1
        if not text.startswith(after, end):
            raise ValueError(f"turn at {at} does not end")
        turns.append((role, unescape(text[begin:end])))
        at = end + len(after)
    return turns


def formatted(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conv_id, text, ids, mask, spans of conversations (conv_id, turn, role, text): a row for each conversation.

    Turns are ordered by turn, then role and text, nulls first; null texts are empty. A conversation is rendered whole and
    encoded by one call with character offsets. mask marks the tokens that meet an assistant text; spans holds for each such
    text its tokens (lo, hi) and its characters (start, end). A conversation is one training example: its text and tokens are
    held in memory together, other conversations are not. Null conv_ids are one conversation. Extra columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(tokenizer or public_tokenizers.path(TOKENIZER))
        coder.encode_special_tokens = True
        held: list[tuple[str | None, str]] = []
        now, started = None, False
        out, tokens, span_rows, chars = [], [], [], 0

        def flush() -> None:
            nonlocal chars
            text, spans = render(held)
            held.clear()
            code = coder.encode(text, add_special_tokens=False)
            places = np.fromiter(chain.from_iterable(code.offsets), np.int32).reshape(-1, 2)
            out.append((now, text))
            tokens.append(np.array(code.ids, np.int32))
            span_rows.append(loss_ranges(spans, places[:, 0], places[:, 1]))
            chars += len(text)

        def batch_of() -> pa.RecordBatch:
            nonlocal chars
            sizes = [len(x) for x in tokens]
            at, masks = np.cumsum([0, *sizes]), np.zeros(sum(sizes), bool)
            for first, spans in zip(at[:-1].tolist(), span_rows, strict=True):
                for lo, hi, _, _ in spans:
                    masks[first + lo : first + hi] = True
            each = np.array([x for spans in span_rows for x in spans], np.int32).reshape(-1, 4)
            span_at = np.cumsum([0, *map(len, span_rows)])
            at, span_at = pa.array(at, pa.int32()), pa.array(span_at, pa.int32())
            names = ["lo", "hi", "start", "end"]
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate(tokens))), pa.ListArray.from_arrays(at, pa.array(masks)),
                    pa.ListArray.from_arrays(span_at, pa.StructArray.from_arrays([pa.array(each[:, k].copy()) for k in range(4)], names)),
                ],
                ["conv_id", "text", "ids", "mask", "spans"],
            )
            out.clear(), tokens.clear(), span_rows.clear()
            chars = 0
            return made

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for conv, role, text in zip(*columns, strict=True):
                if started and conv != now:
                    flush()
                    if chars >= RUN_CHARS:
                        yield batch_of()
                now, started = conv, True
                held.append((role, text or ""))
        if held:
            flush()
        if out:
            yield batch_of()

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(scan, "conv_id long, text string, ids array<int>, mask array<boolean>, spans array<struct<lo int, hi int, start int, end int>>")


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens from formatted()'s rows alone.

    Each row is read by itself, so the table may have been written and read again in any order.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                conv, text, spans = (batch.column(c)[k].as_py() for c in ("conv_id", "text", "spans"))
                mask = np.asarray(batch.column("mask")[k].values.to_numpy(zero_copy_only=False), bool)
                turns = parse(text)
                told = "".join(f"{role or ''}\n{said}\n" for role, said in turns)
                loss = unescape(under_mask(text, mask, spans))
                rows.append((conv, len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text), len(batch.column("ids")[k])))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return output.mapInArrow(scan, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def written(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """formatted() as a table in the shared folder, read again."""
    return materialize(formatted(conversations, tokenizer), "chat")
