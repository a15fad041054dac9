"""Texts cut into chunks and sentences inside tasks, batch by batch.

All work on UTF-8 bytes, so that a text of any bytes passes; what needs character classes stays with Spark's expressions.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

# The functions travel inside the task, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])

#: Distinct pairs that a task holds before it hands them on, and rows of a batch that it yields.
HELD, ROWS = 300_000, 50_000
SPACES = b" \t\n\x0b\x0c\r"
OTHER_SPACES = (b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
CUT = "￿".encode()
_OPENING = b"(?:[\"'(\\[{*]|\xc2\xab|\xe2\x80\x9c|\xe2\x80\x98)"
_CLOSING = b"(?:[\"')\\]}*]|\xc2\xbb|\xe2\x80\x9d|\xe2\x80\x99)"
_CLOSING_OR_COMMA = b"(?:[\"')\\]}*,;:]|\xc2\xbb|\xe2\x80\x9d|\xe2\x80\x99)"
#: A chunk with nothing between its quotes, brackets and commas; a mark that may end a sentence; a possible boundary.
EMPTY = re.compile(_OPENING + b"*+" + _CLOSING_OR_COMMA + b"*+")
MARK = re.compile(b"[.!?]")
BOUNDARY = re.compile(b"[.!?]" + _CLOSING + b"*+[ \t\n\x0b\x0c\r]++")
DARK = re.compile(b"[^ \t\n\x0b\x0c\r]++")
_TO_BLANK = bytes.maketrans(b"".join(OTHER_SPACES), b" " * len(OTHER_SPACES))


def chunks_of(text: bytes) -> tuple[list[bytes], list[tuple[int, bytes]]]:
    """What stands between spaces and isn't empty, and those of them that have a mark that may end a sentence, with their
    places."""
    parts = text.translate(_TO_BLANK).split(b" ")
    odd = [i for i, c in enumerate(parts) if not c.isalpha()]
    empty = {i for i in odd if EMPTY.fullmatch(parts[i])}
    if empty:
        parts = [c for i, c in enumerate(parts) if i not in empty]
        odd = [i for i, c in enumerate(parts) if not c.isalpha()]
    return parts, [(i, parts[i]) for i in odd if MARK.search(parts[i])]


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(y, chunk, n)`` of the texts in the first column: each chunk and the one before it, ``-`` if that has no mark that
    may end a sentence, null at the beginning.  A pair comes once for each time that a task has handed its pairs on."""
    middle, pairs = Counter(), Counter()

    def handed() -> pa.RecordBatch:
        rest = {c: n for c, n in middle.items() if n}
        y = [b"-"] * len(rest) + [k[0] for k in pairs]
        columns = [pa.array(y, pa.binary()), pa.array([*rest, *(k[1] for k in pairs)], pa.binary()), pa.array([*rest.values(), *pairs.values()], pa.int64())]
        middle.clear()
        pairs.clear()
        return pa.RecordBatch.from_arrays(columns, ["y", "chunk", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            parts, marked = chunks_of(text or b"")
            if not parts:
                continue
            # All are counted as if nothing were before them; those behind a mark, which are few, are taken out again.
            middle.update(parts)
            for i, y in [(-1, None), *marked]:
                if i + 1 < len(parts):
                    middle[parts[i + 1]] -= 1
                    pairs[y, parts[i + 1]] += 1
            if len(middle) + len(pairs) > HELD:
                yield handed()
    if middle:
        yield handed()


def ends_of(text: bytes) -> list[int]:
    """Where the segments of a text end: behind each possible boundary and its spaces, and at its own end."""
    found = [m.end() for m in BOUNDARY.finditer(text)]
    return found if found and found[-1] == len(text) else [*found, len(text)]


def _rows(batch: pa.RecordBatch, keys: int, at: list[int], names: Sequence[str], *columns: pa.Array) -> pa.RecordBatch:
    index = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(i).take(index) for i in range(keys)] + list(columns), list(names))


def doubtful_boundaries(names: Sequence[str]):
    """A kernel from ``(*keys, text)`` to ``(*keys, at, last, first)``: the boundaries at a full stop, numbered as the
    segments that they end, with the chunks before and after them."""
    keys = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, last, first = [], [], [], []
            made = lambda: _rows(batch, keys, rows, [*names, "at", "last", "first"], pa.array(at, pa.int32()), pa.array(last, pa.binary()), pa.array(first, pa.binary()))  # noqa: B023, E731
            for row, value in enumerate(batch.column(keys).to_pylist()):
                text = (value or b"").replace(CUT, b"")
                others = [s for s in OTHER_SPACES if s in text]
                start = 0
                for number, m in enumerate(BOUNDARY.finditer(text)):
                    stop, end = m.span()
                    if text[stop] == 46 and end < len(text):
                        begin = max(start, 1 + text.rfind(b" ", start, stop))
                        for s in others:
                            begin = max(begin, 1 + text.rfind(s, start, stop))
                        rows.append(row)
                        at.append(number)
                        last.append(text[begin:end].rstrip(SPACES))
                        first.append(DARK.match(text, end).group())
                    start = end
                if len(rows) >= ROWS:
                    yield made()
                    rows, at, last, first = [], [], [], []
            if rows:
                yield made()

    return run


def sentences_of(text: bytes, going: Sequence[int]) -> list[tuple[int, bytes]]:
    """The numbered sentences of a text, trimmed, blank ones left out; those that end at the boundaries in ``going`` go on."""
    out, start, number, on = [], 0, 0, frozenset(going)
    for at, end in enumerate(ends_of(text)):
        if at in on:
            continue
        if sentence := text[start:end].strip(SPACES):
            out.append((number, sentence))
        start, number = end, number + 1
    return out


def split_sentences(names: Sequence[str]):
    """A kernel from ``(*keys, text, going)`` to ``(*keys, sentence_no, sentence)``."""
    keys = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, found = [], [], []
            made = lambda: _rows(batch, keys, rows, [*names, "sentence_no", "sentence"], pa.array(numbers, pa.int32()), pa.array(found, pa.binary()))  # noqa: B023, E731
            for row, (value, going) in enumerate(zip(batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist())):
                for number, sentence in sentences_of((value or b"").replace(CUT, b""), going or ()):
                    rows.append(row)
                    numbers.append(number)
                    found.append(sentence)
                if len(rows) >= ROWS:
                    yield made()
                    rows, numbers, found = [], [], []
            if rows:
                yield made()

    return run
