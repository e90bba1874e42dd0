"""Operator 2: packing documents into training sequences by harmonic classes.

A document is encoded once and ends with an end id. Only one longer than the capacity C is cut, into whole sequences
and a rest. What is shorter than C stays one item of the class j of its length, the reciprocal-capacity class
(C / (j + 1), C / j]: a bin of class j takes exactly j items, whatever else is packed. The tail that a full count of
items leaves in a bin is then filled with pieces cut from a filler: the rest of a long document, which is cut
anyway, or, where too many bins wait for one, the next item. Each task (worker) fills the bins of its own documents;
no task waits for another and no row is shuffled. When a task ends, the items of its open bins, at most j - 1 of a
class, fill what still waits, and the last sequence is split at its binary digits, so that every sequence is full
or has a power of two of tokens: there is no padding, and a document of less than C tokens is seldom cut.

Scale: bounded memory (less than C ids a class, RESTS rests and WAITING bins, one Arrow batch, and a long text encoded in
slices cut where the tokenizer cannot join), no shuffle, and rows in proportion to the documents and the tokens.

Defined results: null text is an empty document and has only the end id; repeated rows are packed each;
null doc_id is kept as null; extra columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

CAPACITY = 1024
END_ID = 0
#: Rests of long documents and bins waiting for one that a worker holds.
RESTS, WAITING = 64, 64
#: Longer texts are encoded in slices of about so many characters.
SLICE = 1 << 20
#: What both encoders split alike without any doubt: printable ASCII, tab, line ends and Latin letters.
_PLAIN = re.compile(r"[\x20-\x7e\t\n\r¡-¬®-ɏ]*")
_SPECIAL = "<|endoftext|>"
#: A space between two other characters that are no white space and not part of a special token: a token never spans it from the left.
_GAP = re.compile(r"(?<=[^\s|<>]) (?=[^\s|<>])")

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in OUT.split(", ")])


def default_tokenizer() -> tuple[str, str]:
    """Paths of one vocabulary in the formats of tokenizers and tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts by the tokenizers file; plain Latin text takes the same vocabulary in tiktoken, which is faster and gives the same ids."""

    def __init__(self, json_path: str, ranks_path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.main = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= SLICE:
            return self._slice(text)
        parts, at = [], 0
        while at < len(text):
            gap = _GAP.search(text, at + SLICE)
            end = gap.start() if gap else len(text)
            parts.append(self._slice(text[at:end]))
            at = end
        return np.concatenate(parts)

    def _slice(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text) and _SPECIAL not in text:
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(self.main.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of so many tokens as whole sequences, then the binary digits of the rest, largest first."""
    whole, rest = divmod(tokens, capacity)
    out = [(i * capacity, capacity) for i in range(whole)]
    at, bit = whole * capacity, capacity
    while rest:
        bit >>= 1
        if rest & bit:
            out.append((at, bit))
            at, rest = at + bit, rest ^ bit
    return out


class Item:
    """Ids of a document from start on that are not placed yet."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id: int | None, ids: np.ndarray, start: int, total: int):
        self.doc_id, self.ids, self.start, self.total = doc_id, ids, start, total

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, n: int) -> Item:
        """The first n ids, as an item of their own; this one keeps the others."""
        out = Item(self.doc_id, self.ids[:n], self.start, self.total)
        self.ids, self.start = self.ids[n:], self.start + n
        return out

    def row(self, sequence: int, offset: int) -> tuple:
        return self.doc_id, self.start, len(self.ids), zlib.crc32(self.ids.tobytes()), self.total, sequence, offset


class Worker:
    """The bins of one task; place() and finish() return the rows of complete sequences."""

    def __init__(self, number: int, capacity: int = CAPACITY):
        assert capacity & (capacity - 1) == 0, "capacity must be a power of two"
        self.capacity, self.next = capacity, number << 36
        self.open: dict[int, list[Item]] = {}
        self.rests: deque[Item] = deque()
        self.waiting: deque[list[Item]] = deque()

    def _close(self, items: list[Item]) -> list[tuple]:
        offset, rows = 0, []
        for x in items:
            rows.append(x.row(self.next, offset))
            offset += len(x)
        self.next += 1
        return rows

    def _fill(self) -> list[tuple]:
        """Waiting bins are filled as far as the rests go."""
        rows = []
        while self.waiting and self.rests:
            bin_, filler = self.waiting[0], self.rests[0]
            room = self.capacity - sum(map(len, bin_))
            if len(filler) <= room:
                bin_.append(self.rests.popleft())
            else:
                bin_.append(filler.take(room))
            if len(bin_[-1]) == room:
                rows += self._close(self.waiting.popleft())
        return rows

    def _item(self, item: Item) -> list[tuple]:
        kind = self.capacity // len(item)
        bin_ = self.open.setdefault(kind, [])
        bin_.append(item)
        if len(bin_) < kind:
            return []
        del self.open[kind]
        if sum(map(len, bin_)) == self.capacity:
            return self._close(bin_)
        self.waiting.append(bin_)
        return self._fill()

    def place(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        rest, rows = Item(doc_id, ids, 0, len(ids)), []
        while len(rest) >= self.capacity:
            rows += self._close([rest.take(self.capacity)])
        if not len(rest):
            return rows
        rest.ids = rest.ids.copy()  # so that the whole document need not be held
        if rest.start and len(self.rests) < RESTS or len(self.waiting) >= WAITING:
            self.rests.append(rest)
            return rows + self._fill()
        return rows + self._item(rest)

    def finish(self) -> list[tuple]:
        self.rests.extend(x for kind in sorted(self.open) for x in self.open[kind])
        self.open, rows = {}, self._fill()
        left = deque([*(x for bin_ in self.waiting for x in bin_), *self.rests])
        for _, length in cuts(sum(map(len, left)), self.capacity):
            bin_, room = [], length
            while room:
                x = left.popleft()
                if len(x) > room:
                    left.appendleft(x)
                    x = x.take(room)
                bin_.append(x)
                room -= len(x)
            rows += self._close(bin_)
        self.waiting, self.rests = deque(), deque()
        return rows


def _rows_out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)


def _work(batches: Iterator[pa.RecordBatch], paths: tuple[str, str | None], capacity: int) -> Iterator[pa.RecordBatch]:
    encoder, worker, rows = None, Worker(TaskContext.get().partitionId(), capacity), []
    for batch in batches:
        encoder = encoder or Encoder(*paths)
        ids, texts = batch.column("doc_id"), batch.column("text")
        for i in range(batch.num_rows):
            doc_id, text = ids[i].as_py(), texts[i].as_py() or ""
            doc = np.append(encoder.ids(text), np.uint32(END_ID)).astype("<u4")
            rows += worker.place(doc_id, doc)
            if len(rows) >= 20_000:
                yield _rows_out(rows)
                rows = []
    rows += worker.finish()
    if rows:
        yield _rows_out(rows)


def pack(docs: DataFrame, tokenizer: tuple[str, str | None] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file and, if wanted, of the same vocabulary as tiktoken ranks; both must be there on every executor."""
    small_batches(docs.sparkSession)
    paths = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(lambda it: _work(it, paths, capacity)), OUT)
