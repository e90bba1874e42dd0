"""Operator 7: exact dedup with a cuckoo-filter index over live digests.

The filter holds 16-bit fingerprints, two bytes each, in buckets of four slots; a key has two candidate buckets,
the second found from the first and the fingerprint alone. The digests themselves lie apart, in content buckets by
their leading bits. A digest that the filter does not know is new, and no content is read; a filter hit is
verified against the digests of its content bucket. A deletion takes the live digest out of its content bucket and
one equal fingerprint out of the filter. When an insertion overflows, the filter is rebuilt at twice the size from
the stored keys; digests are never lost, since only fingerprints move.

Texts are equal when identical after the white space U+0020 and U+0009 to U+000D is deleted; the key is the
SHA-256 of what remains, in UTF-8.

Scale: every task first collapses the copies among its own rows in an index of its own (flushed when full,
so memory is bounded), and only one entry per task and digest is shuffled. Digests are dealt to shards by
a hash of them, so a group of copies of any size reaches its shard as at most one entry per flush.
The survivors are joined back to the rows by digest; the join is one Spark may split where a group of copies
holds a large share of the rows.

Defined results: null text counts as empty, and all empty texts are copies of each other; of equal texts the
longest original (in code points) stays, then the smallest doc_id (null doc_id last); repeated rows with one
doc_id count each; extra columns are ignored by groups() and kept by keep_one(); empty input gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, lean, shuffle_parts, text_of

SLOTS = 4
MAX_KICKS = 200
MASK = (1 << 64) - 1
#: Entries a task keeps before it hands them on.
FLUSH = 200_000
#: Rows for which there is a shard of the index at least.
SHARD = 500_000


class CuckooFilter:
    """Fingerprints of 64-bit hashes; a hash that was put in and not taken out is always found."""

    def __init__(self, buckets: int):
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.marks = array("H", bytes(2 * SLOTS * (self.mask + 1)))

    def places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & self.mask
        return mark, first * SLOTS, self._other(first, mark) * SLOTS

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x9E3779B97F4A7C15 & MASK) >> 20 & self.mask)

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self.places(key)
        return mark in self.marks[a : a + SLOTS] or mark in self.marks[b : b + SLOTS]

    def _swap(self, at: int, old: int, new: int) -> bool:
        """Put new into a slot of the bucket at `at` that holds old, if there is one."""
        for i in range(at, at + SLOTS):
            if self.marks[i] == old:
                self.marks[i] = new
                return True
        return False

    def add(self, key: bytes) -> bool:
        """False: no slot was found after MAX_KICKS moves and some fingerprint is left over; rebuild from the keys."""
        mark, a, b = self.places(key)
        if self._swap(a, 0, mark) or self._swap(b, 0, mark):
            return True
        for kick in range(MAX_KICKS):
            i = a + kick % SLOTS
            mark, self.marks[i] = self.marks[i], mark
            a = self._other(a // SLOTS, mark) * SLOTS
            if self._swap(a, 0, mark):
                return True
        return False

    def discard(self, key: bytes) -> None:
        mark, a, b = self.places(key)
        if not self._swap(a, mark, 0):
            self._swap(b, mark, 0)


class CuckooIndex:
    """Digest (bytes, 16 at least and uniformly distributed) to entry: bucketed content behind a cuckoo filter."""

    #: Rebuilds after which the filter stays as it is and every key counts as a hit; only keys that share ten leading bytes get there.
    REBUILDS = 6

    def __init__(self, buckets: int = 1024):
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, list[list]] = {}
        self.size, self.sure = 0, True

    @property
    def mask(self) -> int:
        return self.filter.mask

    def _held(self, key: bytes) -> list | None:
        """[digest, entry] of a live key; content is read only where the filter knows the fingerprint."""
        if self.sure and key not in self.filter:
            return None
        return next((x for x in self.content.get(int.from_bytes(key[:8], "big") >> 24, ()) if x[0] == key), None)

    def get(self, key: bytes):
        held = self._held(key)
        return None if held is None else held[1]

    def __contains__(self, key: bytes) -> bool:
        return self._held(key) is not None

    def __len__(self) -> int:
        return self.size

    def put(self, key: bytes, entry) -> None:
        """Insert a digest, or replace the entry of a live one."""
        held = self._held(key)
        if held is not None:
            held[1] = entry
            return
        self.content.setdefault(int.from_bytes(key[:8], "big") >> 24, []).append([key, entry])
        self.size += 1
        if self.sure and not self.filter.add(key):
            self._resize()

    def delete(self, key: bytes) -> bool:
        held = self._held(key)
        if held is None:
            return False
        at = int.from_bytes(key[:8], "big") >> 24
        bucket = self.content[at]
        bucket.remove(held)
        if not bucket:
            del self.content[at]
        self.filter.discard(key)
        self.size -= 1
        return True

    def _resize(self) -> None:
        buckets = self.filter.mask + 1
        for _ in range(self.REBUILDS):
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            if all(self.filter.add(k) for k, _ in self.items()):
                return
        self.sure = False

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, e) for bucket in self.content.values() for k, e in bucket)


OUT = "digest binary, chars long, keep_id long, copies long"
_ARROW = pa.schema([("digest", pa.binary()), ("chars", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64())])
WITHDRAWN = -1


def _merge(batches: Iterator[pa.RecordBatch], flush: int | None) -> Iterator[pa.RecordBatch]:
    """One entry per digest: the longest text, then the smallest id, and how many copies there are. Copies of WITHDRAWN take a digest out again."""
    index, gone = CuckooIndex(), []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("digest", "chars", "keep_id", "copies")]
        for digest, chars, keep, copies in zip(*columns, strict=True):
            if copies == WITHDRAWN:
                gone.append(digest)
                continue
            held = index.get(digest)
            if held is None:
                index.put(digest, [chars, keep, copies])
                continue
            held[2] += copies
            if chars > held[0] or chars == held[0] and keep is not None and (held[1] is None or keep < held[1]):
                held[0], held[1] = chars, keep
        if flush and len(index) + len(gone) >= flush:
            yield from _drain(index, gone)
            index, gone = CuckooIndex(), []
    if flush is None:  # all of the shard's digests are in
        for digest in gone:
            index.delete(digest)
        gone = []
    yield from _drain(index, gone)


def _drain(index: CuckooIndex, gone: list[bytes], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    items = [*index.items(), *((k, [0, None, WITHDRAWN]) for k in gone)]
    for i in range(0, len(items), rows):
        part = items[i : i + rows]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), *(pa.array([e[j] for _, e in part], pa.int64()) for j in range(3))], schema=_ARROW)


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, chars, digest) of every row; white space is deleted before the digest is taken."""
    text = text_of()
    return docs.select("doc_id", F.char_length(text).cast("long").alias("chars"), F.unhex(F.sha2(F.translate(text, WS, "").cast("binary"), 256)).alias("digest"))


def survivors(rows: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """From (doc_id, chars, digest) to one row per digest: digest, chars, keep_id, copies. withdrawn: rows whose digests are deleted."""
    entries = rows.select("digest", "chars", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    if withdrawn is not None:
        entries = entries.union(withdrawn.select("digest", F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(WITHDRAWN).cast("long")))
    local = entries.mapInArrow(lean(lambda it: _merge(it, FLUSH)), OUT)
    shards = max(shuffle_parts(rows.sparkSession), -(-rows.count() // SHARD))
    return local.repartition(shards, "digest").mapInArrow(lean(lambda it: _merge(it, None)), OUT)


def groups(docs: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    withdrawn: documents, with a column text, whose texts are to go; their digests are deleted from the index, and no row with
    one is kept (keep_id and group_size are null)."""
    rows = cut(digested(docs))
    gone = None if withdrawn is None else digested(withdrawn.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    kept = survivors(rows, gone).select("digest", "keep_id", F.col("copies").alias("group_size"))
    out = rows.join(kept, "digest") if gone is None else rows.join(kept, "digest", "left")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    stays = stays if gone is None else stays & F.col("group_size").isNotNull()
    return out.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the copies: of each group the row that stays, the longest of several texts under its doc_id, once even where rows repeat both."""
    row_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id")
    kept = survivors(digested(docs)).select(F.col("digest").alias("_key"), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("_id"), F.col("chars").alias("_chars"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(F.unhex(F.sha2(F.translate(text_of(), WS, "").cast("binary"), 256)).alias("_key"), row_id, F.char_length(text_of()).cast("long").alias("_chars"), whole)
    names = ["_key", "_id", "_chars"]
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).select("_row.*")
