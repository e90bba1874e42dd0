"""Operator 4: token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The lengths of its tokens in bytes, summed up, give every token's span. Sections
are intervals of the document: its lines with their line feed, or those that a column of it gives in characters, such as
the places of fields in a text that was put together from them (with_fields). The spans of the tokens are joined with
the intervals by sorted searches, without a loop over either. A token that meets several sections is allocated by a rule:

* first: to the sections that hold its first character (the default);
* last: to the sections that hold its last character;
* most: to the section with most of its bytes, of equals the one that begins first, then the one named first.

So where sections cover the document without overlap, every token counts once and the sections add up to its tokens. A token in a
gap counts in no section; with the first two rules, one in overlapping sections counts in each of them. Offsets are in
characters; a token that begins inside a character begins with that character.

Scale: narrow, one pass, no shuffle; a long text is encoded in slices cut where no token can lie across.

Defined results: null and empty texts have one line from 0 to 0 without tokens; repeated rows get their rows each; a
null doc_id is kept; extra columns are ignored; an empty table gives no rows. Given intervals are cut to the text, one that
ends before it begins is empty, one with a null end holds nothing, and a null or empty list of them gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches
from .packing import Encoder, default_tokenizer

RULES = ("first", "last", "most")
OUT = "doc_id long, section long, start long, end long, tokens long, doc_tokens long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in OUT.split(", ")])


def token_bytes(json_path: str) -> np.ndarray:
    """Length in bytes of each id of a byte-level vocabulary: one character of its text stands for a byte."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(json_path)
    vocab = t.get_vocab(with_added_tokens=True)
    added = {i: len(x.content.encode()) for i, x in t.get_added_tokens_decoder().items()}
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for text, i in vocab.items():
        out[i] = added.get(i, len(text))
    return out


def lines(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which the lines of a text begin."""
    ends = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], ends[ends < len(data)]]).astype(np.int64)


def join(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens allocated to each interval [start, stop), from the spans [begin, end) of tokens in order, none of them empty."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    stops = np.maximum(starts, stops)
    if rule != "most":
        at = begin if rule == "first" else end - 1
        return np.searchsorted(at, stops) - np.searchsorted(at, starts)
    low = np.searchsorted(end, starts, side="right")
    high = np.maximum(np.searchsorted(begin, stops), low)
    high[stops == starts] = low[stops == starts]
    section = np.repeat(np.arange(len(starts)), high - low)
    token = np.arange(len(section)) - np.repeat(np.cumsum(high - low) - high, high - low)
    share = np.minimum(end[token], stops[section]) - np.maximum(begin[token], starts[section])
    order = np.lexsort((section, starts[section], -share, token))
    won = order[np.flatnonzero(np.diff(token[order], prepend=-1))]
    return np.bincount(section[won], minlength=len(starts))


def attribute(lengths: np.ndarray, starts: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens per section, from the byte lengths of a text's tokens and the byte offsets of sections that follow each other."""
    end = np.cumsum(lengths)
    return join(end - lengths, end, starts, np.append(starts[1:], max(int(end[-1]) if len(end) else 0, int(starts[-1]))), rule)


def chars_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many characters of UTF-8 bytes begin before each place."""
    marks = np.unique(np.concatenate([[0], places]))
    marks = marks[marks < len(data)]
    leads = ((data & 0xC0) != 0x80).view(np.uint8)
    sums = np.concatenate([[0], np.cumsum(np.add.reduceat(leads, marks, dtype=np.int64))]) if len(marks) else np.zeros(1, np.int64)
    return sums[np.searchsorted(marks, places)]


def byte_places(data: np.ndarray, chars: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The byte at which each character begins; the end of the text for those beyond it."""
    out = np.full(len(chars), len(data), np.int64)
    order = np.argsort(chars, kind="stable")
    seen = i = 0
    for at in range(0, len(data), step):
        leads = np.flatnonzero((data[at : at + step] & 0xC0) != 0x80)
        to = int(np.searchsorted(chars[order], seen + len(leads)))
        out[order[i:to]] = at + leads[chars[order[i:to]] - seen]
        seen, i = seen + len(leads), to
    return out


def sections_of(data: np.ndarray, given: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the intervals that a row gives in characters."""
    pairs = np.array([(-1, -1) if x is None or x["start"] is None or x["end"] is None else (max(x["start"], 0), max(x["end"], 0)) for x in given or ()], np.int64).reshape(-1, 2)
    void = (pairs < 0).any(axis=1)
    places = byte_places(data, np.maximum(pairs, 0).reshape(-1)).reshape(-1, 2)
    places[void] = 0
    return places[:, 0], np.maximum(places[:, 0], places[:, 1])


def allocate(data: np.ndarray, lengths: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each interval of a text, from its bytes and the byte lengths of its tokens."""
    end = np.cumsum(lengths)
    begin = end - lengths
    for _ in range(3):  # a token that begins inside a character begins with it
        inside = np.flatnonzero((data[begin] & 0xC0) == 0x80) if len(begin) else begin
        begin[inside] -= 1
    return join(begin, end, starts, stops, rule)


def _work(batches: Iterator[pa.RecordBatch], paths: tuple[str, str | None], rule: str) -> Iterator[pa.RecordBatch]:
    encoder, sizes, rows = None, None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) if i else pa.array([x for part in c for x in part], pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], schema=_SCHEMA)

    held = 0
    for batch in batches:
        if encoder is None:
            encoder, sizes = Encoder(*paths), token_bytes(paths[0])
        ids, texts = batch.column("doc_id"), batch.column("text")
        given = batch.column("sections") if "sections" in batch.schema.names else None
        for i in range(batch.num_rows):
            doc_id, text = ids[i].as_py(), texts[i].as_py() or ""
            data = np.frombuffer(text.encode(), np.uint8)
            if given is None:
                starts = lines(data)
                stops = np.append(starts[1:], len(data))
            else:
                starts, stops = sections_of(data, given[i].as_py())
            lengths = sizes[encoder.ids(text)] if text else np.zeros(0, np.int64)
            counts = allocate(data, lengths, starts, stops, rule)
            places = chars_before(data, np.concatenate([starts, stops]))
            n = len(starts)
            rows.append(([doc_id] * n, np.arange(n), places[:n], places[n:], counts, np.full(n, len(lengths))))
            held += n
            if held >= 20_000:
                yield out()
                rows, held = [], 0
    if rows:
        yield out()


def with_fields(docs: DataFrame, columns: Sequence[str], between: str = "\n") -> DataFrame:
    """(doc_id, text, sections): the columns put together as one text, and where each of them lies in it; null is empty."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    spans, at = [], F.lit(0).cast("long")
    for x in parts:
        end = at + F.char_length(x)
        spans.append(F.struct(at.alias("start"), end.alias("end")))
        at = end + len(between)
    return docs.select("doc_id", F.concat_ws(between, *parts).alias("text"), F.array(*spans).alias("sections"))


def count(docs: DataFrame, rule: str = "first", tokenizer: tuple[str, str | None] | None = None, sections: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, tokens, doc_tokens), one row per line of each document, or per interval of the column
    that sections names, an array of structs with start and end in characters."""
    small_batches(docs.sparkSession)
    paths = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(f"`{sections}`").cast("array<struct<start:long,end:long>>").alias("sections")] if sections else []))
    return rows.mapInArrow(lean(lambda it: _work(it, paths, rule)), OUT)
