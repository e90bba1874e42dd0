"""Operator 9: URL filter by a sorted array of 64-bit digests.

A rule is a host and the start of a path. It fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's; the longest fitting rule decides, and a URL without one gets the default.
The keys, xxhash64 of host + path, lie sorted in one file that every worker memory-maps; beside it lie the full
strings in the same order. For each batch of URLs all candidate keys (each host suffix and path start of as many
labels and characters as some rule has) are probed in one vectorised binary search, and every hit is confirmed against the
stored string, so a collision of digests changes nothing.

Scale: narrow, without a shuffle. The two files go to the executors by Spark's own file distribution, once per
executor and anew for an executor that replaces a lost one; a worker maps pages on demand instead of holding
the rules. The cost of a URL is the number of shapes of rules, whatever the length of its host.

Defined results: null url, or one without "://", has an empty host and path, which no rule fits, and gets the
default; user, port and such belong to the host as written; repeated rows get a row each; of the columns of the table
annotate() keeps those it is asked for, and its own take the place of any called as they are; an empty table or an empty list of rules is fine; of rules with equal host and path the
first counts.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"


class DigestArray:
    """Sorted keys with the strings and verdicts they stand for, on disk."""

    def __init__(self, folder: str, prefix: str):
        at = os.path.join(folder, prefix)
        self.keys = np.load(f"{at}-keys.npy", mmap_mode="r")
        self.ends = np.load(f"{at}-ends.npy", mmap_mode="r")
        self.blob = np.load(f"{at}-blob.npy", mmap_mode="r")
        self.hosts = np.load(f"{at}-hosts.npy", mmap_mode="r")
        self.block = np.load(f"{at}-block.npy", mmap_mode="r")
        self.shapes = [tuple(x) for x in np.load(f"{at}-shapes.npy").tolist()]

    FILES = ("keys", "ends", "blob", "hosts", "block", "shapes")

    @staticmethod
    def build(rules: Sequence[tuple[str, str, str]], folder: str, prefix: str, digest=xxhash.xxh64_intdigest) -> list[str]:
        first: dict[tuple[str, str], str] = {}
        for verdict, host, path in rules:
            first.setdefault((host, path), verdict)
        rows = sorted((digest((h + p).encode()), h + p, len(h.encode()), v == "block") for (h, p), v in first.items())
        texts = [t.encode() for _, t, *_ in rows]
        parts = {
            "keys": np.array([r[0] for r in rows], "<u8"),
            "ends": np.cumsum([len(t) for t in texts], dtype="<i8"),
            "blob": np.frombuffer(b"".join(texts), "u1"),
            "hosts": np.array([r[2] for r in rows], "<i4"),
            "block": np.array([r[3] for r in rows], bool),
            "shapes": np.unique(np.array([(h.count(".") + 1, len(p)) for h, p in first], "<i8").reshape(-1, 2), axis=0),
        }
        for name, values in parts.items():
            np.save(os.path.join(folder, f"{prefix}-{name}.npy"), values)
        return [os.path.join(folder, f"{prefix}-{n}.npy") for n in DigestArray.FILES]

    def text(self, i: int) -> bytes:
        return bytes(self.blob[self.ends[i - 1] if i else 0 : self.ends[i]])

    def probe(self, candidates: list[tuple[str, str]], digest=xxhash.xxh64_intdigest) -> list[int]:
        """The index of each (host suffix, path start) among the rules, or -1."""
        if not candidates or not len(self.keys):
            return [-1] * len(candidates)
        wanted = np.array([digest((h + p).encode()) for h, p in candidates], "<u8")
        at = np.searchsorted(self.keys, wanted)
        found = [-1] * len(candidates)
        inside = np.flatnonzero(at < len(self.keys))
        for j in inside[np.asarray(self.keys[at[inside]]) == wanted[inside]]:
            host, path = candidates[j]
            i, text = int(at[j]), (host + path).encode()
            while i < len(self.keys) and self.keys[i] == wanted[j]:  # strings that share a digest stand side by side
                if self.hosts[i] == len(host.encode()) and self.text(i) == text:
                    found[j] = i
                    break
                i += 1
        return found


def judge(array: DigestArray, hosts: list[str], paths: list[str], default: str = DEFAULT, digest=xxhash.xxh64_intdigest) -> tuple[list, list]:
    """Rule (host + path, or None) and verdict of each URL."""
    candidates: list[tuple[str, str]] = []
    owner: list[int] = []
    for n, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        labels = host.count(".") + 1
        for depth, k in array.shapes:
            if depth <= labels and k <= len(path):
                candidates.append((host if depth == labels else ".".join(host.rsplit(".", depth)[1:]), path[:k]))
                owner.append(n)
    best: list = [None] * len(hosts)
    for j, i in enumerate(array.probe(candidates, digest)):
        if i >= 0:
            rule = (len("".join(candidates[j])), len(candidates[j][0]), i, candidates[j])
            if best[owner[j]] is None or rule[:2] > best[owner[j]][:2]:
                best[owner[j]] = rule
    return [b and "".join(b[3]) for b in best], [default if b is None else "block" if array.block[b[2]] else "allow" for b in best]


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _judge(batches: Iterator[pa.RecordBatch], prefix: str, default: str) -> Iterator[pa.RecordBatch]:
    array = DigestArray(SparkFiles.getRootDirectory(), prefix)
    for batch in batches:
        rules, verdicts = judge(array, batch.column("host").to_pylist(), batch.column("path").to_pylist(), default)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "rule", "verdict"])


def distribute(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> str:
    """Build the array once and hand its files to Spark, which brings them to every executor; returns their prefix."""
    prefix = f"rules-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="riverbend-")  # the driver serves the files from here as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    for path in DigestArray.build(rules, folder, prefix):
        spark.sparkContext.addFile(path)
    return prefix


def annotate(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, columns: Sequence[str] = ("page_id",)) -> DataFrame:
    """The named columns of pages, then host, path, rule and verdict, which replace named ones of these names."""
    prefix = distribute(pages.sparkSession, rules)
    url = F.col("url").cast("string")
    columns = [c for c in columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*[F.col(f"`{c}`") for c in columns], host_of(url).alias("host"), path_of(url).alias("path"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(lambda it: _judge(it, prefix, default)), f"{kinds}, rule string, verdict string")
