"""URL filtering against a sorted array of 64-bit digests.

Rules are strings ``host + path``.  Their xxhash64 digests are kept as one sorted array in a file,
beside the full strings and verdicts.  The file goes to every node once with ``addFile``; tasks
memory-map it, so a list of any length costs no heap.  A page is probed with the host suffixes and
path prefixes whose lengths some rule has, by one vectorised binary search per batch, and a
digest that is found counts only if the stored string is equal.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded

VERDICTS = ("allow", "block")
Rule = tuple[str, str, str]


def digest_bytes(rules: Iterable[Rule]) -> bytes:
    """The digest file of (host, path, verdict) rules; of equal rules a block stays."""
    by_text: dict[bytes, int] = {}
    for host, path, verdict in rules:
        if not host or path[:1] not in ("", "/"):
            raise ValueError("a rule needs a host and a path that is empty or starts with /")
        key = (host.lower() + path).encode()
        by_text[key] = max(by_text.get(key, 0), VERDICTS.index(verdict))
    rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in by_text.items())
    ends = np.cumsum([0] + [len(k) for _, k, _ in rows]).astype("<i8")
    hosts = sorted({len(k.partition(b"/")[0]) for k in by_text})
    lengths = sorted({len(k.partition(b"/")[1] + k.partition(b"/")[2]) for k in by_text})
    parts = [
        np.array([len(rows), len(hosts), len(lengths)], "<i8"), np.array([d for d, _, _ in rows], "<u8"), ends, np.array(hosts, "<i8"), np.array(lengths, "<i8"),
        np.array([v for *_, v in rows], "u1"), np.frombuffer(b"".join(k for _, k, _ in rows), "u1"),
    ]
    return b"".join(p.tobytes() for p in parts)


class DigestArray:
    """A memory-mapped digest file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype="u1", mode="r")
        n, h, k = (int(x) for x in raw[:24].view("<i8"))
        at = 24
        self.digests = raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.host_lengths = raw[at : at + 8 * h].view("<i8").tolist()
        at += 8 * h
        self.path_lengths = raw[at : at + 8 * k].view("<i8").tolist()
        at += 8 * k
        self.verdicts, self.texts = raw[at : at + n], raw[at + n :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Row of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not keys or not len(self.digests):
            return found
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests):
            row = int(at[i])
            while row < len(self.digests) and self.digests[row] == digests[i]:
                if self.texts[self.ends[row] : self.ends[row + 1]].tobytes() == keys[i]:
                    found[i] = row
                    break
                row += 1
        return found


_open: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    if name not in _open:
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


def _probes(host: bytes, path: bytes, host_lengths: list[int], path_lengths: list[int]) -> list[bytes]:
    """Keys that a rule could have: the host and its parents, and starts of the path, of lengths that rules have."""
    hosts = [host[-n:] for n in host_lengths if n == len(host) or (n < len(host) and host[-n - 1] == 46)]
    paths = [path[:n] for n in path_lengths if n <= len(path)] if hosts else []
    return [h + p for h in hosts for p in paths]


def publish_rules(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Write the digest file on the driver and hand it to all nodes; returns its name."""
    content = digest_bytes(rules)
    name = f"url-rules-{sha256(content).hexdigest()[:20]}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="url-rules-"), name)
    with open(path, "wb") as out:
        out.write(content)
    if not any(f.rpartition("/")[2] == name for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``: host after the first ``://`` up to ``/``, ``?`` or ``#``; path then up to ``?`` or ``#``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lower, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def judge_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A rule fits its host and all subdomains when the page's path starts with the rule's path; of
    several the longest wins.  Without a fitting rule ``rule`` is null and the verdict is ``default``.

    Null urls and urls without ``://`` have an empty host and path and get the default.  Repeated rows
    and null page_ids are judged row by row; other columns are ignored, whatever their names.  Very
    long urls are used whole; memory grows with the rules' lengths, not with a host's labels.  An empty table or rule list gives no rows, or defaults only.
    """
    name = publish_rules(pages.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _mapped(name)
        for batch in batches:
            keys: list[bytes] = []
            counts = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = _probes(host.encode(), path.encode(), array.host_lengths, array.path_lengths)
                counts.append(len(own))
                keys += own
            rows = array.find(keys)
            rule, verdict, at = [], [], 0
            for n in counts:
                hits = [(len(keys[i]), i) for i in range(at, at + n) if rows[i] >= 0]
                at += n
                rule.append(keys[max(hits)[1]].decode() if hits else None)
                verdict.append(VERDICTS[array.verdicts[rows[max(hits)[1]]]] if hits else default)
            yield pa.record_batch([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    parts = split_url(bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    return parts.select("page_id", "host", "path").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
