"""URL filter by a sorted digest array (operator 1).

Rules (host, path, verdict) are compiled into arrays of sorted 64-bit xxHash keys with the rule strings behind
them. Executors memory-map the arrays, probe them with a vectorised binary search, and compare the stored
string of every hit, so a hash collision cannot change a verdict.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import publish, published

#: Rules of one array file. More rules make more files, all probed; the longest rule over all files wins.
SHARD_RULES = 1_000_000
RESULT = "host string, path string, rule string, verdict string"
_LOWER = {c: c + 32 for c in range(65, 91)}
_MAGIC = b"SDA1"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host, A-Z lower-cased, follows the first ``://``; both are empty without it or for null."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((p for p in map(rest.find, "?#") if p >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Sorted keys, the order they came in, string offsets, and the strings."""
    keys = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
    order = np.argsort(keys, kind="stable")
    offsets = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(strings[i]) for i in order], out=offsets[1:])
    return keys[order], order, offsets, b"".join(strings[i] for i in order)


def compile_rules(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """One array file. Hosts are lower-cased; of equal rules with both verdicts, block wins."""
    verdicts: dict[tuple[str, str], bool] = {}
    for host, path, verdict in rules:
        key = (host.translate(_LOWER), path)
        verdicts[key] = verdicts.get(key, False) or verdict == "block"
    lengths: dict[str, set[int]] = {}
    for host, path in verdicts:
        lengths.setdefault(host, set()).add(len(path))
    hosts = list(lengths)
    hkeys, horder, hoffsets, hblob = _table([h.encode() for h in hosts])
    starts = np.zeros(len(hosts) + 1, np.int64)
    np.cumsum([len(lengths[hosts[i]]) for i in horder], out=starts[1:])
    cuts = np.array([n for i in horder for n in sorted(lengths[hosts[i]])], np.int64)
    pairs = list(verdicts)
    rkeys, rorder, roffsets, rblob = _table([f"{h}{p}".encode() for h, p in pairs])
    blocks = np.array([verdicts[pairs[i]] for i in rorder], np.int64)
    sizes = np.array([len(pairs[i][0].encode()) for i in rorder], np.int64)  # where the host ends
    parts = [hkeys, hoffsets, starts, cuts, rkeys, roffsets, blocks, sizes]
    head = struct.pack("<4s10q", _MAGIC, *map(len, parts), len(hblob), len(rblob))
    return head.ljust(96, b"\0") + b"".join(p.tobytes() for p in parts) + hblob + rblob


class DigestArray:
    """A compiled file, memory-mapped: pages are read as probes touch them and are shared between workers."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        magic, *sizes = struct.unpack("<4s10q", self.raw[:84].tobytes())
        if magic != _MAGIC:
            raise ValueError(f"{path} is no digest array")
        at, parts = 96, []
        for k, n in enumerate(sizes[:8]):
            parts.append(self.raw[at:at + 8 * n].view(np.uint64 if k in (0, 4) else np.int64))
            at += 8 * n
        self.hkeys, self.hoffsets, self.starts, self.cuts, self.rkeys, self.roffsets, self.blocks, self.host_ends = parts
        self.hblob, self.rblob = self.raw[at:at + sizes[8]], self.raw[at + sizes[8]:at + sizes[8] + sizes[9]]

    @staticmethod
    def _probe(keys: np.ndarray, offsets: np.ndarray, blob: np.ndarray, strings: list[bytes], host_ends=None,
               ends: list[int] | None = None) -> np.ndarray:
        """Index of each string, or -1: one binary search for all, then the stored strings decide."""
        found = np.full(len(strings), -1, np.int64)
        if not len(keys) or not strings:
            return found
        digests = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        place = np.searchsorted(keys, digests)
        inside = place < len(keys)
        hit = np.flatnonzero(inside & (keys[np.minimum(place, len(keys) - 1)] == digests))
        for i in hit:
            at = place[i]
            while at < len(keys) and keys[at] == digests[i]:  # past other strings of the same digest
                same = blob[offsets[at]:offsets[at + 1]].tobytes() == strings[i]
                if same and (ends is None or host_ends[at] == ends[i]):
                    found[i] = at
                    break
                at += 1
        return found

    def longest(self, urls: list[tuple[str, str]]) -> list[tuple[int, int, str, str, bool] | None]:
        """For each (host, path) the longest fitting rule as (length, host length, host, path, block), or None."""
        suffixes: dict[str, int] = {}
        own: dict[str, list[str]] = {}
        for host in {h for h, _ in urls}:
            tails, at = [host], host.find(".")
            while at >= 0:
                tails.append(host[at + 1:])
                at = host.find(".", at + 1)
            own[host] = tails
            for tail in tails:
                suffixes.setdefault(tail, len(suffixes))
        names = list(suffixes)
        place = self._probe(self.hkeys, self.hoffsets, self.hblob, [s.encode() for s in names])
        known = {s: self.cuts[self.starts[p]:self.starts[p + 1]].tolist() for s, p in zip(names, place, strict=True) if p >= 0}
        fitting = {h: [(t, n) for t in tails if t in known for n in known[t]] for h, tails in own.items()}
        tries: dict[tuple[str, str], int] = {}
        for host, path in set(urls):
            for tail, n in fitting[host]:
                if n <= len(path):
                    tries.setdefault((tail, path[:n]), len(tries))
        pairs = list(tries)
        got = self._probe(self.rkeys, self.roffsets, self.rblob, [f"{h}{p}".encode() for h, p in pairs],
                          self.host_ends, [len(h.encode()) for h, _ in pairs])
        out = []
        for host, path in urls:
            best = None
            for tail, n in fitting[host]:
                if n <= len(path) and (at := got[tries[tail, path[:n]]]) >= 0:
                    rule = (len(tail) + n, len(tail), tail, path[:n], bool(self.blocks[at]))
                    best = rule if best is None else max(best, rule)
            out.append(best)
        return out


@lru_cache(maxsize=64)
def _opened(path: str) -> DigestArray:
    return DigestArray(path)


def publish_rules(spark: SparkSession, rules: DataFrame | Iterable[tuple[str, str, str]],
                  shard_rules: int = SHARD_RULES) -> list[str]:
    """Compile and hand out the rules; names of the array files.

    ``rules``: rows (host, path, verdict), as a table or a small list. A table is dealt by a hash of the rule into
    shards of about ``shard_rules``; the driver holds one shard at a time. Rules with a null part are left out.
    """
    if not isinstance(rules, DataFrame):
        return [publish(spark, "urls", compile_rules(rules))]
    rules = rules.select("host", "path", "verdict").dropna()
    shards = max(1, -(-rules.count() // shard_rules))
    shard = F.pmod(F.xxhash64("host", "path"), F.lit(shards))
    return [
        publish(spark, "urls", compile_rules(tuple(r) for r in rules.where(shard == k).toLocalIterator()))
        for k in range(shards)
    ]


def judge(url: Column, files: list[str], default: str = "allow") -> Column:
    """Struct (host, path, rule, verdict) of each url; ``default`` is the verdict where no rule fits.

    A rule fits its host and all subdomains where the path starts with the rule's path. The longest rule wins; of
    equally long ones that with the longer host. Null, or without ``://``: host and path are empty.
    """

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        arrays = [_opened(published(f)) for f in files]
        for urls in batches:
            parts = [split_url(u if isinstance(u, str) else None) for u in urls]
            best: list = [None] * len(parts)
            for array in arrays:
                best = [b if a is None else a if b is None else max(a, b) for a, b in zip(best, array.longest(parts), strict=True)]
            yield pd.DataFrame({
                "host": [h for h, _ in parts],
                "path": [p for _, p in parts],
                "rule": [b and b[2] + b[3] for b in best],
                "verdict": [default if b is None else "block" if b[4] else "allow" for b in best],
            }, dtype=object)

    return judged(url)


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], url: str = "url",
                into: str = "judged", default: str = "allow") -> DataFrame:
    """``pages`` with a struct column ``into``; all other columns and rows stay. No shuffle."""
    files = publish_rules(pages.sparkSession, rules)
    return pages.withColumn(into, judge(F.col(url), files, default))
