"""URL filters over a sorted digest array.

Each rule is stored as the string host + path. Its 64-bit XXH64 digests, sorted, form an array in files, beside the strings
in the same order, in shards by digest range. The files are shipped with SparkContext.addFile, so that every executor maps
its own copy into memory: only pages that are probed are read, so a list may be larger than memory. A url is probed with its
host's suffixes joined to the prefixes of its path that have the length of some rule's path: one vectorised binary search a
batch and shard. A digest that is found is confirmed against the stored string.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end. A
null url or one without `://` has both empty. Empty and null urls, and urls that no rule fits, get the default verdict and
a null rule. Of the rules that fit, the longest wins (ties: the first by string); of equal rules the first. Urls of any
length are judged whole. Repeated rows are judged each. Extra columns are ignored; an empty table gives an empty result. The
rules are an argument, so the driver holds them.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): the rules of the contract query. The host ends at the first slash, the rest is a path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Digests in a shard: 512 MB of them. Probes made of a batch at a time.
SHARD, PROBES = 1 << 26, 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


class DigestArray:
    """Sorted 64-bit digests in memory-mapped files, in shards by range, with the strings they stand for."""

    FILES = ("keys", "ends", "text")

    def __init__(self, folder: str, name: str):
        def mapped(end: str, kind: type) -> np.ndarray:
            path = os.path.join(folder, f"{name}.{end}")
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)

        self.firsts = np.fromfile(os.path.join(folder, f"{name}.firsts"), np.uint64)
        self.shards = [(mapped(f"{k}.keys", np.uint64), mapped(f"{k}.ends", np.int64), mapped(f"{k}.text", np.uint8)) for k in range(len(self.firsts))]
        self.before = np.concatenate(([0], np.cumsum([len(keys) for keys, _, _ in self.shards]))).astype(np.int64)

    @staticmethod
    def write(folder: str, name: str, strings: list[str], digest=xxhash.xxh64_intdigest, shard: int | None = None) -> tuple[list[str], list[str]]:
        """Write the files; returns the strings in the order of their digests, and the files' names."""
        shard = shard or SHARD
        order = sorted((digest(s.encode()), s) for s in strings)
        files, firsts, at = [f"{name}.firsts"], [], 0
        while at < len(order):
            to = min(at + shard, len(order))
            while to < len(order) and order[to][0] == order[to - 1][0]:  # equal digests stay together
                to += 1
            data = [s.encode() for _, s in order[at:to]]
            for end, x in zip(DigestArray.FILES, (np.array([d for d, _ in order[at:to]], np.uint64), np.cumsum([len(d) for d in data]).astype(np.int64), np.frombuffer(b"".join(data), np.uint8))):
                files.append(f"{name}.{len(firsts)}.{end}")
                x.tofile(os.path.join(folder, files[-1]))
            firsts.append(order[at][0])
            at = to
        np.array(firsts, np.uint64).tofile(os.path.join(folder, files[0]))
        return [s for _, s in order], files

    def stored(self, i: int) -> bytes:
        k = int(np.searchsorted(self.before, i, "right")) - 1
        _, ends, text = self.shards[k]
        i -= int(self.before[k])
        return text[ends[i - 1] if i else 0 : ends[i]].tobytes()

    def find(self, probes: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Index of each probe in the array, -1 where it is not stored."""
        wanted = np.fromiter(map(digest, probes), np.uint64, len(probes))
        out = np.full(len(probes), -1, np.int64)
        shard = np.searchsorted(self.firsts, wanted, "right") - 1
        for k in np.unique(shard[shard >= 0]).tolist():
            keys = self.shards[k][0]
            mine = np.flatnonzero(shard == k)
            at = np.searchsorted(keys, wanted[mine])
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted[mine])
            for p, i in zip(mine[hit].tolist(), at[hit].tolist()):
                while i < len(keys) and keys[i] == wanted[p]:  # digests may collide: the string decides
                    if self.stored(int(self.before[k]) + i) == probes[p]:
                        out[p] = self.before[k] + i
                        break
                    i += 1
        return out


def suffixes(host: str, lengths: list[int]) -> list[str]:
    """The host and all it is a subdomain of, of the given lengths: a few, however long the host and however many its labels."""
    whole = len(host)
    return [host[whole - n :] for n in lengths if n == whole or (n < whole and host[whole - n - 1] == ".")]


def _folder() -> str:
    """A folder of the driver's, from which Spark serves files while the application runs."""
    folder = tempfile.mkdtemp(prefix="blockloom-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow", shard: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict per row of pages (page_id, url)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdict = {}
    for v, rule in rules:
        verdict.setdefault(rule, v)
    if not verdict:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hosts = sorted({r.find("/") if "/" in r else len(r) for r in verdict})
    lengths = sorted({len(r) - (r.find("/") if "/" in r else len(r)) for r in verdict})
    name, folder = f"urls-{uuid.uuid4().hex}", _folder()
    stored, shipped = DigestArray.write(folder, name, list(verdict), shard=shard)
    said = sorted(set(verdict.values()))
    np.array([said.index(verdict[r]) for r in stored], np.int8).tofile(os.path.join(folder, f"{name}.said"))
    for file in [*shipped, f"{name}.said"]:
        spark.sparkContext.addFile(os.path.join(folder, file))

    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = SparkFiles.getRootDirectory()
        array, code = DigestArray(root, name), np.memmap(os.path.join(root, f"{name}.said"), np.int8, "r")
        for names, paths in batches:
            best: list[tuple[int, str, str] | None] = [None] * len(names)
            probes: list[bytes] = []
            row: list[int] = []

            def settle(best: list = best, probes: list = probes, row: list = row) -> None:
                found = array.find(probes)
                for k in np.flatnonzero(found >= 0).tolist():
                    rule = array.stored(int(found[k])).decode()
                    hit = (-len(rule), rule, said[code[found[k]]])
                    if best[row[k]] is None or hit < best[row[k]]:
                        best[row[k]] = hit
                probes.clear()
                row.clear()

            for k, (h, p) in enumerate(zip(names, paths)):
                tails = suffixes(h, hosts)
                for n in lengths:
                    if n <= len(p):
                        probes += [(s + p[:n]).encode() for s in tails]
                        row += [k] * len(tails)
                if len(probes) >= PROBES:
                    settle()
            settle()
            yield pd.DataFrame({"rule": [b and b[1] for b in best], "verdict": [b[2] if b else default for b in best]}, dtype=object)

    hit = F.pandas_udf(probe, "rule string, verdict string")("host", "path")
    return pages.withColumn("hit", hit).select("page_id", "host", "path", "hit.rule", "hit.verdict")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query: page_id, host, path, rule, verdict over all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


OP6_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fits AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM fits
"""
