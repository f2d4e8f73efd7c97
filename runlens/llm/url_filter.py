"""URL filters on a sorted digest array.

Rules are strings `host/path`. The array holds their XXH64 digests in order, the full strings, and
the verdict of each, in one file that every executor fetches once and maps into memory. A URL has
one candidate per parent domain and per length that some rule's path has; the digests of a batch of
candidates are looked up together by binary search, and a hit counts only if the stored string is
the candidate itself, so colliding digests never decide.

A rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest
rule wins, of equally long ones that with the longer host. A null URL, or one without `://`, has an
empty host and path and no rule. Repeated rows get the same verdict; an empty table stays empty.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from runlens.session import scratch_dir

#: Rules a digest file may hold: each takes some 60 bytes of the driver while the file is written.
MAX_RULES = 5_000_000
ALLOW, BLOCK = "allow", "block"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, as text; both empty without `://`."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def digests(strings: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in strings), np.uint64)


def digest_file(rules: Iterable[tuple[str, str]]) -> bytes:
    """The array of (rule, verdict) pairs as bytes.

    Layout: counts of rules and of path lengths, digests in order, ends of the strings, path
    lengths, verdicts, strings.
    """
    pairs = sorted({rule.encode(): verdict for rule, verdict in rules}.items())
    if len(pairs) > MAX_RULES:
        raise ValueError(f"{len(pairs)} rules; a digest file holds {MAX_RULES}")
    keys = digests(rule for rule, _ in pairs)
    order = np.argsort(keys, kind="stable")
    names = [pairs[i][0] for i in order]
    lengths = sorted({len(name) - name.index(b"/") for name in names})
    return b"".join([
        np.array([len(names), len(lengths)], np.int64).tobytes(), keys[order].tobytes(),
        np.cumsum([len(name) for name in names], dtype=np.int64).tobytes(),
        np.array(lengths, np.int64).tobytes(),
        bytes(pairs[i][1] == BLOCK for i in order), b"".join(names)])


class DigestArray:
    """Memory-mapped digest file."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in data[:16].view(np.int64))
        cuts = np.cumsum([16, 8 * n, 8 * n, 8 * m, n])
        keys, ends, lengths, blocks = (data[a:b] for a, b in zip(cuts, cuts[1:]))
        self.keys, self.ends = keys.view(np.uint64), ends.view(np.int64)
        self.lengths, self.blocks = [int(x) for x in lengths.view(np.int64)], blocks
        self.names = data[cuts[-1]:]

    def _name(self, at: int) -> bytes:
        return self.names[self.ends[at - 1] if at else 0:self.ends[at]].tobytes()

    def find(self, candidates: list[bytes]) -> dict[int, int]:
        """Position in the array of each candidate that is a rule."""
        wanted = digests(candidates)
        at = np.searchsorted(self.keys, wanted)
        found = {}
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted):
            place = int(at[i])
            while place < len(self.keys) and self.keys[place] == wanted[i]:
                if self._name(place) == candidates[i]:
                    found[int(i)] = place
                    break
                place += 1
        return found

    def verdicts(self, hosts: list[str], paths: list[str]) -> tuple[list, list]:
        """The rule that decides each URL, and its verdict; None without one."""
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        candidates, owners = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            tails = [path[:n] for n in self.lengths if n <= len(path)]
            while tails and host:
                for tail in tails:
                    candidates.append(host + tail)
                    owners.append(i)
                host = host.partition(b".")[2]
        best: dict[int, tuple] = {}
        for c, place in (self.find(candidates) if candidates and len(self.keys) else {}).items():
            rule = candidates[c]
            rank = (len(rule), rule.index(b"/"))
            if rank > best.get(owners[c], ((-1,),))[0]:
                best[owners[c]] = (rank, place, rule)
        for i, (_, place, rule) in best.items():
            rules[i] = rule.decode()
            verdicts[i] = BLOCK if self.blocks[place] else ALLOW
        return rules, verdicts


def publish(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Write the digest file to the shared folder and name it to all executors, also later ones."""
    name = f"digests-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(target)
    out.write(digest_file(rules))
    out.close()
    spark.sparkContext.addFile(files.makeQualified(target).toString())
    return name


@lru_cache(4)
def _array(path: str) -> DigestArray:
    return DigestArray(path)


def judged(host: Column | str, path: Column | str, name: str) -> Column:
    """Struct of the deciding rule and its verdict, by the digest file `name`."""

    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        array = _array(os.path.join(SparkFiles.getRootDirectory(), name))
        for hosts, paths in batches:
            rules, verdicts = array.verdicts(hosts.to_pylist(), paths.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                ["rule", "verdict"])

    judge.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]],
                             "return": Iterator[pa.Array]}
    host, path = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")).cast("binary")
                  for x in (host, path))
    return F.arrow_udf(judge, "struct<rule:string,verdict:string>")(host, path)
