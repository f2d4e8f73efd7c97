"""Multi-index hashing: the same groups from any segments, and from crowded values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_whole_tables import least_reachable

from runlens.llm import simhash
from runlens.llm.components import components


@pytest.fixture(scope="module")
def values() -> list[int]:
    """Random fingerprints, chains of near ones, and a crowd around one that shares its halves."""
    random = np.random.default_rng(3)
    found = set(random.integers(-1 << 63, 1 << 63, 300).tolist()) | {0, -1, 1, -1 << 63}
    for start in list(found)[:60]:
        for _ in range(4):
            for bit in random.choice(64, random.integers(1, 4), replace=False):
                start ^= 1 << int(bit) if bit < 63 else -1 << 63
            found.add(start)
    center = int(random.integers(-1 << 62, 1 << 62))
    found |= {center ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(40, 60, 3)}
    return sorted(found)


def brute_links(values: list[int], most: int) -> set:
    bits = np.array(values, np.int64).view(np.uint64)
    links = set()
    for at, value in enumerate(bits):
        near = np.flatnonzero(np.bitwise_count(bits[:at] ^ value) <= most)
        links |= {(values[j], values[at]) for j in near}
    return links


@pytest.fixture(scope="module")
def prints(spark, values):
    return spark.createDataFrame([(value,) for value in values], "fp long")


def pairs(links) -> set:
    return {tuple(sorted(row)) for row in links.select("u", "v").collect()}


@pytest.mark.parametrize("most, segments", [(2, 1), (2, 2), (2, 4), (3, 2), (0, 2)])
def test_every_link_is_found_and_no_other(prints, values, most, segments):
    assert pairs(simhash.near_links(prints, most, segments)) == brute_links(values, most)


def test_segments_change_the_probes(prints, values):
    def probes(segments):
        return simhash.segment_table(prints, segments, 2 // segments).count() / len(values)

    assert [probes(segments) for segments in (1, 2, 4)] == [1 + 64 + 64 * 63 // 2, 66, 4]


def test_the_complete_distance_rejects_what_a_segment_fetches(prints, values):
    index, probes = simhash.segment_table(prints), simhash.segment_table(prints, radius=1)
    fetched = probes.withColumnRenamed("fp", "u").join(
        index.withColumnRenamed("fp", "v"), ["segment", "value"]).filter("u < v").select(
        "u", "v").distinct()
    assert fetched.count() > len(brute_links(values, 2)) == fetched.filter(
        F.expr("bit_count(u ^ v) <= 2")).count()


@pytest.mark.parametrize("crowded", [0, 3, 30])
def test_crowded_values_give_the_same_groups(spark, prints, values, crowded):
    wanted = least_reachable(values, brute_links(values, 2))
    found = {row.node: row.component for row in components(
        simhash.near_links(prints, crowded=crowded)).collect()}
    assert {value: found.get(value, value) for value in values} == wanted
