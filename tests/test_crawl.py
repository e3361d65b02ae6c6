"""The crawl by levels against the queue that defines it."""

import random
from collections import deque

import pytest

from curaspark.operators import crawl


def queue(roots, links, depth, pages, sources):
    out = []
    for root in roots:
        waiting, seen, left, more, place = deque([(root, 0, [])]), {root}, pages, sources, 0
        while waiting:
            node, at, chain = waiting.popleft()
            if at >= depth:
                continue
            if left <= 0 or more <= 0:
                break
            left -= 1
            for dst in [d for _, d in sorted((o, d) for s, d, o, entry, inner in links if s == node and (inner if at else entry))]:
                if dst in seen or left <= 0 or more <= 0:
                    continue
                seen.add(dst)
                place, more = place + 1, more - 1
                out.append((root, place, dst, at + 1, node, [*chain, node]))
                waiting.append((dst, at + 1, [*chain, node]))
    return sorted(out)


@pytest.mark.parametrize("depth,pages,sources", [(3, 16, 16), (3, 4, 50), (2, 50, 7), (3, 1, 5), (1, 50, 50), (3, 60, 60)])
def test_levels_equal_the_queue(spark, depth, pages, sources):
    rng = random.Random(depth * 100 + pages)
    links = [(s, rng.randrange(60), o, rng.random() < 0.9, rng.random() < 0.8) for s in range(60) for o in range(rng.randrange(7))]
    links += links[::9]
    df = spark.createDataFrame(links, "src int, dst int, ordinal int, entry boolean, inner boolean").repartition(3)
    roots = [0, 7, 7, 13, 59]
    got = crawl.crawl(spark.createDataFrame([(r,) for r in roots], "root int"), df, depth, pages, sources)
    assert sorted((r["root"], r["place"], r["node"], r["level"], r["parent"], r["chain"]) for r in got.collect()) == queue(sorted(set(roots)), links, depth, pages, sources)


def test_nothing_to_crawl(spark):
    none = spark.createDataFrame([], "src string, dst string, ordinal int")
    assert crawl.crawl(spark.createDataFrame([("a",), (None,)], "root string"), none).count() == 0
    assert crawl.crawl(spark.createDataFrame([], "root string"), none).count() == 0
