import zlib
from collections import Counter, defaultdict

import pytest

from loomstead.llm import sharding
from loomstead.llm.sharding import shard_by_bytes


@pytest.mark.parametrize("rows", [[], [(None, None)], [(i, "hot" * 20 if i % 3 else f"text {i} " * (i % 50)) for i in range(2000)] + [(7, "twice"), (7, "twice")]])
def test_sizes_slots_and_groups(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    got = shard_by_bytes(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, size, shards = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        shards[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if len(rows) > 100:
        mean = sum(size.values()) / 8
        assert max(abs(size[s] - mean) for s in range(8)) <= 2 * max(r.size for r in got) + mean / 50
        assert all(len(s) == 1 for crc, s in shards.items() if crc != zlib.crc32(b"hot" * 20))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """Few sampled keys make uneven ranges, and no range or piece may have more than a few rows; no shard is off by more than a few pieces."""
    monkeypatch.setattr(sharding, "SAMPLE", 20)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 9)
    rows = [(i, "hot" * 20 if i % 3 == 0 else f"text {i} " * (i % 9)) for i in range(3000)]
    test_sizes_slots_and_groups(spark, rows)
    sizes = [r.n for r in shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg({"size": "sum"}).toDF("shard", "n").collect()]
    assert max(sizes) < 1.02 * sum(sizes) / 8
