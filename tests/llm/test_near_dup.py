import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from loomstead.llm import near_dup
from loomstead.llm.components import components
from loomstead.llm.near_dup import linked, near_duplicates, super_minhash


def sets_of(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, k, p):
    sets = {i: sets_of(t, k) for i, t in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            for i in root:
                if root[i] == max(x, y):
                    root[i] = min(x, y)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def corpus(seed, n=240):
    rnd, rows = random.Random(seed), []
    bases = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([2, 5, 30, 120, 400]))] for _ in range(12)]
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(9999)}"
        rows.append((i * 7 % 1009, rnd.choice([" ", "\n", " \t"]).join(words).upper() if i % 5 == 0 else " ".join(words)))
    return rows + [(2000, ""), (2001, None), (2002, " \n"), (2003, "One"), (2004, "one"), (2005, "é É"), (2006, "é é")]


@pytest.mark.parametrize(("k", "p"), [(3, 85), (5, 80)])
def test_groups_are_those_of_brute_force(spark, k, p):
    rows = corpus(k)
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, node int, component string")
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(df, k, Fraction(p, 100)).collect()}
    assert got == groups(rows, k, p)


@pytest.mark.parametrize(("docs_of_a_block", "pivots", "broadcast"), [(3, 1, 0), (7, 4, 500_000)])
def test_large_clusters_lose_no_link(spark, monkeypatch, docs_of_a_block, pivots, broadcast):
    """Clusters of many blocks, shuffled or broadcast: near copies of a few texts, and texts that share most words but are linked with nothing."""
    monkeypatch.setattr(near_dup, "BROADCAST_MEMBERS", broadcast)
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", docs_of_a_block)
    monkeypatch.setattr(near_dup, "PIVOTS", pivots)
    rnd = random.Random(docs_of_a_block)
    rows, common = corpus(6, 160), [f"c{i}" for i in range(60)]
    for i in range(120):  # 3 of 4 words are common
        own = [f"o{i // 2}_{j}" for j in range(20)]
        own[rnd.randrange(20)] = f"y{i}"
        rows.append((5000 + i, " ".join(common + own)))
    asked = []
    monkeypatch.setattr(near_dup, "_rare_clusters", lambda *a, f=near_dup._rare_clusters: asked.append(1) or f(*a))
    for k, p in ((3, 85), (5, 80)):
        got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, Fraction(p, 100)).collect()}
        assert got == groups(rows, k, p)
    assert asked


def test_very_long_text_and_text_ids(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [("1", long), ("2", long + " end"), ("x", long), ("3", "a b c")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True)}


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (5, 1, 5, True), (5, 1, 5, True), (9, 1, 5, False), (None, 0, None, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 150, dtype=np.uint64)
    one, two = (np.concatenate([common, rng.integers(0, 2**63, 50, dtype=np.uint64)]) for _ in "ab")
    sig = super_minhash(np.concatenate([one, two]), np.array([0, 200, 400]), 200)
    assert abs((sig[0] == sig[1]).mean() - 150 / 250) < 0.1
    tiny = super_minhash(np.array([7], np.uint64), np.array([0, 0, 1]), 16)
    assert (tiny[0] == np.iinfo(np.uint64).max).all() and sorted(int(v) >> 40 for v in tiny[1]) == list(range(16))


def test_cells_of_two_blocks_lose_no_link():
    rnd = random.Random(5)
    sets = [np.unique(np.array([rnd.randrange(60) for _ in range(40)], np.uint64)) for _ in range(120)]
    block = np.array([i % 2 for i in range(120)])
    t = Fraction(6, 10)

    def closure(pairs):
        root = list(range(120))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return [tuple(i for i in range(120) if root[i] == r) for r in root]

    true = [(a, b) for a, b in itertools.combinations(range(120), 2) if block[a] != block[b] and len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b])) - 1e-9]
    assert closure(linked(sets, block, t)) == closure(true)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


@pytest.mark.parametrize("few", [0, 5, 100])
def test_components_by_contraction(spark, few):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(3000 - i, 2999 - i) for i in range(0, 90, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long").repartition(5), few).collect()))
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)} | {j: 2999 - i for i in range(0, 90, 3) for j in (3000 - i, 2999 - i)}


def test_components_of_random_links(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    root = list(range(300))
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()))
    assert got == {i: root[i] for i in {x for a, b in links if a != b for x in (a, b)}}
