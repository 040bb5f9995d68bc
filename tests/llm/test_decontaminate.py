import random
from fractions import Fraction

import pytest

from loomstead.llm import decontaminate
from loomstead.llm.decontaminate import contained

from .test_near_dup import sets_of


def brute(docs, items, t):
    out = []
    for d, text in docs:
        own = sets_of(text, 5)
        for i, item in items:
            s = sets_of(item, 5)
            if s and Fraction(len(s & own), len(s)) >= t:
                out.append((d, i, len(s), len(s & own)))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 5, 6, 12, 30, 70, 300])))) for i in range(60)] + [(900, None), (901, ""), (902, "Two words"), (3, "w1 w2")]
    docs = []
    for d in range(150):
        words = [word() for _ in range(rnd.choice([0, 4, 50, 400, 6000]))]
        for _ in range(rnd.choice([0, 0, 1, 3])):
            part = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if part:
                    part[rnd.randrange(len(part))] = "changed"
            at = rnd.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, " ".join(words)))
    return docs + [(None, items[10][1]), (1, items[11][1]), (1, items[11][1]), (2, None), (3, "two  WORDS"), (4, items[1][1])], items


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, items = corpus()
    d, i = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item long"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contained(d, i).collect()), key=repr)
    assert got == brute(docs, items, Fraction(8, 10)) and len(got) > 50


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained(d, i.limit(0)).collect() == [] and contained(d.limit(0), i).collect() == [] and contained(d, i).count() == 1


def test_small_and_strewn_items_are_found(spark):
    rnd = random.Random(8)
    new = iter(range(1_000_000))
    fresh = lambda n: [f"u{next(new)}" for _ in range(n)]
    items, docs = [], []
    for i in range(240):
        part = fresh(5 + i % 4)
        items.append((i, " ".join(part)))
        docs.append((i, " ".join([part + fresh(200), fresh(200) + part, fresh(100) + part + fresh(100)][i // 4 % 3])))
    for i in range(240, 270):
        part = fresh(40)
        items.append((i, " ".join(part)))
        docs.append((i, " ".join(w for s in rnd.sample(range(36), 30) for w in part[s : s + 5] + fresh(300))))
    got = sorted((tuple(r) for r in contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == brute(docs, items, Fraction(8, 10)) and len(got) == len(docs)
