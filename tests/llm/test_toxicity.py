import numpy as np
import pyarrow as pa

from loomstead.llm.toxicity import PRIOR, build, learn, op2_toxicity, score, term_counts

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op2_toxicity(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    own = got[got.held_out]
    assert (own.predicted == own.toxic).mean() > 0.97 and (own.predicted[own.toxic == 1]).mean() > 0.8
    assert got.score.between(0, 1).all() and (abs(own.score - own.toxic) ** 2).mean() < 0.03


def test_neighbours_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    n, vocabulary = 900, 40
    label = (rng.random(n) < 0.3).astype(float)
    cells = np.unique(np.stack([np.repeat(np.arange(n), 5), rng.zipf(1.4, 5 * n) % vocabulary], 1), axis=0)
    index = build(cells[:, 0], cells[:, 1].astype(np.uint64), rng.integers(1, 5, len(cells)), np.arange(n) * 3, label, 30)
    x = np.vstack([index.examples[::7], index.examples[:1] * 0])
    place, best = index.nearest(x, 9)
    cos = np.round((x @ index.examples.T).astype(float), 5)
    for r in range(len(x)):
        want = [i for i in np.lexsort((np.arange(n), -cos[r]))[:9] if cos[r, i] > 0]
        assert np.allclose(best[r][: len(want)], cos[r, want], atol=2e-5) and (place[r][len(want) :] == -1).all()
        if len(set(cos[r, want])) == len(want):
            assert place[r][: len(want)].tolist() == want


def test_terms_and_odd_tables(spark):
    terms, counts, off = term_counts(pa.array(["A, a! b", None, "", "é É x_y"]))
    assert np.diff(off).tolist() == [2, 0, 0, 4] and sorted(counts[:2]) == [1, 2]
    assert np.diff(term_counts(pa.array(["insulting insults"]))[2]).tolist() == [2 + 4 + 1]
    docs = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "id long, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    index = learn(docs, labels)
    assert [r.score for r in score(docs, index).collect()] == [0.5] * 3 and score(docs.limit(0), index).count() == 0


def test_votes_are_those_of_brute_force(spark):
    """Scores and evidence of whole texts, a very long one and clashing columns among them, by a plain cosine over all examples."""
    words = ["vile", "nasty", "awful", "kind", "river", "stone", "paper", "window"]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, " ".join(rng.choice(words[:3] + words[5:] if toxic else words[3:], 12)), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(900, "vile stone " * 60_000, "x", 1), (901, None, "x", 1)], "id long, text string, lang string, term int")
    index = learn(docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    got = {r.id: r for r in score(docs, index).collect()}
    assert len(got) == 602 and got[901].score == index.share_without and got[901].evidence == []
    for i, text in [(r[0], r[1]) for r in rows[::29]] + [(900, "vile stone " * 60_000)]:
        terms, counts, _ = term_counts(pa.array([text]))
        x = np.zeros(len(index.terms))
        for term, n in zip(terms, counts):
            at = np.searchsorted(index.terms, term)
            if at < len(index.terms) and index.terms[at] == term:
                x[at] = (1 + np.log(n)) * index.idf[at]
        if not x.any():
            assert got[i].score == index.share_without
            continue
        cos = np.round(index.examples.astype(float) @ (x / np.linalg.norm(x)), 5)
        best = np.lexsort((np.arange(len(cos)), -cos))[: index.votes]
        best = best[cos[best] > 0]
        weight = cos[best] ** 2
        want = ((weight * index.label[best]).sum() + PRIOR * index.share) / (weight.sum() + PRIOR)
        assert abs(got[i].score - want) < 5e-3 and len(got[i].evidence) == len(best)
        assert np.allclose([e.cosine for e in got[i].evidence], cos[best], atol=3e-5)
