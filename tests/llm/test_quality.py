import numpy as np
import pyarrow as pa

from loomstead.llm.quality import NAMES, grow, learn, op7_quality, score, statistics

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op7_quality(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    own = got[got.held_out]
    assert (own.predicted == own.quality).mean() > 0.97 and got.score.between(0, 1).all()


def test_statistics_of_odd_texts():
    texts = ["", None, "\n\n", "a", "Word word WORD\nline\nline", "é" * 9, "x" * 300_000]
    x = statistics(pa.array(texts))
    assert x.shape == (len(texts), len(NAMES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all() and x[4][NAMES.index("distinct_words")] == 2 / 5 and x[4][NAMES.index("repeated_lines")] > 0.3
    assert np.allclose(x[4:5], statistics(pa.array(texts[4:5])))


def test_trees_learn_an_interaction_and_one_class():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    assert ((grow(x, y).score(x) > 0.5) == y).mean() > 0.95
    assert np.allclose(grow(x, np.ones(3000)).score(x), 3001 / 3002)


def test_empty_tables_and_nulls(spark):
    docs = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "id long, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    trees = learn(docs, labels)
    assert [r.quality_score for r in score(docs, trees).collect()] == [0.5] * 3 and score(docs.limit(0), trees).count() == 0


def test_flat_trees_walk_like_scalar_ones():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(700, 5)), rng.random(700) < 0.4
    trees = grow(x, y.astype(float), trees=25)

    def walk(row):
        z = trees.base
        for feature, above, leaf in zip(trees.feature.tolist(), trees.above.tolist(), trees.leaf.tolist()):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > above[node] else 1)
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(trees.score(x), [walk(r) for r in x], atol=1e-12)


def test_statistics_by_hand():
    text = "Ab 12, cd!\nAb 12, cd!\n\nlonglonglonglonglong x"
    got = dict(zip(NAMES, statistics(pa.array([text]))[0]))
    n = len(text)
    want = {
        "bytes": np.log1p(n), "words": np.log1p(8), "lines": np.log1p(3), "word_length": n / 8, "line_words": 8 / 3, "space": text.count(" ") / n + 3 / n, "upper": 2 / n, "digit": 4 / n, "comma": 2 / n, "exclaim": 2 / n,
        "distinct_words": 5 / 8, "top_word": 2 / 8, "repeated_lines": 1 - 2 / 3, "top_line": 2 / 3, "long_words": 1 / 8,
    }
    assert {k: round(float(got[k]), 9) for k in want} == {k: round(float(v), 9) for k, v in want.items()}


def test_clashing_columns_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "a"), (2, None, "b"), (2, None, "b")], "id long, text string, x string")
    trees = grow(np.random.default_rng(0).random((50, len(NAMES))), np.arange(50) % 2.0)
    got = score(docs, trees, keep_text=True).collect()
    assert [(r.id, r.x, len(r.text or "")) for r in got] == [(1, "a", 2_000_000), (2, "b", 0), (2, "b", 0)] and got[1].quality_score == got[2].quality_score
