import random
import time

import numpy as np
import pyarrow as pa
import pytest

from loomstead.llm.suffix_dedup import WINDOW, _repeated, interleave, repeated_bytes, runs_of


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - WINDOW + 1):
                s = b[p : p + WINDOW]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - WINDOW + 1):
            if i is not None and first[b[p : p + WINDOW]] < i:
                gone[p : p + WINDOW] = b"\1" * WINDOW
        spans = [p for p in range(len(b)) if gone[p] and not (p and gone[p - 1])]
        out.append((i, len(b), len(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice(["the ", "on ", "é", "ing", "er ", "\n"]) for _ in range(n)) for n in (10, 13, 20, 60, 200)]
    rows = []
    for i in range(150):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefg hij") for _ in range(rnd.choice([3, 40, 90]))) for _ in range(rnd.choice([0, 1, 3, 6]))]
        rows.append((rnd.randrange(1000), "".join(parts)))
    rows += [rows[3], (rows[5][0], rows[9][1]), (None, passages[4]), (7777, None), (7778, "a" * 49), (7779, "a" * 50), (7780, "a" * 500), (7781, "ab" * 300), (1, passages[4][:50]), (2, passages[4][:51])]
    return rows + [(8000 + k, passages[4] * 2) for k in range(30)]


@pytest.mark.parametrize("chunk", [8 << 20, 900])
def test_bytes_are_those_of_brute_force(spark, chunk):
    rows = corpus(chunk)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int")
    got = [(r.doc_id, r.n_bytes, len(r.starts), bytes(r.kept)) for r in repeated_bytes(df, chunk_bytes=chunk).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_interleave_finds_the_least_document_of_each_window():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.choice([12, 40]))).encode() for _ in range(60)]
    size = np.array([len(t) for t in texts])
    doc = np.array([rnd.randrange(50) for _ in texts])
    got = interleave(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size - 11, doc, 12)
    least = {}
    windows = [(t[p : p + 12], d) for t, d in zip(texts, doc) for p in range(len(t) - 11)]
    for w, d in windows:
        least[w] = min(least.get(w, d), d)
    assert got.tolist() == [least[w] for w, _ in windows]


def test_equal_windows_have_equal_minimizers_across_slices():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 300_000, dtype=np.uint8)
    buf = np.concatenate([rng.integers(97, 123, 77, dtype=np.uint8), body, body])
    off = np.array([0, 77 + len(body), len(buf)])
    start, many, m = runs_of(buf, off)
    assert many.sum() == sum(np.diff(off) - 49)
    one = np.repeat(m, many)
    assert (one[77 : 77 + len(body) - 49] == one[77 + len(body) - 49 :]).all()


def bucket(chunks):
    """Rows as the chunks send them to a bucket, of (minimizers in several documents, in one document)."""
    blobs = [[np.sort(np.array(x, np.uint32)).tobytes() for x in c] for c in chunks]
    return pa.table({"chunk": pa.array(range(len(chunks)), pa.int64()), "bucket": pa.array([3] * len(chunks), pa.int64()), "several": pa.array([b[0] for b in blobs], pa.binary()), "single": pa.array([b[1] for b in blobs], pa.binary())})


def test_a_chunk_is_told_its_minimizers_of_two_documents():
    rnd = random.Random(4)
    chunks = []
    for _ in range(20):
        own = rnd.sample([*range(300), 2**32 - 1], rnd.choice([0, 5, 40]))
        k = rnd.randrange(4)
        chunks.append((own[:k], own[k:]))
    got = {(c, int(v)) for c, blob in zip(*(_repeated(bucket(chunks)).column(x).to_pylist() for x in ("chunk", "blob"))) for v in np.frombuffer(blob, np.uint32)}
    often = lambda v: sum(v in a + b for a, b in chunks) > 1 or any(v in a for a, _ in chunks)
    assert got == {(c, v) for c, (a, b) in enumerate(chunks) for v in a + b if often(v)}


def test_minimizers_of_a_bucket_cost_about_as_much_as_sorting_them():
    rng = np.random.default_rng(5)
    t = bucket([([], rng.choice(2**32, 100_000, replace=True)) for _ in range(20)])
    values = rng.integers(0, 2**63, 2_000_000).astype(np.uint64)
    took = []
    for f in (lambda: np.sort(values), lambda: _repeated(t)):
        runs = []
        for _ in range(3):
            began = time.process_time()
            f()
            runs.append(time.process_time() - began)
        took.append(min(runs))
    assert took[1] < 20 * took[0]


def test_characters_that_lose_some_bytes_only_stay_whole(spark):
    shared = "é" * 30 + "x" + "日本" * 10
    rows = [(1, "q" + shared), (2, "\u00c3z" + shared + "\u672a"), (3, "\u0169" + "é" * 26 + "日"), (4, shared), (5, "Ãé" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.starts, r.ends) for r in repeated_bytes(df, characters=True).collect()}
    for i, t in rows:
        raw, gone = t.encode(), set()
        for p in range(len(raw) - WINDOW + 1):
            if any(j < i and raw[p : p + WINDOW] in u.encode() for j, u in rows):
                gone.update(range(p, p + WINDOW))
        at, keep, lost = 0, b"", []
        for c in t:
            n = len(c.encode())
            if all(x in gone for x in range(at, at + n)):
                lost += range(at, at + n)
            else:
                keep += c.encode()
            at += n
        assert got[i] == (keep, [p for p in lost if p - 1 not in lost], [p + 1 for p in lost if p + 1 not in lost])
