import zlib
from fractions import Fraction

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

from .test_decontaminate import brute as leaks
from .test_near_dup import groups
from .test_suffix_dedup import WINDOW

SF = "/root/testdata/sf0.001"


def cut_whole_characters(rows):
    first = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - WINDOW + 1):
            s = b[p : p + WINDOW]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - WINDOW + 1):
            if first[b[p : p + WINDOW]] < i:
                gone[p : p + WINDOW] = b"\1" * WINDOW
        kept, at = [], 0
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, rows, seen = docs.count(), {}, []
    for name, stage in pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == pipeline.COLUMNS
        rows = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert np.mean([(d in rows) == bool(q) for d, q in labels.items()]) > 0.95 and len(rows) < n
        elif name == "near_dup":
            assert set(rows) == {i for i, (_, _, kept) in groups(sorted(before.items()), 5, 80).items() if kept}
        elif name == "suffix_dedup":
            assert rows == cut_whole_characters(sorted(before.items()))
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(rows) == set(before) - {d for d, *_ in leaks(sorted(before.items()), items, Fraction(8, 10))}
        seen.append(len(rows))
    whole = Tokenizer.from_file(pipeline.TOKENIZER)
    want = set()
    for i, t in rows.items():
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], np.uint32)
        want |= {(i, k, a, zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    got = pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert sorted(map(tuple, pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in got)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_rows_at_every_stage(spark):
    """Nulls in every column, repeated rows, shared ids, ties, empty texts and columns that clash with the operators' own."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    text = "The old mill stands by the river, and its wheel has turned for longer than anyone in the village can say. " * 3
    rows = [
        (1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, text, None, None, None), (3, text + "Once more, with a few words behind.", "en", "a", 9), (None, text, "en", "a", 9), (None, None, None, None, None),
        (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, f"Before it. {item} After it.", "en", "a", 9), (None, item, "en", "a", 9), (6, "Another row of that id.", "en", "a", 9),
    ]
    docs = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, component string, row string")
    stage = dict(pipeline.STAGES)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    ran = {name: sorted(stage[name](spark, docs, SF).collect(), key=key) for name in ("quality", "near_dup", "suffix_dedup", "decontamination")}
    assert all(list(r.asDict()) == pipeline.COLUMNS for got in ran.values() for r in got)
    assert {(r.doc_id, r.text) for r in ran["quality"]} <= {(r[0], r[1]) for r in rows}
    near = [(r.doc_id, r.text) for r in ran["near_dup"]]
    assert near.count((1, text)) == 2 and not any(d == 2 for d, _ in near) and sum(d is None for d, _ in near) == 3 and (4, None) in near and (5, "") in near
    cut = [(r.doc_id, r.text, r.n_chars) for r in ran["suffix_dedup"]]
    assert len(cut) == len(rows) and all(n == len(t) for _, t, n in cut) and cut.count((1, text, len(text))) == 2 and (2, "", 0) in cut and (None, text, len(text)) in cut and (4, "", 0) in cut
    clean = [(r.doc_id, r.text) for r in ran["decontamination"]]
    assert len(clean) == len(rows) - 2 and (6, "Another row of that id.") in clean and (None, item) not in clean
    packed = stage["packing"](spark, docs, SF).collect()
    assert sum(r.doc_id is None for r in packed) == 3 and sum(r.doc_id in (4, 5) and r.length == 1 for r in packed) == 2
