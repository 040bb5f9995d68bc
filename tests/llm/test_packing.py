import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomstead.llm import packing
from loomstead.llm.packing import Tokens, best_fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  \n", "It's *** Ünï-codé!! don't <|endoftext|>x 12.5%", "ΣΑΣ\u00a0x\u2003y e\u0301 İi ſ", "a" * 300, "日本語 テスト ॐ नमस्ते", "x\x1cy \x85 z", "re, Re. RE!!", "'s 't ''s", "ﬁ ½ ² ⅷ"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_whole_text(text):
    assert np.frombuffer(Tokens(PATH).ids(text.encode()), np.uint32).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_another_tokenizer_gets_whole_texts(tmp_path):
    """One that keeps capitals and knows a token with a space."""
    made = json.loads(Tokenizer.from_file(PATH).to_str())
    made["normalizer"] = None
    made["added_tokens"].append({**made["added_tokens"][0], "id": len(made["model"]["vocab"]) + 5, "content": "two words"})
    (tmp_path / "t.json").write_text(json.dumps(made))
    text = "Some TEXT of two words and more"
    assert np.frombuffer(Tokens(str(tmp_path / "t.json")).ids(text.encode()), np.uint32).tolist() == Tokenizer.from_file(str(tmp_path / "t.json")).encode(text, add_special_tokens=False).ids


def test_a_frequent_length_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 5)
    test_round_trip(spark, [(i % 50, "x y") for i in range(90)] + [(None, "x y")])


def test_plan_is_whole_and_close_to_the_bound():
    rng = np.random.default_rng(1)
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(rng.lognormal(5, 1, 5000).astype(int) + 1, 100), return_counts=True))}
    runs, n = best_fit(counts, 100)
    assert n <= -(-sum(k * v for k, v in counts.items()) // 100) * 1.35


@pytest.mark.parametrize("rows", [[], [(1, "a"), (1, "a"), (None, None), (2, ""), (3, "word " * 5000)], [(i, "x y " * (i % 40)) for i in range(300)]])
def test_round_trip(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, piece string")
    got = pack(df, PATH, 64).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for doc, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        want += [(doc, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
