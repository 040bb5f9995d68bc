"""Best-fit packing: the plan is made over a histogram of lengths, and documents take its slots by rank within length.

A document's tokens, then the closing id 0, are cut into pieces of at most ``room``; best-fit decreasing runs over the
counts of the lengths, so its cost depends on ``room`` and not on the documents. Its result is a table of runs (length,
ranks, first sequence, offset), whose size is bounded by ``room`` too, and which every task holds.

Defined cases: null and empty texts are the one id 0; null or repeated ids are packed like others, rows alike in all
columns being interchangeable; an empty table gives an empty result. Texts are tokenised whole. Extra columns are not
carried.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import need, ship, stored, table
from .text import pieces, utf8

ROOM = 2048
#: About so many pieces share a (length, salt) group at most.
GROUP_ROWS = 500
#: Words that a worker remembers: about 200 bytes each.
KNOWN = 100_000
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Tokens:
    """Ids of texts as bytes of 32-bit little-endian numbers; words between ASCII white space are encoded apart, and remembered.

    That gives the ids of the whole text where the splitter never joins what white space parts, as with ``PLAN``; a tokenizer
    made otherwise gets whole texts. Words of letters, perhaps with punctuation behind, go straight to the BPE model; all
    others through the whole tokenizer.
    """

    # How a tokenizer is made whose words can be encoded apart.
    PLAN = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    }

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        made = json.loads(self.whole.to_str())
        self.apart = all(made[k] == v for k, v in self.PLAN.items()) and made["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in made["added_tokens"])
        self.model = self.whole.model
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in kept]
        self.signs = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _plain(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, core: bytes) -> bytes | None:
        if core.isalpha():
            word = core.lower().decode()
        else:
            text = core.decode()
            low = unicodedata.normalize("NFC", text).lower()
            if not text.isalpha() or not low.isalpha() or "Σ" in text or "İ" in text:
                return None
            word = low.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def word(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(_PUNCTUATION)
        tail = chunk[len(core) :]
        if core and len(chunk) <= 64 and (not tail or tail in self.cores or self._remember(tail, self._plain(tail.decode()))):
            got = self.cores.get(core)
            if got is None:
                got = self._remember(core, self._letters(core))
            if got is not None:
                return got + (self.cores[tail] if tail else b"")
        return self._plain(chunk.decode())

    def _remember(self, key: bytes, ids: bytes | None) -> bytes | None:
        if ids is not None:
            self.cores[key] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if not self.apart:
            return self._plain(text.decode())
        chunks, known = text.split(), self.known
        for c in set(chunks).difference(known):
            known[c] = self.word(c)
        out = b"".join(map(known.__getitem__, chunks))
        if len(known) > KNOWN:
            self.known = {}
        if len(self.cores) > KNOWN:
            self.cores = {}
        return out


_loaded: dict[str, Tokens] = {}


def loaded(path: str) -> Tokens:
    """One for each worker process, so that a task finds the words that earlier tasks met there."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def best_fit(counts: dict[int, int], room: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first sequence, offset) and the number of sequences, from the number of pieces of each length."""
    open_groups: list[list[tuple[int, tuple | None]]] = [[] for _ in range(room + 1)]  # by free room: (bins, chain of (length, times))
    shut: list[tuple[int, tuple | None]] = []

    def put(bins: int, chain: tuple | None, free: int) -> None:
        if bins:
            (open_groups[free] if free else shut).append((bins, chain))

    for length in sorted(counts, reverse=True):
        left, free = counts[length], length
        while left:
            while free < room and not open_groups[free]:
                free += 1
            fresh = free >= room
            at = room if fresh else free
            times = at // length
            bins, chain = (-(-left // times), None) if fresh else open_groups[at].pop()
            full = min(bins, left // times)
            put(full, (length, times, chain), at - times * length)
            left -= full * times
            bins -= full
            if bins and 0 < left < times:
                put(1, (length, left, chain), at - left * length)
                left, bins = 0, bins - 1
            if not fresh:
                put(bins, chain, at)
    runs, ranks, base = [], dict.fromkeys(counts, 0), 0
    for bins, chain in shut + [g for groups in open_groups for g in groups]:
        items = []
        while chain:
            items.append(chain[:2])
            chain = chain[2]
        at = 0
        for length, times in reversed(items):
            for _ in range(times):
                runs.append((length, ranks[length], base, at))
                ranks[length] += bins
                at += length
        base += bins
    return np.array(sorted(runs), np.int64).reshape(-1, 4), base


def cut(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of ``docs`` (id, text)."""

    def pieces_of(batches):
        tokens = loaded(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text"):
                buf, off = utf8(part.column("text"))
                raw = buf.tobytes()
                doc, piece, start, length, crc = [], [], [], [], []
                for r in range(part.num_rows):
                    ids = tokens.ids(raw[off[r] : off[r + 1]]) + b"\0\0\0\0"
                    for k, a in enumerate(range(0, len(ids), 4 * room)):
                        own = ids[a : a + 4 * room]
                        doc.append(r)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(pieces_of, f"id {docs.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs``."""
    ship(docs.sparkSession)
    cuts = stored(cut(need(docs, id=id_col, text=text_col), tokenizer, room), "pieces")
    counts = dict(map(tuple, cuts.groupBy("length").agg(F.count("*")).collect()))  # at most ``room`` rows
    salts = docs.sparkSession.createDataFrame([(k, -(-n // GROUP_ROWS)) for k, n in counts.items()], "length long, salts long")
    salted = cuts.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    groups = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    runs, _ = best_fit(counts, room)
    keys, bases, places = (runs[:, 0] << 40) + runs[:, 1], runs[:, 2] - runs[:, 1], runs[:, 3]
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside)).join(offsets, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - 1).alias("rank"))

    def take(batches):
        for b in batches:
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, (b.column("length").to_numpy(zero_copy_only=False) << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bases[run] + rank), pa.array(places[run])], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = cuts.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(take, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
