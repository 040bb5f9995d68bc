"""Suffix-array dedup: strings of ``WINDOW`` bytes that an earlier document also has, found by interleave refinement.

This departs from a full merge of shard Burrows-Wheeler transforms: no shard's transform is built beforehand, and exact
folding of equal texts comes before the refinement. The README says why.

1. Documents are stored in chunks of about ``CHUNK`` bytes, in a table bucketed by chunk, so that later joins by chunk move
   no text. A chunk cuts its windows into runs that share a minimizer (the least hash of a ``GRAM``-byte string in the window).
2. Minimizers that occur in one document only can't stand in a repeated window; all others are told to the chunks.
3. A chunk sends the distinct texts of its runs with repeated minimizers, with their smallest and largest document and their
   places in the chunk, to the bucket of the minimizer: equal windows always meet there.
4. A bucket puts the distinct texts one behind another and refines the order of their windows: each step deals them out,
   stably, by the four bytes before the place reached, so that after step t they are in the order of their last 4t bytes,
   and groups with that much in common are carried along. Windows alone in their group leave.
   After WINDOW bytes the groups are the repeated intervals. Each interval's smallest document goes back to the chunks, with
   the places of its windows.
5. A chunk takes the places whose smallest document is below their own and cuts those bytes out; it looks for no runs again.

Repeated texts are folded before each shuffle (within a chunk, then within a bucket), so copies cost no more than chunks.

Defined cases: null texts are empty; rows with a null id neither lose bytes nor take bytes from others; rows that share an
id don't take from each other; ids are whole numbers, and a text id that isn't one counts as null; texts under WINDOW bytes lose nothing; an empty table gives an empty result. Extra columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import need, scratch_table, shared_folder, ship, shuffle_width, stored, table
from .text import _BYTE, U, utf8

#: A longer string is less often repeated by chance, but makes shorter runs.
WINDOW, GRAM = 50, 24
CHUNK = 8 << 20
#: Bytes of documents for each bucket of minimizers.
BUCKET = 16 << 20
_SLICE = 1 << 15
_FACTORS = [U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F), U(0xA24BAED4963EE407), U(0x8EBC6AF09C88C6E3)]
_TABLE = _BYTE.copy()
for _b in (0x20, *range(0x09, 0x0E)):
    _TABLE[_b] = 0x8EBC6AF09C88C6E3 * (2 * _b + 1) % 2**64


def pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.array([a.nbytes], np.int64).tobytes() + a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def runs_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, minimizer) of each run of windows that share a minimizer; a run stays in its row."""
    n, out = len(buf), []
    ends = off[1:]
    width = WINDOW - GRAM + 1
    one, two = np.empty((2, _SLICE + WINDOW), U)
    for a in range(0, n - WINDOW + 1, _SLICE):
        b = min(a + _SLICE, n - WINDOW + 1)
        with np.errstate(over="ignore"):
            h, spare = np.take(_TABLE, buf[a : b + WINDOW - 1], out=one[: b - a + WINDOW - 1], mode="clip"), two
            for step, factor in zip((1, 2, 4), _FACTORS, strict=False):
                wider = np.multiply(h[:-step], factor, out=spare[: len(h) - step])
                wider += h[step:]
                h, spare = wider, one if spare is two else two
            eight = h  # hashes of 8 bytes, then of 16 and of 24
            h = np.multiply(eight[:-8], _FACTORS[3], out=spare[: len(eight) - 8])
            h += eight[8:]
            h = h[:-8]
            h *= _FACTORS[4]
            h += eight[16:]
            free = one if spare is two else two
            h ^= np.right_shift(h, U(29), out=free[: len(h)])
            h *= U(0xBF58476D1CE4E5B9)
        have = 1
        while 2 * have <= width:
            h, free, spare = np.minimum(h[:-have], h[have:], out=free[: len(h) - have]), spare, free
            have *= 2
        if have < width:
            h = np.minimum(h[: have - width], h[width - have :], out=free[: len(h) + have - width])
        rows = slice(np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b + WINDOW) + 1)
        good = np.ones(b - a, bool)
        for e in ends[rows]:
            good[max(0, e - WINDOW + 1 - a) : max(0, min(e, b) - a)] = False
        change = np.empty(b - a, bool)
        change[0] = True
        np.not_equal(h[1:], h[:-1], out=change[1:])
        change[1:] |= good[1:] != good[:-1]
        at = np.flatnonzero(change)
        size = np.diff(np.append(at, b - a))
        kept = good[at]
        m = h[at[kept]]
        out.append((at[kept] + a, size[kept], m ^ (m >> U(32))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bucket(minimizer: np.ndarray, buckets: int) -> np.ndarray:
    return ((minimizer >> U(32)) & U(0xFFFFFF)) % U(buckets)


def _chunked(size: int):
    """Rows with the number of their chunk: a task begins a new one after every ``size`` bytes."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, have = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            at, (_, off) = 0, utf8(b.column("text"))
            while at < b.num_rows:
                to = min(b.num_rows, max(at + 1, int(np.searchsorted(off, off[at] + size - have, side="right")) - 1))
                part = b.slice(at, to - at)
                yield part.append_column("chunk", pa.array(np.full(part.num_rows, chunk)))
                have += int(off[to] - off[at])
                at = to
                if have >= size or at < b.num_rows:
                    chunk, have = chunk + 1, 0

    return chunked


def _docs(texts: pa.ChunkedArray | pa.Array, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, ids and which rows have an id."""
    buf, off = utf8(texts)
    return buf, off, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)


def _own_runs(buf, off, known):
    """Runs of the rows that have an id, with each run's row."""
    start, many, minimizer = runs_of(buf, off)
    row = np.searchsorted(off, start, side="right") - 1
    if not known.all():
        keep = known[row]
        start, many, minimizer, row = start[keep], many[keep], minimizer[keep], row[keep]
    return start, many, minimizer, row


def _keys(m: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a minimizer in one number."""
    return (_bucket(m, buckets) << U(32)) | (m & U(0xFFFFFFFF))


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """Of sorted keys: where each cell (their upper half) begins, and the end."""
    return np.searchsorted(keys, np.arange(cells + 1, dtype=U) << U(32))


def _binary(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The values between one place of ``cut`` and the next as bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer((cut * values.itemsize).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit numbers of a column of bytes, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32), np.fromiter(map(len, rows), np.int64, len(rows)) // 4


def _minimizers(buckets: int):
    def found(batches):
        for b in batches:
            if not b.num_rows:
                continue
            places = np.flatnonzero(np.diff(b.column("chunk").to_numpy(zero_copy_only=False), prepend=-1))
            for at, to in zip(places, np.append(places[1:], b.num_rows), strict=True):
                part = b.slice(at, to - at)
                buf, off, ids, known = _docs(part.column("text"), part.column("id"))
                _, _, m, row = _own_runs(buf, off, known)
                key = _keys(m, buckets)
                order = np.argsort(key)
                key, doc = key[order], ids[row[order]]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(key) else np.zeros(0, bool)
                key = key[first]
                cuts = []
                for own in (key[several], key[~several]):
                    cuts.append((own.astype(np.uint32), _cells(own, buckets)))
                some = np.flatnonzero(np.diff(cuts[0][1]) + np.diff(cuts[1][1]))
                chunk = part.column("chunk")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), chunk, np.int64)), pa.array(some.astype(np.int64)), *(_binary(own, np.append(cut[some], cut[-1])) for own, cut in cuts)],
                    ["chunk", "bucket", "several", "single"])

    return found


def _repeated(t: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, those of its minimizers that occur in two documents."""
    cells = np.arange(t.num_rows, dtype=U)
    seen = []
    for flag, column in enumerate(("single", "several")):
        values, counts = _numbers(t.column(column))
        seen.append((values.astype(U) << U(32)) | np.repeat(cells << U(1) | U(flag), counts))
    seen = np.sort(np.concatenate(seen))
    value = seen >> U(32)
    edge = np.ones(len(seen) + 1, bool)
    np.not_equal(value[1:], value[:-1], out=edge[1:-1])
    often = ~(edge[:-1] & edge[1:]) | (seen & U(1)).astype(bool)
    out = np.sort((seen[often] & U(0xFFFFFFFF)) >> U(1) << U(32) | value[often])
    cut = _cells(out, t.num_rows)
    some = np.flatnonzero(np.diff(cut))
    return pa.table({"chunk": t.column("chunk").take(pa.array(some)), "bucket": t.column("bucket").take(pa.array(some)), "blob": _binary(out.astype(np.uint32), np.append(cut[some], cut[-1]))})


def _segments(buckets: int):
    def sent(docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if docs.num_rows and replies.num_rows:
            buf, off, ids, known = _docs(docs.column("text").combine_chunks(), docs.column("id").combine_chunks())
            start, many, m, row = _own_runs(buf, off, known)
            values, counts = _numbers(replies.column("blob"))
            often = np.sort((np.repeat(replies.column("bucket").to_numpy().astype(U), counts) << U(32)) | values)
            key = _keys(m, buckets)
            keep = np.flatnonzero(often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key)
            bucket = (key[keep] >> U(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keep, bucket = keep[order], bucket[order]
            start, many, doc = start[keep], many[keep], ids[row[keep]]
            raw, place = buf.tobytes(), {}
            # equal texts share their minimizer, hence their bucket: numbers given in turn are in order of buckets
            number = np.fromiter((place.setdefault(raw[a:b], len(place)) for a, b in zip(start.tolist(), (start + many + WINDOW - 1).tolist(), strict=True)), np.int64, len(start))
            order = np.argsort(number, kind="stable")
            start, doc = start[order].astype(np.uint32), doc[order]
            first = np.searchsorted(number[order], np.arange(len(place) + 1))
            lengths = np.fromiter(map(len, place), np.uint32, len(place))
            text, ends = np.frombuffer(b"".join(place), np.uint8), np.append(0, np.cumsum(lengths, dtype=np.int64))
            low, high, copies = np.minimum.reduceat(doc, first[:-1]), np.maximum.reduceat(doc, first[:-1]), np.diff(first).astype(np.uint32)
            of = bucket[order][first[:-1]]
            heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(of)], strict=True):
                rows.append((int(of[i]), pack(low[i:j], high[i:j], lengths[i:j], copies[i:j], start[first[i] : first[j]], text[ends[i] : ends[j]])))
        chunk = docs.column("chunk")[0].as_py() if rows else 0
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return sent


def interleave(buf: np.ndarray, start: np.ndarray, many: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of the strings at ``start`` (with ``many`` windows each, one string behind the other): the least ``doc`` of a string with an equal window.

    The suffixes begin in the order of their strings. A step goes back four bytes: these are a window's symbol, and after it
    the windows are in the order of all bytes from there to their ends. Their numbers stand below the symbols that are sorted,
    which makes a step stable.
    """
    total = int(many.sum())
    base = np.cumsum(many) - many
    place = (np.arange(total) + np.repeat(start - base, many)).astype(np.int32 if len(buf) < 2**31 else np.int64)
    least = np.repeat(doc, many)
    symbols = np.ascontiguousarray(np.ndarray(max(0, len(buf) - 3), "<u4", np.ascontiguousarray(buf), strides=(1,)))
    number, group = np.arange(total, dtype=np.uint32), np.zeros(total, np.uint32)
    left = window
    while left and len(number):
        width = min(4, left)
        left -= width
        at = np.take(place, number, mode="clip")
        at += left
        symbol = np.take(symbols, at, mode="clip").astype(U)
        symbol &= U((1 << 8 * width) - 1)
        symbol <<= U(32)
        symbol |= np.arange(len(number), dtype=U)
        symbol.sort()
        order = symbol.astype(np.uint32)
        symbol >>= U(32)
        number, group = np.take(number, order, mode="clip"), np.take(group, order, mode="clip")
        new = np.ones(len(number) + 1, bool)
        np.not_equal(symbol[1:], symbol[:-1], out=new[1:-1])
        new[1:-1] |= group[1:] != group[:-1]
        group = np.cumsum(new[:-1], dtype=np.uint32)
        keep = ~(new[:-1] & new[1:])  # alone in its group: no other window ends in the same bytes
        if np.count_nonzero(keep) < 0.9 * len(keep):
            number, group = number[keep], group[keep]
    if len(number):
        opens = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        smallest = np.minimum.reduceat(least[number], opens)
        least[number] = np.repeat(smallest, np.diff(np.append(opens, len(number))))
    return least


def _merged(t: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, the runs of windows (begin, windows, smallest document) that some document in it may have to lose."""
    place: dict[bytes, int] = {}
    own, parts = [], []
    for blob in t.column("blob").to_pylist():
        *part, raw = unpack(blob, np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8)
        raw, ends = raw.tobytes(), np.cumsum(part[2], dtype=np.int64)
        own.append(np.fromiter((place.setdefault(raw[a:b], len(place)) for a, b in zip((ends - part[2]).tolist(), ends.tolist(), strict=True)), np.int64, len(ends)))
        parts.append(part)
    texts = np.append(0, np.cumsum([len(x) for x in own]))
    own = np.concatenate(own)
    low, high, _, copies, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
    least = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(least, own, low)
    size = np.fromiter(map(len, place), np.int64, len(place))
    buf = np.frombuffer(b"".join(place), np.uint8)
    del place, parts, low
    many = size - WINDOW + 1
    smallest = interleave(buf, np.cumsum(size) - size, many, least)
    base = np.cumsum(many) - many
    new = np.append(True, smallest[1:] != smallest[:-1])
    new[base] = True
    run = np.flatnonzero(new)
    run_many = np.diff(np.append(run, len(smallest)))
    of = np.searchsorted(run, base)
    run_first, run_doc = run - np.repeat(base, np.diff(np.append(of, len(run)))), smallest[run]
    count = np.diff(np.append(of, len(run)))[own]
    text = np.repeat(np.arange(len(own)), count)
    at = _within(count) + np.repeat(of[own], count)
    lose = run_doc[at] < high[text]
    text, at = text[lose], at[lose]
    copies = copies.astype(np.int64)
    count = copies[text]  # each place of the text loses the run
    where = _within(count) + np.repeat((np.cumsum(copies) - copies)[text], count)
    at, cut = np.repeat(at, count), np.append(0, np.cumsum(count))[np.searchsorted(text, texts)]
    begin, lost, doc = begin[where] + run_first[at].astype(np.uint32), run_many[at].astype(np.uint32), run_doc[at]
    some = np.flatnonzero(np.diff(cut))
    out = [pack(begin[i:j], lost[i:j], doc[i:j]) for i, j in zip(cut[some].tolist(), cut[some + 1].tolist(), strict=True)]
    return pa.table({"chunk": t.column("chunk").take(pa.array(some)), "bucket": t.column("bucket").take(pa.array(some)), "blob": pa.array(out, pa.binary())})


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _whole_characters(buf: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without characters that they cover in part only; they may become empty."""
    inner = np.append((buf & 0xC0) == 0x80, False)
    while (late := inner[opens] & (opens < closes)).any():
        opens = opens + late
    while (early := inner[closes] & (opens < closes)).any():
        closes = closes - early
    return opens, closes


def _cut(characters: bool, carry: list[str]):
    def cut(docs: pa.Table, replies: pa.Table) -> pa.Table:
        buf, off, ids, _ = _docs(docs.column("text").combine_chunks(), docs.column("id").combine_chunks())
        found = [unpack(x, np.uint32, np.uint32, np.int64) for x in replies.column("blob").to_pylist()]
        begin, many, doc = (np.concatenate(x) for x in zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
        begin = begin.astype(np.int64)
        row = np.searchsorted(off, begin, side="right") - 1
        lose = np.flatnonzero(ids[row] > doc)
        lose = lose[np.argsort(begin[lose])]
        begin, row = begin[lose], row[lose]
        far = np.maximum.accumulate(begin + many[lose] + WINDOW - 1)
        head = np.flatnonzero((begin > np.append(-1, far[:-1])[: len(far)]) | (row != np.append(-1, row[:-1])[: len(row)]))
        opens, closes = begin[head], far[np.append(head[1:], len(far))[: len(head)] - 1]
        if characters:
            opens, closes = _whole_characters(buf, opens, closes)
            some = opens < closes
            opens, closes = opens[some], closes[some]
        row = np.searchsorted(off, opens, side="right") - 1
        per_row = np.searchsorted(row, np.arange(len(off)))
        left = off - np.append(0, np.cumsum(closes - opens))[per_row]
        raw = memoryview(buf)
        kept = b"".join([raw[a:b] for a, b in zip([int(off[0]), *closes.tolist()], [*opens.tolist(), int(off[-1])], strict=True)])
        big = lambda offsets, values: pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, pa.int64())).cast(pa.list_(pa.int64()))
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(kept)]).cast(pa.binary())
        return pa.table({"id": docs.column("id"), "n_bytes": np.diff(off), "starts": big(per_row, opens - off[row]), "ends": big(per_row, closes - off[row]), "kept": texts} | {x: docs.column(x) for x in carry})

    return cut


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, starts, ends, kept, ...) for every row of ``docs``: the removed runs of bytes and what remains, as binary.

    With ``characters`` a character that loses some of its bytes only stays whole, so that what remains is UTF-8. The columns
    in ``carry`` come behind.
    """
    spark = docs.sparkSession
    ship(spark)
    carried = {f"carried_{i}": c for i, c in enumerate(carry)}
    docs = need(docs, id=id_col, text=text_col, **carried).withColumn("id", F.expr("try_cast(id AS bigint)"))
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    chunks = docs.mapInArrow(_chunked(chunk_bytes), f"id long, text string{kinds}, chunk long")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(shuffle_width(spark), -(-total // BUCKET))
    name = scratch_table(spark)
    chunks.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    chunks = spark.table(name)
    plain = chunks.select("id", "text", "chunk")
    found = plain.mapInArrow(_minimizers(buckets), "chunk long, bucket long, several binary, single binary")
    cell = "chunk long, bucket long, blob binary"
    often = stored(found.groupBy("bucket").applyInArrow(_repeated, cell), "often")
    sent = plain.groupBy("chunk").cogroup(often.groupBy("chunk")).applyInArrow(_segments(buckets), cell)
    replies = stored(sent.groupBy("bucket").applyInArrow(_merged, cell), "replies")
    result = "id long, n_bytes long, starts array<long>, ends array<long>, kept binary" + kinds
    cut = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_cut(characters, list(carried)), result)
    return cut.toDF(id_col, "n_bytes", "starts", "ends", "kept", *carry)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, CAST(length(h) AS BIGINT) // 2 - {WINDOW - 1})) AS p, h FROM raw),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * WINDOW})) AS s FROM starts),
least AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s HAVING count(*) > 1),
lost AS (SELECT DISTINCT doc_id, p FROM strings JOIN least USING (s) WHERE doc_id > m),
heads AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= {WINDOW} THEN 0 ELSE 1 END AS head FROM lost WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + {WINDOW} AS b FROM (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM heads) GROUP BY doc_id, k),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS k FROM spans GROUP BY doc_id)
SELECT r.doc_id, CAST(length(h) AS BIGINT) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(k, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(0, k + 1),
    lambda i: substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * b[i] + 1 END, 2 * (CASE WHEN i = k THEN CAST(length(h) AS BIGINT) // 2 ELSE a[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE b[i] END))), '') END)) AS kept_sha256
FROM raw r LEFT JOIN cuts c ON r.doc_id = c.doc_id
"""
