"""Removal of byte strings that repeat across documents, by blockwise sorting.

A byte goes when a 50-byte string that covers it also starts in a document with
a smaller doc_id.  Comparing all suffixes of a corpus needs many times its size;
a difference cover bounds that.  Positions whose remainder modulo 21 is in
{0, 1, 4, 14, 16} form the cover sample: any two positions have a common
distance below 21 at which both are sampled.  So two equal 50-byte strings hold
two sampled positions with equal 30-byte strings.

1. Equal texts become one; the texts, by ascending doc_id, form chunks (rows of
   about ``CHUNK_BYTES`` that are the unit of work).
2. Every chunk sends its sorted sample keys to hash buckets; a bucket, sorted in
   one task at a time, answers which of them occur in more than one document.
3. Only suffixes within 20 bytes before such a sample can be repeated.  They are
   cut out; their 50-byte strings are sorted bucket by bucket the same way,
   and each bucket answers which of them start in a smaller document.
4. Marked strings are united to removed runs per document.

Buckets get sorted blobs of keys, one row per (bucket, chunk), and answer with a
bit per key; their number grows with the corpus, so a task's memory does not.  A
passage in very many documents is one key per chunk.  Order within a bucket is
that of 64-bit hashes, as only equality and the documents' order count, not the
order of suffixes; two different strings agree with probability 2^-64 per pair.

Defined results: a null text is empty; texts under 50 bytes lose nothing; a null
doc_id comes after all others and null ones are equal; rows with the same doc_id
are not smaller than one another; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import documents, release, store, text_or_empty
from tidewell.llm.token_records import text_slices

MATCH = 50
PERIOD, COVER = 21, (0, 1, 4, 14, 16)   # a fixed perfect difference set
SAMPLE = MATCH - PERIOD + 1
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20       # text behind one bucket, so its keys fit a task easily
SAMPLE_BITS = 32             # of a sample key within its bucket; a clash only adds work
LAST = (1 << 63) - 1         # the rank of a null doc_id

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x632BE59BD9B4E019)


def string_hashes(body: np.ndarray, length: int, piece: int = 1 << 17) -> np.ndarray:
    """64-bit hash of the ``length`` bytes from every position that has them,
    by doubling, in pieces that stay in the processor's cache."""
    n = len(body) - length + 1
    out = np.empty(max(n, 0), np.uint64)
    for lo in range(0, max(n, 0), piece):
        part = body[lo:min(lo + piece, n) + length - 1].astype(np.uint64)
        one, h, width = part, part, 1
        for bit in bin(length)[3:]:
            for other, step in [(h, width)] + ([(one, 1)] if bit == "1" else []):
                m = len(h) - step if other is h else len(part) - width
                z = (h[:m] * _M) ^ (other[width:width + m] + _C)
                z ^= z >> np.uint64(29)
                z *= _N
                h, width = z, width + step
        h = h ^ (h >> np.uint64(32))
        out[lo:lo + len(h)] = h[:n - lo]
    return out


def _starts(ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions with ``length`` bytes left in their text, number of the text)."""
    size = np.diff(ends)
    room = (size - length + 1).clip(0)
    doc = np.repeat(np.arange(len(size)), room)
    pos = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    return pos + ends[:-1][doc], doc


def _keys(values: np.ndarray, doc: np.ndarray):
    """Sorted distinct values, each position's place among them, and the first
    and last text (by order) that has each."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.empty(0, bool)
    place = np.empty(len(v), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    d = doc[order]
    last = d[np.concatenate([at[1:], [len(v)]]) - 1] if len(v) else d
    return v[new], place, d[at], last


def _bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _by_bucket(keys: np.ndarray, key_bits: int, bits: int):
    """(bucket, from, to) of the runs of sorted keys by their top bits."""
    top = keys >> np.uint64(key_bits - bits) if bits else np.zeros(len(keys), np.uint64)
    at = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else []
    return [(int(top[a]), a, b) for a, b in zip(at, [*at[1:], len(top)])]


def _table(rows, schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


# --------------------------------------------------------------------- chunks

CHUNK = "chunk long, ranks array<long>, keys array<string>, ends array<long>, body binary"
_CHUNK = pa.schema([("chunk", pa.int64()), ("ranks", pa.list_(pa.int64())),
                    ("keys", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())),
                    ("body", pa.binary())])


def _chunked(batches):
    part, seq = TaskContext.get().partitionId(), 0
    for whole in batches:
        for b in text_slices(whole, 2, CHUNK_BYTES):
            data = [t.encode() for t in b.column(2).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
            yield _table([((part << 32) + seq, b.column(0).to_pylist(), b.column(1).to_pylist(), ends,
                           b"".join(data))], _CHUNK).to_batches()[0]
            seq += 1


def _row(table: pa.Table) -> dict:
    return {n: table.column(n)[0].as_py() for n in table.column_names if n != "body"} | {
        "body": np.frombuffer(table.column("body")[0].as_buffer(), np.uint8)}


def text_key():
    t = text_or_empty("text")
    return F.concat(F.hex(F.xxhash64(t)), F.lit("-"), F.hex(F.xxhash64(F.lit(9), t, F.length(t))))


def chunks(docs: DataFrame) -> DataFrame:
    """The distinct texts, by ascending smallest doc_id, as stored chunks."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("rank"),
                    text_key().alias("key"), text_or_empty("text").alias("text"))
    one = d.groupBy("key").agg(F.min("rank").alias("rank"), F.first("text").alias("text"))
    spread = one.select("rank", "key", "text").repartitionByRange("rank", "key") \
        .sortWithinPartitions("rank", "key")
    return store(spread.mapInArrow(_chunked, CHUNK), "chunks")


# -------------------------------------------------------------- step 2: sample

def _sampled(row: dict, bits: int):
    """(positions, distinct keys, place of each, key occurs in several texts)."""
    pos, doc = _starts(np.array(row["ends"]), SAMPLE)
    offset = pos - np.array(row["ends"])[:-1][doc] if len(pos) else pos
    pick = np.isin(offset % PERIOD, COVER)
    pos, doc = pos[pick], doc[pick]
    t = string_hashes(row["body"], SAMPLE)[pos] >> np.uint64(64 - bits - SAMPLE_BITS)
    keys, place, first, last = _keys(t, doc)
    return pos, keys, place, first != last


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()),
                   ("flags", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])
SENT = "bucket int, chunk long, keys binary, flags binary, low long, high long"
_BITS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])
BITS = "chunk long, bucket int, bits binary"


def _send_samples(bits: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = _row(pa.Table.from_batches([b.slice(i, 1)]))
                _, keys, _, several = _sampled(row, bits)
                rest = keys & np.uint64((1 << SAMPLE_BITS) - 1)
                rows = [(k, row["chunk"], _bytes(rest[lo:hi], SAMPLE_BITS // 8), np.packbits(several[lo:hi]).tobytes(), 0, 0)
                        for k, lo, hi in _by_bucket(keys, SAMPLE_BITS + bits, bits)]
                yield from _table(rows, _SENT).to_batches()
    return run


def _answer_samples(table: pa.Table) -> pa.Table:
    """Bits of the keys that occur in more than one text."""
    parts = [_values(x, SAMPLE_BITS // 8) for x in table.column("keys").to_pylist()]
    _, inv, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    again, at, rows = count[inv] > 1, 0, []
    for chunk, bucket, flags, p in zip(*(table.column(c).to_pylist() for c in ("chunk", "bucket", "flags")), parts):
        several = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(p)).astype(bool)
        rows.append((chunk, bucket, np.packbits(again[at:at + len(p)] | several).tobytes()))
        at += len(p)
    return _table(rows, _BITS)


def _flags(answers: pa.Table, keys: np.ndarray, key_bits: int, bits: int) -> np.ndarray:
    by = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
    parts = [np.unpackbits(np.frombuffer(by[k], np.uint8), count=hi - lo)
             for k, lo, hi in _by_bucket(keys, key_bits, bits)]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


# ------------------------------------------------------------ step 3: suffixes

SEGMENT = "chunk long, ranks array<long>, doc array<int>, start array<long>, ends array<long>, body binary"
_SEGMENT = pa.schema([("chunk", pa.int64()), ("ranks", pa.list_(pa.int64())),
                      ("doc", pa.list_(pa.int32())), ("start", pa.list_(pa.int64())),
                      ("ends", pa.list_(pa.int64())), ("body", pa.binary())])


def _cut(bits: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """Runs of suffixes that may repeat, with the 49 bytes that follow."""
        if not chunk.num_rows or not answers.num_rows:
            return _table([], _SEGMENT)
        row = _row(chunk)
        pos, keys, place, _ = _sampled(row, bits)
        hit = np.zeros(len(row["body"]) + PERIOD + 1, np.int32)
        hit[pos[_flags(answers, keys, SAMPLE_BITS + bits, bits)[place]] + 1] = 1
        seen = np.cumsum(hit)
        at, doc = _starts(np.array(row["ends"]), MATCH)
        may = seen[at + PERIOD] - seen[at] > 0
        at, doc = at[may], doc[may]
        if not len(at):
            return _table([], _SEGMENT)
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])])
        lo = at[new]
        hi = at[np.concatenate([np.flatnonzero(new)[1:], [len(at)]]) - 1] + MATCH
        body = b"".join(row["body"][a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist()))
        ends = np.concatenate([[0], np.cumsum(hi - lo)])
        first = np.array(row["ends"])[:-1][doc[new]]
        return _table([(row["chunk"], row["ranks"], doc[new], lo - first, ends, body)], _SEGMENT)
    return run


def _suffixes(row: dict):
    """(segment position, text, distinct keys, place of each, first text of each)."""
    pos, seg = _starts(np.array(row["ends"]), MATCH)
    doc = np.array(row["doc"])[seg]
    keys, place, first, _ = _keys(string_hashes(row["body"], MATCH)[pos], doc)
    return pos, seg, doc, keys, place, first


def _send_suffixes(bits: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = _row(pa.Table.from_batches([b.slice(i, 1)]))
                *_, keys, _, first = _suffixes(row)
                ranks = np.array(row["ranks"])
                low, high = int(ranks[0]), int(ranks[-1])
                edge = np.stack([ranks[first] == low, ranks[first] == high], 1)
                rows = [(k, row["chunk"], _bytes(keys[lo:hi] & _below(bits), _width(bits)),
                         np.packbits(edge[lo:hi]).tobytes(), low, high)
                        for k, lo, hi in _by_bucket(keys, 64, bits)]
                yield from _table(rows, _SENT).to_batches()
    return run


def _below(bits: int) -> np.uint64:
    """The bits of a suffix key that its bucket does not tell."""
    return np.uint64((1 << (64 - bits)) - 1)


def _width(bits: int) -> int:
    return -(-(64 - bits) // 8)


def _answer_suffixes(table: pa.Table, bits: int) -> pa.Table:
    """Bits of the keys that start in a smaller text of another chunk.

    Chunks ascend by rank.  An earlier chunk's first text with the key is smaller
    unless it has that chunk's highest rank and this is also the own rank."""
    table = table.sort_by("chunk")
    parts = [_values(x, _width(bits)) for x in table.column("keys").to_pylist()]
    chunk, bucket, flags, low, high = (table.column(c).to_pylist()
                                       for c in ("chunk", "bucket", "flags", "low", "high"))
    every, inv = np.unique(np.concatenate(parts), return_inverse=True)
    best = np.full(len(every), -1, np.int64)     # smallest known rank bound, -1: none yet
    rows, at = [], 0
    for i, p in enumerate(parts):
        own = inv[at:at + len(p)]
        at += len(p)
        edge = np.unpackbits(np.frombuffer(flags[i], np.uint8), count=2 * len(p)).astype(bool).reshape(-1, 2)
        # least rank that the first text can have: exact at both edges
        rank = np.where(edge[:, 0], low[i], np.where(edge[:, 1], high[i], min(low[i] + 1, high[i])))
        before = best[own]
        rows.append((chunk[i], bucket[i], np.packbits((before >= 0) & (before < rank)).tobytes()))
        best[own] = np.where(before < 0, rank, before)
    return _table(rows, _BITS)


_RUN = pa.schema([("chunk", pa.int64()), ("doc", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _mark(bits: int):
    def run(segments: pa.Table, answers: pa.Table) -> pa.Table:
        """Maximal runs (document of the chunk, from, to) of removed bytes."""
        if not segments.num_rows:
            return _table([], _RUN)
        row = _row(segments)
        pos, seg, doc, keys, place, first = _suffixes(row)
        ranks = np.array(row["ranks"])
        gone = (_flags(answers, keys, 64, bits)[place]) | (ranks[first][place] < ranks[doc])
        pos, seg, doc = pos[gone], seg[gone], doc[gone]
        if not len(pos):
            return _table([], _RUN)
        at = pos - np.array(row["ends"])[:-1][seg] + np.array(row["start"])[seg]
        order = np.lexsort((at, doc))
        at, doc = at[order], doc[order]
        new = np.concatenate([[True], (at[1:] > at[:-1] + MATCH) | (doc[1:] != doc[:-1])])
        stop = at[np.concatenate([np.flatnonzero(new)[1:], [len(at)]]) - 1] + MATCH
        return pa.table([pa.array(np.full(new.sum(), row["chunk"])), pa.array(doc[new].astype(np.int32)),
                         pa.array(at[new]), pa.array(stop)], schema=_RUN)
    return run


_DONE = pa.schema([("key", pa.string()), ("rank", pa.int64()), ("n_bytes", pa.int64()),
                   ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _finish(chunk: pa.Table, runs: pa.Table) -> pa.Table:
    if not chunk.num_rows:
        return _table([], _DONE)
    row, cut = _row(chunk), {}
    for d, a, b in sorted(zip(*(runs.column(c).to_pylist() for c in ("doc", "start", "end")))):
        cut.setdefault(d, []).append((a, b))
    rows = []
    for i, (key, rank) in enumerate(zip(row["keys"], row["ranks"])):
        lo, hi = row["ends"][i], row["ends"][i + 1]
        gone, sha, at = cut.get(i, []), hashlib.sha256(), lo
        for a, b in gone:
            sha.update(row["body"][at:lo + a])
            at = lo + b
        sha.update(row["body"][at:hi])
        rows.append((key, rank, hi - lo, sum(b - a for a, b in gone), len(gone), sha.hexdigest()))
    return _table(rows, _DONE)


# --------------------------------------------------------------------- operator

def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    c = chunks(docs)
    total = c.select(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    bits = min(24, max(3, int(max(1, total // BUCKET_BYTES)).bit_length()))
    release(spark)
    answers = store(c.mapInArrow(_send_samples(bits), SENT).groupBy("bucket")
                    .applyInArrow(_answer_samples, BITS), "sample_answers")
    release(spark)
    segments = store(c.groupBy("chunk").cogroup(answers.groupBy("chunk"))
                     .applyInArrow(_cut(bits), SEGMENT), "segments")
    release(spark)
    answers = store(segments.mapInArrow(_send_suffixes(bits), SENT).groupBy("bucket")
                    .applyInArrow(lambda t: _answer_suffixes(t, bits), BITS), "suffix_answers")
    release(spark)
    runs = store(segments.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _mark(bits), "chunk long, doc int, start long, end long"), "runs")
    done = store(c.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(
        _finish, "key string, rank long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"),
        "repeats_removed")
    release(spark)
    # a copy of an earlier text goes as a whole when it is long enough
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("key"))
    copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("rank")) & (F.col("n_bytes") >= MATCH)
    nothing = hashlib.sha256(b"").hexdigest()
    return own.join(done, "key").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def op10_repeat_removal(spark, sf_dir) -> DataFrame:
    """Bytes that repeat from a smaller document, of every whole text of ``documents``."""
    return remove_repeats(documents(spark, sf_dir))
