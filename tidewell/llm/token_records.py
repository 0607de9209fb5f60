"""Token ids as length-delimited binary records with a separate offset index.

File format, all numbers little-endian:

    record  = u64 payload length, u32 masked CRC-32 of these 8 bytes,
              payload, u32 masked CRC-32 of the payload
    payload = u8 1 if the doc_id is not null, i64 doc_id, u8 bytes per id
              (2 or 4), u64 number of ids, the ids

A checksum c is stored masked, ``rotate right by 15, then add 0xa282ead8``, so
that checksums of data that itself holds checksums stay strong.  Ids take two
bytes where the vocabulary allows.  The index is a Parquet table with one row
per record (file, part, doc_id, offset, length, n_tokens, start in its part),
so records can be read in any order with one seek each.

Documents are range-partitioned by doc_id, so the record files, taken by part
number, hold ascending doc_ids and no task sees more than its range; copies of
one doc_id are dealt out by text and row.  A task writes under a name of its own and
only files named in the committed index exist for readers, so a lost or
repeated task leaves no half-written record behind.

Tokenizing: the pattern of the byte-level tokenizer never crosses a space
between two visible characters, so a text is cut there and every distinct piece
is encoded once.  Unknown pieces are cut further into the pattern's own tokens;
plain words among these go to the tokenizer many to a call.  Texts with other
white space around a cut are encoded whole.  Results equal encoding the whole
text.

Defined results: a null or empty text holds only the end id; null doc_ids come
first; rows that share a doc_id are ordered by text hash; an empty table writes no
records; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import BATCH_LIMIT, documents, setting, text_or_empty
from tidewell.session import shared_dir

END_ID = 2
BATCH_BYTES = 8 << 20        # text tokenized at a time in a task
ARROW_BYTES = 4 << 20        # text sent to a task's Python at a time
CACHE_PIECES = 700_000       # distinct pieces a worker remembers before it drops those not in use
INDEX = ("file string, part int, has_id boolean, doc_id long, offset long, length long, "
         "n_tokens long, start_in_part long")
MASK_DELTA = 0xA282EAD8

# The byte-level tokenizer's own pattern, applied to pieces of these characters only.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KNOWN = re.compile("[ \n!-~À-ÖØ-öø-ÿ]+")
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
# A word, marks that start neither a contraction nor a special token, and the same after a
# line feed: the pattern cuts between the groups.
SIMPLE = re.compile(f"( ?{LETTERS})([!-&(-/:;=-@[-`{{-~]*)(?:(\n)({LETTERS})([!-&(-/:;=-@[-`{{-~]*))?")
JOIN = 256                   # words to a call
RUN_PIECES = 1 << 16         # pieces whose ids are put in place at a time


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


# ---------------------------------------------------------------- tokenizing

def _is_word(names: list[str]) -> list[bool]:
    return pc.match_substring_regex(pa.array(names, pa.string()), f"^ ?{LETTERS}$").to_pylist()


def _cut(piece: str) -> list[str]:
    """A piece in the tokenizer's pattern tokens, or whole where these are not known."""
    m = SIMPLE.fullmatch(piece)
    if m:
        return [g for g in m.groups() if g]
    return CUT.findall(piece) if KNOWN.fullmatch(piece) and "<|" not in piece else [piece]


class PieceEncoder:
    """Encodes texts as flat id arrays, each distinct piece once."""

    _by_path: dict[str, "PieceEncoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark owns the cores
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        # ids that begin with a space, and that of a line feed, in the byte-level alphabet
        self.spaced = np.zeros(self.tok.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tok.get_vocab().items() if t[:1] == "Ġ"]] = True
        self.line_feed = self.tok.token_to_id("Ċ")
        self.clear()

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, self.dtype), np.zeros(1, np.int64)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _append(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put pieces at the end of the table: ``sizes`` ids of ``ids`` each, one after the other."""
        n = len(self.starts) - 1
        self.index.update(zip(names, range(n, n + len(sizes)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def _at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these places of the table one after the other, number of ids of each)."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        where = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        where += np.arange(len(where))
        return self.ids[where], sizes

    def _learn(self, tokens: list[str]) -> None:
        """Add unknown pattern tokens.  Words with a space in front can stand
        side by side, others are kept apart by line feeds: an id with a space or a
        line feed tells where a word ends."""
        spaced, plain, other = [], [], []
        for t, word in zip(tokens, _is_word(tokens)):
            (other if not word else spaced if t[0] == " " else plain).append(t)
        for group, sep in ((spaced, ""), (plain, "\n")):
            if not group:
                continue
            got = self.ids_of([sep.join(group[i:i + JOIN]) for i in range(0, len(group), JOIN)])
            runs = np.cumsum([0, *map(len, got)])
            ids = np.fromiter(itertools.chain.from_iterable(got), self.dtype, runs[-1])
            starts = self.spaced[ids]
            if sep:
                # a word starts a run or follows a line feed, which is no part of it
                feed = ids == self.line_feed
                starts[1:] = feed[:-1]
                starts[runs[:-1]] = True
                ids, starts = ids[~feed], starts[~feed]
            self._append(group, ids, np.diff(np.append(np.flatnonzero(starts), len(ids))))
        got = self.ids_of(other)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self._append(other, np.fromiter(itertools.chain.from_iterable(got), self.dtype, sizes.sum()), sizes)

    def _lookup(self, pieces: list[str]) -> np.ndarray:
        """Cache positions of pieces, encoding the unknown ones.  Pieces and their
        tokens share one table, as most pieces are a token.  A full table goes on
        with those of its pieces that are asked for now."""
        def places(names):
            return np.fromiter(map(self.index.get, names, itertools.repeat(-1)), np.int32, len(names))
        rows = places(pieces)
        unknown = np.flatnonzero(rows < 0)
        if len(self.index) + len(unknown) > CACHE_PIECES and self.index:
            held = np.flatnonzero(rows >= 0)
            ids, sizes = self._at(rows[held])
            self.clear()
            self._append([pieces[i] for i in held.tolist()], ids, sizes)
            rows[held] = np.arange(len(held))
        if len(unknown):
            new = [pieces[i] for i in unknown.tolist()]
            cut = [[p] if word else _cut(p) for p, word in zip(new, _is_word(new))]
            tokens = {t for c in cut for t in c}
            self._learn([t for t in tokens if t not in self.index])
            longer = [(p, c) for p, c in zip(new, cut) if len(c) > 1]
            if longer:
                count = np.fromiter((len(c) for _, c in longer), np.int64, len(longer))
                ids, sizes = self._at(places([t for _, c in longer for t in c]))
                self._append([p for p, _ in longer], ids, np.add.reduceat(sizes, np.cumsum(count) - count))
            rows[unknown] = places(new)
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, start of each text and the end)."""
        split = pc.split_pattern(texts, " ")
        flat = split.flatten().dictionary_encode()
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        del split
        uniq, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
        first = np.zeros(len(codes), bool)
        first[ends[:-1]] = True
        # a cut is safe where both neighbours are visible ASCII or Latin letters
        seen = "[!-~À-ÿ]"
        safe = pc.match_substring_regex(uniq, f"^{seen}$|^{seen}(?s:.*){seen}$").to_numpy(zero_copy_only=False)
        bad = np.logical_or.reduceat(~safe[codes], ends[:-1]) if len(texts) else np.zeros(0, bool)
        n = len(uniq)
        keys = codes + np.where(first, np.int32(0), np.int32(n))
        if bad.any():
            keys = keys[~np.repeat(bad, np.diff(ends))]
        pieces_of = np.where(bad, 0, np.diff(ends))
        present = np.zeros(2 * n, bool)
        present[keys] = True
        used, inverse = np.flatnonzero(present), (np.cumsum(present, dtype=np.int32) - 1)[keys]
        del flat, codes, first, keys
        names = uniq.to_numpy(zero_copy_only=False).tolist()
        mid = int(np.searchsorted(used, n))
        pieces = [names[k] for k in used[:mid].tolist()] + [" " + names[k] for k in (used[mid:] - n).tolist()]
        rows = self._lookup(pieces)[inverse] if len(used) else np.empty(0, np.int32)
        del names, pieces, inverse
        total = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(np.diff(self.starts).astype(np.int32)[rows], out=total[1:])
        out_sizes = np.diff(total[np.concatenate([[0], np.cumsum(pieces_of)])])
        good = np.empty(total[-1], self.dtype)
        # spread out a run of pieces at a time: the places of all ids take many times their room
        for lo in range(0, len(rows), RUN_PIECES):
            run = rows[lo:lo + RUN_PIECES]
            at, sizes = total[lo:lo + len(run)], np.diff(total[lo:lo + len(run) + 1])
            where = np.repeat(self.starts[run] - at, sizes)
            where += np.arange(at[0], at[0] + len(where))
            good[at[0]:at[0] + len(where)] = self.ids[where]
        if not bad.any():
            return good, np.concatenate([[0], np.cumsum(out_sizes)])
        whole = dict(zip(np.flatnonzero(bad).tolist(),
                         self.ids_of(texts.filter(pa.array(bad)).to_pylist())))
        parts, at = [], 0
        for i in range(len(texts)):
            if i in whole:
                parts.append(np.array(whole[i], self.dtype))
                out_sizes[i] = len(whole[i])
            else:
                parts.append(good[at:at + out_sizes[i]])
                at += out_sizes[i]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(out_sizes)])


def text_slices(batch: pa.RecordBatch, col: int, limit: int = BATCH_BYTES):
    """Cut a batch into runs of rows of about ``limit`` bytes of text."""
    size = np.cumsum(pc.binary_length(batch.column(col)).to_numpy(zero_copy_only=False))
    cut = np.flatnonzero(np.diff((size - 1) // limit)) + 1 if len(size) else np.empty(0, int)
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


# ------------------------------------------------------------------- writing

def _open(path: str, mode: str):
    """A file in the shared folder, by whatever store its address names."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    store, p = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    return store.open_output_stream(p) if mode == "w" else store.open_input_file(p)


def _record(has_id: bool, doc_id: int, ids: np.ndarray) -> bytes:
    payload = struct.pack("<BqBQ", has_id, doc_id, ids.dtype.itemsize, len(ids)) + ids.tobytes()
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload,
                     struct.pack("<I", masked(payload))))


def _writer(folder: str, path: str):
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("has_id", pa.bool_()),
                        ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
                        ("n_tokens", pa.int64()), ("start_in_part", pa.int64())])

    def write(batches):
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec"
        out, offset, start, enc = None, 0, 0, PieceEncoder.of(path)
        for whole in batches:
            for b in text_slices(whole, 1):
                out = out or _open(name, "w")
                ids, ends = enc.encode(b.column(1))
                rows = []
                for i, doc_id in enumerate(b.column(0).to_pylist()):
                    own = np.append(ids[ends[i]:ends[i + 1]], enc.dtype.type(END_ID))
                    rec = _record(doc_id is not None, doc_id or 0, own)
                    out.write(rec)
                    rows.append((name, part, doc_id is not None, doc_id, offset, len(rec), len(own), start))
                    offset, start = offset + len(rec), start + len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if out:
            out.close()
    return write


def write_records(docs: DataFrame, folder: str, path: str) -> DataFrame:
    """Write record files and the index under ``folder``; returns the index."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text")) \
        .withColumn("h", F.xxhash64("text")).withColumn("r", F.monotonically_increasing_id()) \
        .repartitionByRange("doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r")
    spark_dir = f"{folder}/records"
    _make(spark, spark_dir)
    with setting(spark, BATCH_LIMIT, str(ARROW_BYTES)):
        d.select("doc_id", "text").mapInArrow(_writer(spark_dir, path), INDEX) \
            .write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _make(spark, folder: str) -> None:
    """Create a folder through Spark's own file system layer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)


# ------------------------------------------------------------------- reading

def read_record(data: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one framed record; a damaged one raises."""
    size, check = struct.unpack_from("<QI", data)
    payload = data[12:12 + size]
    if masked(data[:8]) != check or len(payload) != size \
            or struct.unpack_from("<I", data, 12 + size)[0] != masked(payload):
        raise ValueError("damaged token record")
    has_id, doc_id, width, n = struct.unpack_from("<BqBQ", payload)
    ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", n, struct.calcsize("<BqBQ"))
    return (doc_id if has_id else None), ids


def read_rows(index: DataFrame) -> DataFrame:
    """Read every record that the index names, in any order, and check it:
    part, start_in_part, doc_id, n_tokens, ids_crc32."""
    schema = pa.schema([("part", pa.int32()), ("start_in_part", pa.int64()), ("doc_id", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        name, src = None, None
        for b in batches:
            rows = []
            for file, part, start, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    if src:
                        src.close()
                    name, src = file, _open(file, "r")
                src.seek(offset)
                doc_id, ids = read_record(src.read(length))
                rows.append((part, start, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if src:
            src.close()
    return index.select("file", "part", "start_in_part", "offset", "length").mapInArrow(
        read, "part int, start_in_part long, doc_id long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` as records and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_dir(docs.sparkSession, "llm", "tokens", fresh=True)
    index = write_records(docs, folder, path or tokenizer_path())
    # one row per record file; its window sums over files, not over documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return read_rows(index).join(parts, "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_records(spark, sf_dir) -> DataFrame:
    """Token records of every whole text of ``documents``, written and read back."""
    return token_records(documents(spark, sf_dir))
