"""Near-duplicate documents by HyperMinHash.

A register keeps the minimum of one hash function over a document's shingles in
16 bits: the minimum's count of leading zeros (6 bits) and the 10 bits after its
first one.  Every register has a hash function of its own, so short texts fill
all of them.  Bands of ``ROWS`` compressed registers propose candidates; equal
registers are corrected for accidental collisions to estimate the Jaccard
similarity, and pairs whose estimate is not clearly too low are confirmed
on the full shingle sets.  A pair at similarity 0.75 shares no band with
probability (1 - 0.75^5)^48, about 2 in a million.

Documents with equal shingle sets form one node first.  Members of a band bucket
are never paired with each other wholesale:

1. Every bucket is a star.  Its hub is the member that meets most others over all
   buckets (a text and its near copies share the text's bands), so the hubs are few
   and each node has one or two.  Hub and member are estimated, then confirmed.
2. The links found so far make components.  What remains are nodes of one hub that
   lie in different components, mostly near copies just below the threshold.  A
   hub's nodes outside its largest component are compared with all its nodes, block by
   block: a task sees two blocks of registers and shingle sets, estimates their pairs
   and confirms on the sets those that are not clearly too low, and sends the links only.

Any two members of a bucket have a hub in common, so both steps together judge every
pair of a bucket or know that links connect it already: the components are the same
as from all pairs.  An end of many pairs is dealt over several tasks.

Defined results: null or empty texts and texts without words have an empty set and
link with nothing; texts of one to four words have one shingle; rows that share
a doc_id but not a text are separate documents; a null doc_id takes part and
never names a component unless all in it are null; empty tables give empty
results; other columns are ignored (``keep_one`` passes them through).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import (discard, documents, lower_ascii, store, text_or_empty, with_windows,
                                 words)
from tidewell.llm.components import components

SHINGLE = 5
LINK_PERCENT = 75
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Estimates below this are not confirmed: 4.6 standard errors of 240 registers below
#: similarity 0.75, missed with the same probability as a shared band.
MIN_ESTIMATE = 0.62
BLOCK = 512                  # nodes of a hub compared at a time with as many others,
BLOCK_SHINGLES = 1 << 18     # fewer if they are long
PAIRS_A_TASK = 4096          # pairs of one end before they are dealt over more tasks
SLICE = 1 << 21              # shingles sketched at a time in a task

_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def row_key(df: DataFrame, name: str = "k") -> DataFrame:
    """128 bits of (doc_id, text) as a string, the same for any integer type of doc_id."""
    doc = F.col("doc_id").cast("bigint")
    return df.withColumn(name, F.concat(F.hex(F.xxhash64(doc, "text")), F.lit("-"),
                                        F.hex(F.xxhash64(F.lit(7), "text", doc))))


def shingled(df: DataFrame) -> DataFrame:
    """Adds ``s``: the distinct 64-bit shingle hashes of ``text``."""
    d = df.withColumn("h", F.transform(words(lower_ascii(text_or_empty("text"))),
                                       lambda w: F.xxhash64(w)))
    d = with_windows(d.withColumn("s", F.col("h")), "s", SHINGLE)
    none = F.array().cast("array<bigint>")
    return d.withColumn("s", F.when(F.size("h") >= SHINGLE, F.array_distinct("s"))
                        .when(F.size("h") > 0, F.array(F.xxhash64("h"))).otherwise(none)).drop("h")


# ------------------------------------------------------------------ sketches

def registers(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Compressed registers, one row per run of ``x`` (none of them empty)."""
    out = np.empty((len(starts), REGISTERS), np.uint16)
    buf = np.empty_like(x)
    one = np.uint64(1)
    for r in range(REGISTERS):
        np.bitwise_xor(x, _XOR[r], out=buf)
        np.multiply(buf, _MUL[r], out=buf)
        low = np.minimum.reduceat(buf, starts)
        low |= one
        zeros = np.uint64(63) - np.floor(np.log2(low.astype(np.float64))).clip(0, 63).astype(np.uint64)
        rest = (low << zeros) << one               # without its first one
        out[:, r] = (zeros << np.uint64(MANTISSA_BITS)) | (rest >> np.uint64(64 - MANTISSA_BITS))
    return out


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band, the band's number mixed in."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(regs), 0)
    for m in range(ROWS):
        h = (h ^ regs[:, m::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _sketch(batches):
    for b in batches:
        col = b.column(b.num_columns - 1)
        ends = col.offsets.to_numpy().astype(np.int64)
        flat = col.values.to_numpy().view(np.uint64)
        size = np.diff(ends)
        cut = [0, *(np.flatnonzero(np.diff(ends[1:] // SLICE)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            if hi == lo:
                continue
            x = flat[ends[lo]:ends[hi]]
            n, full = size[lo:hi], size[lo:hi] > 0
            starts = (ends[lo:hi] - ends[lo])[full]
            keys = np.zeros((hi - lo, 2), np.uint64)
            regs = [None] * (hi - lo)
            if len(starts):
                for j in range(2):   # sums of remixed shingles do not depend on their order
                    y = (x ^ _XOR[j]) * _MUL[j + 2]
                    y = (y ^ (y >> np.uint64(31))) * _MUL[j + 4]
                    keys[full, j] = np.add.reduceat(y ^ (y >> np.uint64(29)), starts)
                for i, g in zip(np.flatnonzero(full).tolist(), registers(x, starts)):
                    regs[i] = g.tobytes()
            yield pa.RecordBatch.from_arrays([
                *(b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)),
                pa.array(n.astype(np.int64)),
                pa.array([f"{p:016x}{q:016x}" for p, q in keys.tolist()]),
                pa.array(regs, pa.binary())], names=["k", "doc_id", "n", "node", "regs"])


def sketches(docs: DataFrame) -> DataFrame:
    """k, doc_id, n (set size), node (128 bits of the set) and regs."""
    d = shingled(row_key(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")))
    return d.select("k", "doc_id", "s").mapInArrow(
        _sketch, "k string, doc_id long, n long, node string, regs binary")


def _banded(batches):
    """A row per node and band: (bucket, id)."""
    for b in batches:
        if b.num_rows:
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(band_hashes(regs).view(np.int64).ravel()),
                 pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bucket", "id"])


def estimate(ra, rb, na, nb) -> np.ndarray:
    """Jaccard estimates from registers, corrected for chance agreement.

    Two unequal minima still agree when they fall into the same octave and the
    same of its 2^10 cells; sets of n shingles have their minimum in octave k
    with probability (1 - 2^-(k+1))^n - (1 - 2^-k)^n.
    """
    edge = 0.5 ** np.arange(0, 61)

    def in_octave(n):
        with np.errstate(divide="ignore"):
            above = np.exp(n[:, None].astype(float) * np.log1p(-edge)[None, :])
        return np.diff(above, axis=1)
    chance = (in_octave(na) * in_octave(nb)).sum(1) / (1 << MANTISSA_BITS)
    return ((ra == rb).mean(1) - chance) / (1 - chance)


def _registers_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(batches):
    """Keep pairs (u, v, nu, ru, nv, rv) whose estimate is high enough."""
    for t in batches:
        j = estimate(_registers_of(t.column("ru")), _registers_of(t.column("rv")),
                     t.column("nu").to_numpy(), t.column("nv").to_numpy())
        yield t.select(["u", "v"]).filter(pa.array(j >= MIN_ESTIMATE))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a).clip(max=len(b) - 1)
    return int((b[at] == a).sum())


def _across(batches):
    """Links between nodes of different components in two blocks ``f`` and ``x``."""
    for t in batches:
        for one, other in zip(t.column("f"), t.column("x")):
            names, comps, sizes, regs, sets = [], [], [], [], []
            for y in (one.values, other.values):
                names.append(y.field("node"))
                comps.append(np.array(y.field("comp").to_pylist()))
                sizes.append(y.field("n").to_numpy())
                regs.append(_registers_of(y.field("regs")))
                ends, flat = y.field("s").offsets.to_numpy(), y.field("s").values.to_numpy()
                sets.append([flat[i:j] for i, j in zip(ends, ends[1:])])
            (fc, xc), (fs, xs), (fr, xr) = comps, sizes, regs
            at, to = [], []
            for i in range(len(fs)):
                # an estimate is never above the share of equal registers
                near = (xc != fc[i]) & (np.minimum(xs, fs[i]) * 100 >= np.maximum(xs, fs[i]) * LINK_PERCENT)
                k = np.flatnonzero(near)
                k = k[(xr[k] == fr[i]).mean(axis=1) >= MIN_ESTIMATE]
                if len(k):
                    k = k[estimate(fr[[i] * len(k)], xr[k], fs[[i] * len(k)], xs[k]) >= MIN_ESTIMATE]
                for j in k.tolist():
                    both = _common(sets[0][i], sets[1][j])
                    if both * 100 >= (fs[i] + xs[j] - both) * LINK_PERCENT:
                        at.append(i)
                        to.append(j)
            if at:
                yield pa.RecordBatch.from_arrays([names[0].take(pa.array(at)), names[1].take(pa.array(to))],
                                                 names=["u", "v"])


# ----------------------------------------------------------------- candidates

def _both(pairs: DataFrame, of: DataFrame, *values: str) -> DataFrame:
    """Pairs (u, v) with ``values`` of both ends (named value + u, v).  The pairs of an
    end v that has very many are dealt over several tasks, each with its values."""
    parts = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).alias("parts"))
    dealt = pairs.join(parts, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"))
    one = of.select(F.col("node").alias("u"), *[F.col(c).alias(f"{c}u") for c in values])
    other = of.join(parts, F.col("node") == F.col("v")).select(
        "v", *[F.col(c).alias(f"{c}v") for c in values],
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return dealt.join(one, "u").join(other, ["v", "part"]).drop("part")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v) that are linked, from the full shingle sets."""
    t = shingled(_both(pairs, texts, "text").withColumnRenamed("textu", "text")) \
        .withColumnRenamed("s", "su").drop("text").withColumnRenamed("textv", "text")
    t = shingled(t)
    # the test sits in a generator: as a filter it would move below the shingles and make
    # them again for each mention
    pair = F.array(F.struct(F.size(F.array_intersect("su", "s")).alias("both"),
                            (F.size("su") + F.size("s")).alias("sum")))
    linked = F.filter(pair, lambda x: x["both"] * 100 >= (x["sum"] - x["both"]) * LINK_PERCENT)
    return t.select("u", "v", F.explode(linked)).select("u", "v")


def _hubs(nodes: DataFrame) -> DataFrame:
    """(node, hub) of every member of a bucket, the hub itself left out."""
    # the short id only spares bytes: two nodes that shared one would meet in more buckets
    each = nodes.select("id", "regs").mapInArrow(_banded, "bucket long, id long")
    # buckets with the same members propose the same pairs: one of them is enough
    buckets = store(each.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.bit_xor("id").alias("mix"))
        .where("size > 1").groupBy("size", "low", "mix").agg(F.min("bucket").alias("bucket")), "buckets")
    members = store(each.join(buckets.select("bucket", "size"), "bucket")
                    .join(nodes.select("id", "node"), "id").select("bucket", "size", "node"), "members")
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    heads = members.join(weights, "node").groupBy("bucket").agg(
        F.max(F.struct("weight", "node")).alias("head")).select("bucket", F.col("head.node").alias("hub"))
    out = store(members.join(heads, "bucket").where("node <> hub").select("node", "hub").distinct(), "hubs")
    discard(buckets)
    discard(members)
    return out


def _left_over(star: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between one hub's nodes that lie in different components."""
    placed = star.join(roots, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("comp")) \
        .join(nodes.select("node", "n", "regs"), "node")
    sizes = placed.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))

    def blocks_of(nodes, shingles):
        return F.ceil(nodes / BLOCK + shingles / BLOCK_SHINGLES)
    hubs = sizes.groupBy("hub").agg(
        F.count(F.lit(1)).alias("comps"), F.sum("nodes").alias("nodes"), F.sum("shingles").alias("shingles"),
        F.max(F.struct("nodes", "comp", "shingles")).alias("main")).where("comps > 1").select(
        "hub", F.col("main.comp").alias("main"), blocks_of(F.col("nodes"), F.col("shingles")).alias("xs"),
        blocks_of(F.col("nodes") - F.col("main.nodes"), F.col("shingles") - F.col("main.shingles")).alias("fs"))
    some = store(placed.join(hubs, "hub"), "left_over")
    sets = shingled(texts.join(some.select("node").distinct(), "node")).select("node", F.array_sort("s").alias("s"))
    rows = store(some.join(sets, "node"), "left_over_sets")

    def blocks(part, name, number):
        return part.groupBy("hub", "xs", F.pmod(F.xxhash64("node"), F.col(number)).alias("at")) \
            .agg(F.collect_list(F.struct("node", "comp", "n", "regs", "s")).alias(name))
    x = blocks(rows, "x", "xs").select("hub", F.col("at").alias("j"), "x")
    f = blocks(rows.where("comp <> main"), "f", "fs").select(
        "hub", "f", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("xs") - 1)).alias("j"))
    found = store(f.join(x, ["hub", "j"]).select("f", "x").mapInArrow(_across, "u string, v string")
                  .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "across")
    discard(some)
    discard(rows)
    return found


def groups(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of every node that is linked with another; root names its group."""
    star = _hubs(nodes)
    pairs = star.select(F.col("node").alias("u"), F.col("hub").alias("v"))
    keys = star.select("node").union(star.select(F.col("hub").alias("node"))).distinct() \
        .join(nodes.select("node", "k"), "node")
    texts = store(row_key(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
                  .join(keys, "k").dropDuplicates(["k"]).select("node", "text"), "texts")
    likely = store(_both(pairs, nodes, "n", "regs").withColumnsRenamed(
        {"nu": "nu", "regsu": "ru", "nv": "nv", "regsv": "rv"}).select("u", "v", "nu", "ru", "nv", "rv")
        .mapInArrow(_likely, "u string, v string"), "likely")
    first = store(_confirm(likely, texts), "links")
    roots = components(first)
    second = _left_over(star, nodes, roots, texts)
    discard(texts)
    return roots if second.isEmpty() else components(first.unionByName(second))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: k, doc_id, n, node, component_id and keeper
    (the one key of the component that stays)."""
    fat = store(sketches(docs), "sketches")
    nodes = store(fat.where("n > 0").groupBy("node").agg(
        F.min("k").alias("k"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        .withColumn("id", F.xxhash64("node")), "nodes")
    sk = store(fat.select("k", "doc_id", "n", "node"), "rows")
    discard(fat)
    roots = store(groups(nodes, docs), "groups")
    discard(nodes)
    own = sk.where("n > 0").select("node", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k")
                                   .alias("who")).groupBy("node").agg(F.min("who").alias("who"))
    named = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("who").alias("first"))
    named = named.join(first, "root").select("node", F.col("first.doc_id").alias("named"),
                                             F.col("first.k").alias("keeper"))
    return sk.select("k", "doc_id", "n", "node").join(named, "node", "left").select(
        "k", "doc_id", "n", "node",
        F.when(F.col("n") > 0, F.col("named")).otherwise(F.col("doc_id")).alias("component_id"),
        "keeper")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group (the smallest doc_id) and every document
    without words; columns unchanged."""
    d = near_duplicates(docs)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    stay = d.where("n = 0 or k = keeper").select(F.col("k").alias("_tw_k"), F.col("n").alias("_tw_n")) \
        .distinct()
    keyed = row_key(docs, "_tw_k").join(stay, "_tw_k")
    words_in = keyed.where("_tw_n > 0").dropDuplicates(["_tw_k"])
    return words_in.select(*cols).unionByName(keyed.where("_tw_n = 0").select(*cols))


def op9_minhash_dedup(spark, sf_dir) -> DataFrame:
    """Near-duplicate component of every whole text of ``documents``."""
    d = near_duplicates(documents(spark, sf_dir))
    return d.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
