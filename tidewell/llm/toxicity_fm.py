"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased letter runs and of their first 4 and 5
letters, hashed into ``BUCKETS``.
Its score is the logistic value of

    bias + sum w[t] + 1/2 * sum over factors f of ((sum v[t,f])^2 - sum v[t,f]^2)

so besides each term's weight every pair of terms has one, the product of their
factors: an insult next to a mention of a group can weigh more than both alone.

Learning uses at most about ``TRAIN_DOCS`` labelled documents (a fixed part of
them by a hash of doc_id; all when there are fewer) whose remainder is not held
out.  Terms are hashed, de-duplicated, counted and screened by Spark; only the
telling terms of this bounded sample reach the driver, where numpy fits the model
by Adam.  Terms in
fewer than ``MIN_DOCS`` of them, or whose share among toxic and other documents
differs by less than ``MIN_Z`` standard errors, stay at zero: else the many
chance terms of a long text outweigh the few that tell.  Scoring is one pass over the
documents without shuffle, with the model broadcast: it holds the telling terms
of the bounded sample only, far under a MB.

Defined results: null and empty texts are scored by the bias alone; a doc_id with
several labels counts as toxic if one says so; null labels, label rows without a
document and a null doc_id are not learned from (a null doc_id is not held out);
repeated rows are scored one by one; without labelled rows of both kinds every score is
the share of toxic rows (0 when there are none); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import documents, store, text_or_empty
from tidewell.sources.tables import load

BUCKETS = 1 << 28
BEGINNINGS = (4, 5)
FACTORS = 4
TRAIN_DOCS = 24_000
MIN_DOCS, MIN_Z = 4, 8.0
EPOCHS, BATCH, RATE = 40, 256, 0.03
L2_W, L2_V = 1e-6, 1e-5
DROP = 0.25                  # share of terms left out at each step, so that few are enough
THRESHOLD = 0.3
HELD_OUT_OF, HELD_OUT = 4, 2


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def with_terms(docs: DataFrame) -> DataFrame:
    """doc_id and the set of hashed terms of the whole text: words, and the
    beginnings of longer words, which inflected forms share."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(text_or_empty("text")), r"[^\p{L}]+"), ""))

    def number(c, kind):
        return F.pmod(F.xxhash64(c, F.lit(kind)), F.lit(BUCKETS)).cast("int")

    def beginnings(n):
        return F.array_distinct(F.transform("w", lambda w: number(F.substring(w, 1, n), n)))
    hashed = [F.transform("w", lambda w: number(w, 0)), *map(beginnings, BEGINNINGS)]
    return docs.select("doc_id", words.alias("w")).select(
        "doc_id", F.array_distinct(F.concat(*hashed)).alias("terms"))


class FactorizationMachine:
    """Binary factorization machine on runs of term numbers; ``known`` are the
    sorted numbers that have weights ``w`` and factors ``v``, others have none."""

    def __init__(self, bias=0.0, known=None, w=None, v=None):
        self.bias = bias
        self.known = np.empty(0, np.int64) if known is None else known
        self.w = np.zeros(len(self.known)) if w is None else w
        self.v = np.zeros((len(self.known), FACTORS)) if v is None else v

    def _own(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``known`` of the known terms, and how many each run has."""
        if not len(self.known):
            return np.empty(0, np.int64), np.zeros(len(starts) - 1, np.int64)
        at = np.searchsorted(self.known, terms).clip(0, len(self.known) - 1)
        hit = self.known[at] == terms
        return at[hit], np.diff(np.concatenate([[0], np.cumsum(hit)])[starts])

    def scores(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        own, size = self._own(terms, starts)
        doc = np.repeat(np.arange(len(size)), size)
        return 1 / (1 + np.exp(-np.clip(self._raw(own, doc, len(size))[0], -30, 30)))

    def _raw(self, idx, doc, n):
        """(scores before the logistic, factor sums, factors of each term)."""
        x = self.v[idx]
        s = np.stack([np.bincount(doc, x[:, f], n) for f in range(FACTORS)], 1)
        q = np.bincount(doc, (x * x).sum(1), n)
        return self.bias + np.bincount(doc, self.w[idx], n) + 0.5 * ((s * s).sum(1) - q), s, x

    def fit(self, terms: np.ndarray, starts: np.ndarray, y: np.ndarray) -> "FactorizationMachine":
        share = float(y.mean()) if len(y) else 0.0
        if not 0 < share < 1:
            self.bias = 30.0 if share else -30.0
            return self
        self.bias = float(np.log(share / (1 - share)))
        self.known = np.unique(terms).astype(np.int64)
        rng, step = np.random.default_rng(11), 0
        self.w = np.zeros(len(self.known))
        self.v = rng.normal(0, 0.02, (len(self.known), FACTORS))
        own, size = self._own(terms, starts)
        at = np.concatenate([[0], np.cumsum(size)])
        moments = [np.zeros_like(p) for p in (self.w, self.w, self.v, self.v)]
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                step += 1
                rows = order[lo:lo + BATCH]
                n = size[rows]
                idx = own[np.repeat(at[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                doc = np.repeat(np.arange(len(rows)), n)
                stay = rng.random(len(idx)) >= DROP
                idx, doc = idx[stay], doc[stay]
                z, sums, x = self._raw(idx, doc, len(rows))
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                self.bias -= RATE * float(err.sum())
                uniq, inv = np.unique(idx, return_inverse=True)
                e = err[doc]
                gw = np.bincount(inv, e, len(uniq)) + L2_W * self.w[uniq]
                gv = np.stack([np.bincount(inv, e * (sums[doc, f] - x[:, f]), len(uniq))
                               for f in range(FACTORS)], 1) + L2_V * self.v[uniq]
                for p, g, m1, m2 in ((self.w, gw, moments[0], moments[1]),
                                     (self.v, gv, moments[2], moments[3])):
                    m1[uniq] = 0.9 * m1[uniq] + 0.1 * g
                    m2[uniq] = 0.99 * m2[uniq] + 0.01 * g * g
                    p[uniq] -= RATE * (m1[uniq] / (1 - 0.9 ** step)) \
                        / (np.sqrt(m2[uniq] / (1 - 0.99 ** step)) + 1e-6)
        return self


def telling(sample: DataFrame) -> list[int]:
    """Sorted numbers of the terms whose share among toxic and other documents
    differs clearly; their number is bounded by the sample's."""
    n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    n0 = n - n1
    if not n0 or not n1:
        return []
    c, hits = F.col("c"), F.col("hits")
    spread = F.sqrt(c / n * (1 - c / n) * (1 / n1 + 1 / n0))
    kept = sample.select("y", F.explode("terms").alias("t")).groupBy("t") \
        .agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("hits")) \
        .where((c >= MIN_DOCS) & (F.abs(hits / n1 - (c - hits) / n0) >= MIN_Z * spread) & (spread > 0))
    return sorted(r["t"] for r in kept.select("t").collect())


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> FactorizationMachine:
    known = labels.where("toxic is not null and doc_id is not null") \
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("y")) \
        .where(~held_out())
    n = known.count()
    part = 1 << 30
    keep = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(part))
                       < int(part * min(1.0, bound / max(n, 1))))
    # one row per doc_id, the bound holds for repeated rows too
    sample = store(with_terms(docs.join(keep.select("doc_id"), "doc_id", "left_semi")
                              .select("doc_id", "text").dropDuplicates(["doc_id"]))
                   .join(keep, "doc_id").select("doc_id", "terms", F.col("y").cast("double").alias("y")),
                   "toxicity_sample")
    told = telling(sample)
    rows = sample.select("doc_id", "y", F.array_intersect(
        "terms", F.array(*[F.lit(t) for t in told]).cast("array<int>")).alias("terms")) \
        .orderBy("doc_id").toArrow()
    col = rows.column("terms").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    starts = col.offsets.to_numpy().astype(np.int64)
    return FactorizationMachine().fit(col.values.to_numpy()[starts[0]:starts[-1]],
                                      starts - starts[0], rows.column("y").to_numpy())


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.known, model.w, model.v))

    def run(batches):
        m = FactorizationMachine(*sent.value)
        for b in batches:
            col = b.column(2)
            ends = col.offsets.to_numpy().astype(np.int64)
            s = m.scores(col.values.to_numpy()[ends[0]:ends[-1]], ends - ends[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)],
                                             names=["doc_id", "held_out", "score"])
    return with_terms(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                   held_out().alias("held_out"), "terms") \
        .mapInArrow(run, "doc_id long, held_out boolean, score double")


def op2_toxicity_fm(spark, sf_dir) -> DataFrame:
    """Toxicity score of every whole text of ``documents``."""
    docs = documents(spark, sf_dir)
    model = train(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
