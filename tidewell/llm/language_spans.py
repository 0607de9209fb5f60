"""Language identification of mixed-language texts.

A text is cut into words: runs of letters of one script with the marks on them; in
scripts written without spaces, runs of at most ``DENSE`` letters.  Three steps
label every word:

1. *Script ranges narrow the candidates.*  ``SCRIPTS`` maps code points to scripts.  A
   word's candidates are the languages that wrote at least ``SCRIPT_SHARE`` of their
   learned words in its script; if none did, the word tells nothing.
2. *Scores.*  Each candidate scores the word by the mean of three estimates of its
   log probability: from letter triples, from letter pairs, both with word borders,
   and from the whole word.  All are hashed into ``BUCKETS`` counters a kind and
   smoothed by ``SMOOTH``.
3. *Viterbi.*  The best sequence of languages over the document's words, where each
   change costs ``SWITCH`` (natural log).  The start costs the language's share of
   documents.  All documents of a chunk of texts take a step at a time together.

Equal neighbours merge into spans (start, end, lang; code points, end exclusive).
The document's language has most letters in the spans; its score is that share of
the letters times the probability of the language over the words that it labels.

Learning counts, in Spark, the words of at most about ``TRAIN_DOCS`` documents a
language (a fixed part by a hash of doc_id, all when there are fewer) that have a
lang and are not held out; the ``MOST_LANGS`` most frequent languages are learned.
These are the bounds of the sample that the classifier is fitted on.  The model,
about 0.4 MB a language, is broadcast; scoring is one pass without shuffle.

Defined results: a null text or one without letters gets ``und``, score 0 and no
spans, so does every text if nothing can be learned; a null doc_id is neither held
out nor learned from; repeated rows are labelled one by one; equal numbers of letters
are decided by the scores, then by the name of the language; long texts are labelled
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import documents

BUCKETS = 1 << 15
TRAIN_DOCS, MOST_LANGS = 3000, 1000
SMOOTH = 0.5
SWITCH = 8.0
SCRIPT_SHARE = 0.02
DENSE = 3
CHUNK = 1 << 21                    # code points times languages / 4 worked on at once
HELD_OUT_OF, HELD_OUT = 5, 0
NONE = "und"

# fixed values: scripts and their code points (first, last)
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "oriya": ((0xB00, 0xB7F),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "ethiopic": ((0x1200, 0x139F),),
    "khmer": ((0x1780, 0x17FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
UNSPACED = ("thai", "lao", "tibetan", "myanmar", "khmer", "kana", "han")
OTHER, MARK = len(SCRIPTS) + 1, 255          # a letter outside all ranges; a combining mark
KINDS = 3                                    # triples, pairs, words
DOCS_AT = -1                                 # feature numbers below 0: documents, then scripts


class _Tables:
    """Script and lower case of every code point, made once a worker."""
    script = lower = dense = None

    @classmethod
    def get(cls):
        if cls.script is None:
            top = sys.maxunicode + 1
            script, lower = np.zeros(top, np.uint8), np.arange(top, dtype=np.int32)
            kind = [unicodedata.category(chr(c))[0] for c in range(top)]
            letters = np.array([k == "L" for k in kind])
            script[letters] = OTHER
            for number, ranges in enumerate(SCRIPTS.values(), 1):
                for first, last in ranges:
                    part = script[first:last + 1]
                    part[letters[first:last + 1]] = number
            script[np.array([k == "M" for k in kind])] = MARK
            for c in np.flatnonzero(letters).tolist():
                small = chr(c).lower()
                if len(small) == 1:
                    lower[c] = ord(small)
            dense = np.zeros(256, bool)
            dense[[list(SCRIPTS).index(s) + 1 for s in UNSPACED]] = True
            cls.script, cls.lower, cls.dense = script, lower, dense
        return cls.script, cls.lower, cls.dense


@dataclass
class Words:
    """Words of joined texts, in order, and their hashed features by letter."""
    doc: np.ndarray          # text of each word
    start: np.ndarray        # within its text
    end: np.ndarray
    script: np.ndarray
    letters: np.ndarray      # marks left out
    first: np.ndarray        # position of the word's first letter in the two arrays below
    triple: np.ndarray
    pair: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> "Words":
        scripts, lower, dense = _Tables.get()
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = scripts[cp]
        own = np.arange(len(cp))
        script = kind[np.maximum.accumulate(np.where(kind == MARK, 0, own))] if len(cp) else kind
        script = np.where(script == MARK, 0, script)
        change = script != np.concatenate([[0], script[:-1]]) if len(cp) else np.zeros(0, bool)
        begin = change & (script != 0)
        crowded = np.flatnonzero(dense[script])
        if len(crowded):
            run = np.maximum.accumulate(np.where(change, own, 0))
            begin[crowded[(crowded - run[crowded]) % DENSE == 0]] = True
        inside = np.flatnonzero(script)
        at = np.flatnonzero(begin[inside])                   # first letters among the inside ones
        starts = inside[at]
        last = np.concatenate([at[1:] - 1, [len(inside) - 1]]) if len(at) else at
        ends = inside[last] + 1 if len(at) else starts
        border = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        doc = np.searchsorted(border, starts, "right") - 1
        low = lower[cp[inside]].astype(np.uint64)
        before, after = np.zeros_like(low), np.zeros_like(low)
        before[1:], after[:-1] = low[:-1], low[1:]
        before[at] = 1
        after[last] = 1
        mul = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
        shift = np.uint64(64 - (BUCKETS - 1).bit_length())

        def bucket(h):
            return ((h ^ (h >> np.uint64(31))) * mul[1] >> shift).astype(np.int32)
        pair = before * mul[0] + low * mul[1]
        size = np.diff(np.concatenate([at, [len(inside)]]))
        place = np.arange(len(inside)) - np.repeat(at, size)
        with np.errstate(over="ignore"):
            spread = (low + np.uint64(1)) * (place.astype(np.uint64) * mul[0] | np.uint64(1))
        whole = np.add.reduceat(spread, at) if len(at) else spread
        marks = np.add.reduceat((kind[inside] == MARK).astype(np.int64), at) if len(at) else size
        return cls(doc, starts - border[doc], ends - border[doc], script[starts], size - marks, at,
                   bucket(pair + after * mul[2]), bucket(pair), bucket(whole * mul[2]))


@dataclass
class Model:
    """Score tables of the learned languages (sorted); empty when none is known."""
    langs: list
    start: np.ndarray        # log share of documents
    tables: np.ndarray       # kind, bucket, language: weighted log probabilities
    scripts: np.ndarray      # script, language: 0 for candidates, else far below

    def word_scores(self, w: Words) -> np.ndarray:
        """One row a word: each language's score below the best one's."""
        triple, pair, word = self.tables
        s = np.add.reduceat(triple[w.triple] + pair[w.pair], w.first, axis=0) + word[w.word]
        s += self.scripts[w.script]
        return s - s.max(axis=1, keepdims=True)


def fit(langs, docs, features) -> Model:
    """Model from {lang: documents} and rows (lang, feature, n)."""
    names = sorted(langs)
    if not names:
        return Model([], np.empty(0), np.empty((KINDS, BUCKETS, 0)), np.empty((256, 0)))
    n = np.zeros((KINDS, BUCKETS, len(names)))
    scripts = np.zeros((256, len(names)))
    at = {name: i for i, name in enumerate(names)}
    which = np.array([at[x] for x in docs], np.int64)
    number, count = features
    f = number >= 0
    n.reshape(-1, len(names))[number[f], which[f]] = count[f]
    scripts[-number[~f] - 2, which[~f]] = count[~f]
    logs = np.log((n + SMOOTH) / (n.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS))
    # a letter is in three triples and two pairs; three estimates are averaged
    logs *= np.array([1 / 3, 1 / 2, 1])[:, None, None] / KINDS
    shares = scripts / np.maximum(scripts.sum(axis=0), 1)
    far = np.where(shares >= SCRIPT_SHARE, 0.0, -1e6)
    far[(far < 0).all(axis=1)] = 0.0
    unknown = ~(scripts > 0).any(axis=1)
    size = np.array([langs[x] for x in names], float)
    model = Model(names, np.log(size / size.sum()).astype(np.float32),
                  logs.astype(np.float32), far.astype(np.float32))
    model.tables[:, :, :] -= model.tables.max(axis=2, keepdims=True)
    model.scripts[unknown] = 0.0
    return model


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, start: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word.  ``doc`` is sorted; the documents, longest first,
    take their steps together."""
    size = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    first = (np.cumsum(size) - size)[order]
    length = size[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, longest + 1), "right")     # documents with a t-th word
    own = np.arange(scores.shape[1], dtype=np.int16)
    back = np.empty(scores.shape, np.int16)
    v = np.zeros((len(order), scores.shape[1]), np.float32)
    for t in range(longest):
        k = active[t]
        rows = first[:k] + t
        if t == 0:
            v[:k] = start + scores[rows]
            continue
        held = v[:k]
        best = held.argmax(axis=1)
        change = held[np.arange(k), best] - switch
        jump = change[:, None] > held
        back[rows] = np.where(jump, best[:, None], own)
        held = np.where(jump, change[:, None], held)
        held -= change[:, None]                       # keeps sums small
        v[:k] = held + scores[rows]
    path, now = np.empty(len(doc), np.int64), v.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        rows = first[:k] + t
        path[rows] = now[:k]
        if t:
            now[:k] = back[rows, now[:k]]
    return path


def label(model: Model, texts: list[str], switch: float = SWITCH):
    """(languages, scores, span lists (offsets, start, end, lang)) of whole texts."""
    n, L = len(texts), len(model.langs)
    lang, score = np.full(n, -1), np.zeros(n)
    w = Words.of(texts) if L else None
    if w is None or not len(w.doc):
        return lang, score, (np.zeros(n + 1, np.int32), *(np.empty(0, np.int32),) * 3)
    s = model.word_scores(w)
    path = viterbi(s, w.doc, n, model.start, switch)
    letters = np.bincount(w.doc * L + path, w.letters, n * L).reshape(n, L)
    total = letters.sum(axis=1)
    gain = np.bincount(w.doc * L + path, s[np.arange(len(path)), path], n * L).reshape(n, L)
    # most letters; then the language whose words fit it better
    most = letters == letters.max(axis=1, keepdims=True)
    pred = np.where(most, gain, -np.inf).argmax(axis=1)
    mine = path == pred[w.doc]
    evidence = np.stack([np.bincount(w.doc[mine], s[mine, k], n) for k in range(L)], 1) + model.start
    evidence -= evidence.max(axis=1, keepdims=True)
    sure = np.exp(evidence)
    sure = sure[np.arange(n), pred] / sure.sum(axis=1)
    has = total > 0
    lang[has] = pred[has]
    score[has] = (letters[np.arange(n), pred] / np.maximum(total, 1) * sure)[has]
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (w.doc[1:] != w.doc[:-1])
    at = np.flatnonzero(new)
    to = np.concatenate([at[1:] - 1, [len(path) - 1]])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(w.doc[at], minlength=n))]).astype(np.int32)
    return lang, score, (offsets, w.start[at].astype(np.int32), w.end[to].astype(np.int32), path[at])


def _chunks(texts: list[str], size: int):
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


FEATURES = "lang string, feature array<long>, n array<long>"


def _count_features(batches):
    """Feature counts of a task, one row a language."""
    held = {}
    for batch in batches:
        by_lang = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for lo, hi in _chunks(texts, CHUNK):
                w = Words.of(texts[lo:hi])
                n = held.setdefault(lang, np.zeros(KINDS * BUCKETS + 256, np.int64))
                for kind, feature in enumerate((w.triple, w.pair, w.word)):
                    n[kind * BUCKETS:(kind + 1) * BUCKETS] += np.bincount(feature, minlength=BUCKETS)
                n[KINDS * BUCKETS:] += np.bincount(w.script, minlength=256)
    for lang, n in held.items():
        at = np.flatnonzero(n)
        number = np.where(at < KINDS * BUCKETS, at, KINDS * BUCKETS - 2 - at)
        yield pa.RecordBatch.from_pydict({"lang": [lang], "feature": [number], "n": [n[at]]},
                                         schema=pa.schema([("lang", pa.string()), ("feature", pa.list_(pa.int64())),
                                                           ("n", pa.list_(pa.int64()))]))


def train(docs: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """Model of the labelled documents that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col("lang").cast("string").alias("lang"))
             .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not sizes:
        return fit({}, [], (np.empty(0, np.int64), np.empty(0)))
    part = 1 << 30
    taken = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int(part * min(1.0, bound / n)))])
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(11)), F.lit(part))
                         < F.coalesce(F.try_element_at(taken, F.col("lang").cast("string")), F.lit(0)))
    rows = sample.where("text is not null") \
        .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_count_features, FEATURES) \
        .select("lang", F.explode(F.arrays_zip("feature", "n")).alias("x")) \
        .groupBy("lang", F.col("x.feature").alias("feature")).agg(F.sum("x.n").alias("n")).toArrow()
    return fit(sizes, rows.column("lang").to_pylist(),
               (rows.column("feature").to_numpy(), rows.column("n").to_numpy()))


LABELLED = ("doc_id long, held_out boolean, lang_pred string, score double, "
            "spans array<struct<start: int, end: int, lang: string>>")


def label_documents(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        names = pa.array([*m.langs, NONE], pa.string())
        size = max(CHUNK * 4 // max(len(m.langs), 4), 1 << 14)
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in _chunks(texts, size):
                lang, score, (offsets, start, end, which) = label(m, texts[lo:hi], switch)
                spans = pa.StructArray.from_arrays(
                    [pa.array(start, pa.int32()), pa.array(end, pa.int32()), names.take(pa.array(which, pa.int64()))],
                    names=["start", "end", "lang"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                     names.take(pa.array(np.where(lang < 0, len(m.langs), lang))), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
                    names=["doc_id", "held_out", "lang_pred", "score", "spans"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .mapInArrow(run, LABELLED)


def op11_language_spans(spark, sf_dir) -> DataFrame:
    """Language of every whole text of ``documents``, from its labelled spans."""
    docs = documents(spark, sf_dir)
    return label_documents(docs, train(docs)).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"),
        F.size(F.array_distinct("spans.lang")).alias("n_langs"))
