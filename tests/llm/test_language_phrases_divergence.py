"""Operators 11 to 13: language spans, phrase collocations, source divergence."""

import itertools
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import language_spans as L
from tidewell.llm import phrase_mining as P
from tidewell.llm import source_divergence as D

EN = "the quick brown fox jumps over the lazy dog while they were walking through this green field".split()
ES = "el perro corre por la calle mientras los niños juegan con una pelota roja en aquel jardín".split()
RU = "собака бежит по улице пока дети играют в саду около большого дома и очень быстро".split()
ZH = "我们今天在公园里看见一只小狗它跑得很快孩子们都笑了".split()


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, -1, 3, "x") for i, t, lang, s in rows],
                                 "doc_id bigint, text string, lang string, source string, "
                                 "n bigint, `rank` int, spans string")


# ------------------------------------------------------------------ op11
@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(w, k=30)), lang, "s") for i, (lang, w) in
            enumerate([(lang, w) for lang, w in (("en", EN), ("es", ES), ("ru", RU), ("zh", ZH))] * 60)]
    return L.train(_docs(spark, rows + [(900, "nothing", None, None), (None, "no id", "en", "s")]))


def test_spans_of_mixed_texts(model):
    text = " ".join(EN[:8]) + " " + " ".join(ES[:8]) + ". " + " ".join(RU[:5]) + " " + ZH[0]
    lang, score, (offsets, start, end, which) = L.label(model, [text, "", "12 !!", " ".join(RU)])
    found = [(text[s:e], model.langs[k]) for s, e, k in zip(start, end, which)][:offsets[1]]
    assert found == [(" ".join(EN[:8]), "en"), (" ".join(ES[:8]), "es"), (" ".join(RU[:5]), "ru"), (ZH[0], "zh")]
    assert [model.langs[k] if k >= 0 else None for k in lang][1:] == [None, None, "ru"]
    assert score[1] == score[2] == 0 and score[3] > 0.99 and 0 < score[0] < 0.9


def test_scripts_narrow_candidates(model):
    # a word of another script cannot be English, however unlikely its letters are elsewhere
    w = L.Words.of(["хфщ", "qzx", "ασδ"])
    s = model.word_scores(w)
    ru, en, es, zh = (model.langs.index(x) for x in ("ru", "en", "es", "zh"))
    assert s[0, ru] == 0 and s[0, en] < -1e5 and s[1, ru] < -1e5 and max(s[1, en], s[1, es]) == 0
    assert (s[2] > -1e5).all()                   # a script nobody wrote tells nothing by itself
    assert unicodedata.normalize("NFD", "é")[1:] == "́"
    marked = L.Words.of(["café ́ हिन्दी"])
    assert marked.letters.tolist() == [4, 3] and marked.end.tolist() == [5, 14]


@pytest.mark.parametrize("switch", [0.5, 3.0])
def test_viterbi_equals_all_paths(switch):
    rng = np.random.default_rng(4)
    size = [0, 5, 1, 0, 6, 3]
    doc = np.repeat(np.arange(6), size)
    s = np.round(-rng.random((len(doc), 3)) * 4, 3).astype(np.float32)
    start = np.log(np.array([0.5, 0.3, 0.2], np.float32))
    got = L.viterbi(s, doc, 6, start, switch)

    def value(path, rows):
        return start[path[0]] + sum(s[r, k] for r, k in zip(rows, path)) - switch * sum(
            a != b for a, b in zip(path, path[1:]))
    for d in range(6):
        rows = np.flatnonzero(doc == d)
        if len(rows):
            best = max(value(p, rows) for p in itertools.product(range(3), repeat=len(rows)))
            assert abs(value(got[rows], rows) - best) < 1e-3


def test_language_of_odd_rows(spark, model, odd, none):
    got = L.label_documents(odd, model)
    rows = got.collect()
    assert len(rows) == odd.count()
    docs = {(r["doc_id"], r["text"]) for r in odd.collect()}
    letters = {i: any(c.isalpha() for c in t or "") for i, t in docs if i in (3, 4, 5, 7, 8)}
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in letters:
            assert (r["lang_pred"] == "und") == (not letters[r["doc_id"]])
            assert bool(r["spans"]) == letters[r["doc_id"]]
    assert L.label_documents(none, model).count() == 0
    untaught = L.train(none)
    assert {r["lang_pred"] for r in L.label_documents(odd, untaught).collect()} == {"und"}


def test_language_held_out_accuracy(spark, sf_small):
    from tidewell.sources.tables import load
    docs = load(spark, sf_small, "documents")
    got = L.op11_language_spans(spark, sf_small).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n >= 20 and right >= 0.97 * n
    # labels are no input of a prediction: other labels, same held-out predictions need the same model
    model = L.train(docs)
    shuffled = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.label_documents(x, model).collect()}
            for x in (docs, shuffled))
    assert a == b


# ------------------------------------------------------------------ op12
def _phrases(rows, least, longest):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        covered = any(la == lang and len(q) > len(p) and c >= least and 100 * c >= 100 * a
                      and any(q[i:i + len(p)] == p for i in range(len(q))) for (la, q), c in f.items())
        if not covered:
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return {(lang, i, p.decode(), -a, x, y, n, -s) for lang, v in out.items()
            for i, (s, a, p, x, y, n) in enumerate(sorted(v), 1)}


def _rows(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def test_phrases_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    vocab = ["A", "b", "New", "york", "city", "é", " x", "日本", "q'", "z-z"]
    rows = []
    for i in range(120):
        w = [rnd.choice(vocab) + rnd.choice(["", "", "", ",", ".", "\t", "  ", "\x0b", "\n"]) for _ in range(40)]
        if i % 3 == 0:
            w += ["New York City Hall"] * 2 + ["new  york\tcity hall a b"]
        rows.append((i, " ".join(w), rnd.choice(["en", "en", None, "", "fr"]), "s"))
    rows += [(1, None, "en", "s"), (1, "", "xx", None), (None, " \t ", "en", None)]
    docs = _docs(spark, rows)
    want = _phrases(rows, 6, 4)
    assert len(want) > 50
    assert _rows(P.collocations(P.phrase_counts(docs, 6, 4), 4)) == want
    # many small stripes, split hot prefixes, a tiny filter that lets most phrases through
    monkeypatch.setattr(P, "CHUNK", 200)
    monkeypatch.setattr(P, "HELD", 50)
    monkeypatch.setattr(P, "HOT_PART", 10)
    monkeypatch.setattr(P, "LEAST_BITS", 6)
    monkeypatch.setattr(P, "MOST_BITS", 6)
    assert _rows(P.collocations(P.phrase_counts(docs, 6, 4), 4)) == want
    top = _rows(P.collocations(P.phrase_counts(docs, 6, 4), 4, top=3))
    assert top == {r for r in want if r[1] <= 3}


def test_phrases_of_odd_rows(spark, odd, none):
    got = P.collocations(P.phrase_counts(odd)).collect()
    # "the cat sat." 20,000 times: its pairs are covered by the whole
    assert ("the cat sat", 20000) in {(r["phrase"], r["a"]) for r in got}
    assert not {"the cat", "cat sat"} & {r["phrase"] for r in got}
    assert P.collocations(P.phrase_counts(none)).count() == 0
    assert P.collocations(P.phrase_counts(odd.limit(0))).count() == 0


def test_scores_past_64_bits(spark):
    big = 10 ** 13
    one = spark.createDataFrame([("en", "", 4 * big), ("en", "a", 3 * big), ("en", "b", big + 7)],
                                "lang string, phrase string, f bigint")
    two = spark.createDataFrame([("en", "a b", big - 1)], "lang string, phrase string, f bigint")
    r = P.collocations([one, two]).first()
    assert r["score"] == 1000 * (big - 1) * 4 * big // (3 * big * (big + 7))


def test_stripes_are_sent_in_small_batches(monkeypatch):
    monkeypatch.setattr(P, "SENT", 50, raising=False)
    counter = Counter({f"p{i % 90}\x01 q w{i}".encode(): i + 1 for i in range(900)})
    counter.update({f"p{i} q w{i}".encode(): 2 for i in range(90)})
    batches = P._stripe_rows({"en": counter}, frozenset({("en", "p0 q")}))
    got, sizes = Counter(), []
    for b in batches:
        rows = b.to_pylist()
        sizes.append(sum(len(r["words"]) for r in rows))
        for r in rows:
            got.update({f"{r['prefix']} {w}".encode(): n for w, n in zip(r["words"], r["counts"], strict=True)})
    assert got == counter and max(sizes) < 50 + 10 and len(sizes) > 10


def test_long_text_is_cut_between_pieces():
    text = b"a b. " * 900_000
    parts = list(P._chunks([text, b"c d"]))
    assert max(map(len, parts)) < 2.1 * P.CHUNK
    assert sum(len(P._normal(x).split()) for x in parts) == 1_800_002


# ------------------------------------------------------------------ op13
def _divergence(rows, least=3, top=200):
    tf, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        tf[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang in {x for x, _ in tf}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        groups = {s: tf[x, s] for x, s in tf if x == lang}
        whole = sum(groups.values(), Counter())

        def prices(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + int(Fraction(10 ** 9 * (c[t] + 1), n + len(kept))) for t in kept}
        p = {s: prices(c) for s, c in groups.items()}
        q = prices(whole)
        for s in groups:
            def ranked(part, items, most):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                return {(lang, s, part, i, v, k) for k, (i, v) in enumerate(order, 1)}
            out |= ranked("pair", [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept))
                                   for o in groups if o != s], None)
            out |= ranked("term", [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept
                                   if groups[s][t] and p[s][t] > q[t]], top)
    return out


def _answers(df):
    return {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()}


def test_divergence_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "日本", "The", "the"]
    rows = []
    for i in range(150):
        source = rnd.choice(["hot", "hot", "hot", "a", "b", None, ""])
        rows.append((i, " ".join(rnd.choices(vocab, [1 + (j % 7) * (source == "hot") for j in range(94)], k=30))
                     + "'s e-mail x_y 12ab", rnd.choice(["en", "en", None, "fr"]), source))
    rows += [(7, "lonely words here", "zz", "only"), (8, "lonely", "zz", "two"), (9, None, "en", "empty"),
             (9, "", "yy", "z"), (None, "12 34", "fr", "digits")]
    docs = _docs(spark, rows)
    want = _divergence(rows)
    assert _answers(D.divergence(docs)) == want
    monkeypatch.setattr(D, "HELD", 40)
    monkeypatch.setattr(D, "SMALL_ROWS", 0)
    assert _answers(D.divergence(docs, block=16)) == want
    assert _answers(D.divergence(docs, top=2)) == _divergence(rows, top=2)


def test_divergence_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert _answers(D.divergence(odd)) == _divergence(rows)
    assert D.divergence(none).count() == 0


def test_pair_merge_past_64_bits():
    n = 9 * 10 ** 18 // 10 ** 9
    a = (np.array([1, 4, 9], np.int32), np.array([n, 5 * n, 3], np.int64))
    b = (np.array([4, 7], np.int32), np.array([2, 10 * n], np.int64))
    n_a, n_b, v = 6 * n + 3, 10 * n + 2, 12
    count = [dict(zip(x[0].tolist(), x[1].tolist())) for x in (a, b)]
    p, q = ({t: 1 + 10 ** 9 * (c.get(t, 0) + 1) // (m + v) for t in (1, 4, 7, 9)}
            for c, m in zip(count, (n_a, n_b)))
    ab = sum((p[t] - q[t]) ** 2 // q[t] for t in p)
    ba = sum((p[t] - q[t]) ** 2 // p[t] for t in p)
    assert D.merge_pair(a, b, n_a, n_b, v) == (4, ab, ba)


@pytest.mark.parametrize("name, run, sql", [
    ("op12", P.op12_phrase_collocations, P.OP12_SQL), ("op13", D.op13_source_divergence, D.OP13_SQL)])
def test_sql_of_new_operators(spark, sf_small, name, run, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_small}/documents.parquet'")
    cur = con.execute(sql)
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in names]
    want = sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    df = run(spark, sf_small)
    assert sorted(df.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == want
