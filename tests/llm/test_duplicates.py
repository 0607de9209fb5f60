"""Operators 4, 9 and 10 and the pipeline against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import benchmark_decontamination as B
from tidewell.llm import minhash_dedup as D
from tidewell.llm import repeat_removal as X
from tidewell.llm.common import store
from tidewell.llm.components import components


def prose(rnd, n, words=400):
    return [f"w{rnd.randrange(words)}" for _ in range(n)]


# ------------------------------------------------------------- decontamination

def test_leaks_tolerate_substitutions(spark, make, odd, none):
    rnd = random.Random(1)
    items = [prose(rnd, 30, 5000) for _ in range(6)] + [["solo"], prose(rnd, 6, 5000)]
    bench = spark.createDataFrame(
        [(i, " ".join(w).capitalize() + ".") for i, w in enumerate(items)] + [(90, " ".join(items[0])), (91, None), (92, "")],
        "item_id bigint, text string")

    def inside(w):
        return " ".join(prose(rnd, 60) + ["—"] + w + prose(rnd, 60))
    changed = [f"new{i}" if i % 7 == 3 else w for i, w in enumerate(items[1])]
    docs = make([(0, inside(items[0]), "a"), (1, inside(changed), "a"), (2, inside(items[2][:12]), "a"),
                 (3, inside([]), "a"), (4, "\n".join(items[3]), "a"), (5, None, "a"), (6, inside(items[7]), "a"),
                 (None, inside(items[4]), "a"), (7, inside(["solo"]), "a")])
    got = {(r["doc_id"], r["item_id"]) for r in B.leaks(docs, bench).collect()}
    assert got == {(0, 0), (0, 90), (1, 1), (4, 3), (6, 7), (None, 4)}
    kept = B.drop_leaks(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 7] and kept.columns == docs.columns
    assert B.drop_leaks(odd, bench).count() == odd.count()
    assert B.leaks(none, bench).count() == 0 and B.leaks(docs, bench.where("false")).count() == 0


def test_leaks_in_blocks(spark, make, monkeypatch):
    rnd = random.Random(2)
    items = [prose(rnd, 25, 5000) for _ in range(8)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    docs = make([(i, " ".join(prose(rnd, 20) + w), "a") for i, w in enumerate(items)])
    monkeypatch.setattr(B, "BLOCK_SEEDS", 100)
    assert {(r["doc_id"], r["item_id"]) for r in B.leaks(docs, bench).collect()} == {(i, i) for i in range(8)}


def test_leaks_of_a_part_and_of_bent_items(spark, make):
    rnd = random.Random(3)
    items = [prose(rnd, n, 50000) for n in (59, 100, 100, 40, 24, 24, 60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    part = [items[0][:40], items[1][:50], items[2][50:], items[3][:20] + ["new"] + items[3][20:],
            items[4][:12] + ["new"] + items[4][12:], items[5][:12] + items[5][13:], items[6][30:42]]
    docs = make([(i, " ".join(prose(rnd, 20) + w + prose(rnd, 20)), "a") for i, w in enumerate(part)])
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in B.leaks(docs, bench).collect()}
    assert set(got) == {(i, i) for i in range(6)}        # 12 words in a row are not enough
    assert got[0, 0] == 40 and got[4, 4] == 24 and got[5, 5] == 23
    assert [r["doc_id"] for r in B.drop_leaks(docs, bench).collect()] == [6]


def test_masks_miss_no_overlap_that_counts(spark, make):
    def hit(kept, masks):
        return any(all(s + o in kept for o in m) for m in masks for s in kept)
    for n in range(3, 19):                      # every pattern of changed words
        for gone in itertools.combinations(range(n), n * (100 - B.MIN_MATCH) // 100):
            assert hit(set(range(n)) - set(gone), [B.MASKS[m] for m in B.masks_of(n)]), (n, gone)
    long = [B.MASKS[m] for m in B.masks_of(60)]
    for gone in itertools.combinations(range(B.RUN), 3):    # every stretch of a long item
        assert hit(set(range(B.RUN)) - set(gone), long), gone


def test_leaks_of_short_items_match_brute_force(spark, make):
    rnd = random.Random(4)
    items = [prose(rnd, n, 50000) for n in (*range(2, 25), *range(4, 25))]
    items += [list("猫が窓の外を見て鳴いた日の朝のこと")]
    bench = spark.createDataFrame([(i, ("" if i == len(items) - 1 else " ").join(w)) for i, w in enumerate(items)],
                                  "item_id bigint, text string")
    rows, want = [], set()
    for i, w in enumerate(items):
        for k in range(4):
            changed = rnd.sample(range(len(w)), min(len(w), len(w) * 30 // 100 + (k == 3 and len(w) < 9)))
            held = [f"new{j}" if j in changed else x for j, x in enumerate(w)]
            rows.append((len(rows), " ".join(prose(rnd, 9) + held + prose(rnd, 9)), "a"))
            if (len(w) - len(changed)) * 100 >= len(w) * B.MIN_MATCH:
                want.add((rows[-1][0], i))
    rows.append((len(rows), "".join(items[-1]), "a"))
    want.add((rows[-1][0], len(items) - 1))
    assert {(r["doc_id"], r["item_id"]) for r in B.leaks(make(rows), bench).collect()} == want


# ------------------------------------------------------------------ components

def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 240)] + [(1, 1)]
    edges = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in pairs], "u string, v string")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[f"{i:04d}"] == "0100" for i in range(100, 141))
    assert all(got[f"{i:04d}"] == "0007" for i in range(200, 240)) and "0001" not in got


# --------------------------------------------------------------------- minhash

def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t or "") for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(rows))]


def near_rows():
    rnd, rows = random.Random(5), []
    base = prose(rnd, 200, 9000)
    for i in range(120):                       # a large group of near copies
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(w), "a"))
    passage = prose(rnd, 60, 9000)
    rows += [(200 + i, " ".join(prose(rnd, 50, 9000) + passage), "a") for i in range(60)]
    rows += [(300 + i, " ".join(prose(rnd, 40, 9000)), "a") for i in range(20)]
    chain = prose(rnd, 120, 9000)
    rows += [(400 + i, " ".join(chain[i * 6:i * 6 + 70]), "a") for i in range(8)]   # links only in a row
    rows += [(500, "One two", "a"), (501, "one TWO", "a"), (502, "", "a"), (503, "", "a")]
    return rows


def test_components_match_all_pairs(make, monkeypatch):
    rows = near_rows()
    want = brute_components(rows)
    for block, pairs in ((D.BLOCK, D.PAIRS_A_TASK), (3, 2)):     # the second makes many blocks and dealt hubs
        monkeypatch.setattr(D, "BLOCK", block)
        monkeypatch.setattr(D, "PAIRS_A_TASK", pairs)
        got = {r["doc_id"]: r for r in D.near_duplicates(make(rows)).collect()}
        for i, (doc, text, _) in enumerate(rows):
            assert got[doc]["component_id"] == min(rows[j][0] for j in range(len(rows)) if want[j] == want[i]), doc
            assert got[doc]["n"] == len(shingles(text))


def test_odd_rows_and_keep_one(odd, none):
    got = D.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    kept = D.keep_one(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(9) == 2 and kept.columns == odd.columns
    assert {3, 4, 5} <= set(ids)
    assert D.near_duplicates(none).count() == 0 and D.keep_one(none).count() == 0


def test_keep_one_with_32_bit_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, "other words"), (4, "")],
                                 "doc_id int, text string")
    kept = D.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and kept.schema == docs.schema


def test_estimates_are_close():
    rng = np.random.default_rng(8)
    for share in (0.2, 0.5, 0.75, 0.9):
        n = 4000
        common = rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)
        rest = n - len(common)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, rest // 2, dtype=np.uint64)]) for _ in range(2))
        r = [D.registers(x, np.array([0])) for x in (a, b)]
        j = D.estimate(*r, np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(j - len(common) / (len(common) + 2 * (rest // 2))) < 0.13


# --------------------------------------------------------------------- repeats

def brute_repeats(rows):
    data = [(1 << 63 if i is None else i, (t or "").encode()) for i, t, _ in rows]
    first, out = {}, []
    for i, b in data:
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            first[s] = min(first.get(s, 1 << 64), i)
    for i, b in data:
        mark = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                mark[p:p + 50] = b"\1" * 50
        spans = sum(1 for j, m in enumerate(mark) if m and (j == 0 or not mark[j - 1]))
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((i if i < 1 << 63 else None, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(make, none, monkeypatch):
    rnd = random.Random(9)
    passage = " ".join(prose(rnd, 30, 900)) + " é日本 "
    rows = [(i, " ".join(prose(rnd, rnd.randrange(5, 60), 900)) + passage[rnd.randrange(40):rnd.randrange(45, 200)]
             + " ".join(prose(rnd, 20, 900)), "a") for i in range(150)]
    rows += [(200, rows[3][1], "a"), (201, rows[3][1], "a"), (201, rows[3][1], "a"), (2, rows[3][1], "a"),
             (202, None, "a"), (203, "", "a"), (204, "x" * 49, "a"), (205, "x" * 49, "a"), (206, "y" * 500, "a"),
             (207, "y" * 60, "a"), (None, passage, "a"), (None, passage + "end", "a"), (5, passage, "b")]
    monkeypatch.setattr(X, "CHUNK_BYTES", 4000)      # many chunks
    monkeypatch.setattr(X, "BUCKET_BYTES", 3000)
    got = sorted((tuple(r) for r in X.remove_repeats(make(rows)).collect()), key=str)
    assert got == brute_repeats(rows)
    assert X.remove_repeats(none).count() == 0


def test_hashes_do_not_depend_on_pieces():
    body = np.random.default_rng(1).integers(0, 3, 5000).astype(np.uint8)
    for n in (X.SAMPLE, X.MATCH):
        assert (X.string_hashes(body, n) == X.string_hashes(body, n, 700)).all()
        assert len(X.string_hashes(body[:n - 1], n)) == 0


# -------------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, sf_small, none):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = store(stage(spark, docs, sf_small), name)
        if i < 4:
            assert out.columns == docs.columns
            if i < 3:
                assert 0 < out.count() < n
            n, docs = out.count(), out
        assert stage(spark, none.select(*docs.columns), sf_small).count() == 0
    assert out.count() == n and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_seeds_carry_no_words_of_their_items(spark, make):
    rnd = random.Random(6)
    items = [prose(rnd, 2000, 50000) for _ in range(10)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    seeds = B.item_seeds(B.benchmark_items(bench))
    assert seeds.count() > 50_000 and sum({"bigint": 8, "int": 4}[t] for _, t in seeds.dtypes) <= 24
    docs = make([(i, " ".join(prose(rnd, 20) + w[700:760] + prose(rnd, 20)), "a") for i, w in enumerate(items)])
    assert {(r["doc_id"], r["item_id"]) for r in B.leaks(docs, bench).collect()} == {(i, i) for i in range(10)}


def test_words_of_a_document_are_made_once(spark, make):
    rnd = random.Random(7)
    items = [prose(rnd, n) for n in (2, 9, 40)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    docs = make([(i, " ".join(prose(rnd, 20) + w), "a") for i, w in enumerate(items)]
                + [(7, "alone", "a"), (8, "", "a"), (9, None, "a"), (10, " ".join(items[0]), "a")])
    found = B.leaks(docs, bench)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and "BroadcastHashJoin [_tw_hash" in plan
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 0), (1, 1), (2, 2), (10, 0)}


def test_a_hit_holds_words_of_its_item_and_not_the_document(spark, make):
    rnd = random.Random(8)
    items = [prose(rnd, n, 50000) for n in (5, 30)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    held = sum([prose(rnd, 300) + items[i % 2] for i in range(20)], [])
    hits = B._hits(make([(0, " ".join(held), "a")]), bench, [F.col("doc_id")])
    most, n = hits.select(F.max(F.size("_tw_h") - F.size("_tw_iw")), F.count("*")).first()
    assert n >= 10 * (5 - 3 + 30 - 4) and most == 2          # before: about 6,000 words a hit


def test_leaks_are_the_same_in_segments_of_any_length(spark, make, monkeypatch):
    rnd = random.Random(9)
    items = [prose(rnd, n, 60) for n in (2, 3, 4, 7, 20, 24, 26, 40)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    docs = [[]] + [prose(rnd, n, 60) for n in (1, 2, 3, 90)]
    for w in items:
        cut = rnd.randrange(len(w))
        docs += [w, w[:cut] + w[cut + 1:], w + prose(rnd, 9, 60), prose(rnd, 9, 60) + w,
                 prose(rnd, rnd.randrange(70), 60) + w[:cut] + ["new"] + w[cut:] + prose(rnd, rnd.randrange(70), 60)]
    docs = make([(i, " ".join(w), "a") for i, w in enumerate(docs)]).cache()

    def found():
        return sorted(map(tuple, B.leaks(docs, bench).collect()))
    whole = found()
    assert {(5 + 5 * i, i) for i in range(8)} <= {r[:2] for r in whole}
    monkeypatch.setattr(B, "SEGMENT", 3)
    assert found() == whole


def test_words_are_the_same_in_pieces_of_any_length(spark, make, monkeypatch):
    rnd = random.Random(10)
    marks = ["\n", "\r\n ", "-", "'", " … ", "😀", "\u2028", ""]
    texts = ["", " ", "a", "—" * 40, "İ" * 50 + "𐐀𐐁 猫が窓", "x" * 70 + " " + "é2" * 30, None]
    texts += ["".join(rnd.choice(["Wort", "two2", "ΟΔΟΣ", "猫が", "ก", "e\u0301", *marks]) for _ in range(200)) for _ in range(4)]
    docs = make([(i, t, "a") for i, t in enumerate(texts)])

    def words():
        return docs.select(B.norm_words(B.text_or_empty("text"))).collect()
    whole = words()
    assert len(whole[-1][0]) > 50 and whole[0][0] == []
    for piece in (1, 5):
        monkeypatch.setattr(B, "PIECE", piece)
        assert words() == whole


def test_unspaced_scripts_lie_in_the_range_tested_first(spark):
    scripts = "Han Hiragana Katakana Thai Lao Khmer Myanmar".split()
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    d = spark.createDataFrame([(every,)], "t string")
    plain = "[" + "".join(rf"\p{{Is{s}}}" for s in scripts) + "]"
    rest, same = d.select(*[F.regexp_replace("t", p, "") for p in (plain, B.UNSPACED)]).first()
    assert rest == same and len(rest) < len(every)
    assert B.UNSPACED.startswith(r"[\x{E01}-")
