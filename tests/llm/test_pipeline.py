"""The whole pipeline against a chain of plain-Python stages."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tidewell.llm import benchmark_decontamination as B
from tidewell.llm import quality_rules as Q
from tidewell.llm import source_mixing as M
from tidewell.llm import token_records as R

WORD = r"[^\x20\x09-\x0D]+"


def good(text):
    """The quality verdict by the rule table."""
    t = text or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = len({i + j for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for j in range(8)})
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_chars": len(t),
         "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_exclaim": t.count("!"),
         "n_upper": sum(unicodedata.category(c) == "Lu" for c in t), "n_stop": sum(x in Q.STOP_WORDS for x in w),
         "n_echo": sum(a == b for a, b in zip(w, w[1:])), "n_lines": len(lines),
         "n_dup_lines": len(lines) - len(set(lines)),
         "n_bullets": sum(x.strip(" \t\n\x0b\x0c\r")[0] in "-*•" for x in lines),
         "n_ellipses": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)}
    base = len(w) < 20 or 100 * again > 30 * len(w)
    broken = [name for name, num, den, low, high in Q.RULES
              if (low is not None and m[num] * 100 < m[den] * low) or (high is not None and m[num] * 100 > m[den] * high)]
    return not base and not broken


def first_of_groups(rows):
    def shingles(t):
        w = re.findall(WORD, re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)), key=lambda i: rows[i][0])
                root[y] = x
    return [r for i, r in enumerate(rows) if not sets[i] or find(i) == i]


def leaked(text, items):
    def words(t):
        return [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
    d = words(text or "")
    for w in map(words, items):
        n = len(w)

        def agree(s):
            return [0 <= s + i < len(d) and d[s + i] == w[i] for i in range(n)]
        for s in range(-n, len(d)):
            a = agree(s)
            if sum(a) * 100 >= n * B.MIN_MATCH and n > 1:
                return True
            if any(a[i] and a[i + B.RUN - 1] and sum(a[i:i + B.RUN]) * 100 >= B.RUN * B.MIN_MATCH
                   for i in range(n - B.RUN + 1)):
                return True
            if 2 < n <= 2 * B.RUN and sum(a):
                for shift in (1, -1):
                    b = agree(s + shift)
                    if any(max(sum(a[:i]) + sum(b[i:]), sum(b[:i]) + sum(a[i:])) * 100 >= n * B.MIN_MATCH
                           for i in range(n + 1)):
                        return True
    return False


def mixed(rows):
    size = {r[0]: len(re.findall(WORD, r[1] or "")) for r in rows}
    total = defaultdict(int)
    for i, _, source in rows:
        total[source] += size[i]
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight, left, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, float(sum(total.values())), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * total[s]]
        if not over:
            target = {**full, **share}
            break
        for s in over:
            full[s] = 3.0 * total[s]
            left -= full[s]

    def unit(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0
    out, salts = [], 16 + len(rows) // M.BLOCK_ROWS
    for s in names:
        def place(r):
            key = hashlib.md5(f"{r[0]}|{r[1] or ''}".encode()).hexdigest()
            return size[r[0]].bit_length() if size[r[0]] else 1, int(key[:7], 16) % salts, size[r[0]], key
        u = unit(M.SEED + ":" + ("t" if s is None else "s" + s))
        each = target[s] / total[s] if total[s] else 0.0
        for k, r in enumerate(sorted((r for r in rows if r[2] == s), key=place), 1):
            out += [r] * (math.floor(each * k + u) - math.floor(each * (k - 1) + u))
    return out


def records(rows):
    enc, at, out = R.PieceEncoder.of(R.tokenizer_path()), 0, []
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = enc.tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def fixture():
    rnd = random.Random(21)
    stop = ["the", "of", "and", "in", "is"]

    def prose(n):
        w = [rnd.choice(stop) if rnd.random() < 0.3 else f"{rnd.choice(['river', 'stone', 'lamp'])}{rnd.randrange(4000)}"
             for _ in range(n)]
        return " ".join(w) + "."
    items = [prose(n) for n in (40, 18, 9)]
    rows, sources = [], ["a", "b", "c", "dé", None]
    for i in range(150):
        text = prose(rnd.randrange(30, 160))
        if i % 9 == 0:
            text = prose(15) + " " + rnd.choice(items) + " " + prose(20)
        if i % 13 == 0:
            text = " ".join(f"w{k}$$$" for k in range(40))
        if i % 17 == 0:
            text = rnd.choice([None, "", "too short", "same words again " * 30])
        rows.append((i, text, rnd.choice(sources)))
    for i in range(150, 230):                       # copies and near copies of earlier texts
        w = (rows[rnd.randrange(150)][1] or "none at all").split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 30])):
            w[rnd.randrange(len(w))] = f"changed{rnd.randrange(9999)}"
        rows.append((i, " ".join(w), rnd.choice(sources)))
    return rows, items


def test_every_stage_equals_plain_python(spark, tmp_path):
    rows, items = fixture()
    schema = "doc_id bigint, text string, source string, lang string, n_chars bigint"
    spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in rows], schema) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [("quality_rules", [r for r in rows if good(r[1])])]
    want.append(("near_dedup", first_of_groups(want[-1][1])))
    want.append(("decontamination", [r for r in want[-1][1] if not leaked(r[1], items)]))
    want.append(("mixing", mixed(want[-1][1])))
    sizes = [len(x) for _, x in want]
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] > 50 and len(set(want[-1][1])) < sizes[3]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), (of, expected) in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, docs, str(tmp_path))
        assert name == of and out.columns == docs.columns
        got = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()]
        assert sorted(got, key=str) == sorted(expected, key=str), name
        docs = spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in expected], schema)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in final) == records(want[-1][1])
