"""Operators 1 and 5, and the pipeline's stages on odd inputs."""

import re
from collections import Counter, defaultdict

from tidewell.llm import quality_rules as Q
from tidewell.llm import source_mixing as M

WORD = r"[^\x20\x09-\x0D]+"


def repeat_words(w):
    wins = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    return len({i + j for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for j in range(8)})


def test_measures_match_plain_python(odd):
    rows = Q.judge(odd).select("doc_id", "text", "_tw_m", "_tw_keep", "_tw_base").collect()
    assert len(rows) == odd.count()
    for r in rows:
        t = r["text"] or ""
        w, m = re.findall(WORD, t), r["_tw_m"]
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        assert (m["n_words"], m["word_chars"]) == (len(w), sum(map(len, w)))
        assert m["n_dup_lines"] == len(lines) - len(set(lines))
        assert m["n_repeat_words"] == repeat_words(w)
        assert m["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["_tw_base"] == (len(w) < 20 or 100 * repeat_words(w) > 30 * len(w))


def test_rules_reject_junk_and_keep_prose(make):
    prose = " ".join(f"the river{i} of town{i} is near and cold." for i in range(30))
    docs = make([(1, prose, "a"), (2, " ".join(f"w{i}$$$ x{i}&&&" for i in range(40)), "a"),
                 (3, " | ".join(f"cell{i}" for i in range(60)), "a"),
                 (4, " ".join(f"LOUD{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(60)), "a")])
    assert [r["doc_id"] for r in Q.keep_good(docs).collect()] == [1]
    assert Q.keep_good(docs).columns == docs.columns


def test_empty_tables(none):
    assert Q.keep_good(none).count() == 0
    assert M.mix(none).count() == 0 and M.emit(none).count() == 0


def test_quality_plan_has_no_python_or_shuffle(odd):
    plan = Q.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def brute_targets(sizes):
    """Reshare the excess of full sources by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_mix_targets_and_copies(make, odd):
    import random
    rnd = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(int(rnd.paretovariate(1.1) * 5) % 400)),
             rnd.choice(["b", "b", "b", "a", "é", None, ""])) for i in range(1500)]
    got = M.mix(make(rows)).select("doc_id", "source", "_tw_size", "_tw_source_size", "_tw_target",
                                   "_tw_copies").collect()
    assert len(got) == 1500
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["_tw_size"]
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["_tw_source_size"] == sizes[r["source"]]
        assert abs(r["_tw_target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["_tw_copies"] <= 3
        taken[r["source"]] += r["_tw_copies"] * r["_tw_size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.06 * t, 800), (s, taken[s], t)
    assert M.mix(odd).count() == odd.count()
    assert M.emit(odd).columns == odd.columns
