"""Filter interaction audit, phrase collocations and quality rules, against plain versions."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.llm import collocations, filter_audit, quality

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def _texts(rng, n):
    words = ["a", "b", "The", "RE", "zoé", "x#", "y|z", "日本", " ", "do"]
    made = ["".join(rng.choice(words[: rng.randint(1, 10)]) + rng.choice(" \t\n\x0b  ") for _ in range(rng.choice([0, 1, 3, 49, 50, 60, 120]))) for _ in range(n // 2)]
    return made + [rng.choice([*made, None, "", "\n \n"]) for _ in range(n - len(made))]


def _plain_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    parts = {}
    for d, text, part in rows:
        t = text or ""
        w = SPACED.findall(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": any((u or "") == t and e is not None and (d is None or e < d) for e, u, _ in rows),
        }
        parts.setdefault(part or "", []).append((d, fails))
    out = []
    for part, docs in parts.items():
        total = Counter()
        here = []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                earlier = sum(x[1][f] for x in docs) - len(gone)
                left = [x for x in left if not x[1][f]]
                total[f] += len(gone)
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in docs)
                here.append([part, order, step, len(left), len(gone), earlier, alone, sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)])
        out += [(*r, total[r[1][r[2] - 1]]) for r in here]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_plain_filters(spark, seed, monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK", 40)
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, None, 7]), t, rng.choice(["p", "q", "q", None, "", "é"])) for i, t in enumerate(_texts(rng, 120))]
    labels = [(rng.choice([i, None]), rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60) for _ in range(rng.randint(1, 2))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, mask string, digest int")
    known = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert sorted(map(tuple, filter_audit.audit(docs, known).collect())) == _plain_audit(rows, [x for x in labels if x[0] is not None])
    assert filter_audit.audit(docs.where("false"), known).count() == 0
    assert filter_audit.audit(docs.limit(1), known.where("false")).count() == 600


def test_first_failures_of_all_orders():
    for mask in range(32):
        for o, order in enumerate(filter_audit.ORDERS):
            steps = [i for i, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
            assert filter_audit.FIRST[mask, o] == (steps[0] if steps else 5)


def test_many_parts_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", 3)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.when(F.col("id") == 3, F.repeat(F.lit("word "), 700_000)).otherwise(F.lit("a")).alias("text"))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).where("filter_order = 'BAECD' and step = 1").orderBy(F.col("part").cast("int")).collect()
    assert [r["removed"] for r in got] == [int(i == 3) for i in range(40)]
    got = filter_audit.audit(docs, labels).where("filter_order = 'ABECD' and step = 1").orderBy(F.col("part").cast("int")).collect()
    assert [(r["removed"], r["good_lost"]) for r in got] == [(int(i != 3), int(i == 0)) for i in range(40)]


def _plain_collocations(rows, longest=3, least=10, cover=50, top=2000):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f = Counter()
        for name, text in rows:
            if (name or "und") == lang:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        rows_ = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * c >= cover * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, c in found.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows_.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "longest", "least", "cover"), [(1, 3, 10, 50), (2, 4, 3, 70), (3, 2, 2, 50)])
def test_collocations_equal_a_plain_count(spark, seed, longest, least, cover, monkeypatch):
    monkeypatch.setattr(collocations, "WORDS", 300)
    monkeypatch.setattr(collocations, "PIECES", 40)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 500)
    rng = random.Random(seed)
    words = ["The", "the", "zoé", "ZOÉ", " x", "日本", "a", "b", "c"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", "  ", ", ", ".", "\n", "!\r\n", " \x0b"]) for _ in range(rng.choice([0, 1, 2, 40, 90])))
    rows = [(rng.choice(["en", "fr", None, "und"]), rng.choice([text(), None, ""])) for _ in range(60)]
    rows += rows[:10]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, text string, n int, piece string")
    got = collocations.collocations(docs, longest, least, cover, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _plain_collocations(rows, longest, least, cover, 25)


def test_collocation_edges(spark):
    docs = spark.createDataFrame([("en", None), ("en", ""), (None, "!!! \t\n"), ("en", "one")], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.where("false")).count() == 0
    rows = [("en", "a b " * 300_000), (None, "b " * 10), ("und", "B " * 2)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(map(tuple, got.collect())) == _plain_collocations(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**14 + 7, 10**14 + 7, 10**14 + 9), (3, 3, 3), (10**15 - 1, 10**15 - 1, 10**15 - 1), (10, 10**17, 10**17)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", F.expr(collocations._SCORE).alias("s")).collect()
    assert [r["s"] for r in got] == [1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got]


def test_buckets_follow_the_words():
    import pyarrow as pa

    one = collocations.grams(pa.array(["en"]), pa.array([b"x a b c"]), pa.array([2]), 3, 97)
    two = collocations.grams(pa.array(["fr", "en"]), pa.array([b"zz", b"a b c a b"]), pa.array([1, 5]), 3, 97)
    seen = dict(zip(one["gram"].to_pylist(), one["bucket"].to_pylist(), strict=True))
    assert {g: b for g, b in zip(two["gram"].to_pylist(), two["bucket"].to_pylist(), strict=True) if g in seen}.items() <= seen.items()
    assert dict(zip(two["gram"].to_pylist(), two["n"].to_pylist(), strict=True))["a b"] == 10


def _plain_measures(text):
    t = text or ""
    w, lines = SPACED.findall(t), [x for x in t.split("\n") if SPACED.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered), sum(any(c.isalpha() for c in x) for x in w),
        sum("A" <= c <= "Z" for c in t), sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines), sum(x.rstrip(" ").endswith(("...", "…")) for x in lines),
    )


def test_measures_equal_plain_counts(spark, monkeypatch):
    rng = random.Random(5)
    signs = ["a", "B", "- x", "* ", "...", "…", "<b>", "$5", "12", "zoé", "日本", " "]
    text = lambda: "".join(rng.choice(signs) + rng.choice([" ", "\n", "\t", " \x0c", "\r\n", ""]) for _ in range(rng.choice([0, 1, 2, 3, 8, 60, 300])))
    texts = [text() for _ in range(300)] + [None, "", " ", "\n\n", "a b c", "a a a a", "w " * 50_000]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, failures string, w int")
    want = [(i, 5, *_plain_measures(t)) for i, t in enumerate(texts)]
    found = quality.measured(docs)
    assert found.columns == ["doc_id", "w", *quality.MEASURES]
    assert sorted(map(tuple, found.collect())) == want
    # where half-hashes meet by chance, the words decide
    monkeypatch.setattr(quality, "windows_hash", lambda words, i: F.xxhash64(F.get(words, i)) % 3)
    assert sorted(map(tuple, quality.measured(docs).collect())) == want


def _fails(m):
    n_words, chars, symbols, lines, dup, repeat, lettered, upper, bullets, dots = m
    return [
        n_words < 50, 100 * repeat > 50 * n_words, chars < 3 * n_words or chars > 10 * n_words, 10 * symbols > n_words, 100 * dup > 30 * lines,
        100 * lettered < 80 * n_words, 100 * upper > 30 * chars, 100 * bullets > 90 * lines, 100 * dots > 30 * lines,
    ]


def test_ledger_policies_and_ablations(spark):
    rng = random.Random(9)
    texts = _texts(rng, 200) + [None]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = quality.ledger(docs).cache()
    fails = [_fails(_plain_measures(t)) for t in texts]
    assert [r["failures"] for r in found.orderBy("doc_id").collect()] == [sum(1 << i for i, x in enumerate(f) if x) for f in fails]
    assert fails[-1] == [True] + [False] * 8
    loose = quality.Policy("loose-2", ("short", "symbols", "upper_case"), tolerated=1)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(found, [quality.BASE, quality.PROSE, loose]).collect()}
    places = [0, 3, 6]
    assert kept == {i: {"base-1": not (f[0] or f[1]), "prose-1": not any(f), "loose-2": sum(f[k] for k in places) <= 1} for i, f in enumerate(fails)}
    got = {r["rule"]: tuple(r)[1:] for r in quality.ablations(found, loose).collect()}
    for name, k in zip(loose.rules, places, strict=True):
        n = [sum(f[j] for j in places) for f in fails]
        without = [c - f[k] <= 1 for c, f in zip(n, fails, strict=True)]
        assert got[name] == (len(texts), sum(c <= 1 for c in n), sum(f[k] for f in fails), sum(w and c > 1 for w, c in zip(without, n, strict=True)), sum(without))
    by = quality.ablations(found, loose, by=("source",)).groupBy("rule").agg(F.sum("failing").alias("n")).collect()
    assert {r["rule"]: r["n"] for r in by} == {k: v[2] for k, v in got.items()}
    assert {tuple(r) for r in quality.ablations(found.where("false"), quality.BASE).collect()} == {("short", 0, 0, 0, 0, 0), ("repeated_windows", 0, 0, 0, 0, 0)}
    sums = np.array([[sum(1 << i for i, x in enumerate(f) if x) for f in fails[k::2]] for k in (0, 1)], dtype=object)
    folded = {r["source"]: (r["fails_somewhere"], r["fails_everywhere"]) for r in quality.profile(found, "source").collect()}
    assert folded == {"ab"[k]: (int(np.bitwise_or.reduce(sums[k])), int(np.bitwise_and.reduce(sums[k]))) for k in (0, 1)}
    with pytest.raises(ValueError, match="unknown"):
        quality.passes(quality.Policy("x", ("nothing",)))
    with pytest.raises(ValueError, match="63"):
        quality.ledger(docs, rules=quality.RULES * 8)
