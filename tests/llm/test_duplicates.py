"""Fingerprints, Jaccard join, line dedup and decontamination against plain versions."""

import hashlib
import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.llm import components as components_module
from grovekit.llm import dealing, decontaminate, jaccard_join, line_dedup, minhash, scratch
from grovekit.llm.components import components
from grovekit.llm.rtree import GROUPS, CountTree, coarse, count_vector, packed, unpacked

WORDS = [f"w{i}" for i in range(400)]


def _shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def _corpus(seed, n=60):
    """Texts with exact copies, near copies around the threshold, shared passages, short texts."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    texts = []
    for _ in range(n):
        kind = rng.random()
        base = rng.choice(texts) if texts else ""
        if kind < 0.35 or not texts:
            texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 3, 4, 7, 9, 12, 30, 90, 200)))))
        elif kind < 0.45:
            texts.append(base.upper())
        elif kind < 0.85:
            w = base.split()
            for _ in range(rng.choice((1, 1, 1, 2, 3))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
        else:
            texts.append(passage + " " + " ".join(rng.choice(WORDS) for _ in range(rng.choice((3, 10, 40)))))
    return texts


def _components(ids, sets, percent):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("words", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 85, 3)])
def test_jaccard_join_equals_all_pairs(spark, words, percent, seed):
    texts = _corpus(seed, 150)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    sets = {i: _shingles(t, words) for i, t, _ in rows}
    want = _components(list(sets), sets, percent)
    got = jaccard_join.join(df, words, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    kept = jaccard_join.one_of_each(df, words, percent)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c) and kept.columns == df.columns


def test_every_link_shares_a_signature():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        for n in [*range(1, 40), 100, 317]:
            a = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for _ in range(4):  # as different as a link allows
                drop = int(rng.integers(0, n + 1))
                b = np.unique(np.concatenate([a[rng.permutation(n)[: n - drop]], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 2)).astype(np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if 100 * shared >= percent * (n + len(b) - shared) and (n != len(b) or (a != b).any()):
                    assert len(np.intersect1d(jaccard_join.signatures(a, percent), jaccard_join.signatures(b, percent)))


def test_fallback_signatures_link_too():
    """Sets that fill no more groups than they may differ in: their least shingles stand in, and link them."""
    rng = np.random.default_rng(1)
    _, hi = next(iter(jaccard_join.tiers(90, 80)))
    d = jaccard_join.largest_difference(2 * hi, 80)
    groups = d + 3 + d // 12
    found = 0
    for tier, top in jaccard_join.tiers(90, 80):
        if top != hi:
            continue
        seed = np.uint64((tier + 1) * 0x8CB92BA72F3D8DD7 & 0xFFFFFFFFFFFFFFFF)
        for _ in range(30):
            # shingles of few groups only
            pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
            some = np.sort(pool[jaccard_join.mix(pool ^ seed) % np.uint64(groups) < np.uint64(d - 2)][:94])
            a, b = some[:90], np.sort(np.append(some[2:90], some[90:92]))
            stand_ins = jaccard_join.mix(a[: d + 1] * np.uint64(0xD1342543DE82EF95) ^ seed)
            sig = [jaccard_join.signatures(x, 80) for x in (a, b)]
            found += bool(np.isin(stand_ins, sig[0]).all())
            assert len(np.intersect1d(sig[0], sig[1]))
            # and where they alone are compared
            theirs = jaccard_join.mix(b[: d + 1] * np.uint64(0xD1342543DE82EF95) ^ seed)
            assert len(np.intersect1d(stand_ins, theirs)) and np.isin(theirs, sig[1]).all()
    assert found == 30


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 200):
        p = rng.poisson(2, (n, GROUPS)).astype(np.int32)
        p[1::3] = p[: len(p[1::3])]
        tree, size = CountTree(p), p.sum(1)
        want = {(i, j) for i, j in itertools.combinations(range(n), 2) if 185 * np.minimum(p[i], p[j]).sum() >= 85 * (size[i] + size[j])}
        got = [tuple(sorted(x)) for i, j, _ in tree.join(tree, 85, 100) for x in zip(i.tolist(), j.tolist(), strict=True)]
        assert set(got) == want and len(got) == len(want)


def test_finer_groups_of_large_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)) for n in (3000, 3100, 2900, 40, 700, 20_000)]
    sets += [np.unique(np.concatenate([sets[0][300:], sets[1][:280]])), sets[5][500:]]
    points = unpacked([packed(count_vector(x)) for x in sets])
    assert all((p == count_vector(x)).all() and (coarse(p) == coarse(count_vector(x))).all() for p, x in zip(points, sets, strict=True))
    tree = CountTree(points)
    got = {tuple(sorted(x)) for i, j, _ in tree.join(tree, 80, 100) for x in zip(i.tolist(), j.tolist(), strict=True)}
    like = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))}
    assert got == like == {(0, 6), (5, 7)}  # unrelated large sets are ruled out
    assert set(tree.search(points[0], 80, 100).tolist()) == {0, 6}


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "ONE two"), (7, "a b c d e f g h " * 20_000), (None, "one two"), (7, "a b c d e f g h " * 20_000)]


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in EDGES], "doc_id long, text string, node int")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df, 4, 85).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 4), (None, 1, 4), (7, 8, 7), (7, 8, 7)], key=str)
    assert jaccard_join.join(df.where("false")).count() == 0
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(df, 4, 85).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 4, 7]  # the row without doc_id is a copy of row 4


def test_one_id_with_several_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, "p"), (7, a, "q"), (7, b, "r"), (9, c, "s"), (9, d, "t"), (9, d, "t"), (8, d, "u"), (2, None, "v"), (2, None, "w"), (2, "", "x"), (3, b + " x", "y"), (3, c, "z"), (3, c, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k string").repartition(5)
    kept = sorted(map(tuple, jaccard_join.one_of_each(df, 5, 80).collect()), key=str)
    twice = [r for r in kept if r[:2] == (3, c)]
    assert len(twice) == 1 and twice[0][2] in "za"
    assert [r for r in kept if r[:2] != (3, c)] == sorted([(1, a, "p"), (3, b + " x", "y"), (8, d, "u"), (2, None, "v"), (2, None, "w"), (2, "", "x")], key=str)


def test_rows_without_doc_id_link(spark):
    words = [f"w{i}" for i in range(120)]
    near = lambda n: " ".join(words[n:] + [f"x{i}" for i in range(n)])
    a, b, c = near(0), near(6), near(12)
    sets = [_shingles(t, 4) for t in (a, b, c)]
    like = lambda x, y: 100 * len(x & y) / len(x | y)
    assert like(sets[0], sets[1]) >= 85 and like(sets[1], sets[2]) >= 85 and like(sets[0], sets[2]) < 85
    rows = [(1, a), (None, b), (3, c), (None, "p q r s t u v w"), (None, "p q r s t u v w"), (None, "P q r s t u v w"), (None, None), (None, ""), (None, "alone it is here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.join(df, 4, 85).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (3, 1), *[(None, None)] * 6], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df, 4, 85).collect()), key=str)
    assert len(kept) == 5 and (1, a) in kept and (None, None) in kept and (None, "") in kept and (None, "alone it is here") in kept
    assert {t.lower() for _, t in kept if t} >= {"p q r s t u v w"}


def test_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 4)  # many tiles
    monkeypatch.setattr(jaccard_join, "SIGNATURES", 50)  # buckets settled in several steps
    monkeypatch.setattr(dealing, "SALT", 2)
    texts = _corpus(7, 120)
    base = " ".join(random.Random(1).choice(WORDS) for _ in range(100)).split()
    for i in range(30):  # one group around the threshold
        w = list(base)
        for at in range(i % 10):
            w[at * 9] = f"new{i}"
        texts.append(" ".join(w))
    sets = {i: _shingles(t, 5) for i, t in enumerate(texts)}
    linked = {i: 0 for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            linked[a] += 1
            linked[b] += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = jaccard_join.links(df, 5, 80).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == linked and max(linked.values()) > 5
    assert all(r["class_id"] == min(i for i, s in sets.items() if s == sets[r["doc_id"]]) for r in got if sets[r["doc_id"]])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(df, 5, 80).collect()} == _components(list(sets), sets, 80)


def test_packed_signatures():
    rng = np.random.default_rng(3)
    sig, node = rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.repeat(rng.integers(-(1 << 62), 1 << 62, 50), 100)
    got = set()
    for bucket, *blobs in jaccard_join.pack(sig, node, 7).itertuples(index=False):
        low, own = jaccard_join.unpack(*blobs)
        got |= {(bucket, x, y) for x, y in zip(low.tolist(), own.tolist(), strict=True)}
    assert got == {(x % 7, x // 7 % (1 << 40), y) for x, y in zip(sig.tolist(), node.tolist(), strict=True)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_components_are_not_run_again_when_settled(spark, monkeypatch):
    made, settle = [], scratch.settle
    monkeypatch.setattr(scratch, "settle", lambda df, name: made.append(name) or settle(df, name))
    stars = spark.createDataFrame([(10 * i, 10 * i + j) for i in range(5) for j in range(1, 6)], "u long, v long")
    assert components(stars).count() == 30 and made == ["edges"]


@pytest.mark.parametrize("few", [0, 10**6])
def test_few_pairs_join_as_many(spark, monkeypatch, few):
    made, settle = [], scratch.settle
    monkeypatch.setattr(scratch, "settle", lambda df, name: made.append(name) or settle(df, name))
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(components_module, "FEW", few)
    monkeypatch.setattr(dealing, "SALT", 3)
    texts = _corpus(4, 120)
    df = spark.createDataFrame([(i % 110, t) for i, t in enumerate(texts)] + [(None, texts[5]), (7, texts[7])], "doc_id long, text string")
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: _shingles(t, 5) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(plain, 5, 80).collect()} == _components(list(sets), sets, 80)
    assert "texts" not in made  # the classes' texts are read from the input once
    linked = {i: sum(1 for j in sets if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join.links(plain, 5, 80).collect()} == linked
    assert jaccard_join.join(df, 5, 80).count() == 122


@pytest.mark.parametrize("few", [0, 10**6])
def test_texts_of_unlike_classes_are_not_stored(spark, monkeypatch, tmp_path, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    written, settle = [], scratch.settle

    def measured(df, name):
        made, path = settle(df, name)
        written.append(sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet")))
        return made, path

    rng = random.Random(6)
    texts = [" ".join(f"{rng.getrandbits(48):012x}" for _ in range(1000)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(scratch, "settle", measured)
    one_block = lambda tokens, percent: np.array([7], np.uint64)
    rows = jaccard_join.join(spark.read.parquet(f"{tmp_path}/docs"), 5, 80, sign_set=one_block).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i for i in range(40)}
    assert 0 < sum(written) < sum(map(len, texts)) / 4


def test_repeated_rows_without_doc_id_send_one_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    rng = random.Random(7)
    text = [rng.choice(WORDS) for _ in range(100)]
    near = [" ".join([*text[:99], f"x{i}"]) for i in range(3)]
    df = spark.createDataFrame([(None, near[0])] * 50 + [(5, near[1]), (4, near[2])], "doc_id long, text string")
    sent, verified = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, texts, *rest: sent.append(texts.count()) or verified(pairs, texts, *rest))
    assert {r["component_id"] for r in jaccard_join.join(df, 5, 80).collect()} == {4}
    assert sent == [3]


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(10**6), " ".join(rng.choice(WORDS) for _ in range(rng.choice((0, 1, 4, 30, 200))))) for _ in range(80)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(10**7, None), (-5, "é " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(4)
    got = {r["doc_id"]: r for r in minhash.edited(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        new = t[: len(t) - cut] + nxt[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        for name, other in (("near_edited", new), ("near_next", nxt)):
            a, b = _shingles(t, 5), _shingles(other, 5)
            assert got[i][name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.25)


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in EDGES], "doc_id long, text string")
    got = minhash.edited(df).collect()
    assert len(got) == len(EDGES)
    same = {r["doc_id"]: r["fingerprint"] for r in got}
    assert same[1] == same[2] == same[3] and same[4] == same[5] == same[6] == same[None] != same[1]
    one = minhash.edited(df.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0
    assert minhash.edited(df.where("false")).count() == 0
    texts = _corpus(9, 80)
    classes = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = {i: _shingles(t, 5) for i, t in enumerate(texts)}
    by = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[a] == sets[b]:
            assert by[a] == by[b]
        if by[a] == by[b]:
            assert sets[a] & sets[b]
    assert {r["fp"] for r in df.where("doc_id = 1").select(minhash.fingerprint(F.col("text")).alias("fp")).collect()} == {same[1]}


def test_near_duplicates_around_the_threshold(spark):
    """Links between two members of a bucket that don't link with its leader count too."""
    rng = random.Random(8)
    base, texts = [f"x{i}" for i in range(204)], []
    for _ in range(150):
        w = list(base)
        for at in rng.sample(range(0, 204, 12), rng.randint(3, 4)):  # each edit changes five shingles of 200
            w[at] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    sets = {i: _shingles(t, 5) for i, t in enumerate(texts)}
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == _components(list(sets), sets, 80)


def test_patience():
    a, b = np.array([1, 2, 3, 9, 4, 5, 1]), np.array([7, 1, 2, 3, 4, 5, 8, 1])
    blocks = line_dedup.patience(a, b)
    assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in blocks)
    assert sum(n for _, _, n in blocks) == 6
    assert line_dedup.patience(a, a) == [(0, 0, 7)]
    assert line_dedup.patience(a, a[:0]) == []


def test_longest_common(monkeypatch):
    rng = random.Random(4)
    for bits in (1 << 27, 8):
        monkeypatch.setattr(line_dedup, "TABLE_BITS", bits)
        for _ in range(200):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in "ab")
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, j in itertools.product(range(len(a)), range(len(b))):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            got = line_dedup.longest_common(a, b)
            assert all(a[i] == b[j] for i, j in got) and len(got) == best[-1][-1]
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))


def test_repeated_lines_go(spark):
    x, y, z = ("the shared line number %d here" % i for i in range(3))
    own = ["an own line of text %d" % i for i in range(9)]
    cases = [  # the owner's lines, the later document's, and the places that go
        ([own[0], x, own[1]], [own[2], x, own[3], x, own[4]], [1, 3]),
        ([own[0], x, own[1], x, own[2]], [own[3], x, own[4]], [1]),
        ([own[0], x, own[1], x, own[2]], [own[3], x, own[4], x, own[5], x, own[6]], [1, 3, 5]),
        ([own[0], "", x, x, "", own[1]], [own[2], x, "", "", "", x, own[3]], [1, 5]),
        ([own[0], "so", "so", x, x, own[1]], [own[2], x, x, "so", "so", own[3]], [1, 2]),
        ([own[0], "a b c", "d e f", own[1]], [own[2], "a b c", "d e f", own[3], "a b c", "d e f", own[4], "d e f", own[5]], [1, 2, 4, 5]),
        ([own[0], x, y, own[1]], [own[2], y, own[3], x, own[4]], [1, 3]),  # another order
        ([own[0], z, own[1]], [own[2], "", own[3]], []),
    ]
    code = {s: i for i, s in enumerate(sorted({s for a, b, _ in cases for s in (*a, *b)}))}
    rows = []
    for n, (owner, later, want) in enumerate(cases):
        a, b = (np.array([code[s] for s in side]) for side in (later, owner))
        gone = line_dedup.removed_lines(a, np.array([len(s.split()) for s in later]), [b], 5).tolist()
        assert gone == want, n
        rows += [(2 * n, "\n".join(f"{n} {s}" if s in (x, y, z) or s in own else s for s in owner)), (2 * n + 1, "\n".join(f"{n} {s} " if s in (x, y, z) else f"{n} later {s}" if s in own else s for s in later))]
    df = spark.createDataFrame(rows[:8], "doc_id long, text string")
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.dedupe(df).collect()}
    assert [got[2 * n + 1] for n in range(4)] == [want for *_, want in cases[:4]] and not any(got[2 * n] for n in range(4))


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_plain_search(spark, seed):
    """Random documents with repeated, crossing, short and blank lines, against all earlier documents' runs."""
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 1, 2, 3, 5, 8)))) for _ in range(60)] + ["", "  "]
    docs: list[tuple[int, list[str]]] = []
    for i in range(120):
        kind = rng.random()
        if kind < 0.5 or not docs:
            got = [rng.choice(lines) if rng.random() < 0.5 else f"own {i} {n} line of text" for n in range(rng.randint(1, 14))]
        elif kind < 0.8:  # blocks of another document, in another order, some twice
            base = rng.choice(docs)[1]
            cut = rng.randint(0, len(base))
            got = base[cut:] + base[:cut] + base[: rng.randint(0, 3)]
        else:
            got = list(rng.choice(docs)[1])
        docs.append((i, got))
    code: dict[str, int] = {}
    plain = [(i, [code.setdefault(" ".join(x.split()), len(code)) for x in d], [len(x.split()) for x in d]) for i, d in docs]

    def runs(seq, words):
        return {tuple(seq[a:b]) for a in range(len(seq)) for b in range(a + 1, len(seq) + 1) if sum(words[a:b]) >= 5}

    want, seen = {}, set()
    for i, seq, words in plain:  # all runs of five words or more that an earlier document holds
        gone = {p for a in range(len(seq)) for b in range(a + 1, len(seq) + 1) if sum(words[a:b]) >= 5 and tuple(seq[a:b]) in seen for p in range(a, b) if words[p]}
        want[i] = gone
        seen |= runs(seq, words)
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in docs], "doc_id long, text string").repartition(3)
    for r in line_dedup.dedupe(df).collect():
        i, d = docs[r["doc_id"]]
        removed = list(r["removed"])
        assert {p for p in removed if d[p].split()} == want[i], (i, removed)
        assert r["text"] == "\n".join(x for p, x in enumerate(d) if p not in removed)


def test_line_dedup(spark):
    p = ["this is line %d of a shared passage" % i for i in range(4)]
    rows = [
        (1, "\n".join(["first own line of text here", *p, "end one two three four"]), "a"),
        (2, "\n".join([*p, "second has its own line here"]), None),
        (3, "\n".join(["no shared line at all here", "short"]), "c"),
        (4, "\n".join(p), "d"),
        (5, "short\nshort", "e"), (6, None, "f"), (7, "", "g"), (None, "\n".join(p), "h"),
        (8, "\n".join(f"unique long line number {i} here" for i in range(20_000)), "i"),
        (4, "\n".join(p), "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, r string")
    out = line_dedup.dedupe(df)
    assert out.columns == ["doc_id", "text", "r", "n_lines", "removed"]
    got = {(r["doc_id"], r["r"]): r for r in out.collect()}
    assert got[1, "a"]["text"] == rows[0][1] and got[2, None]["text"] == "second has its own line here" and list(got[2, None]["removed"]) == [0, 1, 2, 3]
    assert got[4, "d"]["text"] == "" and got[None, "h"]["text"] == rows[7][1]
    for i, r in ((3, "c"), (5, "e"), (6, "f"), (7, "g"), (8, "i")):
        assert got[i, r]["text"] == next(x[1] for x in rows if x[0] == i) and not got[i, r]["removed"]
    assert out.count() == len(rows)
    assert line_dedup.dedupe(df.where("false")).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(1, prose(40)), (2, prose(25)), (3, "tiny"), (4, None), (5, prose(6))]
    edited = list(items[0][1])
    for at in range(20, len(edited), 40):
        edited[at] = "X"
    rows = [
        (10, prose(50) + " " + items[0][1] + " " + prose(50)), (11, prose(20) + " " + "".join(edited) + " " + prose(9)), (12, prose(300)), (13, None), (14, ""),
        (15, items[1][1].upper().replace(" ", "\n -- ")), (16, prose(60_000) + items[4][1]), (17, "tiny"), (17, "tiny"), (18, items[0][1][:60]), (19, items[0][1][7:47]),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(10, 1), (11, 1), (15, 2), (16, 5), (17, 3), (18, 1)}
    r = next(r for r in hits if r["doc_id"] == 10)
    assert rows[0][1][r["doc_start"] : r["doc_end"]].strip() == items[0][1] and r["edits"] == 0
    kept = decontaminate.clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 13, 14, 19] and kept.columns == docs.columns
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.leaks(docs.where("false"), bench).count() == 0


def _edits(window, text):
    """Least edits of the window against any part of the text: the whole table, a row at a time."""
    text, step = np.array(text), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for i, x in enumerate(window):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (text != x), row[1:] + 1)])
        row = np.minimum.accumulate(new - step) + step
    return row.min()


def test_decontamination_equals_full_alignment():
    """Every window against every text by the whole table of edits; texts and items over few letters, so that q-grams repeat."""
    rng = random.Random(11)
    prose = lambda n, letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    items = [(i, prose(rng.choice((1, 1, 2, 8, 20, 45)), "abcd")) for i in range(14)] + [(20, "ab " * 30), (21, None), (22, "...")]
    texts = ["ab " * 400, "", None, "ab"]
    for _ in range(60):
        part = list(rng.choice(items[:14])[1])
        part = part[rng.randint(0, len(part) // 3) :] if rng.random() < 0.3 else part
        for _ in range(rng.randint(0, 1 + len(part) // 9)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice(["", "x", part[at] + "y"])
        texts.append(prose(rng.randint(0, 12), "abcd") + " " + "".join(part) + rng.choice(["", ", "]) + prose(rng.randint(0, 12), "efg"))
    index = decontaminate.build_index(items)
    want = [set() for _ in texts]
    for t, text in enumerate(texts):
        points = decontaminate.normalise(text or "")[0]
        plain = "".join(map(chr, points))
        for w, window in enumerate(index.windows):
            if len(window) < decontaminate.LEAST:
                hit = f" {''.join(map(chr, window))} " in f" {plain} "
            else:
                hit = len(points) and _edits(window.tolist(), points.tolist()) <= index.edits[w]
            if hit:
                want[t].add(index.items[index.item_of[w]])
    got = [{h[0] for h in hits} for hits in index.search(iter(texts))]
    assert got == want and sum(map(len, want)) > 60


def test_short_quotes_are_found_wherever_they_start():
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    items = [(i, prose(rng.randint(30, 80))) for i in range(20)]
    index = decontaminate.build_index(items)
    texts, want = [], []
    for n in (59, 60, 66, 80, 99, 110, 120, 130):
        for i, item in items:
            for at in (0, len(item) - n, *(rng.randint(0, len(item) - n) for _ in range(4))):
                quote = item[at : at + n].strip()
                if len(quote) == n:
                    texts.append(f"{prose(20)} {quote} {prose(20)}")
                    want.append({i})
    assert [{h[0] for h in hits} for hits in index.search(iter(texts))] == want and len(texts) > 600
    others = [prose(200) for _ in range(50)] + [f"{prose(20)} {item[40:75]} {prose(20)}" for _, item in items]  # 35 characters are no leak
    assert not any(index.search(iter(others)))


def test_decontamination_of_texts_that_repeat_themselves(monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS", 1000)
    index = decontaminate.build_index([(1, "ab " * 60), (2, "a " * 80), (3, "ab")])
    (hits,) = index.search(iter(["ab " * 20_000]))
    assert {h[0] for h in hits} == {1, 3}


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    items = [(i, prose(30)) for i in range(12)]
    docs = spark.createDataFrame([(i, prose(20) + " " + (items[i][1] if i % 2 else prose(30))) for i in range(12)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(i, i) for i in range(1, 12, 2)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(0, 12, 2))


def test_banded_distance_equals_the_full_table():
    def full(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(3)
    for _ in range(60):
        w, t = ([rng.randrange(3) for _ in range(n)] for n in (10, 25))
        m, n = len(w), len(t)
        padded = np.full((1, 2 * m + n + 1), 99, np.uint32)
        padded[0, m : m + n] = t
        edits, start, end = decontaminate.banded_distances(np.array([w], np.uint32), padded, np.array([m]), np.array([m + n]))
        assert edits[0] == full(w, t)
        a, b = int(start[0]) - m, int(end[0]) - m
        assert 0 <= a <= b <= n and full(w, t[a:b]) == edits[0]
