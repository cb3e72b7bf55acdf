"""Contraction, jump pointers, neighbour graphs, bulk moves, batch insertion and clustering over links, against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.operators import batchwise, contraction, cut, evaluate, graph, hac, knn, moves, online, tree


def _table(spark, parents):
    return spark.createDataFrame(list(parents.items()), "node long, parent long")


def _points(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vec array<double>")


def _below(parents):
    kids = {}
    for x, p in parents.items():
        kids.setdefault(p, []).append(x)

    def below(x):
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            out.append(y)
            todo += kids.get(y, [])
        return out

    return below


def _path(parents, x):
    out = [x]
    while parents.get(out[-1]) is not None:
        out.append(parents[out[-1]])
    return out


def _leaf_sets(parents):
    """The tree as its sets of leaves."""
    inner = set(parents.values())
    below = _below(parents)
    return {frozenset(y for y in below(x) if y not in inner) for x in parents}


def _binary(rng, n, first=1000):
    """A random binary tree over leaves 0 .. n - 1."""
    tops, parents = list(range(n)), {}
    while len(tops) > 1:
        a, b = rng.sample(tops, 2)
        new = first + len(parents) // 2
        parents[a] = parents[b] = new
        tops = [x for x in tops if x not in (a, b)] + [new]
    parents[tops[0]] = None
    return parents


def _shapes():
    rng = random.Random(3)
    long = {0: None, **{i: rng.randrange(max(0, i - 3), i) for i in range(1, 30)}, 100: None, **{i: i - 1 for i in range(101, 112)}, 500: None}
    return [long, {0: None, **{i: 0 for i in range(1, 40)}}, _binary(rng, 20)]


@pytest.mark.parametrize("shape", [0, 1, 2])
def test_rollups_and_ancestors_equal_walks(spark, shape):
    rng = random.Random(shape)
    parents = _shapes()[shape]
    below, nodes = _below(parents), _table(spark, parents)
    values = [(x, rng.choice([None, rng.randint(1, 9)])) for x in parents for _ in range(rng.randint(0, 2))]
    given = spark.createDataFrame(values, "node long, v long")
    for how, fold in [("sum", sum), ("max", max), ("min", min)][: 1 if shape == 0 else 3]:
        got = {r["node"]: r["v"] for r in contraction.rollup(nodes, given, how).collect()}
        held = {x: [v for y in below(x) for z, v in values if z == y and v is not None] for x in parents}
        assert got == {x: fold(h) if h else None for x, h in held.items()}
    some = rng.sample(sorted(parents), 12)
    pairs = [(a, b) for a in some for b in some[:4]]
    want = []
    for a, b in set(pairs):
        up, other = _path(parents, a), set(_path(parents, b))
        met = next((x for x in up if x in other), None)
        if met is not None:
            want.append((a, b, met, up.index(met), _path(parents, b).index(met)))
    assert sorted(map(tuple, contraction.lca(spark.createDataFrame(pairs, "a long, b long"), nodes).collect())) == sorted(want)
    deep = {x: len(_path(parents, x)) - 1 for x in parents}
    assert {r["node"]: r["depth"] for r in contraction.depths(nodes).collect()} == deep
    assert {r["node"]: r["height"] for r in contraction.heights(nodes).collect()} == {x: max(deep[y] for y in below(x)) - deep[x] for x in parents}


def test_rollups_equal_the_closure(spark, monkeypatch):
    rng = np.random.default_rng(1)
    parents = _binary(random.Random(2), 30)
    labelled = spark.createDataFrame([(x, p, ["a", "b", None, "c"][x % 4] if x < 30 else None) for x, p in parents.items()], "node long, parent long, label string")
    anc, leaf = tree.closure(labelled), tree.leaves(labelled)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(tree.class_counts(anc, leaf))
    assert rows(contraction.class_counts(labelled, leaf)) == want
    monkeypatch.setattr(tree, "WIDE", 2)
    assert rows(contraction.class_counts(labelled, leaf)) == want
    monkeypatch.setattr(tree, "WIDE", 256)
    assert rows(contraction.leaf_counts(labelled)) == rows(tree.leaf_counts(anc, leaf))
    points = spark.createDataFrame([(i, rng.standard_normal(5).tolist()) for i in range(0, 30, 2)], "node long, vec array<double>")
    got, want = ({r["node"]: (r["n"], [*r["sum"], r["sumsq"]]) for r in df.collect()} for df in (contraction.stats(labelled, points), tree.stats(anc, points)))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1]) for k in got)
    assert contraction.leaf_counts(labelled.where("false")).count() == 0
    assert contraction.class_counts(labelled, leaf.where("label = 'z'")).count() == 0


def test_a_chain_of_a_hundred_thousand_nodes(spark):
    n = 100_000
    nodes = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = contraction.rollup(nodes, nodes.select("node", F.lit(1).cast("long").alias("v")))
    assert got.count() == n and got.where(F.col("v") != n - F.col("node")).count() == 0
    pairs = spark.createDataFrame([(99_999, 12_345), (7, 7), (0, 50_000)], "a long, b long")
    assert sorted(map(tuple, contraction.lca(pairs, nodes).collect())) == [(0, 50_000, 0, 0, 50_000), (7, 7, 7, 0, 0), (99_999, 12_345, 12_345, 87_654, 0)]


def test_graph_search_without_exact_search(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((600, 24))
    v[5] = v[6] = v[7]
    p = _points(spark, v)
    want = {(r["query"], r["neighbour"]) for r in knn.exact(p, p, 5).collect()}
    monkeypatch.setattr(knn, "exact", None)
    links = graph.descend(p).cache()
    near = knn.top_k(links, 5, "src", "score", "dst").collect()
    assert len({(r["src"], r["dst"]) for r in near} & want) >= 0.95 * len(want)
    thin = graph.navigable(links, p, 32)
    assert max(r["count"] for r in thin.groupBy("src").count().collect()) <= 32
    found = graph.beam(p, p, thin, 5).collect()
    assert len({(r["query"], r["neighbour"]) for r in found} & want) >= 0.95 * len(want)
    assert all(r["query"] != r["neighbour"] for r in found)
    barred = spark.createDataFrame(sorted(want)[:400], "query long, neighbour long")
    assert not {(r["query"], r["neighbour"]) for r in graph.beam(p, p, thin, 5, barred=barred).collect()} & set(sorted(want)[:400])


def test_graphs_of_few_points(spark):
    one = _points(spark, [[1.0, 2.0]])
    assert graph.descend(one).count() == 0 and graph.search(one, one, 3).count() == 0
    two = _points(spark, [[1.0, 2.0], [2.0, 1.0]])
    assert sorted((r["query"], r["neighbour"]) for r in graph.search(two, two, 3).collect()) == [(0, 1), (1, 0)]
    assert graph.descend(one.where("false")).count() == 0


def _move(parents, x, y):
    """One move on a plain tree."""
    up = parents[x]
    sib = next(z for z, p in parents.items() if p == up and z != x)
    out = {**parents, sib: parents[up]}
    return {**out, up: out[y], y: up}


@pytest.mark.parametrize("seed", [0])
def test_bulk_moves_equal_single_ones(spark, seed):
    rng = random.Random(seed)
    parents = _binary(rng, 120)
    nodes = _table(spark, parents)
    anc = tree.closure(nodes)
    every, below = sorted(parents), _below(parents)
    near = lambda x: rng.choice(below(_path(parents, x)[min(rng.randint(1, 4), len(_path(parents, x)) - 1)]))
    tried = [(x, near(x), round(rng.random(), 3)) for x in rng.choices(every, k=90)]
    taken = [tuple(r) for r in moves.independent(spark.createDataFrame(tried, "x long, y long, score double"), nodes, anc).collect()]
    assert len(taken) > 1
    got = {r["node"]: r["parent"] for r in moves.apply_moves(nodes, spark.createDataFrame(taken, "x long, y long, score double")).collect()}
    for order in (taken, taken[::-1]):
        plain = dict(parents)
        for x, y, _ in order:
            plain = _move(plain, x, y)
        assert plain == got
    assert tree.problems(_table(spark, got)).count() == 0
    swaps = [tuple(r) for r in moves.independent(spark.createDataFrame(tried, "x long, y long, score double"), nodes, anc, kin=False).collect()]
    got = {r["node"]: r["parent"] for r in moves.apply_swaps(nodes, spark.createDataFrame(swaps, "x long, y long, score double")).collect()}
    plain = dict(parents)
    for x, y, _ in swaps:
        plain[x], plain[y] = plain[y], plain[x]
    assert plain == got and len(swaps) > 1 and tree.problems(_table(spark, got)).count() == 0
    # the best of all that have a sense is always among those taken
    sense = {(x, y): s for x, y, s in tried if x not in _path(parents, y) and parents[x] is not None and parents[x] not in (parents[y], y)}
    x, y = min(sense, key=lambda m: (-sense[m], m))
    assert (x, y) in {t[:2] for t in taken}


def test_collapsing_in_bulk(spark):
    rng = np.random.default_rng(4)
    parents = _binary(random.Random(7), 24)
    vec = {i: rng.standard_normal(4) for i in range(24)}
    points = spark.createDataFrame([(i, v.tolist()) for i, v in vec.items()], "node long, vec array<double>")
    for bound, order in ((24, "lowest"), (9, "highest")):
        nodes, members = moves.collapse_to(_table(spark, parents), points, bound, order=order)
        held, tables = {i: [i] for i in range(24)}, dict(parents)
        while len(held) > bound:
            kids = {}
            for x, p in tables.items():
                kids.setdefault(p, []).append(x)
            flat = []
            for p, (a, *b) in kids.items():
                if p is not None and a in held and b[0] in held:
                    s, t = (sum(vec[i] for i in held[x]) for x in (a, b[0]))
                    flat.append((round(float(s @ t / np.sqrt((s @ s) * (t @ t))), 9) * (1 if order == "lowest" else -1), p))
            for _, p in sorted(flat)[: len(held) - bound]:
                held[p] = [i for x in kids[p] for i in held.pop(x)]
                for x in kids[p]:
                    del tables[x]
        assert {r["id"]: r["node"] for r in members.collect()} == {i: x for x, ids in held.items() for i in ids}
        assert {r["node"]: r["parent"] for r in nodes.collect()} == tables
    with pytest.raises(ValueError, match="one leaf"):
        moves.collapse_to(_table(spark, parents), points, 0)


def test_batches_of_separable_points(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([c + 0.05 * rng.standard_normal((3, 16)) for c in np.eye(16)[:3]])
    labels = np.repeat(np.arange(3), 3)
    order = rng.permutation(9)
    empty = spark.createDataFrame([], "node long, parent long")
    p = _points(spark, v[order])
    made = batchwise.insert(empty, spark.createDataFrame([], "node long, vec array<double>"), p, 1000)
    named = made.join(spark.createDataFrame([(i, str(labels[o])) for i, o in enumerate(order)], "node long, label string"), "node", "left").cache()
    assert named.count() == 17 and tree.problems(named).count() == 0
    purity = evaluate.dendrogram_purity_from(named, contraction.class_counts(named, tree.leaves(named))).first()[0]
    assert purity == pytest.approx(1)


@pytest.mark.parametrize("linkage", ["cosine", "average"])
def test_a_batch_of_one_is_an_insertion(spark, linkage):
    v = np.random.default_rng(3).standard_normal((24, 5))
    config = online.ClusterConfig(linkage=linkage, graft=False, restructure=False)
    rows = lambda ids: spark.createDataFrame([("all", str(i), None, v[i].tolist(), i) for i in ids], "block string, pid string, label string, vec array<double>, seq long")
    built = online.build(rows(range(23)), config, "block").cache()
    named = {r["node"]: int(r["pid"]) if r["pid"] is not None else 100 + r["node"] for r in built.collect()}
    nodes = {named[r["node"]]: None if r["parent"] is None else named[r["parent"]] for r in built.collect()}
    leaves = spark.createDataFrame([(i, v[i].tolist()) for i in range(23)], "node long, vec array<double>")
    got = batchwise.insert(_table(spark, nodes), leaves, _points(spark, v[23:], 23), 10_000, linkage)
    grown = online.extend(built, rows(range(23)), rows([23]), config).collect()
    names = {r["node"]: int(r["pid"]) if r["pid"] is not None else 100 + r["node"] for r in grown}
    assert _leaf_sets({r["node"]: r["parent"] for r in got.collect()}) == _leaf_sets({names[r["node"]]: None if r["parent"] is None else names[r["parent"]] for r in grown})


def _plain_over_links(links):
    """One merge at a time: the least mean distance over links, ties to the least pair of least leaves."""
    d = {}
    for a, b, x in links:
        if a != b:
            k = frozenset([frozenset([a]), frozenset([b])])
            d[k] = (min(x, d[k][0]) if k in d else x, 1)
    out = set()
    while d:
        a, b = min(d, key=lambda k: (round(d[k][0] / d[k][1], 12), sorted(min(x) for x in k)))
        out.add(a | b)
        new = {}
        for k, (t, n) in d.items():
            named = frozenset((a | b) if x in (a, b) else x for x in k)
            if len(named) == 2:
                s, m = new.get(named, (0.0, 0))
                new[named] = (s + t, m + n)
        d = new
    return out


def test_clustering_over_links(spark):
    v = np.random.default_rng(5).standard_normal((7, 4))
    every = [(i, j, float(((v[i] - v[j]) ** 2).sum())) for i, j in itertools.combinations(range(7), 2)]
    rng = random.Random(6)
    some = [(b, a, x) if rng.random() < 0.5 else (a, b, x) for a, b, x in every if x < 5 or (a + b) % 4 == 0]
    for links in (every, some + some[:5] + [(3, 3, 0.0)], [(0, 1, 1.0), (5, 6, 2.0)]):
        rows = hac.over_links(spark.createDataFrame(links, "src long, dst long, distance double")).collect()
        parents = {r["node"]: r["parent"] for r in rows}
        assert {s for s in _leaf_sets(parents) if len(s) > 1} == _plain_over_links(links)
        below = _below(parents)
        assert all(r["size"] == sum(x < 7 for x in below(r["node"])) for r in rows)
    merged = hac.chain(v)
    made = {i: frozenset([i]) for i in range(7)}
    for i, (a, b, _, _) in enumerate(merged):
        made[7 + i] = made[a] | made[b]
    assert _plain_over_links(every) == {s for s in made.values() if len(s) > 1}
    assert hac.over_links(spark.createDataFrame([], "src long, dst long, distance double")).count() == 0


def test_thresholds_are_the_best_runs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (7, 3), (11, 4), (9, 9)):
        x, w = np.sort(rng.standard_normal(n)), rng.integers(1, 5, n).astype(float)
        error = lambda starts: sum(float((w[a:b] * (x[a:b] - np.average(x[a:b], weights=w[a:b])) ** 2).sum()) for a, b in zip(starts, [*starts[1:], n], strict=True))  # noqa: B023, E731
        want = min(([0, *c] for c in itertools.combinations(range(1, n), k - 1)), key=error)
        assert error(cut.best_runs(x, w, k)) == pytest.approx(error(want), abs=1e-12)
    values = [*rng.normal(0, 0.1, 300), *rng.normal(3, 0.1, 200), *rng.normal(9, 0.1, 100)]
    scores = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "score double")
    whole = [r[0] for r in cut.clustered_thresholds(scores, 3).collect()]
    assert whole == pytest.approx([np.mean(values[:300]), np.mean(values[300:500]), np.mean(values[500:])])
    monkeypatch.setattr(cut, "CELLS", 60)
    assert [r[0] for r in cut.clustered_thresholds(scores, 3).collect()] == pytest.approx(whole, abs=0.1)
    assert cut.clustered_thresholds(scores.where("false"), 3).count() == 0
    assert cut.clustered_thresholds(spark.createDataFrame([(2.0,), (2.0,)], "score double"), 3).collect()[0][0] == 2.0


def test_guesses_at_sizes_stay_numbers_of_a_few_digits(spark):
    from grovekit.plans.session import checkpointed

    now = checkpointed(spark.range(8))
    for _ in range(6):  # eightfold the digits in each round before
        side = lambda i: now.select("id", F.col("id").alias(f"x{i}"))  # noqa: B023, E731
        now = checkpointed(side(0).join(side(1), "id").join(side(2), "id").join(side(3), "id").select("id"))
    assert now.count() == 8
    assert len(str(now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 25


def test_points_in_every_task_give_what_joins_give(spark, monkeypatch):
    from grovekit.plans.session import checkpointed

    rng = np.random.default_rng(12)
    p = checkpointed(spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)))], "id long, vec array<float>"))
    o = graph.SearchOptions(max_rounds=2, k=5, width=6, opened=4, max_degree=5, starts=2)
    told = lambda df: sorted(tuple(r) for r in df.collect())
    found = []
    for most in (graph.MOST_HELD, 0):
        monkeypatch.setattr(graph, "MOST_HELD", most)
        links = checkpointed(graph.descend(p, o))
        thin = checkpointed(graph.navigable(links, p, 5))
        near = graph.beam(p, p, thin, 4, o).select("query", "neighbour", "score", "rank")
        found.append((told(links), told(thin), told(near)))
        # a step of joins is a job; with the points in every task the walk is part of the plan
        assert ("MapInPandas" in near._jdf.queryExecution().toString()) == (most > 0)
    assert found[0] == found[1]
