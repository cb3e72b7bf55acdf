"""Clustering operators against plain versions on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.functions import features as FE
from grovekit.functions import vectors as V
from grovekit.operators import cut, evaluate, hac, knn, online, train, tree


def _points(spark, vectors, labels=None):
    rows = [(i, [float(x) for x in v], None if labels is None else labels[i]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int")


def _separable(seed=1, groups=6, each=8, dim=16):
    rng = np.random.default_rng(seed)
    centres = np.eye(dim)[:groups]
    return np.concatenate([c + 0.05 * rng.standard_normal((each, dim)) for c in centres]), np.repeat(np.arange(groups), each).tolist()


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "node long, parent long, label string")


def _brute_hac(v):
    """Merges as sets of leaves, by mean squared distance."""
    groups, out = [frozenset([i]) for i in range(len(v))], []
    while len(groups) > 1:
        d = lambda a, b: np.mean([((v[i] - v[j]) ** 2).sum() for i in a for j in b])
        a, b = min(itertools.combinations(groups, 2), key=lambda p: d(*p))
        groups = [g for g in groups if g not in (a, b)] + [a | b]
        out.append(a | b)
    return set(out)


def _clusters(merges, n):
    made = {i: frozenset([i]) for i in range(n)}
    for step, (left, right) in enumerate(merges):
        made[n + step] = made[left] | made[right]
    return {made[n + s] for s in range(len(merges))}


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], {1: 2.0, 3: 1.0}, {1: 5.0})], "a array<double>, z array<double>, s map<int,double>, t map<int,double>")
    a, z = F.col("a"), F.col("z")
    got = df.select(V.norm(a), V.cosine(a, z), V.cosine(a, a), V.similarity_l2(a, z), V.similarity_squared_l2(a, z), V.l1_distance(a, z), V.negative_squared_distance(a, z), V.sparse_dot(F.col("s"), F.col("t")), V.sparse_squared_distance(F.col("s"), F.col("t"))).first()
    assert [round(x, 9) for x in got] == [5, 0, 1, round(1 / 6, 9), round(1 / 26, 9), 7, -25, 10, 10]
    mean = df.select(*[V.centroid(V.add(a, z), F.lit(2), k) for k in ("none", "l2", "l_inf", "binary")], V.centroid(z, F.lit(2), "l2")).first()
    assert [list(map(lambda x: round(x, 9), m)) for m in mean] == [[1.5, 2], [0.6, 0.8], [0.75, 1], [1, 1], [0, 0]]
    with pytest.raises(Exception, match="different length"):
        df.select(V.add(a, F.array(F.lit(1.0)))).collect()


def test_search_is_exact_with_ties_by_id(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 5))
    v[7] = v[3]
    v[9] = 0
    p = _points(spark, v)
    for name in ("cosine", "dot", "l2", "sql2", "negative_sql2"):
        got = {(r["query"], r["rank"]): r["neighbour"] for r in knn.exact(p, p, 3, name).withColumn("score", F.round("score", 9)).collect()}
        want = {(r["query"], r["rank"]): r["neighbour"] for r in knn.expression(p, p, 3, name).collect()}
        assert got == want
    near = knn.exact(p, p, 5)
    links = knn.graph_links(near, 3)
    assert links.groupBy("src").count().agg(F.max("count")).first()[0] <= 3
    gone = spark.createDataFrame([(3,)], "id long")
    assert knn.graph_without(links, gone).where("src = 3 or dst = 3").count() == 0
    assert knn.graph_renamed(links, spark.createDataFrame([(3, 7)], "id long, new long")).where("src = 3 or dst = 3 or src = dst").count() == 0
    barred = near.where("rank = 1").select("query", "neighbour")
    assert knn.without(near, barred).where("rank = 1").count() == 0


def test_tree_relations_on_a_chain(spark):
    n = 70
    rows = [(2 * i, 2 * i + 2 if i < n - 1 else None, None if i else "x") for i in range(n)] + [(2 * i + 1, 2 * i + 2, "y") for i in range(n - 1)]
    nodes = _nodes(spark, rows)
    anc = tree.closure(nodes)
    assert anc.count() == sum(n - i for i in range(n)) + sum(n - i for i in range(n - 1))
    assert tree.height(anc).first()[0] == n - 1
    assert tree.problems(nodes).count() == 0
    assert tree.problems(nodes.where("node <> 1")).count() > 0
    pair = spark.createDataFrame([(1, 9), (9, 1)], "a long, b long")
    assert {r["lca"] for r in tree.lca(pair, anc).collect()} == {10}


def _brute_purity(rows, only=None, strict=False):
    up = {n: p for n, p, _ in rows}
    kids = {p for _, p, _ in rows if p is not None}
    leaf = {n: label for n, _, label in rows if n not in kids}

    def path(x):
        out = []
        while x is not None:
            out.append(x)
            x = up[x]
        return out

    scores = []
    for a, b in itertools.combinations([x for x in leaf if leaf[x] is not None and (only is None or x in only)], 2):
        if leaf[a] == leaf[b]:
            above = path(b)
            v = next(x for x in path(a) if x in above)
            below = [x for x in leaf if v in path(x)]
            labelled = below if strict else [x for x in below if leaf[x] is not None]
            scores.append(sum(leaf[x] == leaf[a] for x in labelled) / len(labelled))
    return sum(scores) / len(scores) if scores else None


def test_purity_equals_all_pairs(spark):
    rng = random.Random(4)
    rows, nxt, live = [], 30, list(range(30))
    parent = {}
    while len(live) > 1:
        k = min(len(live), rng.choice((2, 2, 3)))
        some = rng.sample(live, k)
        for x in some:
            parent[x] = nxt
            live.remove(x)
        live.append(nxt)
        nxt += 1
    rows = [(x, parent.get(x), rng.choice(["a", "b", "c", None]) if x < 30 else None) for x in range(nxt)]
    nodes = _nodes(spark, rows)
    anc, leaf = tree.closure(nodes), tree.leaves(nodes)
    for strict in (False, True):
        assert evaluate.dendrogram_purity(nodes, anc, leaf, strict).first()[0] == pytest.approx(_brute_purity(rows, None, strict))
    only = leaf.where("node < 15")
    assert evaluate.dendrogram_purity(nodes, anc, leaf, only=only).first()[0] == pytest.approx(_brute_purity(rows, set(range(15))))
    single = _nodes(spark, [(1, None, "a")])
    assert evaluate.dendrogram_purity(single, tree.closure(single), single).first()[0] is None


def test_pairwise_example(spark):
    table = spark.createDataFrame([(1, 3), (1, 2), (1, 0), (1, 0)], "predicted int, gold int")
    r = evaluate.pairwise_f1(table).first()
    assert (r["true_pos"], r["false_pos"], r["false_neg"]) == (1, 5, 0)
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((1 / 6, 1, 2 / 7))
    same = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "predicted int, gold int")
    assert evaluate.adjusted_rand(same).first()[0] == pytest.approx(1)
    assert evaluate.normalised_information(same).first()[0] == pytest.approx(1)
    empty = table.where("false")
    assert evaluate.pairwise_f1(empty).first()["f1"] == 0


@pytest.mark.parametrize(("finish", "block"), [(1, 5), (8, 4096), (2000, 4096)])
def test_hac_equals_one_at_a_time(spark, monkeypatch, finish, block):
    monkeypatch.setattr(hac, "FINISH", finish)
    monkeypatch.setattr(hac, "BLOCK", block)
    v = np.random.default_rng(5).standard_normal((24, 4))
    want = _brute_hac(v)
    assert _clusters([(m[0], m[1]) for m in hac.chain(v)], 24) == want
    p = _points(spark, v)
    rows = {r["node"]: r["parent"] for r in hac.rounds(p).collect()}
    below = {}
    for leaf in range(24):
        x = leaf
        while x is not None:
            below.setdefault(x, set()).add(leaf)
            x = rows[x]
    assert {frozenset(s) for s in below.values() if len(s) > 1} == want
    merges = hac.within_blocks(p.withColumn("block", F.lit(1)), "block")
    assert _clusters([(r["left"], r["right"]) for r in merges.orderBy("step").collect()], 24) == want
    nodes = hac.nodes_of_merges(merges, 24)
    assert nodes.count() == 47 and hac.merges_of_nodes(nodes).count() == 23
    cuts = cut.by_distance(tree.closure(nodes.withColumn("label", F.lit("x"))), tree.leaves(nodes), nodes, merges.orderBy("step").collect()[19]["distance"])
    assert cuts.select("cluster").distinct().count() == 4
    assert hac.rounds(_points(spark, v[:1])).count() == 1
    assert hac.rounds(p.where("false")).count() == 0


def _check_tree(out):
    kids = {}
    for r in out:
        kids.setdefault(r["parent"], []).append(r)
    assert len(kids[None]) == 1
    n = {r["node"]: r["n"] for r in out}
    for parent, below in kids.items():
        if parent is not None:
            assert sum(r["n"] for r in below) == n[parent]


@pytest.mark.parametrize("linkage", ["cosine", "average", "centroid"])
def test_online_on_separable_data(spark, linkage):
    v, labels = _separable()
    order = np.random.default_rng(2).permutation(len(v))
    rows = [(str(i), str(labels[i]), v[i].tolist(), int(s)) for s, i in enumerate(order)]
    df = spark.createDataFrame(rows, "pid string, label string, vec array<double>, seq long")
    built = online.build(df, online.ClusterConfig(linkage=linkage))
    out = built.collect()
    _check_tree(out)
    assert {r["pid"] for r in out if r["pid"] is not None} == {str(i) for i in range(len(v))}
    nodes = built.select("node", "parent", "label")
    assert evaluate.dendrogram_purity(nodes, tree.closure(nodes), tree.leaves(nodes)).first()[0] == pytest.approx(1)


def test_online_options(spark):
    v = np.random.default_rng(8).standard_normal((60, 6))
    v[10] = v[11] = v[12]
    v[20] = 0
    rows = [(str(i), None, v[i].tolist(), i, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "pid string, label string, vec array<double>, seq long, block int")
    for options in ({"rotate": False, "graft": False}, {"graft": False}, {"restructure": False}, {"single_search": True, "single_elimination": True}, {"max_grafts": 5}, {"max_leaves": 10}, {"max_leaves": 10, "collapse_order": "highest"}, {"rotate_cap": 5, "graft_cap": 5, "restructure_cap": 5}):
        for block in (0, 1):
            out = online.build(df, online.ClusterConfig(**options), "block").where(F.col("block") == str(block)).collect()
            _check_tree(out)
            assert len({r["pid"] for r in out if r["pid"] is not None}) == 30
    with pytest.raises(ValueError):
        online.ClusterConfig(linkage="median")


def test_cut_opens_from_the_root(spark):
    nodes = _nodes(spark, [(1, None, None), (2, 1, None), (3, 1, None), (4, 2, "a"), (5, 2, "b"), (6, 3, "c"), (7, 3, "d")])
    scores = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.2)], "node long, score double")
    anc, leaf = tree.closure(nodes), tree.leaves(nodes)
    got = {r["node"]: r["cluster"] for r in cut.by_similarity(anc, leaf, scores, 0.5).collect()}
    assert got == {4: 2, 5: 2, 6: 6, 7: 7}
    swept = cut.sweep(anc, leaf, scores, spark.createDataFrame([(0.05,), (0.5,)], "threshold double")).where("threshold = 0.05")
    assert {r["cluster"] for r in swept.collect()} == {1}


def test_learning_finds_the_useful_feature(spark):
    v, labels = _separable(groups=4, each=6)
    noise = np.random.default_rng(1).integers(0, 3, len(v)).tolist()
    rows = [(i, v[i].tolist(), noise[i], labels[i]) for i in range(len(v))]
    p = spark.createDataFrame(rows, "id long, vec array<double>, noise int, cluster int")
    triplets = train.sample_triplets(p, 5)
    assert triplets.count() > 0
    fit = train.fit_weights(triplets, p, [FE.FeatureSpec("vec"), FE.FeatureSpec("noise", "no_match")], steps=15)
    assert fit.losses[-1] < fit.losses[0] and fit.weights.learned["vec"][0] > 1.0
    best = train.best_threshold(p.withColumn("gold", F.col("cluster")).withColumn("block", F.lit(0)), "block", [0.001, 0.2, 5.0]).where("best").first()
    assert best["threshold"] == 0.2 and best["f1"] == pytest.approx(1)
    with pytest.raises(ValueError):
        FE.FeatureSpec("x", "location")


def test_insertion_into_a_batch_tree(spark):
    v, labels = _separable(groups=4)
    rows = [(str(i), str(labels[i]), v[i].tolist(), (i * 7) % len(v)) for i in range(len(v))]
    df = spark.createDataFrame(rows, "pid string, label string, vec array<double>, seq long")
    out = online.build(df, online.ClusterConfig(batch=12)).collect()
    _check_tree(out)
    assert {r["pid"] for r in out if r["pid"] is not None} == {str(i) for i in range(len(v))}
    told = {r["name"]: r["value"] for r in online.run_statistics(df).collect()}
    assert told["points"] == len(v) and told["comparisons"] > len(v)


def test_command_line(spark, tmp_path):
    from grovekit.plans import cli
    from grovekit.sources import files

    v, labels = _separable(groups=3)
    df = spark.createDataFrame([(str(i), str(labels[i]), v[i].tolist(), i) for i in range(len(v))], "pid string, label string, vec array<double>, seq long")
    files.write_points(df, f"{tmp_path}/points")
    cli.main(["cluster", f"{tmp_path}/points", f"{tmp_path}/tree", "--linkage", "average"], spark)
    assert cli.main(["score", f"{tmp_path}/tree"], spark) == pytest.approx(1)
    assert cli.main(["score", f"{tmp_path}/tree", "--strict"], spark) == pytest.approx(1)


def test_pluggable_embeddings(spark):
    df = spark.createDataFrame([("a bb",), (None,)], "text string")
    embed = FE.embedding(lambda texts: np.array([[len(t), 3.0 * (len(t) > 0)] for t in texts]))
    got = [list(r[0]) for r in df.select(embed(F.col("text"))).collect()]
    assert got == [pytest.approx([0.8, 0.6]), [0.0, 0.0]]


def test_online_queries_build_one_tree(spark):
    from grovekit.plans.catalogue import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for name in ("online_tree", "online_tree_average", "online_tree_collapsed", "online_after_batch"):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert [r["n"] for r in rows if r["parent"] is None] == [n], name
        assert len({r["pid"] for r in rows if r["pid"] is not None}) == n
    told = [r["value"] for r in QUERIES["online_statistics"](spark, sf_dir).collect() if r["name"] == "points"]
    assert told == [n]


def _shape(rows):
    """A tree as the set of its nodes' point sets."""
    below = {}
    up = {r["node"]: r["parent"] for r in rows}
    for r in rows:
        if r["pid"] is not None:
            at = r["node"]
            while at is not None:
                below.setdefault(at, set()).add(r["pid"])
                at = up[at]
    return {frozenset(s) for s in below.values()}


@pytest.mark.parametrize("config", [online.ClusterConfig(), online.ClusterConfig(linkage="average"), online.ClusterConfig(linkage="centroid", similarity="sql2", centroid="none", graft_search="grid")])
def test_a_stored_tree_grows_as_a_new_one(spark, config):
    rng = np.random.default_rng(5)
    rows = [(b, f"{b}{i}", str(i % 3), rng.standard_normal(6).tolist(), i) for b in "xyz" for i in range(1 if b == "z" else 24)]
    df = spark.createDataFrame(rows, "block string, pid string, label string, vec array<double>, seq long")
    first, rest = df.where("seq < 10 and block <> 'y'"), df.where("seq >= 10 or block = 'y'")
    grown = online.extend(online.build(first, config, "block"), first, rest, config).collect()
    whole = online.build(df, config, "block").collect()
    for b in "xyz":
        _check_tree([r for r in grown if r["block"] == b])
        assert _shape([r for r in grown if r["block"] == b]) == _shape([r for r in whole if r["block"] == b])
        assert {r["pid"] for r in grown if r["pid"] is not None and r["block"] == b} == {r[1] for r in rows if r[0] == b}


def test_a_collapsed_tree_grows(spark):
    rng = np.random.default_rng(6)
    config = online.ClusterConfig(max_leaves=5)
    df = spark.createDataFrame([("x", str(i), "a", rng.standard_normal(4).tolist(), i) for i in range(30)], "block string, pid string, label string, vec array<double>, seq long")
    first, rest = df.where("seq < 18"), df.where("seq >= 18")
    grown = online.extend(online.build(first, config, "block"), first, rest, config).collect()
    assert sorted(r["pid"] for r in grown if r["pid"] is not None) == sorted(str(i) for i in range(30))
    assert _shape(grown) == _shape(online.build(df, config, "block").collect())


def test_stream_adds_to_stored_trees(spark, tmp_path):
    from grovekit.streaming import incremental

    rng = np.random.default_rng(7)
    rows = [("xy"[i % 2], str(i), "a", rng.standard_normal(4).tolist(), i) for i in range(40)]
    df = spark.createDataFrame(rows, "block string, pid string, label string, vec array<double>, seq long")
    root = f"file://{tmp_path}/store"
    incremental.update(spark, root, df.where("seq < 12"), 0)
    incremental.update(spark, root, df.where("seq >= 8 and seq < 30"), 1)  # some again
    incremental.update(spark, root, df.where("seq >= 30 and block = 'x'"), 2)
    incremental.update(spark, root, df.where("seq >= 30 and block = 'x'"), 2)  # replayed
    got = incremental.current(spark, root).collect()
    want = online.build(df.where("seq < 30 or block = 'x'"), None, "block").collect()
    for b in "xy":
        assert _shape([r for r in got if r["block"] == b]) == _shape([r for r in want if r["block"] == b])


def test_climbing_a_link_graph(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((120, 5))
    p = _points(spark, v)
    want = {(r["query"], r["neighbour"]) for r in knn.exact(p, p, 4).collect()}
    every = p.select(F.col("id").alias("src")).crossJoin(p.select(F.col("id").alias("dst"))).where("src <> dst")
    assert {(r["query"], r["neighbour"]) for r in knn.climb(p, p, every, 4).collect()} == want  # each point is linked with all
    few = knn.climb(p, p, knn.graph_links(knn.exact(p, p, 6), 12), 4).collect()
    assert len({(r["query"], r["neighbour"]) for r in few} & want) >= 0.9 * len(want)
    none = knn.climb(p, p, every.where("false"), 4, roots=2).collect()
    assert len(none) == 2 * 120 - 2 and max(r["rank"] for r in none) == 2


def test_snapshots_of_a_growing_tree(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([("x", str(i), "a", rng.standard_normal(4).tolist(), i) for i in range(17)], "block string, pid string, label string, vec array<double>, seq long")
    got = online.snapshots(df, 5, block="block").collect()
    assert {r["inserted"] for r in got} == {5, 10, 15, 17}
    for n in (5, 17):
        assert _shape([r for r in got if r["inserted"] == n]) == _shape(online.build(df.where(F.col("seq") < n), None, "block").collect())


def test_hashed_counts_equal_a_plain_count(spark):
    texts = [[], ["a"], ["a", "b", "a", "c", "a"], ["w%d" % (i % 50) for i in range(3000)]]
    df = spark.createDataFrame([(t,) for t in texts], "t array<string>")
    for r in df.select("t", FE.hashed_counts(F.col("t"), 1 << 10).alias("c"), F.transform("t", lambda w: F.pmod(F.hash(w), F.lit(1 << 10))).alias("b")).collect():
        plain = {}
        for b in r["b"]:
            plain[b] = plain.get(b, 0) + 1.0
        assert r["c"] == plain


def test_development_thresholds_come_from_the_trees(spark):
    v, labels = _separable()
    df = spark.createDataFrame([(i % 2, i, v[i].tolist(), 2 * labels[i] + i % 2) for i in range(len(v))], "block int, id long, vec array<double>, gold int")  # no cluster spans blocks
    told = train.dev_evaluation(df, "block", 6).collect()
    assert len(told) == 6 and [r["f1"] for r in told if r["best"]] == [max(r["f1"] for r in told)]
    assert max(r["f1"] for r in told) > 0.9  # the thresholds are means of distances, so the very best cut need not be among them
    sizes = spark.createDataFrame([("a", "1")] * 4 + [("b", "1")] * 2 + [("b", "-1")] * 2 + [("c", None)] * 9, "block string, gold string")
    assert [tuple(r) for r in train.dev_blocks(sizes, "block", "gold", 9, 5).collect()] == [("a", 4, 4), ("b", 4, 2)]


@pytest.mark.parametrize("options", [{}, {"linkage": "average", "max_leaves": 30}, {"linkage": "centroid", "similarity": "l2", "centroid": "none"}])
def test_nearest_leaves_are_exact_though_few_are_compared_in_full(options):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 12))
    points[200:] = points[:100]  # ties
    full = []

    class Watched(online.Tree):
        def _link(self, a, others):
            full.append(len(others))
            return super()._link(a, others)

        def nearest(self, node, k, barred=frozenset()):
            leaves = np.array(sorted(x for x in range(len(self.parent)) if self.live[x] and self.kids[x] is None and x != node and x not in barred))
            before = self.stats["comparisons"]
            full.clear()
            found = super().nearest(node, k, barred)
            seen = sum(full)
            if len(leaves):
                link = np.round(self._link(node, leaves), 12)
                assert np.allclose(self._link(node, np.array(found)), np.sort(link)[::-1][:k])
                assert len(found) == min(k, len(leaves)) and self.stats["comparisons"] == before + len(leaves)
                assert seen <= max(20, 4 * k)
            return found

    tree = Watched(online.ClusterConfig(**options))
    tree.fill(list(points))
    assert sorted(p for x in tree.leaves(tree.root) for p in tree.members[x]) == list(range(300))
    for x in range(len(tree.parent)):  # statistics are what lies below
        if tree.live[x]:
            below = [p for y in tree.leaves(x) for p in tree.members[y]]
            assert tree.n[x] == len(below) and np.allclose(tree.sums[x], points[below].sum(0)) and np.allclose(tree.length[x], (points[below].sum(0) ** 2).sum())


def test_development_trees_are_made_once(spark, monkeypatch):
    v, gold = _separable(groups=3, each=5)
    df = _points(spark, v, gold).withColumn("gold", F.col("label")).withColumn("block", F.lit(0))
    made, within = spark.sparkContext.accumulator(0), hac.chain

    def chain(vectors):
        made.add(1)
        return within(vectors)

    monkeypatch.setattr(hac, "chain", chain)
    want = hac.within_blocks(df, "block").select("distance")
    top = max(r["distance"] for r in want.collect())
    before = made.value
    told = train.best_threshold(df, "block", [0.001, top / 2, top]).collect()
    assert made.value == before + 1 and [r["f1"] for r in told if r["best"]] == [1.0]
    before = made.value
    assert sum(r["best"] for r in train.dev_evaluation(df, "block", 4).collect()) == 1
    assert made.value == before + 1
