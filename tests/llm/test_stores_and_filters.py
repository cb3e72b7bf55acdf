"""Mixing, sharding, URL filters and the pipeline."""

import itertools
import math
import os
import random
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovekit.llm import decontaminate, jaccard_join, mixing, registry, scratch, sharding, urlfilter

SMALL = "/root/testdata/sf0.001"
RULES = [urlfilter.Rule("block", "bad.example", "/"), urlfilter.Rule("allow", "good.bad.example", "/ok"), urlfilter.Rule("block", "x.example", "/p/")]


def test_copies_follow_the_distribution(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, None).otherwise("b").alias("source"), F.lit("t").alias("copy"), F.lit("x").alias("text"))
    out = mixing.replicate(docs)
    by = {r["source"]: r for r in out.groupBy("source").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()}
    for source, n in (("a", 1000), (None, 1000), ("b", 2000)):
        rate = by[source]["rate"]
        assert rate == pytest.approx(4000 * math.sqrt(n) / (2 * math.sqrt(1000) + math.sqrt(2000)) / n)
        assert abs(by[source]["n"] - rate * n) < 5 * math.sqrt(rate * n)
    assert out.columns == ["doc_id", "source", "text", "copy", "repeats", "rate"]
    got = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("repeats").alias("r"), F.max("copy").alias("c")).where("n <> r or n <> c")
    assert got.count() == 0
    given = mixing.replicate(docs, target_weights={"a": 0.5}, max_rate=4.0)
    assert {round(r["rate"], 6) for r in given.select("source", "rate").distinct().collect()} == {2.0, round(0.5 / 0.75, 6)}
    ids = [r["doc_id"] for r in out.select("doc_id").limit(60).collect()]
    assert ids != sorted(ids)


def test_mixing_edges(spark, monkeypatch):
    rows = [(1, None, None), (1, None, None), (None, "s", ""), (2, "s", "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.replicate(docs, max_rate=100.0)
    same = out.where("doc_id = 1").groupBy("copy").count().collect()
    assert all(r["count"] == 2 for r in same)
    assert mixing.replicate(docs.where("false")).count() == 0
    many = mixing.replicate(docs).orderBy("doc_id", "copy").collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert mixing.replicate(docs).orderBy("doc_id", "copy").collect() == many
    with pytest.raises(ValueError):
        mixing.replicate(docs, max_rate=1000.0)


def test_rows_without_an_id_draw_apart(spark, tmp_path):
    rows = [(None, f"t{i}", None if i % 3 else "en", "only", i) for i in range(900)] + [(i, "t", "en", "b", 1) for i in range(60)] + [(None, "twice", "en", "b", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.replicate(docs)
    counts = {r["text"]: r["n"] for r in got.where("source = 'only'").groupBy("text").agg(F.count("*").alias("n")).collect()}
    rate = got.where("source = 'only'").first()["rate"]
    assert len(set(counts.values())) > 2 and abs(sum(counts.values()) - 900 * rate) < 5 * math.sqrt(900 * rate)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = c.sql(f"SELECT doc_id, text, copy, repeats FROM ({mixing.SQL})").fetchall()
    assert sorted(map(tuple, got.select("doc_id", "text", "copy", "repeats").collect()), key=str) == sorted(want, key=str)


def test_plans_of_aliases_stay_small(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<link rel=canonical href=b>")], "page_id long, url string, html string")
    assert len(urlfilter.alias_edges(pages)._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_rare_sources_reach_their_weights(spark):
    def rows(*sizes):
        docs = spark.range(sum(sizes)).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
        ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
        source = F.lit(None).cast("string")
        for i, end in reversed(list(enumerate(ends))):
            source = F.when(F.col("doc_id") < end, F.lit(f"s{i}")).otherwise(source)
        return docs.withColumn("source", source)

    def reached(out):
        return {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}

    near = lambda n, want: abs(n - want) < 5 * math.sqrt(want)
    docs = rows(40, 3960)
    got = reached(mixing.replicate(docs, target_weights={"s0": 0.5}))  # a rate of 50
    assert near(got["s0"], 2000) and near(got["s1"], 2000)
    got = reached(mixing.replicate(docs, target_weights={"s0": 0.5}, max_rate=8.0))
    assert near(got["s0"], 320)  # cut only where it is asked for
    got = reached(mixing.replicate(rows(1, 9999)))  # the square roots give a rate of 99
    assert near(got["s0"], 10000 / (1 + math.sqrt(9999)))
    docs = rows(10, 11990)
    out = mixing.replicate(docs, target_weights={"s0": 0.9})  # a rate of 1080: three draws for each document
    got = reached(out)
    assert near(got["s0"], 10800) and near(got["s1"], 1200)
    each = [r["repeats"] for r in out.where("source = 's0'").select("doc_id", "repeats").distinct().collect()]
    assert len(each) == 10 and all(near(n, 1080) for n in each) and len(set(each)) > 5


def test_rows_without_id_are_spread(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    out = mixing.replicate(docs)
    tasks = {r["p"]: r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert sum(tasks.values()) == out.count() and (not tasks or max(tasks.values()) < 0.5 * sum(tasks.values()))


def test_store(spark):
    store = sharding.ShardStore(spark, scratch.fresh(spark, "store"), target_bytes=60_000, fanin=3, small_bytes=4_000)
    df = spark.range(6000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("shard_note"))
    for part in range(6):
        assert store.append(df.where(F.col("id") % 6 == part).repartition(3)) == part + 1
    before = store.shards()
    version = store.compact()
    after = store.shards()
    assert version == 7 and len(after) < len(before) and sum(s.n_rows for s in after) == 6000
    tiers = [store.tier(s.n_bytes) for s in after]
    assert all(tiers.count(t) < 3 for t in set(tiers) if t >= 0)
    assert store.read(6).count() == store.read().count() == 6000  # old shards are there until vacuum
    assert store.vacuum() == 0 and store.vacuum(keep_versions=2, min_age_seconds=0) == 0  # version 6 names all old shards
    assert store.read(6).count() == 6000
    assert store.vacuum(keep_versions=1, min_age_seconds=0) == len(before) and store.read().select("id", "text", "shard_note").exceptAll(df).count() == 0
    with pytest.raises(Exception, match="manifest-00000006"):
        store.read(6)
    assert store.compact() == 7
    with pytest.raises(FileExistsError):
        store._commit(6, store.manifest()[1]["schema"], [], [])
    with pytest.raises(ValueError):
        store.append(spark.range(3))
    assert store.append(df.where("false")) == 8 and store.read().count() == 6000


def test_vacuum_beside_other_writers(spark):
    root = scratch.fresh(spark, "store")
    one, two = (sharding.ShardStore(spark, root, target_bytes=60_000, fanin=3, small_bytes=4_000) for _ in range(2))
    df = spark.range(900).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("text"))
    one.append(df.where("id < 300"))
    written = two._write(df.where("id >= 300 and id < 600"), 0)  # not yet committed
    assert one.vacuum() == 0
    version, now = two.manifest()
    assert two._commit(version, now["schema"], two.shards(), written) == 2
    assert one.read().count() == 600 and one.read(1).count() == 300
    late = two._write(df.where("id >= 600"), 0)
    assert one.vacuum(min_age_seconds=0) >= len(late)  # and empty part files
    with pytest.raises(sharding.ConflictError, match="removed before"):  # rather than a version that can't be read
        two._commit(2, now["schema"], two.shards(), late)
    assert one.version() == 2 and one.read().count() == 600
    # two writers that race for a version: both arrivals are kept
    stale = one.manifest
    one.manifest = lambda v=None: (one.__dict__.pop("manifest"), stale(1))[1]
    assert one.append(df.where("id >= 600")) == 3 and one.read().count() == 900


def test_sharding_edges(spark):
    rows = [(1, None, "x"), (None, "", "x"), (2, "y" * 2_000_000, None), (2, "y" * 2_000_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    store, out = sharding.shard(docs)
    assert sorted(out.select("doc_id", "text").collect(), key=str) == sorted(docs.select("doc_id", "text").collect(), key=str)
    assert out.columns == ["doc_id", "text", "shard", "shard_version", "shard_level", "shard_rows", "shard_bytes"]
    assert sum(s.n_rows for s in store.shards()) == 4
    assert sharding.shard(docs.where("false"))[1].count() == 0


def _pages():
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://Bad.example/x?q#f", ""), (2, "https://a.example/1", link.format("http://bad.example/y")), (3, "https://b.example/2", link.format("https://a.example/1#top")),
        (4, "http://good.bad.example/ok/1", ""), (5, "http://c.example/", link.format("http://good.bad.example/ok/1")), (6, "http://d.example", link.format("http://c.example/")),
        (7, "http://e.example/", '<meta http-equiv="refresh" content="0; url=http://bad.example/z">'), (8, "http://f.example/a", link.format("/b")), (9, "http://f.example/b", link.format("http://x.example/p/1")),
        (10, None, "x"), (11, "no scheme", link.format("http://bad.example/y")), (12, "http://g.example/", None), (13, "http://x.example/q", ""), (2, "https://a.example/1", link.format("http://bad.example/y")),
    ]
    return rows


def test_urls(spark):
    df = spark.createDataFrame([(*r, "keep") for r in _pages()], "page_id int, url string, html string, action string")
    out = urlfilter.judge(df, RULES)
    got = {r["page_id"]: r for r in out.collect()}
    blocked = {i for i, r in got.items() if r["verdict"] == "block"}
    assert blocked == {1, 2, 3, 7, 8, 9}
    assert got[4]["rule"] == "good.bad.example/ok" and got[1]["rule"] == "bad.example/" and got[2]["rule"] is None
    assert (got[1]["host"], got[1]["path"], got[10]["host"], got[11]["path"]) == ("bad.example", "/x", "", "")
    assert got[1]["action"] == "keep" and out.count() == len(_pages())
    assert urlfilter.judge(df.where("false"), RULES).count() == 0


def test_joined_rules_equal_inline_ones(spark, monkeypatch):
    df = spark.createDataFrame(_pages(), "page_id int, url string, html string")
    want = sorted(urlfilter.judge(df, RULES).collect(), key=str)
    monkeypatch.setattr(urlfilter, "INLINE_RULES", 0)
    assert sorted(urlfilter.judge(df, RULES).collect(), key=str) == want


class _Tags(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.base, self.targets = None, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        at = {k: (v or "").strip() for k, v in reversed(attrs)}
        if tag == "base" and self.base is None:
            self.base = at.get("href", "")
        if tag == "link" and "canonical" in at.get("rel", "").lower().split():
            self.targets.append(at.get("href", ""))
        if tag == "meta" and at.get("http-equiv", "").lower() == "refresh" and "=" in at.get("content", ""):
            self.targets.append(at["content"].split("=", 1)[1].strip(" '\""))


def test_aliases_equal_plain_resolution(spark):
    rng = random.Random(8)
    hosts = ["a.example", "B.example", "bad.example", "x.example", "good.bad.example"]
    some = lambda: "/".join(rng.choice(["p", "ok", "q", "r"]) for _ in range(rng.randint(0, 2)))

    def target():
        return rng.choice([
            lambda: f"https://{rng.choice(hosts)}/{some()}", lambda: f"//{rng.choice(hosts)}/{some()}", lambda: f"/{some()}", lambda: f"{some()}z", lambda: f"../{some()}", lambda: f"./{some()}", lambda: f"../../{some()}",
            lambda: f"?k={rng.randint(0, 2)}", lambda: "#top", lambda: "", lambda: "mailto:x@a.example", lambda: f"/{some()}?u=http://{rng.choice(hosts)}/",
        ])()

    def written(t):
        return rng.choice([t, t, t.replace("/", "&#x2F;"), t.replace("?", "&#63;"), t.replace(":", "&#58;")])

    def tag():
        link = rng.choice(['<link rel="canonical" href="{}">', "<LINK href='{}' data-x='>' REL=canonical>", '<link rel="nofollow Canonical" href=" {} "/>', '<link data-rel="canonical" href="{}">', '<meta property="og:url" content="{}">',
                           '<meta http-equiv="refresh" content="0; url={}">', "<meta content='5;URL={}' http-equiv=Refresh>", '<meta name="refresh" content="0; url={}">'])
        made = link.format(written(target()))
        return rng.choice(["{}", "{}", "{}", "<!-- {} -->", "<script>var x = '{}'</script>", "<style>{}</style>"]).format(made)

    rows = []
    for i in range(420):
        url = f"http://{rng.choice(hosts)}/{some()}{rng.choice(['s', 's/', '?k=1', 's/../w', '#f'])}"
        base = f'<base href="{rng.choice(["/d/e/", "http://x.example/s/t", "u/"])}">' if rng.random() < 0.15 else ""
        rows.append((i, url, f"<html><head>{base}{tag() if rng.random() < 0.6 else ''}</head><body>canonical{tag() if rng.random() < 0.15 else ''}</body></html>"))

    def node(url):
        u = urlsplit(url)
        return f"//{u.netloc.lower()}{urlsplit(urljoin('http://h/', u.path)).path}{'?' + u.query if u.query else ''}" if u.netloc else None

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    edges = set()
    for _, url, html in rows:
        found = _Tags(html)
        for t in found.targets:
            to = node(urljoin(urljoin(url, found.base or ""), t) if t else url)
            if to and to != node(url):
                edges.add((node(url), to))
                root[find(node(url))] = find(to)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["u"], r["v"]) for r in urlfilter.alias_edges(pages).collect()}
    assert got == edges and len(edges) > 60

    def ruled(n):
        host, path = urlsplit("x:" + n).netloc, urlsplit("x:" + n).path
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)).action if fits else None

    said = {}
    for n in {n for e in edges for n in e}:
        said.setdefault(find(n), set()).add(ruled(n))
    judged = {r["page_id"]: (r["verdict"], r["rule"]) for r in urlfilter.judge(pages, RULES).collect()}
    spread = 0
    for i, url, _ in rows:
        near = said.get(find(node(url)), set())
        verdict, rule = judged[i]
        if rule is None:
            want = "block" if "block" in near and "allow" not in near else "allow"
            spread += want == "block"
            assert verdict == want, url
    assert spread > 5


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    want = c.sql(registry.ORACLE[name])
    got = registry.QUERIES[name](spark, SMALL)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(x) for x in columns]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def _firsts(texts):
    """The least doc_id of each component of links, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted(i for i in sets if find(i) == i)


def _repeats(index, text):
    """Whether a window of the benchmark lies within its budget of edits in the text, by the whole table."""
    points = decontaminate.normalise(text)[0].astype(np.int64)
    sizes = {len(w) for w in index.windows}
    for m in sizes:
        own = [i for i, w in enumerate(index.windows) if len(w) == m]
        windows, edits = np.stack([index.windows[i] for i in own]).astype(np.int64), index.edits[own]
        place = np.arange(m + 1)
        column = np.broadcast_to(place, (len(own), m + 1)).copy()
        for x in points:
            new = column + 1
            new[:, 1:] = np.minimum(new[:, 1:], column[:, :-1] + (windows != x))
            new[:, 0] = 0
            column = np.minimum.accumulate(new - place, axis=1) + place
            if (column[:, -1] <= edits).any():
                return True
    return False


def test_pipeline(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 !!", "en", "s", 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        out, _ = scratch.settle(stage(spark, docs, SMALL), name)
        if i < 4:
            assert out.columns == docs.columns
        if name == "language_id":
            assert out.where("doc_id >= 1000000").count() == 0 and out.count() >= 0.98 * (before - 3)
            known = {r["doc_id"]: r["lang"] for r in docs.collect()}
            assert all(known[r["doc_id"]] is not None or r["text"] for r in out.collect())
        if name == "jaccard_join":
            assert sorted(r["doc_id"] for r in out.collect()) == _firsts({r["doc_id"]: r["text"] for r in docs.collect()}) and out.count() < before
        if name == "decontamination":
            bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            kept = {r["doc_id"] for r in out.collect()}
            index = decontaminate.build_index([(r["item_id"], r["text"]) for r in bench.collect()])
            short = [r for r in docs.collect() if len(r["text"]) <= 900]
            assert {r["doc_id"] for r in short if not _repeats(index, r["text"])} == {r["doc_id"] for r in short} & kept and len(short) > 40
            assert decontaminate.leaks(out, bench).count() == 0 and out.count() < before
        if name == "mixing":
            c = duckdb.connect()
            docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
            c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
            want = c.sql(f"SELECT doc_id, count(*) AS n FROM ({registry.ORACLE['op3_mixing']}) GROUP BY doc_id").fetchall()
            assert sorted((r["doc_id"], r["n"]) for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()) == sorted(want)
        if name == "sharding":
            assert out.count() == before and out.select(*docs.columns).exceptAll(docs).count() == 0
        docs = out
    none = docs.select(*corpus_pipeline.STAGES and spark.read.parquet(f"{SMALL}/documents.parquet").columns).where("false")
    for _, stage in corpus_pipeline.STAGES:
        none, _ = scratch.settle(stage(spark, none, SMALL), "none")
        assert none.count() == 0
