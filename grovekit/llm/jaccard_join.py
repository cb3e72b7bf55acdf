"""N-gram Jaccard self-join of documents, with the components of its links.

A document's set is its distinct ``words``-word shingles.  Two documents link
when ``100 * |intersection| >= percent * |union|``.  The join is exact.

1. *Classes.*  Equal sets are one class; what follows handles classes, so a
   group of copies of any size costs one.
2. *Blocks.*  Two linked sets differ in at most ``d`` shingles, where ``d``
   follows from their sizes.  A set's shingles are hashed into more than ``d``
   groups, so linked sets agree in all of at least one group: each group's
   content is a signature, and linked sets share one.  (The number of groups
   follows the size tier; a set is also hashed as the next tier is if a partner
   may lie there.  A set with so many empty groups that the agreeing one might
   be empty gives its ``d + 1`` least shingles too: two such sets share one.)
   A passage that many documents share doesn't fill a group, so it makes no
   block; each block is led by one of its classes.
3. *R-tree.*  Each class is a point of group counts.  The points of the classes
   with one leader are indexed in R-trees of bounded size, which the leader
   searches: the members whose summed coordinate minima reach the needed
   overlap are verified.  Verified links give components.
4. Classes with a leader in common are searched where they still span
   components: their R-trees are joined, tile by tile, and yield the pairs of
   different components that reach the needed overlap.  They are verified, the
   likeliest first, and the components are taken again before all that are left
   are searched.  Every pair that shares a block has then been verified, ruled
   out by the bound or connected already.

Nothing is capped: a block's members are dealt out in parts of bounded size,
pairs within a component are never formed, and a class costs some bytes for
each signature.

Defined results: a null or wordless text has an empty set and links with
nothing, so its component is its own doc_id; rows that repeat a doc_id are
returned as often; a null doc_id is never a component's name unless all its
members' are null, but its row links as any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from grovekit.llm import scratch
from grovekit.llm.components import stored_components
from grovekit.llm.dealing import FEW, dealt, listed
from grovekit.llm.hashing import mix, shingle_set, word_hashes
from grovekit.llm.rtree import CountTree, count_vector, packed, unpacked

#: A list of ids is broadcast up to this length (16 MB), and joined by shuffling beyond.
BROADCAST_IDS = 1_000_000
#: Sizes of a tier: from lo to 1.5 * lo.
TIER_RATIO = 1.5
#: Signatures that a task packs or sorts at once.
SIGNATURES = 250_000
#: Bytes kept of a signature besides its bucket; a chance agreement costs a search, not a wrong link.
WIDTH = 5
#: Points of a tile.
TILE = 2048


def largest_difference(total: int, percent: int) -> int:
    """How many shingles two linked sets with ``total`` shingles together can differ in."""
    return total * (100 - percent) // (100 + percent)


def tiers(n: int, percent: int) -> Iterator[tuple[int, int]]:
    """(tier, its largest size) of the tiers where a set of ``n`` meets partners of its size or more."""
    lo, tier = 1, 0
    while lo * percent <= n * 100:
        hi = max(lo, int(lo * TIER_RATIO))
        if hi >= n:
            yield tier, hi
        lo, tier = hi + 1, tier + 1


def signatures(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set of sorted distinct tokens."""
    out = []
    for tier, hi in tiers(len(tokens), percent):
        d = largest_difference(2 * hi, percent)
        if d == 0:  # only equal sets link
            continue
        groups = d + 3 + d // 12
        seed = np.uint64((tier + 1) * 0x8CB92BA72F3D8DD7 & 0xFFFFFFFFFFFFFFFF)
        scrambled = mix(tokens ^ seed)
        at = (scrambled % np.uint64(groups)).astype(np.int64)
        content = np.zeros(groups, np.uint64)
        np.add.at(content, at, mix(scrambled))
        filled = np.flatnonzero(np.bincount(at, minlength=groups))
        out.append(mix(content[filled] ^ mix(seed + filled.astype(np.uint64))))
        if len(filled) <= d:
            out.append(mix(tokens[: d + 1] * np.uint64(0xD1342543DE82EF95) ^ seed))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    a = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    b = mix(tokens + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, k, n, node, check, data): size, two hashes and group counts of each document's set; an empty one has no counts."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, data = [], []
            for h in word_hashes(batch["t"]):
                tokens = shingle_set(h, words)
                found.append((len(tokens), *(_set_hash(tokens) if len(tokens) else (0, 0))))
                data.append(packed(count_vector(tokens)) if len(tokens) else None)
            n, node, check = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
            yield pd.DataFrame({"doc_id": batch["doc_id"], "k": batch["k"], "n": n, "node": node, "check": check, "data": data})

    return rows.mapInPandas(measure, "doc_id long, k long, n long, node long, check long, data binary")


def pack(sig: np.ndarray, node: np.ndarray, buckets: int) -> pd.DataFrame:
    """Signatures with their classes by bucket: for each bucket the classes, how many signatures each has, and the low bytes of these."""
    at = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, node = at[order], node[order]
    low = (sig[order] // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :WIDTH]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (node[1:] != node[:-1])]))
    counts = np.diff(np.append(first, len(at))).astype(np.uint32)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends, runs = np.append(cut[1:], len(at)), np.searchsorted(first, np.append(cut, len(at)))
    return pd.DataFrame({
        "bucket": at[cut],
        "nodes": [node[first[x:y]].tobytes() for x, y in zip(runs, runs[1:], strict=False)],
        "counts": [counts[x:y].tobytes() for x, y in zip(runs, runs[1:], strict=False)],
        "sigs": [low[x:y].tobytes() for x, y in zip(cut, ends, strict=True)],
    })


def unpack(nodes: bytes, counts: bytes, sigs: bytes) -> tuple[np.ndarray, np.ndarray]:
    low = np.frombuffer(sigs, np.uint8).reshape(-1, WIDTH)
    whole = np.zeros((len(low), 8), np.uint8)
    whole[:, :WIDTH] = low
    return whole.view(np.uint64).ravel(), np.repeat(np.frombuffer(nodes, np.int64), np.frombuffer(counts, np.uint32))


def _signed(rows: DataFrame, words: int, percent: int, sign_set: Callable[[np.ndarray, int], np.ndarray], buckets: int) -> DataFrame:
    """(bucket, nodes, counts, sigs): each class's signatures, once for each task that holds a member."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for h in word_hashes(batch["t"]):
                tokens = shingle_set(h, words)
                if not len(tokens):
                    continue
                node = _set_hash(tokens)[0]
                if node in seen:
                    continue
                if len(seen) >= 200_000:  # only saves repeats
                    seen.clear()
                seen.add(node)
                made = sign_set(tokens, percent)
                for at in range(0, len(made), SIGNATURES):
                    part = made[at : at + SIGNATURES]
                    sigs.append(part)
                    nodes.append(np.full(len(part), node, np.int64))
                    size += len(part)
                    if size >= SIGNATURES:
                        yield pack(np.concatenate(sigs), np.concatenate(nodes), buckets)
                        sigs, nodes, size = [], [], 0
        if size:
            yield pack(np.concatenate(sigs), np.concatenate(nodes), buckets)

    return rows.select("t").mapInPandas(sign, "bucket long, nodes binary, counts binary, sigs binary")


def lead(sig: np.ndarray, node: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sig, leader): pairs of a signature's leader with its other classes, and the leader of each signature.

    ``leads`` marks the leaders that are known already; else the least class leads.
    """
    order = np.lexsort((node, ~leads, sig))
    sig, node = sig[order], node[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    leader = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
    other = node != leader
    a, b = leader[other], node[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[once], b[once], sig[first], node[first]


def _led(signed: DataFrame) -> DataFrame:
    """(a, b): each block's leader with each other member; once for each pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held, size, known = None, [], 0, None

        def settle() -> Iterator[pd.DataFrame]:
            """What is held gives its pairs; one leader for each signature stays."""
            nonlocal held, size, known
            if not held:
                return
            sig, node = (np.concatenate(x) for x in zip(*held, *([known] if known else []), strict=True))
            leads = np.zeros(len(sig), bool)
            leads[size:] = True
            a, b, *known = lead(sig, node, leads)
            held, size = [], 0
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            for at, *blobs in batch.itertuples(index=False):
                if at != bucket:
                    yield from settle()
                    bucket, known = at, None
                held.append(unpack(*blobs))
                size += len(held[-1][0])
                if size >= 6 * SIGNATURES:
                    yield from settle()
        yield from settle()

    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return signed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "a long, b long").distinct()


def _searched(pairs: DataFrame, points: DataFrame, percent: int, few: bool) -> DataFrame:
    """The pairs (a, b) that remain when a searches the R-tree of its partners."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, point, members = None, None, ([], [])

        def found() -> Iterator[pd.DataFrame]:
            if members[0]:
                tree = CountTree(unpacked(members[1]))
                near = np.array(members[0], np.int64)[tree.search(point, percent, 100)]
                yield pd.DataFrame({"a": np.full(len(near), group[0]), "b": near})

        for batch in batches:
            made = []
            for a, salt, own, b, data in batch.itertuples(index=False):
                if own:
                    made += found()
                    group, point, members = (a, salt), unpacked([data])[0], ([], [])
                else:
                    members[0].append(b)
                    members[1].append(data)
            if made:
                yield pd.concat(made)
        yield from found()

    return dealt(pairs, points, "data", few=few).mapInPandas(search, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, few: bool) -> DataFrame:
    """The pairs (a, b) that link, by their exact sets."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.empty(0, np.uint64)
        for batch in batches:
            links = []
            for own, h in zip(batch["own"], word_hashes(batch["data"]), strict=True):
                y = shingle_set(h, words)
                if own:
                    x = y
                    links.append(False)
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.loc[np.array(links, bool), ["a", "b"]]

    return dealt(pairs, texts, "data", few=few).mapInPandas(verify, "a long, b long")


def _crossing(pairs: DataFrame, comps: DataFrame, points: DataFrame, percent: int, first: bool, few: bool) -> DataFrame:
    """(a, b): pairs of classes led by one class, in different components, that the R-tree can't rule out; some come more than once.

    Two classes that share a block have its leader in common, so all classes of
    one leader are searched together, each once.  A leader's classes are dealt
    into tiles, and each pair of tiles is one join of two trees.  With
    ``first``, a class gets only its likeliest partner in each leaf of the tree.
    """
    own = comps.select(F.col("node").alias("b"), F.col("component").alias("comp"))
    members = pairs.join(listed(own, few), "b", "left").select(F.col("a").alias("leader"), F.col("b").alias("node"), F.coalesce("comp", "b").alias("comp"))
    # each class has met the leader: what is left are two more of different components
    open_ = members.groupBy("leader").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / TILE).alias("tiles")).where("low <> high").select("leader", "tiles")
    tiled = points.join(listed(members.join(listed(open_, few), "leader").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles")), few), "node")
    met = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda other: F.struct(F.least("tile", other).alias("i"), F.greatest("tile", other).alias("j"))))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = tiled.select("leader", met.alias("met"), "tile", "node", "comp", "data").select("leader", "met.i", "met.j", "tile", "node", "comp", "data")
    spread = spread.repartition(parts, "leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(group: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
            sides = []
            for tile in dict.fromkeys(group[1:]):
                node, comp, data = zip(*x, strict=True) if (x := [r[1:] for r in rows if r[0] == tile]) else ((), (), ())
                sides.append((np.array(node, np.int64), np.array(comp, np.int64), CountTree(unpacked(data))))
            (node, comp, tree), (node2, comp2, tree2) = sides[0], sides[-1]
            for i, j, spare in tree.join(tree2, percent, 100):
                apart = comp[i] != comp2[j]
                i, j, spare = i[apart], j[apart], spare[apart]
                if first:
                    order = np.lexsort((j, -spare, i))
                    best = order[np.unique(i[order], return_index=True)[1]]
                    i, j = i[best], j[best]
                if len(i):
                    a, b = node[i], node2[j]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        group, rows = None, []
        for batch in batches:
            for leader, i, j, *row in batch.itertuples(index=False):
                if (leader, i, j) != group:
                    if rows:
                        yield from found(group, rows)
                    group, rows = (leader, i, j), []
                rows.append(row)
        if rows:
            yield from found(group, rows)

    return spread.mapInPandas(search, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _points(sets: DataFrame, pairs: DataFrame, few: bool) -> DataFrame:
    """(node, doc_id, k, data): each class that has a pair, with its group counts, and one of its rows by doc_id and its text's hash, so that one without a doc_id is found as well."""
    wanted = _ends(pairs)
    met = sets.where("n > 0").join(F.broadcast(wanted) if few else wanted.distinct(), "node", "left_semi")
    return met.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("k", "doc_id"), F.min("k")).alias("k"), F.first("data").alias("data"))


def _texts(rows: DataFrame, points: DataFrame, pairs: DataFrame, few: bool) -> DataFrame:
    """(node, data): a text of each class in ``pairs``, once, though its row may repeat."""
    ends = _ends(pairs)
    chosen = points.select("node", "doc_id", "k").join(F.broadcast(ends) if few else ends.distinct(), "node", "left_semi")
    ids = listed(chosen, few or chosen.count() <= BROADCAST_IDS)
    found = rows.join(ids, rows["doc_id"].eqNullSafe(ids["doc_id"]) & (rows["k"] == ids["k"])).select("node", F.col("t").alias("data"))
    return found.dropDuplicates(["node"])


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text).cast("binary")
    return docs.select(F.col(key).cast("long").alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("k"))


class _Work:
    """The working tables of one join; all go when it is done."""

    def __init__(self, docs: DataFrame, words: int, percent: int, key: str, text: str, sign_set: Callable[[np.ndarray, int], np.ndarray]):
        self.spark, self.words, self.percent, self.paths = docs.sparkSession, words, percent, []
        self.rows = rows = _rows(docs, key, text)
        self.sets, self.sets_path = scratch.settle(_sets(rows, words), "sets")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        total = self.sets.agg(F.sum("n")).first()[0] or 0
        self.pairs = self.keep(_led(_signed(rows, words, percent, sign_set, max(parts, total // (4 * SIGNATURES)))), "pairs")
        self.few = self.pairs.count() <= FEW
        self.points = self.keep(_points(self.sets, self.pairs, self.few), "points")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        made, path = scratch.settle(df, name)
        self.paths.append(path)
        return made

    def verified(self, pairs: DataFrame, few: bool) -> DataFrame:
        """The links among ``pairs``; only texts of their classes are fetched."""
        return self.keep(_verified(pairs, _texts(self.rows, self.points, pairs, few), self.words, self.percent, few), "links")

    def crossing(self, comps: DataFrame, first: bool, tried: DataFrame, tried_few: bool) -> tuple[DataFrame, int]:
        """The pairs to be verified that weren't ``tried``, and their number."""
        met = _crossing(self.pairs, comps, self.points.select("node", "data"), self.percent, first, self.few)
        left = self.keep(met.join(listed(tried, tried_few), ["a", "b"], "left_anti").distinct(), "crossing")
        return left, left.count()

    def led(self) -> DataFrame:
        """The leaders' links."""
        near = self.keep(_searched(self.pairs, self.points.select("node", "data"), self.percent, self.few), "near")
        return self.verified(near, self.few or near.count() <= FEW)

    def components(self, links: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, str]:
        """(node, component) of the links and those that gave ``before``, of which only the components are joined."""
        if before is None:
            return stored_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        few = before.count() + links.count() <= FEW
        named = lambda c: listed(before.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), few)
        edges = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("of_a", "a").alias("u"), F.coalesce("of_b", "b").alias("v"))
        met, path = stored_components(edges)
        moved = before.join(listed(met.select(F.col("node").alias("component"), F.col("component").alias("to")), few), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        made = scratch.settle(moved.unionByName(met.join(listed(before.select("node"), few), "node", "left_anti")), "components")
        scratch.drop(self.spark, path)
        return made

    def done(self) -> None:
        scratch.drop(self.spark, *self.paths)
        self.paths = []


def _joined(docs: DataFrame, words: int, percent: int, key: str, text: str, sign_set: Callable[[np.ndarray, int], np.ndarray]) -> tuple[DataFrame, list[str]]:
    """(doc_id, k, n, group, least, class_size) for each row, and the paths that it is read from; group names a component of any rows."""
    work = _Work(docs, words, percent, key, text, sign_set)
    comps, path = work.components(work.led())
    tried, few = work.pairs, work.few
    for first in (True, False):  # likeliest pairs first: what they connect needs no more pairs; then all that are left
        left, n = work.crossing(comps, first, tried, few)
        if n:
            more = work.verified(left, n <= FEW)
            tried, few = tried.union(left), few and n <= FEW
            if more.limit(1).count():
                old = path
                comps, path = work.components(more, comps)
                scratch.drop(work.spark, old)
    work.done()

    classes = work.sets.where("n > 0").groupBy("node", "check").agg(F.min("doc_id").alias("first"), F.count("*").alias("class_size"))
    named = classes.join(comps, "node").select("component", "first").groupBy("component").agg(F.min("first").alias("least"))
    linked = comps.join(named, "component").select("node", "component", "least")
    told = classes.join(linked, "node", "left").where("class_size > 1 or component is not null")
    told = told.select("node", "check", F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("least"), "class_size")
    joined = work.sets.join(told, ["node", "check"], "left")
    return joined.select(
        "doc_id", "k", "n", F.coalesce("group", "node").alias("group"),
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    ), [work.sets_path, path]


def join(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", sign_set: Callable[[np.ndarray, int], np.ndarray] = signatures,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size) for each row of ``docs``; class_size counts rows with the same set.

    With another ``sign_set`` (sorted distinct tokens and percent to signatures),
    the pairs that share one of its signatures are those joined.
    """
    found, _ = _joined(docs, words, percent, key, text, sign_set)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "class_size")


def links(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links) for each row of ``docs``: its class of equal sets and the number of other rows that it links with.

    Here each pair of classes is verified, also those that are connected by
    others, so a group of near copies costs the square of its different texts.
    """
    work = _Work(docs, words, percent, key, text, signatures)
    nobody = work.pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    found = work.led()
    left, n = work.crossing(nobody, False, work.pairs, work.few)
    found = found.union(work.verified(left, n <= FEW))
    both, _ = scratch.settle(found.union(found.select("b", "a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "verified")
    work.done()
    classes = work.sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"))
    ends = both.union(both.select("b", "a")).toDF("node", "other")
    more = ends.join(classes.select(F.col("node").alias("other"), "size"), "other").groupBy("node").agg(F.sum("size").alias("more"))
    told = classes.join(more, "node", "left").select("node", "class_id", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    empty = F.col("n") == 0
    return work.sets.join(told, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, 0).otherwise(F.col("n_links")).cast("long").alias("n_links")
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the least doc_id, and of its texts the one of the least hash.

    Rows are told apart by doc_id and text: several texts under one doc_id are
    different rows, and only rows equal in both are repeats, of which one stays
    (that of the least hash of all its plain columns).  Rows without doc_id come
    after all others.  Rows without words link with nothing, and all stay.
    """
    found, paths = _joined(docs, words, percent, key, text, signatures)
    found, joined_path = scratch.settle(found.where("n > 0").select("doc_id", "k", "group"), "joined")
    scratch.drop(docs.sparkSession, *paths)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("k").alias("at"))
    # written, so that a large group is a join whose skew Spark splits
    firsts, firsts_path = scratch.settle(found.groupBy("group").agg(F.min(order).alias("f"), F.count("*").alias("rows")).where("rows > 1").select("group", "f.id", "f.at"), "firsts")
    gone, _ = scratch.settle(found.join(firsts, "group").where("not (doc_id <=> id and k = at)").select(F.col("doc_id").alias("_id"), F.col("k").alias("_at")).distinct(), "gone")
    again, _ = scratch.settle(found.groupBy("doc_id", "k").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("k").alias("_at")), "repeats")
    scratch.drop(docs.sparkSession, joined_path, firsts_path)

    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = [F.col(a) for c, a in names.items() if isinstance(docs.schema[c].dataType, AtomicType)]
    rows = docs.select(*[F.col(c).alias(a) for c, a in names.items()]).withColumn("_k", F.xxhash64(F.col(names[text]).cast("binary")))
    same = F.col(names[key]).cast("long").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_at"))
    stay = rows.join(listed(gone, gone.count() <= BROADCAST_IDS), same, "left_anti")
    if again.limit(1).count():
        repeats = listed(again, again.count() <= BROADCAST_IDS)
        once = stay.join(repeats, same, "left_semi").groupBy(names[key], "_k").agg(F.min_by(F.struct(*names.values()), F.xxhash64(*plain)).alias("row")).select("row.*", "_k")
        stay = stay.join(repeats, same, "left_anti").unionByName(once)
    return stay.select(*[F.col(a).alias(c) for c, a in names.items()])


#: The same rows in DuckDB (component_id by iterated minimum over the links).
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS start, doc_id AS node FROM sets UNION SELECT r.start, l.y FROM reach r JOIN links l ON r.node = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.node) AS component_id FROM sets s JOIN reach r ON s.doc_id = r.start GROUP BY s.doc_id, s.s
"""
