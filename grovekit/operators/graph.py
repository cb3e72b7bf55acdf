"""Navigable neighbour graphs, built and searched without comparing all pairs.

``descend`` improves a rough graph by the rule that a neighbour's neighbour is
likely a neighbour (NN-descent): each round every point brings its newest
neighbours, forward and reverse, together, and each keeps its best ``k``; links
are flagged new until they were compared, and the rounds end when few change.
``navigable`` thins a neighbour table into links of bounded degree that point in
different directions.  ``beam`` searches it for all queries at once.

All are rounds of joins, top-k aggregates and small matrix products in tasks:
what meets in a task is one point's neighbours (bounded by ``k`` and
``reverse``), and a round shuffles points times neighbours, never pairs.
Points are ``points(id, vec)``; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.functions import vectors as V
from grovekit.operators import blocks
from grovekit.operators.knn import _block_scores, top_k
from grovekit.plans.observed import Rounds
from grovekit.plans.session import checkpointed

#: Neighbourhoods that meet in one group of a task.
GROUP = 512
#: Most entry points of a search; they go to every task (a few MB).
MOST_ENTRIES = 4096
#: Bytes of vectors, and of links, that go to every task; larger tables are joined.
MOST_HELD = 256 << 20
#: Pairs (query, point) that a task remembers at once.
SEEN = 1 << 25


@dataclass(frozen=True)
class SearchOptions:
    """How a graph is built and searched."""

    k: int = 20  # neighbours that building keeps of each point
    reverse: int = 30  # reverse neighbours that take part in a round
    max_degree: int = 32  # links of a point in the navigable graph
    width: int = 80  # a search's best points, of which none may be left unopened
    opened: int = 16  # points that a search opens at once
    starts: int = 4  # a search begins at so many of the entries
    max_steps: int = 40
    max_rounds: int = 12
    settled: float = 0.002  # building ends when a smaller share of links changes
    similarity: str = "cosine"
    seed: int = 5


class _Vectors:
    """All points by id, for tasks to look up."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray) -> None:
        self.ids, self.vec = ids, vec

    def place(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.vec[self.place(ids)].astype(np.float64)


def _held(points: DataFrame) -> Broadcast | None:
    """The points for every task, unless they are too large, or one is there twice."""
    single = points.schema["vec"].dataType.simpleString() == "array<float>"
    table = blocks.gathered(points.select("id", "vec" if single else V.wide("vec").alias("vec")), MOST_HELD)
    if table is None or not table.num_rows:
        return None
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    cells = table["vec"].combine_chunks()
    vec = cells.flatten().to_numpy().reshape(len(ids), -1)[order]
    if (ids[order][1:] == ids[order][:-1]).any():
        return None
    return points.sparkSession.sparkContext.broadcast(_Vectors(ids[order], vec))


def _pair_scores(similarity: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of rows with rows, to 12 digits."""
    if similarity in ("dot", "cosine"):
        s = np.einsum("ij,ij->i", a, b)
        if similarity == "cosine":
            lengths = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
            s = np.divide(s, lengths, out=np.zeros_like(s), where=lengths > 0)
        return np.round(s, 12)
    away = ((a - b) ** 2).sum(1)
    return np.round({"l2": lambda: 1 / (1 + np.sqrt(away)), "sql2": lambda: 1 / (1 + away), "negative_sql2": lambda: -away}[similarity](), 12)


def _groups(n: int) -> int:
    return max(1, -(-n // GROUP))


def _rough(points: DataFrame, n: int, o: SearchOptions) -> DataFrame:
    """(src, dst): links within random groups of about ``k`` points, two groupings."""
    made = None
    for turn in range(2):
        group = F.pmod(F.xxhash64(F.lit(o.seed + turn), "id"), F.lit(max(1, n // (o.k + 1))))
        side = lambda c: points.select(group.alias("g"), F.col("id").alias(c))  # noqa: B023, E731
        links = side("src").join(side("dst"), "g").where("src <> dst").select("src", "dst")
        made = links if made is None else made.unionByName(links)
    return made.distinct()


def _best(links: DataFrame, k: int) -> DataFrame:
    """Each src's best ``k`` links; a link that is known already stays as it is."""
    once = links.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    return top_k(once, k, "src", "score", "dst").drop("rank")


def _scored(pairs: DataFrame, points: DataFrame, similarity: str, held: Broadcast | None = None) -> DataFrame:
    if held is not None:
        kind = points.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(score=_pair_scores(similarity, *(held.value.of(batch[c].to_numpy()) for c in ("src", "dst"))))

        return pairs.select("src", "dst").mapInPandas(run, f"src {kind}, dst {kind}, score double")
    vec = lambda c: points.select(F.col("id").alias(c), V.wide("vec").alias(f"v_{c}"))
    both = pairs.join(vec("src"), "src").join(vec("dst"), "dst")
    return both.select("src", "dst", F.round(V.SIMILARITIES[similarity](F.col("v_src"), F.col("v_dst")), 12).alias("score"))


def _met(members: DataFrame, kind: str, k: int, groups: int, similarity: str, held: Broadcast | None = None) -> DataFrame:
    """(src, dst, score): the best links between the members of each neighbourhood, of which one at least is new to it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["at", "id"], kind="stable")
        cuts = np.flatnonzero(np.r_[True, pdf["at"].to_numpy()[1:] != pdf["at"].to_numpy()[:-1], True])
        ids, fresh = pdf["id"].to_numpy(), pdf["fresh"].to_numpy()
        vec = np.array(pdf["vec"].to_list(), np.float64) if held is None else held.value.of(ids)
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y - x < 2 or not fresh[x:y].any():
                continue
            score = np.round(_block_scores(similarity, vec[x:y], vec[x:y]), 12)
            new, own = fresh[x:y], ids[x:y]
            score[(~new[:, None] & ~new[None, :]) | (own[:, None] == own[None, :])] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(y - x), order.shape[1])
            col = order.ravel()
            keep = np.isfinite(score[row, col])
            out.append((own[row[keep]], own[col[keep]], score[row[keep], col[keep]]))
        if not out:
            return pd.DataFrame({"src": ids[:0], "dst": ids[:0], "score": np.empty(0)})
        src, dst, s = (np.concatenate(c) for c in zip(*out, strict=True))
        # of what this group found, each point's best are enough
        order = np.lexsort((dst, -s, src))
        src, dst, s = src[order], dst[order], s[order]
        once = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
        src, dst, s = src[once], dst[once], s[once]
        first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        place = np.arange(len(src)) - np.repeat(first, np.diff(np.r_[first, len(src)]))
        return pd.DataFrame({"src": src[place < k], "dst": dst[place < k], "score": s[place < k]})

    dealt = members.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(groups)))
    return dealt.groupBy("block").applyInPandas(run, f"src {kind}, dst {kind}, score double")


def link_rounds() -> Rounds:
    """Metrics of the rounds of ``descend``: links held, links that are new, and the least and mean score."""
    return Rounds(links=F.count("*"), changed=F.count_if("fresh"), least=F.min("score"), mean=F.avg("score"))


def descend(points: DataFrame, options: SearchOptions | None = None, start: DataFrame | None = None, rounds: Rounds | None = None) -> DataFrame:
    """(src, dst, score): about the ``k`` nearest points of each, from random links or those of ``start(src, dst)``.

    Fewer than two points have no links.  A round compares what is new in each
    neighbourhood; of a point's reverse neighbours the ``reverse`` least by hash
    take part, another set in each round.  ``rounds`` (``link_rounds()``) keeps
    what each round counted; its round 0 is the start.
    """
    rounds = rounds or link_rounds()
    o = options or SearchOptions()
    n = points.count()
    groups = _groups(n)
    kind = points.schema["id"].dataType.simpleString()
    given = _rough(points, n, o) if start is None else start.select("src", "dst").unionByName(_rough(points, n, o)).distinct()
    vec = points.select("id", V.wide("vec").alias("vec"))
    held = _held(points)
    links, _ = rounds.checkpointed(_best(_scored(given, points, o.similarity, held).withColumn("fresh", F.lit(True)), o.k))
    for turn in range(o.max_rounds):
        forward = links.select(F.col("src").alias("at"), F.col("dst").alias("id"), "fresh")
        chance = F.row_number().over(W.partitionBy("dst").orderBy(F.xxhash64(F.lit(turn), "src"), "src"))
        back = links.withColumn("place", chance).where(F.col("place") <= o.reverse).select(F.col("dst").alias("at"), F.col("src").alias("id"), "fresh")
        members = forward.unionByName(back).groupBy("at", "id").agg(F.max("fresh").alias("fresh"))
        if held is None:
            members = members.join(vec, "id").select("at", "id", "fresh", "vec")
        found = _met(members, kind, o.k, groups, o.similarity, held).withColumn("fresh", F.lit(True))
        links, seen = rounds.checkpointed(_best(links.withColumn("fresh", F.lit(False)).unionByName(found), o.k))
        if seen["changed"] <= o.settled * n * o.k:
            break
    return links.select("src", "dst", "score")


def navigable(links: DataFrame, points: DataFrame, max_degree: int, similarity: str = "cosine") -> DataFrame:
    """(src, dst, score): of each point's links, both ways, those that no nearer kept one makes a detour of, at most ``max_degree``.

    A link is kept if the point is nearer to its end than any end kept before it
    is; what room is left goes to the nearest of the others.
    """
    kind = points.schema["id"].dataType.simpleString()
    both = links.select("src", "dst", "score").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    few = top_k(both.groupBy("src", "dst").agg(F.max("score").alias("score")), 3 * max_degree, "src", "score", "dst").drop("rank")
    every = _held(points)
    held = few if every is not None else few.join(points.select(F.col("id").alias("dst"), V.wide("vec").alias("vec")), "dst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(down=-pdf["score"]).sort_values(["src", "down", "dst"])
        src = pdf["src"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, src[1:] != src[:-1], True])
        vec = np.array(pdf["vec"].to_list(), np.float64) if every is None else every.value.of(pdf["dst"].to_numpy())
        score, kept = pdf["score"].to_numpy(), np.zeros(len(pdf), bool)
        for x, y in zip(cuts, cuts[1:], strict=False):
            among = _block_scores(similarity, vec[x:y], vec[x:y])
            mine: list[int] = []
            for i in range(y - x):
                if len(mine) < max_degree and not (among[i, mine] > score[x + i]).any():
                    mine.append(i)
            mine += [i for i in range(y - x) if i not in set(mine)][: max_degree - len(mine)]
            kept[x + np.array(mine, int)] = True
        return pdf.loc[kept, ["src", "dst", "score"]]

    groups = _groups(points.count())
    return held.withColumn("block", F.pmod(F.xxhash64("src"), F.lit(groups))).groupBy("block").applyInPandas(run, f"src {kind}, dst {kind}, score double")


def _entered(queries: DataFrame, points: DataFrame, o: SearchOptions) -> DataFrame:
    """(query, neighbour, score): each query's nearest ``starts`` of the entries, which are the square root of the points in number, by hash."""
    n = min(MOST_ENTRIES, math.isqrt(max(1, points.count())) + 1)
    entries = points.select("id", V.wide("vec").alias("vec")).orderBy(F.xxhash64(F.lit(o.seed), "id"), "id").limit(n).toPandas()  # bounded by MOST_ENTRIES
    ids, vec = entries["id"].to_numpy(), np.array(entries["vec"].to_list(), np.float64)
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            own = batch["id"].to_numpy()
            s = np.round(_block_scores(o.similarity, np.array(batch["vec"].to_list(), np.float64), vec), 12)
            s[own[:, None] == ids[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, : o.starts]
            row, col = np.repeat(np.arange(len(own)), order.shape[1]), order.ravel()
            keep = np.isfinite(s[row, col])
            yield pd.DataFrame({"query": own[row[keep]], "neighbour": ids[col[keep]], "score": s[row[keep], col[keep]]})

    return queries.select("id", V.wide("vec").alias("vec")).mapInPandas(run, f"query {kind}, neighbour {kind}, score double")


def _walk(asked: pd.DataFrame, all_of: _Vectors, start: np.ndarray, ends: np.ndarray, k: int, o: SearchOptions) -> pd.DataFrame:
    """The walks of some queries, each from its entries, over links that begin at ``start`` and lead to ``ends``."""
    width = max(o.width, k)
    n, many = len(all_of.ids), len(asked)
    q = np.array(asked["vec"].to_list(), np.float64)
    own = all_of.place(asked["id"].to_numpy())
    own = np.where(all_of.ids[np.minimum(own, n - 1)] == asked["id"].to_numpy(), own, -1)
    sizes = asked["entries"].str.len().fillna(0).astype(int).to_numpy()
    row = np.repeat(np.arange(many), sizes)
    at = all_of.place(np.concatenate([all_of.ids[:0], *(x for x in asked["entries"] if x is not None and len(x))]))
    score, opened = _pair_scores(o.similarity, q[row], all_of.vec[at].astype(np.float64)), np.zeros(len(at), bool)
    seen = np.zeros(many * n, bool)
    seen[row * n + at] = True
    for step in range(o.max_steps + 1):
        order = np.lexsort((at, -score, row))
        row, at, score, opened = row[order], at[order], score[order], opened[order]
        few = _places(row) < width
        row, at, score, opened = row[few], at[few], score[few], opened[few]
        closed = np.flatnonzero(~opened)
        front = closed[_places(row[closed]) < o.opened]
        if not len(front) or step == o.max_steps:
            break
        opened[front] = True
        low, high = start[at[front]], start[at[front] + 1]
        to = np.repeat(row[front], high - low)
        new = ends[np.repeat(low, high - low) + np.arange(len(to)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
        key = np.unique((to * n + new)[new != own[to]])
        key = key[~seen[key]]
        seen[key] = True
        to, new = key // n, key % n
        more = [_pair_scores(o.similarity, q[to[i : i + SEEN // 512]], all_of.vec[new[i : i + SEEN // 512]].astype(np.float64)) for i in range(0, len(to), SEEN // 512)]
        row, at, score, opened = np.r_[row, to], np.r_[at, new], np.concatenate([score, *more]), np.r_[opened, np.zeros(len(to), bool)]
    few = _places(row) < k
    return pd.DataFrame({"query": asked["id"].to_numpy()[row[few]], "neighbour": all_of.ids[at[few]], "score": score[few]})


def _walked(entered: DataFrame, queries: DataFrame, held: Broadcast, links: Broadcast, k: int, o: SearchOptions, kind: str) -> DataFrame:
    """(query, neighbour, score): ``beam``'s best ``k`` where points and links are in every task: a task walks for some queries at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_of, (start, ends) = held.value, links.value
        size = max(1, min(512, SEEN // len(all_of.ids)))
        for batch in batches:
            for i in range(0, len(batch), size):
                yield _walk(batch.iloc[i : i + size].reset_index(drop=True), all_of, start, ends, k, o)

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select("id", V.wide("vec").alias("vec")).join(entered.groupBy(F.col("query").alias("id")).agg(F.collect_list("neighbour").alias("entries")), "id").repartition(parts)
    return asked.mapInPandas(run, f"query {kind}, neighbour {kind}, score double")


def _places(row: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row; rows are in order."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[: len(row)]
    return np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))


def _held_links(links: DataFrame, held: Broadcast) -> Broadcast | None:
    """For each point's place where its links begin, and the places of their ends; None if there are too many."""
    table = blocks.gathered(links.select("src", "dst").distinct(), MOST_HELD)
    if table is None:
        return None
    src, dst = (held.value.place(table[c].to_numpy()) for c in ("src", "dst"))
    order = np.argsort(src, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(held.value.ids)))])
    return links.sparkSession.sparkContext.broadcast((start, dst[order].astype(np.int32)))


def beam(queries: DataFrame, points: DataFrame, links: DataFrame, k: int, options: SearchOptions | None = None, barred: DataFrame | None = None) -> DataFrame:
    """(query, neighbour, score, rank): the nearest points that a beam over ``links(src, dst)`` reaches from spread entries.

    All queries step together.  In a step a query opens the best ``opened`` of
    its best ``width`` points that it hasn't opened yet, and is compared with
    their links' ends.  It ends when none of any query's best is unopened, or
    after ``max_steps``.  Pairs of ``barred(query, neighbour)`` are walked over
    but not returned.

    If points and links are small enough for every task (``MOST_HELD``) and no
    pair is barred, each task walks for its own queries; else steps are joins.
    """
    o = options or SearchOptions()
    width = max(o.width, k)
    held = _held(points) if barred is None else None
    held_links = None if held is None else _held_links(links, held)
    if held_links is not None:
        kind = points.schema["id"].dataType.simpleString()
        return top_k(_walked(_entered(queries, points, o), queries, held, held_links, k, o, kind), k)
    ask = queries.select(F.col("id").alias("query"), V.wide("vec").alias("v_query"))
    have = points.select(F.col("id").alias("neighbour"), V.wide("vec").alias("v_neighbour"))
    similarity = V.SIMILARITIES[o.similarity]
    hop = links.select(F.col("src").alias("neighbour"), "dst")
    # rows are (best points, opened or not); what falls out of the width is forgotten but for its name
    seen = checkpointed(_entered(queries, points, o).withColumn("opened", F.lit(False)))
    for _ in range(o.max_steps):
        best = top_k(seen, width)
        front = checkpointed(top_k(best.where("not opened").drop("rank"), o.opened).select("query", "neighbour"))
        if front.isEmpty():
            break
        ends = front.join(hop, "neighbour").select("query", F.col("dst").alias("neighbour")).where("query <> neighbour").distinct()
        new = ends.join(seen.select("query", "neighbour"), ["query", "neighbour"], "left_anti").join(ask, "query").join(have, "neighbour")
        new = new.select("query", "neighbour", F.round(similarity(F.col("v_query"), F.col("v_neighbour")), 12).alias("score"), F.lit(False).alias("opened"))
        marked = seen.join(front.withColumn("now", F.lit(True)), ["query", "neighbour"], "left").select("query", "neighbour", "score", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened"))
        seen = checkpointed(marked.unionByName(new))
    found = seen if barred is None else seen.join(barred.select("query", "neighbour"), ["query", "neighbour"], "left_anti")
    return top_k(found.drop("opened"), k)


def search(queries: DataFrame, points: DataFrame, k: int, options: SearchOptions | None = None) -> DataFrame:
    """(query, neighbour, score, rank) by a graph that is built for the purpose."""
    o = options or SearchOptions()
    links = checkpointed(navigable(descend(points, o), points, o.max_degree, o.similarity))
    return beam(queries, points, links, k, o)
