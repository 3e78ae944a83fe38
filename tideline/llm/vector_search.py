"""Operator 10: approximate nearest neighbours over robust-pruned directed graphs.

Distinct vectors are dealt to shards by a hash, at most ``shard_rows`` to one
and at least ``PARTS`` of them as soon as they hold ``LEAST_ROWS`` each.  In each
shard a directed graph is grown: a vector's proposed neighbours are the nearest
in the cells of its nearest pivots (in the whole shard, while that is small), and
relaxed distance pruning (a neighbour goes when a kept one is ``alpha`` times
closer to it than the vector is) keeps diverse edges, of the proposed ones and
then of these and their reverses.  Some vectors, from which all others can be
reached, are where searches start.  Each query runs a beam search in every
shard; the shards' best are re-scored exactly, in double precision, on the
original vectors, and merged.  How wide a shard's beam is, is measured on some
of its queries, whose nearest nodes are also found by comparing with all:
vectors without clusters need a much wider one.

A shard's queries stream past its graph, so memory is bounded by a shard.  All
steps of a build and of a search work on blocks of vectors or queries at once.

Cosines depend on directions only.  Vectors whose unit vectors agree to about
2^-20 in every component (equal and scaled copies) are one graph node, which
carries its smallest ids, as many as a result can hold, with their own vectors:
copies tie, and ties go to smaller ids.  So a direction that a third of the rows
share stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import delete, save, table

SHARD_ROWS = 1 << 17
SHARD_BYTES = 1 << 26  # of a shard's vectors in double precision
LEAST_ROWS = 4096      # of a shard, while there are fewer than PARTS
PARTS = 12
QUERY_BLOCK = 2048     # queries answered at once
DEGREE = 24
PROPOSED = 48          # nearest proposed links of a node that are pruned to DEGREE
SLACK = 36             # links a node may gather, with their reverses, before it is pruned back to DEGREE
WHOLE = 8192           # rows up to which every vector of a shard is proposed to every other
CELL = 1024            # vectors of a cell, on average
FAN = 16               # cells of a vector, at least; more in a shard of over 57,600
PER_CELL = 8           # neighbours that a cell proposes to a vector
STARTS = 1024          # vectors drawn for searches to start from, besides far ones and those that no link leads to
ROUNDS, FAR = 16, 64   # far vectors are added in rounds of so many
FIRST = 32             # of which a search takes the nearest
SEARCH_BEAM = 64       # at least
AT_ONCE = 8            # nodes of a beam that are expanded in one step, or a sixteenth of a wider beam
ALPHA = 1.2
BLOCK = 256            # vectors or queries worked on at once
REVERSED = 1 << 14     # vectors whose reverse links are gathered at once
MARKS = 1 << 22        # marks of visited nodes, over a block of queries
TRIED = 128            # queries of a shard that are answered exactly, too, to find out how wide its beam must be
RECALL = 0.93          # of their nearest nodes that the beam must find
WIDER = (1, 1.5, 2, 3, 4, 5, 6, 8, 12, 16, 24, 32)
STEPS = 1 << 20        # of a unit vector's component: directions closer than that are one node

_NONE = np.iinfo(np.int64).max  # a beam's empty place: last in order, and expanded


def usable(vector: str = "embedding"):
    """Not null, not zero, every component finite."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe against overflow and underflow of squares."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _packed(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Similarity and id in one integer, nearest first in order; the lowest bit is free."""
    return (1.5 - sims).astype(np.float32).view(np.int32).astype(np.int64) << 32 | ids.astype(np.int64) << 1


def _ids(packed: np.ndarray) -> np.ndarray:
    return packed >> 1 & 0x7FFFFFFF


def _sims(packed: np.ndarray) -> np.ndarray:
    return np.float32(1.5) - (packed >> 32).astype(np.int32).view(np.float32)


def _places(rows: np.ndarray, n: int) -> np.ndarray:
    """Place of each entry among those of its row; ``rows`` is sorted."""
    counts = np.bincount(rows, minlength=n)
    return np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]


def _highest(s: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of about the ``wanted`` highest entries of each row, never fewer."""
    n = s.shape[1]
    if n <= wanted:
        return np.nonzero(np.ones(s.shape, dtype=bool))
    groups = n // 16  # each group's highest: as many as wanted of them are entries of a row
    most = s[:, :groups * 16].reshape(len(s), 16, groups).max(axis=1) if groups >= 2 * wanted else s
    least = np.partition(most, most.shape[1] - wanted, axis=1)[:, most.shape[1] - wanted]
    return np.divmod(np.flatnonzero(s >= least[:, None]), n)


def _proposed(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Packed neighbours proposed to each vector; a neighbour may come up more than once."""
    n = len(x)
    if n <= WHOLE:
        out = np.full((n, min(PROPOSED, n - 1)), _NONE)
        for i in range(0, n, BLOCK):
            s = x[i:i + BLOCK] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            row, col = _highest(s, out.shape[1])
            place = _places(row, len(s))
            ok = place < out.shape[1]
            row, col = row[ok], col[ok]
            out[i + row, place[ok]] = _packed(s[row, col], col)
        return out
    fan = max(FAN, int(np.sqrt(n) / 15))
    pivots = x[rng.choice(n, -(-n * fan // CELL), replace=False)]
    near = np.empty((n, fan), dtype=np.int32)
    for i in range(0, n, BLOCK):
        near[i:i + BLOCK] = np.argpartition(x[i:i + BLOCK] @ -pivots.T, fan - 1, axis=1)[:, :fan]
    order = np.argsort(near, axis=None, kind="stable")
    ends = np.cumsum(np.bincount(near.ravel(), minlength=len(pivots)))
    out = np.full((n, fan * PER_CELL), _NONE)
    for cell in np.split(order, ends[:-1]):
        # A crowded cell is dealt out, so that no cell's pairs grow with the square of a crowd.
        for own in np.array_split(rng.permutation(cell), -(-len(cell) // (2 * CELL))) if len(cell) > 2 * CELL else [cell]:
            rows, slot = np.divmod(own, fan)
            if len(rows) < 2:
                continue
            s = x[rows] @ x[rows].T
            np.fill_diagonal(s, -2)
            row, col = _highest(s, min(PER_CELL, len(rows) - 1))
            place = _places(row, len(rows))
            ok = place < PER_CELL
            row, col = row[ok], col[ok]
            out[rows[row], slot[row] * PER_CELL + place[ok]] = _packed(s[row, col], rows[col])
    return out


def _distinct(packed: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` nearest different ones of each row, in order."""
    packed = np.sort(packed, axis=1)
    packed[:, 1:][_ids(packed[:, 1:]) == _ids(packed[:, :-1])] = _NONE
    return np.sort(packed, axis=1)[:, :width]


def _pruned(x: np.ndarray, packed: np.ndarray, alpha: float) -> np.ndarray:
    """Robust pruning of each row: nearest first, dropping what a kept neighbour covers."""
    out = np.full((len(packed), DEGREE), _NONE)
    rows = np.arange(len(packed))
    ids = np.where(packed < _NONE, _ids(packed), 0)
    v = x.take(ids.ravel(), axis=0).reshape(*ids.shape, -1)
    between = (2 - 2 * np.matmul(v, v.transpose(0, 2, 1))) * np.float32(alpha)
    to = 2 - 2 * _sims(packed)
    alive, count = packed < _NONE, np.zeros(len(packed), dtype=np.int64)
    for j in range(packed.shape[1]):
        kept = rows[alive[:, j] & (count < DEGREE)]
        if len(kept):
            out[kept, count[kept]] = packed[kept, j]
            count[kept] += 1
            alive[kept] &= between[kept, j] > to[kept]
    return out


def _starts(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Some vectors, and those that are far from them: a few vectors apart from all others have a start of their own."""
    starts = rng.choice(len(x), min(STARTS, -(-len(x) // 16)), replace=False)
    apart = np.concatenate([2 - 2 * (x[i:i + BLOCK] @ x[starts].T).max(axis=1) for i in range(0, len(x), BLOCK)])
    usual = max(2 * np.median(apart), 1e-4)
    for _ in range(ROUNDS):
        far = np.flatnonzero(apart > usual)
        if not len(far):
            break
        starts = np.concatenate([starts, more := far[np.argsort(-apart[far], kind="stable")[:FAR]]])
        apart = np.minimum(apart, 2 - 2 * (x @ x[more].T).max(axis=1))
    return starts


def _reached(links: np.ndarray, starts: np.ndarray, seen: np.ndarray) -> None:
    while len(starts):
        seen[starts] = True
        near = links[starts]
        near = near[near >= 0]
        starts = np.unique(near[~seen[near]])


class Graph:
    """Directed neighbour graph over unit vectors; distance is 2 - 2 cosine."""

    def __init__(self, x: np.ndarray, links: np.ndarray, starts: np.ndarray):
        self.x = x.astype(np.float32)
        self.links = np.where(links < 0, np.arange(len(links), dtype=np.int32)[:, None], links)  # a node itself is visited when its links are
        self.starts = starts
        self.block = int(np.clip(MARKS // len(x), 16, BLOCK))
        self.marks = np.zeros(self.block * len(x), dtype=np.int32)
        self.clock = 1

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 1) -> Graph:
        x, n = x.astype(np.float32), len(x)
        rng = np.random.default_rng(seed)
        starts = _starts(x, rng)
        links = np.full((n, DEGREE), -1, dtype=np.int32)
        if n > 1:
            packed = _proposed(x, rng)
            kept = np.concatenate([_pruned(x, _distinct(packed[i:i + BLOCK], PROPOSED), ALPHA) for i in range(0, n, BLOCK)])
            del packed
            ids = np.where(kept < _NONE, _ids(kept), -1).astype(np.int32)
            for i in range(0, n, REVERSED):
                own = kept[i:i + REVERSED]
                at = np.flatnonzero((ids >= i) & (ids < i + len(own)))
                to, back = ids.ravel()[at] - i, kept.ravel()[at] >> 32 << 32 | at // DEGREE << 1
                order = np.lexsort((back, to))
                to, back = to[order], back[order]
                place = _places(to, len(own))
                ok = place < SLACK
                more = np.full((len(own), SLACK), _NONE)
                more[to[ok], place[ok]] = back[ok]
                own = _distinct(np.concatenate([own, more], axis=1), SLACK)
                few, many = own[:, :DEGREE].copy(), np.flatnonzero(own[:, DEGREE] < _NONE)
                for j in range(0, len(many), BLOCK):
                    few[many[j:j + BLOCK]] = _pruned(x, own[many[j:j + BLOCK]], ALPHA)
                links[i:i + len(own)] = np.where(few < _NONE, _ids(few), -1)
        seen = np.zeros(n, dtype=bool)
        _reached(links, starts, seen)
        while len(lost := np.flatnonzero(~seen)):
            starts = np.concatenate([starts, more := lost[::16]])
            _reached(links, more, seen)
        return cls(x, links, np.sort(starts))

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` nodes (-1: none), nearest first, and their similarities for each query."""
        found = np.concatenate([self._beam(queries[i:i + self.block], width) for i in range(0, len(queries), self.block)])
        none = found == _NONE
        return np.where(none, -1, _ids(found)), np.where(none, np.float32(-np.inf), _sims(found))

    def _beam(self, queries: np.ndarray, width: int) -> np.ndarray:
        n, marks = len(self.x), self.marks
        if self.clock > 1 << 30:
            marks[:] = 0
            self.clock = 1
        begun, live = self.clock, np.arange(len(queries))
        out = np.full((len(queries), width), _NONE)
        first = _packed(queries @ self.x[self.starts].T, self.starts)
        take = min(FIRST, width, first.shape[1])
        first = np.sort(np.partition(first, take - 1, axis=1)[:, :take], axis=1)
        beam = out.copy()
        beam[:, :take] = first
        marks[(live * n)[:, None] + _ids(first)] = begun
        self.clock += 1
        while True:
            unseen = (beam & 1) == 0
            some = unseen.any(axis=1)
            if not some.all():
                out[live[~some]] = beam[~some]
                live, beam, unseen = live[some], beam[some], unseen[some]
                if not len(live):
                    return out
            row, col = np.nonzero(unseen & (np.cumsum(unseen, axis=1, dtype=np.int16) <= max(AT_ONCE, width // 16)))
            node = _ids(beam[row, col])
            beam[row, col] |= 1
            near = self.links.take(node, axis=0)
            place = ((live[row] * n)[:, None] + near).ravel()
            fresh = np.flatnonzero(marks.take(place) < begun)
            place = place[fresh]
            mark = np.arange(self.clock, self.clock + len(place), dtype=np.int32)
            self.clock += len(place)
            marks[place] = mark
            fresh = fresh[marks.take(place) == mark]  # what two nodes link to comes once
            row, near = row[fresh // near.shape[1]], near.ravel()[fresh]
            packed = _packed(np.einsum("fd,fd->f", self.x.take(near, axis=0), queries.take(live[row], axis=0)), near)
            good = np.flatnonzero(packed < beam[row, -1])
            if len(good):
                row = row[good]
                place = _places(row, len(live))
                more = np.full((len(live), place.max() + 1), _NONE)
                more[row, place] = packed[good]
                beam = np.sort(np.concatenate([beam, more], axis=1), axis=1)[:, :width]


def _toward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a digest of the unit vector in whole steps of 1 / STEPS."""
    for b in batches:
        if b.num_rows:
            steps = np.floor(unit(_doubles(b.column("v"))) * STEPS + 0.5).astype(np.int32)
            names = [blake2b(row, digest_size=16).digest() for row in steps]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(names, pa.binary())], names=["vec_id", "v", "toward"])


def distinct_directions(rows: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of each direction with their vectors: ``node`` (the smallest of them), ``vec_id`` and ``v``.

    Directions meet by a 128-bit digest of their components.
    """
    w = Window.partitionBy("toward").orderBy("vec_id")
    few = rows.select("vec_id", "v").mapInArrow(_toward, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, toward binary")
    few = few.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return few.select(F.min("vec_id").over(Window.partitionBy("toward")).alias("node"), "vec_id", "v")


def _rows(v: pa.Array) -> np.ndarray:
    """Equally long lists as a matrix."""
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _doubles(v: pa.Array) -> np.ndarray:
    return _rows(v).astype(np.float64)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


_INDEX = "shard int, at int, node long, ids array<long>, vs array<{v}>, links array<int>, start boolean"


def _build(shard: pa.Table) -> pa.Table:
    node, ids = shard.column("node").to_numpy(), shard.column("vec_id").to_numpy()
    order = np.lexsort((ids, node))
    key, node, ids = shard.column("shard")[0].as_py(), node[order], ids[order]
    v = np.concatenate([_rows(c) for c in shard.column("v").chunks if len(c)])[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    g = Graph.build(unit(v[first].astype(np.float64)))
    n, ends = len(first), np.append(first[1:], len(node))
    linked = g.links != np.arange(n)[:, None]
    start = np.zeros(n, dtype=bool)
    start[g.starts] = True
    out = pa.table({
        "shard": pa.array(np.full(n, key), pa.int32()), "at": pa.array(np.arange(n), pa.int32()), "node": pa.array(node[first]),
        "ids": _lists(ends, pa.array(ids)), "vs": _lists(ends, _lists(np.arange(1, len(v) + 1) * v.shape[1], pa.array(v.ravel()))),
        "links": _lists(np.cumsum(linked.sum(axis=1)), pa.array(g.links[linked], pa.int32())), "start": pa.array(start)})
    return pa.concat_tables([out.slice(i, BLOCK) for i in range(0, n, BLOCK)])  # handed on in small batches


def _even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers of which Spark's hash deals one to each of ``n`` partitions."""
    tries = 16 * n
    while True:
        found = spark.range(tries).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("p")).agg(F.min("key").alias("key"))
        if len(keys := sorted(r["key"] for r in found.select("key").collect())) == n:
            return keys
        tries *= 2


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graph of every shard, one row per direction: shard, at, node, ids, vs, links (to ``at``) and whether searches start there."""
    spark, schema = rows.sparkSession, _INDEX.format(v=rows.schema["v"].dataType.simpleString())
    nodes = save(distinct_directions(rows, k), "vectors")
    n, size = nodes.count(), nodes.select(F.size("v")).first()
    most = min(shard_rows, max(1, SHARD_BYTES // (8 * size[0]))) if size else shard_rows
    shards = max(1, -(-n // most), min(PARTS, -(-n // LEAST_ROWS)))
    keys = F.array(*map(F.lit, _even_keys(spark, shards)))
    dealt = nodes.withColumn("shard", F.element_at(keys, (F.pmod(F.xxhash64("node"), F.lit(shards)) + 1).cast("int")))
    index = save(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_build, schema), "graph")
    delete(nodes)
    return index


class Shard:
    """A shard's graph with the ids and vectors of its nodes."""

    def __init__(self, parts: list[pa.RecordBatch]):
        def joined(name: str) -> np.ndarray:
            return np.concatenate([p.column(name).flatten().to_numpy() for p in parts])

        def ends(name: str) -> np.ndarray:
            return np.cumsum(np.concatenate([[0], *(pc.list_value_length(p.column(name)).to_numpy() for p in parts)]))

        self.ids, self.first = joined("ids"), ends("ids")
        self.vectors = unit(np.concatenate([_doubles(p.column("vs").flatten()) for p in parts]))
        values, at = joined("links"), ends("links")
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        links = np.full((len(at) - 1, DEGREE), -1, dtype=np.int32)
        links[node, np.arange(len(values)) - at[node]] = values
        start = np.concatenate([p.column("start").to_numpy(zero_copy_only=False) for p in parts])
        self.graph = Graph(self.vectors[self.first[:-1]], links, np.flatnonzero(start))

    def width(self, v: np.ndarray, k: int, least: int) -> int:
        """Width, ``least`` or a multiple, at which a beam finds enough of what comparing with every node finds."""
        x = self.graph.x
        q, k = unit(v[::-(-len(v) // TRIED)]).astype(np.float32), min(k, len(x))
        nearest = np.concatenate([np.partition(q[i:i + 16] @ x.T, len(x) - k, axis=1)[:, len(x) - k:] for i in range(0, len(q), 16)])
        for times in WIDER:
            width = int(least * times)
            if width >= len(x):
                break
            _, sims = self.graph.beam(q, width)
            if (sims[:, :k] >= nearest.min(axis=1, keepdims=True) - 2.0 ** -20).mean() >= RECALL:
                break
        return width

    def nearest(self, asked: np.ndarray, v: np.ndarray, k: int, width: int) -> pa.RecordBatch:
        """The ``k`` nearest found of each query, by exact score."""
        u = unit(v)
        nodes, sims = self.graph.beam(u.astype(np.float32), width)
        # Single precision finds the nodes that may be among the best; what decides is double precision.
        row, col = np.nonzero((nodes >= 0) & (sims >= sims[:, k:k + 1] - v.shape[1] * 2.0 ** -21))
        node = nodes[row, col]
        members = self.first[node + 1] - self.first[node]
        row, own = np.repeat(row, members), np.repeat(self.first[node] - np.cumsum(members) + members, members) + np.arange(members.sum())
        own, row = own[other := self.ids[own] != asked[row]], row[other]
        score = np.clip((u[row] * self.vectors[own]).sum(axis=1), -1.0, 1.0)
        order = np.lexsort((self.ids[own], -score, row))
        order = order[_places(row[order], len(asked)) < k]
        return pa.RecordBatch.from_arrays([pa.array(asked[row[order]]), pa.array(self.ids[own[order]]), pa.array(score[order])],
                                          names=["query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK,
           beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest found.

    Queries go to every shard.  A shard's rows come to one task, the graph's
    first, then the queries in a stream, of which ``query_block`` are answered
    at once.  The first ones tell whether a beam of ``beam`` is wide enough for
    the shard or must be wider.  Ties go to the smaller vec_id; fewer than ``k``
    rows come back only when there are fewer candidates.
    """
    shards = sorted(r["shard"] for r in index.select("shard").distinct().collect())
    if not shards:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard, width = None, [], None, 0
        for b in batches:
            keys, node = b.column("shard").to_numpy(), pc.is_valid(b.column("at")).to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]) | (node[1:] != node[:-1])) + 1).tolist(), b.num_rows]
            for i, j in zip([0, *ends], ends, strict=False):
                if i == j:
                    continue
                if keys[i] != key:
                    key, parts, shard = keys[i], [], None
                if node[i]:
                    parts.append(b.slice(i, j - i))
                    continue
                for at in range(i, j, query_block):
                    own = b.slice(at, min(j - at, query_block))
                    v = _doubles(own.column("v"))
                    if shard is None:
                        shard, parts = Shard(parts), []
                        width = shard.width(v, k, max(beam, 2 * (k + 1)))
                    yield shard.nearest(own.column("query_id").to_numpy(), v, k, width)

    asked = queries.select(F.explode(F.array(*map(F.lit, shards))).alias("shard"), "query_id", "v")
    rows = index.select("shard", "at", "ids", "vs", "links", "start").unionByName(asked, allowMissingColumns=True)
    rows = rows.repartition(len(shards), "shard").sortWithinPartitions("shard", F.col("at").asc_nulls_last(), F.xxhash64("query_id"))
    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def vector_rows(table_rows: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part; a null id takes no part.  Floats stay floats (half the bytes), all else is read as doubles.

    A repeated id counts once; with differing vectors, the smallest one counts.
    Vectors of another length than the commonest one (ties: the shorter) take
    no part, since they have no cosine with the rest.
    """
    kind = "array<float>" if table_rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table_rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.where(usable() & F.col("vec_id").isNotNull()).withColumnRenamed("embedding", "v")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (sizes["n"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def op10_vector_search(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    rows = vector_rows(table(spark, sf_dir, "embeddings"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return search(build_index(rows, k), queries, k)
