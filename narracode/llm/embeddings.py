"""Near-duplicate embeddings by navigable small-world graphs, one hierarchy per shard.

Equal vectors are one class and are indexed once. Classes are dealt over shards; each shard
builds one graph with layers, and every class is searched in every shard. A search keeps a beam
of the best vertices seen and ends when all of the beam are expanded. The beam of a query
is widened while all of it lies above the threshold; past ``WIDEST`` it is the whole shard, which
products of matrices go through in blocks. The beams of all queries are widened until audits
pass: for a sample of queries the whole shard is compared, and the searches must
have found the links that this shows. Each vertex also has a parent, a first child and a next
sibling that are never cut, so every vertex can be reached. Links are verified by cosine in double
precision.

Links are counted and united as they are found and are not kept, so a dense group costs time but
no memory. A task sends on a count per query and a spanning forest of its links, never all pairs.
Shards and blocks of queries have a bounded number of rows and bytes, so a task's memory does not grow with the data; the number
of pairs of a shard and a block does, as every shard must be asked.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narracode.llm.graph import components
from narracode.session import write_table

COSINE = 0.95
#: Vectors of a shard and of a block of queries at most, and the least numbers of both.
SHARD_ROWS, MIN_SHARDS, MIN_BLOCKS = 65_536, 8, 2
#: Bytes of the vectors of a shard or block at most.
SHARD_BYTES = 64 << 20
#: Links of a vertex (twice as many in the lowest layer), and beam widths to start with.
LINKS, BUILD_BEAM, BEAM = 12, 40, 24
#: Beams are searched up to this width; a query that needs more is compared with the whole shard.
WIDEST = 96
#: Cosines of a matrix product at once; those this near the limit are computed again one by one.
CELLS, BORDER = 4_000_000, 1e-9
#: Vertices expanded at once, queries searched at once, vertices inserted at once.
STEP, TOGETHER, BATCH = 4, 512, 256
AUDITS, AUDIT_RECALL = 256, 0.999


class SmallWorld:
    """Layered graph over unit vectors. Vertices are numbered by falling level, so a layer is a
    prefix of them and the first vertex is the entry."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], kin: np.ndarray):
        self.v, self.links, self.kin = vectors, links, kin

    @staticmethod
    def levels(n: int) -> np.ndarray:
        """Falling levels with a share of one in ``LINKS`` above each."""
        sizes, size = [], n
        while size > 1:
            size = -(-size // LINKS)
            sizes.append(size)
        out = np.zeros(n, np.int64)
        for size in sizes:
            out[:size] += 1
        return out

    @classmethod
    def build(cls, vectors: np.ndarray) -> SmallWorld:
        n = len(vectors)
        level = cls.levels(n)
        counts = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        links = [np.full((c, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k, c in enumerate(counts)]
        self = cls(vectors, links, np.full((n, 3), -1, np.int32))
        at = 1
        while at < n:
            end = min(n, at + min(at, BATCH))
            self._insert(at, end)
            at = end
        return self

    def _insert(self, a: int, b: int) -> None:
        """Add vertices ``a`` to ``b``; all before are in the graph."""
        q = self.v[a:b]
        beam = np.zeros((b - a, 1), np.int64)
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        among[np.triu_indices(b - a)] = -np.inf
        for k in range(len(self.links) - 1, -1, -1):
            size = len(self.links[k])
            last = k == 0
            if size <= a:
                beam, _ = self._search(q, beam, k, 4 if k > 0 else BUILD_BEAM, a)
                if not last:
                    continue
            count = min(b, size) - a
            if count <= 0:
                continue
            if size > a:
                found, _ = self._search(q, beam, k, BUILD_BEAM, a)
                beam = found
            # the nearest of the batch that come before are candidates too
            near = min(16, b - a)
            mates = np.argsort(-among[:count], axis=1)[:, :near]
            mates_ok = np.take_along_axis(among[:count], mates, axis=1) > -np.inf
            cand = np.concatenate([beam[:count], np.where(mates_ok, mates + a, -1)], axis=1)
            chosen = self._choose(q[:count], cand, LINKS)
            self.links[k][a : a + count, :LINKS] = chosen
            if last:
                for i, p in enumerate(chosen[:, 0]):
                    # a child is put before its siblings
                    self.kin[a + i, 0] = p
                    self.kin[a + i, 2] = self.kin[p, 1]
                    self.kin[p, 1] = a + i
            self._link_back(k, a, chosen)

    def _choose(self, q: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
        """The nearest candidates that are nearer to the vertex than to one chosen before, then
        the nearest of the others; -1 where there are none."""
        s = np.where(cand >= 0, np.einsum("bcd,bd->bc", self.v[np.maximum(cand, 0)], q), -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")[:, : 3 * m]
        cand, s = np.take_along_axis(cand, order, axis=1), np.take_along_axis(s, order, axis=1)
        same = np.zeros(cand.shape, bool)
        for t in range(1, cand.shape[1]):
            same[:, t] = (cand[:, :t] == cand[:, t : t + 1]).any(axis=1)
        s = np.where(same, -np.inf, s)
        cv = self.v[np.maximum(cand, 0)]
        pair = cv @ cv.transpose(0, 2, 1)
        taken = np.zeros(cand.shape, bool)
        for t in range(cand.shape[1]):
            shaded = (taken & (pair[:, t] > s[:, t : t + 1])).any(axis=1)
            taken[:, t] = ~shaded & (s[:, t] > -np.inf) & (taken.sum(axis=1) < m)
        rank = np.where(taken, 2.0, 0.0) * 4 + np.where(s > -np.inf, s, -9.0)
        best = np.argsort(-rank, axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(s, best, axis=1) > -np.inf, np.take_along_axis(cand, best, axis=1), -1)
        if out.shape[1] < m:
            out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
        return out

    def _link_back(self, k: int, a: int, chosen: np.ndarray) -> None:
        links = self.links[k]
        width = links.shape[1]
        new = np.repeat(np.arange(a, a + len(chosen)), chosen.shape[1])
        to = chosen.ravel()
        new, to = new[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        new, to = new[order], to[order]
        start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
        size = np.diff(np.r_[start, len(to)])
        for low in range(0, len(start), TOGETHER):
            who = to[start[low : low + TOGETHER]]
            n = size[low : low + TOGETHER]
            came = np.full((len(who), int(n.max())), -1, np.int64)
            row = np.repeat(np.arange(len(who)), n)
            col = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = start[low]
            came[row, col] = new[first : first + n.sum()]
            every = np.concatenate([links[who].astype(np.int64), came], axis=1)
            links[who] = self._choose(self.v[who], every, width)

    def _search(self, q: np.ndarray, start: np.ndarray, layer: int, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams (vertex numbers, -1 for none, and similarities, falling) of queries in one
        layer. Only vertices below ``limit`` are in it."""
        outs = [self._search_some(q[i : i + TOGETHER], start[i : i + TOGETHER], layer, width, limit) for i in range(0, len(q), TOGETHER)]
        return np.concatenate([o[0] for o in outs]), np.concatenate([o[1] for o in outs])

    def _search_some(self, q, start, layer, width, limit):
        n, links = len(q), self.links[layer]
        size = min(len(links), limit)
        width = max(1, min(width, size))
        seen = np.zeros((n, size), bool)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        done = np.zeros((n, width), bool)
        rows = np.arange(n)
        add = np.where(start < size, start, -1)
        act = rows
        while True:
            add = np.sort(add, axis=1)
            add[:, 1:][add[:, 1:] == add[:, :-1]] = -1
            r, c = np.nonzero(add >= 0)
            x = add[r, c]
            fresh = ~seen[act[r], x]
            r, c, x = r[fresh], c[fresh], x[fresh]
            seen[act[r], x] = True
            s = np.full(add.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.v[x], q[act[r]])
            every_s = np.concatenate([sims[act], s], axis=1)
            every_i = np.concatenate([ids[act], add], axis=1)
            every_d = np.concatenate([done[act], np.zeros(add.shape, bool)], axis=1)
            best = np.argpartition(-every_s, width - 1, axis=1)[:, :width] if every_s.shape[1] > width else np.argsort(-every_s, axis=1)
            sims[act] = np.take_along_axis(every_s, best, axis=1)
            ids[act] = np.take_along_axis(every_i, best, axis=1)
            done[act] = np.take_along_axis(every_d, best, axis=1)
            open_s = np.where(done | (sims == -np.inf), -np.inf, sims)
            act = rows[(open_s > -np.inf).any(axis=1)]
            if not len(act):
                break
            t = min(STEP, width)
            pick = np.argpartition(-open_s[act], t - 1, axis=1)[:, :t] if width > t else np.tile(np.arange(width), (len(act), 1))
            ok = np.take_along_axis(open_s[act], pick, axis=1) > -np.inf
            at = np.where(ok, np.take_along_axis(ids[act], pick, axis=1), -1)
            mark = done[act]
            np.put_along_axis(mark, pick, True, axis=1)
            done[act] = mark
            near = np.where(at[:, :, None] >= 0, links[np.maximum(at, 0)], -1).reshape(len(act), -1)
            if layer == 0:
                kin = np.where(at[:, :, None] >= 0, self.kin[np.maximum(at, 0)], -1).reshape(len(act), -1)
                near = np.concatenate([near, kin], axis=1)
            add = np.where(near < size, near, -1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        return np.where(sims > -np.inf, ids, -1), sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        beam = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.links) - 1, 0, -1):
            beam, _ = self._search(q, beam, k, 4, len(self.v))
        return self._search(q, beam, 0, width, len(self.v))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, kin=self.kin, **{f"l{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def unpack(cls, vectors: np.ndarray, blob: bytes) -> SmallWorld:
        with np.load(io.BytesIO(blob)) as x:
            return cls(vectors, [x[f"l{i}"] for i in range(len(x.files) - 1)], x["kin"])


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small components neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class LinkSums:
    """Links of a block's queries with a shard's vectors, summed as they come: the copies that
    each query links with, and the sets of numbers that links unite. A query that lies in the
    shard has the number of its vertex, any other one a number after these."""

    def __init__(self, copies: np.ndarray, self_at: np.ndarray):
        n, m = len(copies), len(self_at)
        self.copies, self.self_at = copies, self_at
        self.number = np.where(self_at >= 0, self_at, np.arange(m) + n)
        #: Vertices found and copies linked, per query.
        self.found, self.linked = np.zeros(m, np.int64), np.zeros(m, np.int64)
        self.up = np.arange(n + m)

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while True:
                shorter = self.up[self.up]
                if np.array_equal(shorter, self.up):
                    break
                self.up = shorter

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        """Links of query numbers and vertex numbers, each given once."""
        m = len(self.found)
        self.found += np.bincount(left, minlength=m)
        other = self.self_at[left] != right
        left, right = left[other], right[other]
        self.linked += np.bincount(left, self.copies[right], m).astype(np.int64)
        self._unite(self.number[left], right)

    def add_matrix(self, queries: np.ndarray, linked: np.ndarray) -> None:
        """Links of some query numbers (rows) with all vertices (columns)."""
        self.found[queries] += linked.sum(axis=1)
        own = np.flatnonzero(self.self_at[queries] >= 0)
        linked[own, self.self_at[queries[own]]] = False
        self.linked[queries] += (linked @ self.copies.astype(np.float64)).astype(np.int64)
        # only vertices of another set than the row's first one unite anything
        roots, some = self.up[: len(self.copies)], linked.any(axis=1)
        first = np.where(some, roots[linked.argmax(axis=1)], self.number[queries])
        self._unite(self.number[queries[some]], first[some])
        r, c = np.nonzero(linked & (roots[None, :] != first[:, None]))
        self._unite(first[r], c)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers that are not the least of their set, and the least."""
        x = np.flatnonzero(self.up != np.arange(len(self.up)))
        return x, self.up[x]


def _linked(queries: np.ndarray, exact: np.ndarray, limit: float) -> np.ndarray:
    """Whether each query (row) and vector (column) are linked. Cosines at the limit's border
    are summed as those of single links are, so a pair has one answer."""
    cosine = queries @ exact.T
    out = cosine >= limit
    r, c = np.nonzero(np.abs(cosine - limit) < BORDER)
    out[r, c] = np.einsum("ij,ij->i", queries[r], exact[c]) >= limit
    return out


def _matches(graph: SmallWorld, exact: np.ndarray, queries: np.ndarray, limit: float, width: int, sums: LinkSums) -> None:
    """Add all verified links that beams of ``width`` find. Beams that lie wholly above the limit
    are widened; past ``WIDEST`` the queries are compared with the whole shard."""
    q32 = queries.astype(np.float32)
    todo = np.arange(len(queries))
    while len(todo) and width <= WIDEST:
        again = []
        # wide beams are searched for fewer queries at once
        some = max(1, TOGETHER * BEAM // width)
        for i in range(0, len(todo), some):
            part = todo[i : i + some]
            ids, sims = graph.search(q32[part], width)
            full = (sims[:, -1] >= limit - 1e-3) & (ids.shape[1] < len(exact))
            again.append(part[full])
            r, c = np.nonzero((sims >= limit - 1e-3) & ~full[:, None])
            a, b = part[r], ids[r, c]
            ok = np.einsum("ij,ij->i", queries[a], exact[b]) >= limit
            sums.add(a[ok], b[ok])
        todo, width = np.concatenate(again), width * 2
    rows = max(1, CELLS // len(exact))
    for i in range(0, len(todo), rows):
        part = todo[i : i + rows]
        sums.add_matrix(part, _linked(queries[part], exact, limit))


def find_links(graph: SmallWorld, exact: np.ndarray, queries: np.ndarray, limit: float, copies: np.ndarray, self_at: np.ndarray) -> LinkSums:
    """Links of all queries, with beams widened until the audits pass. ``self_at`` is the vertex
    that a query is itself, or -1."""
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDITS, len(queries))).astype(np.int64))
    truth, rows = 0, max(1, CELLS // len(exact))
    for i in range(0, len(sample), rows):
        truth += int(_linked(queries[sample[i : i + rows]], exact, limit).sum())
    width = BEAM
    while True:
        sums = LinkSums(copies, self_at)
        _matches(graph, exact, queries, limit, width, sums)
        if sums.found[sample].sum() >= AUDIT_RECALL * truth or width > WIDEST:
            return sums
        width *= 2


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_c", kind="stable")
    exact = np.stack([np.asarray(v, np.float64) for v in pdf["_v"]])
    graph = SmallWorld.build(_unit(exact).astype(np.float32))
    return pd.DataFrame(
        {
            "_dim": [pdf["_dim"].iloc[0]],
            "_shard": [pdf["_shard"].iloc[0]],
            "_keys": [b"".join(bytes(c) for c in pdf["_c"])],
            "_copies": [pdf["_n"].to_numpy(np.int64).tobytes()],
            "_vectors": [exact.tobytes()],
            "_graph": [graph.pack()],
        }
    )


def _ask(limit: float):
    def ask(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = ["_a", "_b", "_links"]
        if not len(shard) or not len(block):
            return pd.DataFrame({c: [] for c in columns})
        one = shard.iloc[0]
        keys = np.frombuffer(one["_keys"], "V16")
        copies = np.frombuffer(one["_copies"], np.int64)
        exact = _unit(np.frombuffer(one["_vectors"], np.float64).reshape(len(keys), -1))
        graph = SmallWorld.unpack(exact.astype(np.float32), one["_graph"])
        block = block.sort_values("_c", kind="stable")
        own = [bytes(c) for c in block["_c"]]
        queries = _unit(np.stack([np.asarray(v, np.float64) for v in block["_v"]]))
        number = {bytes(k): i for i, k in enumerate(keys)}
        self_at = np.array([number.get(c, -1) for c in own])
        sums = find_links(graph, exact, queries, limit, copies, self_at)
        counts = sums.linked
        node, root = sums.forest()
        name = lambda i: bytes(keys[i]) if i < len(keys) else own[i - len(keys)]
        linked = np.flatnonzero(counts)
        return pd.DataFrame(
            {
                "_a": [name(a) for a in node] + [own[i] for i in linked],
                "_b": [name(b) for b in root] + [None] * len(linked),
                "_links": [0] * len(node) + [int(counts[i]) for i in linked],
            },
            columns=columns,
        )

    return ask


def link_vectors(vectors: DataFrame, limit: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``.

    Rows are linked if their cosine is at least ``limit`` in double precision; only vectors of
    equal length can be. A vector that is missing, empty or zero, or holds missing or non-finite
    components, links with nothing and is its own component. Copies count as links of each
    other. The component's id is the smallest id that links reach; ``kept`` rows have it.
    """

    v = F.col("embedding").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id"), F.when(F.coalesce(usable, F.lit(False)), v).alias("_v"))
    rows = rows.select("vec_id", "_v", F.when(F.col("_v").isNotNull(), F.unhex(F.md5(F.concat_ws(",", F.col("_v").cast("array<string>"))))).alias("_c"))
    members = rows.select("vec_id", "_c")
    kinds = rows.filter(F.col("_c").isNotNull()).groupBy("_c").agg(F.count(F.lit(1)).alias("_n"), F.first("_v").alias("_v"))
    kinds = write_table(kinds.withColumn("_dim", F.size("_v")), "vector_kinds")
    n, longest = kinds.agg(F.count(F.lit(1)), F.coalesce(F.max("_dim"), F.lit(1))).first()
    each = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * longest)))
    shards, blocks = max(MIN_SHARDS, -(-n // each)), max(MIN_BLOCKS, -(-n // each))
    sharded = kinds.withColumn("_shard", F.pmod(F.xxhash64("_c"), F.lit(shards)).cast("int"))
    schema = "_dim int, _shard int, _keys binary, _copies binary, _vectors binary, _graph binary"
    graphs = write_table(sharded.groupBy("_dim", "_shard").applyInPandas(_build, schema), "vector_graphs")
    every = graphs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = kinds.select("_c", "_v", "_dim", F.pmod(F.xxhash64("_c", F.lit(1)), F.lit(blocks)).cast("int").alias("_block"))
    asked = asked.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    on = ["_dim", "_shard", "_block"]
    # the partitions are given: a group's work has nothing to do with its bytes
    every, asked = every.repartition(2 * shards * blocks, *on), asked.repartition(2 * shards * blocks, *on)
    found = every.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(_ask(limit), "_a binary, _b binary, _links long")
    found = write_table(found, "vector_links")
    links = found.filter(F.col("_b").isNull()).groupBy(F.col("_a").alias("_k")).agg(F.sum("_links").alias("_links"))
    roots = components(found.filter(F.col("_b").isNotNull()).select(F.col("_a").alias("u"), F.col("_b").alias("v")))
    counted = kinds.select("_c", "_n").join(links, F.col("_c") == F.col("_k"), "left").join(roots, F.col("_c") == F.col("node"), "left")
    counted = counted.select(
        F.col("_c").alias("_k"), (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), F.coalesce("root", "_c").alias("_root")
    )
    named = write_table(members.join(counted, F.col("_c") == F.col("_k"), "left").select("vec_id", "_links", "_root"), "vector_roots")
    least = named.groupBy("_root").agg(F.min("vec_id").alias("_least")).filter(F.col("_root").isNotNull())
    out = named.join(least.withColumnRenamed("_root", "_r"), F.col("_root") == F.col("_r"), "left")
    component = F.when(F.col("_root").isNull(), F.col("vec_id")).otherwise(F.col("_least"))
    return out.select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
