"""Exact top-k by inner product, pruned by two cover trees searched together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from quarry.llm import vectors as V

#: Ratio of the radii of a node and its children, children and points of a node at most.
RATIO, CHILDREN, LEAF = 1.3, 32, 24
#: Queries of a group, vectors of a block.
ROWS = (256, 4096)
#: What integer components are multiplied by.
SCALE = 1024


def build_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree: order of points, and of each node its range, centre, radius and children.

    A node's children are centres chosen one after another as the point farthest from those before
    (its own centre first), until all points lie within the node's radius over RATIO or CHILDREN are
    found; points go to the nearest centre. Radii are measured, so that every point below a node is
    within its radius of its centre. Equal points end in one leaf of radius 0, whatever their number.
    """
    order = np.arange(len(points))
    centre, radius, first, last, children = [], [], [], [], []
    middle = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    away = np.sqrt(((points - points[middle]) ** 2).sum(axis=1))
    centre.append(middle), radius.append(away.max()), first.append(0), last.append(len(points)), children.append((0, 0))
    node = 0
    while node < len(centre):
        a, b = first[node], last[node]
        if b - a > LEAF and radius[node] > 0:
            mine = order[a:b]
            near = np.sqrt(((points[mine] - points[centre[node]]) ** 2).sum(axis=1))
            chosen, owner = [centre[node]], np.zeros(b - a, np.int64)
            while len(chosen) < CHILDREN and near.max() > radius[node] / RATIO or len(chosen) < 2:
                far = int(near.argmax())
                away = np.sqrt(((points[mine] - points[mine[far]]) ** 2).sum(axis=1))
                closer = away < near
                owner[closer], near[closer] = len(chosen), away[closer]
                chosen.append(int(mine[far]))
            sorting = np.argsort(owner, kind="stable")
            order[a:b] = mine[sorting]
            cuts = a + np.searchsorted(owner[sorting], np.arange(len(chosen) + 1))
            begin = len(centre)
            for c, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if y > x:
                    centre.append(chosen[c]), first.append(int(x)), last.append(int(y)), children.append((0, 0))
                    radius.append(float(near[owner == c].max()))
            children[node] = (begin, len(centre))
        node += 1
    return {
        "order": order, "centre": np.array(centre), "radius": np.array(radius) * (1 + 1e-12),
        "first": np.array(first), "last": np.array(last), "children": np.array(children).reshape(-1, 2),
    }


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64)


def _build(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    whole = integers(vectors)
    return V.pack(ids=ids, whole=whole, **build_tree(whole.astype(np.float64)))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where no sum can leave its exact range."""
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if largest < 2**53 else x @ y.T


class _Bounds:
    """Upper bounds of the inner product of any query below one node and any point below another."""

    def __init__(self, queries: dict, block: dict):
        self.q, self.x = (t["whole"][t["centre"]].astype(np.float64) for t in (queries, block))
        self.rq, self.rx = queries["radius"], block["radius"]
        self.nq, self.nx = np.linalg.norm(self.q, axis=1), np.linalg.norm(self.x, axis=1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """<q, x> <= <cq, cx> + rq |cx| + rx |cq| + rq rx, for pairs of nodes."""
        out = np.einsum("ij,ij->i", self.q[a], self.x[b])
        return out + self.rq[a] * self.nx[b] + self.rx[b] * self.nq[a] + self.rq[a] * self.rx[b]


def _opened(tree: dict, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, child) for each child of the nodes; a leaf stands for itself."""
    begin, end = tree["children"][nodes].T
    leaf = end == begin
    sizes = np.where(leaf, 1, end - begin)
    at = np.repeat(np.arange(len(nodes)), sizes)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return at, np.where(leaf, nodes, begin)[at] + inner


def _best(queries: dict, block: dict, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs of nodes are opened level by level; a pair whose bound is below the worst kth score of
    its query group is dropped. Pairs of leaves are compared in the order of their bounds, which
    raises the group's worst kth score and drops the rest."""
    bound, ids = _Bounds(queries, block), block["ids"]
    scale = 1 + float(np.abs(bound.nq).max() * np.abs(bound.nx).max())
    slack = 0.5 + scale * 1e-9  # scores are whole numbers: below by more than rounding is below
    n = len(queries["ids"])
    # kth score of each query against the points nearest to it by the leaves' centres.
    leaves = np.flatnonzero(block["children"][:, 0] == block["children"][:, 1])
    promising = np.argsort(-(queries["whole"].astype(np.float64) @ bound.x[leaves].T), axis=1)[:, :4]
    kth = np.full(n, -np.inf)
    for i in range(n):
        points = np.concatenate([block["order"][block["first"][x] : block["last"][x]] for x in leaves[promising[i]]])
        points = points[ids[points] != queries["ids"][i]]
        if len(points) >= k:
            scores = products(queries["whole"][i : i + 1], block["whole"][points])[0]
            kth[i] = np.partition(scores, len(scores) - k)[len(scores) - k]

    def worst(nodes: np.ndarray) -> np.ndarray:
        sorted_kth = kth[queries["order"]]
        return np.array([sorted_kth[queries["first"][x] : queries["last"][x]].min() for x in nodes])

    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        before = len(a)
        at, a = _opened(queries, a)
        b = b[at]
        at, b = _opened(block, b)
        a = a[at]
        limit = bound(a, b)
        seen, place = np.unique(a, return_inverse=True)
        keep = limit + slack >= worst(seen)[place]
        a, b, limit = a[keep], b[keep], limit[keep]
        inner = (queries["children"][a, 0] < queries["children"][a, 1]) | (block["children"][b, 0] < block["children"][b, 1])
        if not inner.any() and len(a) <= before or not len(a):
            break
    for node in np.unique(a):
        mine = queries["order"][queries["first"][node] : queries["last"][node]]
        against = b[a == node][np.argsort(-limit[a == node], kind="stable")]
        limits = np.sort(limit[a == node])[::-1]
        held = {i: (ids[:0], np.zeros(0, np.int64)) for i in mine}
        at = 0
        while at < len(against) and limits[at] + slack >= kth[mine].min():
            step = against[at : at + 16]
            points = np.concatenate([block["order"][block["first"][x] : block["last"][x]] for x in step])
            scores = products(queries["whole"][mine], block["whole"][points])
            for row, i in enumerate(mine):
                own = ids[points] != queries["ids"][i]
                found, score = np.concatenate([held[i][0], ids[points][own]]), np.concatenate([held[i][1], scores[row][own]])
                chosen = V.top(found, score, k)
                held[i] = found[chosen], score[chosen]
                if len(chosen) == k:
                    kth[i] = max(kth[i], score[chosen[-1]])
            at += len(step)
        for i in mine:
            yield queries["ids"][i], *held[i]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product for each query, exactly.

    ``vectors`` has vec_id and embedding, each component x taken as floor(1024 x); ``is_query`` is a
    condition on vec_id. Blocks of vectors and groups of queries each get a cover tree; every group
    meets every block. Ties go to smaller ids, also at the last rank: a bound that equals the kth score
    is not pruned. Null ids and vectors null, with null or non-finite components, or not of the
    commonest length take no part; rows with the query's own id are no candidates; equal vectors and
    other repeated rows are separate candidates. An empty table gives none.
    """
    return V.search(V.usable(vectors, nonzero=False), is_query, k, ROWS, "long", _build, _build, _best)
