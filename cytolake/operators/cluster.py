"""Clusters: communities, k-means, linkage, and agreement of labelings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kmeans(df: DataFrame, key: str, vec: str, k: int = 8, seed: int = 1) -> DataFrame:
    """(id, cluster) by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(key).alias("id"), array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=300, tol=1e-4).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("cluster"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a labeling of a weighted undirected graph (each edge once)."""
    total = edges.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return 0.0
    both = edges.join(labels.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    inside = both.filter("a = b").agg(F.sum("weight")).first()[0] or 0.0
    ends = both.select(F.col("a").alias("c"), "weight").union(both.select(F.col("b").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("w"))
    square = ends.agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    return inside / total - resolution * square / (2 * total) ** 2


#: Edges (both ways) up to which a level's moves are made in one place, on arrays of that size.
LOCAL_EDGES = 2_000_000


def _local_moves(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, ids: np.ndarray, k: np.ndarray, twice: float, resolution: float) -> np.ndarray:
    """The community of each node (ids ascending) after moves of one node after another, until none gains by one; ties go to the lowest number."""
    order = np.lexsort((dst, src))
    to, w = np.searchsorted(ids, dst[order]).tolist(), weight[order].tolist()
    first = np.searchsorted(src[order], ids).tolist() + [len(to)]
    of, total, k = list(range(len(ids))), k.astype(float).tolist(), k.astype(float).tolist()
    moved = True
    while moved:
        moved = False
        for node, mass in enumerate(k):
            own = of[node]
            near = {own: 0.0}
            for e in range(first[node], first[node + 1]):
                near[of[to[e]]] = near.get(of[to[e]], 0.0) + w[e]
            total[own] -= mass
            gain = {c: round(x - resolution * mass * total[c] / twice, 12) for c, x in near.items()}
            best = min(gain, key=lambda c: (-gain[c], c))
            if gain[best] > gain[own]:
                of[node], moved = best, True
            total[of[node]] += mass
    return ids[np.array(of, dtype=np.int64)] if len(ids) else ids


def _moves(both: DataFrame, nodes: DataFrame, twice: float, save, level: int, resolution: float) -> tuple[DataFrame, bool]:
    """(id, k, community) after local moves from single nodes on until no node gains by one, and whether any moved.

    In a round the nodes that gain join the neighbouring community with the
    largest gain, a share of them by a hash that changes each round, so two
    nodes rarely swap.  A round that doesn't raise modularity is taken back and
    the share halved, at last to the one node with the largest advantage; so
    modularity rises with each round that stays, and the rounds end.  A graph of
    ``LOCAL_EDGES`` at most is gathered, and its nodes move one after another.
    """

    def quality(labels: DataFrame) -> float:
        ends = both.join(labels.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
        inside = ends.filter("a = b").agg(F.sum("weight")).first()[0] or 0.0
        square = labels.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
        return inside / twice - resolution * square / twice**2

    if both.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES and nodes.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        edge, node = both.select("src", "dst", "weight").toArrow(), nodes.select("id", "k").toArrow()
        order = np.argsort(node["id"].to_numpy())
        ids, k = node["id"].to_numpy()[order], node["k"].to_numpy()[order]
        to = _local_moves(*(edge[c].to_numpy() for c in ("src", "dst", "weight")), ids, k, twice, resolution)
        found = pa.table({"id": ids, "k": k, "community": to})
        return save(both.sparkSession.createDataFrame(found), f"labels_{level}"), bool((to != ids).any())
    labels = save(nodes.select("id", "k", F.col("id").alias("community")), f"labels_{level}_0")
    now, moved, turn, halvings, wanted = quality(labels), False, 0, 1, None
    while True:
        turn += 1
        if wanted is None:
            mass = labels.groupBy("community").agg(F.sum("k").alias("tot"))
            near = both.join(labels.select(F.col("id").alias("dst"), F.col("community").alias("c")), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("weight").alias("w"))
            own = labels.select("id", F.col("community").alias("c"), F.lit(0.0).alias("w"))
            options = near.unionByName(own).groupBy("id", "c").agg(F.max("w").alias("w")).join(labels, "id").join(mass.withColumnRenamed("community", "c"), "c")
            stays = F.col("c") == F.col("community")
            rest = F.col("tot") - F.when(stays, F.col("k")).otherwise(F.lit(0.0))
            scored = options.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * rest / twice, 12))
            best = scored.groupBy("id").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("b"), F.max(F.when(stays, F.col("gain"))).alias("now"))
            wanted = save(best.filter("b.gain > now").select("id", (-F.col("b.c")).alias("to"), (F.col("b.gain") - F.col("now")).alias("more")), f"wanted_{level}_{turn}")
            n = wanted.count()
            if not n:
                return labels, moved
        one = 2**halvings > 2 * n
        chosen = wanted.orderBy(F.desc("more"), "id").limit(1) if one else wanted.filter(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2**halvings)) == 0)
        fresh = save(labels.join(chosen.select("id", "to"), "id", "left").select("id", "k", F.coalesce("to", "community").alias("community")), f"labels_{level}_{turn}")
        then = quality(fresh)
        if then > now:
            labels, now, moved, halvings, wanted = fresh, then, True, max(1, halvings - 1), None
        elif one:  # a gain below the precision of modularity
            return labels, moved
        else:
            halvings += 1


def communities(edges: DataFrame, save, resolution: float = 1.0) -> DataFrame:
    """(id, community) by Louvain: local moves until no node gains, then communities become nodes, until none of these moves.

    ``save(df, name)`` writes and rereads a table; names don't recur.
    """
    both = edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = save(both, "both")
    nodes = save(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "degree")
    twice = nodes.agg(F.sum("k")).first()[0] or 1.0
    both = both.filter("src <> dst")  # a node's own loop moves with it
    found, level = nodes.select("id", F.col("id").alias("community")), 0
    while True:
        labels, moved = _moves(both, nodes, twice, save, level, resolution)
        if not moved:
            return found
        level += 1
        step = labels.select(F.col("id").alias("community"), F.col("community").alias("up"))
        found = save(found.join(step, "community").select("id", F.col("up").alias("community")), f"found_{level}")
        ends = both.join(labels.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
        nodes = save(labels.groupBy(F.col("community").alias("id")).agg(F.sum("k").alias("k")), f"nodes_{level}")
        both = save(ends.filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), f"both_{level}")


def linkage(d: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of a small distance matrix, new clusters numbered from n on."""
    n = len(d)
    d = d.astype(float).copy()
    if method == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    name, size = list(range(n)), [1] * n
    out = []
    live = list(range(n))
    for step in range(n - 1):
        sub = d[np.ix_(live, live)]
        i, j = divmod(int(np.argmin(sub)), len(live))
        a, b = live[min(i, j)], live[max(i, j)]
        height = d[a, b]
        na, nb = size[a], size[b]
        for c in live:
            if c in (a, b):
                continue
            x, y = d[a, c], d[b, c]
            if method == "single":
                z = min(x, y)
            elif method == "complete":
                z = max(x, y)
            elif method == "weighted":
                z = (x + y) / 2
            elif method == "ward":
                z = ((na + size[c]) * x + (nb + size[c]) * y - size[c] * height) / (na + nb + size[c])
            else:
                z = (na * x + nb * y) / (na + nb)
            d[a, c] = d[c, a] = z
        out.append((min(name[a], name[b]), max(name[a], name[b]), float(np.sqrt(height) if method == "ward" else height), na + nb))
        name[a], size[a] = n + step, na + nb
        live.remove(b)
    return out


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, k: int) -> list[int]:
    """Cluster number of each leaf after undoing the k-1 highest merges."""
    parent = list(range(n + len(merges)))
    for step, (a, b, _, _) in enumerate(merges[: n - k]):
        parent[a] = parent[b] = n + step

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    names: dict[int, int] = {}
    return [names.setdefault(top(i), len(names)) for i in range(n)]


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """The leaves as a drawn tree has them, from left to right."""
    below = {i: [i] for i in range(n)}
    for step, (a, b, _, _) in enumerate(merges):
        below[n + step] = below.pop(a) + below.pop(b)
    return [i for part in below.values() for i in part]


#: Groups whose tree is made in one place.
MAX_GROUPS = 2000


def group_order(rows: DataFrame, feature: str, group: str, value: str, method: str = "complete") -> list[str]:
    """The groups in the order of the leaves of their dendrogram: linkage of 1 - correlation of their mean values over the features."""
    from .ranked import correlations

    names = sorted(r[0] for r in rows.select(group).filter(F.col(group).isNotNull()).distinct().limit(MAX_GROUPS + 1).collect())
    if len(names) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    place = {g: i for i, g in enumerate(names)}
    means = rows.groupBy(feature, group).agg(F.avg(value).alias("m"))
    d = np.ones((len(names), len(names)))
    for r in correlations(means, feature, group, "m").collect():
        if r["r"] is not None:
            d[place[r["a"]], place[r["b"]]] = d[place[r["b"]], place[r["a"]]] = 1 - round(r["r"], 9)
    return [names[i] for i in leaf_order(linkage(d, method), len(names))]


def edge_table(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(src, dst, weight) of the entries other than 0 of an adjacency matrix, a row an array; columns count from 0."""
    each = rows.select(F.col(key).cast("long").alias("src"), F.posexplode(F.col(vec).cast("array<double>")).alias("dst", "weight"))
    return each.filter("weight <> 0").select("src", F.col("dst").cast("long").alias("dst"), "weight")


def resolution_search(find, wanted: int, low: float = 0.0, high: float = 3.0, steps: int = 20) -> tuple[float, DataFrame]:
    """(resolution, labels) with the wanted number of communities, by halving; that which came nearest if none has it.

    ``find(resolution)`` gives (id, community); a higher resolution gives more communities.
    """
    best = None
    for _ in range(steps):
        middle = (low + high) / 2
        labels = find(middle)
        n = labels.select("community").distinct().count()
        if best is None or abs(n - wanted) < best[0]:
            best = abs(n - wanted), middle, labels
        if n == wanted:
            break
        low, high = (middle, high) if n < wanted else (low, middle)
    if best is None:
        raise ValueError("no steps")
    return best[1], best[2]


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    return labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def rand_index(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index from the contingency table."""
    table = contingency(labels, a, b)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = table.agg(pairs("n").alias("both"), F.sum("n").alias("total"))
    left = table.groupBy("a").agg(F.sum("n").alias("m")).agg(pairs("m").alias("left"))
    right = table.groupBy("b").agg(F.sum("n").alias("m")).agg(pairs("m").alias("right"))
    one = cells.join(left).join(right)  # a row each
    expected = F.col("left") * F.col("right") / (F.col("total") * (F.col("total") - 1) / 2)
    return one.select(F.when((F.col("left") + F.col("right")) / 2 == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / ((F.col("left") + F.col("right")) / 2 - expected)).alias("ari"))


def v_measure(labels: DataFrame, truth: str, found: str) -> DataFrame:
    """One row: homogeneity, completeness and their harmonic mean."""
    table = contingency(labels, truth, found)
    total = F.sum("n").over(Window.partitionBy())  # the contingency table has a row a pair of labels
    row, col = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    t = table.select("a", "b", "n", total.alias("t"), row.alias("ra"), col.alias("cb"))
    mutual = t.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("t") * F.col("n") / (F.col("ra") * F.col("cb")))).alias("mi"))
    ha = t.select("a", "ra", "t").distinct().agg(-F.sum(F.col("ra") / F.col("t") * F.log(F.col("ra") / F.col("t")))).toDF("ha")
    hb = t.select("b", "cb", "t").distinct().agg(-F.sum(F.col("cb") / F.col("t") * F.log(F.col("cb") / F.col("t")))).toDF("hb")
    one = mutual.join(ha).join(hb)
    h = F.when(F.col("ha") > 0, F.col("mi") / F.col("ha")).otherwise(F.lit(1.0))
    c = F.when(F.col("hb") > 0, F.col("mi") / F.col("hb")).otherwise(F.lit(1.0))
    return one.select(h.alias("homogeneity"), c.alias("completeness"), F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(F.lit(0.0)).alias("v_measure"))


def prevalence_error(labels: DataFrame, truth: str, found: str) -> DataFrame:
    """One row: mean absolute and squared error of each item's cluster prevalence."""
    share = lambda c: labels.groupBy(c).agg(F.count(F.lit(1)).alias("k")).select(F.col(c), (F.col("k") / F.sum("k").over(Window.partitionBy())).alias(f"p_{c}"))
    both = labels.join(F.broadcast(share(truth)), truth).join(F.broadcast(share(found)), found)
    e = F.col(f"p_{truth}") - F.col(f"p_{found}")
    return both.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
