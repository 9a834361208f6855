"""K-means steps and BFR clustering over chunks of points (id, vec array<double>).

Clusters are sufficient statistics (n, sum, sumsq), a table of at most a few times k rows;
points are only ever read by distributed jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.functions.storage import kept


def euclidean(a: Column, b: Column) -> Column:
    """Distance; null for vectors of unlike length."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(squares))


def mahalanobis(v: Column, n: Column, total: Column, sumsq: Column) -> Column:
    """Normalised distance to a cluster; a deviation of 0 counts as 1."""
    term = lambda x, i: (x - total[i] / n) / F.when(F.sqrt(F.greatest(sumsq[i] / n - (total[i] / n) * (total[i] / n), F.lit(0.0))) > 0, F.sqrt(F.greatest(sumsq[i] / n - (total[i] / n) * (total[i] / n), F.lit(0.0)))).otherwise(F.lit(1.0))
    return F.sqrt(F.aggregate(F.transform(v, term), F.lit(0.0), lambda s, x: s + x * x))


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, dist): nearest centre (cluster, vec), ties to the smallest cluster.

    The centres are k rows, broadcast; the minimum is taken inside each point's task.
    """
    c = centres.select(F.struct("cluster", "vec").alias("c")).agg(F.collect_list("c").alias("cs"))
    all_d = F.transform("cs", lambda x: F.struct(F.round(euclidean(F.col("vec"), x["vec"]), 9).alias("dist"), x["cluster"].alias("cluster")))
    return points.crossJoin(F.broadcast(c)).select("id", F.array_min(all_d).alias("m")).select("id", "m.cluster", "m.dist")


def cluster_stats(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, dim, n, total, sumsq) in long form."""
    each = points.join(assigned.select("id", "cluster"), "id").select("cluster", F.posexplode("vec").alias("dim", "x"))
    return each.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))


def packed(stats: DataFrame) -> DataFrame:
    """(cluster, n, total, sumsq) with arrays over the dimensions."""
    rows = stats.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "total", "sumsq"))).alias("s"))
    return rows.select("cluster", "n", F.col("s.total").alias("total"), F.col("s.sumsq").alias("sumsq"))


def means(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, vec): mean of each cluster's points."""
    return packed(cluster_stats(points, assigned)).select("cluster", F.transform("total", lambda x: x / F.col("n")).alias("vec"))


def farthest_first(points: DataFrame, k: int, first: int | None = None) -> DataFrame:
    """(cluster, vec): the smallest id, then again and again the point farthest from those chosen (ties to the smallest id)."""
    spark = points.sparkSession
    start = points.orderBy("id").limit(1) if first is None else points.filter(F.col("id") == first)
    chosen = [r.vec for r in start.collect()]
    while chosen and len(chosen) < k:
        c = F.array(*(F.array(*map(F.lit, v)) for v in chosen))
        far = points.select("id", "vec", F.round(F.array_min(F.transform(c, lambda x: euclidean(F.col("vec"), x))), 9).alias("d")).orderBy(F.desc("d"), "id").limit(1).first()
        if not far.d:
            break
        chosen.append(far.vec)
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(chosen)], "cluster int, vec array<double>")


def kmeans(points: DataFrame, k: int, tol: float = 30.0) -> DataFrame:
    """(id, cluster): farthest-first start, then Lloyd steps until the centres move by ``tol`` in sum or less."""
    spark = points.sparkSession
    centres = farthest_first(points, k)
    held = {r.cluster: np.array(r.vec) for r in centres.collect()}
    while held:
        new = {r.cluster: np.array(r.vec) for r in means(points, nearest(points, centres)).collect()}
        moved = sum(float(np.linalg.norm(new[c] - held[c])) for c in new)
        held |= new
        centres = spark.createDataFrame([(c, v.tolist()) for c, v in sorted(held.items())], "cluster int, vec array<double>")
        if not moved > tol:
            break
    return nearest(points, centres).select("id", "cluster") if held else points.select("id", F.lit(0).alias("cluster")).limit(0)


@dataclass
class Stats:
    n: int
    total: np.ndarray
    sumsq: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    def plus(self, o: Stats) -> Stats:
        return Stats(self.n + o.n, self.total + o.total, self.sumsq + o.sumsq)

    def distance(self, v: np.ndarray) -> float:
        dev = np.sqrt(np.maximum(self.sumsq / self.n - self.mean**2, 0))
        return float(np.sqrt((((v - self.mean) / np.where(dev > 0, dev, 1)) ** 2).sum()))


def _collected(points: DataFrame, assigned: DataFrame) -> dict[int, Stats]:
    return {r.cluster: Stats(r.n, np.array(r.total), np.array(r.sumsq)) for r in packed(cluster_stats(points, assigned)).collect()}


def _within(points: DataFrame, clusters: dict[int, Stats], limit: float, spark: SparkSession) -> DataFrame:
    """(id, vec, cluster): nearest cluster by normalised distance if under the limit, else null."""
    if not clusters:
        return points.select("id", "vec", F.lit(None).cast("int").alias("cluster"))
    rows = [(c, s.n, s.total.tolist(), s.sumsq.tolist()) for c, s in sorted(clusters.items())]
    table = spark.createDataFrame(rows, "cluster int, n long, total array<double>, sumsq array<double>").select(F.struct("*").alias("c")).agg(F.collect_list("c").alias("cs"))
    d = F.transform("cs", lambda c: F.struct(F.round(mahalanobis(F.col("vec"), c["n"], c["total"], c["sumsq"]), 9).alias("d"), c["cluster"].alias("cluster")))
    near = points.crossJoin(F.broadcast(table)).select("id", "vec", F.array_min(d).alias("m"))
    return near.select("id", "vec", F.when(F.col("m.d") < limit, F.col("m.cluster")).alias("cluster"))


def _compressed(retained: DataFrame, k: int, next_id: int) -> tuple[DataFrame, dict[int, Stats], DataFrame]:
    """k-means over the retained points: (points with cluster, statistics) of clusters of two or more, and the rest."""
    got = kept(kmeans(retained, k), "retained-kmeans")
    large = got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cluster")
    member = kept(retained.join(got.join(large, "cluster", "left_semi"), "id").withColumn("cluster", F.col("cluster") + next_id), "compressed")
    rest = kept(retained.join(member.select("id"), "id", "left_anti").select("id", "vec"), "retained")
    return member, _collected(member.select("id", "vec"), member), rest


def bfr(points: DataFrame, chunk: str, k: int, alpha: float = 2.0, fanout: int = 3, sample_percent: int = 60) -> tuple[DataFrame, DataFrame]:
    """BFR clustering of points (id, vec, chunk), chunk by chunk: (rounds, membership).

    Chunk 0: a hashed sample is clustered into ``fanout * k`` groups, whose singletons are set aside
    (retained); k-means over the others gives the k discard clusters.  Each further chunk joins the
    nearest discard cluster within ``alpha * sqrt(d)``, else the nearest compression cluster, else the
    retained set; all of a chunk is judged on the statistics as they stood before it.  Then the retained
    set is clustered anew, and compression clusters within the threshold of each other merge.  After the
    last chunk compression clusters join their nearest discard cluster, before that round's counts are
    taken; retained points are cluster -1.
    """
    spark = points.sparkSession
    chunks = [r[0] for r in points.select(chunk).distinct().orderBy(chunk).collect()]
    member_schema, round_schema = "id long, cluster int", "round_id int, nof_cluster_discard int, nof_point_discard long, nof_cluster_compression int, nof_point_compression long, nof_point_retained long"
    if not chunks:
        return spark.createDataFrame([], round_schema), spark.createDataFrame([], member_schema)
    data = lambda c: points.filter(F.col(chunk) == F.lit(c)).select("id", "vec")
    first = kept(data(chunks[0]), "chunk")
    limit = alpha * float(np.sqrt(len(first.first().vec)))
    sample = first.filter(F.pmod(F.xxhash64("id"), F.lit(100)) < sample_percent)
    groups = kept(kmeans(sample, fanout * k), "groups")
    lone = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.first("id").alias("id")).filter("n = 1").select("id")
    retained = kept(first.join(lone, "id", "left_semi"), "retained")
    discard = kept(first.join(lone, "id", "left_anti").join(kmeans(first.join(lone, "id", "left_anti"), k), "id"), "discard")
    ds = _collected(discard.select("id", "vec"), discard)
    placed, cs, origin, next_id = discard.select("id", F.col("cluster").alias("d"), F.lit(None).cast("int").alias("c")), {}, {}, 0
    rounds = []

    def compress():
        nonlocal retained, placed, next_id
        member, stats, retained = _compressed(retained, fanout * k, next_id)
        placed = placed.unionByName(member.select("id", F.lit(None).cast("int").alias("d"), F.col("cluster").alias("c")))
        cs.update(stats)
        next_id += fanout * k

    def count(i):
        rounds.append((i, len(ds), sum(s.n for s in ds.values()), len(cs), sum(s.n for s in cs.values()), retained.count()))

    compress()
    if len(chunks) > 1:
        count(0)
    for i, name in enumerate(chunks[1:], 1):
        got = kept(_within(data(name), ds, limit, spark), "near-discard")
        near = got.filter("cluster IS NOT NULL")
        for c, s in _collected(near.select("id", "vec"), near).items():
            ds[c] = ds[c].plus(s)
        placed = placed.unionByName(near.select("id", F.col("cluster").alias("d"), F.lit(None).cast("int").alias("c")))
        far = kept(_within(got.filter("cluster IS NULL").select("id", "vec"), cs, limit, spark), "near-compressed")
        mine = far.filter("cluster IS NOT NULL")
        for c, s in _collected(mine.select("id", "vec"), mine).items():
            cs[c] = cs[c].plus(s)
        placed = placed.unionByName(mine.select("id", F.lit(None).cast("int").alias("d"), F.col("cluster").alias("c")))
        retained = kept(retained.unionByName(far.filter("cluster IS NULL").select("id", "vec")), "retained")
        compress()
        for a in sorted(cs):
            for b in sorted(cs):
                if a < b and a in cs and b in cs and cs[a].distance(cs[b].mean) < limit:
                    cs[a] = cs[a].plus(cs.pop(b))
                    origin[b] = a
        placed = kept(placed, "placed")
        if i < len(chunks) - 1:
            count(i)
    # the last round's row is taken after its compression clusters have joined their discard clusters
    joins = {}
    for c in sorted(cs):
        joins[c] = min(sorted(ds), key=lambda d: round(ds[d].distance(cs[c].mean), 9))
        ds[joins[c]] = ds[joins[c]].plus(cs[c])
    cs.clear()
    count(len(chunks) - 1)

    def final(c):
        while c in origin:
            c = origin[c]
        return joins[c]

    target = spark.createDataFrame([(c, final(c)) for c in sorted({*joins, *origin})], "c int, t int")
    membership = placed.join(F.broadcast(target), "c", "left").select("id", F.coalesce("d", "t").alias("cluster")).unionByName(retained.select("id", F.lit(-1).alias("cluster")))
    return spark.createDataFrame(rounds, round_schema), membership
