"""Clusterings at several resolutions, memberships, outliers, topic reduction, split tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve.functions.vectors import matrix, norm2, unit, vector_sum
from tasksieve.operators.features import group_terms
from tasksieve.operators.neighbours import density_cluster, density_levels, nearest, topics_of_level
from tasksieve.operators.topics import topic_coherence, with_centroid_similarity
from tasksieve.session import checkpointed, join_unique, numbered, small_side, top_per_group

#: Centres or sums of clusters that a worker holds at a time.
HELD_CLUSTERS = 20_000
#: Ids with their halves that are sent to the texts, if their bytes allow it.
HALF_ROWS = 2_000_000
#: Topics with the closest partners that the driver looks at in a round of merges.
MERGE_ROWS = 512
RESOLUTIONS = {"fine": (12, 1), "medium": (30, 3), "coarse": (60, 5)}


def cluster_multi_resolution(vec: DataFrame, resolutions: dict[str, int], id_col: str = "task_id",
                             vector: str = "embedding", seed: int = 42, bisecting: bool = False) -> DataFrame:
    """``(id, resolution, topic_id)``: the same vectors clustered into several numbers of topics."""
    data = vec.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    maker = BisectingKMeans if bisecting else KMeans
    parts = []
    for name, k in resolutions.items():
        model = maker(k=k, seed=seed, distanceMeasure="cosine", predictionCol="topic_id").fit(data)
        parts.append(model.transform(data).select(
            id_col, F.lit(name).alias("resolution"), F.col("topic_id").cast("bigint").alias("topic_id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def density_multi_resolution(vec: DataFrame, eps: float, resolutions: dict[str, tuple[int, int]] = RESOLUTIONS,
                             id_col: str = "task_id", vector: str = "embedding") -> DataFrame:
    """Density clusters at each ``(min_cluster_size, min_samples)``, from one neighbour join."""
    unique, member = density_levels(vec, eps, [ms for _, ms in resolutions.values()], id_col, vector)
    parts = [topics_of_level(vec, unique, member, ms, mcs, id_col, vector).withColumn("resolution", F.lit(name)) for name, (mcs, ms) in resolutions.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _blocks(table: DataFrame, key: str, rows: int):
    """A table in parts of about ``rows`` rows, dealt by the hash of ``key``; one part if it has no more."""
    n = -(-table.count() // rows)
    return [table] if n <= 1 else [table.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _unit_rows(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


class _Centres:
    """Unit centroids in blocks that a worker holds one at a time; rows pass all blocks and carry what they have seen so far."""

    def __init__(self, vec: DataFrame, centroids: DataFrame, id_col: str, topic: str, vector: str, block: int, cells: int = 1 << 22):
        table = checkpointed(centroids.select(topic, "centroid"))
        self.blocks = _blocks(table, topic, block)
        self.id_col, self.topic, self.vector, self.cells = id_col, topic, vector, cells
        self.kinds = f"`{id_col}` {vec.schema[id_col].dataType.simpleString()}, `{vector}` {vec.schema[vector].dataType.simpleString()}"
        self.topic_kind = centroids.schema[topic].dataType.simpleString()
        self.context = vec.sparkSession.sparkContext
        # the normaliser of each row: the sum of exp(cosine) over all topics; a cosine is at most 1, so no sum gets out of hand
        self.rows = vec.select(id_col, vector).withColumn("norm", F.lit(0.0))
        for part in self.blocks:
            self.rows = self._passed(self.rows, part, lambda pdf, e, ids: pdf.assign(norm=pdf["norm"].to_numpy() + e.sum(axis=1)), self.kinds + ", norm double")

    def _passed(self, rows: DataFrame, part: DataFrame, step, schema: str) -> DataFrame:
        """``step(rows, exp(cosine), topics)`` for slices of rows with one block; a slice times the block stays within ``cells`` doubles."""
        held = part.toPandas().sort_values(self.topic)  # one block
        shared = self.context.broadcast((held[self.topic].to_numpy(), _unit_rows(matrix(held["centroid"])) if len(held) else None))
        vector, cells = self.vector, self.cells

        def run(batches):
            ids, y = shared.value
            for pdf in batches:
                size = max(1, cells // max(1, len(ids)))
                for at in range(0, len(pdf), size):
                    some = pdf.iloc[at:at + size]
                    yield step(some, np.exp(_unit_rows(matrix(some[vector])) @ y.T) if len(ids) else np.zeros((len(some), 0)), ids)

        return rows.mapInPandas(run, schema)

    def all(self) -> DataFrame:
        id_col, topic = self.id_col, self.topic

        def each(pdf, e, ids):
            p = e / pdf["norm"].to_numpy()[:, None]
            return pd.DataFrame({id_col: np.repeat(pdf[id_col].to_numpy(), len(ids)), topic: np.tile(ids, len(pdf)), "prob": p.ravel()})

        schema = f"{self.kinds.split(', ')[0]}, `{topic}` {self.topic_kind}, prob double"
        parts = [self._passed(self.rows, part, each, schema) for part in self.blocks]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def best(self) -> DataFrame:
        def better(pdf, e, ids):
            if not len(ids):
                return pdf
            p = e / pdf["norm"].to_numpy()[:, None]
            at = np.argmax(np.round(p, 12), axis=1)
            value, name = p[np.arange(len(pdf)), at], ids[at]
            old, known = pdf["best_prob"].to_numpy(dtype=float), pdf["best_topic"]
            new, was = np.round(value, 12), np.round(np.where(np.isnan(old), -1.0, old), 12)
            take = (new > was) | ((new == was) & (pd.Series(name, index=known.index) < known).to_numpy())
            return pdf.assign(best_topic=known.where(~take, pd.Series(name, index=known.index)), best_prob=np.where(take, value, old))

        rows = self.rows.withColumns({"best_topic": F.lit(None).cast(self.topic_kind), "best_prob": F.lit(None).cast("double")})
        for part in self.blocks:
            rows = self._passed(rows, part, better, f"{self.kinds}, norm double, best_topic {self.topic_kind}, best_prob double")
        return rows.filter(F.col("best_topic").isNotNull()).select(self.id_col, "best_topic", "best_prob")


def soft_membership(vec: DataFrame, centroids: DataFrame, id_col: str = "task_id", topic: str = "topic_id",
                    vector: str = "embedding", block: int = HELD_CLUSTERS) -> DataFrame:
    """``(id, topic, prob)``: softmax of the cosine to every topic's centroid, for any number of topics.

    Rows pass blocks of ``block`` centroids twice, for the normaliser and for the probabilities, without a shuffle.
    """
    return _Centres(vec, centroids, id_col, topic, vector, block).all()


def best_topic(vec: DataFrame, centroids: DataFrame, id_col: str = "task_id", topic: str = "topic_id",
               vector: str = "embedding", block: int = HELD_CLUSTERS) -> DataFrame:
    """``(id, best_topic, best_prob)``: the top of ``soft_membership`` without its table, so nothing is shuffled.

    Rows carry the normaliser and the best topic so far through blocks of ``block`` centroids.
    Probabilities equal to twelve places are ties and go to the smaller topic.
    Without any topic there are no rows.
    """
    return _Centres(vec, centroids, id_col, topic, vector, block).best()


def binary_confidence(strength: Column, topic: Column) -> Column:
    return F.coalesce(F.round(strength, 4), F.when(topic == -1, 0.0).otherwise(1.0))


def best_membership(member: DataFrame, id_col: str = "task_id", topic: str = "topic_id") -> DataFrame:
    """``(id, best_topic, best_prob)``; ties go to the smaller topic.  A table that has these columns already stays as it is."""
    if "best_prob" in member.columns:
        return member
    return member.groupBy(id_col).agg(
        F.max(F.struct(F.col("prob"), (-F.col(topic)).alias("minus"))).alias("b")).select(
        id_col, (-F.col("b.minus")).alias("best_topic"), F.col("b.prob").alias("best_prob"))


def reassign_outliers(assign: DataFrame, member: DataFrame, id_col: str = "task_id", topic: str = "topic_id") -> DataFrame:
    """Outliers take the topic they most probably belong to, when that probability is above 0.

    ``member`` is the table of ``soft_membership`` or, without its shuffle, that of ``best_topic``.
    """
    joined = assign.join(best_membership(member, id_col, topic), id_col, "left")
    take = (F.col(topic) == -1) & (F.col("best_prob") > 0)
    return joined.select(
        *[F.when(take, F.col("best_topic")).otherwise(F.col(topic)).alias(topic) if c == topic else c for c in assign.columns],
        F.coalesce(take, F.lit(False)).alias("reassigned"))


def outlier_rate(assign: DataFrame, topic: str = "topic_id", target: float = 0.20) -> DataFrame:
    outliers = F.count_if(F.col(topic) == -1)
    return assign.agg(F.count("*").alias("docs"), F.count_if(F.col(topic) == -1).alias("outliers"),
                      (outliers * 100 / F.count("*")).alias("outlier_pct"), (outliers / F.count("*") < target).alias("target_met"))


def zero_shot_assign(vec: DataFrame, seeds: DataFrame, min_sim: float = 0.30, id_col: str = "task_id",
                     seed: str = "seed_id", vector: str = "embedding") -> DataFrame:
    """``(id, seed_id, sim)``: the nearest seed topic, or null below ``min_sim``."""
    unit_seeds = seeds.select(F.col(seed).alias(id_col), unit(vector).alias(vector))
    best = nearest(vec.select(id_col, unit(vector).alias(vector)), unit_seeds, 1, id_col, vector)
    return best.select(id_col, F.when(F.col("sim") >= min_sim, F.col("neighbour")).alias(seed), "sim")


def zero_shot_then_cluster(vec: DataFrame, seeds: DataFrame, eps: float, min_sim: float = 0.30,
                           min_samples: int = 3, min_cluster_size: int = 40, id_col: str = "task_id",
                           seed: str = "seed_id", vector: str = "embedding") -> DataFrame:
    """Seed topics first; what matches none is clustered and numbered after the seeds."""
    assigned = checkpointed(zero_shot_assign(vec, seeds, min_sim, id_col, seed, vector))
    after = seeds.agg((F.max(seed) + 1).alias("next")).scalar()
    rest = vec.join(assigned.filter(F.col(seed).isNull()).select(id_col), id_col, "left_semi")
    found = density_cluster(rest.select(id_col, unit(vector).alias(vector)), eps, min_samples, min_cluster_size, id_col, vector)
    return (assigned.filter(F.col(seed).isNotNull()).select(id_col, F.col(seed).cast("bigint").alias("topic_id"))
            .unionByName(found.select(id_col, F.when(F.col("topic_id") >= 0, F.col("topic_id") + after)
                                      .otherwise(-1).cast("bigint").alias("topic_id"))))


def _two_best(pairs: DataFrame, topic: str) -> DataFrame:
    """``(topic, first, s1, second, s2)`` from a few candidates ``(topic, partner, sim)`` of each topic; ties to the smaller partner."""
    ranked = pairs.groupBy(topic).agg(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("minus"), "partner"))).alias("p"))
    one, two = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return ranked.select(topic, one["partner"].alias("first"), (-one["minus"]).alias("s1"),
                         two["partner"].alias("second"), (-two["minus"]).alias("s2"))


def _partners(asked: DataFrame, pool: DataFrame, topic: str, k: int) -> DataFrame:
    """The closest ``k`` topics of ``pool`` for each topic asked, itself left out: ``(topic, partner, sim)``."""
    near = nearest(asked.select(topic, "u"), pool.select(topic, "u"), k, topic, "u")
    return near.filter(F.col("neighbour") != F.col(topic)).select(topic, F.col("neighbour").alias("partner"), F.round("sim", 9).alias("sim"))


def next_merges(rows: list, room: int) -> list[tuple]:
    """The pairs ``(a, b)`` that a merge of the closest pair, one after the other, is sure to take next.

    ``rows`` are ``(topic, length, first, s1, s2)`` of the topics with the closest partners, closest pair first.  The
    first pair is always next.  A topic merged from x and y has similarity ``(|x| cos(x, z) + |y| cos(y, z)) / |x + y|``
    with z, so the second best partners of x and y bound what it can reach; a further pair is taken only while
    it is closer than any new topic can be to anything.  What can't be told waits for the next round.
    """
    known = {r[0]: r for r in rows}
    gone: set = set()
    out: list[tuple] = []
    bound = -np.inf
    for topic, length, first, sim, second in rows:
        if len(out) == room:
            break
        if topic in gone:
            continue
        if first in gone:  # its next best partner is not known, but no closer than this
            bound = max(bound, second)
            continue
        other = known.get(first)
        sure = other is not None and other[2] == topic
        if out and not (sure and sim > bound):
            break
        out.append((topic, first))
        gone |= {topic, first}
        if not sure:
            break
        merged = np.sqrt(max(0.0, length ** 2 + other[1] ** 2 + 2 * length * other[1] * sim))
        reach = length * max(bound, second) + other[1] * max(bound, other[4]) + 1e-8 * (length + other[1])
        bound = max(bound, reach / merged + 1e-8) if merged > 0 else np.inf
    return out


def reduce_topics(assign: DataFrame, vec: DataFrame, n: int, id_col: str = "task_id", topic: str = "topic_id",
                  batch: int = MERGE_ROWS) -> DataFrame:
    """``(topic, merged_into)``: merge the two most similar topics until ``n`` are left.

    The rows are summed once per topic.  A merged topic's centroid is the sum of
    its parts, so each step works on the table of topics alone.  The smaller
    topic of a pair joins the larger one (ties: the larger id joins).  Topics without a direction (sum zero) are
    like each other and have similarity 0 with the rest.

    A table keeps the two best partners of every topic.  A round merges the closest pair and those that are sure to come
    next (``next_merges``), so that the merges are those of one by one.  Then only topics that were merged, or that
    had a partner among them, look for partners among all topics; the others meet the new topics only.  The driver sees
    ``batch`` rows without vectors a round; sums, partners and memberships stay in tables of the shared folder.
    """
    spark, kind = assign.sparkSession, assign.schema[topic].dataType.simpleString()

    def described(sums: DataFrame) -> DataFrame:
        length = F.sqrt(norm2(F.col("total")))
        off = F.when(F.col("length") > 0, 0.0).otherwise(1.0)
        return sums.select(topic, "n", "total", length.alias("length")).select("*", F.concat(unit("total"), F.array(off)).alias("u"))

    live = checkpointed(described(vector_sum(assign.filter(F.col(topic) != -1).select(id_col, topic).join(vec, id_col), [topic])))
    member = live.select(topic, F.col(topic).alias("merged_into"))
    left, goal = live.count(), max(n, 1)
    best = checkpointed(_two_best(_partners(live, live, topic, 3), topic)) if left > goal else None
    while left > goal:
        low, high = F.least(topic, "first"), F.greatest(topic, "first")
        closest = best.orderBy(F.desc("s1"), low, high, topic).limit(batch)
        sizes = live.select(topic, "n", "length")
        rows = (closest.join(sizes, topic).join(sizes.select(F.col(topic).alias("first"), F.col("n").alias("n_first")), "first")
                .orderBy(F.desc("s1"), low, high, topic).collect())
        size = {r[topic]: r["n"] for r in rows} | {r["first"]: r["n_first"] for r in rows}
        pairs = next_merges([(r[topic], r["length"], r["first"], r["s1"], -1.0 if r["s2"] is None else r["s2"]) for r in rows], left - goal)
        moves = []
        for a, b in ((min(p), max(p)) for p in pairs):
            moves.append((b, a) if size[a] >= size[b] else (a, b))
        left -= len(moves)
        # At most ``batch`` rows each.
        moved = F.broadcast(spark.createDataFrame(moves, f"__drop {kind}, __keep {kind}"))
        kept = F.broadcast(spark.createDataFrame([(k,) for _, k in moves], f"`{topic}` {kind}"))
        touched = [F.lit(t) for move in moves for t in move]
        member = checkpointed(member.join(moved, F.col("merged_into") == F.col("__drop"), "left")
                              .select(topic, F.coalesce("__keep", "merged_into").alias("merged_into")))
        if left <= goal:
            break
        gained = (live.join(moved, F.col(topic) == F.col("__drop"))
                  .select(F.col("__keep").alias(topic), F.col("n").alias("n_more"), F.col("total").alias("more")))
        grown = live.join(F.broadcast(gained), topic).select(
            topic, (F.col("n") + F.col("n_more")).alias("n"), F.zip_with("total", "more", lambda x, y: x + y).alias("total"))
        live = checkpointed(live.filter(~F.col(topic).isin(touched)).unionByName(described(grown)))
        stale = F.col("first").isin(touched) | F.coalesce(F.col("second").isin(touched), F.lit(False))
        steady = best.filter(~F.col(topic).isin(touched) & ~stale)
        asked = live.join(steady.select(topic), topic, "left_anti")
        calm = live.join(steady.select(topic), topic, "left_semi")
        offers = (steady.select(topic, F.col("first").alias("partner"), F.col("s1").alias("sim"))
                  .unionByName(steady.filter("second IS NOT NULL").select(topic, F.col("second").alias("partner"), F.col("s2").alias("sim")))
                  .unionByName(_partners(calm, live.join(kept, topic, "left_semi"), topic, 2))
                  .unionByName(_partners(asked, live, topic, 3)))
        best = checkpointed(_two_best(offers, topic))
    return member


def representative_docs(assign: DataFrame, vec: DataFrame, docs: DataFrame, k: int = 3, id_col: str = "task_id",
                        topic: str = "topic_id", name: str = "name") -> DataFrame:
    """``(topic, rank, id, name, sim)``: ``k`` rows for every topic but the outliers, one per distinct name.

    Names of the rows closest to the centre come first, then those of rows without a vector in the order of
    their ids; what is still missing is filled up by empty names without id.
    """
    own = assign.filter(F.col(topic) != -1).select(id_col, topic)
    near = with_centroid_similarity(own, vec, id_col, topic).select(id_col, topic, "sim")
    far = own.join(vec.select(id_col), id_col, "left_anti").select(id_col, topic, F.lit(None).cast("double").alias("sim"))
    named = near.unionByName(far).join(docs.select(id_col, name), id_col).filter(F.col(name) != "")
    minus = F.coalesce(-F.round("sim", 9), F.lit(2.0))  # after all cosines
    best = F.min(F.struct(minus.alias("minus"), F.col(id_col), "sim")).alias("b")
    distinct = named.groupBy(topic, name).agg(best).select(
        topic, name, F.col(f"b.{id_col}").alias(id_col), F.col("b.sim").alias("sim"), F.col("b.minus").alias("__minus"))
    ranked = top_per_group(distinct, [topic], [F.asc("__minus"), F.asc(id_col)], k)
    places = own.select(topic).distinct().withColumn("rank", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))))
    return places.join(ranked, [topic, "rank"], "left").select(topic, "rank", id_col, F.coalesce(name, F.lit("")).alias(name), "sim")


def _held_sums(sums: DataFrame, keys: list[str]) -> dict:
    """Cluster sums by key, of one block of clusters."""
    return {tuple(r[k] for k in keys): (r["n"], np.asarray(r["total"])) for r in sums.collect()}


def silhouette_rows(assign: DataFrame, vec: DataFrame, id_col: str = "task_id", topic: str = "topic_id",
                    within: str | None = None, vector: str = "embedding", block: int = HELD_CLUSTERS) -> DataFrame:
    """``(id, topic, silhouette)``: cosine silhouette of every row, exact and without pairs.

    The mean cosine distance of a row to a cluster is ``1 - u . S / n``, so only the
    sum ``S`` and the size ``n`` of each cluster are needed.  ``within`` scores the
    clusters of each group apart (say, the halves of each topic).  Rows pass the sums in blocks of about ``block``
    clusters and carry the distance to their own and the least to another one, so there may be any number of clusters.
    """
    keys = [within, topic] if within else [topic]
    rows = assign.select(id_col, *keys).join(vec.select(id_col, unit(vector).alias("u")), id_col)
    sums = checkpointed(vector_sum(rows, keys, "u"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [id_col, *keys])
    schema = fields + ", u array<double>, own double, other double, mates bigint"
    state = rows.select(id_col, *keys, F.col("u").cast("array<double>").alias("u"), F.lit(None).cast("double").alias("own"),
                        F.lit(None).cast("double").alias("other"), F.lit(0).cast("bigint").alias("mates"))

    def passed(state: DataFrame, held: dict) -> DataFrame:
        shared = vec.sparkSession.sparkContext.broadcast(held)

        def run(batches):
            groups: dict = {}
            for key, value in shared.value.items():
                groups.setdefault(key[0] if within else None, {})[key[-1]] = value
            packed = {g: (pd.Index(list(cs)), np.array([c[0] for c in cs.values()]), np.stack([c[1] for c in cs.values()])) for g, cs in groups.items()}
            for pdf in batches:
                own, other = pdf["own"].to_numpy(dtype=float).copy(), pdf["other"].to_numpy(dtype=float).copy()
                mates = pdf["mates"].to_numpy().copy()
                owner = pdf[within].to_numpy() if within else np.full(len(pdf), None)
                for group in pd.unique(owner):
                    if group not in packed:
                        continue
                    names, n, total = packed[group]
                    every = np.flatnonzero(owner == group) if within else np.arange(len(pdf))
                    step = max(1, (1 << 22) // len(names))
                    for start in range(0, len(every), step):
                        at = every[start:start + step]
                        x = matrix(pdf["u"].iloc[at])
                        dots = x @ total.T
                        mine = names.get_indexer(pdf[topic].to_numpy()[at])
                        has = np.flatnonzero(mine >= 0)
                        apart = 1 - dots / n
                        apart[has, mine[has]] = np.inf
                        other[at] = np.fmin(other[at], apart.min(axis=1))
                        few = n[mine[has]] - 1
                        square = np.einsum("ij,ij->i", x[has], x[has])
                        own[at[has]] = 1 - np.divide(dots[has, mine[has]] - square, few, out=np.zeros(len(has)), where=few > 0)
                        mates[at[has]] = few
                yield pdf.assign(own=own, other=other, mates=mates)

        return state.mapInPandas(run, schema)

    for part in _blocks(sums, keys[0], block):
        state = passed(state, _held_sums(part, keys))
    own, other = F.col("own"), F.col("other")
    alone = F.col("mates") <= 0
    lone = other.isNull() | F.isnan(other) | (other == float("inf"))  # no other cluster
    top = F.greatest(own, other)
    score = F.when(alone | lone | (top <= 0), 0.0).otherwise((other - own) / top)
    return state.select(id_col, *keys, score.alias("silhouette"))


def silhouette(assign: DataFrame, vec: DataFrame, id_col: str = "task_id", topic: str = "topic_id") -> DataFrame:
    """One row: mean silhouette over all rows."""
    return silhouette_rows(assign, vec, id_col, topic).agg(F.avg("silhouette").alias("silhouette"))


def _packed(id_col: str, topic: str):
    """Rows ``(id, topic, x)`` of an Arrow batch as one row a topic, with the ids and the bytes of their vectors."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                groups = list(pdf.groupby(topic, sort=False))
                yield pd.DataFrame({topic: [name for name, _ in groups], "ids": [g[id_col].tolist() for _, g in groups],
                                    "x": [matrix(g["x"]).tobytes() for _, g in groups]})

    return run


def halve_topics(assign: DataFrame, vec: DataFrame, id_col: str = "task_id", topic: str = "topic_id",
                 vector: str = "embedding", rounds: int | None = None, block: int = HELD_CLUSTERS) -> DataFrame:
    """``(id, topic, half)``: 2-means inside every topic, all topics in one job per round.

    Vectors are stored as bytes, a batch's rows of a topic in one row.  A round assigns each to the nearer of its topic's two
    centres; a task passes on one sum per half, so a topic of any size is spread over all tasks.
    Starts from the row least like the topic's centre and the row least like that,
    and goes on until no centre moves (or ``rounds``, if given, are over).  Topics know nothing of each
    other, so more than ``block`` of them are halved in several runs; the driver holds the centres of one.
    """
    named = checkpointed(assign.filter(F.col(topic) != -1).select(topic).distinct())
    parts = _blocks(named, topic, block)
    if len(parts) > 1:
        halved = [halve_topics(assign.join(part, topic, "left_semi"), vec, id_col, topic, vector, rounds, max(block, part.count())) for part in parts]
        out = halved[0]
        for more in halved[1:]:
            out = out.unionByName(more)
        return out
    rows = (assign.filter(F.col(topic) != -1).select(id_col, topic)
            .join(vec.select(id_col, F.col(vector).cast("array<double>").alias("x")), id_col))
    context = vec.sparkSession.sparkContext
    kind = rows.schema[topic].dataType.simpleString()
    id_kind = rows.schema[id_col].dataType.simpleString()
    packs = checkpointed(rows.mapInPandas(_packed(id_col, topic), f"`{topic}` {kind}, ids array<{id_kind}>, x binary"))

    def unpacked(batches):
        for pdf in batches:
            for name, ids, x in zip(pdf[topic], pdf["ids"], pdf["x"]):
                yield name, ids, np.frombuffer(x).reshape(len(ids), -1)

    def farthest(centres: dict) -> dict:
        shared = context.broadcast(centres)

        def run(batches):
            for name, ids, x in unpacked(batches):  # the first of each pack
                away = np.round(((x - shared.value[name]) ** 2).sum(axis=1), 9)
                far = np.where(np.isnan(away), -np.inf, away)
                at = min(np.flatnonzero(far == far.max()), key=lambda i: ids[i])
                yield pd.DataFrame({id_col: [ids[at]], topic: [name], "x": [x[at]], "away": [away[at]]})

        measured = packs.mapInPandas(run, f"`{id_col}` {id_kind}, `{topic}` {kind}, x array<double>, away double")
        best = top_per_group(measured, [topic], [F.desc("away"), F.asc(id_col)], 1)
        return {r[topic]: np.asarray(r["x"]) for r in best.collect()}  # one row per topic

    def sides(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        d = ((x[:, None, :] - centres) ** 2).sum(axis=2)
        return (d[:, 1] < d[:, 0]).astype("int32")

    def sums(centres: dict | None) -> dict:
        """Rows and vector sum of each topic or, with two centres of each, of its halves; a task adds up what it has."""
        shared = context.broadcast(centres)

        def run(batches):
            held: dict = {}
            for name, ids, x in unpacked(batches):
                half = sides(x, shared.value[name]) if shared.value else np.zeros(len(x), dtype="int32")
                for h in np.unique(half):
                    some = x[half == h]
                    n, total = held.get((name, h), (0, 0.0))
                    held[name, h] = n + len(some), total + some.sum(axis=0)
            if held:
                yield pd.DataFrame({topic: [k[0] for k in held], "half": [k[1] for k in held], "n": [float(v[0]) for v in held.values()],
                                    "total": [v[1] for v in held.values()]})

        parts = packs.mapInPandas(run, f"`{topic}` {kind}, half int, n double, total array<double>")
        gathered = F.array_sort(F.collect_list(F.struct("n", "total")))  # a row a task
        total = F.aggregate(F.slice("p", 2, F.size("p")), F.col("p")[0]["total"], lambda acc, p: F.zip_with(acc, p["total"], lambda x, y: x + y))
        whole = parts.groupBy(topic, "half").agg(F.sum("n").alias("n"), gathered.alias("p")).select(topic, "half", "n", total.alias("total"))
        return _held_sums(whole, [topic, "half"])

    middle = {k[0]: total / n for k, (n, total) in sums(None).items()}
    first = farthest(middle)
    centres = {t: np.stack([first[t], c]) for t, c in farthest(first).items()}

    seen, done = set(), 0
    while rounds is None or done < rounds:
        done += 1
        halves = sums(centres)
        moved = {t: np.stack([halves[t, h][1] / halves[t, h][0] if (t, h) in halves else c[h] for h in (0, 1)])
                 for t, c in centres.items()}
        still = all(np.allclose(moved[t], centres[t], atol=1e-9) for t in centres)
        centres = moved
        # Centres that come back (ties decided by rounding) would go round for ever.
        state = hash(tuple(np.round(centres[t], 9).tobytes() for t in sorted(centres)))
        if still or state in seen:
            break
        seen.add(state)
    shared = context.broadcast(centres)

    def placed(batches):
        for name, ids, x in unpacked(batches):
            yield pd.DataFrame({id_col: ids, topic: np.full(len(ids), name), "half": sides(x, shared.value[name])})

    return packs.mapInPandas(placed, f"`{id_col}` {id_kind}, `{topic}` {kind}, half int")


def split_test(assign: DataFrame, vec: DataFrame, docs: DataFrame, text: str = "cleaned_text", min_docs: int = 30,
               threshold: float = 0.15, strong: float = 0.4, id_col: str = "task_id", topic: str = "topic_id",
               stop=()) -> DataFrame:
    """``(topic, n, split_recommended, strength, silhouette, sub_a_count, sub_b_count, sub_a_keywords, sub_b_keywords, reason)``.

    A topic with fewer than ``min_docs`` rows is reported as too small.
    """
    sizes = assign.filter(F.col(topic) != -1).groupBy(topic).agg(F.count("*").alias("n"))
    big = assign.join(sizes.filter(F.col("n") >= min_docs).select(topic), topic, "left_semi")
    split = checkpointed(halve_topics(big, vec, id_col, topic))
    scores = silhouette_rows(split, vec, id_col, "half", within=topic)
    stats = scores.groupBy(topic).agg(
        F.avg("silhouette").alias("silhouette"), F.count_if(F.col("half") == 0).alias("sub_a_count"),
        F.count_if(F.col("half") == 1).alias("sub_b_count"))
    # ids and halves are sent to the texts, which are neither sorted nor shuffled for the join
    texts = docs.select(id_col, text).join(small_side(split, HALF_ROWS, "shuffle_hash"), id_col)
    terms = group_terms(texts, text, [topic, "half"], id_col, (1, 2), stop=stop).filter(F.col("df") >= 2)
    words = top_per_group(terms, [topic, "half"], [F.desc("tf"), F.asc("term")], 5)

    def words_of(half: int) -> Column:
        chosen = F.collect_list(F.when(F.col("half") == half, F.struct("rank", "term")))
        return F.array_join(F.transform(F.array_sort(chosen), lambda t: t["term"]), ", ")

    keywords = words.groupBy(topic).agg(words_of(0).alias("a"), words_of(1).alias("b"))
    sil = F.coalesce("silhouette", F.lit(0.0))
    enough = F.col("n") >= min_docs
    yes = enough & (sil > threshold)
    return (sizes.join(stats, topic, "left").join(keywords, topic, "left").select(
        topic, "n", yes.alias("split_recommended"),
        F.when(yes & (sil > strong), "STRONG").when(yes, "MODERATE").otherwise("NONE").alias("strength"),
        sil.alias("silhouette"), F.coalesce("sub_a_count", F.lit(0)).alias("sub_a_count"),
        F.coalesce("sub_b_count", F.lit(0)).alias("sub_b_count"),
        F.when(F.col("sub_a_count") >= 5, F.coalesce("a", F.lit(""))).otherwise("").alias("sub_a_keywords"),
        F.when(F.col("sub_b_count") >= 5, F.coalesce("b", F.lit(""))).otherwise("").alias("sub_b_keywords"),
        F.when(~enough, "Too few docs").otherwise(F.format_string("Silhouette=%.3f %s threshold", sil, F.when(yes, ">").otherwise("<")))
        .alias("reason")))


def objective(max_outlier: float = 0.10, min_topics: int = 5) -> Column:
    """The score of a clustering from its columns ``topics``, ``coherence`` and ``outlier_rate``."""
    topics = F.col("topics")
    penalty = F.when(topics > 80, (topics - 80) * 0.005).when(topics < 20, (20 - topics) * 0.01).otherwise(0.0)
    return (F.when(F.col("outlier_rate") > max_outlier, -1.0 + (max_outlier - F.col("outlier_rate")))
            .when((topics < min_topics) | F.col("coherence").isNull(), -2.0)
            .otherwise(F.col("coherence") - penalty))


def sweep_objective(assign: DataFrame, vec: DataFrame, max_outlier: float = 0.10, min_topics: int = 5,
                    id_col: str = "task_id", topic: str = "topic_id") -> DataFrame:
    """One row: mean coherence minus a penalty on the number of topics.

    More outliers than allowed score ``-1 + (allowed - rate)``, too few topics -2.
    """
    shares = assign.agg(F.count("*").alias("docs"), F.count_if(F.col(topic) == -1).alias("outliers"))
    rate = shares.select(F.col("outliers") / F.col("docs")).scalar()
    coherence = topic_coherence(assign, vec, id_col, topic)
    stats = coherence.agg(F.count("*").alias("topics"), F.avg(F.when(F.col("n") > 1, F.col("coherence"))).alias("coherence"))
    return stats.withColumn("outlier_rate", rate).withColumn("objective", objective(max_outlier, min_topics))


def sweep_params(vec: DataFrame, eps: float, min_cluster_sizes=range(5, 21), min_samples=range(1, 6),
                 max_outlier: float = 0.10, reduced: DataFrame | None = None, id_col: str = "task_id") -> DataFrame:
    """``(min_cluster_size, min_samples, topics, coherence, outlier_rate, objective)`` for a grid.

    Clusters are found on ``reduced`` (shared by all trials) and scored on ``vec``.  All densities come
    from one neighbour join and one spanning forest (``density_levels``).  The size limit only turns small clusters into
    noise, so every cluster of every density is scored once, and the trials are sums over the table of clusters.
    """
    sizes = F.array(*[F.lit(int(s)) for s in min_cluster_sizes])
    levels = sorted({int(ms) for ms in min_samples})
    space = checkpointed(reduced if reduced is not None else vec)
    unique, member = density_levels(space, eps, levels, id_col)
    placed = unique.select("pid", "x", "w").join(member, "pid")
    names = numbered(placed.select("level", "component").distinct(), [F.asc("level"), F.asc("component")], "topic_id")
    # a copy of a vector is in the clusters of that vector, one a level at most
    homes = (placed.join(names, ["level", "component"]).groupBy("x", "w").agg(F.collect_list("topic_id").alias("topics")))
    rows = join_unique(space.select(id_col, F.col("embedding").alias("x")), homes, "x", "w")
    found = checkpointed(rows.select(id_col, F.explode("topics").alias("topic_id")))
    scored = checkpointed(topic_coherence(found, vec, id_col).join(names.select("topic_id", "level"), "topic_id").select("level", "n", "coherence"))
    grid = (scored.select("level", "n", "coherence", F.explode(sizes).alias("min_cluster_size")).filter("n >= min_cluster_size")
            .groupBy("min_cluster_size", F.col("level").alias("min_samples")).agg(
                F.count("*").alias("topics"), F.sum("n").alias("inside"), F.avg(F.when(F.col("n") > 1, F.col("coherence"))).alias("coherence")))
    trials = (space.agg(F.count("*").alias("docs")).withColumn("min_cluster_size", F.explode(sizes))
              .withColumn("min_samples", F.explode(F.array(*[F.lit(m) for m in levels]))))
    rate = (F.col("docs") - F.coalesce("inside", F.lit(0))) / F.col("docs")
    out = (trials.join(F.broadcast(grid), ["min_cluster_size", "min_samples"], "left")  # one row a trial
           .select("min_cluster_size", "min_samples", F.coalesce("topics", F.lit(0)).cast("bigint").alias("topics"), "coherence", rate.alias("outlier_rate"))
           .withColumn("objective", objective(max_outlier)))
    return out.orderBy(F.desc("objective"), "min_cluster_size", "min_samples")
