"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasksieve.llm.common import components
from tasksieve.session import checkpointed

THRESHOLD = 0.98
#: Chance that a pair at the threshold meets in no table.
MISS = 1e-5
#: Vectors of a bucket that are compared as one block.
BLOCK = 1024


def table_shape(threshold: float, rows: int, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): about as many buckets as rows, and as many tables as the chance of a miss asks for.

    Two vectors at an angle a agree on a random hyperplane's sign with probability 1 - a / pi.
    """
    bits = max(12, math.ceil(math.log2(max(rows, 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


class Planes:
    """Random hyperplanes; they depend on seed, table and dimension only, and are drawn once a task."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed = bits, tables, seed
        self.drawn: dict[tuple[int, int], np.ndarray] = {}

    def of(self, dim: int, t: int) -> np.ndarray:
        if (dim, t) not in self.drawn:
            self.drawn[dim, t] = np.random.default_rng([self.seed, t]).standard_normal((dim, self.bits))
        return self.drawn[dim, t]

    def signatures(self, x: np.ndarray, tables: int) -> np.ndarray:
        """Bucket numbers of unit vectors in the first ``tables`` tables, one column each."""
        out = np.empty((len(x), tables), np.int64)
        weights = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        for t in range(tables):
            out[:, t] = (x @ self.of(x.shape[1], t) > 0) @ weights
        return out


def _unit(values: list, dim: int) -> np.ndarray:
    x = np.asarray(values, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(vectors: list) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for k, v in enumerate(vectors):
        found.setdefault(len(v), []).append(k)
    return found


def _local_components(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links with a true diagonal, the least row reachable."""
    head = np.arange(len(close))
    while True:
        least = np.where(close, head[None, :], len(close)).min(axis=1)
        least = least[least]
        if (least == head).all():
            return head
        head = least


def _compare(threshold: float, planes: Planes):
    """Worker: reads blocks of a bucket (sorted by bucket, pair of blocks) and reports weights and links.

    A row's weight is how many vectors it is linked to that it did not meet in an earlier table.
    """
    def finish(rows, out):
        t, left, right = rows[0]["table"], [r for r in rows if r["side"] < 2], [r for r in rows if r["side"] != 1]
        x, y = (np.array([r["x"] for r in part], np.float64) for part in (left, right))
        if not len(x) or not len(y):
            return
        x, y = _unit(x, x.shape[1]), _unit(y, y.shape[1])
        close = x @ y.T >= threshold
        ids_x, ids_y = np.array([r["cls"] for r in left]), np.array([r["cls"] for r in right])
        same = ids_x[:, None] == ids_y[None, :]
        i, j = np.nonzero(close & ~same)
        if not len(i):
            return
        # count a pair in the first table in which it meets
        s_x, s_y = planes.signatures(x, t + 1), planes.signatures(y, t + 1)
        fresh = (s_x[i] == s_y[j]).argmax(axis=1) == t
        n_x, n_y = np.array([r["n"] for r in left]), np.array([r["n"] for r in right])
        weight_x, weight_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        np.add.at(weight_x, i[fresh], n_y[j[fresh]])
        if rows[0]["pair"][0] == rows[0]["pair"][1]:
            head = _local_components(close | same)
            linked = ids_x[head]
            out += [(int(c), int(w), int(h)) for c, w, h in zip(ids_x, weight_x, linked) if w or h != c]
        else:
            np.add.at(weight_y, j[fresh], n_x[i[fresh]])
            # both sides as one graph
            n = len(x)
            both = np.zeros((n + len(y),) * 2, bool)
            both[:n, n:] = close
            both[n:, :n] = close.T
            np.fill_diagonal(both, True)
            ids, weight = np.concatenate([ids_x, ids_y]), np.concatenate([weight_x, weight_y])
            linked = ids[_local_components(both)]
            out += [(int(c), int(w), int(h)) for c, w, h in zip(ids, weight, linked) if w or h != c]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["cls", "weight", "head"])

    def run(batches):
        held, key, out = [], None, []
        for batch in batches:
            for row in batch.to_pylist():
                row["pair"] = (row["p"], row["q"])
                now = (row["label"], row["dim"], row["table"], row["bucket"], row["pair"])
                if now != key and held:
                    finish(held, out)
                    held = []
                key = now
                held.append(row)
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if held:
            finish(held, out)
        yield batch_of(out)

    return run


def embedding_groups(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
                     miss: float = MISS, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: ``key``, ``n_links``, ``component``, ``kept``.

    Vectors are compared if their labels are equal and not null; null, zero and empty vectors, and those
    with null or non-finite components, link with nothing; vectors of different length don't either.
    Equal vectors form a class, which is hashed and compared once and counts with its size.  Classes
    that share a bucket of a table are candidates, and a link is a cosine of at least ``threshold`` in
    double precision.  A bucket is compared in pairs of blocks of ``block`` classes, each a task's work
    of fixed size, of which only counts and spanning links are kept.  ``component`` is the smallest id
    reachable (the own id where there is no link).  Rows that repeat an id count as vectors of their own;
    a null id heads a component only if all its ids are null.  An empty table gives an empty result.
    """
    rows = checkpointed(vectors.select(F.col(f"`{id}`").alias("key"), F.col(f"`{label}`").alias("label"),
                                       F.transform(F.col(f"`{embedding}`"), lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
                        .withColumn("row", F.monotonically_increasing_id()))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("x", lambda v: v != 0), F.lit(False))
    good = rows.filter(usable)
    classes = checkpointed(good.groupBy("label", "x").agg(F.min("row").alias("cls"), F.count("*").alias("n")))
    member = checkpointed(good.join(classes, ["label", "x"]).select("row", "cls", "n"))
    total = classes.count()
    bits, tables = table_shape(threshold, total, miss)
    planes = Planes(bits, tables, seed)

    def sign(batches):
        for batch in batches:
            vectors_here = batch.column(2).to_pylist()
            buckets = np.zeros((len(vectors_here), tables), np.int64)
            for dim, at in _by_dim(vectors_here).items():
                buckets[at] = planes.signatures(_unit([vectors_here[k] for k in at], dim), tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(v) for v in vectors_here], pa.int32()),
                                              pa.array(list(buckets), pa.list_(pa.int64()))], names=["cls", "label", "dim", "buckets"])

    kind = classes.schema["label"].dataType.simpleString()
    signed = classes.select("cls", "label", "x").mapInArrow(sign, f"cls bigint, label {kind}, dim int, buckets array<bigint>")
    placed = checkpointed(signed.select("cls", "label", "dim", F.posexplode("buckets").alias("table", "bucket")))
    place = ["label", "dim", "table", "bucket"]
    sizes = checkpointed(placed.groupBy(*place).agg(F.count("*").alias("size")).filter("size > 1"))
    # a bucket's classes fall in blocks by hash; each pair of blocks is a group of its own
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("cls", "table"), F.col("blocks")).cast("int")
    busy = placed.join(sizes, place).withColumn("blocks", blocks).withColumn("own", own)
    pairs = busy.select(*place, "cls", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select(*place, "cls", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                         F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    group = [*place, "p", "q"]
    loaded = pairs.join(classes.select("cls", "x", "n"), "cls")
    dealt = loaded.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "cls")
    found = checkpointed(dealt.select(*group, "side", "cls", "n", "x").mapInArrow(_compare(threshold, planes), "cls bigint, weight bigint, head bigint"))
    weights = found.groupBy("cls").agg(F.sum("weight").alias("weight"))
    linked = components(found.filter("cls <> head").select("cls", "head"), "cls", "head")
    group_of = checkpointed(member.join(weights, "cls", "left").join(linked.withColumnRenamed("node", "cls"), "cls", "left")
                            .select("row", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("c")))
    known = checkpointed(rows.select("row", "key").join(group_of, "row", "left").select("row", "key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("c", "row").alias("c")))
    heads = checkpointed(known.groupBy("c").agg(F.min("key").alias("component")))
    return (known.join(heads, "c").select("key", F.col("n_links").cast("long").alias("n_links"), "component",
                                          F.col("key").eqNullSafe(F.col("component")).alias("kept")))
