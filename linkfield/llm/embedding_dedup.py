"""Near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosines."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import shared_dir, written
from .components import components, union_find

#: Width of a quantised projection (unit vectors), chance of missing a pair at the very threshold, unlike vectors
#: that share a bucket on average, vectors in one block of a bucket.
WIDTH, MISS, OCCUPANCY, BLOCK = 1.8, 0.002, 400, 16384

#: Signs of random projections in a sketch; standard deviations that a pair at the threshold may differ beyond the
#: mean of its unlike signs (it is missed with a chance of about 1 in 100,000).
SIGNS, DEVIATIONS = 128, 4.5


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection puts two vectors at this distance into one interval."""
    r = width / distance
    return 1 - 2 * NormalDist().cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(projections in a bucket key, tables): unrelated vectors meet in about OCCUPANCY / n of cases a table, and a
    pair at the threshold is missed with chance MISS at most, whatever the number of vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(2, round(math.log(max(n, 1) / OCCUPANCY) / -math.log(far))) if n > OCCUPANCY else 2
    return k, math.ceil(math.log(MISS) / math.log(1 - near**k))


def unlike_signs(threshold: float) -> int:
    """Unlike signs up to which two sketches may belong to a pair at the threshold."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(SIGNS * p + DEVIATIONS * math.sqrt(SIGNS * p * (1 - p)))


def _vectors(batches):
    """Per row: id, key of its vector (null if it links with nothing), length, vector as bytes of doubles, or of floats
    where they hold the same numbers."""
    fields = (("vec_id", pa.int64()), ("key", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()))
    for batch in batches:
        out = []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if not np.isfinite(x).all() or not np.any(x) or not 0 < float(np.dot(x, x)) < math.inf:
                    x = _rescued(x)
            if x is None:
                out.append((i, None, None, None))
            else:
                x = x + 0.0  # -0.0 is 0.0
                with np.errstate(over="ignore"):
                    floats = x.astype("<f4")
                raw = (floats if np.array_equal(floats, x) else x).tobytes()
                out.append((i, _key(raw, len(x)), len(x), raw))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _rescued(x: np.ndarray) -> np.ndarray | None:
    """A vector whose squares leave the range of doubles, scaled by its largest component; None if it isn't valid."""
    if not np.isfinite(x).all() or not np.any(x):
        return None
    return x / np.abs(x).max()


def _key(raw: bytes, dim: int) -> int:
    return xxhash.xxh64_intdigest(raw, dim) - (1 << 63)


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of unit length from vectors as bytes."""
    x, size = np.empty((len(raw), dim)), np.array([len(r) for r in raw])
    for width, kind in ((4, "<f4"), (8, "<f8")):
        rows = np.flatnonzero(size == width * dim)
        x[rows] = np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(k: int, tables: int, seed: int):
    """A row per class: its buckets, one a table, and its sketch (signs of other projections) in two numbers."""
    made: dict[int, tuple] = {}

    def run(batches):
        for batch in batches:
            raw, dims = batch.column("vec").to_pylist(), batch.column("dim").to_numpy()
            names, signs = np.empty((len(raw), tables), np.uint64), np.empty((len(raw), SIGNS // 64), np.int64)
            for d in np.unique(dims).tolist():
                if d not in made:
                    rng = np.random.default_rng([seed, d])
                    made[d] = rng.standard_normal((d, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.standard_normal((d, SIGNS))
                a, b, c = made[d]
                rows = np.flatnonzero(dims == d)
                x = _unit([raw[i] for i in rows], d)
                cells = np.floor((x @ a + b) / WIDTH).astype("<i4").reshape(len(rows), tables, k)
                names[rows] = [[xxhash.xxh64_intdigest(c.tobytes(), t * 100_003 + d) for t, c in enumerate(r)] for r in cells]
                signs[rows] = np.packbits(x @ c > 0, axis=1).view(np.int64)
            if len(raw):
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * tables), pa.array(names.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns, buckets, pa.array(signs[:, 0]), pa.array(signs[:, 1])], names=[*batch.schema.names, "buckets", "s0", "s1"])

    return run


def _by_group(of_group):
    """of_group(rows) for the rows of each group, of batches in the order of grp; rows are columns by name."""

    def columns(batch) -> dict[str, np.ndarray]:
        return {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}

    def run(batches):
        rest = None
        for rows in map(columns, batches):
            if rest is not None:
                rows = {c: np.concatenate([rest[c], rows[c]]) for c in rows}
            cuts = [0, *(np.flatnonzero(np.diff(rows["grp"])) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from of_group({c: v[a:b] for c, v in rows.items()})
            rest = {c: v[cuts[-1] :] for c, v in rows.items()}
        if rest is not None and len(rest["grp"]):
            yield from of_group(rest)

    return run


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows to compare with one another, and whether they are those of two blocks."""
    return np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()), bool(side.min() != side.max())


def _likely_in_buckets(most: int):
    """Of the rows of each group those with another one (of the other block, where there are two) of which at most
    `most` signs are unlike."""

    def of_group(rows):
        if len(rows["key"]) < 2:
            return
        left, right, _ = _sides(rows["side"])
        sketch, likely = np.stack([rows["s0"], rows["s1"]], axis=1).view(np.uint64), np.zeros(len(rows["key"]), bool)
        for s in range(0, len(left), 512):
            part = left[s : s + 512]
            for r in range(0, len(right), 512):
                other = right[r : r + 512]
                if likely[part].all() and likely[other].all():
                    continue
                unlike = sum(np.bitwise_count(sketch[part, w, None] ^ sketch[None, other, w]) for w in range(sketch.shape[1]))
                near = (unlike <= most) & (part[:, None] != other[None, :])
                likely[part] |= near.any(axis=1)
                likely[other] |= near.any(axis=0)
        if likely.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][likely]) for c in ("grp", "t", "side", "key")], names=["grp", "t", "side", "key"])

    return _by_group(of_group)


def _linked_in_buckets(threshold: float):
    """Rows in the order of group (a bucket, or two blocks of one) to key, links, root: how many vectors each class
    links with that it hasn't met in an earlier table, and the smallest class it is connected to here."""

    def of_group(rows):
        key, n, t = rows["key"], rows["n"], int(rows["t"][0])
        if len(key) < 2 or (rows["dim"] != rows["dim"][0]).any():
            return
        x, met = _unit(rows["vec"].tolist(), int(rows["dim"][0])), np.stack(rows["codes"])
        left, right, two = _sides(rows["side"])
        links, found = np.zeros(len(key), np.int64), []
        step = max(1, (1 << 21) // max(1, len(right)))
        for s in range(0, len(left), step):
            part = left[s : s + step]
            i, j = np.nonzero(x[part] @ x[right].T >= threshold)
            i, j = part[i], right[j]
            if not two:
                i, j = i[i < j], j[i < j]
            if len(i):
                fresh = np.ones(len(i), bool)
                for earlier in range(t):
                    fresh &= met[i, earlier] != met[j, earlier]
                np.add.at(links, i[fresh], n[j[fresh]])
                np.add.at(links, j[fresh], n[i[fresh]])
                node, root = union_find(i, j)
                found.append((node, root))
        if found:
            node, root = union_find(*(np.concatenate(z) for z in zip(*found, strict=True)))
            least = np.full(len(key), np.iinfo(np.int64).max)
            np.minimum.at(least, root, key[node])
            yield pa.RecordBatch.from_arrays([pa.array(key[node]), pa.array(links[node]), pa.array(least[root])], names=["key", "links", "root"])

    return _by_group(of_group)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    Two vectors link when their cosine is threshold or more.  Equal vectors are one class, so a vector that a third of
    all rows share is looked up once.  Classes meet in buckets of several tables (see plan).  Only sketches travel to all
    buckets; what has a partner there that its sketch doesn't rule out (see unlike_signs) is joined by its vector,
    compared exactly and counted in the first table where a pair meets.  Buckets over `block` classes are compared block
    by block in tasks of their own.  Vectors that are null, empty, zero or hold null or non-finite components, and vectors
    of unlike length, link with nothing.  component_id is the smallest vec_id that links reach (the vector's own
    without links); kept tells if it is the row's own.  Null ids are never smallest.  An empty table gives no rows.
    """
    spark = df.sparkSession
    shared_dir(spark)
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast(ArrayType(DoubleType())).alias("v"))
    rows = written(source.mapInArrow(_vectors, "vec_id long, key long, dim int, vec binary"), "vectors")
    classes = written(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes")
    k, tables = plan(classes.count(), threshold)
    kind = "key long, n long, dim int, vec binary, buckets array<long>, s0 long, s1 long"
    hashed = written(classes.select("key", "n", "dim", "vec").mapInArrow(_hashed(k, tables, seed), kind), "hashed")
    each = hashed.select("key", "s0", "s1", F.posexplode("buckets").alias("t", "bucket"))
    large = written(each.groupBy("bucket", "t").count().where(F.col("count") > block).select("bucket", "t", F.ceil(F.col("count") / block).cast("int").alias("m")), "large")
    each = each.join(large, ["bucket", "t"], "left")
    side = F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("key"), F.col("m")).cast("int"))
    each = each.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("m"), F.lit(1)) - 1)))
    group = F.xxhash64("bucket", "t", F.least("side", "other"), F.greatest("side", "other"))
    met = each.select(group.alias("grp"), "t", "side", "key", "s0", "s1").repartition("grp").sortWithinPartitions("grp")
    likely = written(met.mapInArrow(_likely_in_buckets(unlike_signs(threshold)), "grp long, t int, side int, key long"), "likely")
    codes = F.transform("buckets", lambda b: F.shiftright(b, 32).cast("int")).alias("codes")
    pairs = likely.join(hashed.select("key", "n", "dim", "vec", codes), "key").repartition("grp").sortWithinPartitions("grp")
    found = written(pairs.mapInArrow(_linked_in_buckets(threshold), "key long, links long, root long"), "links")
    labels = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")).distinct())
    degree = found.groupBy("key").agg(F.sum("links").alias("links"))

    named = classes.select("key", "n", "least").join(labels.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
