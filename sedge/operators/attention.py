"""Attention as joins and aggregates over rows (b, h, pos, q, k, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The generator of random links.
RANDOM_A, RANDOM_B = 1103515245, 12345


def split_heads(df: DataFrame, batch: str, position: str, vector: str, heads: int, size: int) -> DataFrame:
    """(b, h, pos, vec): the vector of each position in equal slices."""
    v = F.col(vector).cast("array<double>")
    slices = F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.struct(h.alias("h"), F.slice(v, h * size + 1, F.lit(size)).alias("vec")))
    return df.select(F.col(batch).alias("b"), F.col(position).alias("pos"), F.explode(slices).alias("x")).select("b", "x.h", "pos", "x.vec")


def length(x: DataFrame) -> int:
    """The number of positions: the greatest and one; 1 for no rows."""
    top = x.agg(F.max("pos")).first()[0]
    return 1 if top is None else int(top) + 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sides(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    return x.select("b", "h", F.col("pos").alias("qpos"), F.col("vec").alias("q")), x.select("b", "h", F.col("pos").alias("kpos"), F.col("vec").alias("k"))


def links_all(x: DataFrame, causal: bool = False) -> DataFrame:
    """Every pair within a head, or those not ahead. The work is the operator's own n * n / heads."""
    q, k = _sides(x)
    out = q.join(k, ["b", "h"])
    return out.where("kpos <= qpos") if causal else out


def links_local(x: DataFrame, window: int) -> DataFrame:
    """Pairs at most `window` apart: offsets are generated and joined by equality, not by a range condition."""
    q, k = _sides(x)
    return q.withColumn("kpos", F.explode(F.sequence(F.col("qpos") - window, F.col("qpos") + window))).join(k, ["b", "h", "kpos"])


def links_random(x: DataFrame, length: int, n: int) -> DataFrame:
    """n pseudo-random keys of each query, the same every time."""
    q, k = _sides(x)
    offsets = F.explode(F.sequence(F.lit(1), F.lit(n)))
    q = q.withColumn("o", offsets).withColumn("kpos", F.pmod(F.col("qpos").cast("bigint") * RANDOM_A + F.col("o") * RANDOM_B, F.lit(length)))
    return q.drop("o").distinct().join(k, ["b", "h", "kpos"])


def links_sparse(x: DataFrame, window: int, global_tokens: int, random_tokens: int, length: int, causal: bool = False) -> DataFrame:
    """Local, global and random links together. The window looks both ways even where a causal mask cuts it later."""
    q, k = _sides(x)
    few = k.where(F.col("kpos") < global_tokens)
    ahead = q.where(F.col("qpos") < global_tokens)
    out = links_local(x, window).select("b", "h", "qpos", "q", "kpos", "k")
    for part in (q.join(few, ["b", "h"]), ahead.join(k, ["b", "h"]), *([links_random(x, length, random_tokens)] if random_tokens else [])):
        out = out.unionByName(part.select("b", "h", "qpos", "q", "kpos", "k"))
    out = out.dropDuplicates(["b", "h", "qpos", "kpos"])
    return out.where("kpos <= qpos") if causal else out


def check_shape(x: DataFrame, size: int) -> None:
    """Raises ValueError where a vector isn't of the head's size or a position is there twice."""
    bad = x.agg(F.count_if(F.coalesce(F.size("vec"), F.lit(-1)) != size).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} vectors don't have {size} elements")
    if x.groupBy("b", "h", "pos").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a position is there twice")


def _rows(vectors: DataFrame) -> DataFrame:
    """(b, h, qpos, d, value) of (b, h, qpos, vec)."""
    return vectors.select("b", "h", "qpos", F.posexplode("vec").alias("d", "value"))


def _weighted(size: int, weight: Column, vector: Column) -> list[Column]:
    """The sums of weight * element, one a dimension: partial aggregates in the JVM's registers, no row a dimension."""
    return [F.sum(weight * vector[i]).alias(f"v{i}") for i in range(size)]


def attend(links: DataFrame, values: DataFrame, size: int) -> DataFrame:
    """(b, h, qpos, d, value): softmax over each query's links and the weighted sum of values.

    The largest score is taken off first; a link meets its value as one vector.
    """
    s = links.withColumn("s", dot(F.col("q"), F.col("k")) / math.sqrt(size)).select("b", "h", "qpos", "kpos", "s")
    top = s.groupBy("b", "h", "qpos").agg(F.max("s").alias("m"))
    e = s.join(top, ["b", "h", "qpos"]).withColumn("e", F.exp(F.col("s") - F.col("m")))
    v = values.select("b", "h", F.col("pos").alias("kpos"), "vec")
    sums = e.join(v, ["b", "h", "kpos"]).groupBy("b", "h", "qpos").agg(F.sum("e").alias("e"), *_weighted(size, F.col("e"), F.col("vec")))
    return _rows(sums.select("b", "h", "qpos", F.array(*(F.col(f"v{i}") / F.col("e") for i in range(size))).alias("vec")))


def _phi(x: Column) -> Column:
    return F.when(x > 0, x + 1).otherwise(F.exp(x))


def masked_pairs(links: DataFrame, allowed: DataFrame) -> DataFrame:
    """Links that a mask of pairs allows: allowed (b, qpos, kpos) for every head or (b, h, qpos, kpos). A query none of
    whose links is allowed keeps them all with the same weight."""
    keys = [c for c in ("b", "h", "qpos", "kpos") if c in allowed.columns]
    met = links.join(allowed.select(*keys, F.lit(True).alias("_valid")), keys, "left").withColumn("_valid", F.coalesce("_valid", F.lit(False)))
    return _kept(met)


def attend_linear(x: DataFrame, eps: float = 1e-6, valid: DataFrame | None = None) -> DataFrame:
    """(b, h, qpos, d, value) with the feature map elu + 1: keys and values are summed before queries meet them.

    With `valid` (b, pos) padded keys and values are zero before the map, so a padded key still adds 1 a feature to
    the norm and nothing to the sum.
    """
    features = F.transform(F.col("vec"), _phi)
    keys = x
    if valid is not None:
        keys = x.join(valid.select("b", "pos", F.lit(True).alias("_valid")), ["b", "pos"], "left").withColumn("vec", F.when(F.col("_valid"), F.col("vec")).otherwise(F.transform("vec", lambda v: F.lit(0.0))))
    k = keys.select("b", "h", F.posexplode(features).alias("i", "f"), "vec")
    kv = k.select("b", "h", "i", "f", F.posexplode("vec").alias("d", "v")).groupBy("b", "h", "i", "d").agg(F.sum(F.col("f") * F.col("v")).alias("kv"))
    z = k.groupBy("b", "h", "i").agg(F.sum("f").alias("z"))
    q = x.select("b", "h", F.col("pos").alias("qpos"), F.posexplode(features).alias("i", "f"))
    norm = q.join(z, ["b", "h", "i"]).groupBy("b", "h", "qpos").agg(F.sum(F.col("f") * F.col("z")).alias("n"))
    out = q.join(kv, ["b", "h", "i"]).groupBy("b", "h", "qpos", "d").agg(F.sum(F.col("f") * F.col("kv")).alias("s"))
    return out.join(norm, ["b", "h", "qpos"]).select("b", "h", "qpos", "d", (F.col("s") / F.greatest("n", F.lit(eps))).alias("value"))


def merge_heads(attended: DataFrame, size: int) -> DataFrame:
    """(b, pos, vec): the heads side by side again."""
    rows = attended.groupBy("b", "qpos").agg(F.array_sort(F.collect_list(F.struct((F.col("h") * size + F.col("d")).alias("i"), "value"))).alias("x"))  # one vector
    return rows.select("b", F.col("qpos").alias("pos"), F.transform("x", lambda y: y["value"]).alias("vec"))


def masked(links: DataFrame, valid: DataFrame) -> DataFrame:
    """Links to keys that are no padding: valid (b, pos). A query all of whose links are padding keeps them all with the
    same weight."""
    v = valid.select("b", F.col("pos").alias("kpos"), F.lit(True).alias("_valid"))
    return _kept(links.join(v, ["b", "kpos"], "left").withColumn("_valid", F.coalesce("_valid", F.lit(False))))


def _kept(met: DataFrame) -> DataFrame:
    """Links that are _valid; of a query without any all of them, its vector zero, so that its result is the average of
    the values it is linked to."""
    some = met.groupBy("b", "h", "qpos").agg(F.max("_valid").alias("_some"))
    kept = met.join(some, ["b", "h", "qpos"]).where(F.col("_valid") | ~F.col("_some"))
    return kept.withColumn("q", F.when(F.col("_some"), F.col("q")).otherwise(F.transform("q", lambda x: F.lit(0.0)))).drop("_valid", "_some")


def attend_blocked(x: DataFrame, values: DataFrame, size: int, block: int, causal: bool = False) -> DataFrame:
    """Full attention by blocks of keys: each block of keys and values is one row of arrays, a query meets a block at a
    time and keeps (m, l, acc), and blocks merge by rescaling to the greatest m. No row a pair of positions is made."""
    size_type = "array<struct<kpos:bigint,k:array<double>,v:array<double>>>"
    pair = x.select("b", "h", "pos", "vec").join(values.select("b", "h", "pos", F.col("vec").alias("v")), ["b", "h", "pos"])
    blocks = pair.groupBy("b", "h", F.floor(F.col("pos") / block).alias("j")).agg(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("kpos"), F.col("vec").alias("k"), "v")).cast(size_type).alias("ks"))  # at most a block
    met = x.select("b", "h", F.col("pos").alias("qpos"), F.col("vec").alias("q")).join(blocks, ["b", "h"])
    if causal:
        met = met.where(F.col("j") * block <= F.col("qpos")).withColumn("ks", F.filter("ks", lambda y: y["kpos"] <= F.col("qpos"))).where(F.size("ks") > 0)
    scored = met.select("b", "h", "qpos", "ks", F.transform("ks", lambda y: dot(F.col("q"), y["k"]) / math.sqrt(size)).alias("s"))
    scored = scored.withColumn("m", F.array_max("s")).withColumn("e", F.transform("s", lambda y: F.exp(y - F.col("m"))))
    total = F.aggregate("e", F.lit(0.0), lambda s, y: s + y)
    zero = F.array(*(F.lit(0.0) for _ in range(size)))
    acc = F.aggregate(F.arrays_zip("e", "ks"), zero, lambda s, y: F.zip_with(s, y["ks"]["v"], lambda p, r: p + y["e"] * r))
    state = scored.select("b", "h", "qpos", "m", total.alias("l"), acc.alias("acc"))
    top = state.groupBy("b", "h", "qpos").agg(F.max("m").alias("top"))
    scaled = state.join(top, ["b", "h", "qpos"]).withColumn("c", F.exp(F.col("m") - F.col("top")))
    sums = scaled.groupBy("b", "h", "qpos").agg(F.sum(F.col("c") * F.col("l")).alias("l"), *_weighted(size, F.col("c"), F.col("acc")))
    return _rows(sums.select("b", "h", "qpos", F.array(*(F.col(f"v{i}") / F.col("l") for i in range(size))).alias("vec")))


def _vectors(attended: DataFrame) -> DataFrame:
    rows = attended.groupBy("b", "h", "qpos").agg(F.array_sort(F.collect_list(F.struct("d", "value"))).alias("x"))  # one vector
    return rows.select("b", "h", F.col("qpos").alias("pos"), F.transform("x", lambda y: y["value"]).alias("vec"))


def co_attend(q: DataFrame, k: DataFrame, v: DataFrame, size: int) -> DataFrame:
    """(b, h, qpos, d, value): attention over (k, v), then over its own result, added up."""

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.select("b", "h", F.col("pos").alias("qpos"), F.col("vec").alias("q")).join(right.select("b", "h", F.col("pos").alias("kpos"), F.col("vec").alias("k")), ["b", "h"])

    own = attend(pairs(q, k), v, size)
    summary = _vectors(own)
    cross = attend(pairs(q, summary), summary, size)
    return own.join(cross.withColumnRenamed("value", "c"), ["b", "h", "qpos", "d"]).select("b", "h", "qpos", "d", (F.col("value") + F.col("c")).alias("value"))


def shifted(x: DataFrame, residual: DataFrame) -> DataFrame:
    """Vectors with a residual added: residual (b, h, pos, vec)."""
    r = residual.select("b", "h", "pos", F.col("vec").alias("_r"))
    return x.join(r, ["b", "h", "pos"], "left").select("b", "h", "pos", F.when(F.col("_r").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_r", lambda a, b: a + b)).alias("vec"))
