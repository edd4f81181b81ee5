"""Splits that keep related records together: linked keys form components, whole components get a split.

Components are found by contraction: every node points to its least neighbour, pointer jumping takes each to its
root, edges are relabelled and the graph shrinks by half or more a round. Each round is checkpointed. Components
that hold a key with a split keep it, components whose keys have different splits are quarantined, new ones fill
the splits' deficits, the largest first. The table of keys, components and splits is what the next run starts from.

Components of one size are alike, so the filling is worked out on the numbers of components by size: there are
fewer than sqrt(2 * rows) sizes, which is what the driver reads. Each component then finds its split by its rank.

Cases: missing keys link nothing, a row without any key is its own group; DOIs are compared bare and in lower case;
repeated rows and edges count once as links; an empty table gives no groups; only the key columns are used, so
extra or clashing columns don't matter; the least DOI names a group, so ties can't occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.missing import is_missing, strip
from sedge.functions.splits import check_ratios, stable_bucket
from sedge.sources.tables import cut

SPLITS = ("train", "validation", "test")


def bare_doi(c: Column) -> Column:
    """The bare DOI in lower case: without resolver, label, escapes and a final stop."""
    v = F.lower(strip(c))
    v = F.when(v.contains("%"), F.coalesce(F.try_url_decode(v), v)).otherwise(v)
    found = F.regexp_replace(F.regexp_extract(v, r"(10\.[0-9]{2,9}/\S+)", 1), r"[.,;:)\]]+$", "")
    return F.when(is_missing(c), None).otherwise(F.when(found != "", found).otherwise(v))


def batch_key(c: Column) -> Column:
    return F.when(~is_missing(c), F.lower(strip(c)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component."""
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known: DataFrame | None = None
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        while True:  # pointer jumping: chains halve each time
            up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = cut(parent.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"), (F.coalesce("_r", "root") != F.col("root")).alias("moved")))
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        pa = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        pb = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = cut(e.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if known is None:
            known = parent
        else:
            up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            known = cut(known.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")))
    return known if known is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")


def _keyed(df: DataFrame, id_column: str, doi: str, batch: str) -> DataFrame:
    """(id, written, d, k): rows with their nodes, "d:" + DOI and "k:" + batch key, null where missing."""
    written, key = F.col(f"`{doi}`"), F.col(f"`{batch}`")
    return df.select(F.col(id_column).alias("_id"), written.alias("_written"), F.concat(F.lit("d:"), bare_doi(written)).alias("_d"), F.concat(F.lit("k:"), batch_key(key)).alias("_k"))


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds _group to rows with a _node: the root of its component, or the node itself if it is linked to none."""
    return nodes.join(roots.select(F.col("node").alias("_n"), "root"), F.col("_node") == F.col("_n"), "left").withColumn("_group", F.coalesce("root", "_node")).drop("_n", "root")


def linked(rows: DataFrame, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """_keyed() rows with _group, the root of their component, and (node, root) of all linked nodes.

    The root is the least node, so that of a group with a DOI is its least DOI. `earlier` (node, component) links too.
    """
    edges = rows.select(F.col("_d").alias("a"), F.col("_k").alias("b"))
    if earlier is not None:
        edges = edges.unionByName(earlier.select(F.col("node").alias("a"), F.col("component").alias("b")))
    roots = components(edges)
    return _rooted(rows.withColumn("_node", F.coalesce("_d", "_k")), roots).drop("_node"), roots


def chained_rows(df: DataFrame, id_column: str, doi: str, batch: str) -> DataFrame:
    """p6: all rows of the groups that hold more than one written DOI, with the least bare DOI of the group."""
    rows = linked(_keyed(df, id_column, doi, batch))[0].where("_group IS NOT NULL")
    written = F.when(~is_missing(F.col("_written")), F.col("_written"))
    several = rows.groupBy("_group").agg(F.min(written).alias("lo"), F.max(written).alias("hi")).where("lo <> hi").select("_group")
    return rows.join(several, "_group").select(F.col("_id").cast("bigint").alias(id_column), F.substring("_group", 3, 1 << 30).alias("group_doi"))


def fill(sizes: list[tuple[int, int]], have: dict[str, int], ratios: dict[str, float], total: int) -> list[tuple[int, list[int]]]:
    """For each size of (size, number of components), the largest first, how many of them each split gets.

    As if one by one each went to the split with the greatest deficit, the earlier of equals.
    """
    deficit = [ratios[s] * total - have.get(s, 0) for s in SPLITS]
    out = []
    for size, n in sorted(sizes, reverse=True):
        given = [0] * len(SPLITS)
        # all but the last rounds at once: splits above a level get what takes them down to it
        level = _level(deficit, size * n)
        for k, d in enumerate(deficit):
            given[k] = max(0, min(n, int((d - level) / size) - 1))
        for k, g in enumerate(given):
            deficit[k] -= g * size
        for _ in range(n - sum(given)):
            k = max(range(len(SPLITS)), key=lambda i: (deficit[i], -i))
            given[k] += 1
            deficit[k] -= size
        out.append((size, given))
    return out


def _level(deficit: list[float], amount: float) -> float:
    """The level to which an amount fills the deficits."""
    ordered = sorted(deficit, reverse=True)
    for k in range(1, len(ordered) + 1):
        level = (sum(ordered[:k]) - amount) / k
        if k == len(ordered) or level >= ordered[k]:
            return level
    return 0.0


def _ranked(groups: DataFrame, seed: int) -> DataFrame:
    """Adds _rank, the place from 0 in the order of size and hash, without a window over all rows."""
    parts = cut(groups.select("_group", "n", stable_bucket(F.col("_group"), seed).alias("_b")).repartitionByRange(F.desc("n"), "_b", "_group").sortWithinPartitions(F.desc("n"), "_b", "_group").withColumn("_at", F.monotonically_increasing_id()))
    # the upper bits of the number are the partition's, the lower count its rows
    parts = parts.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r["_part"], r["rows"]) for r in parts.groupBy("_part").agg(F.count("*").alias("rows")).collect())  # one row a partition
    start, at = [], 0
    for part, rows in sizes:
        start.append((part, at))
        at += rows
    starts = groups.sparkSession.createDataFrame(start, "_part bigint, _start bigint")
    return parts.join(starts, "_part").select("_group", "n", (F.col("_start") + F.col("_row")).alias("_rank"))


def _filled(new: DataFrame, have: dict[str, int], ratios: dict[str, float], total: int, seed: int) -> DataFrame:
    """(_group, filled): the split of each new component (_group, n)."""
    sizes = [(r["n"], r["groups"]) for r in new.groupBy("n").agg(F.count("*").alias("groups")).collect()]
    bounds, at = [], 0
    for size, given in fill(sizes, have, ratios, total):
        ends = [at + sum(given[: k + 1]) for k in range(len(SPLITS))]
        bounds.append((size, *ends))
        at = ends[-1]
    table = new.sparkSession.createDataFrame(bounds, "n bigint, _t bigint, _v bigint, _e bigint")
    split = F.when(F.col("_rank") < F.col("_t"), SPLITS[0]).when(F.col("_rank") < F.col("_v"), SPLITS[1]).otherwise(SPLITS[2])
    return _ranked(new, seed).join(table, "n").select("_group", split.alias("filled"))


def assign_splits(df: DataFrame, id_column: str, doi: str, batch: str, train: float = 0.8, validation: float = 0.1, seed: int = 17, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their split, and the table (node, component, split) to start the next run from.

    `existing` is that table of an earlier run, whose rows needn't be given again: it holds every DOI and batch key
    seen so far, and its components link as rows do. A component with nodes of two splits is quarantined: its rows
    get the split "quarantine" until someone decides, and its nodes keep the splits they had.
    """
    check_ratios(train, validation)
    ratios = {"train": train, "validation": validation, "test": 1 - train - validation}
    rows, roots = linked(_keyed(df, id_column, doi, batch), existing)
    rows = cut(rows.withColumn("_group", F.coalesce("_group", F.concat(F.lit("r:"), F.col("_id").cast("string")))))
    groups = rows.groupBy("_group").agg(F.count("*").alias("n"))
    nodes = rows.select(F.explode(F.array("_d", "_k")).alias("_node"))
    if existing is not None:
        nodes = nodes.union(existing.select("node"))
    nodes = cut(_rooted(nodes.where("_node IS NOT NULL").distinct(), roots))
    if existing is not None:
        old = existing.select(F.col("node").alias("_node"), F.col("split").alias("_old"))
        kept = nodes.join(old, "_node").groupBy("_group").agg(F.min("_old").alias("lo"), F.max("_old").alias("hi")).select("_group", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("quarantine").alias("kept"))
        groups = groups.join(kept, "_group", "left")
    else:
        groups = groups.withColumn("kept", F.lit(None).cast("string"))
    groups = cut(groups)
    have = {r["kept"]: r["n"] for r in groups.groupBy("kept").agg(F.sum("n").alias("n")).collect()}
    total = sum(have.values())
    placed = {s: have.get(s, 0) for s in SPLITS}
    filled = _filled(groups.where("kept IS NULL"), placed, ratios, total, seed)
    splits = groups.select("_group", "kept").join(filled, "_group", "left").select("_group", F.coalesce("kept", "filled").alias("split"))
    out = rows.join(splits, "_group").select(F.col("_id").alias(id_column), F.col("_group").alias("group_id"), "split")
    table = nodes.join(splits, "_group", "left")
    table = table.join(old, "_node", "left") if existing is not None else table.withColumn("_old", F.lit(None).cast("string"))
    return out, table.select(F.col("_node").alias("node"), F.col("_group").alias("component"), F.coalesce("_old", "split").alias("split"))


def kept_promises(df: DataFrame, rows: DataFrame, id_column: str, doi: str, batch: str) -> DataFrame:
    """(n_rows, n_lost, n_apart): rows of the table, rows without a split, and groups of the whole table with rows in
    several splits, but for those that a run found in conflict (with rows in quarantine)."""
    whole, _ = linked(_keyed(df, id_column, doi, batch))
    both = whole.select(F.col("_id").alias(id_column), F.col("_group").alias("_whole")).join(rows.select(id_column, "split"), id_column, "left")
    lost = both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("split").isNull()).alias("n_lost"))
    each = both.where("_whole IS NOT NULL").groupBy("_whole").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.max(F.col("split") == "quarantine").alias("conflict"))
    return lost.join(each.agg(F.count_if((F.col("lo") != F.col("hi")) & ~F.col("conflict")).alias("n_apart")))  # one row each
