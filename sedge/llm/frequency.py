"""How often every distinct value or term occurs and in how many records, and which are too rare or too common.

Blocks of rows are dictionary-encoded and counted into arrays where they are read. The distinct terms of all
blocks get dense integer ids (a range-partitioned sort, ids by partition offset), the blocks' counts are encoded
with them, and arrays are summed by id range.

Cases: null terms are left out; a term that repeats within a record counts once as a record and each time as an
occurrence; columns with the same name as those made here don't clash, as only the counted columns are read; an
empty table gives no rows; terms of any length count whole; ties don't matter, marks depend on counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.missing import meaningful
from sedge.sources.tables import cut

#: Ids in one array.
RANGE = 4096
#: Entries of a task's block before it is passed on.
BLOCK = 200_000


def _blocks(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[tuple[str, str], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(block)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([block[k][0] for k in keys], pa.int64()), pa.array([block[k][1] for k in keys], pa.int64())], names=["column_name", "item", "occurrences", "records"])
            block.clear()
            return out

        for batch in batches:
            for i, name in enumerate(names):
                lists = batch.column(i)
                flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
                keep = flat.is_valid()
                flat, parent = flat.filter(keep), parent.filter(keep)
                if not len(flat):
                    continue
                encoded = flat.dictionary_encode()
                codes, k = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(encoded.dictionary)
                occurrences = np.bincount(codes, minlength=k)
                records = np.bincount(np.unique(parent.to_numpy(zero_copy_only=False).astype(np.int64) * k + codes) % k, minlength=k)
                for item, o, r in zip(encoded.dictionary.to_pylist(), occurrences.tolist(), records.tolist()):
                    cell = block.setdefault((name, item), [0, 0])
                    cell[0] += o
                    cell[1] += r
                if len(block) > BLOCK:
                    yield flush()
        yield flush()

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, occ, rec = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for r in np.unique(ids // RANGE).tolist():
            mine = ids // RANGE == r
            a = ranges.setdefault(r, np.zeros((2, RANGE), np.int64))
            np.add.at(a[0], ids[mine] % RANGE, occ[mine])
            np.add.at(a[1], ids[mine] % RANGE, rec[mine])
    for r, a in ranges.items():
        at = np.flatnonzero(a[0])
        yield pa.RecordBatch.from_arrays([pa.array(at + r * RANGE, pa.int64()), pa.array(a[0][at]), pa.array(a[1][at])], names=["term_id", "occurrences", "records"])


def term_frequencies(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column_name, item, term_id, occurrences, records) of every term; `columns` gives an array of terms by name."""
    names = list(columns)
    arrays = df.select(*(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")).alias(f"c{i}") for i, c in enumerate(columns.values())))
    blocks = cut(arrays.mapInArrow(_blocks(names), "column_name string, item string, occurrences bigint, records bigint"))
    numbered = blocks.select("column_name", "item").distinct().repartitionByRange("column_name", "item").sortWithinPartitions("column_name", "item")
    # the position within the partition is the low part of the monotonically increasing id
    dictionary = cut(numbered.select("column_name", "item", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_k")))
    sizes = {r["_p"]: r["n"] for r in dictionary.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    offsets, at = [], 0
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(at).cast("bigint")]
        at += sizes[p]
    ids = dictionary.select("column_name", "item", (F.col("_k") + F.element_at(F.create_map(*offsets), F.col("_p")) if offsets else F.col("_k")).alias("term_id"))
    encoded = blocks.join(ids, ["column_name", "item"]).select("term_id", "occurrences", "records")
    spread = encoded.repartition(F.floor(F.col("term_id") / RANGE))
    return ids.join(spread.mapInArrow(_sums, "term_id bigint, occurrences bigint, records bigint"), "term_id")


def value_terms(fields: list[str]) -> dict[str, Column]:
    """Each cell as its one value, stripped; missing cells have none."""
    return {f: F.array_compact(F.array(meaningful(F.col(f"`{f}`").cast("string")))) for f in fields}


def mark(frequencies: DataFrame, rows: int, rare_records: int = 1, common_share: float = 0.1) -> DataFrame:
    """Adds `mark`: rare up to so many records, common from that share of all rows, else null."""
    return frequencies.withColumn("mark", F.when(F.col("records") <= rare_records, "rare").when(F.col("records") >= common_share * rows, "common"))


def useless_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """p4: the values of the fields that occur in one row only or in at least a tenth of all rows."""
    marked = mark(term_frequencies(df, value_terms(fields)), df.count())
    return marked.where("mark IS NOT NULL").select("column_name", "item", "mark")
