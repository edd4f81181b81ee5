"""Texts in containers of a fixed number of tokens, with little space left over.

Texts are counted in tokens of a public tokenizer. A text longer than a container is cut into full containers and
a rest; no other text is cut. Items are dealt by hash into shards of about SHARD items, and each shard is packed
by best fit, the largest first: bins are kept by residual space and carry bitmaps of their sources and duplicate
clusters, and a successor search goes from the tightest residual that holds the item upwards until a bin is found that
has neither. Where every bin that fits is in conflict, a bin is opened, as long as the shard has at most SPARE more bins than
its tokens need. Only beyond that a conflict is taken: the tightest bin that has the source but no copy of the text,
else the tightest. So a source or copies of a text with a third of all rows cost no more than that space, and what is
left of conflicts is reported.

Cases: null and missing texts and texts without tokens are items of no tokens and go where they fit; ties go to the
oldest bin; other columns aren't used; repeated rows are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD = 20_000
SPARE = 0.01
#: Fixed value: how texts are cut before byte pairs are merged.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


#: Characters that are encoded at a time.
STRETCH = 100_000
_BETWEEN = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of a text. A long text is encoded in stretches that end between two words, where no token crosses."""
    if not text:
        return 0
    encode, n, at = encoder(path).encode_ordinary, 0, 0
    while len(text) - at > STRETCH:
        cut = _BETWEEN.search(text, at + STRETCH)
        if cut is None:
            break
        n += len(encode(text[at : cut.start()]))
        at = cut.start()
    return n + len(encode(text[at:]))


def sizes(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, cluster, n): tokens of each text; texts that are the same share a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t.as_py(), tokenizer) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "cluster", "n"])

    d = documents.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("cluster"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, source string, cluster bigint, n bigint")


def enough(total: int, capacity: int) -> int:
    """Bins for so many tokens, with SPARE more."""
    return math.ceil(total / capacity * (1 + SPARE)) + 1


class Bins:
    """Open containers by residual space. `mask` has a bit for each residual that some bin has."""

    def __init__(self, capacity: int, enough: int):
        self.capacity, self.enough, self.mask, self.count = capacity, enough, 0, 0
        self.by_residual: dict[int, list[list]] = defaultdict(list)
        self.holding: dict[int, int] = defaultdict(int)  # bins that have a source

    def _place(self, b: list) -> None:
        self.by_residual[b[1]].append(b)
        self.mask |= 1 << b[1]

    def _put(self, b: list, size: int, source: int, cluster: int) -> int:
        row = self.by_residual[b[1]]
        row.remove(b)
        if not row:
            self.mask &= ~(1 << b[1])
        b[1] -= size
        if not b[2] & source:
            self.holding[source] += 1
        b[2] |= source
        b[3] |= cluster
        self._place(b)
        return b[0]

    def _open(self, size: int, source: int, cluster: int) -> int:
        b = [self.count, self.capacity - size, source, cluster]
        self.count += 1
        self.holding[source] += 1
        self._place(b)
        return b[0]

    def _fitting(self, size: int) -> Iterator[list]:
        """Bins with room for the size, the tightest first."""
        rest, least = self.mask >> size, size
        while rest:
            step = (rest & -rest).bit_length() - 1
            least += step
            yield from self.by_residual[least]
            rest >>= step + 1
            least += 1

    def add(self, size: int, source: int, cluster: int) -> int:
        """The bin of an item: source and cluster are bits."""
        if self.holding[source] < self.count:
            for b in self._fitting(size):
                if not b[2] & source and not b[3] & cluster:
                    return self._put(b, size, source, cluster)
        if self.count < self.enough:
            return self._open(size, source, cluster)
        tightest = None
        for b in self._fitting(size):
            if not b[3] & cluster:
                return self._put(b, size, source, cluster)
            tightest = tightest or b
        return self._put(tightest, size, source, cluster) if tightest else self._open(size, source, cluster)


def pack(items: list[tuple[int, int, str, int]], capacity: int) -> list[int]:
    """The bin of each (key, size, source, cluster); the largest items are placed first."""
    order = sorted(range(len(items)), key=lambda i: (-items[i][1], items[i][0]))
    sources: dict[str, int] = {}
    members = Counter(c for _, _, _, c in items)
    bits: dict[int, int] = {}
    bins, out = Bins(capacity, enough(sum(n for _, n, _, _ in items), capacity)), [0] * len(items)
    for i in order:
        _, size, source, cluster = items[i]
        s = 1 << sources.setdefault(source, len(sources))
        c = 1 << bits.setdefault(cluster, len(bits)) if members[cluster] > 1 else 0
        out[i] = bins.add(size, s, c)
    return out


def _packed_shard(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A shard of (doc_id, source, cluster, n): the container of each text's rest, and whether another item in it has its source or text."""
        pdf = pdf.sort_values(["doc_id", "n", "cluster", "source"], kind="stable", ignore_index=True)
        rest = pdf[(pdf["n"] == 0) | (pdf["n"] % capacity > 0)]
        bins = pd.Series(pack(list(zip(rest.index, rest["n"] % capacity, rest["source"], rest["cluster"])), capacity), index=rest.index, dtype="int64")
        out = pdf[["doc_id", "n"]].copy()
        out["item"] = [f"{key[0]}-{i}" for i in pdf.index]
        out["container"] = bins.map(lambda b: f"{key[0]}-{b}").reindex(pdf.index).astype(object).where(pdf.index.isin(rest.index), None)
        for name, column in (("same_source", "source"), ("same_text", "cluster")):
            out[name] = pd.DataFrame({"b": bins, "x": rest[column]}).duplicated(keep=False).reindex(pdf.index, fill_value=False)
        return out

    return run


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """p8: (doc_id, piece, start, n_tokens, container, same_source, same_text): every token of every text in exactly
    one container. same_source and same_text tell whether another item of the container has the source or the text."""
    n_shards = max(1, -(-documents.count() // shard))
    items = sizes(documents, tokenizer).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(n_shards)).cast("int"))
    packed = items.groupBy("shard").applyInPandas(_packed_shard(capacity), "doc_id bigint, n bigint, item string, container string, same_source boolean, same_text boolean")
    # a text of several containers gives full pieces, which need no packing, and a rest (nothing, if it fits exactly)
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1))
    packed = packed.withColumn("piece", F.explode(pieces)).withColumn("start", (F.col("piece") * capacity).cast("bigint"))
    packed = packed.withColumn("n_tokens", F.least(F.col("n") - F.col("start"), F.lit(capacity)))
    full = F.col("n_tokens") == capacity
    name = F.when(full, F.concat_ws("-", F.lit("full"), "item", F.col("piece").cast("string"))).otherwise(F.col("container"))
    return packed.select("doc_id", "piece", "start", "n_tokens", name.alias("container"), (~full & F.col("same_source")).alias("same_source"), (~full & F.col("same_text")).alias("same_text"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_tokens, fill, n_same_source, n_same_text): how full the containers are, and the conflicts left."""
    counts = packed.agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count_if("same_source").alias("n_same_source"), F.count_if("same_text").alias("n_same_text"))
    return counts.select("n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("fill"), "n_same_source", "n_same_text")


def kept_promises(packed: DataFrame, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_documents, n_lost, n_over, n_cut): texts of which a piece is lacking or there twice, containers over their
    capacity, and texts that are cut though a container holds them."""
    each = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max("piece").alias("last"), F.countDistinct("piece").alias("kinds"))
    rows = documents.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("rows")).join(each, "doc_id", "full")
    whole = (F.col("rows") * F.col("kinds") == F.col("pieces")) & (F.col("kinds") == F.col("last") + 1)
    needless = (F.col("pieces") > F.col("rows")) & (F.col("n") <= F.col("rows") * capacity)
    texts = rows.agg(F.sum("rows").alias("n_documents"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("n_lost"), F.count_if(needless).alias("n_cut"))
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("n_over"))
    return texts.join(over).select("n_documents", "n_lost", "n_over", "n_cut")  # one row each
