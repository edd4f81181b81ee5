"""Evaluation passages inside training text, by winnowing.

Words (lower case, letters and digits) are hashed; of every WINDOW consecutive hashes of K words the least is kept,
so two texts that share RUN = K + WINDOW - 1 words in a row share a fingerprint. Fingerprints of the documents are
joined with those of the passages, and pairs with hits are extended: the longest common subsequence of the passage
and the stretch of text around the hits must hold SHARE of the passage's words, and runs of RUN shared words must
cover RUNS of it, which short shared phrases don't. Each such run is found from a fingerprint in it, so no pair that
fulfils both conditions is lost.

Passages up to MAX_SENT words go to the tasks that read the documents; the number is counted first. More passages
are joined by shuffle instead, with the same result: of each passage the fingerprints that most documents have are
left out of the join, as many as a pair can do without.

Cases: null and empty texts match nothing; passages shorter than RUN words match nothing; a document of any length
is read whole; repeated documents and passages come out each; text in several columns of the same name isn't used,
only the named columns are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 3, 2
#: Shared words in a row that always leave a common fingerprint.
RUN = K + WINDOW - 1
#: Share of the passage's words that the stretch must hold in order, and that runs of shared words must cover (half a
#: passage with one word in six changed has 5 / 12).
SHARE, RUNS = 0.5, 0.4
#: Words that a stretch may be longer than its passage (an inserted sentence).
SLACK = 40
#: Words of passages that tasks receive; beyond, fingerprints are joined by shuffle.
MAX_SENT = 200_000
#: Equal pairs of fingerprints that are looked at together.
MOST_HITS = 3_000_000
#: Bytes of text that are hashed at a time.
CHUNK = 2_000_000
_M = np.uint64(0xBF58476D1CE4E5B9)
_P = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = _P
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word) of an Arrow string array."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")
    plain = pc.binary_join_element_wise(plain, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    if isinstance(plain, pa.ChunkedArray):
        plain = plain.combine_chunks()
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = data != 32
    edge = np.diff(letter.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = (data[letter].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[at]
    rows = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
    return _mix(np.add.reduceat(values, first)), rows


def fingerprints(words: np.ndarray, rows: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the winnowed k-grams; grams never cross rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = words[:n].copy()
    for j in range(1, k):
        grams = grams * _P + words[j : n + j]
    grams = _mix(grams)
    inside = rows[:n] == rows[k - 1 :]
    grams[~inside] = _TOP
    best, pos = grams.copy(), np.arange(n)
    for j in range(1, min(window, n)):
        later = grams[j:]
        take = (later <= best[: n - j]) & inside[j:] & (rows[j:n] == rows[: n - j])
        best[: n - j][take] = later[take]
        pos[: n - j][take] = np.flatnonzero(take) + j
    pos = np.unique(pos[inside])
    return pos, grams[pos]


def covered(starts: np.ndarray) -> int:
    """Words in runs of RUN words that start at the given positions, which are in order."""
    return int(np.minimum(np.diff(starts), RUN).sum()) + RUN if len(starts) else 0


class Passages:
    """The held-out passages: their words, and their fingerprints in hash order."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, rows = word_hashes(pa.array(texts, pa.string()))
        pos, hashes = fingerprints(words, rows)
        order = np.argsort(hashes, kind="stable")
        bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
        self.ids, self.words = ids, [words[a:b] for a, b in zip(bounds, bounds[1:])]
        self.hashes, self.item = hashes[order], rows[pos][order]
        self.at = (pos - bounds[rows[pos]])[order]
        self.flat, self.start, self.size = words, bounds[:-1], np.diff(bounds)
        self.masks: dict[int, dict[int, int]] = {}
        low = np.zeros(1 << 20, bool)
        low[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.low = low

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indexes of the hashes that a passage has, the first equal fingerprint of each, how many are equal)."""
        maybe = np.flatnonzero(self.low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, hashes[maybe], "left"), np.searchsorted(self.hashes, hashes[maybe], "right")
        return maybe, lo, hi - lo

    def mask(self, item: int) -> dict[int, int]:
        if item not in self.masks:
            m: dict[int, int] = {}
            for p, w in enumerate(self.words[item].tolist()):
                m[w] = m.get(w, 0) | 1 << p
            self.masks[item] = m
        return self.masks[item]

    def runs(self, words: np.ndarray, rows: np.ndarray, at: np.ndarray, item: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hits (position, item, position in the passage): (position, item, start in the passage) of the shared runs
        of RUN words that they belong to. Of the two grams in such a run one is a fingerprint, so none is missed."""
        out = []
        for back in range(WINDOW):  # the hit is this gram of the run
            ahead = WINDOW - 1 - back
            ok = (fp >= back) & (fp + K + ahead <= self.size[item]) & (at >= back) & (at + K + ahead <= len(words))
            a, i, f = at[ok] - back, item[ok], fp[ok] - back
            same = rows[a] == rows[a + RUN - 1]
            for k in (*range(back), *range(back + K, RUN)):
                same &= words[a + k] == self.flat[self.start[i] + f + k]
            out.append((a[same], i[same], f[same]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def extends(self, item: int, doc: np.ndarray, at: np.ndarray, start: np.ndarray) -> bool:
        """Whether a stretch of the document's words around shared runs (position, start in the passage) holds enough."""
        n, half = int(self.size[item]), SLACK // 2
        at, start = at[order := np.argsort(at, kind="stable")], start[order]
        begins = np.unique(np.maximum(0, (at - start - half) // half * half))
        low, high = np.searchsorted(at, begins), np.searchsorted(at, begins + n + 2 * SLACK - RUN, "right")
        for begin, x, y in zip(begins.tolist(), low.tolist(), high.tolist()):
            if RUN * (y - x) >= RUNS * n and covered(np.unique(start[x:y])) >= RUNS * n and common_subsequence(doc[begin : begin + n + 2 * SLACK].tolist(), self.mask(item), n) >= SHARE * n:
                return True
        return False


def common_subsequence(words: list[int], mask: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence, n the passage's length (bit-parallel)."""
    full = (1 << n) - 1
    s = full
    for w in words:
        if m := mask.get(w):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def matches(texts: pa.Array, passages: Passages) -> list[tuple[int, int]]:
    """(row, item) of each text that holds a passage."""
    words, rows = word_hashes(texts)
    pos, hashes = fingerprints(words, rows)
    if not len(pos) or not len(passages.hashes):
        return []
    maybe, lo, n = passages.found(hashes)
    if n.sum() > MOST_HITS and len(texts) > 1:  # half of the texts at a time
        half = len(texts) // 2
        return matches(texts[:half], passages) + [(half + r, it) for r, it in matches(texts[half:], passages)]
    base = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else n
    i, j = np.repeat(maybe, n), base + np.arange(int(n.sum()))  # all equal pairs
    if not len(i):
        return []
    at, item, start = passages.runs(words, rows, pos[i], passages.item[j], passages.at[j])
    if not len(at):
        return []
    pair = rows[at] * len(passages.ids) + item
    order = np.lexsort((start, pair))
    pair, at, start = pair[order], at[order], start[order]
    # words of the passage that the text's runs cover, wherever they stand
    heads = np.concatenate(([True], pair[1:] != pair[:-1]))
    step = np.full(len(pair), RUN)
    step[1:] = np.where(heads[1:], RUN, np.minimum(start[1:] - start[:-1], RUN))
    heads = np.flatnonzero(heads)
    cover, items = np.add.reduceat(step, heads), pair[heads] % len(passages.ids)
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    tails, out = np.concatenate((heads[1:], [len(pair)])), []
    for k in np.flatnonzero(cover >= RUNS * passages.size[items]).tolist():
        r, it = divmod(int(pair[heads[k]]), len(passages.ids))
        span = slice(heads[k], tails[k])
        if passages.extends(it, words[bounds[r] : bounds[r + 1]], at[span] - bounds[r], start[span]):
            out.append((r, it))
    return out


def _chunks(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, "right")))
        yield ids.slice(a, b - a), texts.slice(a, b - a)
        a = b


def _pairs(ids: list[int], items: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])


def leaked(documents: DataFrame, passages: DataFrame, max_sent: int = MAX_SENT) -> DataFrame:
    """p9: (doc_id, item_id) of each document that holds half of a passage within one stretch."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    tests = passages.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = tests.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0)).alias("n")).first()["n"]  # at most so many words
    if size > max_sent:
        return _by_shuffle(docs, tests)
    rows = tests.orderBy("item_id").collect()
    sent = documents.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Passages(*sent.value) if sent.value[0] else None
        for batch in batches:
            for ids, texts in _chunks(batch.column(0), batch.column(1)):
                found = matches(texts, own) if own else []
                yield _pairs([ids[r].as_py() for r, _ in found], [own.ids[i] for _, i in found])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint").distinct()


def _run_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, run, times): hashes of the runs of RUN words that hold a fingerprint, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch.column(0), batch.column(1)):
                words, rows = word_hashes(texts)
                pos, _ = fingerprints(words, rows)
                at = np.unique(np.concatenate([pos - back for back in range(WINDOW)]))
                at = at[(at >= 0) & (at + RUN <= len(words))]
                at = at[rows[at] == rows[at + RUN - 1]]
                h = words[at]
                for k in range(1, RUN):
                    h = h * _P + words[at + k]
                row, h = rows[at], _mix(h).view(np.int64)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(heads, len(h)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[heads])), pa.array(h[heads]), pa.array(n)], names=[key, "run", "times"])

    return df.mapInArrow(run, f"{key} bigint, run bigint, times bigint")


def _by_shuffle(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The join for passages of any number: runs that hold a fingerprint meet by shuffle, candidates fetch their texts.

    A pair needs common runs over RUNS of the passage. So it still shares one if each passage leaves out those that
    most documents have, as long as these cover less.
    """
    runs = _run_rows(tests, "item_id").groupBy("item_id", "run").agg(F.sum("times").alias("times"))
    found = _run_rows(docs, "doc_id").select("doc_id", "run").join(runs.select("run").distinct(), "run", "left_semi")
    often = found.groupBy("run").agg(F.count("*").alias("n"))
    sizes = tests.mapInArrow(_sized, "item_id bigint, words bigint").groupBy("item_id").agg(F.min("words").alias("words"))
    # one passage's runs in a window: at most its words
    most = Window.partitionBy("item_id").orderBy(F.desc("n"), "run").rowsBetween(Window.unboundedPreceding, 0)
    ranked = runs.join(often, "run").withColumn("cover", RUN * F.sum("times").over(most))
    rare = ranked.join(sizes, "item_id").where(F.col("cover") >= RUNS * F.col("words")).select("item_id", "run")
    pairs = found.join(rare, "run").select("doc_id", "item_id").distinct()
    both = pairs.join(docs, "doc_id").join(tests.select("item_id", F.col("text").alias("passage")), "item_id").select("doc_id", "text", "item_id", "passage")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(pa.array(np.arange(batch.num_rows)), batch.column(1)):
                part = batch.slice(at[0].as_py(), len(at))
                distinct, passages = texts.dictionary_encode(), part.column(3).dictionary_encode()
                own = Passages(list(range(len(passages.dictionary))), passages.dictionary.to_pylist())
                held = set(matches(distinct.dictionary, own))
                keep = [k for k, pair in enumerate(zip(distinct.indices.to_pylist(), passages.indices.to_pylist())) if pair in held]
                kept = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2)], names=["doc_id", "item_id"])

    return both.mapInArrow(verify, "doc_id bigint, item_id bigint").distinct()


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words) of passages (item_id, text)."""
    for batch in batches:
        n = np.bincount(word_hashes(batch.column(1))[1], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["item_id", "words"])


def leak_report(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, split, source, n_documents): each passage with the number of documents that hold it."""
    n = leaked(documents, passages).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return passages.select("item_id", "split", "source").join(n, "item_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0).cast("bigint")))
