"""The same or almost the same recipe in a training and an evaluation split.

A user's messages are read as labelled lines; each line's value is canonicalised (case, punctuation, blanks, number
format) and hashed. Equal sets of lines form a class. Classes of the evaluation splits are joined with classes of
the training split on the class hash and, for almost equal ones, on hashes of some lines: the usual lines, ranked by
how seldom they agree by chance, are dealt into groups of three. MAX_OTHER differing lines spoil as many groups at most, so two classes
that have more groups in common agree in one. Classes that lack too many lines for that meet on groups of two,
and the few that lack too many for these on blocks of the lines that both have. Joined classes are compared line by line,
so no pair is lost and none is taken for its hash alone.

Cases: null messages, contents and messages of fewer than FEWEST lines match nothing; a label given twice keeps
its first value; misspelt and re-worded labels go to the nearest usual label, other rare labels stand for themselves, and where two recipes have few usual lines in common, rare ones are joined; a line that
one side lacks says nothing; texts of any length are read whole; repeated examples come out as all their pairs across splits.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.canon import distance
from sedge.sources.tables import SMALL, cut, cut_packed, small

#: Words that labels use for one another.
SAME_WORD = {"absorber": "perovskite"}
MIN_LINES, MAX_OTHER = 6, 2
#: So many lines of two recipes must agree; a message with fewer can't meet that.
FEWEST = MIN_LINES - MAX_OTHER
#: Bits of a line in a signature.
SIGNED = 3
#: (lines in a group, groups): the groups whose hashes are joined, tried in this order. Masks of groups stay small.
LEVELS = ((3, 7), (2, 8))
#: A label is usual if this share of the recipes has it: misspelt labels go to usual ones, and usual lines are hashed.
USUAL = 0.01
_LINE = re.compile(r"^[^\w\n]*([^:=\n]{2,80}+)[ \t]*[:=][ \t]*(.+)$", re.M)
_INLINE = re.compile(r"(?:^|[;.\n])\s*([A-Za-z][A-Za-z ]{2,70}?)\s*=\s*")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_WORD = re.compile(r"[^\W_]+(?:\.\d+)?")


def _plain(m: re.Match) -> str:
    s = m.group(0)
    if "." in s:
        s = s.rstrip("0").rstrip(".")
    return s.lstrip("0") or "0"


def canonical(value: str) -> str:
    """A line's value without case, punctuation, blanks and number formats."""
    return " ".join(_WORD.findall(_NUMBER.sub(_plain, unicodedata.normalize("NFKC", value).casefold())))


def _label(text: str) -> str:
    return " ".join(SAME_WORD.get(w, w) for w in re.findall(r"\w+", text.lower()))


def lines_of(text: str | None) -> list[tuple[str, str]]:
    """(label, value) as written, from one line a label or from "label = value; label = value"."""
    if not text:
        return []
    marks = list(_INLINE.finditer(text)) if "=" in text else []
    lines = _LINE.findall(text) if len(marks) < MIN_LINES else []
    if len(marks) >= MIN_LINES or len(marks) >= FEWEST and len(marks) > len(lines):
        return [(a.group(1), text[a.end() : b.start() if b else len(text)]) for a, b in zip(marks, [*marks[1:], None])]
    return lines


def read_recipe(text: str | None) -> dict[str, str]:
    """label -> canonical value."""
    out: dict[str, str] = {}
    for label, value in lines_of(text):
        if value := canonical(value):
            out.setdefault(_label(label), value)
    return out


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


class _Memo(dict):
    """What a function gave for its last arguments; emptied when it has grown large."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, key):
        if len(self) > 200_000:
            self.clear()
        self[key] = out = self.function(key)
        return out


def _value_hash(value: str) -> int | None:
    return hash64(v) if (v := canonical(value)) else None


def _recipe(text: str | None, names: dict, hashes: dict) -> dict[str, int]:
    """label -> hash of the value; names and hashes are memos."""
    out: dict[str, int] = {}
    for label, value in lines_of(text):
        if (h := hashes[value]) is not None:
            out.setdefault(names[label], h)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, n): the recipes that have a label, with null for any."""
    names, hashes = _Memo(_label), _Memo(_value_hash)
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["label", "n"])

    for batch in batches:
        for text in batch.column(3).to_pylist():
            if len(r := _recipe(text, names, hashes)) >= FEWEST:
                n.update(r.keys())
                n.update((None,))
        if len(n) > 200_000:
            yield out()
            n.clear()
    yield out()


def nearest(label: str, usual: list[str]) -> str | None:
    """The usual label at the least distance, if that is small for its length."""
    best = min(((distance(label, u), u) for u in usual if abs(len(u) - len(label)) <= 3), default=None)
    return best[1] if best and best[0] <= max(1, min(3, len(best[1]) // 6)) else None


def _labelled(usual: list[str]):
    """Labels as places: a usual one is its index, any other its hash, which is greater."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {u: i for i, u in enumerate(usual)}

        def of(label: str) -> int:
            near = label if label in place else nearest(label, usual)
            return place[near] if near else (hash64(label) & (1 << 62) - 1) | 1 << 62

        names, values, places = _Memo(_label), _Memo(_value_hash), _Memo(of)
        for batch in batches:
            keep, at, hashes, kinds = [], [], [], []
            for k, text in enumerate(batch.column(3).to_pylist()):
                lines: dict[int, int] = {}
                for label, v in _recipe(text, names, values).items():
                    lines.setdefault(places[label], v)
                if len(lines) < FEWEST:
                    continue
                ordered = sorted(lines.items())
                keep.append(k)
                at.append([p for p, _ in ordered])
                hashes.append([v for _, v in ordered])
                kinds.append(hashlib.blake2b(array("q", at[-1] + hashes[-1]).tobytes(), digest_size=16).digest())
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(3)), pa.array(kinds, pa.binary()), pa.array(at, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))], names=["example_id", "split", "source", "recipe", "at", "hashes"])

    return run


def recipes(examples: DataFrame) -> tuple[DataFrame, list[str]]:
    """(example_id, split, source, recipe, at, hashes) with the class of each readable recipe, and the usual labels.

    The texts are read twice, as what is read of them takes more room than they do.
    """
    said = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]), "\n")
    texts = examples.select(F.col("example_id").cast("bigint"), F.col("split").cast("string"), F.col("source").cast("string"), said.alias("text"))
    counts = texts.mapInArrow(_counted, "label string, n bigint").groupBy("label").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    n = counts.where("label IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    usual = sorted(r["label"] for r in counts.where(F.col("label").isNotNull() & (F.col("n") >= max(1.0, USUAL * n))).collect())
    return texts.mapInArrow(_labelled(usual), "example_id bigint, split string, source string, recipe binary, at array<bigint>, hashes array<bigint>"), usual


def dealt(ranked: list[int], size: int, most: int) -> list[tuple[int, ...]]:
    """Groups of so many lines, each with lines of all ranks."""
    n = min(most, len(ranked) // size)
    return [tuple(ranked[g + k * n] for k in range(size)) for g in range(n)]


def _described(ranked: list[int]):
    """Adds to classes: rare (its unusual lines), signature, and for each level mask and keys.

    A mask has a bit for each group of which a class has all lines, and there is a key for each of them. A signature has three
    bits for each of the first lines: 0 where a class lacks it, else a number by its value.
    """
    groups, first = [dealt(ranked, size, most) for size, most in LEVELS], ranked[: 63 // SIGNED]
    rank = np.full(max(ranked, default=0) + 1, -1)
    rank[ranked] = np.arange(len(ranked))
    wide = min(len(ranked), max([len(first), *(1 + max((int(rank[p]) for g in gs for p in g), default=-1) for gs in groups)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.num_rows, batch.column("at")
            places = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            k = np.where(places < len(rank), rank[np.minimum(places, len(rank) - 1)], -1)
            here = (k >= 0) & (k < wide)
            has, value = np.zeros((n, wide), bool), np.zeros((n, wide), np.uint64)
            has[row[here], k[here]] = True
            value[row[here], k[here]] = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)[here].view(np.uint64)
            signature = np.zeros(n, np.int64)
            for i in range(len(first)):
                signature |= np.where(has[:, i], (value[:, i] % np.uint64(7)).astype(np.int64) + 1, 0) << SIGNED * i
            out = [pa.array(np.bincount(row[k < 0], minlength=n).astype(np.int32)), pa.array(signature)]
            for gs in groups:
                whole, keys = np.zeros((n, len(gs)), bool), np.zeros((n, len(gs)), np.uint64)
                for i, g in enumerate(gs):
                    ks = rank[list(g)]
                    whole[:, i] = has[:, ks].all(1)
                    h = np.full(n, i + 1, np.uint64)
                    for c in ks:
                        h = (h ^ value[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(32)
                    keys[:, i] = h
                ends = np.concatenate([[0], np.cumsum(whole.sum(1))]).astype(np.int32)
                out += [pa.array((whole << np.arange(len(gs))).sum(1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[whole].view(np.int64)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *_DESCRIBED])

    return run


_DESCRIBED = {"rare": "int", "signature": "bigint"} | {k: t for i in range(len(LEVELS)) for k, t in ((f"mask{i}", "int"), (f"keys{i}", "array<bigint>"))}


def _given(signature: Column) -> Column:
    """A bit for each number of a signature that isn't 0."""
    low = F.lit(sum(1 << SIGNED * i for i in range(63 // SIGNED))).cast("bigint")
    return signature.bitwiseOR(F.shiftrightunsigned(signature, 1)).bitwiseOR(F.shiftrightunsigned(signature, 2)).bitwiseAND(low)


def _both() -> Column:
    return _given(F.col("signature_a")).bitwiseAND(_given(F.col("signature_b")))


def _may_agree() -> Column:
    """No more lines differ by the signatures than may; numbers differ only where lines do, so no pair is lost."""
    return F.bit_count(_given(F.col("signature_a").bitwiseXOR(F.col("signature_b"))).bitwiseAND(_both())) <= MAX_OTHER


def _named(classes: DataFrame, side: str, keys: Column, *keep: str) -> DataFrame:
    """(key, id_<side>, signature_<side>, keep...) of each key."""
    return classes.select(F.explode(F.array_compact(keys)).alias("key"), *(F.col(c).alias(f"{c}_{side}") for c in ("id", "signature", *keep)))


def _keyed(classes: DataFrame, level: int, side: str, *keep: str) -> DataFrame:
    """The keys of the groups that a class has."""
    return _named(classes, side, F.col(f"keys{level}"), *keep)


def _sizes(classes: DataFrame) -> tuple[list[dict[str, Counter]], bool]:
    """How many classes have a mask, by level and side, at most two to the power of the groups; whether both sides have
    classes with several unusual lines."""
    masks = [f"mask{k}" for k in range(len(LEVELS))]
    rows = classes.groupBy(*masks).agg(*(F.count_if(s).alias(s) for s in ("train", "eval")), *(F.count_if(F.col(s) & (F.col("rare") >= 2)).alias(f"rare_{s}") for s in ("train", "eval"))).collect()
    out = [{s: Counter() for s in ("train", "eval")} for _ in masks]
    for r in rows:
        for k, m in enumerate(masks):
            for s in ("train", "eval"):
                out[k][s].update({r[m]: r[s]} if r[s] else {})
    return out, all(any(r[f"rare_{s}"] for r in rows) for s in ("train", "eval"))


def _unsure(masks: list[dict[str, Counter]], level: int) -> list[tuple[int, int]]:
    """Masks of a training and an evaluation class with too few common groups to be sure that one agrees."""
    return [(a, b) for a in masks[level]["train"] for b in masks[level]["eval"] if (a & b).bit_count() <= MAX_OTHER]


def _meetings(unsure: list[tuple[int, int]], sizes: dict[str, Counter], keys: int) -> list[tuple[set[int], set[int], str]]:
    """(masks of training, masks of evaluation, side to broadcast) of joins in which all unsure masks meet.

    Of an unsure pair the side with fewer groups is seldom, the more so the fewer; the seldom ones that are few go to
    all of the other side, and the others meet only those that lack enough groups too.
    """
    out = []
    for few, side in ((0, "train"), (1, "eval")):
        mine = [p for p in unsure if (p[0].bit_count() <= p[1].bit_count()) == (few == 0)]
        rows = Counter()
        for m in {p[few] for p in mine}:
            rows[m.bit_count()] += keys * sizes[side][m]
        sent, most = 0, -1
        for n in sorted(rows):
            if (sent := sent + rows[n]) > SMALL:
                break
            most = n
        for met, send in (([p for p in mine if p[few].bit_count() <= most], side), ([p for p in mine if p[few].bit_count() > most], "")):
            if met:
                out.append(({a for a, _ in met}, {b for _, b in met}, send))
    return out


def _candidates(classes: DataFrame, ranked: list[int]) -> DataFrame:
    """(id_a, id_b): all pairs with at most MAX_OTHER differing lines, and others.

    Where two classes meet, their signatures are compared, so that few other pairs leave a join.
    """
    whole = classes.mapInArrow(_described(ranked), ", ".join([*(f"{c} {t}" for c, t in classes.dtypes), *(f"{c} {t}" for c, t in _DESCRIBED.items())]))
    classes = cut_packed(whole.drop("at", "hashes"))
    left, right = classes.where("train"), classes.where("eval")
    masks, rare = _sizes(classes)
    out = _keyed(left, 0, "a").join(_keyed(right, 0, "b"), "key").where(_may_agree()).select("id_a", "id_b")
    unsure = _unsure(masks, 0)
    for level in range(1, len(LEVELS)):
        before = f"mask{level - 1}"
        for a, b, send in _meetings(unsure, masks[level - 1], LEVELS[level][1]):
            x, y = _keyed(left.where(F.col(before).isin(a)), level, "a", before), _keyed(right.where(F.col(before).isin(b)), level, "b", before)
            met = (F.broadcast(x) if send == "train" else x).join(F.broadcast(y) if send == "eval" else y, "key")
            out = out.unionByName(met.where((F.bit_count(F.col(f"{before}_a").bitwiseAND(F.col(f"{before}_b"))) <= MAX_OTHER) & _may_agree()).select("id_a", "id_b"))
        unsure = unsure and _unsure(masks, level)
    if unsure:
        out = out.unionByName(_block_pairs(whole.withColumn("mask", F.col(f"mask{len(LEVELS) - 1}")), unsure, ranked))
    if rare:
        # with too few common usual lines for blocks, two unusual ones must agree
        tokens = F.transform(F.filter(F.arrays_zip(F.col("at").alias("p"), F.col("hashes").alias("h")), lambda x: ~F.array_contains(F.array(*map(F.lit, ranked)).cast("array<bigint>"), x["p"])), lambda x: F.xxhash64(x["p"], x["h"]))
        x, y = (_named(c.where("rare >= 2"), s, tokens) for c, s in ((whole.where("train"), "a"), (whole.where("eval"), "b")))
        out = out.unionByName(x.join(y, "key").where(_may_agree() & (F.bit_count(_both()) <= MAX_OTHER)).select("id_a", "id_b"))
    return out


def _block_pairs(classes: DataFrame, unsure: list[tuple[int, int]], ranked: list[int]) -> DataFrame:
    """Candidates among the classes whose masks of the last level are unsure together, without loss.

    How many of their lines may differ is known from the two sets of labels alone, as FEWEST must agree. The common usual
    lines are dealt into one block more than that; one block agrees. Pairs with too few of them have unusual lines in common.
    """
    usual = F.array(*map(F.lit, ranked)).cast("array<bigint>")
    own = classes.withColumn("lines", F.array_intersect(usual, "at"))
    shapes = cut_packed(own.groupBy("lines", "rare", "mask").agg(F.max("train").alias("train"), F.max("eval").alias("eval")))
    a = shapes.where("train").select(F.col("mask").alias("ma"), F.col("lines").alias("lines_a"), F.col("rare").alias("rare_a"))
    b = shapes.where("eval").select(F.col("mask").alias("mb"), F.col("lines").alias("lines_b"), F.col("rare").alias("rare_b"))
    risky = classes.sparkSession.createDataFrame(unsure, "ma int, mb int")
    most = F.size("both") + F.least("rare_a", "rare_b")
    fewer = F.least(F.size("lines_a") + F.col("rare_a"), F.size("lines_b") + F.col("rare_b"))
    shared = risky.join(a, "ma").join(b, "mb").withColumn("both", F.array_intersect("lines_a", "lines_b")).where(2 * most >= fewer)
    shared = shared.withColumn("other", F.least(F.lit(MAX_OTHER), most - FEWEST)).where((F.col("other") >= 0) & (F.size("both") > F.col("other")))
    shared = cut_packed(shared.select("lines_a", "rare_a", "lines_b", "rare_b", "both", "other"))

    def keyed(side: str, x: str) -> DataFrame:
        value = F.map_from_arrays("at", "hashes")

        def block(n: int) -> Column:
            return F.transform(F.filter("both", lambda _, i: i % (F.col("other") + 1) == n), lambda p: F.element_at(value, p))

        keys = F.array(*(F.when(F.col("other") >= n, F.xxhash64("both", "other", F.lit(n), block(n))) for n in range(MAX_OTHER + 1)))
        meet = shared.select(F.col(f"lines_{x}").alias("lines"), F.col(f"rare_{x}").alias("rare"), "both", "other").distinct()
        return _named(own.where(side).join(meet, ["lines", "rare"]), x, keys)

    return keyed("train", "a").join(keyed("eval", "b"), "key").where(_may_agree()).select("id_a", "id_b")


def same_recipes(classes: DataFrame, usual: list[str]) -> DataFrame:
    """(recipe_a, recipe_b): a training and an evaluation class with at most MAX_OTHER lines that differ.

    At least half of the lines of one must be common, and FEWEST of them must agree.
    """
    # how often two classes agree in a line by chance, lines that few have last, from counts of values by the last bits of their hash
    values = classes.select(F.explode(F.arrays_zip(F.col("at").alias("p"), F.col("hashes").alias("h"))).alias("x")).where(F.col("x.p") < len(usual)).groupBy(F.col("x.p").alias("p"), F.col("x.h").bitwiseAND(1023).alias("h")).agg(F.count("*").cast("double").alias("n"))
    chance = {r["p"]: (r["n"], r["c"]) for r in values.groupBy("p").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("c")).collect()}
    most = max((n for n, _ in chance.values()), default=0.0)
    ranked = sorted(chance, key=lambda i: (2 * chance[i][0] < most, chance[i][1], i))
    classes = classes.select("recipe", "at", "hashes", "train", "eval", F.xxhash64("recipe").alias("id"))
    pairs = cut_packed(_candidates(classes.drop("recipe"), ranked).distinct())
    met = small(pairs, 10 * SMALL)  # two numbers a row
    lines = [met.join(classes.where(side).withColumnRenamed("id", f"id_{x}"), f"id_{x}").select("id_a", "id_b", *(F.col(c).alias(f"{c}_{x}") for c in ("recipe", "at", "hashes"))) for x, side in (("a", "train"), ("b", "eval"))]
    both = lines[0].join(lines[1], ["id_a", "id_b"]).where("recipe_a <> recipe_b")
    common = F.size(F.array_intersect("at_a", "at_b"))
    # lines with the same place and value on both sides
    same = F.size(F.array_intersect(F.arrays_zip(F.col("at_a").alias("p"), F.col("hashes_a").alias("h")), F.arrays_zip(F.col("at_b").alias("p"), F.col("hashes_b").alias("h"))))
    both = both.select("recipe_a", "recipe_b", common.alias("common"), same.alias("same"), F.least(F.size("at_a"), F.size("at_b")).alias("fewer"))
    return both.where((F.col("common") - F.col("same") <= MAX_OTHER) & (2 * F.col("common") >= F.col("fewer")) & (F.col("same") >= FEWEST)).select("recipe_a", "recipe_b")


def _near(examples: DataFrame, train: str) -> tuple[DataFrame, DataFrame]:
    """Readable examples, and the pairs (recipe_a, recipe_b) of classes of training and evaluation that are the same."""
    found, usual = recipes(examples)
    found = cut_packed(found.where(F.col("split").isNotNull()))
    is_train = F.col("split") == train
    classes = cut_packed(found.groupBy("recipe").agg(F.first("at").alias("at"), F.first("hashes").alias("hashes"), F.max(is_train).alias("train"), F.max(~is_train).alias("eval")))
    same = classes.where("train AND eval").select(F.col("recipe").alias("recipe_a"), F.col("recipe").alias("recipe_b"))
    return found, same_recipes(classes, usual).unionByName(same)


def cross_split_pairs(examples: DataFrame, train: str = "train") -> DataFrame:
    """p5: (example_id_a, example_id_b), a < b, of each training and evaluation example with the same recipe.

    Pairs are as many as copies times copies: only where an id is given twice can one come out twice, and are all compared.
    """
    found, near = _near(examples, train)
    a = found.where(F.col("split") == train).select(F.col("example_id").alias("t_id"), F.col("recipe").alias("recipe_a"))
    b = found.where(F.col("split") != train).select(F.col("example_id").alias("e_id"), F.col("recipe").alias("recipe_b"))
    pairs = near.join(a, "recipe_a").join(b, "recipe_b").select(F.least("t_id", "e_id").alias("example_id_a"), F.greatest("t_id", "e_id").alias("example_id_b"))
    once = found.groupBy("example_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return pairs if once else pairs.distinct()


def overlap_report(examples: DataFrame, train: str = "train") -> DataFrame:
    """(split, source, n_examples, n_exact, n_pairs): overlaps of the evaluation splits by split and source.

    Pairs are counted from the sizes of the training classes, not made.
    """
    found, near = _near(examples, train)
    sizes = found.where(F.col("split") == train).groupBy(F.col("recipe").alias("recipe_a")).agg(F.count("*").alias("n"))
    each = near.join(sizes, "recipe_a").groupBy("recipe_b").agg(F.sum("n").alias("n"), F.max(F.col("recipe_a") == F.col("recipe_b")).alias("exact"))
    rows = found.where(F.col("split") != train).select("split", "source", F.col("recipe").alias("recipe_b")).join(each, "recipe_b")
    return rows.groupBy("split", "source").agg(F.count("*").alias("n_examples"), F.count_if("exact").alias("n_exact"), F.sum("n").alias("n_pairs"))
