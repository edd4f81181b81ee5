"""Free-entered values mapped to the entries of a reference list.

Every entry (canonical name, long name and their usual re-arrangements) is a node of a BK-tree under the true
Damerau-Levenshtein distance. The triangle inequality prunes the search, which returns every entry within the
threshold of a value; the closest wins. A list of up to SHARD entries is one tree, broadcast to the tasks. A longer
list is cut into shards by the length of its names and beyond by hash; a form of a value meets the shards of the lengths
within its threshold, which no other entry can be, and the winners of the shards merge by (distance, spelling distance,
term id). No list longer than a shard comes to the driver or to one task.

Cases: null and missing values and exact canonical names give no rows; a value near no entry gives 0; a tie goes
to the entry whose spelling is closest, then to the smallest term id; values of any length are compared whole
(beyond the longest entry plus the threshold the length alone rules them out); an empty list gives 0 for every
value; rows that repeat come out as often as they occur.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.missing import is_missing
from sedge.sources.tables import cut

#: Entries in one tree. A list of more entries is searched shard by shard.
SHARD = 5_000
_QUOTES = "\"'“”‘’„«»`"
_DASHES = str.maketrans({c: "-" for c in "‐‑‒–—−_"})
_SEPARATOR = re.compile(r"\s*(?:[|;,/+>→&]|->|=>)\s*")
_BRACKET = re.compile(r"\s+[\(\[][^)\]]*[\)\]]$")
_SQUASH = re.compile(r"[\s\-]+")
#: Words that may surround a name, and what the short suffixes of materials mean.
BEFORE, AFTER = ("the", "by", "via", "a", "an"), ("layer", "film", "in glovebox", "in the glovebox", "process", "method", "technique")
BETWEEN = ("then", "on", "over", "on top of", "and", "plus", "followed by")
SUFFIX_WORDS = {"c": ("compact",), "mp": ("mesoporous",), "np": ("nanoparticle", "nanoparticles"), "nw": ("nanowire", "nanowires"), "nt": ("nanotube", "nanotubes")}


def tidy(value: str) -> str:
    """Compatibility forms folded, lower case, one kind of dash and blank, no outer quotes and stops."""
    v = unicodedata.normalize("NFKC", value).translate(_DASHES).lower()
    v = " ".join(v.split()).strip()
    while v and (v[0] in _QUOTES or v[-1] in _QUOTES + ".,;:"):
        v = v.strip(_QUOTES).rstrip(".,;:").strip()
    return v


def squash(v: str) -> str:
    """The form that is compared: separators as |, without blanks and dashes."""
    return _SQUASH.sub("", _SEPARATOR.sub("|", v))


_STEPS = re.compile(r",?\s*\b(?:in\s+)?\d+\s+(?:steps?|times|cycles|layers?)$")


def _starts(v: str) -> list[int]:
    """Where a value may start: at its start and after each word that may stand before a name."""
    out = [0]
    while True:
        rest = out[-1]
        word = next((w for w in BEFORE if v.startswith(w + " ", rest)), None)
        if word is None:
            return out
        rest += len(word)
        out.append(rest + len(v[rest:]) - len(v[rest:].lstrip()))


def _ends(v: str) -> list[int]:
    """Where a value may end: at its end and before whatever may stand after a name."""
    out, todo = {len(v): None}, [len(v)]
    while todo:
        x = v[: todo.pop()]
        for y in (_BRACKET.sub("", x), _STEPS.sub("", x), *(x[: -len(w) - 1].rstrip(" ,") for w in AFTER if x.endswith(" " + w))):
            end = len(y.rstrip())
            if end and end not in out:
                out[end] = None
                todo.append(end)
    return list(out)


def readings(value: str, longest: int | None = None) -> list[str]:
    """Squashed forms under which a typed value is looked up: as it is, and without what may surround a name.

    With `longest`, the forms that may be within MOST edits of a name of so many characters.
    """
    v = tidy(value)
    out: dict[str, None] = {}
    ends = _ends(v)
    for start in _starts(v):
        for end in ends:
            x = v[start:end].strip()
            if not x:
                continue
            tails = [x, x[:-2] + "ing", x[:-2] + "ion", x[:-2] + "ation"] if x.endswith("ed") else [x]
            for y in tails:
                joins = [w for w in BETWEEN if f" {w} " in y]
                for k in range(1 << len(joins)):
                    z = y
                    for i, w in enumerate(joins):
                        if k >> i & 1:
                            z = z.replace(f" {w} ", " | ")
                    z = squash(z)
                    if z and (longest is None or len(z) <= longest + MOST):
                        out[z] = None
    return list(out)


def spellings(canonical: str, long_name: str | None) -> list[str]:
    """Squashed names of an entry; "X-c" is also written "c-X", "compact X" and "X compact"."""
    parts = [p.strip() for p in tidy(canonical).split("|")]
    choices = []
    for p in parts:
        forms = [p]
        stem, dash, suffix = p.rpartition("-")
        if dash and suffix in SUFFIX_WORDS:
            forms.append(f"{suffix}-{stem}")
            for w in SUFFIX_WORDS[suffix]:
                forms += [f"{w} {stem}", f"{stem} {w}"]
        choices.append(forms)
    out = [""]
    for forms in choices:
        out = [f"{o}|{f}" if o else f for o in out for f in forms]
    names = [squash(o) for o in out]
    if long_name:
        names.append(squash(tidy(long_name)))
    return list(dict.fromkeys(n for n in names if n))


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions: a true metric."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    la, lb = len(a), len(b)
    if not la:
        return lb
    top = la + lb
    last: dict[str, int] = {}
    rows = [[top] * (la + 2), [top, *range(la + 1)]]
    for i in range(1, lb + 1):
        c, match = b[i - 1], 0
        prev, row = rows[i], [top, i] + [0] * la
        for j in range(1, la + 1):
            d = a[j - 1]
            i1 = last.get(d, 0)
            best = prev[j] if c == d else prev[j] + 1
            if row[j] + 1 < best:
                best = row[j] + 1
            if prev[j + 1] + 1 < best:
                best = prev[j + 1] + 1
            if i1 and match:
                t = rows[i1][match] + (i - i1 - 1) + 1 + (j - match - 1)
                if t < best:
                    best = t
            if c == d:
                match = j
            row[j + 1] = best
        last[c] = i
        rows.append(row)
    return rows[lb + 1][la + 1]


def distance_within(a: str, b: str, most: int) -> int:
    """distance(a, b) where that is at most `most`, else most + 1: only the diagonal band that can hold it is filled."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    la, lb, big = len(a), len(b), most + 1
    if lb - la > most:
        return big
    last: dict[str, int] = {}
    rows = [[big] * (la + 2), [big, *(min(j, big) for j in range(la + 1))]]
    for i in range(1, lb + 1):
        c, match = b[i - 1], 0
        prev, row = rows[i], [big] * (la + 2)
        low = row[1] = min(i, big)
        for j in range(max(1, i - most), min(la, i + most) + 1):
            d = a[j - 1]
            best = prev[j] if c == d else prev[j] + 1
            if row[j] + 1 < best:
                best = row[j] + 1
            if prev[j + 1] + 1 < best:
                best = prev[j + 1] + 1
            if match and (i1 := last.get(d, 0)):
                t = rows[i1][match] + (i - i1 - 1) + 1 + (j - match - 1)
                if t < best:
                    best = t
            if c == d:
                match = j
            row[j + 1] = best
            if best < low:
                low = best
        if low > most:  # a later row can't fall below: a transposition costs more than the deletions it spans
            return big
        last[c] = i
        rows.append(row)
    return min(rows[lb + 1][la + 1], big)


def bag(word: str) -> frozenset[tuple[str, int]]:
    """The characters of a word, each occurrence of one its own element."""
    seen: dict[str, int] = {}
    out = []
    for c in word:
        seen[c] = k = seen.get(c, 0) + 1
        out.append((c, k))
    return frozenset(out)


def threshold(query: str, entry: str) -> int:
    """Edits that may lie between a typed form and a name of an entry: more for longer names."""
    n = min(len(query), len(entry))
    return 0 if n < 3 else 1 if n < 9 else 2 if n < 16 else 3 if n < 24 else 4


MOST = 4


class Node:
    """A name with its payloads, its children by distance, the greatest of these and the number of nodes below."""

    __slots__ = ("name", "payload", "children", "bag", "far", "below")

    def __init__(self, name: str, payload):
        self.name, self.payload, self.children, self.bag, self.far, self.below = name, [payload], {}, bag(name), 0, 0


class BKTree:
    """Names under the distance; `names` has the nodes by name and `longest` the length of the longest."""

    def __init__(self) -> None:
        self.root: Node | None = None
        self.names: dict[str, Node] = {}
        self.longest = 0

    def add(self, name: str, payload) -> None:
        if (node := self.names.get(name)) is not None:
            node.payload.append(payload)
            return
        new = self.names[name] = Node(name, payload)
        self.longest = max(self.longest, len(name))
        if self.root is None:
            self.root = new
            return
        node = self.root
        while True:
            d = distance(name, node.name)
            node.below += 1
            if d not in node.children:
                node.children[d] = new
                node.far = max(node.far, d)
                return
            node = node.children[d]

    def within(self, query: str, radius: int) -> list[tuple[int, str, list]]:
        """Every entry at most `radius` away. A subtree is entered only where the triangle inequality allows.

        A node farther than radius + far has neither itself nor a child to enter, so its distance is worked out up to
        that only, and not at all where the lengths or the characters of both are farther apart. These also bound which
        children can be near, which is enough where fewer nodes follow than the distance would take steps.
        """
        out, todo, own, n = [], [self.root] if self.root else [], bag(query), len(query)
        while todo:
            node = todo.pop()
            most = radius + node.far
            least = max(n, len(node.name)) - len(own & node.bag)
            if least > most:
                continue
            if least > radius and node.below < n:
                todo += [child for edge, child in node.children.items() if edge >= least - radius]
                continue
            d = distance_within(query, node.name, most)
            if d <= radius:
                out.append((d, node.name, node.payload))
            if d <= most and node.children:
                todo += [child for edge, child in node.children.items() if d - radius <= edge <= d + radius]
        return out


def best_in(tree: BKTree, value: str, forms: list[str] | None = None) -> tuple[int, int, int] | None:
    """(distance, spelling distance, term id) of the closest entry of one tree."""
    forms = readings(value, tree.longest) if forms is None else forms
    exact = [term_id for f in forms if (node := tree.names.get(f)) for term_id, _ in node.payload]
    if exact:
        return 0, 0, min(exact)
    for radius in (1, MOST):
        hits = [(d, terms) for f in forms if (limit := min(radius, threshold(f, f))) for d, name, terms in tree.within(f, limit) if d <= threshold(f, name)]
        if hits:
            least, v = min(d for d, _ in hits), tidy(value)
            return min((least, distance(v, tidy(canonical)), term_id) for d, terms in hits if d == least for term_id, canonical in terms)
    return None


_FOUND = "value string, d bigint, spelling bigint, term_id bigint"


def _tree(entries: list[tuple[int, str, str | None]]) -> BKTree:
    tree = BKTree()
    for term_id, canonical, long_name in entries:
        for name in spellings(canonical, long_name):
            tree.add(name, (term_id, canonical))
    return tree


def map_values(values: DataFrame, entries: list[tuple[int, str, str | None]]) -> DataFrame:
    """(value) -> (value, d, spelling, term_id): the closest of a list of at most one shard; values near none are left out."""
    sent = values.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(sent.value)
        for batch in batches:
            found = [(v, b) for v in batch.column(0).to_pylist() if (b := best_in(tree, v)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.string())] + [pa.array([b[i] for _, b in found], pa.int64()) for i in range(3)], names=["value", "d", "spelling", "term_id"])

    return values.select("value").mapInArrow(run, _FOUND)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, name, term_id, canonical) of each name of entries (term_id, canonical, long_name)."""
    for batch in batches:
        rows = [(len(n), n, t, c) for t, c, x in zip(*(batch.column(i).to_pylist() for i in range(3))) for n in spellings(c, x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.string()))], names=["size", "name", "term_id", "canonical"])


def _formed(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(value, form, size): each form with every length that a name within its threshold may have."""
        for batch in batches:
            rows = [(v, f, n) for v in batch.column(0).to_pylist() for f in readings(v, longest) for n in range(len(f) - threshold(f, f), len(f) + threshold(f, f) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["value", "form", "size"])

    return run


def _search_shard(forms: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    tree, rows = BKTree(), []
    for name, term_id, canonical in zip(names["name"], names["term_id"], names["canonical"]):
        tree.add(name, (term_id, canonical))
    for value, own in forms.groupby("value")["form"]:
        if (b := best_in(tree, value, list(own))) is not None:
            rows.append((value, *b))
    return pd.DataFrame(rows, columns=["value", "d", "spelling", "term_id"])


def map_values_sharded(values: DataFrame, entries: DataFrame, shard: int = SHARD) -> DataFrame:
    """map_values() for a list of any length: names and forms meet by the lengths of names.

    A length with more names than a shard has several shards, and a shard with more forms than that several tasks.
    """
    names = cut(entries.select("term_id", "canonical", "long_name").mapInArrow(_named, "size int, name string, term_id bigint, canonical string"))
    sizes = {r["size"]: r["n"] for r in names.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most the length of the longest name
    forms = cut(values.select("value").mapInArrow(_formed(max(sizes, default=0)), "value string, form string, size int"))
    many = {r["size"]: r["n"] for r in forms.groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = values.sparkSession.createDataFrame([(k, -(-n // shard), -(-many[k] // (4 * shard))) for k, n in sizes.items() if k in many], "size int, _shards int, _tasks int")

    def dealt(c: str, n: str) -> Column:
        return F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = names.join(plan, "size").withColumn("_shard", dealt("name", "_shards")).withColumn("_task", every("_tasks"))
    asked = forms.join(plan, "size").withColumn("_task", dealt("value", "_tasks")).withColumn("_shard", every("_shards"))
    keys = ["size", "_shard", "_task"]
    found = asked.select(*keys, "value", "form").groupBy(*keys).cogroup(own.select(*keys, "name", "term_id", "canonical").groupBy(*keys)).applyInPandas(_search_shard, _FOUND)
    return found.groupBy("value").agg(F.min(F.struct("d", "spelling", "term_id")).alias("m")).select("value", "m.*")


def to_canonical(df: DataFrame, id_column: str, fields: list[str], terms: DataFrame, shard: int = SHARD) -> DataFrame:
    """p1: (id, field_name, term_id) of each value that isn't missing and isn't a canonical name of its field.

    Only distinct values are searched.
    """
    cells = df.select(F.col(id_column).cast("bigint").alias(id_column), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields))).alias("_x")).select(id_column, "_x.field_name", "_x.value").where(~is_missing(F.col("value")))
    names = terms.select(F.col("field_name").alias("_f"), F.col("canonical").alias("_c")).distinct()
    cells = cells.join(names, (F.col("field_name") == F.col("_f")) & (F.col("value") == F.col("_c")), "left_anti")
    winners = []
    # a search costs far more than its value's bytes, by which tasks would be merged
    n_tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = {r["field_name"]: r["n"] for r in terms.where(F.col("field_name").isin(fields)).groupBy("field_name").agg(F.count("*").alias("n")).collect()}
    for field in fields:
        mine = df.select(F.col(f"`{field}`").cast("string").alias("value")).where(~is_missing(F.col("value"))).distinct().repartition(n_tasks, "value")
        own = terms.where((F.col("field_name") == field) & F.col("canonical").isNotNull()).select("term_id", "canonical", "long_name")
        if n := sizes.get(field, 0):
            found = map_values(mine, sorted(tuple(r) for r in own.collect())) if n <= shard else map_values_sharded(mine, own, shard)
            winners.append(found.select(F.lit(field).alias("_f"), F.col("value").alias("_v"), "term_id"))
    if not winners:
        return cells.select(id_column, "field_name", F.lit(0).cast("bigint").alias("term_id"))
    found = reduce(DataFrame.unionByName, winners)
    return cells.join(found, (F.col("field_name") == F.col("_f")) & (F.col("value") == F.col("_v")), "left").select(id_column, "field_name", F.coalesce("term_id", F.lit(0)).cast("bigint").alias("term_id"))
