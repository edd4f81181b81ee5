"""Several values packed in one field: split into one row per value with its position.

Expectation-maximisation learns from the whole column how often each value and each kind of delimiter occurs;
a Viterbi lattice over the delimiters outside quotes then picks the likeliest split of each cell. Quoted spans
are atomic. A cell has one kind of delimiter (`|` and `;` may mix); a delimiter character of that kind may still
belong to a value where the column knows the value ("SiO2|SiN mesh"), whatever the number of delimiters in it.

A value that occurs in one distinct cell only scores as an unknown one does, so the model is the values beyond
that. Up to `most_sent` of them go to the tasks; more are joined to the cells that may hold them, with the same
result.

Cases: null and missing cells give no rows; an empty cell gives none; empty or missing items keep their position
but are not listed; an unclosed quote is plain text; equal-likelihood splits go to the kind listed first and then
to fewer positions; repeated cells split alike; other columns of the input are ignored; cells of any length are
split whole (time grows with the number of delimiters and of known values that start at each).
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions.missing import MISSING_TOKENS, is_missing_text
from sedge.sources.tables import cut

#: Kinds of delimiter; the last is a run of blanks.
KINDS = ("|", ";", "|;", ",", "/", "→", ">", "\t", "\n", " ")
PRIOR = {k: 1.0 for k in KINDS} | {" ": 0.05, "\n": 0.2, "|;": 0.3, "": 1.0}
#: Known values that tasks receive; beyond, they are joined to the cells.
MOST_SENT = 200_000
_OPEN = {'"': '"', "“": "”"}
_CHARS = frozenset("".join(KINDS))
_MARK, _BLANKS = re.compile(r"[|;,/→>\t\n]"), re.compile(" +")
#: Cells with neither a delimiter nor a quote nor a blank: one value.
_PLAIN = r"(?U)^[^\s|;,/→>\"“”]+$"


def atoms(cell: str) -> list[tuple[int, int]]:
    """Spans [start, end) of quoted values: quotes that open a value and close it."""
    if not any(q in cell for q in _OPEN):
        return []
    out, i, n = [], 0, len(cell)
    while i < n:
        c = cell[i]
        if c in _OPEN and (not (b := cell[:i].rstrip(" ")) or b[-1] in _CHARS or (out and out[-1][1] == len(b)) or cell[i - 1] == " "):
            close, j = _OPEN[c], i + 1
            while j < n:
                if cell[j] == close:
                    if close == '"' and j + 1 < n and cell[j + 1] == '"':
                        j += 2
                        continue
                    rest = cell[j + 1 :].lstrip(" ")
                    if not rest or rest[0] in _CHARS or (j + 1 < n and cell[j + 1] == " "):
                        break
                j += 1
            if j < n:
                out.append((i, j + 1))
                i = j + 1
                continue
        i += 1
    return out


def unquote(item: str) -> str:
    """The trimmed value without its enclosing quotes; doubled quotes inside are undone."""
    item = item.strip()
    if len(item) >= 2 and item[0] in _OPEN and item[-1] == _OPEN[item[0]]:
        inner = item[1:-1]
        return (inner.replace('""', '"') if item[0] == '"' else inner).strip()
    return item


def lattice(cell: str) -> dict[str, list[tuple[int, int]]]:
    """For each kind of delimiter that occurs outside quotes, the spans of its delimiters."""
    quoted = atoms(cell)

    def outside(m: re.Match) -> bool:
        return not any(a < m.end() and m.start() < b for a, b in quoted)

    marks: dict[str, list[tuple[int, int]]] = {}
    for m in _MARK.finditer(cell):
        if not quoted or outside(m):
            c = m.group()
            if c in marks:
                marks[c].append(m.span())
            else:
                marks[c] = [m.span()]
    out = {k: marks[k] for k in KINDS if k in marks}
    if "|" in marks and ";" in marks:
        out["|;"] = sorted(marks["|"] + marks[";"])
    if " " in cell:
        first, last = len(cell) - len(cell.lstrip()), len(cell.rstrip())
        if spans := [m.span() for m in _BLANKS.finditer(cell) if m.start() >= max(1, first) and m.end() < last and (not quoted or outside(m))]:
            out[" "] = spans
    return out


def _cut(cell: str, spans: list[tuple[int, int]]) -> list[str]:
    at, out = 0, []
    for a, b in spans:
        out.append(cell[at:a])
        at = b
    out.append(cell[at:])
    return out


_EITHER = re.compile("[|;]")


def readings(cell: str) -> dict[str, list[str]]:
    """For each kind of delimiter that occurs outside quotes, the pieces between its delimiters."""
    if any(q in cell for q in _OPEN):
        return {k: _cut(cell, s) for k, s in lattice(cell).items()}
    out: dict[str, list[str]] = {}
    for k in KINDS[:-1]:
        if k == "|;":
            if "|" in out and ";" in out:
                out[k] = _EITHER.split(cell)
        elif k in cell:
            out[k] = cell.split(k)
    if " " in cell and len(cuts := [x for x in cell.strip().split(" ") if x]) > 1:
        out[" "] = cuts
    return out


class _Values(dict):
    """The value of each piece of text seen, None for a missing one; emptied when it has grown large."""

    def __missing__(self, raw: str) -> str | None:
        if len(self) > 200_000:
            self.clear()
        item = unquote(raw)
        self[raw] = item = None if item.lower() in MISSING_TOKENS else item
        return item


_VALUES = _Values()


class _Scores(dict):
    """What a function gave for the pieces seen; emptied when it has grown large."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, raw: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[raw] = s = self.function(raw)
        return s


class Model:
    """Value and delimiter frequencies of one field."""

    def __init__(self, values: dict[str, float], kinds: dict[str, float], total: float | None = None):
        self.values, self.total = values, (sum(values.values()) if total is None else total) + 1.0
        weight = sum(kinds.values()) + 1.0
        self.kinds = {k: math.log((kinds.get(k, 0.0) + 0.02 * PRIOR[k]) / weight) for k in (*KINDS, "")}
        self.scores = _Scores(self._score)
        self.longer: dict[str, dict[str, set[int]]] = {}
        self._index(values)

    def _index(self, values: dict[str, float]) -> None:
        """For each kind, the numbers of delimiters inside known values by the piece that they start with."""
        for item, w in values.items():
            if w > 1.0 and _MARK.search(item):
                for kind in KINDS[:-1]:
                    n = sum(map(item.count, kind))
                    if n and all(c in item for c in kind):
                        start = min(item.index(c) for c in kind)
                        self.longer.setdefault(kind, {}).setdefault(item[:start].strip(), set()).add(n)

    def known(self, raw: str) -> bool:
        return self.values.get(unquote(raw), 0.0) > 1.0

    def _score(self, raw: str) -> float:
        """Log probability of one value; one occurrence is left out, as the cell itself may have brought it."""
        item = _VALUES[raw]
        if item is None:
            return math.log(0.02)
        # a value drawn from the known ones, or spelt out by characters; neither chance depends on the column's size
        known, spelt = max(0.0, self.values.get(item, 0.0) - 1.0) / self.total, math.log(0.05) - 1.8 * len(item)
        return math.log(known + math.exp(max(spelt, -700.0))) if known else spelt

    def best(self, cell: str, kind: str, cuts: list[str], least: float = -math.inf) -> tuple[float, list[str]]:
        """Viterbi over the pieces between the delimiters of one kind: the likeliest values and their log probability.

        A value with delimiters inside is an edge of the lattice where the column knows it. Scores only fall along a
        path, so one path that falls below `least` is given up (-inf).
        """
        longer, scores = self.longer.get(kind), self.scores
        starts = {i: ns for i, c in enumerate(cuts[:-1]) if (ns := longer.get(c.strip()))} if longer else {}
        if not starts:  # one path only
            total = 0.0
            for c in cuts:
                total += scores[c]
                if total < least:
                    return -math.inf, cuts
            return total, cuts
        begin, n = [0], len(cuts)
        for c in cuts:  # a delimiter is one character
            begin.append(begin[-1] + len(c) + 1)
        top, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for i in range(n):
            if (s := top[i] + scores[cuts[i]]) > top[i + 1]:
                top[i + 1], back[i + 1] = s, i
            for inside in starts.get(i, ()):
                j = i + inside + 1
                if j <= n and self.known(raw := cell[begin[i] : begin[j] - 1]) and (s := top[i] + scores[raw] - 4.0 * inside) > top[j]:
                    top[j], back[j] = s, i
        out, j = [], n
        while j:
            out.append(cell[begin[back[j]] : begin[j] - 1])
            j = back[j]
        return top[-1], out[::-1]

    def splits(self, cell: str, within: float = 20.0) -> list[tuple[float, str, list[str]]]:
        """(log probability, kind, values) of every kind that fits, "" being no list, if at most `within` below the best."""
        top = self.kinds[""] + self.scores[cell]
        out = [(top, "", [cell])]
        for kind, cuts in readings(cell).items():
            s, cuts = self.best(cell, kind, cuts, top - within - self.kinds[kind])
            s += self.kinds[kind]
            if s >= top - within:
                out.append((s, kind, cuts))
                top = max(top, s)
        return out

    def split(self, cell: str) -> list[str]:
        return max(self.splits(cell, 0.0), key=lambda x: (x[0], -len(x[2])))[2]

    def items(self, cell: str | None) -> tuple[list[int], list[str]]:
        """Positions and values of a cell that holds several, none of any other."""
        cuts = [] if is_missing_text(cell) else self.split(cell)
        if len(cuts) < 2:
            return [], []
        found = [(p, u) for p, c in enumerate(cuts, 1) if (u := unquote(c)).lower() not in MISSING_TOKENS]
        return [p for p, _ in found], [u for _, u in found]


def _expected(cells: Iterator[tuple[str, str, Model | None]]) -> dict[tuple[str, str, str], float]:
    """E-step: expected counts of values (what = 'v') and delimiter kinds ('k') over (field, cell, model)."""
    kinds: dict[tuple[str, str], float] = defaultdict(float)
    values: dict[str, dict[str, float]] = {}
    known = _VALUES
    for field, cell, model in cells:
        if model is None:
            # before anything is known: kinds by prior, the more of its delimiters a cell has the likelier
            weights = [(PRIOR[""] * 0.3, "", [cell])] + [(PRIOR[k] * len(cuts), k, cuts) for k, cuts in readings(cell).items()]
        else:
            scored = model.splits(cell)
            m = max(s for s, _, _ in scored)
            weights = [(math.exp(s - m), k, c) for s, k, c in scored if s > m - 20]
        total = sum([w for w, _, _ in weights])
        own = values.get(field)
        if own is None:
            own = values[field] = defaultdict(float)
        for w, kind, cuts in weights:
            w /= total
            if w < 1e-6:
                continue
            kinds[field, kind] += w
            for c in cuts:
                if (item := known[c]) is not None:
                    own[item] += w
    return {(f, "k", k): w for (f, k), w in kinds.items()} | {(f, "v", v): w for f, own in values.items() for v, w in own.items()}


_SUMS = "field_name string, what string, item string, w double"
_KNOWN = "array<struct<item:string,w:double>>"


def _sums_batch(sums: dict[tuple[str, str, str], float]) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([sums[k] for k in keys], pa.float64())], names=["field_name", "what", "item", "w"])


class Learned:
    """What a round has learned: kinds and totals by field, and the known values as rows or, where few, in memory."""

    def __init__(self, sums: DataFrame, fields: list[str], most_sent: int):
        self.known = sums.where((F.col("what") == "v") & (F.col("w") > 1.0)).select("field_name", "item", "w")
        small = sums.groupBy("field_name", F.when(F.col("what") == "k", F.col("item")).alias("kind")).agg(F.sum("w").alias("w"), F.count_if(F.col("w") > 1.0).alias("n")).collect()  # at most a row a field and kind
        self.kinds = {f: {r["kind"]: r["w"] for r in small if r["field_name"] == f and r["kind"] is not None} for f in fields}
        self.totals = {f: sum(r["w"] for r in small if r["field_name"] == f and r["kind"] is None) for f in fields}
        self.sent: dict[str, dict[str, float]] | None = None
        if sum(r["n"] for r in small if r["kind"] is None) <= most_sent:
            self.sent = {f: {} for f in fields}
            for r in self.known.collect():
                self.sent[r["field_name"]][r["item"]] = r["w"]

    def tables(self) -> dict[str, tuple]:
        return {f: (self.sent[f] if self.sent else {}, self.kinds[f], self.totals[f]) for f in self.kinds}

    def with_known(self, cells: DataFrame) -> DataFrame:
        """Cells with the known values that they may hold: every run of pieces with as many delimiters as some known
        value of the field has."""
        inside = {(r["field_name"], k): r[str(i)] for r in self.known.groupBy("field_name").agg(*(F.max(sum((F.length("item") - F.length(F.replace("item", F.lit(c), F.lit(""))) for c in k), F.lit(0))).alias(str(i)) for i, k in enumerate(KINDS))).collect() for i, k in enumerate(KINDS)}

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for field, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = {unquote(cell)}
                    for kind, spans in lattice(cell).items():
                        begin, end = [0, *(e for _, e in spans)], [*(s for s, _ in spans), len(cell)]
                        deep = 0 if kind == " " else inside.get((field, kind)) or 0
                        found |= {unquote(cell[begin[i] : end[j]]) for i in range(len(begin)) for j in range(i, min(len(end), i + 1 + deep))}
                    rows += [(field, cell, x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["field_name", "cell", "item"])

        met = cells.mapInArrow(pieces, "field_name string, cell string, item string").join(self.known, ["field_name", "item"])
        lists = met.groupBy("field_name", "cell").agg(F.collect_list(F.struct("item", "w")).alias("known"))  # pieces of one cell
        return cells.join(lists, ["field_name", "cell"], "left").select("field_name", "cell", F.coalesce("known", F.array().cast(_KNOWN)).alias("known"))


def _models(tables: dict[str, tuple]) -> dict[str, Model]:
    return {f: Model(dict(values), kinds, total) for f, (values, kinds, total) in tables.items()}


def _rows(batch: pa.RecordBatch, tables: dict[str, tuple] | None, models: dict[str, Model]) -> Iterator[tuple[str, str, Model | None]]:
    """(field, cell, model) of a batch; with a column of known values each cell has a model of its own."""
    fields, cells = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    if batch.num_columns == 2:
        yield from ((f, c, models.get(f)) for f, c in zip(fields, cells))
        return
    for f, c, known in zip(fields, cells, batch.column(2).to_pylist()):
        yield f, c, Model({x["item"]: x["w"] for x in known}, tables[f][1], tables[f][2])


def learn(df: DataFrame, fields: list[str], rounds: int = 3, most_sent: int = MOST_SENT) -> Learned | None:
    """EM over every distinct cell of the fields; a value counts once for each distinct cell that holds it."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("cell")) for f in fields))).alias("x")).select("x.*")
    cells = cut(cells.where("cell IS NOT NULL AND length(trim(cell)) > 0").distinct())
    # a cell without delimiters has one reading, the same in each round
    plain = F.col("cell").rlike(_PLAIN)
    alone = cells.where(plain)
    fixed = alone.where(~F.lower("cell").isin(*MISSING_TOKENS)).select("field_name", F.lit("v").alias("what"), F.col("cell").alias("item"), F.lit(1.0).alias("w"))
    fixed = fixed.union(alone.groupBy("field_name").agg(F.count("*").cast("double").alias("w")).select("field_name", F.lit("k"), F.lit(""), "w"))
    several = cells.where(~plain)
    learned: Learned | None = None
    for _ in range(rounds):
        source, sent = several, None
        if learned is not None:
            source = several if learned.sent is not None else learned.with_known(several)
            sent = df.sparkSession.sparkContext.broadcast(learned.tables())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tables = sent.value if sent else None
            models = _models(tables) if tables else {}
            for batch in batches:
                yield _sums_batch(_expected(_rows(batch, tables, models)))

        sums = cut(source.mapInArrow(run, _SUMS).union(fixed).groupBy("field_name", "what", "item").agg(F.sum("w").alias("w")))
        learned = Learned(sums, fields, most_sent)
    return learned


def split_packed(df: DataFrame, id_column: str, fields: list[str], rounds: int = 3, most_sent: int = MOST_SENT) -> DataFrame:
    """p7: (id, field_name, pos, item) of every cell with two or more positions; pos counts from 1."""
    learned = learn(df, fields, rounds, most_sent)
    rows = df.select(F.col(id_column).cast("bigint").alias(id_column), *(F.col(f"`{f}`").cast("string").alias(f) for f in fields))
    sent = df.sparkSession.sparkContext.broadcast(learned.tables())
    schema = f"`{id_column}` bigint, field_name string, pos bigint, item string"
    if learned.sent is None:
        return _split_joined(rows, id_column, fields, learned, sent).select(id_column, "field_name", "pos", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(sent.value)
        memo: dict[str, dict[str, tuple]] = {f: {} for f in fields}
        for batch in batches:
            for k, f in enumerate(fields, 1):
                own, model = memo[f], models[f]
                coded = batch.column(k).dictionary_encode()
                words = coded.dictionary.to_pylist()
                if len(own) + len(words) > 100_000:
                    own.clear()
                for w in words:
                    if w not in own:
                        own[w] = model.items(w)
                # each distinct cell of the batch is converted once, its rows take it
                pos = pa.array([own[w][0] for w in words], pa.list_(pa.int64())).take(coded.indices)
                items = pa.array([own[w][1] for w in words], pa.list_(pa.string())).take(coded.indices)
                ids = batch.column(0).take(pc.list_parent_indices(pos))
                yield pa.RecordBatch.from_arrays([ids, pa.repeat(pa.scalar(f), len(ids)), pc.list_flatten(pos), pc.list_flatten(items)], names=[id_column, "field_name", "pos", "item"])

    return rows.mapInArrow(run, schema)


def _split_joined(rows: DataFrame, id_column: str, fields: list[str], learned: Learned, sent) -> DataFrame:
    """Distinct cells are split with the known values joined to them, and rows meet the splits of their cells."""
    each = rows.select(F.col(id_column), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("cell")) for f in fields))).alias("x")).select(id_column, "x.field_name", "x.cell").where("cell IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(f, c, *m.items(c)) for f, c, m in _rows(batch, sent.value, {})]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())))], names=["field_name", "cell", "pos", "items"])

    cells = each.select("field_name", "cell").distinct().where(~F.col("cell").rlike(_PLAIN))
    split = learned.with_known(cells).mapInArrow(run, "field_name string, cell string, pos array<bigint>, items array<string>").where(F.size("pos") > 0)
    met = each.join(split, ["field_name", "cell"]).select(id_column, "field_name", F.explode(F.arrays_zip("pos", "items")).alias("x"))
    return met.select(id_column, "field_name", F.col("x.pos").alias("pos"), F.col("x.items").alias("item"))
