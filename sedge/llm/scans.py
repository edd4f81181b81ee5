"""Noise in the text of scanned pages: page furniture, words broken at line ends, misread characters.

Furniture is looked for near page edges: page numbers that count up through a paper mark the edges, and a line near
an edge is furniture if its like stands near another edge of the paper, or usually does so in other papers. Broken
words are joined with or without their hyphen, as the collection's word counts say. Rare words are joined in SQL
with frequent words whose anagram hash differs by that of a known confusion; the most frequent that the confusion
really turns into the rare word is the correction. Numbers in table cells are read digit by digit.

Cases: null texts, tables, rows and cells give nothing; an empty text has no lines that count; a paper without page
numbers has its first and last lines as edges only; a tie between corrections goes to the more frequent word, then
to the later in the alphabet; a paper is read whole, whatever its length; repeated papers come out each; columns
with clashing names aren't used.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.canon import distance_within
from sedge.sources.tables import cut, small

#: Right and misread characters of words, in lower case.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("t", "†"), ("n", "ri"), ("ri", "n"), ("a", "@"), ("s", "5"), ("i", "1"), ("l", "1"), ("o", "0"), ("l", "i"), ("i", "l"), ("d", "cl"), ("cl", "d"),
    ("m", "rn"), ("rn", "m"), ("u", "ii"), ("g", "9"), ("h", "b"), ("b", "h"), ("w", "vv"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("l", "|"), ("i", "|"), ("i", "!"), ("b", "6"), ("z", "2"), ("q", "9"), ("s", "$"), ("e", "€"), ("g", "q"), ("o", "°"), ("li", "h"), ("h", "li"), ("n", "ii"), ("in", "m"), ("m", "in"), ("m", "nn"), ("u", "v"), ("v", "u"), ("t", "+"), ("t", "7"), ("a", "4"), ("e", "3"), ("b", "8"),
)
#: What digits are misread as.
DIGITS = str.maketrans("OoQlI|!zZSs$GbB&gq", "000111122555688899")
#: Hyphens at a line's end, and punctuation around words.
HYPHENS, AROUND = "-‐‑­¬", ".,;:()[]{}\"'“”‘’„?…"
NEAR = 3
_NUMBER_LINE = re.compile(r"^(?:p\.|page|pg\.|s)?(\d+)(?:of\d+|/\d+)?$")
_FLOAT = re.compile(r"(?i)^(?:figure|fig\.?|table|scheme)\s")
_DIGITISH = re.compile(r"(?<![^\W\d_])[\dOolI|SQ]*\d[\dOolI|SQ]*(?![^\W\d_])")


#: A line with a page number alone has "page" and "of" or six misread digits, no more letters.
_FEW_LETTERS = re.compile(r"[\W_\d]*(?:[^\W\d_][\W_\d]*){0,8}\Z")
_AROUND_NUMBER = re.compile(r"[\s\-–—−\[\]()|.~*•]+")


def page_number(line: str) -> int | None:
    """The number of a line that holds a page number and nothing else."""
    if not _FEW_LETTERS.match(line) or not _HAS_DIGIT.search(line):
        return None
    s = _AROUND_NUMBER.sub("", line.replace("p.", "p").replace("P.", "p")).lower()
    m = _NUMBER_LINE.match(s.replace("p", "p.", 1) if s.startswith("p") and not s.startswith("pa") and not s.startswith("pg") else s)
    if m and len(m.group(1)) <= 6:
        return int(m.group(1))
    t = s[1:] if s[:1] == "s" else s
    t = t.translate(DIGITS)
    return int(t) if t.isdigit() and len(t) <= 6 and any(c.isdigit() for c in s) else None


_FOLD_TWO = re.compile("ri|rn|cl|ii|vv|nn")
#: Characters that are misread as one another fold to one; so do the pairs that are misread as one character.
_FOLD = str.maketrans("1i|!0596c†@b€$", "llllosgbetahes")
_FOLD_PAIRS = {"ri": "n", "rn": "m", "cl": "d", "ii": "u", "vv": "w", "nn": "m"}
_FOLD = {c: _FOLD.get(ord(f) if isinstance(f, str) else f, f) for c, f in _FOLD.items()}  # what a folded character folds to


def folded(word: str) -> str:
    """A word in lower case whose misread forms fold to the same letters."""
    return _FOLD_TWO.sub(lambda m: _FOLD_PAIRS[m.group(0)], word.lower()).translate(_FOLD)


_HAS_DIGIT = re.compile(r"\d")


def _is_number(core: str) -> bool:
    digits = len(_HAS_DIGIT.findall(core))
    return digits > 2 or (digits > 0 and 2 * digits >= len(core))


class _Memo(dict):
    """What a function gave for the tokens seen; emptied when it has grown large."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, token: str):
        if len(self) > 200_000:
            self.clear()
        self[token] = out = self.function(token)
        return out


def _piece(token: str) -> str:
    """The token folded, # for a number, nothing for dashes."""
    if _HAS_DIGIT.search(token) and _is_number(token.strip(AROUND)):
        return "#"
    return folded(token.strip("–-—"))


def _named_piece(token: str) -> str:
    """The same with ~ for a capitalised word."""
    if not (_HAS_DIGIT.search(token) and _is_number(token.strip(AROUND))):
        core = token.strip(AROUND)
        if core[:1].isupper() and (len(core) == 1 or not any(c.isupper() and c != "I" for c in core[1:])):
            return "~"
    return _piece(token)


_PIECES, _NAMED_PIECES = _Memo(_piece), _Memo(_named_piece)


def skeleton(line: str, names: bool = False) -> str:
    """A line with its numbers as # and its words folded; with `names`, capitalised words as ~."""
    memo = _NAMED_PIECES if names else _PIECES
    return " ".join([x for w in line.split() if (x := memo[w])])


def _numbers(line: str) -> list[int]:
    """The numbers of the tokens that a skeleton shows as #, misread digits read right."""
    out = []
    for w in line.split():
        core = w.strip(AROUND)
        if _is_number(core):
            out += [int(n) for n in re.findall(r"\d+", core.translate(DIGITS)) if len(n) <= 9]
    return out


def edges(lines: list[str]) -> tuple[list[int], set[int], dict[int, bool]]:
    """Indexes of the lines that aren't blank, of those that hold a page number alone, and of those of a repeated
    form with numbers, with whether one number counts up as page numbers do."""
    real = [i for i, x in enumerate(lines) if x.strip()]
    alone = [(i, n) for i in real if (n := page_number(lines[i])) is not None]
    found: set[int] = set()
    # page numbers count up by one; the longest such chain is taken, each link with its length and the link before
    ends: dict[int, tuple] = {}
    last: tuple | None = None
    for i, n in alone:
        before = ends.get(n - 1)
        link = (before[0] + 1 if before else 1, i, n, before)
        if n not in ends or link[0] > ends[n][0]:
            ends[n] = link
        if last is None or link[0] > last[0]:
            last = link
    best: list[tuple[int, int]] = []
    while last:
        best.append(last[1:3])
        last = last[3]
    best.reverse()
    if len(best) >= 2:
        found = {i for i, _ in best}
        low, high = best[0][1], best[-1][1]
        found |= {i for i, n in alone if low - 1 <= n <= high + 1}
    elif len(alone) == 1 and real and alone[0][0] in (real[0], real[-1]):
        found = {alone[0][0]}
    groups: dict[str, list[int]] = defaultdict(list)
    for i in real:
        if i not in found and _HAS_DIGIT.search(lines[i]):
            groups[skeleton(lines[i])].append(i)
    counted: dict[int, bool] = {}
    for key, at in groups.items():
        if len(at) < 2 or not any(c.isalpha() for c in key) or _FLOAT.match(key):
            continue
        numbers = [_numbers(lines[i]) for i in at]
        rising = False
        if len({len(n) for n in numbers}) == 1 and min(b - a for a, b in zip(at, at[1:])) >= 8:
            columns = list(zip(*numbers))
            up = [c for c in columns if all(1 <= b - a <= 4 for a, b in zip(c, c[1:]))]
            rising = len(up) == 1 and all(len(set(c)) == 1 for c in columns if c is not up[0])
        for i in at:
            counted[i] = rising and (len(at) > 2 or at[0] in real[:3] or at[-1] in real[-3:])
    return real, found, counted


def alike(a: str, b: str, x: frozenset[str] | None = None, y: frozenset[str] | None = None) -> bool:
    """Whether two skeletons (with their words x and y) are the same but for misread characters."""
    if a == b:
        return True
    most = max(1, len(a) // 10)
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 5:
        return False
    x, y = frozenset(a.split()) if x is None else x, frozenset(b.split()) if y is None else y
    if len(x) > 2 and 2 * len(x & y) < len(x):
        return False
    # one edit changes the count of two characters at most
    if sum(abs(a.count(c) - b.count(c)) for c in set(a + b)) > 2 * most:
        return False
    return distance_within(a, b, most) <= most


def edge_lines(text: str) -> list[tuple[int, str, bool, bool]]:
    """(line, skeleton, whether it carries the page number, whether its like stands near another edge)."""
    lines = text.split("\n")
    real, alone, counted = edges(lines)
    numbered = alone | {i for i, rising in counted.items() if rising}
    if not real:
        return []
    place = {i: k for k, i in enumerate(real)}
    marks = sorted({place[i] for i in numbered} | {-1, len(real)})
    near: dict[int, int] = {}  # position -> edge
    for e, k in enumerate(marks):
        for step in range(-NEAR, NEAR + 1):
            p = k + step
            if 0 <= p < len(real) and real[p] not in numbered and (p not in near or abs(marks[near[p]] - p) > abs(step)):
                near[p] = e
    keys = {p: skeleton(lines[real[p]]) for p in near}
    by_key: dict[str, list[int]] = defaultdict(list)
    for p, key in keys.items():
        by_key[key].append(p)
    sizes: dict[int, list[str]] = defaultdict(list)
    words = {key: frozenset(key.split()) for key in by_key}
    having: dict[str, list[str]] = defaultdict(list)
    for key, own in words.items():
        sizes[len(key)].append(key)
        for w in own:
            having[w].append(key)

    def elsewhere(p: int, places: list[int]) -> bool:
        return any(near[q] != near[p] and abs(q - p) > NEAR for q in places)

    def candidates(key: str) -> Iterator[str]:
        """Keys that may be alike: of more than two words half must be shared, so one of any larger half is."""
        own = words[key]
        if len(own) <= 2:
            most = max(1, len(key) // 10)
            return (other for n in range(len(key) - most, len(key) + most + 1) for other in sizes.get(n, ()))
        rare = sorted(own, key=lambda w: (len(having[w]), w))[: len(own) // 2 + 1]
        return iter({other: None for w in rare for other in having[w]})

    def again(p: int) -> bool:
        key = keys[p]
        return elsewhere(p, by_key[key]) or any(other != key and alike(key, other, words[key], words[other]) and elsewhere(p, by_key[other]) for other in candidates(key))

    same = {p: again(p) for p in near}
    out = [(i, "", True, True) for i in alone]
    out += [(i, "N " + skeleton(lines[i], True), False, rising) for i, rising in counted.items()]
    return out + [(real[p], skeleton(lines[real[p]], True), False, same[p]) for p in near]


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, *x) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for x in edge_lines(text)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names=["paper_id", "line", "key", "numbered", "again"])


def furniture(papers: DataFrame) -> DataFrame:
    """(paper_id, line) of the running headers, footers and page numbers."""
    rows = cut(papers.select("paper_id", "text").mapInArrow(_edge_rows, "paper_id bigint, line bigint, key string, numbered boolean, again boolean"))
    usual = rows.where("NOT numbered").groupBy("key").agg(F.count("*").alias("n"), F.avg(F.col("again").cast("int")).alias("rate"))
    rows = rows.join(usual, "key", "left")
    least = F.when(F.col("key").startswith("N "), 0.6).otherwise(0.3)  # forms of lines that are furniture in so many cases
    here = F.col("again") & ~((F.col("n") >= 10) & (F.col("rate") < least))
    elsewhere = (F.col("n") >= 6) & (F.col("rate") >= least)
    return rows.where(F.col("numbered") | here | elsewhere).select("paper_id", "line").distinct()


def word_of(token: str) -> str | None:
    """The token in lower case without punctuation around it; null for formulas, numbers and single signs."""
    w = token.strip(AROUND)
    if len(w) < 2 or not any(c.isalpha() for c in w):
        return None
    if any(c.isupper() and c != "I" for c in w[1:]) or (w[0].isupper() and sum(c.isdigit() for c in w) > 1) or sum(c.isdigit() for c in w) > 2:
        return None
    return w.lower()


_WORDS = _Memo(word_of)


def broken(line: str) -> str | None:
    """The part of a word before a hyphen at the line's end."""
    s = line.rstrip()
    if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalpha():
        return None
    part = s[:-1].split()[-1].lstrip(AROUND)
    return part.lower() if part and part[0].isalnum() or part[:1] in "@†" else None


class Found:
    """What a paper says: units by word, by (first, second) part of a broken word and by number. A unit is twice the
    number of a line or cell, and one more in tables."""

    def __init__(self) -> None:
        self.words: dict[str, list[int]] = defaultdict(list)
        self.parts: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.numbers: dict[str, list[int]] = defaultdict(list)

    def read_lines(self, lines: list[tuple[int, str]], sample_labels: bool = True) -> None:
        """Words and broken words of body lines (unit, text); a letter with a number is left out without sample_labels."""
        rest, words, known = -1, self.words, _WORDS  # rest: the line that starts with the rest of a broken word
        for k, (unit, line) in enumerate(lines):
            tokens = line.split()
            if k == rest:
                tokens = tokens[1:]
            left = broken(line) if tokens else None
            if left is not None:
                after = k + 1
                while after < len(lines) and (not lines[after][1].strip() or _FLOAT.match(lines[after][1])):
                    after += 1
                follows = lines[after][1].split() if after < len(lines) else []
                right = follows[0].strip(AROUND).lower() if follows else ""
                if right and follows[0].lstrip(AROUND)[:1] == right[:1] and any(c.isalpha() for c in right) and right not in ("and", "or", "to"):
                    self.parts[left, right].append(unit)
                    tokens, rest = tokens[:-1], after
            for t in tokens:
                if (w := known[t]) is not None and (sample_labels or not _LABEL.fullmatch(w)):
                    words[w].append(unit)


_LABEL = re.compile(r"[a-z|]\d+")


def number_of(cell: str, numeric_column: bool) -> str | None:
    """The right number of a cell with misread digits."""
    c = cell.strip()
    if not c or re.fullmatch(r"[+-]?\d+(?:\.\d+)?", c):
        return None
    t = c.translate(DIGITS)
    if re.fullmatch(r"[+-]?\d+\.\d+", t) or (numeric_column and re.fullmatch(r"[+-]?\d+", t)):
        return t if numeric_column or any(x.isdigit() for x in c) else None
    return None


def _clean_number(c: str | None) -> bool:
    return bool(c) and re.fullmatch(r"\s*[+-]?\d+(?:\.\d+)?\s*", c) is not None


def read_paper(text: str | None, tables: list | None, away: set[int]) -> Found:
    found = Found()
    if text:
        found.read_lines([(2 * i, x) for i, x in enumerate(text.split("\n")) if i not in away])
    unit = 1
    for t in tables or []:
        rows = (t or {}).get("rows") or []
        width = max((len(r or []) for r in rows), default=0)
        numeric = []
        for k in range(width):
            column = [r[k] for r in rows if r and k < len(r) and r[k]]
            numeric.append(2 * sum(map(_clean_number, column)) > len(column))
        for r in rows:
            for k, cell in enumerate(r or []):
                if cell:
                    if (n := number_of(cell, numeric[k])) is not None:
                        found.numbers[n].append(unit)
                    elif not _clean_number(cell):
                        found.read_lines([(unit, x) for x in cell.split("\n")], sample_labels=False)
                unit += 2
    return found


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(paper_id, what, a, b, at): what read_paper() gives, each once a paper with its units."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()))
    for batch in batches:
        rows = []
        for key, text, tables, away in zip(*(batch.column(i).to_pylist() for i in range(4))):
            found = read_paper(text, tables, set(away or ()))
            rows += [(key, "word", w, "", at) for w, at in found.words.items()]
            rows += [(key, "part", a, b, at) for (a, b), at in found.parts.items()]
            rows += [(key, "number", n, "", at) for n, at in found.numbers.items()]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["paper_id", "what", "a", "b", "at"])


def _power(c):
    code = F.ascii(c).cast("bigint") % 997
    return code * code * code * code * code


def anagram_hash(word):
    """Sum of the fifth powers of the characters' codes: the same for the same letters in any order."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda s, c: s + F.when(c == "", F.lit(0).cast("bigint")).otherwise(_power(c)))


def _hash(word: str) -> int:
    return sum((ord(c) % 997) ** 5 for c in word)


#: Words of letters of any language, with hyphens between them; ligatures are misread letters.
_LETTERS = r"^(?:(?![\uFB00-\uFB06])\p{L})+(?:-(?:(?![\uFB00-\uFB06])\p{L})+)*$"


def corrections(lexicon: DataFrame) -> DataFrame:
    """(wrong, right, m) for the rare words of (word, n) that a confusion makes of a word that is far more frequent, m times there."""
    # different confusions with the same difference don't matter, as each is verified
    pairs = F.array(*(F.struct(F.lit(right).alias("r"), F.lit(wrong).alias("w"), F.lit(_hash(wrong) - _hash(right)).alias("diff")) for right, wrong in CONFUSIONS))
    frequent = lexicon.where((F.col("n") >= 4) & F.col("word").rlike(_LETTERS)).select(F.col("word").alias("right"), F.col("n").alias("m"), anagram_hash(F.col("word")).alias("hash"))
    rare = lexicon.select(F.col("word").alias("wrong"), "n", anagram_hash(F.col("word")).alias("own"), F.explode(F.filter(pairs, lambda p: F.contains(F.col("word"), p["w"]))).alias("p"))
    rare = rare.select("wrong", "n", "p.r", "p.w", (F.col("own") - F.col("p.diff")).alias("hash"))
    met = rare.join(frequent, "hash").where("right <> wrong")
    odd = ~F.col("wrong").rlike(_LETTERS)
    met = met.where((odd & (F.col("m") >= F.col("n"))) | (F.col("m") >= 12 * F.col("n")))
    made = F.exists(F.sequence(F.lit(1), F.length("right")), lambda i: F.concat(F.substring(F.col("right"), F.lit(1), i - 1), F.col("w"), F.substring(F.col("right"), i + F.length("r"), F.length("right"))) == F.col("wrong"))
    right_there = F.col("right").contains(F.col("r"))
    return met.where(right_there & made).groupBy("wrong").agg(F.max(F.struct("m", "right")).alias("x")).select("wrong", "x.right", "x.m")


def repairs(papers: DataFrame) -> DataFrame:
    """p2: (paper_id, place, unit_no, kind, fixed) of furniture, broken words and misread words and numbers."""
    papers = papers.select(F.col("paper_id").cast("bigint").alias("paper_id"), F.col("text").cast("string").alias("text"), F.col("tables").alias("tables"))
    away = cut(furniture(papers))
    lists = away.groupBy("paper_id").agg(F.collect_list("line").alias("away"))  # at most a paper's lines
    # repeated ids: each text is read with the furniture found under its id
    reads = cut(papers.join(lists, "paper_id", "left").select("paper_id", "text", F.transform("tables", lambda t: F.struct(t["rows"].alias("rows"))).alias("tables"), "away").mapInArrow(_reads, "paper_id bigint, what string, a string, b string, at array<bigint>"))
    words = reads.where("what = 'word'").select("paper_id", F.col("a").alias("word"), "at")
    parts = reads.where("what = 'part'")
    shapes = parts.select("a", "b").distinct().withColumn("whole", F.concat("a", "b")).withColumn("linked", F.concat_ws("-", "a", "b"))
    lexicon = cut(_lexicon(words, shapes))
    fixes = cut(lexicon.where("right <> word").select("word", "right"))
    found = [
        words.join(small(fixes), "word").select("paper_id", "at", F.lit("ocr").alias("kind"), F.col("right").alias("fixed")),
        reads.where("what = 'number'").select("paper_id", "at", F.lit("ocr").alias("kind"), F.col("a").alias("fixed")),
        parts.join(small(cut(joined(shapes, lexicon))), ["a", "b"]).select("paper_id", "at", F.lit("hyphen").alias("kind"), "fixed"),
    ]
    lines = reduce(DataFrame.unionByName, found).select("paper_id", F.explode("at").alias("_u"), "kind", "fixed")
    lines = lines.select("paper_id", F.when(F.col("_u") % 2 == 1, "tables").otherwise("text").alias("place"), F.shiftright("_u", 1).alias("unit_no"), "kind", "fixed")
    edge = away.select("paper_id", F.lit("text").alias("place"), F.col("line").alias("unit_no"), F.lit("furniture").alias("kind"), F.lit("").alias("fixed"))
    return edge.unionByName(lines).distinct()


def _lexicon(words: DataFrame, shapes: DataFrame) -> DataFrame:
    """(word, n, right, m): each word and form with its number, its correction or itself, and the number of that.

    A form that stands nowhere as it is counts as one occurrence where it is corrected, and as none as evidence.
    """
    counted = words.select("word", F.size("at").cast("bigint").alias("n")).unionByName(shapes.select(F.explode(F.array("whole", "linked", "a", "b")).alias("word"), F.lit(0).cast("bigint").alias("n")))
    counted = cut(counted.groupBy("word").agg(F.sum("n").alias("n")))
    fixes = corrections(counted.withColumn("n", F.greatest("n", F.lit(1))))
    return counted.join(fixes.withColumnRenamed("wrong", "word"), "word", "left").select("word", "n", F.coalesce("right", "word").alias("right"), F.when(F.col("right").isNull(), F.col("n")).otherwise(F.col("m")).alias("m"))


def joined(shapes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(a, b, fixed): broken words made whole: the form that the collection has more often keeps or drops the hyphen.

    A misread part is corrected in the whole word.
    """
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("word")) for r in ("whole", "linked", "a", "b")))
    said = shapes.select("a", "b", F.explode(roles).alias("x")).select("a", "b", "x.role", "x.word").join(lexicon, "word", "left")

    def of(role: str, value: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(value)))

    said = said.groupBy("a", "b").agg(of("whole", "m").alias("w"), of("whole", "right").alias("whole"), of("linked", "m").alias("l"), of("linked", "right").alias("linked_right"), of("a", "n").alias("a_n"), of("b", "n").alias("b_n"))
    w, link = F.coalesce("w", F.lit(0)), F.coalesce("l", F.lit(0))
    both = (F.col("a_n") >= 3) & (F.col("b_n") >= 3) & (F.length("a") >= 3) & (F.length("b") >= 3)
    fixed = F.when(link > w, F.col("linked_right")).when(w > 0, F.col("whole")).when(both, F.concat_ws("-", "a", "b")).otherwise(F.concat("a", "b"))
    return said.select("a", "b", fixed.alias("fixed"))
