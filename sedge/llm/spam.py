"""Pages of repeated keywords, link lists and product tags.

A page is spam if repeated substrings hold most of its letters and less than half of its text stands in clauses.
Repetition comes from the page's suffix automaton: the longest suffix of each prefix that occurs again, of MIN_REPEAT
characters at least, covers its characters; letters count, so tables of values don't. A clause is told by its
structure in any language: a stretch that ends in a sentence mark, of MIN_WORDS words or more, of which few repeat.
Both conditions must hold, so the automaton is built where clauses are missing. For a page longer than AUTOMATON the
union of those substrings is taken as the union of its repeated windows of MIN_REPEAT characters, which is the same
set: windows are told apart exactly, by doubling their names, in memory proportional to the page.

Cases: null, empty and missing texts aren't spam; texts of any length are read whole; text without letters isn't
spam; repeated pages come out each; other columns aren't used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_REPEAT, MIN_CLAUSES, MIN_COVERED = 12, 0.5, 0.4
#: A clause has so many words, and this share of them are different.
MIN_WORDS, MIN_DIFFERENT = 8, 0.75
AUTOMATON = 300_000
#: Up to a sentence mark before a blank, a blank line or the end of the text.
_SEGMENT = re.compile(r"[^.!?。！？\n]+(?:(?:[.!?](?=\S)|\n(?![ \t]*\n))[^.!?。！？\n]*)*([.!?。！？]?)")
_WORD = re.compile(r"[^\W\d_]+")
_BLANKS, _DIGIT = re.compile(r"\s+"), re.compile(r"\d")


def clause_share(text: str) -> float:
    """Share of the text in segments with the structure of a clause; 1 for a text without segments."""
    good = total = 0
    for m in _SEGMENT.finditer(text):
        size = len(m.group().strip())
        total += size
        if m.group(1):
            words = _WORD.findall(m.group().lower())
            if len(words) >= MIN_WORDS and len(set(words)) >= MIN_DIFFERENT * len(words):
                good += size
    return good / total if total else 1.0


class SuffixAutomaton:
    """States with their longest length, suffix link and transitions; `prefix` has the state of each prefix."""

    def __init__(self, text: str):
        self.length, self.link = [0], [-1]
        step: list[dict[str, int]] = [{}]
        self.prefix: list[int] = []
        length, link, last = self.length, self.link, 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(step)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            self.prefix.append(new)
            last = new

    def repeated(self, least: int) -> np.ndarray:
        """For each character whether a substring of `least` characters or more that occurs again covers it."""
        n = len(self.prefix)
        several = set(self.link)  # a state that another links to ends at two places at least
        edges = np.zeros(n + 1, np.int64)
        for i, s in enumerate(self.prefix):
            size = self.length[s] if s in several else self.length[self.link[s]]
            if size >= least:
                edges[i + 1 - size] += 1
                edges[i + 1] -= 1
        return np.cumsum(edges)[:n] > 0


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for the same pairs."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def repeated_windows(text: str, least: int) -> np.ndarray:
    """SuffixAutomaton(text).repeated(least) from all windows of `least` characters; names of windows double in length."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(codes) - least + 1
    covered = np.zeros(len(codes) + 1, np.int64)
    if n > 0:
        power, size, names, done = np.unique(codes, return_inverse=True)[1], 1, None, 0
        while done < least:
            if least & size:
                names = power[:n] if names is None else _names(names, power[done : done + n])
                done += size
            if done < least:
                power, size = _names(power[:-size], power[size:]), 2 * size
        at = np.flatnonzero(np.bincount(names)[names] > 1)
        covered[at] += 1
        covered[at + least] -= 1
    return np.cumsum(covered)[:-1] > 0


def folded(text: str) -> str:
    """Lower case, digits alike, runs of blanks as one."""
    return _BLANKS.sub(" ", _DIGIT.sub("0", text.lower())).strip()


def repeated_share(text: str, least: int = MIN_REPEAT, automaton: int = AUTOMATON) -> float:
    """Letters covered by repeated substrings, as a share of all characters but blanks."""
    t = folded(text)
    if not t:
        return 0.0
    covered = SuffixAutomaton(t).repeated(least) if len(t) <= automaton else repeated_windows(t, least)
    letters = np.fromiter(map(str.isalpha, t), bool, len(t))
    return float((covered & letters).sum() / max(1, len(t) - t.count(" ")))


def is_spam(text: str | None) -> bool:
    return bool(text) and clause_share(text) < MIN_CLAUSES and repeated_share(text) >= MIN_COVERED


def spam_pages(documents: DataFrame) -> DataFrame:
    """p10: (doc_id) of the pages that are mostly keywords, links or tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [i for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) if is_spam(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["doc_id"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL").mapInArrow(run, "doc_id bigint")
