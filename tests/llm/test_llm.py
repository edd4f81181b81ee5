import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedge.llm import canon, frequency, grouping, leakage, overlap, packing, scans, spam
from sedge.sources.tables import cut, cut_packed

WORDS = st.text("abcd", max_size=7)


# --- p1


def _plain_distance(a, b):
    """Unrestricted Damerau-Levenshtein by search over all edits, for short words."""
    from heapq import heappop, heappush

    seen, todo = {}, [(0, a)]
    letters = set(a + b)
    while todo:
        d, w = heappop(todo)
        if w == b:
            return d
        if w in seen or len(w) > max(len(a), len(b)) + 1:
            continue
        seen[w] = d
        nxt = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        for x in nxt:
            if x not in seen:
                heappush(todo, (d + 1, x))


@settings(max_examples=25, deadline=None)
@given(st.text("abc", max_size=4), st.text("abc", max_size=4))
def test_distance_is_the_least_number_of_edits(a, b):
    assert canon.distance(a, b) == _plain_distance(a, b)


@settings(max_examples=60, deadline=None)
@given(WORDS, WORDS, WORDS)
def test_distance_is_a_metric(a, b, c):
    assert canon.distance(a, b) == canon.distance(b, a) and (canon.distance(a, b) == 0) == (a == b)
    assert canon.distance(a, c) <= canon.distance(a, b) + canon.distance(b, c)


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 6))
def test_distance_within_a_band(a, b, most):
    d = canon.distance(a, b)
    assert canon.distance_within(a, b, most) == min(d, most + 1)
    assert max(len(a), len(b)) - len(canon.bag(a) & canon.bag(b)) <= d


def test_readings_of_any_number():
    long = "by the " * 300 + "TiO2-c" + " layer, 2 times (new)" * 3
    assert "tio2c" in canon.readings(long, 20) and all(len(f) <= 24 for f in canon.readings(long, 20))
    assert canon.readings("x" * 100_000, 20) == [] and {"pbi2|mai", "pbi2thenmai"} <= set(canon.readings("PbI2 then MAI"))


@settings(max_examples=40, deadline=None)
@given(st.lists(WORDS, max_size=30), WORDS, st.integers(0, 3))
def test_tree_returns_every_entry_within_the_radius(words, query, radius):
    tree = canon.BKTree()
    for i, w in enumerate(words):
        tree.add(w, i)
    found = {(d, w) for d, w, _ in tree.within(query, radius)}
    assert found == {(d, w) for w in words if (d := canon.distance(query, w)) <= radius}


TERMS = [(1, "f", "Spiro-MeOTAD", "tetrakis amine"), (2, "f", "TiO2-c", "compact titanium dioxide"), (3, "f", "C60 | BCP", None), (4, "f", "Spin-coating", "solution cast on a rotating substrate"), (5, "g", "PTAA", "poly(triaryl amine)"), (6, "f", None, "nothing")]
TYPED = {"spiro_meotad": 1, "SpiroMeOTAD ": 1, "Spiro-MeOTDA": 1, "“Tetrakis Amnie”.": 1, "c-TiO2": 2, "compact TiO2": 2, "TiO₂-c": 2, "C60/BCP": 3, "C60 on BCP": 3, "by spin-coating": 4, "Spin-coated": 4, "spin-coating, 2 steps": 4, "Spiro-MeOTAD (as received)": 1, "secret recipe no. 4": 0, "x" * 30_000: 0, "PTAA": 0}


@pytest.mark.parametrize("shard", [5000, 1, 2])
def test_mapping_with_any_shards(spark, shard):
    terms = spark.createDataFrame(TERMS, "term_id bigint, field_name string, canonical string, long_name string")
    rows = [(i, v, None, "x") for i, v in enumerate(TYPED)] + [(100, "TiO2-c", "Poly(Triaril Amine)", "x"), (101, None, "nan; none", "x"), (102, "", "PTAA", "x"), (103, "c-TiO2", None, "y")]
    df = spark.createDataFrame(rows, "row_id bigint, f string, g string, value string")
    got = {(r["row_id"], r["field_name"]): r["term_id"] for r in canon.to_canonical(df, "row_id", ["f", "g"], terms, shard).collect()}
    assert got == {(i, "f"): t for i, t in enumerate(TYPED.values())} | {(100, "g"): 5, (103, "f"): 2}


def test_mapping_of_empty_tables(spark):
    terms = spark.createDataFrame(TERMS, "term_id bigint, field_name string, canonical string, long_name string")
    df = spark.createDataFrame([(1, "abc", None)], "row_id bigint, f string, g string")
    assert [r["term_id"] for r in canon.to_canonical(df, "row_id", ["f", "g"], terms.limit(0)).collect()] == [0]
    assert canon.to_canonical(df.limit(0), "row_id", ["f", "g"], terms).count() == 0


# --- p2


HEAD = "Annals of Nothing"
BODY = ["Films of the layer were made by spin-", "coating on glass and the resis-", "tance of the film fell below a known", "value after the surface treatment was", "done in nitrogen for the open-circuit", "cells with the module on the glass", "and the c0ntact of the surface held.", "The surface of the module and contact"]


def _paper(k):
    rng = random.Random(k)
    lines = []
    for page in (1, 2, 3):
        own = [" ".join("".join(rng.choice("aeiounrst") for _ in range(7)) for _ in range(5)) for _ in range(6)]
        lines += [HEAD, *own[:3], *BODY, *BODY[::-1][:4], *["Plain words on resistance and spin-coating of the open-circuit module contact surface"] * 3, *own[3:], f"- {page + 10 * k} -"]
    if k == 1:
        lines[9] = lines[9].replace("module", "rnodule")
    return "\n".join(lines)


def _papers(spark, n=6):
    rows = [("1", [["S1", "O.65", "17.0"], ["I2", "0.70", "1z.5"], ["l3", "0.71", "module resi-\nstance c0ntact"]])]
    tables = [(1, 0, ["a"], r, "t") for _, r in rows]
    return spark.createDataFrame([(k, "d", _paper(k), tables) for k in range(1, n + 1)] + [(50, "d", None, None), (51, "d", "", [])], "paper_id bigint, line string, text string, tables array<struct<page:int,table_index:int,headers:array<string>,rows:array<array<string>>,text:string>>")


def test_scans(spark):
    got = {(r["paper_id"], r["place"], r["unit_no"], r["kind"], r["fixed"]) for r in scans.repairs(_papers(spark)).collect()}
    lines = _paper(1).split("\n")
    assert {u for p, place, u, k, _ in got if p == 1 and k == "furniture"} == {i for i, x in enumerate(lines) if x == HEAD or x.startswith("- ")}
    assert (1, "text", 4, "hyphen", "spin-coating") in got and (1, "text", 5, "hyphen", "resistance") in got
    assert (1, "text", 9, "ocr", "module") in got and (1, "text", 10, "ocr", "contact") in got
    assert (1, "tables", 1, "ocr", "0.65") in got and (1, "tables", 5, "ocr", "12.5") in got and (1, "tables", 8, "hyphen", "resistance") in got and (1, "tables", 8, "ocr", "contact") in got
    assert not any(place == "tables" and u in (0, 3, 6) for _, place, u, _, _ in got)
    assert not {50, 51} & {x[0] for x in got}


def test_words_of_other_languages_and_long_gaps(spark):
    line = "Die Schicht zeigt eine größere Spannung über der Fläche und die Messung bleibt gültig"
    body = [line] * 8 + ["Die Schicht zeigt eine gröfiere Spannung über der F1äche"] + ["ein neuer Span-"] + [""] * 7 + ["Figure 1. A film"] + ["nung folgt"]
    df = spark.createDataFrame([(i, "\n".join(body), None) for i in range(3)], "paper_id bigint, text string, tables array<struct<page:int,table_index:int,headers:array<string>,rows:array<array<string>>,text:string>>")
    got = {(r["unit_no"], r["kind"], r["fixed"]) for r in scans.repairs(df).where("paper_id = 1").collect()}
    assert (8, "ocr", "fläche") in got and (9, "hyphen", "spannung") in got


def test_scans_empty(spark):
    assert scans.repairs(_papers(spark).limit(0)).count() == 0


def test_anagram_hash_is_the_same_in_sql(spark):
    words = ["module", "modu1e", "fea†ures", "", "a-b"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(scans.anagram_hash(F.col("w"))).collect()]
    assert got == [scans._hash(w) for w in words]


# --- p4


def test_frequencies_by_brute_force(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 6))], rng.choice(["x", " x ", "y", None, "nan;N/A"])) for _ in range(300)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows] + [([None, "a"], "z", "clash"), (None, None, "clash")], "terms array<string>, item string, column_name string")
    got = {(r["column_name"], r["item"]): (r["occurrences"], r["records"]) for r in frequency.term_frequencies(df, {"terms": F.col("terms"), **frequency.value_terms(["item"])}).collect()}
    want = defaultdict(lambda: [0, 0])
    for a, b in [*rows, ([None, "a"], "z"), ([], None)]:
        for t, n in Counter(x for x in a if x).items():
            want["terms", t][0] += n
            want["terms", t][1] += 1
        if b and b.strip() not in ("nan;N/A",):
            want["item", b.strip()][0] += 1
            want["item", b.strip()][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    ids = [r["term_id"] for r in frequency.term_frequencies(df, {"terms": F.col("terms")}).collect()]
    assert sorted(ids) == list(range(len(ids)))


def test_marks(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)] * 26 + [("c",), ("c",)], "v string")
    assert {(r["item"], r["mark"]) for r in frequency.useless_values(df, ["v"]).collect()} == {("b", "rare")}
    assert {(r["item"], r["mark"]) for r in frequency.useless_values(df.limit(10), ["v"]).collect()} == {("b", "rare"), ("a", "common")}
    assert frequency.useless_values(df.limit(0), ["v"]).count() == 0


# --- p5


def _recipe(k, **change):
    lines = {"cell stack sequence": f"SLG | FTO | X{k} | Au", "perovskite composition long form": f"MAPbI{k}", "perovskite thickness": str(200 + 7 * k), "perovskite band gap": f"1.{k:03d}", "cell area measured": f"0.{k}1", "etl thickness": str(30 + k), "htl thickness list": str(100 + 3 * k), "jv scan speed": str(50 + 11 * k), "substrate surface roughness rms": f"{k}.5", "cell architecture": "nip", "perovskite deposition solvents": "DMF; NMP"}
    lines.update(change)
    return {a: b for a, b in lines.items() if b is not None}


def _says(lines, form="- {}: {}", sep="\n"):
    return "Task: predict.\n\nCore device recipe:\n" + sep.join(form.format(a, b) for a, b in lines.items())


def test_overlap(spark):
    base = _recipe(1)
    cases = [
        (1, "train", _says(base)), (2, "test", _says(base)), (3, "validation", _says(dict(reversed(base.items())), "  * {} :  {} ").replace("MAPbI1", "mapbi1")),
        (4, "test", "Task. " + "; ".join(f"{a.replace('perovskite', 'absorber')} = {b}" for a, b in base.items())), (5, "test", _says(_recipe(1, **{"jv scan speed": "61.0", "cell area measured": "9.9", "etl thickness": None}))),
        (6, "test", _says(_recipe(1, **{"jv scan speed": "1", "cell area measured": "2", "etl thickness": "3", "htl thickness list": "4"}))), (7, "test", _says(_recipe(1, **{"cell stack sequence": "other", "perovskite composition long form": "other"}))),
        (8, "train", _says(base)), (9, "test", _says({a.replace("thickness", "thicknes"): b for a, b in base.items()})), (10, "test", None), (11, "train", "hello"), (12, None, _says(base)),
    ] + [(100 + k, "train" if k % 2 else "test", _says(_recipe(k))) for k in range(2, 40)]
    df = spark.createDataFrame([(i, s, "src", [("system", "s"), ("user", t), ("assistant", "a")] if t is not None or i == 10 else None, "x") for i, s, t in cases], "example_id bigint, split string, source string, messages array<struct<role:string,content:string>>, recipe string")
    got = {tuple(r) for r in overlap.cross_split_pairs(df).collect()}
    assert got == {tuple(sorted(p)) for e in (2, 3, 4, 5, 7, 9) for p in ((1, e), (8, e))}
    report = {r["split"]: (r["n_examples"], r["n_exact"], r["n_pairs"]) for r in overlap.overlap_report(df).collect()}
    assert report["validation"] == (1, 1, 2) and report["test"][0] == 5
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def test_pairs_that_lack_selective_lines_are_found(spark):
    rng, n = random.Random(4), 20
    usual = [f"line {i:02d}" for i in range(n)]
    rows = []
    for i in range(60):
        whole = {p: rng.randrange(4 + 60 * (p < 12)) for p in range(n)}
        copy = {p: whole[p] for p in sorted(rng.sample(range(n), rng.randrange(6, 15)))}
        for p in rng.sample(list(copy), rng.randrange(4)):
            copy[p] = 1000 + p
        few = {p: v for p, v in whole.items() if p > rng.randrange(12)}
        rows += [(f"t{i}", list(x), list(x.values()), True, False) for x in [whole if i % 2 else few]] + [(f"e{i}", list(copy), list(copy.values()), False, True)]
    want = set()
    for a in rows:
        for b in rows:
            if a[3] and b[4]:
                la, lb = dict(zip(a[1], a[2])), dict(zip(b[1], b[2]))
                common = la.keys() & lb.keys()
                other = sum(la[p] != lb[p] for p in common)
                if other <= 2 and 2 * len(common) >= min(len(la), len(lb)) and len(common) - other >= 4:
                    want.add((a[0], b[0]))
    df = spark.createDataFrame(rows, "recipe string, at array<bigint>, hashes array<bigint>, train boolean, eval boolean")
    assert len(want) > 20 and {tuple(r) for r in overlap.same_recipes(df, usual).collect()} == want


def test_pairs_that_share_a_few_lines_are_no_candidates(spark):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        values = [1, 2, 3] + [rng.randrange(1 << 40) for _ in range(18)]
        rows += [(f"t{i}", list(range(21)), values, True, False), (f"e{i}", list(range(21)), values[:19] + [rng.randrange(1 << 40) for _ in range(2)], False, True)]
    df = spark.createDataFrame(rows, "recipe string, at array<bigint>, hashes array<bigint>, train boolean, eval boolean").withColumn("id", F.xxhash64("recipe"))
    # ranked so that the lines which all share make one group: 40,000 pairs meet
    got = overlap._candidates(df, [0, *range(3, 9), 1, *range(9, 15), 2, *range(15, 21)]).distinct()
    assert 200 <= got.count() < 400


def test_packed_cut_is_compressed_and_whole(spark):
    df = spark.range(20_000).select("id", F.array_repeat(F.col("id") % 7, 20).alias("at"))
    out = cut_packed(df)
    assert out.dtypes == df.dtypes and out.exceptAll(df).isEmpty() and out.count() == 20_000
    assert sum(os.path.getsize(f.removeprefix("file:")) for f in out.inputFiles()) < 20_000 * 20


def _same(la, lb):
    common = la.keys() & lb.keys()
    other = sum(la[p] != lb[p] for p in common)
    return other <= 2 and 2 * len(common) >= min(len(la), len(lb)) and len(common) - other >= 4


def test_pairs_of_few_or_unusual_lines_are_found(spark):
    rng, rare = random.Random(8), [(1 << 62) + i for i in range(30)]
    rows = []
    for i in range(80):
        places = rng.sample(range(9), rng.randrange(4, 9) if i % 3 else rng.randrange(4)) + rng.sample(rare[i % 5 : i % 5 + 9], rng.randrange(2, 7))
        whole = {p: rng.randrange(1, 90) for p in places}
        copy = {p: v for p, v in whole.items() if rng.random() < 0.9}
        copy |= {p: 1000 + p % 100 for p in rng.sample(list(copy), min(len(copy), rng.randrange(4)))}
        rows += [(f"{x}{i}", sorted(r), [r[p] for p in sorted(r)], x == "t", x == "e") for x, r in (("t", whole), ("e", copy)) if len(r) >= 4]
    lines = {r[0]: dict(zip(r[1], r[2])) for r in rows}
    want = {(a, b) for a in lines for b in lines if a[0] == "t" and b[0] == "e" and _same(lines[a], lines[b])}
    df = spark.createDataFrame(rows, "recipe string, at array<bigint>, hashes array<bigint>, train boolean, eval boolean")
    assert len(want) > 20 and {tuple(r) for r in overlap.same_recipes(df, [f"line {p}" for p in range(9)]).collect()} == want
    assert any(sum(p < 9 for p in lines[a].keys() & lines[b].keys()) == 0 for a, b in want)


def test_recipes_of_few_or_unusual_lines_are_read(spark):
    short = {"cell stack sequence": "SLG | FTO | Y | Au", "perovskite composition long form": "CsPbI9", "perovskite band gap": "1.77", "cell architecture": "pin"}
    foreign = {f"own {a} of {b}": f"{a}{len(b)}.5" for a in ("glass", "oxide", "salt") for b in ("width", "origin")}
    cases = [(1, "train", _says(short)), (2, "test", _says(dict(reversed(short.items())), "* {} : {}")), (3, "test", "; ".join(f"{a} = {b}" for a, b in short.items()))]
    cases += [(4, "train", _says(foreign)), (5, "validation", _says(foreign | {"own salt of width": "7"})), (6, "test", _says({"own glass of width": "glass5.5", "own oxide of width": "oxide5.5"}))]
    cases += [(1000 + k, "train" if k % 2 else "test", _says(_recipe(k))) for k in range(2, 402)]
    df = spark.createDataFrame([(i, s, "src", [("user", t)], "x") for i, s, t in cases], "example_id bigint, split string, source string, messages array<struct<role:string,content:string>>, recipe string")
    assert {tuple(r) for r in overlap.cross_split_pairs(df).where("example_id_a < 1000 AND example_id_b < 1000").collect()} == {(1, 2), (1, 3), (4, 5)}


# --- p6


def test_components_by_brute_force(spark):
    rng = random.Random(2)
    edges = [(f"d:{rng.randint(0, 60):02d}", f"k:{rng.randint(0, 60):02d}") for _ in range(70)] + [(f"d:{100 + i}", f"k:{100 + i}") for i in range(30)] + [(f"d:{101 + i}", f"k:{100 + i}") for i in range(30)] + [("d:x", None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in grouping.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for a, b in edges if b for n in (a, b)}


ROWS = [(1, "10.0000/B.", " Batch-1 "), (2, "https://doi.example/10.0000/b", None), (3, "10.0000/a", "batch-1"), (4, "10.0000%2Fc", "k2"), (5, None, "K2"), (6, None, None), (7, "unknown", "nan"), (8, "10.0000/c", None), (9, "10.0000/z", "k9"), (9, "10.0000/z", "k9")]


def test_chained_rows(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "row_id bigint, doi string, batch string, root string")
    got = sorted(tuple(r) for r in grouping.chained_rows(df, "row_id", "doi", "batch").collect())
    assert got == [(1, "10.0000/a"), (2, "10.0000/a"), (3, "10.0000/a"), (4, "10.0000/c"), (5, "10.0000/c"), (8, "10.0000/c")]
    assert grouping.chained_rows(df.limit(0), "row_id", "doi", "batch").count() == 0


def test_splits_keep_groups_and_history(spark):
    df = spark.createDataFrame([(i, f"10.0000/{i % 200}", None) for i in range(1000)] + [(2000, None, None)], "row_id bigint, doi string, batch string")
    rows, table = grouping.assign_splits(df, "row_id", "doi", "batch")
    first = rows.toPandas()
    assert first.groupby("group_id")["split"].nunique().max() == 1 and len(first) == 1001
    assert abs((first["split"] == "train").mean() - 0.8) < 0.1 and set(first["split"]) == set(grouping.SPLITS)
    old = {r["node"]: r["split"] for r in table.collect()}
    a, b = next(n for n, s in old.items() if s == "train"), next(n for n, s in old.items() if s == "test")
    more = spark.createDataFrame([(5000, a[2:], "new"), (5001, b[2:], "new"), (5002, a[2:], "solo"), (5003, "10.0000/fresh", None)], "row_id bigint, doi string, batch string")
    again, table2 = grouping.assign_splits(df.unionByName(more.where("row_id > 5001")), "row_id", "doi", "batch", existing=table)
    new = {r["row_id"]: r["split"] for r in again.collect()}
    assert all(new[i] == s for i, s in zip(first["row_id"], first["split"]) if i != 2000) and new[5002] == "train" and new[5003] in grouping.SPLITS
    clash, table3 = grouping.assign_splits(df.unionByName(more), "row_id", "doi", "batch", existing=table)
    assert {r["split"] for r in clash.where("row_id IN (5000, 5001)").collect()} == {"quarantine"}
    assert {r["node"]: r["split"] for r in table3.collect()}[a] == "train"
    assert grouping.assign_splits(df.limit(0), "row_id", "doi", "batch")[0].count() == 0


def _one_by_one(sizes, have, ratios, total):
    """The split of each component, the largest first, always to the greatest deficit."""
    have, out = dict(have), Counter()
    for n in sorted((n for n, k in sizes for _ in range(k)), reverse=True):
        best = max(grouping.SPLITS, key=lambda s: (ratios[s] * total - have.get(s, 0), -grouping.SPLITS.index(s)))
        have[best] = have.get(best, 0) + n
        out[n, best] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 60), max_size=8), st.tuples(*[st.integers(0, 300)] * 3))
def test_filling_by_size_is_filling_one_by_one(sizes, have):
    have, ratios = dict(zip(grouping.SPLITS, have)), {"train": 0.8, "validation": 0.1, "test": 0.1}
    total = sum(n * k for n, k in sizes.items()) + sum(have.values())
    got = {(n, s): k for n, ks in grouping.fill(list(sizes.items()), have, ratios, total) for s, k in zip(grouping.SPLITS, ks) if k}
    assert got == dict(_one_by_one(sizes.items(), have, ratios, total))


def test_new_groups_fill_the_deficits_whatever_their_size(spark):
    keys = [f"g{i}" for i in range(400)] + ["big"] * 300 + ["mid"] * 100 + [f"h{i // 3}" for i in range(300)]
    df = spark.createDataFrame([(i, f"10.0000/{k}", None) for i, k in enumerate(keys)], "row_id bigint, doi string, batch string")
    rows, _ = grouping.assign_splits(df, "row_id", "doi", "batch")
    got = rows.groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 880, "validation": 110, "test": 110}
    assert rows.groupBy("group_id").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] == 1


def test_second_run_on_new_rows_only(spark):
    schema, n = "row_id bigint, doi string, batch string", 120
    run1 = spark.createDataFrame([(i, f"10.0000/m{i}", f"k{i}") for i in range(n)], schema)
    rows, table = grouping.assign_splits(run1, "row_id", "doi", "batch")
    table = cut(table)
    want = {r["row_id"]: r["split"] for r in rows.collect()}
    assert {r["node"] for r in table.collect()} == {x for i in range(n) for x in (f"d:10.0000/m{i}", f"k:k{i}")}
    assert len(set(want.values())) > 1
    # run 2 meets run 1 by batch key alone; x<i> sorts after and a<i> before the earlier DOI
    run2 = spark.createDataFrame([(1000 + i, f"10.0000/{'xa'[i % 2]}{i}" if i % 3 else None, f"K{i} ") for i in range(n)], schema)
    rows, table2 = grouping.assign_splits(run2, "row_id", "doi", "batch", existing=table)
    table2 = cut(table2)
    assert {r["row_id"] - 1000: r["split"] for r in rows.collect()} == want
    # run 3 meets run 1 through a DOI of run 2
    run3 = spark.createDataFrame([(2000 + i, f"10.0000/{'xa'[i % 2]}{i}", None) for i in range(n) if i % 3], schema)
    rows, table3 = grouping.assign_splits(run3, "row_id", "doi", "batch", existing=table2)
    assert {r["row_id"] - 2000: r["split"] for r in rows.collect()} == {i: s for i, s in want.items() if i % 3}
    seen = {r["node"]: r for r in table3.collect()}
    assert table3.count() == len(seen) and all(r["split"] is not None for r in seen.values())
    assert all(len({seen[x]["component"] for x in (f"k:k{i}", f"d:10.0000/m{i}", f"d:10.0000/{'xa'[i % 2]}{i}") if x in seen}) == 1 for i in range(n))


def test_links_of_earlier_runs_quarantine(spark):
    schema = "row_id bigint, doi string, batch string"
    known = spark.createDataFrame([("d:10.0000/a", "d:10.0000/a", "train"), ("d:10.0000/b", "d:10.0000/b", "test"), ("d:10.0000/c", "d:10.0000/c", "test")], "node string, component string, split string")
    both = spark.createDataFrame([(1, "10.0000/a", "k"), (2, "10.0000/b", "k")], schema)
    rows, table = grouping.assign_splits(both, "row_id", "doi", "batch", existing=known)
    assert {r["split"] for r in rows.collect()} == {"quarantine"}
    table = cut(table)
    assert {r["node"]: r["split"] for r in table.collect()} == {"d:10.0000/a": "train", "d:10.0000/b": "test", "d:10.0000/c": "test", "k:k": "quarantine"}
    later, _ = grouping.assign_splits(spark.createDataFrame([(3, "10.0000/b", None), (4, None, "K"), (5, "10.0000/c", None)], schema), "row_id", "doi", "batch", existing=table)
    assert {r["row_id"]: r["split"] for r in later.collect()} == {3: "quarantine", 4: "quarantine", 5: "test"}


# --- p8


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from("abc"), st.integers(0, 5)), max_size=40))
def test_packing_keeps_its_promises(items):
    given_items = [((i, 0), n, s, c) for i, (n, s, c) in enumerate(items)]
    bins = packing.pack(given_items, 20)
    used, clusters, sources = Counter(), defaultdict(list), defaultdict(list)
    for (_, n, s, c), b in zip(given_items, bins):
        used[b] += n
        clusters[b].append(c)
        sources[b].append(s)
    assert all(n <= 20 for n in used.values())
    if len(used) < packing.enough(sum(used.values()), 20):
        assert all(len(c) == len(set(c)) for c in clusters.values()) and all(len(c) == len(set(c)) for c in sources.values())


def test_conflicts_are_few_while_space_allows():
    rng = random.Random(2)
    items = [((i, 0), rng.randint(1, 90), f"s{i % 12}", i if i % 50 else 0) for i in range(2000)]
    bins = packing.pack(items, 200)
    by = Counter((b, s) for (_, _, s, _), b in zip(items, bins)), Counter((b, c) for (_, _, _, c), b in zip(items, bins))
    assert sum(n for n in by[0].values() if n > 1) < 0.08 * len(items) and max(by[1].values()) == 1
    assert sum(n for _, n, _, _ in items) / (len(set(bins)) * 200) > 0.98


def test_packing_of_hot_copies_and_sources():
    rng = random.Random(9)
    items = [((i, 0), rng.randint(1, 60), "hot" if rng.random() < 0.4 else f"s{i % 9}", 7 if i % 3 == 0 else i) for i in range(3000)]
    bins = packing.pack(items, 200)
    assert sum(n for _, n, _, _ in items) / (len(set(bins)) * 200) > 0.97


def test_containers(spark):
    words = ["layer", "film", "glass", "contact"]
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90))), "hot" if i % 3 else f"s{i % 7}", "x") for i in range(600)] + [(600, None, None, "x"), (601, "", "hot", "x"), (602, "film " * 1000, "hot", "x"), (603, "same text", "a", "x"), (604, "same text", "b", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n string")
    got = packing.containers(df, capacity=100).toPandas()
    count = {i: packing.count_tokens(t, packing.TOKENIZER) for i, t, _, _ in docs}
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == count
    assert got.groupby("container")["n_tokens"].sum().max() <= 100
    assert (got.groupby("doc_id").size().drop(602) == 1).all() and (got["doc_id"] == 602).sum() == -(-count[602] // 100)
    same = got.set_index("doc_id")["container"]
    assert same[603] != same[604]
    full = got["n_tokens"].sum() / (got["container"].nunique() * 100)
    assert full > 0.97
    assert packing.kept_promises(packing.containers(df, capacity=100), df, 100).first()[1:] == (0, 0, 0)
    twice = df.where("doc_id IN (602, 5)").unionByName(df.where("doc_id IN (602, 5)"))
    assert packing.kept_promises(packing.containers(twice, capacity=100), twice, 100).first() == (4, 0, 0, 0)
    assert packing.containers(df.limit(0)).count() == 0


def test_long_texts_are_counted_in_stretches():
    text = "The annealed film, 12.5 nm thick;  it's doped.\n" * 9000
    assert len(text) > 4 * packing.STRETCH
    assert packing.count_tokens(text, packing.TOKENIZER) == len(packing.encoder(packing.TOKENIZER).encode_ordinary(text))


# --- p9


def _text(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi pi rho sigma tau phi chi psi omega".split()) + str(rng.randint(0, 40)) for _ in range(n)]


def test_winnowing_guarantee():
    rng = random.Random(3)
    for _ in range(30):
        shared = _text(rng, leakage.K + leakage.WINDOW - 1)
        a, b = (" ".join(_text(rng, rng.randint(0, 30)) + shared + _text(rng, rng.randint(0, 30))) for _ in range(2))
        words, rows = leakage.word_hashes(pa.array([a, b]))
        pos, h = leakage.fingerprints(words, rows)
        assert set(h[rows[pos] == 0]) & set(h[rows[pos] == 1])


def test_word_hashes_see_words_only():
    texts = ["Alpha, beta!", "", None, "ALPHA\nbeta", "alphabeta", "é–x"]
    words, rows = leakage.word_hashes(pa.array(texts))
    by = {r: words[rows == r].tolist() for r in range(6)}
    assert by[0] == by[3] and len(by[0]) == 2 and by[1] == by[2] == [] and len(by[4]) == 1 and len(by[5]) == 2
    sliced = leakage.word_hashes(pa.array(texts).slice(3, 2))
    assert sliced[0].tolist() == by[3] + by[4]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=6), st.integers(1, 5), st.integers(1, 5))
def test_fingerprints_of_chunks_of_any_size(texts, k, window):
    words, rows = leakage.word_hashes(pa.array([" ".join(t) for t in texts], pa.string()))
    pos, hashes = leakage.fingerprints(words, rows, k, window)
    assert len(pos) == len(hashes) and all(rows[p] == rows[p + k - 1] for p in pos.tolist())
    for r, t in enumerate(texts):  # every window of a text has one
        own = set((pos[rows[pos] == r] - np.searchsorted(rows, r)).tolist())
        assert all(own & set(range(a, a + window)) for a in range(len(t) - k - window + 2))
    assert leakage.matches(pa.array([" ".join(t) for t in texts], pa.string()), leakage.Passages([1], ["a b c d"])) is not None


def _shared(passage, text, n):
    """The conditions by brute force: every stretch of every start."""
    grams = lambda w: [tuple(w[i : i + leakage.RUN]) for i in range(len(w) - leakage.RUN + 1)]
    for begin in range(0, max(1, len(text)), leakage.SLACK // 2):
        part = text[begin : begin + n + 2 * leakage.SLACK]
        have = set(grams(part))
        cover = {i + j for i, g in enumerate(grams(passage)) if g in have for j in range(leakage.RUN)}
        mask = {}
        for i, w in enumerate(passage):
            mask[w] = mask.get(w, 0) | 1 << i
        if cover and len(cover) >= leakage.RUNS * n and leakage.common_subsequence(part, mask, n) >= leakage.SHARE * n:
            return True
    return False


def test_matches_lose_nothing_against_brute_force():
    rng, missed, found = random.Random(31), 0, 0
    for _ in range(150):
        n = rng.choice([4, 6, 8, 12, 20, 40, 90])
        passage = [f"w{rng.randrange(60)}" for _ in range(n)]
        part = list(passage[: rng.randint(max(1, n // 3), n)])
        for _ in range(rng.randrange(1 + n // 5)):
            part[rng.randrange(len(part))] = "other"
        text = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(80))] + part + [f"w{rng.randrange(200)}" for _ in range(rng.randrange(80))]
        got = bool(leakage.matches(pa.array([" ".join(text)]), leakage.Passages([1], [" ".join(passage)])))
        want = _shared(passage, text, n)
        found += got
        missed += want and not got
    assert missed == 0 and found > 40


def test_many_hits_are_looked_at_in_halves(monkeypatch):
    rng = random.Random(8)
    items = [" ".join(_text(rng, 40)) for _ in range(4)]
    texts = pa.array([items[k % 4] if k % 3 else " ".join(_text(rng, 50)) for k in range(23)])
    own = leakage.Passages(list(range(4)), items)
    whole = leakage.matches(texts, own)
    monkeypatch.setattr(leakage, "MOST_HITS", 5)
    assert leakage.matches(texts, own) == whole and len(whole) == 15


@pytest.mark.parametrize("n", [4, 8, 10, 16, 50, 120])
def test_whole_passages_and_one_changed_word_in_six(n):
    rng = random.Random(n)
    for every in (0, 6):
        for _ in range(20):
            passage = _text(rng, n)
            copy = [w if not every or (i + 1) % every else "changed" for i, w in enumerate(passage)]
            text = " ".join(_text(rng, rng.randrange(60)) + copy + _text(rng, 30))
            assert leakage.matches(pa.array([text]), leakage.Passages([1], [" ".join(passage)]))


def test_both_plans_on_all_passages(spark):
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    docs, tests = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_passages"))
    sent, joined = ({tuple(r) for r in leakage.leaked(docs, tests, most).collect()} for most in (leakage.MAX_SENT, 0))
    assert sent == joined and len(sent) > 10


def test_common_subsequence_by_dynamic_programming():
    rng = random.Random(4)
    for _ in range(50):
        p, d = [rng.randint(0, 5) for _ in range(rng.randint(1, 20))], [rng.randint(0, 5) for _ in range(rng.randint(0, 25))]
        mask = {}
        for i, w in enumerate(p):
            mask[w] = mask.get(w, 0) | 1 << i
        t = np.zeros((len(p) + 1, len(d) + 1), int)
        for i, x in enumerate(p):
            for j, y in enumerate(d):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert leakage.common_subsequence(d, mask, len(p)) == t[-1, -1]


@pytest.mark.parametrize("sent", [leakage.MAX_SENT, 0])
def test_leaks(spark, sent):
    rng = random.Random(6)
    items = [_text(rng, 90) for _ in range(6)]
    noise = lambda n: _text(rng, n)
    changed = [w if i % 12 else "changed" for i, w in enumerate(items[1])]
    inserted = items[2][:45] + noise(20) + items[2][45:]
    docs = {
        1: noise(200) + items[0] + noise(100), 2: noise(30) + changed + noise(30), 3: noise(30) + inserted, 4: noise(50) + items[3][:50] + noise(50), 5: noise(50) + items[3][:20] + noise(50), 6: noise(400), 7: items[4] + noise(10) + items[5],
        8: items[0][:22] + noise(300) + items[0][22:44], 10: noise(150_000) + items[0],
    }
    rows = [(i, (". " if i % 2 else "\n").join([" ".join(w[k : k + 9]) for k in range(0, len(w), 9)]).upper(), 1) for i, w in docs.items()] + [(9, None, 1), (11, "", 1), (1, " ".join(docs[1]), 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    tests = spark.createDataFrame([(i, "test", "s", " ".join(w)) for i, w in enumerate(items)] + [(90, "test", "s", "too short"), (91, "test", "s", None), (92, "test", "s", " ".join(items[0]))], "item_id bigint, split string, source string, text string")
    got = {tuple(r) for r in leakage.leaked(df, tests, sent).collect()}
    assert got == {(1, 0), (1, 92), (2, 1), (3, 2), (4, 3), (7, 4), (7, 5), (10, 0), (10, 92)}
    assert leakage.leaked(df.limit(0), tests, sent).count() == 0 and leakage.leaked(df, tests.limit(0), sent).count() == 0
    assert {r["item_id"]: r["n_documents"] for r in leakage.leak_report(df, tests).collect()}[90] == 0


# --- p10


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=40), st.integers(1, 6))
def test_automaton_covers_what_repeats(text, least):
    want = np.zeros(len(text), bool)
    for i in range(len(text)):
        for j in range(i + least, len(text) + 1):
            if text.find(text[i:j]) != i or text.find(text[i:j], i + 1) >= 0:
                want[i:j] = True
    assert spam.SuffixAutomaton(text).repeated(least).tolist() == want.tolist()
    assert spam.repeated_windows(text, least).tolist() == want.tolist()


def test_windows_equal_the_automaton_on_long_texts():
    rng = random.Random(12)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.randint(5, 60))) for _ in range(40)]
    for n in (30, 600):
        text = "".join(rng.choice(parts) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh é字") for _ in range(20)) for _ in range(n))
        for least in (1, 5, 12, 13):
            assert spam.repeated_windows(text, least).tolist() == spam.SuffixAutomaton(text).repeated(least).tolist()


def test_clauses_are_told_in_any_language():
    polish = "Warstwy perowskitu nanoszono przez wirowanie w atmosferze azotu i wygrzewano przez dziesięć minut. Po starzeniu wydajność ogniw spadła o kilka procent, ponieważ jony wędrowały do elektrody."
    finnish = "Näytteet valmistettiin typessä ja lämmitettiin hitaasti, jotta kiteet ehtivät kasvaa tasaisiksi koko pinnalla. Mittaukset toistettiin seuraavana\npäivänä samoilla laitteilla, eikä tuloksissa havaittu merkittävää eroa aiempaan."
    assert all(spam.clause_share(t) > 0.9 for t in (polish, finnish)) and not spam.is_spam("\n\n".join([polish] * 3))
    shop = " ".join(f"Tani jodek ołowiu {w} jodek ołowiu. Jodek ołowiu, {w}, jodek ołowiu." for w in ("promocja", "sklep", "hurt", "nowy", "wysyłka", "raty", "tanio", "okazja"))
    assert spam.clause_share(shop) == 0 and spam.is_spam(shop) and spam.is_spam(polish + "\n\n" + shop * 2)


CLAUSES = ["We attribute the porous layer to a contact near the surface, as reported before.", "Films of the absorber were made by gas quenching from toluene and held at 90 degrees for an hour.", "The diffusion length rose from 2 to 9 nm when the film was annealed in the glove box."]


def test_spam(spark):
    rng = random.Random(8)
    paper = " ".join(f"{c[:-1]} after run {rng.randint(0, 999)}." for _ in range(6) for c in CLAUSES)
    tags = " ".join(f"#buy{rng.choice(['GlassPaste', 'LeadIodide', 'SpinCoater'])}" for _ in range(80))
    texts = {
        1: "best lead iodide free shipping " * 40, 2: tags, 3: CLAUSES[0] + "\n\n" + "glovebox | SKU 1 | in stock\n" * 60, 4: paper, 5: paper + "\n\nKeywords: lead iodide; lead iodide film; glass", 6: paper + "\n" + "\n".join(f"[{i}] Author. Journal {i}. https://doi.example/{i}" for i in range(6)),
        7: "", 8: None, 9: "\n".join(f"{i} | {i * 7 % 100}.25 | 0.{i * 37 % 1000:03d} | 1.5" for i in range(80)), 10: "n/a", 11: "cheap glass paste near me " * 30_000, 12: "Die Schicht zeigt im Mittel über 93 Proben einen Füllfaktor von 14 Prozent. " * 30,
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(1, texts[1], "x")], "doc_id bigint, text string, word string")
    assert sorted(r["doc_id"] for r in spam.spam_pages(df).collect()) == [1, 1, 2, 3, 11]
    assert spam.spam_pages(df.limit(0)).count() == 0


# --- queries on the smallest tables


def test_every_query_runs(spark):
    import os

    from sedge.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    for name, q in queries.QUERIES.items():
        rows = q(spark, data).toPandas()
        assert len(rows) > 0, name
        if name.endswith("_found"):  # cases are told once and whole
            assert not rows.isna().any(axis=None) and (name == "p4_found" or not rows.duplicated().any()), name
