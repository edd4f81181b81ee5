import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedge.operators.packed import Model, _cut, atoms, lattice, readings, split_packed, unquote

CELLS = {
    1: "SLG | ITO | TiO2-c | Perovskite | Au", 2: "SLG|ITO|TiO2-c|Perovskite|Au", 3: "SLG, ITO, TiO2-c, Perovskite, Au", 4: "SLG;ITO; TiO2-c |Perovskite|Au", 5: 'SLG,ITO,"LiF, 1 nm",Perovskite,Au', 6: "SLG | ITO | LiF, 1 nm | Perovskite | Au",
    7: 'SLG | "SiO2|SiN mesh" | Perovskite | "Carbon ""low T""" | “Au”', 8: "SLG → ITO → Perovskite → Au", 9: "SLG | ITO | unknown |  | Au", 10: None, 11: "nan; nan", 12: "Au", 13: "SLG/ITO/TiO2-c/Perovskite/Au", 14: "Au |", 15: "",
}
WANT = {
    1: ["SLG", "ITO", "TiO2-c", "Perovskite", "Au"], 4: ["SLG", "ITO", "TiO2-c", "Perovskite", "Au"], 5: ["SLG", "ITO", "LiF, 1 nm", "Perovskite", "Au"], 6: ["SLG", "ITO", "LiF, 1 nm", "Perovskite", "Au"],
    7: ["SLG", "SiO2|SiN mesh", "Perovskite", 'Carbon "low T"', "Au"], 8: ["SLG", "ITO", "Perovskite", "Au"], 13: ["SLG", "ITO", "TiO2-c", "Perovskite", "Au"],
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(k, v, "x") for k, v in CELLS.items()] + [(100 + k, "SLG | ITO | TiO2-c | Perovskite | Au", "y") for k in range(5)], "row_id bigint, stack string, item string")
    out = {}
    for r in split_packed(df, "row_id", ["stack"]).collect():
        out.setdefault(r["row_id"], []).append((r["pos"], r["item"]))
    return {k: sorted(v) for k, v in out.items()}


def test_values_come_out_with_their_positions(rows):
    for k, want in WANT.items():
        assert rows[k] == list(enumerate(want, 1)), k
    assert rows[2] == rows[3] == rows[1] == rows[100]


def test_empty_items_keep_their_position(rows):
    assert rows[9] == [(1, "SLG"), (2, "ITO"), (5, "Au")] and rows[14] == [(1, "Au")]
    assert not {10, 11, 12, 15} & set(rows)


def test_quotes():
    assert atoms('a,"b, c",d') == [(2, 8)] and atoms('5" disc, a') == []
    assert unquote(' "say ""hi""" ') == 'say "hi"' and unquote("“x”") == "x"


def test_empty_table_and_long_cell(spark):
    schema = "row_id bigint, stack string"
    assert split_packed(spark.createDataFrame([], schema), "row_id", ["stack"]).count() == 0
    long = " | ".join(["Au", "ITO"] * 5000)
    assert split_packed(spark.createDataFrame([(1, long), (2, "Au | ITO")], schema), "row_id", ["stack"]).where("row_id = 1").count() == 10000


def _split(spark, cells, **more):
    df = spark.createDataFrame(list(enumerate(cells)), "row_id bigint, stack string")
    out = {}
    for r in split_packed(df, "row_id", ["stack"], **more).collect():
        out.setdefault(r["row_id"], []).append((r["pos"], r["item"]))
    return {k: sorted(v) for k, v in out.items()}


def test_a_known_value_may_hold_any_number_of_delimiters(spark):
    name = "2,2',7,7'-tetrakis, N,N-di, spiro"
    lists = [f"{a} | {b} | {c}" for a in ("SLG", "PET", "PEN") for b in ("ITO", "FTO", name) for c in ("Au", "Ag", "Al", "Cu")]
    got = {k - len(lists): v for k, v in _split(spark, [*lists, f"SLG, {name}, Au", "SLG, ITO, Ag"]).items()}
    assert got[0] == [(1, "SLG"), (2, name), (3, "Au")] and got[1] == [(1, "SLG"), (2, "ITO"), (3, "Ag")]


def test_values_that_are_joined_split_as_those_that_are_sent(spark):
    cells = list(CELLS.values()) + [f"0,{i}; 0,{99 - i}" for i in range(10, 40)] + ["SLG | SiO2|SiN mesh | Au", '"SiO2|SiN mesh"', 'ITO;"SiO2|SiN mesh"', "SiO2|SiN mesh|Au"]
    sent, joined = _split(spark, cells), _split(spark, cells, most_sent=0)
    assert sent == joined and sent[len(CELLS)] == [(1, "0,10"), (2, "0,89")]


def test_the_size_of_the_column_does_not_decide(spark):
    cells = [f"x{i}; y{i}" for i in range(30)]
    want = {k: [(1, f"x{k}"), (2, f"y{k}")] for k in range(30)}
    assert _split(spark, cells) == want
    more = _split(spark, cells + [f"u{i}; v{i}" for i in range(3000)])
    assert {k: more[k] for k in range(30)} == want


def test_a_path_below_the_best_is_given_up():
    m = Model({"a": 50.0, "b": 50.0}, {";": 90.0, "": 10.0})
    assert m.split("a; b") == ["a", " b"] and m.items("a;;b") == ([1, 3], ["a", "b"]) and m.items(None) == ([], [])


@settings(max_examples=300, deadline=None)
@given(st.text('ab|;, >\t"', max_size=14))
def test_pieces_are_those_of_the_lattice(cell):
    got, want = readings(cell), {k: _cut(cell, s) for k, s in lattice(cell).items()}
    assert {k: [unquote(x) for x in v] for k, v in got.items()} == {k: [unquote(x) for x in v] for k, v in want.items()}


def test_lists_come_back_as_they_were_packed(spark):
    rng = random.Random(11)
    values = ["SLG", "ITO", "FTO", "TiO2-c", "TiO2-mp", "SnO2", "Perovskite", "Spiro-MeOTAD", "PTAA", "Au", "Ag", "Carbon", "PET", "ZnO", "SiO2|SiN mesh", "LiF, 1 nm", 'Carbon "low T"', "NiO/Au"]
    packed = []
    for _ in range(400):
        items = [rng.choice(values) for _ in range(rng.randint(2, 7))]
        kind = rng.choice([" | ", "|", "; ", ";", ", ", " → ", " > "])
        mark = kind.strip()
        packed.append((kind.join('"' + x.replace('"', '""') + '"' if mark in x or '"' in x or rng.random() < 0.05 else x for x in items), items))
    got = _split(spark, [c for c, _ in packed])
    assert sum(got.get(k) == list(enumerate(items, 1)) for k, (_, items) in enumerate(packed)) >= 398
