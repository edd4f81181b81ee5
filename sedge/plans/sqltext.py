"""Pieces of the SQL twins."""

from __future__ import annotations

from sedge.operators.targets import BIN_EDGES, FIELDS, LIMITS, TARGET_COLUMNS, bin_labels

_TOKEN = "(unknown|nan|none|null|n/a)?"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def stripped(c: str) -> str:
    return f"trim({c}, {_BLANKS})"


def missing(c: str) -> str:
    return f"regexp_full_match(lower(coalesce({c}, '')), '\\s*{_TOKEN}\\s*([;|]\\s*{_TOKEN}\\s*)*')"


def given(c: str) -> str:
    return f"CASE WHEN NOT {missing(c)} THEN {stripped(c)} END"


def number(c: str) -> str:
    return f"CASE WHEN regexp_full_match({stripped(c)}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({stripped(c)} AS DOUBLE) END"


def bucket(key: str, seed: int = 17) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {key}), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551615.0"


def split(key: str) -> str:
    return f"CASE WHEN {bucket(key)} < 0.8 THEN 'train' WHEN {bucket(key)} < 0.9 THEN 'validation' ELSE 'test' END"


def binned(field: str, c: str) -> str:
    labels, edges = bin_labels(field), BIN_EDGES[field]
    return "CASE " + " ".join(f"WHEN {c} < {e} THEN '{x}'" for e, x in zip(edges, labels)) + f" WHEN {c} IS NOT NULL THEN '{labels[-1]}' END"


def limits(prefix: str = "") -> str:
    return " AND ".join(f"{prefix}{f} BETWEEN {LIMITS[f][0]} AND {LIMITS[f][1]}" for f in FIELDS)


TARGETS = "SELECT *, " + ", ".join(f"{number(chr(34) + c + chr(34))} AS {f}" for f, c in TARGET_COLUMNS.items()) + " FROM devices"
ERROR = "abs(pce - voc * jsc * ff)"
VALID = f"SELECT * FROM ({TARGETS}) WHERE {limits()} AND {ERROR} <= 5.0"
PAIRED = f"""SELECT row_id, pce AS t_pce, voc AS t_voc, jsc AS t_jsc, ff AS t_ff, voc * jsc * ff AS p_pce, gap * 0.6 AS p_voc, 30 - 5 * gap AS p_jsc, CASE WHEN pce IS NOT NULL THEN 0.7 END AS p_ff
FROM (SELECT *, {number('Perovskite_band_gap')} AS gap FROM ({TARGETS}))"""
LONG = f"SELECT * FROM (SELECT unnest([{', '.join(repr(f) for f in FIELDS)}]) AS field, unnest([{', '.join('t_' + f for f in FIELDS)}]) AS truth, unnest([{', '.join('p_' + f for f in FIELDS)}]) AS pred, row_id, t_pce FROM ({PAIRED}))"


def binned_by_field(c: str) -> str:
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {binned(f, c)}" for f in FIELDS) + " END"
