"""Key discovery against sets of values, and the declared-key helpers."""

import random

from arbiter.operators import keys as K
from arbiter.sources import catalogio as IO


def brute(tables):
    """{(child, child_col, parent, parent_col)} of inclusions in key columns."""
    columns = {(t, c): [r[i] for r in rows] for t, (cols, rows) in tables.items() for i, c in enumerate(cols)}
    out = set()
    for a, xs in columns.items():
        x = {v for v in xs if v is not None}
        for b, ys in columns.items():
            key = len(set(ys)) == len(ys) and None not in ys
            if a != b and x and key and all(any(type(v) is type(w) and v == w for w in ys) for v in x):
                out.add((*a, *b))
    return out


def frames(spark, tables, schemas):
    return {t: spark.createDataFrame(rows, schemas[t]) for t, (_, rows) in tables.items()}


def test_inclusions_against_sets(spark):
    rng = random.Random(4)
    long_text = "x" * 100
    tables = {
        "parent": (["p_id", "p_name", "p_note"], [(i, f"n{i}", long_text + str(i)) for i in range(40)]),
        "child": (["c_id", "pa_id", "c_name", "c_note", "c_none"], [(i, rng.choice([None, *range(20)]), f"n{rng.randrange(40)}", long_text + str(rng.randrange(40)), None) for i in range(90)]),
        "other": (["o_id", "p_id", "o_name"], [(i, rng.randrange(60), f"n{rng.randrange(80)}") for i in range(50)]),
        "empty": (["p_id"], []),
    }
    schemas = {"parent": "p_id long, p_name string, p_note string", "child": "c_id int, pa_id long, c_name string, c_note string, c_none string",
               "other": "o_id long, p_id int, o_name string", "empty": "p_id long"}
    found = K.inclusions(frames(spark, tables, schemas))
    got = {(r.child, r.child_col, r.parent, r.parent_col) for r in found.collect()}
    assert got == brute(tables)
    keys = {(r.child, r.child_col, r.parent, r.parent_col) for r in K.foreign_keys(found).collect()}
    assert ("child", "pa_id", "parent", "p_id") in keys and ("child", "c_name", "parent", "p_name") in keys
    assert ("other", "p_id", "parent", "p_id") not in keys  # some values are missing in the parent
    assert all(c != p for c, _, p, _ in keys)


def test_masks_of_more_columns_than_a_word(spark):
    n = 70
    wide = spark.createDataFrame([tuple(range(k, k + n)) for k in range(3)], ", ".join(f"c{i} int" for i in range(n)))
    got = {(r.child_col, r.parent_col) for r in K.inclusions({"wide": wide, "key": spark.createDataFrame([(i,) for i in range(2, 70)], "k int")}).collect()}
    assert got == {(f"c{i}", "k") for i in range(2, 68)}


def test_equal_keys_reference_one_way(spark):
    a, b = (spark.createDataFrame([(i,) for i in range(5)], "id long") for _ in range(2))
    got = [tuple(r) for r in K.foreign_keys(K.inclusions({"a": a, "b": b})).collect()]
    assert got == [("b", "id", 1, "a", "id")]


def test_declared_keys_resolve_an_implicit_parent_column(spark):
    frames_ = {"p": spark.createDataFrame([(1, "x"), (2, "y")], "p_id long, name string"), "q": spark.createDataFrame([(1,), (1,)], "q_id long")}
    declared = spark.createDataFrame([("c", "pid", "p", None), ("c", "pid", "p", None), ("c", "qid", "q", None), ("c", "n", "p", "name")], "child string, child_col string, parent string, parent_col string")
    got = {tuple(r) for r in IO.foreign_keys(declared, IO.primary_keys(spark, frames_)).collect()}
    assert got == {("c", "pid", "p", "p_id"), ("c", "qid", "q", "(pk)"), ("c", "n", "p", "name")}
