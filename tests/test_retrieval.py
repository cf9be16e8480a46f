"""Selections folded from posting lists against plain loops over every table."""

import math
import random

from pyspark.sql import functions as F

from arbiter.operators import catalog as C
from arbiter.operators import retrieval as RT

WORDS = "order item price city name total code date user shop".split()


def world(spark):
    rng = random.Random(11)
    dbs, rows, fks, desc, q = {}, [], [], [], []
    for db, n in (("a", 7), ("b", 4), ("c", 1)):
        names = sorted({f"{rng.choice(WORDS)}_{k}" for k in range(n)})
        dbs[db] = {}
        for o, name in enumerate(names, start=1):
            cols = rng.sample(WORDS, 2)
            refs = [r for r in rng.sample(names, min(2, len(names))) if r != name]
            about = rng.choice([None, " ".join(rng.sample(WORDS, 2)).title()])
            dbs[db][name] = {"ord": o, "cols": cols, "refs": refs, "about": about}
            rows += [(db, name, o, c, i, "INT", f"gloss {c}" if rng.random() < 0.5 else None, about) for i, c in enumerate(cols, start=1)]
            fks += [(db, name, i, "x", r) for i, r in enumerate(refs, start=1)]
    for i in range(60):
        db = rng.choice("abc")
        q.append((i, db, " ".join(rng.sample(WORDS + ["which", "b_3", rng.choice(list(dbs[db]))], rng.randrange(5)))))
    cat = spark.createDataFrame(rows, "db_id string, table_name string, table_ordinal int, column_name string, column_ordinal int, type string, description string, table_description string")
    fk = spark.createDataFrame(fks, "db_id string, table_name string, fk_ordinal int, local_col string, referred_table string")
    none = spark.createDataFrame([], "db_id string, table_name string, column_name string, rank int, value string")
    questions = spark.createDataFrame(q, "question_id long, db_id string, question string")
    return dbs, q, cat, fk, none, questions


def toks(s):
    import re
    return set(re.findall("[a-z0-9]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", s or "").lower()))


def scores(tables, question):
    out = {}
    for name, t in tables.items():
        own = toks(name) | toks(t["about"]) | set().union(*(toks(c) for c in t["cols"]))
        out[name] = 3 * len(toks(question) & own)
    return out


def relevant(tables, question, most, floor):
    s = scores(tables, question)
    picks = [n for n in sorted(s, key=lambda n: (-s[n], n)) if s[n] > 0][:most]
    order = sorted(tables, key=lambda n: tables[n]["ord"])
    if not picks and floor <= 0:
        return set(order)
    sel = list(picks)
    for p in picks:
        sel += [r for r in tables[p]["refs"] if r not in sel]
    sel = sel[:most]
    rest = [n for n in order if n not in sel]
    return set(sel + rest[: max(floor - len(sel), 0)])


def test_selections_against_loops(spark):
    dbs, q, cat, fk, none, questions = world(spark)
    blocks = C.render_blocks(cat, fk, none)
    size = {(r.db_id, r.table_name): (r.cost, len(r.block)) for r in blocks.collect()}
    hits = RT.question_hits(questions, RT.posting_lists(cat, none), RT.schemas(cat, fk, blocks))
    assert hits.count() == len(q)
    for most, floor in ((8, 0), (2, 0), (2, 4)):
        got = {}
        for r in RT.relevant_tables(hits, most, True, floor).collect():
            got.setdefault(r.question_id, set()).add(r.table_name)
        assert got == {i: relevant(dbs[db], text, most, floor) for i, db, text in q}
    floors = {r.question_id: r.n for r in RT.relevant_tables(hits, 2, False, C.widening_floor(F.col("question_id") % 3, 2)).groupBy("question_id").agg(F.count("*").alias("n")).collect()}
    assert all(floors[i] >= min(2 * 2 ** (i % 3), len(dbs[db])) for i, db, _ in q)

    def order(db, text):
        s = scores(dbs[db], text)
        return sorted(dbs[db], key=lambda n: (-s[n], dbs[db][n]["ord"]))

    def prefix(db, names, budget):
        out, total = [], 0
        for n in names:
            total += size[db, n][0]
            if out and total > budget:
                break
            out.append(n)
        return out

    def tokens(db, names):
        return math.ceil((sum(size[db, n][1] for n in names) + 2 * (len(names) - 1)) / 4)

    budgets = (10, 60, 120, 10_000)
    for budget in budgets:
        got = {}
        for r in RT.fit_budget(hits, budget).collect():
            got.setdefault(r.question_id, set()).add(r.table_name)
        assert got == {i: set(prefix(db, order(db, text), budget)) for i, db, text in q}
        for r in RT.gate(hits, budget).collect():
            _, db, text = q[r.question_id]
            whole = list(dbs[db])
            names = whole if tokens(db, whole) <= budget else prefix(db, order(db, text), budget)
            assert (r.mode, r.n_tables, r.tokens) == ("full" if tokens(db, whole) <= budget else "rag", len(names), tokens(db, names))
    for r in RT.budget_report(hits, budgets).collect():
        differ, right, naive, judged = 0, 0, 0, 0
        for _, db, text in q:
            own = sorted(dbs[db], key=lambda n: dbs[db][n]["ord"])
            a, b = prefix(db, order(db, text), r.budget), prefix(db, own, r.budget)
            gold = {n for n in own if n.lower() in toks(text)}
            differ += set(a) != set(b)
            judged += bool(gold)
            right += bool(gold) and gold <= set(a)
            naive += bool(gold) and gold <= set(b)
        share = lambda x: x / judged if judged else 0.0  # noqa: B023, E731
        assert (r.divergence, r.ranked_accuracy, r.naive_accuracy) == (differ / len(q), share(right), share(naive))
    means = {r["mode"]: r.total_tokens for r in RT.footprint(hits, 60, 2).collect()}
    assert means["naive"] == sum(tokens(db, list(dbs[db])) for _, db, _ in q)
    assert means["always"] == sum(tokens(db, relevant(dbs[db], text, 2, 0)) for _, db, text in q)


def test_no_questions(spark):
    _, _, cat, fk, none, questions = world(spark)
    hits = RT.question_hits(questions.limit(0), RT.posting_lists(cat, none), RT.schemas(cat, fk, C.render_blocks(cat, fk, none)))
    assert RT.relevant_tables(hits).count() == RT.footprint(hits, 10).count() == RT.budget_report(hits, [10]).count() == 0


def test_descriptions_ride_into_the_block(spark):
    frames = {"schools": spark.createDataFrame([("1", 2)], "cds string, n int")}
    about = spark.createDataFrame([("schools", "All schools of a county")], "table_name string, description string")
    glosses = spark.createDataFrame([("schools.cds", "A 14-char school identifier."), ("schools.n", "")], "column_key string, description string")
    fks = spark.createDataFrame([], "db_id string, table_name string, fk_ordinal int, local_col string, referred_table string")
    samples = C.sample_values("d", frames)
    cat = C.catalog_from_frames(spark, "d", frames, about, glosses)
    block = C.render_blocks(cat, fks, samples).first().block
    assert block.startswith("-- All schools of a county\nCREATE TABLE schools (\n  -- A 14-char school identifier.\n  cds STRING,\n  n INT\n);")
    names = {r.token for r in C.table_tokens(cat, samples).where("kind = 'name'").collect()}
    assert {"county", "schools", "cds"} <= names and "identifier" not in names  # a column's gloss is no name
    plain = C.render_blocks(C.catalog_from_frames(spark, "d", frames), fks, samples).first().block
    assert plain.startswith("CREATE TABLE schools (\n  cds STRING")
