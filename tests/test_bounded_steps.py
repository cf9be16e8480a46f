"""Steps whose memory and shuffles must stay even: what a task keeps, what is dealt out, and what is written."""

import datetime
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F

from arbiter.operators import catalog as C
from arbiter.operators import keys as K
from arbiter.operators import profile as P
from arbiter.operators import retrieval as RT
from arbiter.operators import values as L
from arbiter.operators import voting as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_samples_keep_few_texts_a_task():
    cells = [[f"v{(7 * i + j) % 90:02d}" if i % 5 else None for i in range(50)] for j in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c), pa.array([None] * 50, pa.string()), pa.array(["one"] * 50)], ["a", "b", "c"]) for c in cells]
    rows = [(r["i"], r["value"]) for b in P._least(5)(iter(batches)) for r in b.to_pylist()]
    assert rows == [(0, v) for v in sorted({v for c in cells for v in c if v})[:5]] + [(2, "one")]


def test_samples_against_plain_python(spark):
    rows = [(i * 37 % 101, None if i % 3 else f"t{i % 11}", "x" * (i % 50), [i], i / 4) for i in range(300)]
    frames = {"t": spark.createDataFrame(rows, "a long, b string, c string, d array<int>, e double").repartition(7), "none": spark.createDataFrame([], "a int")}
    got = {}
    for r in C.sample_values("d", frames).orderBy("rank").collect():
        got.setdefault(r.column_name, []).append(r.value)
    want = {c: sorted({str(r[i]) for r in rows if r[i] is not None and len(str(r[i])) <= 40})[:5] for i, c in enumerate("abcde") if c != "d"}
    assert got == want


def test_questions_are_dealt_out_before_their_tokens(spark):
    q = spark.createDataFrame([(1, "d", "alpha beta alpha"), (1, "d", "beta gamma"), (None, "d", "alpha")], "question_id long, db_id string, question string")
    tokens = C.question_tokens(q)
    assert shuffles(tokens) == 1
    assert plan(tokens).index("Generate") < plan(tokens).index("Exchange")  # the tree is printed from the result down
    assert sorted(map(tuple, tokens.select("question_id", "token").collect()), key=str) == sorted([(1, "alpha"), (1, "beta"), (1, "gamma"), (None, "alpha")], key=str)
    postings = spark.createDataFrame([("d", "alpha", [(1, 3)])], "db_id string, token string, postings array<struct<ord:int,w:bigint>>")
    schema = spark.createDataFrame([("d", [(1, "a", 1, 1, [])])], "db_id string, tables array<struct<ord:int,name:string,cost:bigint,len:bigint,refs:array<int>>>")
    hits = RT.question_hits(q, F.broadcast(postings), F.broadcast(schema))
    assert shuffles(hits) == 1 and plan(hits).index("Generate") < plan(hits).index("Exchange hashpartitioning")


def test_tasks_grow_in_number_with_the_questions(spark, monkeypatch):
    """Parts of questions stay as large as they are, and scores, ranks and links are made where they were dealt out."""
    monkeypatch.setattr(C, "QUESTIONS_PER_TASK", 10)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = spark.range(10 * width + 391).select(F.col("id").alias("question_id"), F.lit("d").alias("db_id"), F.concat(F.lit("alpha of t"), F.col("id") % 3).alias("question"))
    assert C.spread(q).rdd.getNumPartitions() == width + 40 and C.spread(q.limit(3)).rdd.getNumPartitions() == width
    catalog = spark.createDataFrame([("d", "t0", 1, "alpha", 1, None), ("d", "t1", 2, "b", 1, None)], "db_id string, table_name string, table_ordinal int, column_name string, column_ordinal int, table_description string")
    none = spark.createDataFrame([], "db_id string, table_name string, column_name string, rank int, value string")
    ranked = C.ranked_names(C.score(q, catalog, none))
    dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\(question_id[^,]*, (\d+)\)", plan(ranked))]
    assert dealt == [width + 40]
    linked = C.link_tables(C.spread(q).select("question_id", "db_id", F.explode(C.tokens(F.col("question"))).alias("table_name")), catalog, C.spread(q).select("question_id", F.lit("t0").alias("table_name"), F.lit(1).alias("table_ordinal")))
    assert set(re.findall(r"Exchange hashpartitioning\(question_id[^,]*, (\d+)\)", plan(linked))) == {str(width + 40)}
    assert linked.where("source = 'link'").count() + linked.where("source = 'fallback'").count() == q.count()


def test_scores_of_ids_that_come_twice_or_are_null(spark):
    """Each row is scored by the tokens of all rows of its id; a null id scores nothing, a null db has no tables."""
    q = spark.createDataFrame([(1, "d", "alpha"), (1, "d", "beta alpha"), (2, "e", "alpha"), (2, "d", "nothing"), (None, "d", "alpha"), (None, "d", None), (3, None, "alpha"), (4, "d", None)],
                              "question_id long, db_id string, question string")
    catalog = spark.createDataFrame([("d", "alpha", 1, "x", 1, None), ("d", "beta", 2, "alpha", 1, None), ("e", "alpha", 1, "y", 1, None)],
                                    "db_id string, table_name string, table_ordinal int, column_name string, column_ordinal int, table_description string")
    samples = spark.createDataFrame([("d", "alpha", "x", 1, "alpha")], "db_id string, table_name string, column_name string, rank int, value string")
    got = sorted(map(tuple, C.score(q, catalog, samples).collect()), key=str)
    want = [(1, "d", "alpha", 1, 4), (1, "d", "beta", 2, 6)] * 2 + [(2, "d", "alpha", 1, 3), (2, "d", "beta", 2, 0), (2, "e", "alpha", 1, 3)]
    want += [(i, "d", t, o, 0) for i in (None, None, 4) for t, o in (("alpha", 1), ("beta", 2))]
    assert got == sorted(want, key=str)


def test_columns_are_read_by_tasks_of_their_own(spark, tmp_path):
    frames = {"t": spark.createDataFrame([(1, "a", 2), (2, " A ", 1)], "x long, y string, z int")}
    masks, words = K.column_masks(frames)
    assert words == 1 and "Generate" not in plan(masks)
    assert sorted(map(tuple, masks.collect())) == [(2, 2), (5, 2)]  # y holds two values alone, x and z the same two
    rows, holders = L.ValueIndex(spark, str(tmp_path))._masks(frames)
    assert shuffles(rows) == 1 and "Generate" not in plan(rows)
    got = {r.value_norm: r.h for r in rows.select("value_norm", holders.alias("h")).collect()}
    assert got == {"1": ["t.x", "t.z"], "2": ["t.x", "t.z"], "a": ["t.y"]}


def test_value_index_of_more_columns_than_a_word_has_bits(spark, tmp_path):
    wide = spark.createDataFrame([tuple(i // 2 for i in range(150))], ", ".join(f"c{i} int" for i in range(150)))
    index = L.ValueIndex(spark, str(tmp_path)).add({"Wide": wide})
    assert {r.value_norm: r.holders for r in index.rows().collect()} == {str(k): sorted([f"wide.c{2 * k}", f"wide.c{2 * k + 1}"]) for k in range(75)}


def test_classes_by_type_agree_with_the_patterns(spark):
    at, day = datetime.datetime(2020, 1, 2, 3), datetime.date(2020, 1, 2)
    columns = {
        "whole": ("long", [5, 0, 12]), "signed": ("int", [-5, 3]), "nan": ("double", [math.nan, math.inf]), "low": ("double", [-math.inf]), "x": ("float", [1.0, 2e20]),
        "yes": ("boolean", [True, False]), "ts": ("timestamp_ntz", [at]), "day": ("date", [day]), "dec": ("decimal(5,0)", None), "none": ("int", []),
    }
    frames = {n: spark.createDataFrame([(v,) for v in vs] + [(None,)], f"{n} {t}") for n, (t, vs) in columns.items() if vs is not None}
    frames["dec"] = spark.range(3).select(F.col("id").cast("decimal(5,0)").alias("dec"))
    got = {r.column_name: r.char_class for r in P.Profiles(frames).columns().collect()}
    for n, df in frames.items():
        text = df.select(P.plain_text(F.col(n), df.schema[0].dataType).alias("t"))
        told = text.agg(*(F.bool_and(F.col("t").rlike(p)).alias(c) for c, p in P.CHAR_CLASS_PATTERNS)).collect()[0]
        want = "empty" if told["digits"] is None else next((c for c, _ in P.CHAR_CLASS_PATTERNS if told[c]), "mixed")
        assert got[n] == want, n
    seen = P._seen(frames["signed"], [(4, frames["signed"].schema[0])]).collect()
    assert [(r.column, r.min, r.max, r.minlen, r.maxlen) for r in seen] == [(4, "-5", "3", 1, 2)]


def test_exact_classes_write_no_candidate_rows(spark, monkeypatch):
    """Forty candidates of one fingerprint, every seventh of which differs in one count; only names of members are written."""
    rows = [(1, i, p, "same", 1.0) for i in range(40) for p in range(3 + (i % 7 == 3))] + [(2, i, 0, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "question_id long, idx int, row_pos long, a string, b double")
    prints = df.select("question_id", "idx").distinct().select("question_id", "idx", F.lit(False).alias("errored"), F.lit("fp").alias("fp"))
    written = []
    monkeypatch.setattr(V, "stable", lambda d, keep=V.stable: written.append(d.columns) or keep(d))
    got = {(r.question_id, r.idx): r.fp for r in V.exact_classes(df, prints, ["a", "b"]).collect()}
    assert got == {(q, i): "fp#1" if q == 1 and i % 7 == 3 else "fp" for q, i in {r[:2] for r in rows}}
    assert written and not any("cells" in c for c in written)
