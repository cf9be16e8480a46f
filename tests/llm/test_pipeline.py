"""The pipeline's stages against brute-force versions on a whole small table, each on its own input."""

import re
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from arbiter.llm import queries
from arbiter.llm.common import written
from arbiter.llm.decontaminate import leaks
from arbiter.llm.jaccard_join import near_duplicates
from arbiter.llm.quality_rules import clean_lines

from .messy import WORD, frame, prose, similar
from .test_matching import groups_of
from .test_mix_url_chat import brute_targets, sizes_of
from .test_text_operators import brute_base

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__

    names = [*queries.QUERIES, "pipeline"]
    assert set(names) <= set(__spark_entry__.queries()) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append([tuple(r) for r in docs.collect()])
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
    result = [tuple(r) for r in docs.collect()]
    raw, ruled, unique, clean, private = inputs
    # Quality rules: no document stays that the base rule rejects, and good prose stays as it is.
    kept = {r[0]: r for r in ruled}
    for r in raw:
        n, _, symbols, dup, repeat = brute_base(r[1])
        if n < 50 or 100 * repeat > 50 * n:
            assert r[0] not in kept
        elif not symbols and not dup and not re.search("(?i)rights reserved|!", r[1]):
            assert kept[r[0]][1] == r[1]
    assert all(r[4] == len(r[1]) for r in ruled)
    # Near duplicates: one of each connected group of similar documents.
    pairs = [(a[0], b[0]) for i, a in enumerate(ruled) for b in ruled[i + 1 :] if similar(a[1], b[1])]
    assert sorted(r[0] for r in unique) == sorted(set(groups_of([r[0] for r in ruled], pairs).values()))
    # Leaks: documents with an item's words in order.
    items = [" ".join(WORD.findall(r.text)).lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {r[0] for r in unique if any(i in " ".join(WORD.findall(r[1])).replace("!!", "").lower() for i in items)}
    assert leaking and {r[0] for r in unique} - {r[0] for r in clean} == leaking
    # Personal data: rows stay, planted kinds of values are gone, other texts are left alone.
    before, after = {r[0]: r[1] for r in clean}, {r[0]: r[1] for r in private}
    assert before.keys() == after.keys() and all(r[4] == len(r[1]) for r in private)
    planted = re.compile(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|AKIA[A-Z0-9]{16}|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")
    for i, t in before.items():
        assert not any(v in after[i] for v in planted.findall(t))
        if not re.search("[0-9@=]", t):
            assert after[i] == t
    # Mix: whole repeats near the targets.
    times, known = Counter(result), Counter(private)
    assert all(n <= 3 * known[r] for r, n in times.items())
    want = brute_targets(sizes_of([(r[0], r[1], r[2], r[3]) for r in private]))
    for source, target in want.items():
        longest = max(len(WORD.findall(r[1])) for r in private if r[3] == source)
        assert abs(sum(len(WORD.findall(r[1])) for r in result if r[3] == source) - target) <= 2 * longest


def test_odd_rows_pass_through_every_stage(spark):
    for some in (None, []):
        for _, stage in corpus_pipeline.STAGES:
            docs = frame(spark, some)
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).collect()


def test_rows_go_to_python_few_at_once_and_texts_once(spark):
    """The JVM holds what it sends outside its heap, so that a batch counts twice in an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = frame(spark, [(i, prose(i % 7, 60), "en", "a", 9, "r", None, 7, i) for i in range(3000)]).coalesce(1)
    few, benchmark = docs.limit(5), spark.createDataFrame([], "item_id long, text string")
    many = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    try:
        for given, most in (("10000", 1000), ("0", 1000), ("70", 70)):
            for stage in (lambda: clean_lines(docs), lambda: near_duplicates(few), lambda: leaks(few, benchmark)):
                spark.conf.set(name, given)
                stage()
                sizes = [r.n for r in many.select("*").collect()]
                assert sum(sizes) == 3000 and max(sizes) <= most
        plan = corpus_pipeline.quality_rules(spark, docs, SF)._jdf.queryExecution().analyzed().toString()
        packed = re.search(r"struct\(([^)]*)\) AS row#\d+, text#\d+ AS text#", plan)[1]
        assert "doc_id#" in packed and "text#" not in packed
    finally:
        spark.conf.set(name, before)
