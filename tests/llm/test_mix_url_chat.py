import random

import duckdb
import pytest

from arbiter.llm import mixing, quote_threads, url_filter
from pyspark.sql import functions as F

from .messy import WORD, frame, rows


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] >= cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def sizes_of(some):
    out = {}
    for r in some:
        out[r[3]] = out.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    return out


def test_targets_and_copies(spark):
    found = mixing.mix_copies(frame(spark), F.col("doc_id")).collect()
    sizes = sizes_of(rows())
    want = brute_targets(sizes)
    assert len(found) == len(rows())
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.copies <= 3
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") % 97).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"),
    )
    one = mixing.mix_copies(docs, F.col("doc_id"))
    by = one.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    for r in by:
        assert abs(r.taken - r.target) <= 0.02 * r.target + 3 * 97
    again = mixing.mix_copies(docs.repartition(3), F.col("doc_id"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))


def test_digest_slices_change_nothing(spark, monkeypatch):
    whole = sorted(map(tuple, mixing.mix_copies(frame(spark), F.col("doc_id")).collect()), key=repr)
    monkeypatch.setattr(mixing, "SLICE_ROWS", 1)
    assert sorted(map(tuple, mixing.mix_copies(frame(spark), F.col("doc_id")).collect()), key=repr) == whole


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = frame(spark)
    copies = {}
    for r in mixing.mix_copies(docs).collect():
        copies[tuple(r.row)] = copies.get(tuple(r.row), 0) + r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == {k: v for k, v in copies.items() if v}
    assert mixing.mix(frame(spark, [])).count() == 0


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "https://Example.COM/en/a?b#c", "https://www.example.com/en/", "https://www.example.com/de", "http://a.b.example.com/en/x",
    "http://xexample.com/en/x", "http://example.com", "http://example.com?x=/en/", "ftp://m.foo.net/es/1", "http://net/fr/", "http://foo.net/en/", "http://foo.net:80/es/",
    "http://example.com./en/", "x://y://z/en/", "http://www.example.com/en/", "http://é.com/", "http://foo.org/a",
]


def brute_url(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


@pytest.mark.parametrize("width", [1, 7])
def test_urls_against_brute_force_and_oracle(spark, width):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        rules = [*url_filter.RULES, ("a.b.example.com", "/", "block"), ("b.example.com", "/en/x", "allow"), ("org", "/a", "block"), ("org", "/a", "allow")]
        pages = spark.createDataFrame([(i, u, "host", "rule") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, rule string")
        got = url_filter.judge_urls(pages, spark.createDataFrame(rules, url_filter.RULES_SCHEMA), F.col("page_id")).collect()
        assert {r.row: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute_url(u, rules) for i, u in enumerate(URLS + URLS)}
        assert len(got) == 2 * len(URLS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_url_rules_of_the_query(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(url_filter.RULES, url_filter.RULES_SCHEMA)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    want = {r[0]: r[1:] for r in con.execute(url_filter.ORACLE).fetchall()}
    assert {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    none = spark.createDataFrame([], url_filter.RULES_SCHEMA)
    assert {r.verdict for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.where("false"), spark.createDataFrame(url_filter.RULES, url_filter.RULES_SCHEMA)).count() == 0


CHATS = [
    (1, 0, "user", "Hello there my friend\nHow do I sort a list?"), (1, 1, "assistant", "> How do I  sort a list?\nUse sorted()."),
    (1, 2, "user", "On Monday Bob wrote:\n>> How do I sort a list?\n> Use sorted().\nThanks, that is nice"), (1, 3, "user", "> Hello there my friend\n> How do I sort a list?\nMe too"),
    (1, 4, "x", "> unknown quote line\nbody"), (1, 5, "y", ">only quote here unknown"), (1, 6, "z", None), (1, 7, "z", ""), (1, 7, "z", ""), (1, 8, "u", "> Thanks, that is nice\n\nwelcome to you all"),
    (1, 9, "u", "  >  > Thanks, that is nice\n>welcome to you all\nbye"), (1, 10, "v", "> hello there my friend how do I\n> sort a list?\nrewrapped"), (2, 0, "user", "no quotes > here"),
    (2, 1, "assistant", "> no quotes > here\nok then sure"), (2, 1, "assistant", "> ok then sure\nsame turn"), (None, 0, "a", "Use sorted()."), (None, 1, "a", "> Use sorted()."), (3, None, "a", "> x"),
    (4, 0, None, "first line here"), (4, 1, None, "first line here"), (4, 2, None, "> first line here\nanswer to the second"),
]


@pytest.mark.parametrize("width", [1, 6])
def test_threads_against_the_oracle(spark, width):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        schema = "conv_id long, turn long, role string, text string"
        got = quote_threads.format_threads(spark.createDataFrame(CHATS, schema))
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", CHATS)
        cur = con.execute(quote_threads.ORACLE)
        names = [d[0] for d in cur.description]
        rows = [tuple(r[c] for c in names) for r in got.collect()]
        assert sorted(rows, key=repr) == sorted(cur.fetchall(), key=repr)
        by = {(r.conv_id, r.turn): r for r in got.where("conv_id = 1").collect()}
        assert by[1, 2].reply_to == 1 and by[1, 2].content == "Thanks, that is nice" and by[1, 9].depth == 4
        assert by[1, 10].reply_to == 0 and by[1, 5].content == "" and by[1, 6].content is None
        assert quote_threads.format_threads(spark.createDataFrame([], schema)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quotes_of_other_wrapping_and_short_quotes_are_linked(spark):
    long = "First we looked at the old engine.\n\nThen Ada took the green valve apart, cleaned every ring of it\nand put it back without a leak.\n\nAt last we went home by train."
    chat = [
        (0, long), (1, "Yes."), (2, "Something else altogether, said at some length"),
        (3, "> Then Ada took the green\n> valve apart, cleaned every ring\n> of it and put it back without a leak.\nWell done"),
        (4, "> Yes.\nReally?"), (5, "> First we looked at\n> the old engine.\nWhy?\n> At last we went\n> home by train.\nWhen?"),
        (6, "> > Something else\n> > altogether, said at\n> nobody wrote such a thing\nok"), (7, "> No.\nunknown"), (8, "> without a trace of any leak in it\nunknown"),
    ]
    rows = [(c, turn, "user", text) for c in (1, 2) for turn, text in chat if c == 1 or turn > 2]
    got = quote_threads.format_threads(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert {r.turn: r.reply_to for r in got if r.conv_id == 1} == {0: None, 1: None, 2: None, 3: 0, 4: 1, 5: 0, 6: 2, 7: None, 8: None}
    assert not any(r.reply_to is not None for r in got if r.conv_id == 2)


def test_a_block_links_to_the_message_that_says_all_of_it(spark):
    rows = [
        (1, 1, "user", "I think that the moon is bright tonight"), (1, 2, "assistant", "I think that the sun is hot today"), (1, 3, "user", "> I think that the moon is\nyes"),
        (2, 1, "user", "one two three four five six seven"), (2, 2, "user", "one two three four nine five six seven"), (2, 3, "user", "> one two three four\n> five six seven"),
        (3, 1, "user", "a long way to go home now"), (3, 2, "user", "home now a long way"), (3, 3, "user", "> a long way to go home"),
    ]
    got = quote_threads.format_threads(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert {r.conv_id: r.reply_to for r in got if r.turn == 3} == {1: 1, 2: 1, 3: 1}


def test_generated_chats_against_every_block_and_message(spark):
    """Random quotes (runs of words, other wrapping, deeper levels, changed words) against all earlier messages in SQL."""
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "so", "we", "go", "on"]
    rows = []
    for conv in range(14):
        said = []
        for turn in range(1, 9):
            lines = []
            if said and rng.random() < 0.7:
                for _ in range(rng.randrange(1, 3)):
                    source = rng.choice(said).split()
                    a = rng.randrange(len(source))
                    run = source[a : a + rng.randrange(1, 12)]
                    if rng.random() < 0.3:
                        run[rng.randrange(len(run))] = "changed"
                    width, marks = rng.randrange(1, 6), ">" * rng.randrange(1, 3)
                    lines += [f"{marks} {' '.join(run[i : i + width])}" for i in range(0, len(run), width)]
                    lines += [rng.choice(["", "I see"])]
            own = " ".join(rng.choices(words, k=rng.randrange(1, 14)))
            lines.append(own)
            said.append(own)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(lines)))
    rows += [(None, 1, "user", "> alpha beta gamma delta"), (0, None, "user", "> so we go on"), (99, 1, "user", None), (99, 2, "user", ">")]
    schema = "conv_id long, turn int, role string, text string"
    got = quote_threads.format_threads(spark.createDataFrame(rows, schema))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(quote_threads.ORACLE)
    names = [c[0] for c in cur.description]
    found = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(cur.fetchall(), key=repr)
    assert got.where("reply_to is not null").count() > 20
