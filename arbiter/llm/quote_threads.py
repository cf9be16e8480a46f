"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with ``>`` marks are quotes, nested as deep as they have marks;
a line that announces one ("On ... wrote:") goes with it.  Every quoted line,
the first-level quote as a whole and every block (lines of one level in a row)
is normalised (lower case, single blanks) and hashed, and joined to the latest
earlier message of the conversation that says the same in its own words: as a
line or as a whole, and a block also as a run of words, however its lines are
wrapped.  Runs are hashed from windows of a power of two of words, made by
doubling: the longest that fits at the start and the one at the end of the
block, at their distance, cover all its words and make one key.  So a block
links only to a message that says the whole of it.  A message is looked up by
the lengths of blocks that its conversation quotes.  A block that is too short for lines and
windows must be a whole message.  A message replies to the one that its
outermost matching quotes take most characters from.  Replies are followed to
the first message of their thread by pointer doubling, and the conversation is
returned message by message, thread after thread, each reply after the message
it answers, without the quotes.

The join to the latest earlier message is a sorted sweep dealt out by key range
(a range starts from what the ranges before it leave), and so are the positions
in the conversation: a conversation or a line of any size is never in one task.

Edge cases: a null text stays null, without quotes; an empty one stays empty; a
message of quotes only becomes empty; texts without quotes stay as they are;
messages without conversation or turn are never linked; repeated rows are one
message for linking and are all returned; messages of equal turn are never
linked with each other, and are ordered by role and text; an empty table stays
empty; further columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbiter.llm.common import BLANKS, shuffle_width, written

MARKS = r"^(?:[ \t]*>)+"
ANNOUNCE = r"(?i)^[ \t]*(?:on|am|le|el) .{1,200}(?:wrote|schrieb|a écrit|escribió)[^:\n]{0,80}:[ \t\r]*$"
#: Shorter normal lines say too little to link by; a shorter block must be a whole message.
MIN_CHARS = 8
#: Windows are of so many words at least, 2 to this power; a block of fewer words must be a line or a whole message.
MIN_POWER = 2
_BLANK = r"[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), _BLANK, " "))


def word_windows(body: Column) -> Column:
    """Array of (power, hashes): hashes of the windows of 2^power words of a normal text at each of its words, by doubling."""

    def twice(acc: Column, power: Column) -> Column:
        half = F.pow(F.lit(2), power - 1).cast("int")
        longer = F.transform(F.sequence(F.lit(0), F.size(acc["now"]) - 1 - half), lambda i: F.xxhash64(F.get(acc["now"], i), F.get(acc["now"], i + half)))
        return F.struct(longer.alias("now"), F.concat(acc["all"], F.array(F.struct(power.alias("power"), longer.alias("hashes")))).alias("all"))

    words = F.split(body, " ")
    none = F.array().cast("array<struct<power:int,hashes:array<bigint>>>")
    start = F.struct(F.transform(words, lambda w: F.xxhash64(w)).alias("now"), none.alias("all"))
    powers = F.sequence(F.lit(1), F.floor(F.log2(F.size(words))).cast("int"))
    found = F.aggregate(powers, start, twice, lambda acc: acc["all"])
    return F.when(F.size(words) > 1, F.filter(found, lambda x: x["power"] >= MIN_POWER)).otherwise(none)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(body: Column) -> Column:
    return F.size(F.split(body, " "))


def run_keys(body: Column, lengths: Column) -> Column:
    """Keys of every run of words of a normal text, for each of ``lengths`` (words, at least 2^MIN_POWER) that fits."""

    def of(windows: Column) -> Column:
        def runs(n: Column) -> Column:
            power = F.floor(F.log2(n)).cast("int")
            gap = n - F.pow(F.lit(2), power).cast("int")

            def keys(h: Column) -> Column:
                places = F.sequence(F.lit(0), F.size(h) - 1 - gap)
                return F.transform(places, lambda i: F.concat_ws(" ", n.cast("string"), F.xxhash64(F.get(h, i), F.get(h, i + gap)).cast("string")))

            return let(F.get(windows, power - MIN_POWER)["hashes"], keys)

        return F.flatten(F.transform(F.filter(lengths, lambda n: (n >= 2**MIN_POWER) & (n <= n_words(body))), runs))

    return let(word_windows(body), of)


def parsed(messages: DataFrame) -> DataFrame:
    """Adds mid (digest of the row), own (lines of its own), quotes (level, body), blocks (level, body) and content to (conv_id, turn, role, text)."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        return F.struct(F.length(F.translate(marks, " \t", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"), x.rlike(ANNOUNCE).alias("announces"))

    found = messages.withColumn("mid", F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text"))))
    found = found.withColumn("lines", F.when(F.col("text").rlike(r"(?m)^[ \t]*>"), F.transform(F.split("text", "\n", -1), line)))
    quoted = F.filter("lines", lambda x: x["level"] > 0)
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["announces"] & F.coalesce(F.get("lines", i + 1)["level"] > 0, F.lit(False))))
    found = found.withColumn("quotes", F.coalesce(quoted, F.array().cast("array<struct<level:int,body:string,announces:boolean>>")))
    level = lambda i: F.coalesce(F.get("lines", i)["level"], F.lit(0))
    place = F.sequence(F.lit(0), F.size("lines") - 1)
    first = F.filter(place, lambda i: (level(i) > 0) & ((i == 0) | (level(i - 1) != level(i))))
    last = F.filter(place, lambda i: (level(i) > 0) & (level(i + 1) != level(i)))
    body = lambda a, b: F.array_join(F.transform(F.slice("lines", a + 1, b - a + 1), lambda x: x["body"]), " ")
    blocks = F.zip_with(first, last, lambda a, b: F.struct(level(a).alias("level"), normal(body(a, b)).alias("body")))
    found = found.withColumn("blocks", F.when(F.col("lines").isNotNull(), blocks))
    found = found.withColumn("own", F.when(F.col("lines").isNotNull(), F.transform(own, lambda x: x["body"])))
    content = F.btrim(F.array_join("own", "\n"), F.lit(BLANKS))
    return found.withColumn("content", F.when(F.col("own").isNull(), F.col("text")).otherwise(content)).drop("lines")


def latest_before(events: DataFrame, order: list[str], slot: str) -> DataFrame:
    """``events`` with ``slot`` filled by its last value at or before each row in the order of all rows."""
    dealt = written(events.repartitionByRange(shuffle_width(events.sparkSession), *order).withColumn("part", F.spark_partition_id()), "sweep")
    ends = dealt.where(F.col(slot).isNotNull()).groupBy("part").agg(F.max_by(slot, F.struct(*order)).alias(slot))
    parts = dealt.select("part").distinct().join(ends, "part", "left")
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("part", F.last(slot, ignorenulls=True).over(earlier).alias("carried"))
    sweep = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return dealt.withColumn(slot, F.last(slot, ignorenulls=True).over(sweep)).join(carried, "part").withColumn(slot, F.coalesce(slot, "carried")).drop("part", "carried")


def whole_key(body: Column) -> Column:
    return F.concat(F.lit("whole "), body)


def reply_links(messages: DataFrame) -> DataFrame:
    """(mid, parent, parent_turn): the message that each quoting message answers; ``messages`` as from ``parsed``."""
    able = messages.where("conv_id is not null and turn is not null")
    quoting = able.where(F.size("quotes") > 0).select("conv_id", "turn", "mid", "quotes", "blocks")
    first_level = F.array_join(F.transform(F.filter("quotes", lambda x: x["level"] == 1), lambda x: x["body"]), " ")
    piece = lambda level, hashed, size: F.struct(level.alias("level"), hashed.alias("hash"), size.alias("size"))
    said_as = lambda level, body: piece(level, F.md5(body), F.length(body))
    lines = F.concat(F.transform("quotes", lambda x: said_as(x["level"], normal(x["body"]))), F.array(said_as(F.lit(1), normal(first_level))))
    blocks = F.transform("blocks", lambda x: said_as(x["level"], x["body"]))

    runs = F.filter("blocks", lambda x: n_words(x["body"]) >= 2**MIN_POWER)
    windows = F.transform(runs, lambda x: piece(x["level"], F.get(run_keys(x["body"], F.array(n_words(x["body"]))), F.lit(0)), F.length(x["body"])))
    short = F.transform(F.filter("blocks", lambda x: F.length(x["body"]).between(1, MIN_CHARS - 1)), lambda x: piece(x["level"], whole_key(x["body"]), F.length(x["body"])))
    long = F.filter(F.concat(lines, blocks, windows), lambda x: x["size"] >= MIN_CHARS)
    wanted = quoting.select("conv_id", "turn", "mid", F.explode(F.array_distinct(F.concat(long, short))).alias("p"))
    wanted = wanted.select(
        "conv_id", "p.hash", "turn", F.lit(0).alias("kind"), "mid", "p.level", "p.size", F.lit(None).cast("string").alias("source")
    )
    # Only conversations with quotes have originals to look for, and runs only of the lengths that are quoted.
    sizes = F.transform("blocks", lambda x: n_words(x["body"]))
    sizes = quoting.select("conv_id", F.explode(sizes).alias("length")).groupBy("conv_id").agg(F.collect_set("length").alias("lengths"))
    origin = able.join(sizes, "conv_id")
    said = F.transform(F.coalesce("own", F.split("text", "\n", -1)), normal)
    whole = normal(F.coalesce(F.array_join("own", " "), "text"))
    windows = run_keys(F.col("whole"), F.col("lengths"))
    lines = F.transform(F.filter(F.concat("said", F.array("whole")), lambda x: F.length(x) >= MIN_CHARS), lambda x: F.md5(x))
    short = F.when(F.length("whole").between(1, MIN_CHARS - 1), F.array(whole_key(F.col("whole")))).otherwise(F.array().cast("array<string>"))
    known = origin.where("text is not null").select("conv_id", "turn", "mid", "lengths", said.alias("said"), whole.alias("whole"))
    known = known.select("conv_id", "turn", "mid", F.explode(F.array_distinct(F.concat(lines, windows, short))).alias("hash"))
    # Of messages of one turn with the same words one is the source; quotes sort before it, so that a source is earlier.
    known = known.groupBy("conv_id", "hash", "turn").agg(F.min("mid").alias("source"))
    nothing = F.lit(None).cast("int")
    known = known.select("conv_id", "hash", "turn", F.lit(1).alias("kind"), F.col("source").alias("mid"), nothing.alias("level"), nothing.alias("size"), "source")
    slot = F.when(F.col("source").isNotNull(), F.struct("conv_id", "hash", "turn", "source"))
    events = wanted.unionByName(known).withColumn("slot", slot).drop("source")
    swept = latest_before(events, ["conv_id", "hash", "turn", "kind"], "slot")
    met = swept.where((F.col("kind") == 0) & (F.col("slot.conv_id") == F.col("conv_id")) & (F.col("slot.hash") == F.col("hash")) & (F.col("slot.turn") < F.col("turn")))
    votes = met.groupBy("mid", "level", F.col("slot.source").alias("parent"), F.col("slot.turn").alias("parent_turn")).agg(F.sum("size").alias("chars"))
    best = F.max_by(F.struct("parent", "parent_turn"), F.struct(-F.col("level"), "chars", "parent_turn", "parent"))
    return votes.groupBy("mid").agg(best.alias("b")).select("mid", "b.parent", "b.parent_turn")


def threads(links: DataFrame) -> DataFrame:
    """(mid, parent_turn, root_turn, depth) of every reply, by pointer doubling: the rounds grow with the logarithm of the depth."""
    known = written(links.select("mid", "parent_turn", F.col("parent").alias("top"), F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "threads")
    while True:
        up = known.select(F.col("mid").alias("top"), F.col("top").alias("next"), F.col("root_turn").alias("next_turn"), F.col("depth").alias("more"))
        joined = known.join(up, "top", "left")
        if joined.where("next is not null").isEmpty():
            return known.drop("top")
        known = written(
            joined.select(
                "mid", "parent_turn", F.coalesce("next", "top").alias("top"), F.coalesce("next_turn", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            "threads",
        )


def format_threads(messages: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, content, reply_to, thread, depth, n_quoted) per message, in reply order by position."""
    found = parsed(messages.select("conv_id", "turn", "role", "text"))
    replies = threads(written(reply_links(found).dropDuplicates(["mid"]), "reply-links"))
    placed = found.join(replies, "mid", "left").select(
        "conv_id", "turn", "role", "content", "text", F.col("parent_turn").alias("reply_to"), F.coalesce("root_turn", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.size("quotes").cast("long").alias("n_quoted"),
    )
    order = ["conv_id", "thread", "turn", "role", "text"]
    dealt = written(placed.repartitionByRange(shuffle_width(messages.sparkSession), *order).withColumn("part", F.spark_partition_id()), "chat-order")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order[1:]))
    placed = dealt.withColumn("rank", rank).join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return placed.select("conv_id", (F.col("offset") + F.col("rank")).cast("long").alias("position"), "turn", "role", "content", "reply_to", "thread", "depth", "n_quoted")


def op9_quote_threads(spark, sf_dir: str) -> DataFrame:
    return format_threads(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = rf"""
WITH RECURSIVE msgs AS (
  SELECT *, min(rid) OVER (PARTITION BY conv_id, turn, role, text) AS mid
  FROM (SELECT conv_id, turn, role, text, row_number() OVER () AS rid FROM conversations)),
lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM msgs),
levels AS (
  SELECT rid, i, line, length(replace(replace(regexp_extract(line, '{MARKS}'), ' ', ''), chr(9), '')) AS level,
    regexp_replace(line, '{MARKS}', '') AS body, regexp_matches(line, '{ANNOUNCE}') AS announces
  FROM lines),
kinds AS (
  SELECT *, level = 0 AND NOT (announces AND coalesce(lead(level) OVER (PARTITION BY rid ORDER BY i) > 0, FALSE)) AS own FROM levels),
contents AS (
  SELECT rid, sum((level > 0)::INT) AS n_quoted, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (own), '') AS said,
    coalesce(string_agg(body, ' ' ORDER BY i) FILTER (own), '') AS whole,
    coalesce(string_agg(body, ' ' ORDER BY i) FILTER (level = 1), '') AS quoted
  FROM kinds GROUP BY rid),
blocks AS (
  SELECT rid, level, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '{_BLANK}', ' ', 'g')) AS body
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, level ORDER BY i) AS island FROM kinds WHERE level > 0) GROUP BY rid, level, island),
pieces AS (
  SELECT DISTINCT m.conv_id, m.turn, m.mid, p.level, p.body, p.how FROM msgs m JOIN (
    SELECT rid, level, trim(regexp_replace(lower(body), '{_BLANK}', ' ', 'g')) AS body, 'same' AS how FROM kinds WHERE level > 0
    UNION ALL SELECT rid, 1, trim(regexp_replace(lower(quoted), '{_BLANK}', ' ', 'g')), 'same' FROM contents WHERE n_quoted > 0
    UNION ALL SELECT rid, level, body, 'same' FROM blocks
    UNION ALL SELECT rid, level, body, 'run' FROM blocks WHERE len(string_split(body, ' ')) >= {2**MIN_POWER}
    UNION ALL SELECT rid, level, body, 'short' FROM blocks) p USING (rid)
  WHERE CASE WHEN p.how = 'short' THEN length(p.body) BETWEEN 1 AND {MIN_CHARS - 1} ELSE length(p.body) >= {MIN_CHARS} END),
known AS (
  SELECT conv_id, turn, body, is_whole, min(mid) AS mid FROM msgs JOIN (
    SELECT rid, trim(regexp_replace(lower(body), '{_BLANK}', ' ', 'g')) AS body, FALSE AS is_whole FROM kinds WHERE own
    UNION ALL SELECT rid, trim(regexp_replace(lower(whole), '{_BLANK}', ' ', 'g')), TRUE FROM contents) USING (rid)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn, body, is_whole),
met AS (
  SELECT p.mid, p.level, length(p.body) AS size, k.mid AS parent, k.turn AS parent_turn,
    row_number() OVER (PARTITION BY p.mid, p.level, p.body, p.how ORDER BY k.turn DESC, k.mid) AS r
  FROM pieces p JOIN known k ON p.conv_id = k.conv_id AND k.turn < p.turn AND CASE p.how WHEN 'same' THEN p.body = k.body
    WHEN 'short' THEN k.is_whole AND p.body = k.body ELSE k.is_whole AND contains(' ' || k.body || ' ', ' ' || p.body || ' ') END),
votes AS (SELECT mid, level, parent, parent_turn, sum(size) AS chars FROM met WHERE r = 1 GROUP BY ALL),
links AS (
  SELECT mid, parent, parent_turn FROM (
    SELECT *, row_number() OVER (PARTITION BY mid ORDER BY level, chars DESC, parent_turn DESC, parent DESC) AS r FROM votes) WHERE r = 1),
climb AS (
  SELECT mid, parent, parent_turn AS root_turn, 1 AS depth FROM links
  UNION ALL SELECT c.mid, l.parent, l.parent_turn, c.depth + 1 FROM climb c JOIN links l ON c.parent = l.mid),
tops AS (SELECT mid, max(depth) AS depth, arg_max(root_turn, depth) AS root_turn FROM climb GROUP BY mid),
placed AS (
  SELECT m.*, CASE WHEN coalesce(c.n_quoted, 0) = 0 THEN m.text ELSE trim(c.said, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS content,
    l.parent_turn AS reply_to, coalesce(t.root_turn, m.turn) AS thread, coalesce(t.depth, 0)::BIGINT AS depth, coalesce(c.n_quoted, 0)::BIGINT AS n_quoted
  FROM msgs m LEFT JOIN contents c USING (rid) LEFT JOIN links l USING (mid) LEFT JOIN tops t USING (mid))
SELECT conv_id, turn, role, content, reply_to, thread, depth, n_quoted,
  row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position
FROM placed
"""
