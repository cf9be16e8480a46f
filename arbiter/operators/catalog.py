"""Schema catalog, lexical retrieval and token-budget policy.

Catalog tables:
  catalog_columns(db_id, table_name, table_ordinal, column_name, column_ordinal, type, description, table_description)
  catalog_fks(db_id, table_name, fk_ordinal, local_col, referred_table)
  samples(db_id, table_name, column_name, rank, value)

Retrieval scores every (question, table) of the question's db through an
inverted index: question tokens join table tokens on (db_id, token) and a
sum of weights per pair gives the score.  Selections (top-k, budgets, gates)
need no such pairs: ``operators/retrieval.py`` folds them from posting lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.operators.profile import least_values

# Fixed values.
DEFAULT_SAMPLE_VALUES = 5
MAX_SAMPLE_LEN = 40
DEFAULT_MAX_TABLES = 8
NAME_WEIGHT = 3
SAMPLE_WEIGHT = 1
CHARS_PER_TOKEN = 4
#: Questions that one task scores, more or less.
QUESTIONS_PER_TASK = 20_000
TOKEN_PATTERN = "[a-z0-9]+"
CAMEL_PATTERN = "(?<=[a-z])(?=[A-Z])"


def tokens(s: Column) -> Column:
    """Split camelCase, lowercase, alphanumeric runs, as a set (array_distinct)."""
    spaced = F.regexp_replace(s, CAMEL_PATTERN, " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(spaced, F.lit(""))), F.lit(TOKEN_PATTERN), 0))


def estimate_tokens(text: Column) -> Column:
    """ceil(len / 4); empty text is 0."""
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def catalog_from_frames(
    spark, db_id: str, frames: dict[str, DataFrame], table_descriptions: DataFrame | None = None, column_descriptions: DataFrame | None = None,
) -> DataFrame:
    """One row per column from the frames' schemas; tables in name order.

    ``table_descriptions`` (table_name, description) and ``column_descriptions``
    (column_key, description; keys ``table.column`` in lower case, as S10 merges
    them) are joined where given; an empty description is none.
    """
    rows = []
    for t_ord, name in enumerate(sorted(frames), start=1):
        for c_ord, f in enumerate(frames[name].schema.fields, start=1):
            rows.append((db_id, name, t_ord, f.name, c_ord, f.dataType.simpleString().upper()))
    found = spark.createDataFrame(rows, "db_id string, table_name string, table_ordinal int, column_name string, column_ordinal int, type string")
    none = F.lit(None).cast("string")
    given = lambda df, key, name: df.where(F.col("description") != "").select(F.col(key), F.col("description").alias(name))
    if column_descriptions is not None:
        key = F.concat_ws(".", F.lower("table_name"), F.lower("column_name"))
        found = found.withColumn("column_key", key).join(given(column_descriptions, "column_key", "description"), "column_key", "left").drop("column_key")
    else:
        found = found.withColumn("description", none)
    if table_descriptions is not None:
        return found.join(given(table_descriptions, "table_name", "table_description"), "table_name", "left")
    return found.withColumn("table_description", none)


def sample_values(db_id: str, frames: dict[str, DataFrame], limit: int = DEFAULT_SAMPLE_VALUES) -> DataFrame:
    """Up to ``limit`` distinct values per column, none over 40 chars, smallest first."""
    top = least_values(frames, limit, MAX_SAMPLE_LEN)
    return top.select(F.lit(db_id).alias("db_id"), "table_name", "column_name", F.col("rank").cast("int").alias("rank"), "value")


def table_tokens(catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """C4: (db_id, table_name, kind, token): name tokens (table, its description, its columns' names) and sample tokens."""
    names = catalog.select(
        "db_id", "table_name",
        F.explode(F.array_union(F.array_union(tokens(F.col("table_name")), tokens(F.col("column_name"))),
                                tokens(F.col("table_description")))).alias("token"),
    ).withColumn("kind", F.lit("name"))
    samp = samples.select("db_id", "table_name", F.explode(tokens(F.col("value"))).alias("token")).withColumn(
        "kind", F.lit("sample")
    )
    return names.unionByName(samp).distinct()


def spread(questions: DataFrame) -> DataFrame:
    """``questions`` dealt out by id, so that their tokens, many times as many rows, are made and grouped in even parts without another shuffle.

    The parts grow in number with the questions, which are counted for it, not in size.
    """
    width = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return questions.repartition(max(width, -(-questions.count() // QUESTIONS_PER_TASK)), "question_id")


def question_tokens(questions: DataFrame) -> DataFrame:
    return spread(questions).select("question_id", "db_id", F.explode(tokens(F.col("question"))).alias("token")).distinct()


def catalog_tables(catalog: DataFrame) -> DataFrame:
    return catalog.select("db_id", "table_name", "table_ordinal").distinct()


def score(questions: DataFrame, catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """Score of every (question, table of its db); zero when nothing matches.

    A question's tokens meet the tables that they stand for where it lies, and
    what they hit is one row, beside which the tables of its db are laid out.
    """
    weight = F.when(F.col("kind") == "name", F.lit(NAME_WEIGHT)).otherwise(F.lit(SAMPLE_WEIGHT))
    weighed = table_tokens(catalog, samples).groupBy("db_id", "token", "table_name").agg(F.sum(weight).alias("w"))
    held = weighed.groupBy("db_id", "token").agg(F.collect_list(F.struct("table_name", "w")).alias("held"))
    tables = catalog_tables(catalog).groupBy("db_id").agg(F.collect_list(F.struct("table_name", "table_ordinal")).alias("tables"))
    asked = spread(questions).select("question_id", "db_id", F.posexplode_outer(tokens(F.col("question"))).alias("pos", "token"))
    met = asked.join(F.broadcast(held), ["db_id", "token"], "left").where(F.col("held").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    # Rows of one id: each is scored, by the tokens of all.
    per_id = met.groupBy("question_id").agg(
        F.collect_list(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("db_id"))).alias("dbs"),
        F.collect_set(F.when(F.col("held").isNotNull(), F.struct("db_id", "token", "held"))).alias("hits"),
    ).withColumn("hits", F.expr("flatten(transform(hits, x -> x.held))"))
    rows = per_id.select("question_id", "hits", F.explode("dbs").alias("db_id")).join(F.broadcast(tables), "db_id")
    hit = F.expr("IF(question_id IS NULL, 0L, aggregate(filter(hits, x -> x.table_name = t.table_name), 0L, (a, x) -> a + x.w))")
    return rows.select("question_id", "db_id", "hits", F.explode("tables").alias("t")).select(
        "question_id", "db_id", "t.table_name", "t.table_ordinal", hit.alias("score"))


def ranked_names(scores: DataFrame) -> DataFrame:
    """Every table per question by score desc, ties by declaration order."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("table_ordinal"))
    return scores.withColumn("priority", F.row_number().over(w))


def widened_questions(attempts: DataFrame) -> DataFrame:
    """The query of a re-retrieval is the question and the name that was missing, if any.

    ``attempts``: (question_id, db_id, question, n_retries, missing).
    """
    return attempts.select("question_id", "db_id", F.concat_ws(" ", "question", "missing").alias("question"), "n_retries")


def widening_floor(n_retries: Column, max_tables: int = DEFAULT_MAX_TABLES) -> Column:
    """At the n-th re-retrieval at least ``max_tables * 2^n`` tables are shown."""
    return (F.lit(max_tables) * F.pow(F.lit(2), n_retries)).cast("int")


def render_blocks(catalog: DataFrame, fks: DataFrame, samples: DataFrame) -> DataFrame:
    """Prompt-ready text block per table (its description, columns with glosses, FK lines, samples) and C9 cost."""
    col_line = F.concat(
        F.when(F.col("description").isNotNull(), F.concat(F.lit("  -- "), F.col("description"), F.lit("\n"))).otherwise(F.lit("")),
        F.rtrim(F.concat(F.lit("  "), F.col("column_name"), F.lit(" "), F.col("type"))),
    )
    cols = catalog.groupBy("db_id", "table_name", "table_ordinal", "table_description").agg(
        F.array_sort(F.collect_list(F.struct(F.col("column_ordinal").cast("int").alias("k"), col_line.alias("line")))).alias("cl")
    )
    fk_lines = fks.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("fk_ordinal").cast("int").alias("k"),
            F.format_string("  FOREIGN KEY (%s) REFERENCES %s", F.col("local_col"), F.col("referred_table")).alias("line"),
        ))).alias("fl")
    )
    per_col = samples.groupBy("db_id", "table_name", "column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), ", ").alias("vals")
    ).join(catalog.select("db_id", "table_name", "column_name", "column_ordinal"), ["db_id", "table_name", "column_name"])
    samp_lines = per_col.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("column_ordinal").alias("k"),
            F.format_string("--   %s ∈ {%s}", F.col("column_name"), F.col("vals")).alias("line"),
        ))).alias("sl")
    )
    j = cols.join(fk_lines, ["db_id", "table_name"], "left").join(samp_lines, ["db_id", "table_name"], "left")
    lines = F.transform(F.concat(F.col("cl"), F.coalesce(F.col("fl"), F.array().cast("array<struct<k:int,line:string>>"))), lambda s: s["line"])
    about = F.when(F.col("table_description").isNotNull(), F.concat(F.lit("-- "), F.col("table_description"), F.lit("\n"))).otherwise(F.lit(""))
    block = F.concat(about, F.lit("CREATE TABLE "), F.col("table_name"), F.lit(" (\n"), F.array_join(lines, ",\n"), F.lit("\n);"))
    samples_txt = F.when(F.col("sl").isNotNull(), F.concat(F.lit("\n-- sample values:\n"), F.array_join(F.transform("sl", lambda s: s["line"]), "\n"))).otherwise(F.lit(""))
    text = F.concat(block, samples_txt)
    return j.select("db_id", "table_name", "table_ordinal", text.alias("block")).withColumn("cost", estimate_tokens(F.col("block")))


def budget_convergence(per_budget: DataFrame) -> DataFrame:
    """From (budget, divergence, ranked_accuracy, naive_accuracy): the least budget without divergence, and the budget of the largest accuracy gap."""
    gap = F.col("ranked_accuracy") - F.col("naive_accuracy")
    return per_budget.agg(
        F.min(F.when(F.col("divergence") == 0, F.col("budget"))).alias("convergence_budget"),
        F.max_by("budget", F.struct(gap, -F.col("budget"))).alias("peak_budget"),
        F.round(F.max(gap), 9).alias("peak_gap"),
    )


def link_tables(refs: DataFrame, catalog: DataFrame, fallback: DataFrame) -> DataFrame:
    """C17: union of the tables named across a question's variants, kept only when they are
    catalog tables (case-insensitive), in declaration order; no linked table -> the fallback selection.

    ``refs``: (question_id, db_id, variant, table_name) harvested references;
    ``fallback``: (question_id, table_name, table_ordinal), e.g. ``relevant_tables``.
    """
    tables = catalog_tables(catalog).select("db_id", F.lower("table_name").alias("_t"), "table_name", "table_ordinal")
    # Most references name no table: they are dropped before anything is de-duplicated.
    linked = (
        refs.select("question_id", "db_id", F.lower("table_name").alias("_t"))
        .join(F.broadcast(tables), ["db_id", "_t"]).distinct()
        .select("question_id", "table_name", "table_ordinal", F.lit("link").alias("source"))
    )
    missing = fallback.join(linked.select("question_id").distinct(), "question_id", "left_anti")
    return linked.unionByName(missing.select("question_id", "table_name", "table_ordinal", F.lit("fallback").alias("source")))
