"""Table selection from posting lists: top-k, budgets and gates as folds over one array per question.

A database's schema is one row (its tables in declaration order: name, cost,
length, tables referred to), and its inverted index one posting list per token.
Questions are dealt out by id once; where they lie, their tokens meet the
posting lists and the tables that they hit are gathered.  Tables without a hit appear only as numbers inside an
expression, where a floor pads or a budget reaches beyond the hits: no rows of
questions x tables are built.

* top-k (C6), widening (C12): hits by score, then their referred tables, then
  padding in declaration order.
* budgets (C10, C14-C16): one fold over the costs in priority order keeps a
  running sum and a count per budget; the sum only grows, so a count is the
  length of the prefix that fits.  All budgets come from the same fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.operators.catalog import CHARS_PER_TOKEN, DEFAULT_MAX_TABLES, NAME_WEIGHT, SAMPLE_WEIGHT, catalog_tables, spread, table_tokens, tokens

_ALL = "transform(tables, t -> t.ord)"


def posting_lists(catalog: DataFrame, samples: DataFrame) -> DataFrame:
    """(db_id, token, postings): per token the tables (their ordinal) that it stands for, with its weight."""
    weight = F.when(F.col("kind") == "name", F.lit(NAME_WEIGHT)).otherwise(F.lit(SAMPLE_WEIGHT))
    held = table_tokens(catalog, samples).join(catalog_tables(catalog), ["db_id", "table_name"])
    weighed = held.groupBy("db_id", "token", F.col("table_ordinal").alias("ord")).agg(F.sum(weight).alias("w"))
    return weighed.groupBy("db_id", "token").agg(F.collect_list(F.struct("ord", "w")).alias("postings"))


def schemas(catalog: DataFrame, fks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(db_id, tables): a database's tables in declaration order, numbered from 1: (ord, name, cost, len, refs)."""
    listed = catalog_tables(catalog)
    named = listed.select("db_id", F.col("table_name").alias("referred_table"), F.col("table_ordinal").alias("to"))
    refs = fks.join(named, ["db_id", "referred_table"]).groupBy("db_id", "table_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fk_ordinal", "to"))), lambda x: x["to"]).alias("refs"))
    sized = blocks.select("db_id", "table_name", "cost", F.length("block").cast("long").alias("len"))
    rows = listed.join(sized, ["db_id", "table_name"]).join(refs, ["db_id", "table_name"], "left")
    table = F.struct(F.col("table_ordinal").alias("ord"), F.col("table_name").alias("name"), "cost", "len", F.coalesce("refs", F.array().cast("array<int>")).alias("refs"))
    return rows.groupBy("db_id").agg(F.array_sort(F.collect_list(table)).alias("tables"))


def question_hits(questions: DataFrame, postings: DataFrame, schema: DataFrame) -> DataFrame:
    """(question_id, db_id, tokens, hits, tables): the tables (ord, score > 0) that a question's tokens hit, and its schema."""
    asked = spread(questions).select("question_id", "db_id", F.explode_outer(tokens(F.col("question"))).alias("token"))
    met = asked.join(postings, ["db_id", "token"], "left").groupBy("question_id", "db_id").agg(
        F.collect_set("token").alias("tokens"), F.flatten(F.collect_list("postings")).alias("p"))
    hits = F.expr("transform(array_distinct(transform(p, x -> x.ord)), o -> struct(o AS ord, aggregate(filter(p, x -> x.ord = o), 0L, (a, x) -> a + x.w) AS score))")
    return met.select("question_id", "db_id", "tokens", hits.alias("hits")).join(schema, "db_id")


def _selected(hit: DataFrame, max_tables: int, expand_fks: bool, floor: Column | int) -> DataFrame:
    """``hit`` with ``chosen``: the ordinals that C6 selects."""
    q = hit.withColumn("floor", floor if isinstance(floor, Column) else F.lit(floor))
    q = q.withColumn("picks", F.expr(f"transform(slice(array_sort(transform(hits, h -> struct(-h.score AS neg, tables[h.ord - 1].name AS name, h.ord AS ord))), 1, {max_tables}), x -> x.ord)"))
    referred = "flatten(transform(picks, o -> tables[o - 1].refs))" if expand_fks else "CAST(array() AS array<int>)"
    q = q.withColumn("sel", F.expr(f"slice(concat(picks, array_except({referred}, picks)), 1, {max_tables})"))
    padded = f"concat(sel, slice(array_except({_ALL}, sel), 1, greatest(floor - size(sel), 0)))"
    return q.withColumn("chosen", F.expr(f"CASE WHEN size(picks) = 0 AND floor <= 0 THEN {_ALL} ELSE {padded} END"))


def relevant_tables(hit: DataFrame, max_tables: int = DEFAULT_MAX_TABLES, expand_fks: bool = True, floor: Column | int = 0) -> DataFrame:
    """(question_id, table_name, table_ordinal) selected for each question.

    Top ``max_tables`` with score > 0 (ties by name), then the tables that the
    picks refer to in pick order, cut to ``max_tables``, then padded to
    ``floor`` in declaration order.  No hit and floor <= 0: every table.
    """
    return _named(_selected(hit, max_tables, expand_fks, floor), "chosen")


def _named(q: DataFrame, ordinals: str) -> DataFrame:
    out = q.select("question_id", "tables", F.explode(ordinals).alias("o"))
    return out.select("question_id", F.expr("tables[o - 1].name").alias("table_name"), F.col("o").alias("table_ordinal"))


def prioritized(hit: DataFrame) -> DataFrame:
    """``hit`` with ``ordered``: every table's ordinal by score desc, ties and tables without a hit in declaration order."""
    ranked = "transform(array_sort(transform(hits, h -> struct(-h.score AS neg, h.ord AS ord))), x -> x.ord)"
    return hit.withColumn("ranked", F.expr(ranked)).withColumn("ordered", F.expr(f"concat(ranked, array_except({_ALL}, ranked))")).drop("ranked")


def _prefixes(order: str, budgets: Sequence[int]) -> Column:
    """Per budget the number of tables whose running cost fits; the first is always kept."""
    start = ", ".join(f"0 AS c{i}" for i in range(len(budgets)))
    cost = "a.s + tables[o - 1].cost"
    step = ", ".join(f"a.c{i} + IF({cost} <= {int(b)}, 1, 0) AS c{i}" for i, b in enumerate(budgets))
    counts = ", ".join(f"greatest(a.c{i}, least(1, size({order})))" for i in range(len(budgets)))
    return F.expr(f"aggregate({order}, struct(0L AS s, {start}), (a, o) -> struct({cost} AS s, {step}), a -> array({counts}))")


def _rendered(ordinals: str) -> Column:
    """C9 of the blocks of these tables joined by a blank line, from their lengths alone."""
    return F.expr(f"CAST(ceil((aggregate({ordinals}, 0L, (a, o) -> a + tables[o - 1].len) + 2 * (size({ordinals}) - 1)) / {CHARS_PER_TOKEN}) AS BIGINT)")


def fit_budget(hit: DataFrame, budget: int) -> DataFrame:
    """(question_id, table_name, table_ordinal) of the priority prefix within the budget."""
    q = prioritized(hit).withColumn("kept", _prefixes("ordered", [budget]))
    return _named(q.withColumn("fitting", F.expr("slice(ordered, 1, kept[0])")), "fitting")


def gated(hit: DataFrame, budget: int) -> DataFrame:
    """C11: (question_id, mode, n_tables, tokens, ...): the question's own whole schema when it fits the budget, else ranked and fitted."""
    q = prioritized(hit).withColumn("all_tokens", _rendered(_ALL)).withColumn("kept", _prefixes("ordered", [budget]))
    q = q.withColumn("fitting", F.expr("slice(ordered, 1, kept[0])")).withColumn("fitted_tokens", _rendered("fitting"))
    fits = F.col("all_tokens") <= budget
    return q.select(
        "*", F.when(fits, F.lit("full")).otherwise(F.lit("rag")).alias("mode"),
        F.when(fits, F.size("tables")).otherwise(F.size("fitting")).cast("long").alias("n_tables"),
        F.when(fits, F.col("all_tokens")).otherwise(F.col("fitted_tokens")).alias("gate_tokens"),
    )


def gate(hit: DataFrame, budget: int) -> DataFrame:
    return gated(hit, budget).select("question_id", "mode", "n_tables", F.col("gate_tokens").alias("tokens"))


def footprint(hit: DataFrame, budget: int, max_tables: int = DEFAULT_MAX_TABLES) -> DataFrame:
    """C14: (mode, mean_tokens, max_tokens, total_tokens) of the whole schema, of always retrieving (C6) and of the gate."""
    q = _selected(gated(hit, budget), max_tables, True, 0).withColumn("always_tokens", _rendered("chosen"))
    modes = {"naive": "all_tokens", "always": "always_tokens", "adaptive": "gate_tokens"}
    total = q.agg(*(f(c).alias(f"{m}_{n}") for m, c in modes.items() for n, f in (("mean", F.avg), ("max", F.max), ("sum", F.sum))), F.count(F.lit(1)).alias("n"))
    rows = [F.struct(F.lit(m).alias("mode"), F.bround(F.col(f"{m}_mean"), 0).cast("long").alias("mean_tokens"), F.col(f"{m}_max").alias("max_tokens"),
                     F.col(f"{m}_sum").cast("long").alias("total_tokens")) for m in modes]
    return total.where("n > 0").select(F.inline(F.array(*rows)))


def budget_report(hit: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """(budget, divergence, ranked_accuracy, naive_accuracy).

    Divergence is the share of questions whose ranked selection is not the
    prefix in declaration order.  A question is answered when the tables it
    names are all in its selection; questions that name none are not judged.
    """
    gold = "transform(filter(tables, t -> array_contains(tokens, lower(t.name))), t -> t.ord)"
    q = prioritized(hit).withColumn("gold", F.expr(gold)).withColumn("r", _prefixes("ordered", budgets)).withColumn("n", _prefixes(_ALL, budgets))
    judged = F.size("gold") > 0
    sums = [F.count(F.lit(1)).alias("questions"), F.count_if(judged).alias("judged")]
    for i in range(len(budgets)):
        picked = f"slice(ordered, 1, r[{i}])"
        sums += [
            F.count_if(F.expr(f"r[{i}] <> n[{i}] OR array_max({picked}) > n[{i}]")).alias(f"differ_{i}"),
            F.count_if(judged & F.expr(f"size(array_intersect(gold, {picked})) = size(gold)")).alias(f"ranked_{i}"),
            F.count_if(judged & F.expr(f"array_max(gold) <= n[{i}]")).alias(f"naive_{i}"),
        ]
    share = lambda c: F.coalesce(F.col(c) / F.when(F.col("judged") > 0, F.col("judged")), F.lit(0.0))
    rows = [F.struct(F.lit(b).alias("budget"), (F.col(f"differ_{i}") / F.col("questions")).alias("divergence"), share(f"ranked_{i}").alias("ranked_accuracy"),
                     share(f"naive_{i}").alias("naive_accuracy")) for i, b in enumerate(budgets)]
    return q.agg(*sums).where("questions > 0").select(F.inline(F.array(*rows)))
