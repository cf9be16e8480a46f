"""Result-set comparison (the central operator family).

A batch of result sets is a long table: one row per result row, keyed by
``question_id`` with its position ``row_pos`` (1..n, the order the query
returned) and the typed value columns.  Gold and candidate sides are
canonicalized by an ordered list of named rules, then compared for all
questions at once:

    union(gold, cand) --groupBy(question_id, row_pos|NULL, cells)--> side counts
                      --groupBy(question_id)--> mismatch flag, row counts

The first exchange is keyed by the whole canonical row, which spreads a huge
question over many tasks; the second is a partial aggregate over booleans and
counts.  Order-free comparison nulls ``row_pos`` so the same aggregation
compares multisets.  No step collects a result set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.functions.cells import cell_text, comparable_cells, is_cells, number_text, rounded, tagged
from arbiter.operators.order import dense_position
from arbiter.session import stable

# Reasons and rule presets (fixed values).
REASON_EMPTY = "both result sets empty"
REASON_MATCH = "result sets match"
REASON_DIFFER = "result sets differ"

DEFAULT_RULES: tuple[str, ...] = (
    "column_position",
    "null_sentinel",
    "float_tolerance",
    "order_insensitive",
    "exact",
)
LENIENT_RULES: tuple[str, ...] = ("column_position", "set", "exact")


@dataclass(frozen=True)
class Side:
    """One side of a comparison: the frame plus which columns hold values."""

    df: DataFrame
    values: tuple[str, ...]
    dedupe: bool = False


Rule = Callable[[Side], Side]
_RULES: dict[str, Rule] = {}


def register_rule(name: str) -> Callable[[Rule], Rule]:
    """Register a named canonicalization rule (a Side -> Side transform)."""

    def deco(fn: Rule) -> Rule:
        _RULES[name] = fn
        return fn

    return deco


def rule_names() -> list[str]:
    return list(_RULES)


@register_rule("exact")
def _exact(side: Side) -> Side:
    """Identity: names the final equality."""
    return side


@register_rule("column_position")
def _column_position(side: Side) -> Side:
    """Drop labels: value columns become _c0.._cN, matched by position."""
    df = side.df
    renamed = tuple(f"_c{i}" for i in range(len(side.values)))
    for old, new in zip(side.values, renamed, strict=True):
        if old != new:
            df = df.withColumnRenamed(old, new)
    return Side(df, renamed, side.dedupe)


@register_rule("null_sentinel")
def _null_sentinel(side: Side) -> Side:
    """All NULLs equal each other and nothing else: grouping on typed cells does so, and text cells tag NULL."""
    return side


@register_rule("float_tolerance")
def _float_tolerance(side: Side) -> Side:
    """Round float/double/decimal cells half-even to 6 places, also inside arrays; others untouched."""
    types = {f.name: f.dataType for f in side.df.schema.fields}
    df = side.df
    for c in side.values:
        df = df.withColumn(c, rounded(F.col(c), types[c]))
    return Side(df, side.values, side.dedupe)


@register_rule("order_insensitive")
def _order_insensitive(side: Side) -> Side:
    """Forget row order unless the gold declares it significant."""
    df = side.df.withColumn(
        "row_pos", F.when(F.coalesce(F.col("order_significant"), F.lit(False)), F.col("row_pos"))
    )
    return Side(df, side.values, side.dedupe)


@register_rule("set")
def _set(side: Side) -> Side:
    """Duplicates collapse and order is ignored (always)."""
    return Side(side.df.withColumn("row_pos", F.lit(None).cast("long")), side.values, True)


def apply_rules(side: Side, rules: Sequence[str]) -> Side:
    for name in rules:
        try:
            rule = _RULES[name]
        except KeyError:
            raise ValueError(f"unknown canonicalization rule: {name!r}") from None
        side = rule(side)
    return side


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, _INTEGRAL):
        return "long"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "double"
    return dt.simpleString()


def _numeric(kind: str) -> bool:
    return kind in ("long", "double") or kind.startswith("decimal")


def _unify(a: str, b: str) -> str:
    """Common comparison type of one position: numbers of different types compare by exact value, else same type or text."""
    if a == b:
        return a
    if _numeric(a) and _numeric(b):
        return "number"
    return "text"


def _cells(side: Side, targets: Sequence[str] | None = None) -> DataFrame:
    """(question_id, row_pos, cells, dedupe) with ``cells`` a typed struct (``f0..fn``).

    Grouping on typed values keeps NULL equal only to NULL and avoids
    formatting every cell; a position whose sides disagree in type compares
    as canonical text (numbers printed so that 1 and 1.0 agree).
    """
    return side.df.select(
        "question_id",
        F.col("row_pos").cast("long").alias("row_pos"),
        _cell_struct(side, targets).alias("cells"),
        F.lit(side.dedupe).alias("dedupe"),
    )


def _cell_struct(side: Side, targets: Sequence[str] | None = None) -> Column:
    types = {f.name: f.dataType for f in side.df.schema.fields}
    targets = list(targets) if targets is not None else [_kind(types[c]) for c in side.values]
    fields = []
    for i, (c, target) in enumerate(zip(side.values, targets, strict=True)):
        col = F.col(c)
        if is_cells(types[c]):
            e = comparable_cells(col)
        elif target == "number":
            e = number_text(col, types[c])
        elif target == "text":
            # Values of different kinds never compare equal ('1' is not 1); NULL stays NULL.
            kind = "num" if _numeric(_kind(types[c])) else _kind(types[c])
            e = F.concat(F.lit(kind + ":"), cell_text(col, types[c], float_tolerance=False))
        elif target in ("long", "double"):
            e = col.cast(target)
        else:
            e = col
        fields.append(e.alias(f"f{i}"))
    return F.struct(*fields)


def _text_cells(side: Side) -> DataFrame:
    """Fallback for sides of different width: cells as an array of tagged canonical text."""
    types = {f.name: f.dataType for f in side.df.schema.fields}
    texts = [tagged(cell_text(F.col(c), types[c], float_tolerance=False)) for c in side.values]
    return side.df.select(
        "question_id", F.col("row_pos").cast("long").alias("row_pos"), F.array(*texts).alias("cells"),
        F.lit(side.dedupe).alias("dedupe"),
    )


def _prepare(
    df: DataFrame,
    values: Sequence[str] | None,
    questions: DataFrame | None,
    question_col: str,
    pos_col: str,
    needs_order_flag: bool,
    order_flag: bool | None = None,
) -> Side:
    values = tuple(values) if values is not None else tuple(c for c in df.columns if c not in (question_col, pos_col))
    out = df.select(
        F.col(question_col).alias("question_id"),
        F.col(pos_col).alias("row_pos") if pos_col in df.columns else F.lit(None).cast("long").alias("row_pos"),
        *[F.col(c) for c in values],
    )
    if needs_order_flag:
        if order_flag is not None:  # one flag for every question: no join
            out = out.withColumn("order_significant", F.lit(order_flag))
        elif questions is not None and "order_significant" in questions.columns:
            # One row per question: AQE broadcasts it when its runtime size is
            # small and falls back to a skew-aware sort-merge join otherwise.
            flags = questions.select(
                F.col("question_id"), F.col("order_significant").cast("boolean").alias("order_significant")
            )
            out = out.join(flags, "question_id", "left")
        else:
            out = out.withColumn("order_significant", F.lit(False))
    return Side(out, values)


def _per_row(g: Side, c: Side) -> DataFrame:
    """(question_id, row_pos, cells, ng, nc, dedupe): side counts per canonical row."""
    if len(g.values) == len(c.values):
        gt = {f.name: f.dataType for f in g.df.schema.fields}
        ct = {f.name: f.dataType for f in c.df.schema.fields}
        targets = [_unify(_kind(gt[a]), _kind(ct[b])) for a, b in zip(g.values, c.values, strict=True)]
        gc, cc = _cells(g, targets), _cells(c, targets)
    else:  # different widths never match; compare as text arrays of different sizes
        gc, cc = _text_cells(g), _text_cells(c)
    long = gc.withColumn("side_g", F.lit(1)).withColumn("side_c", F.lit(0)).unionByName(
        cc.withColumn("side_g", F.lit(0)).withColumn("side_c", F.lit(1))
    )
    return long.groupBy("question_id", "row_pos", "cells").agg(
        F.sum("side_g").alias("ng"), F.sum("side_c").alias("nc"), F.max("dedupe").alias("dedupe")
    )


def _mismatch():
    """Per canonical row: presence differs (set rule) or counts differ (multiset/ordered)."""
    return F.when(F.col("dedupe"), (F.col("ng") > 0) != (F.col("nc") > 0)).otherwise(F.col("ng") != F.col("nc"))


def _verdict_columns(rules: Sequence[str]) -> list:
    correct = ~F.coalesce(F.col("_mis"), F.lit(False))
    return [
        correct.alias("correct"),
        F.when(correct & (F.coalesce(F.col("n_gold_rows"), F.lit(0)) == 0), F.lit(REASON_EMPTY))
        .when(correct, F.lit(REASON_MATCH))
        .otherwise(F.lit(REASON_DIFFER))
        .alias("reason"),
        F.lit(",".join(rules)).alias("applied_rules"),
        F.coalesce(F.col("n_gold_rows"), F.lit(0)).cast("long").alias("n_gold_rows"),
        F.coalesce(F.col("n_cand_rows"), F.lit(0)).cast("long").alias("n_cand_rows"),
    ]


def compare_results(
    gold: DataFrame,
    cand: DataFrame,
    questions: DataFrame,
    rules: Sequence[str] = DEFAULT_RULES,
    *,
    gold_values: Sequence[str] | None = None,
    cand_values: Sequence[str] | None = None,
    question_col: str = "question_id",
    pos_col: str = "row_pos",
) -> DataFrame:
    """Verdict per question: question_id, correct, reason, applied_rules, row counts.

    ``questions`` lists the questions to score (``question_id`` plus an optional
    ``order_significant`` flag); a question with no rows on either side is
    "both result sets empty" and correct.  Two non-empty results of different
    width differ (their cell arrays differ in size).
    """
    rules = tuple(rules)
    for name in rules:
        if name not in _RULES:
            raise ValueError(f"unknown canonicalization rule: {name!r}")
    needs_flag = "order_insensitive" in rules
    g = apply_rules(_prepare(gold, gold_values, questions, question_col, pos_col, needs_flag), rules)
    c = apply_rules(_prepare(cand, cand_values, questions, question_col, pos_col, needs_flag), rules)
    per_q = _per_row(g, c).groupBy("question_id").agg(
        F.max(_mismatch()).alias("_mis"), F.sum("ng").alias("n_gold_rows"), F.sum("nc").alias("n_cand_rows")
    )
    return questions.select("question_id").join(per_q, "question_id", "left").select("question_id", *_verdict_columns(rules))


def compare_strict_and_lenient(
    gold: DataFrame, cand: DataFrame, questions: DataFrame, *, gold_values: Sequence[str] | None = None, cand_values: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(strict, lenient): the verdicts under DEFAULT_RULES and LENIENT_RULES (R11) from one shuffle of the rows.

    A row carries its cells as they are and rounded.  Equal cells stay equal
    when rounded, so rows dealt by (question, rounded cells) meet for both:
    the strict counts go by position and rounded cells, the lenient presence
    by the cells as they are.  Both read the same exchange.
    """
    given = [_prepare(df, values, questions, "question_id", "row_pos", True) for df, values in ((gold, gold_values), (cand, cand_values))]
    if len(given[0].values) != len(given[1].values):
        return tuple(compare_results(gold, cand, questions, rules, gold_values=gold_values, cand_values=cand_values) for rules in (DEFAULT_RULES, LENIENT_RULES))
    kinds = [{f.name: _kind(f.dataType) for f in g.df.schema.fields} for g in given]
    targets = [_unify(kinds[0][a], kinds[1][b]) for a, b in zip(given[0].values, given[1].values, strict=True)]
    parts = []
    for n, side in enumerate(given):
        raw = side.df.withColumn("raw", _cell_struct(side, targets))
        rounded_side = apply_rules(Side(raw, side.values), DEFAULT_RULES)
        rows = rounded_side.df.select("question_id", F.col("row_pos").cast("long").alias("row_pos"), _cell_struct(rounded_side, targets).alias("cells"), "raw")
        parts.append(rows.withColumn("g", F.lit(1 - n)).withColumn("c", F.lit(n)))
    both = lambda df, *keys: df.groupBy("question_id", *keys).agg(F.sum("g").alias("g"), F.sum("c").alias("c"))
    counted = both(parts[0].unionByName(parts[1]).repartition("question_id", "cells"), "cells", "row_pos", "raw")
    strict = both(counted, "cells", "row_pos").groupBy("question_id").agg(F.max(F.col("g") != F.col("c")).alias("s"), F.sum("g").alias("n_gold_rows"), F.sum("c").alias("n_cand_rows"))
    lenient = both(counted, "cells", "raw").groupBy("question_id").agg(F.max((F.col("g") > 0) != (F.col("c") > 0)).alias("l"))
    verdicts = stable(questions.select("question_id").join(strict, "question_id", "left").join(lenient, "question_id", "left"))
    return tuple(verdicts.withColumn("_mis", F.col(kind)).select("question_id", *_verdict_columns(rules)) for kind, rules in (("s", DEFAULT_RULES), ("l", LENIENT_RULES)))


def compare_frames(
    gold: DataFrame,
    cand: DataFrame,
    rules: Sequence[str] = DEFAULT_RULES,
    *,
    order_significant: bool = False,
    gold_order: Sequence[str] | None = None,
    cand_order: Sequence[str] | None = None,
) -> DataFrame:
    """Pairwise compare of two whole DataFrames (R8): one verdict row.

    Labels never matter (values match by position).  When order is
    significant, ``gold_order``/``cand_order`` give each side's ORDER BY and
    rows are positioned by a distributed range sort.
    """
    def positioned(df: DataFrame, order: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
        values = [f"_v{i}" for i in range(len(df.columns))]
        renamed = df.toDF(*values)
        if order_significant and order:
            idx = [values[df.columns.index(o)] for o in order]
            renamed = dense_position(renamed, [], idx + [v for v in values if v not in idx])
        else:
            renamed = renamed.withColumn("row_pos", F.lit(None).cast("long"))
        return renamed.withColumn("question_id", F.lit(0).cast("long")), values

    g, gv = positioned(gold, gold_order)
    c, cv = positioned(cand, cand_order)
    rules = tuple(rules)
    for name in rules:
        if name not in _RULES:
            raise ValueError(f"unknown canonicalization rule: {name!r}")
    needs_flag = "order_insensitive" in rules
    gs = apply_rules(_prepare(g, gv, None, "question_id", "row_pos", needs_flag, order_significant), rules)
    cs = apply_rules(_prepare(c, cv, None, "question_id", "row_pos", needs_flag, order_significant), rules)
    # A global aggregate always yields exactly one row, also for two empty inputs.
    agg = _per_row(gs, cs).agg(
        F.max(_mismatch()).alias("_mis"), F.sum("ng").alias("n_gold_rows"), F.sum("nc").alias("n_cand_rows")
    )
    return agg.select(*_verdict_columns(rules))


def rescore(strict: DataFrame, lenient: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Re-judge strict failures under lenient rules.

    ``scored`` (question_id, executable) marks runs that produced a result; an
    unexecutable run is wrong under both.  A strict failure that passes lenient
    is a scorer artifact; one that fails both is genuine.
    """
    s = strict.select("question_id", F.col("correct").alias("strict_correct"))
    lz = lenient.select("question_id", F.col("correct").alias("lenient_correct"))
    out = s.join(lz, "question_id", "full_outer")
    if scored is not None:
        out = out.join(scored.select("question_id", "executable"), "question_id", "left").withColumn(
            "lenient_correct", F.col("lenient_correct") & F.coalesce(F.col("executable"), F.lit(True))
        ).withColumn("strict_correct", F.col("strict_correct") & F.coalesce(F.col("executable"), F.lit(True)))
    return out.select(
        "question_id",
        "strict_correct",
        "lenient_correct",
        F.when(F.col("strict_correct"), F.lit("correct"))
        .when(F.col("lenient_correct"), F.lit("scorer_artifact"))
        .otherwise(F.lit("genuine"))
        .alias("rescore_class"),
    )


def verify_gold(
    expected: DataFrame,
    actual: DataFrame,
    questions: DataFrame,
    expected_labels: Sequence[str],
    actual_labels: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Gold verification (R12): labels and ordered rows must equal the stored gold.

    Numbers compare by exact value whatever their types, so whole decimals
    equal integers; labels come from the two schemas.
    """
    rows = compare_results(expected, actual, questions, ("column_position", "exact"), gold_values=values, cand_values=values)
    labels_ok = list(expected_labels) == list(actual_labels)
    return rows.select(
        "question_id",
        F.lit(labels_ok).alias("labels_match"),
        F.col("correct").alias("rows_match"),
        (F.lit(labels_ok) & F.col("correct")).alias("verified"),
    )


def score_runs(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per run, the question's verdict when the run produced a result; NULL when it
    errored or was rejected (never scored), plus its terminal state."""
    from arbiter.operators.runs import terminal_state

    j = runs.join(verdicts.select("question_id", F.col("correct").alias("_v"), F.col("reason").alias("_r")), "question_id", "left")
    scored = ~F.coalesce(F.col("guard_rejected"), F.lit(False)) & F.col("error").isNull()
    correct = F.when(scored, F.coalesce(F.col("_v"), F.lit(False)))
    return j.select(
        "case_id", "question_id", correct.alias("correct"), F.when(scored, F.col("_r")).alias("reason"),
        terminal_state(F.col("guard_rejected"), F.col("error"), F.col("attempts"), correct).alias("terminal_state"),
    )
