"""profile_*: column profiles of the test-data tables, every column of each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arbiter.operators import profile as P
from arbiter.operators import sketches as SK
from arbiter.plans.schema import STAR_SCHEMA, whole_profile
from arbiter.session import ensure_checkpoint_dir
from arbiter.sources.tables import TABLES, Tables

# Columns of each table with Spark type names.
PROFILED = {t: [(c, kind.lower()) for c, kind in cols] for t, cols in STAR_SCHEMA.items()}
PII = ("customer.c_name",)


def _frame(spark, sf_dir, table):
    return getattr(Tables(spark, sf_dir), table)


def whole_db(spark, sf_dir):
    """The profiles of every table, one scan each."""
    t = Tables(spark, sf_dir)
    return P.Profiles({n: getattr(t, n) for n in TABLES})


def _profile(table, redact=()):
    def q(spark, sf_dir):
        return P.profile_table(_frame(spark, sf_dir, table), table, redact)
    return q


def _top(table, redact=()):
    def q(spark, sf_dir):
        return P.profile_top_values(_frame(spark, sf_dir, table), table, P.DEFAULT_TOP_K, redact)
    return q


def profile_sample_nation_part(spark, sf_dir):
    a = P.distinct_sample(_frame(spark, sf_dir, "nation"), "nation")
    b = P.distinct_sample(_frame(spark, sf_dir, "part"), "part")
    return a.unionByName(b)


def profile_english_customer(spark, sf_dir):
    both = P.Profiles({"customer": _frame(spark, sf_dir, "customer")})
    return P.render_column_english(both.columns(), both.top(P.MAX_LISTED + 1))


def profile_english_tables(spark, sf_dir):
    """The English of every table, a line per column."""
    both = whole_db(spark, sf_dir)
    return P.render_table_english(both.columns(), both.top(P.MAX_LISTED + 1))


def profile_db_all(spark, sf_dir):
    """P9 over every column of every table."""
    return whole_db(spark, sf_dir).columns()


def profile_top_all(spark, sf_dir):
    """P8 over every column of every table, long texts included."""
    return whole_db(spark, sf_dir).top()


def profile_sketches(spark, sf_dir):
    """P1, opt-in: distinct counts merged from the sketches of two parts of every table, with the exact ones and whether they are close enough."""
    store = SK.SketchStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}")
    t = Tables(spark, sf_dir)
    for name in TABLES:
        df = getattr(t, name)
        half = F.pmod(F.xxhash64(*[c for c in df.columns if c != "embedding"]), F.lit(2))
        for part in (0, 1):
            store.add(name, f"half-{part}", df.where(half == part))
    exact = whole_profile(spark, sf_dir).select("table_name", "column_name", "distinct_count")
    both = store.profile().join(exact, ["table_name", "column_name"])
    close = F.abs(F.col("approx_distinct") - F.col("distinct_count")) <= SK.relative_error() * F.col("distinct_count") + 1
    return both.select("table_name", "column_name", "row_count", "non_null_count", "distinct_count", close.alias("within_bound"))


def profile_db_small(spark, sf_dir):
    return P.profile_db({t: _frame(spark, sf_dir, t) for t in ("nation", "region", "part")})


QUERIES = {
    "profile_db_all": profile_db_all,
    "profile_db_small": profile_db_small,
    "profile_customer": _profile("customer"),
    "profile_orders": _profile("orders"),
    "profile_part": _profile("part"),
    "profile_nation": _profile("nation"),
    "profile_customer_redacted": _profile("customer", PII),
    "profile_top_customer": _top("customer"),
    "profile_top_orders": _top("orders"),
    "profile_top_part": _top("part"),
    "profile_top_customer_redacted": _top("customer", PII),
    "profile_sample_nation_part": profile_sample_nation_part,
    "profile_english_customer": profile_english_customer,
    "profile_english_tables": profile_english_tables,
    "profile_top_all": profile_top_all,
    "profile_sketches": profile_sketches,
}


def _lcp(a: str, b: str) -> str:
    n = f"least(length({a}), length({b}))"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN '' ELSE substr({a}, 1, coalesce(list_filter(range(1, {n} + 1), "
        f"lambda i: substr({a}, i, 1) <> substr({b}, i, 1))[1], {n} + 1) - 1) END"
    )


def _txt(c: str, kind: str) -> str:
    """A cell as text: fractions in plain decimal form, without a sign of zero."""
    if kind not in ("double", "float"):
        return f"CAST({c} AS VARCHAR)"
    t = f"CAST({c} + CAST(0 AS {kind}) AS VARCHAR)"
    return (f"CASE WHEN contains({t}, 'e') THEN coalesce(regexp_replace(regexp_replace(CAST(TRY_CAST({t} AS DECIMAL(38,18)) AS VARCHAR), "
            f"'0+$', ''), '\\.$', '.0'), {t}) ELSE {t} END")


def _profile_sql(table: str, redact=()) -> str:
    parts = []
    for i, (c, t) in enumerate(PROFILED[table], start=1):
        hidden = f"{table}.{c}".casefold() in {r.casefold() for r in redact}
        scalar = not t.startswith("array")
        txt = _txt(c, t) if scalar else "NULL::VARCHAR"
        cls = "CASE WHEN nn = 0 THEN 'empty' WHEN d THEN 'digits' WHEN a THEN 'alpha' WHEN an THEN 'alnum' ELSE 'mixed' END"
        parts.append(f"""
SELECT '{table}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{t}' AS declared_type,
       rc::BIGINT AS row_count, nn::BIGINT AS non_null_count, {"dc" if scalar else "NULL"}::BIGINT AS distinct_count,
       (rc - nn)::BIGINT AS null_count, CASE WHEN rc > 0 THEN (rc - nn) / rc ELSE 0.0 END AS null_fraction,
       {"nn > 0 AND dc = nn" if scalar else "CASE WHEN nn = 0 THEN false END"} AS is_unique,
       {"NULL::VARCHAR" if hidden or not scalar else _txt("mn", t)} AS min_value, {"NULL::VARCHAR" if hidden or not scalar else _txt("mx", t)} AS max_value,
       minlen::INT AS min_len, maxlen::INT AS max_len,
       minlen IS NOT NULL AND minlen = maxlen AS is_constant_length,
       {cls if scalar else "NULL::VARCHAR"} AS char_class,
       {"''" if hidden else _lcp("tmin", "tmax")} AS common_prefix, {str(hidden).lower()} AS redacted
FROM (SELECT count(*) AS rc, count({c}) AS nn, count(DISTINCT {c}) AS dc,
             {"min(" + c + ") AS mn, max(" + c + ") AS mx" if scalar else "NULL AS mn, NULL AS mx"},
             min(length({txt})) AS minlen, max(length({txt})) AS maxlen,
             min({txt}) AS tmin, max({txt}) AS tmax,
             bool_and(regexp_full_match({txt}, '[0-9]+')) AS d,
             bool_and(regexp_full_match({txt}, '\\p{{L}}+')) AS a,
             bool_and(regexp_full_match({txt}, '[\\p{{L}}\\p{{N}}]+')) AS an
      FROM {table})""")
    return "\nUNION ALL".join(parts)


def _top_sql(table: str, redact=(), k: int = 5) -> str:
    hidden = {r.casefold() for r in redact}
    parts = []
    for c, t in PROFILED[table]:
        if f"{table}.{c}".casefold() in hidden or t.startswith("array"):
            continue
        parts.append(f"""
SELECT table_name, column_name, rank::INT AS rank, value, n FROM (
  SELECT '{table}' AS table_name, '{c}' AS column_name, {_txt(c, t)} AS value, count(*)::BIGINT AS n,
         row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
  FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {k}""")
    return "\nUNION ALL".join(parts)


def _sample_sql(table: str, limit: int = 200) -> str:
    parts = []
    for c, t in PROFILED[table]:
        if t.startswith("array"):
            continue
        parts.append(f"""
SELECT table_name, column_name, rank::INT AS rank, value FROM (
  SELECT '{table}' AS table_name, '{c}' AS column_name, {_txt(c, t)} AS value,
         row_number() OVER (ORDER BY {c}) AS rank
  FROM (SELECT DISTINCT {c} FROM {table} WHERE {c} IS NOT NULL)) WHERE rank <= {limit}""")
    return "\nUNION ALL".join(parts)


def _english_sql(tables) -> str:
    """Clause by clause what a column's profile says, in their order."""
    prof = "\nUNION ALL".join(_profile_sql(t) for t in tables)
    top = "\nUNION ALL".join(_top_sql(t, k=6) for t in tables)
    return f"""WITH p AS ({prof}), tops AS ({top}),
listed AS (SELECT table_name, column_name, string_agg('"' || value || '" (' || n || ')', ', ' ORDER BY rank) FILTER (WHERE rank <= 5)
             || CASE WHEN max(rank) > 5 THEN ', …' ELSE '' END AS top FROM tops GROUP BY ALL),
shaped AS (SELECT p.*, top, concat_ws(', ',
    CASE WHEN is_constant_length THEN 'exactly ' || min_len || ' characters long' WHEN min_len IS NOT NULL THEN min_len || '–' || max_len || ' characters long' END,
    CASE char_class WHEN 'digits' THEN 'all digits' WHEN 'alpha' THEN 'all letters' WHEN 'alnum' THEN 'alphanumeric' WHEN 'mixed' THEN 'mixed characters' END,
    CASE WHEN common_prefix <> '' THEN 'always beginning with "' || common_prefix || '"' END) AS shape
  FROM p LEFT JOIN listed l ON l.table_name = p.table_name AND l.column_name = p.column_name),
english AS (SELECT table_name, column_name, ordinal, row_count, 'Column "' || column_name || '" (declared type ' || declared_type || ').' ||
  CASE WHEN row_count = 0 THEN ' The table is empty.' WHEN non_null_count = 0 THEN ' All ' || row_count || ' rows are NULL.'
  ELSE ' ' || concat_ws(' ',
    CASE WHEN null_count = 0 THEN 'No NULLs across ' || row_count || ' rows.'
         ELSE null_count || ' of ' || row_count || ' rows are NULL (' || CAST(round_even(null_fraction * 100, 0) AS BIGINT) || '%).' END,
    CASE WHEN is_unique THEN 'All ' || distinct_count || ' non-NULL values are distinct (unique).' WHEN distinct_count IS NOT NULL THEN distinct_count || ' distinct values.' END,
    CASE WHEN shape <> '' THEN 'Values are ' || shape || '.' END,
    CASE WHEN min_value = max_value THEN 'The only value is "' || min_value || '".' WHEN min_value IS NOT NULL THEN 'Ranges from "' || min_value || '" to "' || max_value || '".' END,
    CASE WHEN top IS NOT NULL AND NOT is_unique THEN 'Most common: ' || top || '.' END) END AS english FROM shaped)
"""


ORACLES = {
    "profile_sketches": "SELECT table_name, column_name, row_count, non_null_count, distinct_count, true AS within_bound FROM ("
    + "\nUNION ALL".join(_profile_sql(t) for t in PROFILED) + ") WHERE distinct_count IS NOT NULL",
    "profile_db_all": "\nUNION ALL".join(_profile_sql(t) for t in PROFILED),
    "profile_top_all": "\nUNION ALL".join(_top_sql(t) for t in PROFILED),
    "profile_english_customer": _english_sql(["customer"]) + "SELECT table_name, column_name, ordinal, english FROM english",
    "profile_english_tables": _english_sql(PROFILED) + """SELECT table_name, 'Table "' || table_name || '" (' || max(row_count) || ' rows):' || chr(10)
  || string_agg('- ' || english, chr(10) ORDER BY ordinal) AS english FROM english GROUP BY table_name""",
    "profile_db_small": _profile_sql("nation") + "\nUNION ALL" + _profile_sql("region") + "\nUNION ALL" + _profile_sql("part"),
    "profile_customer": _profile_sql("customer"),
    "profile_orders": _profile_sql("orders"),
    "profile_part": _profile_sql("part"),
    "profile_nation": _profile_sql("nation"),
    "profile_customer_redacted": _profile_sql("customer", PII),
    "profile_top_customer": _top_sql("customer"),
    "profile_top_orders": _top_sql("orders"),
    "profile_top_part": _top_sql("part"),
    "profile_top_customer_redacted": _top_sql("customer", PII),
    "profile_sample_nation_part": _sample_sql("nation") + "\nUNION ALL" + _sample_sql("part"),
}
