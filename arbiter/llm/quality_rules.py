"""Quality rules: line-first cleaning.

Every line with a word is judged by itself: *navigation* (separators between
few words), *punctuation* (symbols or exclamation marks in place of prose, or a
short line that ends no sentence), *boilerplate* (short lines with stock
phrases, and later copies of a line).  Failing lines are removed; a document
that loses too large a share of its words is rejected.  Before that a base rule
rejects documents with too few words or mostly repeated three-word windows.

The base counts are computed for a batch of documents at once: words are coded
by a hash table, three-word windows by pairs of codes, and windows that occur
twice in a document mark their words.

Edge cases: a null text has no words, is rejected and stays null; an empty text
is rejected; texts are read whole whatever their length (a batch is cut by
bytes, a longer text is a batch of its own); repeated rows get equal results;
lines without a word are never counted and never removed; an empty table stays
empty; input columns are packed in one struct and keep their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.llm.common import BLANKS, slices, small_batches

#: Text bytes judged at once; their words are objects, of many times their size.
PART_BYTES = 1 << 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when the lines that stay hold a smaller percentage of its words.
MIN_KEPT_PERCENT = 60
#: Lines up to so many words can be boilerplate, or must end a sentence.
BOILERPLATE_WORDS = 40
OPEN_LINE_WORDS = 6
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|›»•·"
#: Marks in place of prose: at least so many, and at least one for this many words.
MIN_MARKS, WORDS_A_MARK = 3, 3

_TERMINAL = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
_BOILERPLATE = (
    r"(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|we use cookies|enable javascript"
    r"|sign up for our newsletter|subscribe to our newsletter|click here|skip to (?:main )?content|back to top|read more|lorem ipsum"
)
_terminal = re.compile(_TERMINAL)
_boilerplate = re.compile(_BOILERPLATE, re.ASCII)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words")


def line_failure(line: str, n_words: int, seen: bool) -> str | None:
    """The rule that a line with ``n_words`` words breaks; ``seen``: an equal line came before."""
    separators = sum(map(line.count, SEPARATORS))
    if separators >= MIN_MARKS and separators * WORDS_A_MARK >= n_words:
        return "navigation"
    marks = sum(map(line.count, "#*$%&<>!"))
    if marks >= MIN_MARKS and marks * WORDS_A_MARK >= n_words:
        return "punctuation"
    if n_words < OPEN_LINE_WORDS and not _terminal.search(line):
        return "punctuation"
    if seen or (n_words <= BOILERPLATE_WORDS and _boilerplate.search(line)):
        return "boilerplate"
    return None


def repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """Per document: words inside a three-word window that the document has twice or more."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    if lengths.sum() < 3:
        return out
    doc = np.repeat(np.arange(len(words)), lengths)
    flat = np.empty(len(doc), object)
    flat[:] = [w for one in words for w in one]
    code, distinct = pd.factorize(flat)
    code = code.astype(np.int64)
    pair = pd.factorize(code[:-1] * len(distinct) + code[1:])[0].astype(np.int64)
    triple, kinds = pd.factorize(pair[:-1] * len(distinct) + code[2:])
    inside = doc[:-2] == doc[2:]
    key, _ = pd.factorize(doc[:-2] * len(kinds) + triple)
    often = (np.bincount(key[inside], minlength=key.max() + 1) >= 2)[key] & inside
    marked = np.zeros(len(doc), bool)
    for shift in range(3):
        marked[shift : len(doc) - 2 + shift] |= often
    return np.bincount(doc, marked, len(words)).astype(np.int64)


def judge(texts: list[str | None]) -> tuple[dict[str, list[int]], list[str | None]]:
    """The counts of each text and the text without its failing lines."""
    counts: dict[str, list[int]] = {c: [] for c in COUNTS}
    cleaned: list[str | None] = []
    words: list[list[bytes]] = []
    for text in texts:
        own: list[bytes] = []
        kept, n_kept, n_dup = [], 0, 0
        seen: set[str] = set()
        for line in (text or "").split("\n"):
            of_line = line.encode().split()
            own += of_line
            if of_line:
                known = line in seen
                n_dup += known
                seen.add(line)
                if line_failure(line, len(of_line), known):
                    continue
                n_kept += len(of_line)
            kept.append(line)
        words.append(own)
        cleaned.append(None if text is None else "\n".join(kept))
        counts["n_words"].append(len(own))
        counts["word_chars"].append(len(text or "") - sum(map((text or "").count, BLANKS)))
        counts["n_symbols"].append(sum(map((text or "").count, SYMBOLS)))
        counts["n_dup_lines"].append(n_dup)
        counts["n_kept_words"].append(n_kept)
    counts["n_repeat_words"] = repeat_words(words).tolist()
    return counts, cleaned


def clean_lines(docs: DataFrame, text_col: str = "text", payload: Column | None = None, with_text: bool = True) -> DataFrame:
    """(row, counts, base_failed, kept, cleaned): verdict and remaining text; ``row`` is ``payload``, by default all columns."""
    small_batches(docs.sparkSession)
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(payload.alias("row"), F.col(f"`{text_col}`").alias("text"))
    fields = [rows.schema["row"], *(T.StructField(c, T.LongType()) for c in COUNTS)]
    schema = T.StructType([*fields, *([T.StructField("cleaned", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                counts, cleaned = judge(part.column("text").to_pylist())
                columns = [part.column("row"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)]
                names = ["row", *COUNTS]
                if with_text:
                    columns.append(pa.array(cleaned, pa.string()))
                    names.append("cleaned")
                yield pa.RecordBatch.from_arrays(columns, names)

    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    enough = F.col("n_kept_words") * 100 >= F.col("n_words") * MIN_KEPT_PERCENT
    return rows.mapInArrow(run, schema).withColumn("base_failed", base).withColumn("kept", ~base & enough)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = clean_lines(docs, payload=F.col("doc_id"), with_text=False)
    return found.select(F.col("row").alias("doc_id"), *COUNTS, "base_failed", "kept")


#: CTEs up to ``verdicts``, which adds the counts and verdicts to the rows of {docs}; two quotes stand for one in SQL.
VERDICTS = rf"""
base_docs AS (SELECT row_number() OVER () AS n, * FROM {{docs}}),
base_lines AS (
  SELECT n, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM base_docs)),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY n, line ORDER BY i) > 1 AS seen,
    len(regexp_extract_all(line, '[|›»•·]')) AS seps,
    len(regexp_extract_all(line, '[#*$%&<>!]')) AS marks
  FROM base_lines WHERE w > 0),
line_verdicts AS (
  SELECT *, (seps >= {MIN_MARKS} AND seps * {WORDS_A_MARK} >= w) OR (marks >= {MIN_MARKS} AND marks * {WORDS_A_MARK} >= w)
    OR (w < {OPEN_LINE_WORDS} AND NOT regexp_matches(line, '{_TERMINAL.replace("'", "''")}'))
    OR seen OR (w <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{_BOILERPLATE}')) AS fails
  FROM judged),
line_counts AS (
  SELECT n, sum(w) AS n_words, sum(CASE WHEN fails THEN 0 ELSE w END) AS n_kept_words, sum(seen::INT) AS n_dup_lines
  FROM line_verdicts GROUP BY n),
base_words AS (
  SELECT n, unnest(ws) AS word, generate_subscripts(ws, 1) AS k
  FROM (SELECT n, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM base_docs)),
windows AS (
  SELECT n, k, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM base_words WINDOW o AS (PARTITION BY n ORDER BY k)),
often AS (SELECT n, k, w3 IS NOT NULL AND count(*) OVER (PARTITION BY n, word, w2, w3) > 1 AS twice FROM windows),
marked AS (
  SELECT n, twice OR coalesce(lag(twice, 1) OVER o, FALSE) OR coalesce(lag(twice, 2) OVER o, FALSE) AS marked
  FROM often WINDOW o AS (PARTITION BY n ORDER BY k)),
repeats AS (SELECT n, sum(marked::INT) AS n_repeat_words FROM marked GROUP BY n),
counted AS (
  SELECT d.*, coalesce(c.n_words, 0)::BIGINT AS n_words,
    (length(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(c.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(c.n_kept_words, 0)::BIGINT AS n_kept_words
  FROM base_docs d LEFT JOIN line_counts c USING (n) LEFT JOIN repeats r USING (n)),
verdicts AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
      AND n_kept_words * 100 >= n_words * {MIN_KEPT_PERCENT} AS kept
  FROM counted)
"""

ORACLE = (
    f"WITH {VERDICTS.format(docs='documents')}"
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words, base_failed, kept FROM verdicts"
)
