"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word has features of its own and of the lines before and
after it.  The field labels lines good or bad; it is trained on whole documents
whose lines all carry the document's label.  A document's raw score is the mean
of its lines' forward-backward marginals, weighted by their words; a logistic
fit on the training documents turns it into a probability.

The model is fitted on a bounded sample of labelled rows (``TRAIN_DOCUMENTS``,
the first by a hash of the id; documents of over ``TRAIN_LINES`` lines are left
out of the fit, never of scoring).  Only features of lines enter a score.

Edge cases: a null or empty text, or one without words, has score 0; long texts
are scored whole; labels that are null, or of ids without a document, are not
used; a document with several labels counts once for each; without any label
all other texts score 0.5; repeated rows get equal scores; an empty table stays
empty; input columns are packed in one struct and keep their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.llm.common import slices

TRAIN_DOCUMENTS, TRAIN_LINES = 4000, 5000
FOLDS = 5
PASS_SCORE = 0.3
STEPS, RATE, RIDGE = 300, 0.1, 1e-3
#: Words of a line that count as its length, and different words that a long line of prose has at least.
LONG_LINE, DIFFERENT = 200, 60
#: Documents whose chains are worked off side by side.
CHAINS = 512

#: Classes of bytes: 0 white space, 1 upper, 2 lower, 3 digit, 4 symbol, 5 separator, 6 exclamation, 7 other punctuation, 8 beyond ASCII.
_CLASS = np.full(256, 7, np.int64)
_CLASS[128:] = 8
for _chars, _kind in ((b" \t\n\x0b\x0c\r", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b"#*$%&<>@=^~_{}\\", 4), (b"|", 5), (b"!", 6)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _kind
_N_CLASSES = 9
#: Last bytes of characters that end a sentence, or close one.
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?:;\"')]\xa6\xbb\x9d", np.uint8))


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, words, document) of the lines that hold a word, in order."""
    bodies = [(t or "").encode() + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    kind = _CLASS[raw]
    breaks = raw == 10
    line_of = np.cumsum(breaks) - breaks
    n = int(breaks.sum())
    count = np.bincount(line_of * _N_CLASSES + kind, minlength=n * _N_CLASSES).reshape(n, _N_CLASSES).astype(float)
    document = np.searchsorted(np.cumsum([len(b) for b in bodies]), np.flatnonzero(breaks), side="right")
    word_start = (kind != 0) & (np.concatenate([[0], kind[:-1]]) == 0)
    of_line = line_of[word_start]
    words = np.bincount(of_line, minlength=n)
    flat = np.empty(len(of_line), object)
    flat[:] = [w for b in bodies for w in b.split()]
    code, distinct = pd.factorize(flat)
    code = code.astype(np.int64)
    different = np.bincount(pd.unique(of_line * max(len(distinct), 1) + code) // max(len(distinct), 1), minlength=n)
    doubled = np.bincount(of_line[1:][(code[1:] == code[:-1]) & (of_line[1:] == of_line[:-1])], minlength=n)
    last = np.zeros(n, np.int64)
    place = np.flatnonzero(kind != 0)
    last[line_of[place]] = place
    lines = np.empty(n, object)
    lines[:] = [x for b in bodies for x in b[:-1].split(b"\n")]
    of_text = pd.factorize(lines)[0].astype(np.int64)
    seen = pd.Series(document * n + of_text).duplicated().to_numpy()
    w = np.maximum(words, 1)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    own = np.column_stack([
        np.log1p(np.minimum(words, LONG_LINE)) / 5, words < 6, np.minimum((count[:, 1:].sum(axis=1)) / w / 10, 3), count[:, 1] / letters, count[:, 3] / np.maximum(count[:, 1:].sum(axis=1), 1),
        np.minimum(count[:, 4] / w, 2), np.minimum(count[:, 5] / w, 2), np.minimum(count[:, 6] / w, 2), np.minimum(count[:, 7] / w, 2),
        _ENDS[raw[last]], 1 - np.minimum(different / np.minimum(w, DIFFERENT), 1), doubled / w, seen,
    ])
    keep = words > 0
    own, words, document = own[keep], words[keep], document[keep]
    same = document[1:] == document[:-1] if len(document) else np.zeros(0, bool)
    before, after = np.zeros((len(own), own.shape[1] + 1)), np.zeros((len(own), own.shape[1] + 1))
    before[1:][same] = np.column_stack([own[:-1], np.ones(max(len(own) - 1, 0))])[same]
    after[:-1][same] = np.column_stack([own[1:], np.ones(max(len(own) - 1, 0))])[same]
    return np.column_stack([np.ones(len(own)), own, before, after]), words, document


def chains(document: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lengths) of documents of similar length, as rows of a padded table of line numbers."""
    ids, first, n = np.unique(document, return_index=True, return_counts=True)
    order = np.argsort(n, kind="stable")
    for at in range(0, len(order), CHAINS):
        some = order[at : at + CHAINS]
        width = int(n[some].max())
        if len(some) > 1 and width > 20_000:  # very long documents one by one
            for k in some:
                yield first[k] + np.arange(n[k])[None, :], n[k : k + 1]
            continue
        yield first[some][:, None] + np.minimum(np.arange(width)[None, :], n[some][:, None] - 1), n[some]


def marginals(unary: np.ndarray, step: np.ndarray, places: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(good, pairs, log_z) of padded chains: P(good) per place, expected label pairs, and the sum of the log partition functions.

    ``unary`` is the score of good against bad per line, ``step`` the 2 x 2 scores of label pairs.
    """
    score = unary[places]
    width = score.shape[1]
    forward = np.zeros((width, len(n), 2))
    forward[0, :, 1] = score[:, 0]
    for t in range(1, width):
        now = np.logaddexp(forward[t - 1, :, 0, None] + step[0], forward[t - 1, :, 1, None] + step[1])
        now[:, 1] += score[:, t]
        forward[t] = np.where((t < n)[:, None], now, forward[t - 1])
    log_z = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    good = np.zeros_like(score)
    pairs = np.zeros((2, 2))
    back = np.zeros((len(n), 2))
    for t in range(width - 1, -1, -1):
        good[:, t] = np.exp(forward[t, :, 1] + back[:, 1] - log_z)
        if t:
            ahead = back.copy()
            ahead[:, 1] += score[:, t]
            joint = forward[t - 1, :, :, None] + step[None] + ahead[:, None, :] - log_z[:, None, None]
            inside = t < n
            pairs += np.exp(joint[inside]).sum(axis=0)
            back = np.where(inside[:, None], np.logaddexp(step[:, 0][None] + ahead[:, :1], step[:, 1][None] + ahead[:, 1:]), back)
    return good, pairs, float(log_z.sum())


def raw_scores(model: dict, features: np.ndarray, words: np.ndarray, document: np.ndarray, n_documents: int) -> np.ndarray:
    """Word-weighted mean marginal of each document; nan without lines."""
    total, weight = np.zeros(n_documents), np.zeros(n_documents)
    if len(features):
        unary = ((features - model["mean"]) / model["scale"]) @ model["weights"]
        for places, n in chains(document):
            good, _, _ = marginals(unary, model["step"], places, n)
            inside = np.arange(places.shape[1])[None, :] < n[:, None]
            w = np.where(inside, words[places], 0)
            total[document[places[:, 0]]] = (good * w).sum(axis=1)
            weight[document[places[:, 0]]] = w.sum(axis=1)
    return np.where(weight > 0, total / np.maximum(weight, 1), np.nan)


def probability(model: dict, raw: np.ndarray) -> np.ndarray:
    clipped = np.clip(raw, 1e-6, 1 - 1e-6)
    score = 1 / (1 + np.exp(-(model["slope"] * np.log(clipped / (1 - clipped)) + model["shift"])))
    return np.where(np.isnan(raw), 0.0, score)


def fit(features: np.ndarray, words: np.ndarray, document: np.ndarray, label: np.ndarray) -> dict:
    """Train the field by gradient ascent (Adam) on the conditional likelihood, then the logistic fit of document scores."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean[0], scale = 0, np.where(scale > 1e-9, scale, 1)
    x = (features - mean) / scale
    y = label[document].astype(float)
    batches = list(chains(document))
    n_docs = max(len(np.unique(document)), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    same = document[1:] == document[:-1]
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
    for t in range(1, STEPS + 1):
        unary, step = x @ theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs = np.zeros(len(x)), np.zeros((2, 2))
        for places, n in batches:
            g, p, _ = marginals(unary, step, places, n)
            inside = np.arange(places.shape[1])[None, :] < n[:, None]
            good[places[inside]] = g[inside]
            pairs += p
        gradient = np.concatenate([x.T @ (y - good), (observed - pairs).ravel()]) / n_docs - RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = {"mean": mean, "scale": scale, "weights": theta[:-4], "step": theta[-4:].reshape(2, 2), "slope": 1.0, "shift": 0.0}
    raw = raw_scores(model, features, words, document, len(label))
    known = ~np.isnan(raw)
    z = np.clip(raw[known], 1e-6, 1 - 1e-6)
    z, target = np.log(z / (1 - z)), label[known].astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic regression with one feature
        p = 1 / (1 + np.exp(-(slope * z + shift)))
        w = p * (1 - p)
        g = np.array([((target - p) * z).sum() - slope, (target - p).sum() - shift])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        slope, shift = np.array([slope, shift]) + np.linalg.solve(h, g)
    return model | {"slope": float(max(slope, 1e-3)), "shift": float(shift)}


def train(labelled: DataFrame) -> dict | None:
    """Fit on (text, label) rows; the caller has bounded them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                features, words, document = line_features(part.column("text").to_pylist())
                n = np.bincount(document, minlength=part.num_rows)
                some = np.flatnonzero((n > 0) & (n <= TRAIN_LINES))
                packed = [pa.array([a[document == d].astype(float).tobytes() for d in some.tolist()], pa.binary()) for a in (features, words)]
                yield pa.RecordBatch.from_arrays([part.column("label").take(pa.array(some)), *packed], ["label", "features", "words"])

    rows = labelled.mapInArrow(run, "label int, features binary, words binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, r.features, r.words))
    words = [np.frombuffer(r.words) for r in rows]
    features = np.concatenate([np.frombuffer(r.features).reshape(len(w), -1) for r, w in zip(rows, words, strict=True)])
    return fit(features, np.concatenate(words), np.repeat(np.arange(len(rows)), [len(w) for w in words]), np.array([r.label for r in rows]))


def score_documents(docs: DataFrame, model: dict | None, text_col: str = "text", payload: Column | None = None) -> DataFrame:
    """(row, score); ``row`` is ``payload``, by default all columns."""
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(payload.alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                features, words, document = line_features(part.column("text").to_pylist())
                if model is None:
                    score = np.where(np.bincount(document, minlength=part.num_rows) > 0, 0.5, 0.0)
                else:
                    score = probability(model, raw_scores(model, features, words, document, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score)], ["row", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op7_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null")
    chosen = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(TRAIN_DOCUMENTS)
    # At most TRAIN_DOCUMENTS ids and labels are sent to the documents.
    model = train(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"))
    scored = score_documents(docs, model, payload=F.col("doc_id"))
    return scored.select(
        F.col("row").alias("doc_id"), held_out(F.col("row")).alias("held_out"), "score", (F.col("score") >= PASS_SCORE).cast("int").alias("predicted")
    )
