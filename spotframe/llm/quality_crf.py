"""Quality by a linear-chain conditional random field over the lines of a document.

Every line that holds a word has a state, good or bad. Its features are its own counts and those of the lines before
and after it; a transition matrix couples neighbouring lines. The field is fitted on a bounded sample of labelled
documents, each line taking its document's label. The mean of a document's forward-backward marginals of the good
state, weighted by the lines' lengths in bytes, becomes its score by a rising logistic curve that is fitted on the same
sample, so that scores are probabilities of the good label.

Scores use the text alone. Defined cases: a null or blank text has no line and scores the share of good documents in
the sample. Without any labelled document every score is 0.5. Rows that repeat a ``doc_id`` are scored one by one, and
equal rows alike; different labels of one ``doc_id`` count once each. A null ``doc_id`` is held out. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import CLASSES, COMMON, Texts, common_index
from .kernel import pieces, tidy

#: Labelled documents that the field is fitted on, and their most lines: the bound of the sample.
SAMPLE, SAMPLE_LINES = 4000, 400_000
#: The fit: gradient steps, and the weight of the squared norm.
STEPS, RIDGE = 300, 1e-3
OWN = 16
#: Lines of a run that documents are cut into for the recursions.
SEGMENT = 128


def line_features(t: Texts) -> np.ndarray:
    """One row per line: own counts, then those of the line before and of the line after, then a constant."""
    n = len(t.line_start)
    chars = t.class_counts(t.line_start, t.line_end).astype(np.float64)
    total = np.maximum(chars.sum(1), 1)
    words = (t.line_last - t.line_first).astype(np.float64)

    def per_line(flags: np.ndarray) -> np.ndarray:
        cum = np.concatenate([[0], np.cumsum(flags)])
        return cum[t.line_last] - cum[t.line_first]

    def bytes_equal(c: str) -> np.ndarray:
        cum = np.concatenate([[0], np.cumsum(t.buf == ord(c))])
        return cum[t.line_end] - cum[t.line_start]

    common = common_index(t.words.hashes(lower=True)) < len(COMMON)
    lengths = t.words.ends - t.words.starts
    at_end = t.buf[np.maximum(t.line_end - 1, 0)] if len(t.buf) else np.zeros(n, np.uint8)
    own = np.stack([
        np.log1p(words) / 3, *[chars[:, k] / total for k in range(CLASSES)], (total - chars[:, 3]) / words / 10,
        per_line(common) / words, per_line(t.repeated) / words, t.repeats_line.astype(np.float64),
        np.minimum(bytes_equal("|") / words, 1.0), np.minimum(bytes_equal("!") / words, 1.0), per_line(lengths == 1) / words,
    ], 1) if n else np.zeros((0, OWN))
    own = np.concatenate([own, np.isin(at_end, [46, 33, 63]).astype(np.float64)[:, None]], 1) if n else np.zeros((0, OWN + 1))
    around = np.zeros((n, 2 * own.shape[1]))
    if n > 1:
        same = (t.line_doc[1:] == t.line_doc[:-1])[:, None]
        around[1:, : own.shape[1]] = own[:-1] * same
        around[:-1, own.shape[1] :] = own[1:] * same
    edge = np.zeros((n, 2))
    if n:
        edge[:, 0] = np.concatenate([[True], t.line_doc[1:] != t.line_doc[:-1]])
        edge[:, 1] = np.concatenate([t.line_doc[1:] != t.line_doc[:-1], [True]])
    return np.concatenate([own, around, edge, np.ones((n, 1))], 1)


@dataclass(frozen=True)
class Field:
    """Weights of the good state against the bad one, transition scores, the score of a text without lines, and the curve."""

    weights: np.ndarray
    moves: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0


def _chains(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of runs of lines that begin at ``first``, longest first; their lengths so; how many reach each position."""
    count = np.diff(np.concatenate([first, [n]]))
    order = np.argsort(-count, kind="stable")
    count = count[order]
    return order, count, np.searchsorted(-count, -np.arange(count[0] if len(count) else 0), "left")


def marginals(gain: np.ndarray, doc: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected counts of each transition, and the sum of log partition functions.

    ``gain``: score of the good state over the bad one for each line. Documents are cut into runs of SEGMENT lines, all
    of which step through their lines together; transfer matrices of whole runs carry messages from run to run, so a
    document of many lines takes about as many steps as it has runs.
    """
    n = len(gain)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    peak = np.maximum(gain, 0)
    emit = np.stack([np.exp(-peak), np.exp(gain - peak)], 1)
    step = np.exp(moves)
    opens = np.concatenate([[True], doc[1:] != doc[:-1]])
    of_doc = np.flatnonzero(opens)
    place = np.arange(n) - of_doc[np.cumsum(opens) - 1]
    first = np.flatnonzero(place % SEGMENT == 0)
    order, count, reach = _chains(first, n)
    starts, begins = first[order], opens[first]
    entry, leave = np.where(begins[:, None], 1.0, 0.5) * np.ones((len(first), 2)), np.ones((len(first), 2))
    if not begins.all():
        whole = np.tile(np.eye(2), (len(first), 1, 1))  # by the runs' order
        for t, m in enumerate(reach):
            at = starts[:m] + t
            one = step * emit[at][:, None, :]
            if t == 0:
                one = np.where(opens[at][:, None, None], np.eye(2) * emit[at][:, None, :], one)
            whole[:m] = whole[:m] @ one
            whole[:m] /= whole[:m].sum((1, 2), keepdims=True)
        transfer = np.empty_like(whole)
        transfer[order] = whole
        runs_from = np.flatnonzero(begins)
        runs = np.diff(np.concatenate([runs_from, [len(first)]]))
        for k in range(1, int(runs.max())):
            at = runs_from[runs > k] + k
            a = (entry[at - 1][:, None, :] @ transfer[at - 1])[:, 0]
            entry[at] = a / a.sum(1, keepdims=True)
        for k in range(int(runs.max()) - 2, -1, -1):
            at = runs_from[runs > k + 1] + k
            b = (transfer[at + 1] @ leave[at + 1][:, :, None])[:, :, 0]
            leave[at] = b / b.sum(1, keepdims=True)
    alpha, beta, scale = np.zeros((n, 2)), np.zeros((n, 2)), np.ones(n)
    for t, m in enumerate(reach):
        at = starts[:m] + t
        before = entry[order[:m]] if t == 0 else alpha[at - 1]
        a = np.where(opens[at][:, None], before, before @ step) * emit[at]
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at, None]
    beta[starts + count - 1] = leave[order]
    for t in range(len(reach) - 2, -1, -1):
        at = starts[: reach[t + 1]] + t
        b = (emit[at + 1] * beta[at + 1]) @ step.T
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    inner = np.flatnonzero(~opens)  # lines with one before
    ahead = emit[inner] * beta[inner]
    weight = ((alpha[inner - 1] @ step) * ahead).sum(1)
    pairs = step * (alpha[inner - 1].T @ (ahead / weight[:, None]))
    return both[:, 1] / both.sum(1), pairs, float(peak.sum()) + float(np.log(scale).sum())


def fit(x: np.ndarray, doc: np.ndarray, good: np.ndarray, prior: float, steps: int = STEPS) -> Field:
    """Maximum likelihood with a ridge, by gradient steps with running moments. ``good``: the label of each line."""
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    if not len(x):
        return Field(weights, moves, prior)
    y = good.astype(np.float64)
    same = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[:-1][same].astype(int), good[1:][same].astype(int)), 1)
    n = len(x)
    m, v = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for k in range(1, steps + 1):
        p, pairs, _ = marginals(x @ weights, doc, moves)
        g = np.concatenate([x.T @ (p - y) / n + RIDGE * weights, ((pairs - seen) / n + RIDGE * moves).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        weights, moves = weights - move[:-4], moves - move[-4:].reshape(2, 2)
    return Field(weights, moves, prior)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_curve(means: np.ndarray, good: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope (at least 0.05) and shift of the logistic curve from the logit of a document's mean to its label."""
    x, y = np.stack([_logit(means), np.ones(len(means))], 1), good.astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps with a ridge towards the identity
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - [1.0, 0.0])
        w = w - np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), g), -1, 1)
    return max(0.05, float(w[0])), float(w[1])


def document_means(p: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted mean marginal of each of n documents, and which have a line."""
    total = np.bincount(doc, size, n)
    return np.bincount(doc, size * p, n) / np.maximum(total, 1), total > 0


def scores(t: Texts, field: Field) -> np.ndarray:
    """One score per document."""
    p, _, _ = marginals(line_features(t) @ field.weights, t.line_doc, field.moves)
    means, has = document_means(p, t.line_doc, (t.line_end - t.line_start).astype(np.float64), t.n)
    curve = 1 / (1 + np.exp(-np.clip(field.slope * _logit(means) + field.shift, -30, 30)))
    return np.where(has, curve, field.prior)


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """Whether CRC-32 of the id as text leaves no remainder: such rows are never learnt from. A null id is the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> DataFrame:
    """(doc_id, quality, text): labelled documents outside the held-out fold, in order of the hash of id and text.

    At most ``sample`` of them, and of these only as long as they have ``lines`` lines together; a document that would
    exceed that is passed over. Equal rows count once. The bounds hold before any text is read by a task of the fit.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = known.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("doc_id", "text").alias("k"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n"), "text")
    each = found.select("doc_id", "quality", "k", "n").distinct().orderBy("k", "doc_id", "quality").limit(sample).collect()  # at most ``sample`` rows
    taken, left = [], lines
    for r in each:
        if r["n"] <= left:
            taken.append((r["k"], r["quality"]))
            left -= r["n"]
    kept = docs.sparkSession.createDataFrame(taken, "k long, quality int").withColumnRenamed("quality", "q")
    same = (found["k"] == kept["k"]) & (found["quality"] == kept["q"])
    return found.join(F.broadcast(kept), same, "left_semi").dropDuplicates(["doc_id", "k", "quality"]).select("doc_id", "quality", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Field:
    """Fit on a bounded ``training_sample``; the features of its lines are all that comes to the driver."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in pieces(batch.column("text")):
                t = Texts(buf, offs)
                x, bounds = line_features(t), np.searchsorted(t.line_doc, np.arange(t.n + 1))
                x = np.concatenate([x, (t.line_end - t.line_start)[:, None]], 1)  # the length comes last
                rows = [x[a:b].astype("<f4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "quality")], pa.array(np.diff(bounds), pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "quality", "n", "x"])

    found = training_sample(docs, labels, sample, lines).select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id long, quality int, n int, x binary")
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], r["quality"], r["n"], bytes(r["x"])))
    prior = float(np.mean([r["quality"] for r in rows])) if rows else 0.5
    xs, doc, good = [], [], []
    for i, r in enumerate(rows):
        if r["n"]:
            xs.append(np.frombuffer(r["x"], "<f4").reshape(r["n"], -1))
            doc.append(np.full(r["n"], i))
            good.append(np.full(r["n"], r["quality"] == 1))
    if not xs:
        return Field(np.zeros(3 * (OWN + 1) + 3), np.zeros((2, 2)), prior)
    x, size = np.split(np.concatenate(xs).astype(np.float64), [-1], axis=1)
    of, states = np.unique(np.concatenate(doc), return_inverse=True)[1], np.concatenate(good)
    field = fit(x, of, states, prior)
    p, _, _ = marginals(x @ field.weights, of, field.moves)
    means, _ = document_means(p, of, size[:, 0], of[-1] + 1)
    slope, shift = fit_curve(means, states[np.searchsorted(of, np.arange(of[-1] + 1))])
    return Field(field.weights, field.moves, prior, slope, shift)


def score_quality(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every whole text of ``docs`` (doc_id, text)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in pieces(batch.column("text")):
                s = scores(Texts(buf, offs), field)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): fitted on ``labels`` (doc_id, quality) outside the held-out fold."""
    out = score_quality(docs, train(docs, labels), threshold)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
