"""Document quality by a linear-chain conditional random field over lines.

Each line has features of its own and of its two neighbours; the field labels
it good or bad. A document's score is the mean marginal probability of "good"
over its lines, by forward and backward passes, weighted by the lines' lengths.
The field is fitted on the driver on a bounded sample of labelled documents
(SAMPLE_DOCS), each line bearing its document's label; scoring is one map over
all documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kinmatch.llm.common import given_id, in_batches, plain, steps, utf8
from kinmatch.llm.words import NONSPACE, words

#: Labelled documents that the field is fitted on, at most; the sample is by a hash of the id.
SAMPLE_DOCS = 4096
#: Fitting cuts long documents into stretches of this many lines and takes this many stretches of each, at most.
STRETCH, STRETCHES = 64, 8
#: Cells of a padded (documents x lines) table in one pass.
CELLS = 1 << 18
NAMES = ["empty", "log_bytes", "log_words", "upper", "digit", "mark", "symbol", "end_mark", "accent", "word_length", "marked_words", "lone_marks", "repeats", "few_words", "sentence", "capital", "same_line"]

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "stop": b".?!", "mark": b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "symbol": b"#$%&*|<>=~^@{}\\_"}
TABLE = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x NAMES), byte lengths and text numbers of all lines of the texts between offsets; an empty text has one empty line."""
    base = int(offsets[0])
    text, at = data[base : offsets[-1]], offsets - base
    breaks = np.flatnonzero(text == 10)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    # A line starts at each text's start and after each break; with a break as a text's last byte, its last line is empty.
    doc_of_break = np.searchsorted(at, breaks, "right") - 1
    doc = np.sort(np.concatenate([np.arange(len(at) - 1), doc_of_break]), kind="stable")
    last = np.concatenate([doc[1:] != doc[:-1], [True]])
    ends = np.where(last, at[doc + 1], np.concatenate([starts[1:] - 1, [0]]))
    n = np.maximum(ends - starts, 0)
    part = {}
    for k, flags in TABLE.items():
        sums = np.zeros(len(text) + 1, np.int64)
        np.cumsum(flags[text], out=sums[1:])
        part[k] = (sums[ends] - sums[starts]).astype(np.float64)
    ws, we, hashes, _ = words(data, offsets, NONSPACE)
    ws, we = ws - base, we - base
    # Empty lines share their start with the next line; a word belongs to the last line that starts at or before it.
    line = np.searchsorted(starts, ws, "right") - 1
    m = len(starts)
    count = lambda weights=None: np.bincount(line, weights, minlength=m).astype(np.float64)
    n_words = count()
    final, first = (TABLE["mark"][text[we - 1]], TABLE["upper"][text[ws]]) if len(ws) else (np.zeros(0, bool),) * 2
    lone = final & (we - ws == 1)
    again = np.zeros(len(ws), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    letters = np.maximum(part["upper"] + part["lower"], 1)
    some, per_word = np.maximum(n, 1), np.maximum(n_words, 1)
    line_hash = np.zeros(m, np.uint64)
    np.add.at(line_hash, line, hashes)
    same = np.zeros(m)
    same[1:] = (line_hash[1:] == line_hash[:-1]) & (doc[1:] == doc[:-1]) & (n_words[1:] > 0)
    tail = np.where(n > 0, text[np.maximum(ends - 1, 0)] if len(text) else 0, 0)
    head = np.where(n > 0, text[np.minimum(starts, max(len(text) - 1, 0))] if len(text) else 0, 0)
    features = np.stack(
        [n_words == 0, np.log1p(n), np.log1p(n_words), part["upper"] / letters, part["digit"] / some, part["mark"] / some, part["symbol"] / some, part["stop"] / per_word, part["high"] / some]
        + [np.minimum(n / per_word, 40) / 10, count(final) / per_word, count(lone) / per_word, count(again) / per_word, n_words < 4, TABLE["stop"][tail], count(first) / per_word, same],
        axis=1,
    )
    return features, n, doc


def with_neighbours(features: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's features, a constant, those of the lines before and after in its text (0 where there is none), and whether there are such lines."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    inner = (doc[1:] == doc[:-1])[:, None]
    before[1:] = features[:-1] * inner
    after[:-1] = features[1:] * inner
    has = np.zeros((len(doc), 2))
    has[1:, :1], has[:-1, 1:] = inner, inner
    return np.concatenate([np.ones((len(doc), 1)), features, before, after, has], axis=1)


@dataclass
class Field:
    """Unary weights of "good" against "bad", and the 2 x 2 transition scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    constant: float | None = None  # the score of all texts where nothing could be learned

    def unary(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights


def padded(values: np.ndarray, rows: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """rows x longest table of stretches of values, 0 beyond their ends."""
    out = np.zeros((len(rows), int(sizes[rows].max())))
    row = np.repeat(np.arange(len(rows)), sizes[rows])
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
    out[row, col] = values[firsts[rows][row] + col]
    return out


def passes(unary: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log scores (sequence, line, label) and the log partition sums. unary: (sequence, line), for "good"; sizes: ascending line counts."""
    n, t = unary.shape
    forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    own = np.stack([np.zeros_like(unary), unary], axis=2)
    forward[:, 0] = own[:, 0]
    for k in range(1, t):
        live = np.searchsorted(sizes, k, "right")  # sequences from here on have a line k
        f = forward[live:, k - 1, :, None] + moves
        forward[live:, k] = np.logaddexp(f[:, 0], f[:, 1]) + own[live:, k]
    for k in range(t - 2, -1, -1):
        live = np.searchsorted(sizes, k + 1, "right")
        b = backward[live:, k + 1] + own[live:, k + 1]
        b = b[:, None, :] + moves
        backward[live:, k] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    end = forward[np.arange(n), sizes - 1]
    return forward, backward, np.logaddexp(end[:, 0], end[:, 1])


def marginals(unary: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of "good" for each line of sequences that follow one another."""
    firsts, out = np.cumsum(sizes) - sizes, np.zeros(len(unary))
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * sizes[order[j]] <= CELLS:
            j += 1
        rows = order[i:j]
        forward, backward, total = passes(padded(unary, rows, firsts, sizes), sizes[rows], moves)
        good = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0))
        row = np.repeat(np.arange(len(rows)), sizes[rows])
        col = np.arange(len(row)) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
        out[firsts[rows][row] + col] = good[row, col]
        i = j
    return out


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 150, decay: float = 1e-2) -> Field:
    """Maximum likelihood of every line bearing its sequence's label, by Adam with weight decay. weights: of sequences, so that each document counts once and both labels alike."""
    if len(set(labels.tolist())) < 2:
        return Field(np.zeros(0), np.ones(0), np.zeros(0), np.zeros((2, 2)), float(labels.mean()) if len(labels) else 0.5)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[scale == 0], scale[scale == 0] = 0, 1
    order = np.argsort(sizes, kind="stable")
    firsts = np.cumsum(sizes) - sizes
    x = (np.concatenate([x[firsts[k] : firsts[k] + sizes[k]] for k in order]) - mean) / scale
    sizes, labels, weights = sizes[order], labels[order].astype(float), weights[order] / weights.sum()
    firsts, seq = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(seq)) - firsts[seq]
    pairs = np.maximum(sizes - 1, 0)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(len(sizes))
    for step in range(1, rounds + 1):
        moves = theta[-4:].reshape(2, 2)
        unary = padded(x @ theta[:-4], rows, firsts, sizes)
        forward, backward, total = passes(unary, sizes, moves)
        good = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0))[seq, nth]
        gradient = np.zeros_like(theta)
        gradient[:-4] = (weights[seq] * (labels[seq] - good)) @ x
        live = np.arange(unary.shape[1] - 1)[None, :] < pairs[:, None]
        own = np.stack([np.zeros_like(unary), unary], axis=2)
        for a in (0, 1):
            for b in (0, 1):
                both = np.exp(np.minimum(forward[:, :-1, a] + moves[a, b] + own[:, 1:, b] + backward[:, 1:, b] - total[:, None], 0)) * live
                gradient[len(theta) - 4 + 2 * a + b] = weights @ (((labels == a) & (a == b)) * pairs - both.sum(axis=1))
        gradient -= decay * theta * (np.arange(len(theta)) > 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def _feature_rows(batches: Iterator[pa.RecordBatch], stretches: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("txt"))
        for i, j in steps(offsets):
            features, n, doc = line_features(data, offsets[i : j + 1])
            x = with_neighbours(features, doc).astype(np.float32)
            first = np.searchsorted(doc, np.arange(j - i + 1))
            rows = []
            for d in range(j - i):
                starts = range(int(first[d]), int(first[d + 1]), STRETCH)
                rows += [(i + d, a, min(a + STRETCH, int(first[d + 1]))) for a in starts[:: -(-len(starts) // stretches)]]
            owner = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("did").take(owner), batch.column("label").take(owner), pa.array([b - a for _, a, b in rows], pa.int32()), pa.array([x[a:b].tobytes() for _, a, b in rows], pa.binary())], ["did", "label", "n", "x"])


def _score_rows(field: Field):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("txt"))
            scores = np.full(batch.num_rows, field.constant if field.constant is not None else 0.0)
            for i, j in steps(offsets) if field.constant is None else ():
                features, n, doc = line_features(data, offsets[i : j + 1])
                good = marginals(field.unary(with_neighbours(features, doc)), np.bincount(doc, minlength=j - i), field.moves)
                weight = n + 1.0
                scores[i:j] = np.bincount(doc, good * weight, minlength=j - i) / np.bincount(doc, weight, minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column("did"), pa.array(np.clip(scores, 0, 1))], ["did", "score"])

    return rows


def held_out(id_col):
    """The fifth of the ids that is kept from learning."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS, stretches: int = STRETCHES) -> Field:
    """The field of a sample of labelled documents, held-out ids excluded. Rows without an id or a label teach nothing; of two labels for one id, the smaller counts. Longer documents teach by `stretches` stretches of STRETCH lines, dealt over the whole text."""
    chosen = labels.select(F.col(id_col).cast("long").alias("did"), F.col(label_col).cast("int").alias("label")).filter("did is not null and label in (0, 1)").filter(~held_out(F.col("did")))
    chosen = chosen.groupBy("did").agg(F.min("label").alias("label")).orderBy(F.xxhash64("did"), "did").limit(sample)
    rows = plain(docs, id_col, text_col).join(F.broadcast(chosen), "did").transform(in_batches, lambda batches: _feature_rows(batches, stretches), "did long, label int, n int, x binary").toArrow()  # sample * STRETCH * STRETCHES lines at most
    rows = rows.sort_by([("did", "ascending")])
    if not rows.num_rows:
        return fit(np.zeros((0, 1)), np.zeros(0, int), np.zeros(0), np.zeros(0))
    sizes, labels_, did = rows["n"].to_numpy(), rows["label"].to_numpy(), rows["did"].to_numpy()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(int(sizes.sum()), -1).astype(np.float64)
    _, inverse, counts = np.unique(did, return_inverse=True, return_counts=True)
    weights = 1 / counts[inverse]
    return fit(x, sizes, labels_, weights)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS, least: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    score is in 0 to 1, higher where label 1 is likelier; only texts are looked
    at. A null or empty text is one empty line and scored as such; a null id is
    not held out; repeated rows score alike; without labels of both kinds, all
    scores are the mean label (0.5 without any); an empty table gives no rows.
    """
    field = fit_quality(docs, labels, id_col, text_col, label_col, sample)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    scored = plain(docs, id_col, text_col).transform(in_batches, lambda batches: _score_rows(sent.value)(batches), "did long, score double")
    return scored.select(given_id().alias("doc_id"), held_out(given_id()).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that quality() predicts to be good. One map; nothing is shuffled."""
    field = fit_quality(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).cast(pa.string()).fill_null("")
            plain_batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), text], ["did", "txt"])
            for scored in _score_rows(sent.value)(iter([plain_batch])):
                yield batch.filter(pa.array(scored.column("score").to_numpy() >= least))

    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]  # any name may stand in docs
    kinds = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields, strict=True)])
    return docs.toDF(*names).transform(in_batches, rows, kinds).toDF(*docs.columns)
