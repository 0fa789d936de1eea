"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its score reads its own features and those of the lines beside it, and neighbouring
labels share a transition weight. Forward and backward messages are taken for all lines of a batch by a segmented
scan over 2x2 matrices. A document's quality is the length-weighted mean of its lines' marginals, put on the scale
of a probability by a logistic fit. Lines inherit their document's label in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.llm.sample import within
from testimony.llm.textbatch import PLAIN_WORD, Texts, byte_table, groups, mix

#: Labelled documents that training reads at most, those whose doc_id hashes lowest, and their lines.
TRAIN_DOCS, TRAIN_LINES = 4000, 1_000_000
#: Longer texts are not read for training.
TRAIN_CHARS = 200_000
#: Scores from here on are predicted good.
THRESHOLD = 0.3

_SETS = [byte_table(x) for x in (r"[A-Z]", r"[a-z]", r"[0-9]", r"[#*$%&]", r"[|<>{}\\^~=_]", r"[!?]", r"[.,;:]", r"[\x80-\xff]", r"[\x00-\x08\x0E-\x1F]")]
N_OWN = len(_SETS) + 6


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line (own, of the line before, of the line after, whether there is one) and its length in bytes."""
    texts.find_words(PLAIN_WORD)
    texts.find_lines()
    starts, ends = texts.line_starts, texts.line_ends
    length = (ends - starts).astype(np.float64)
    lo, hi = np.searchsorted(texts.starts, starts), np.searchsorted(texts.starts, ends)
    words = (hi - lo).astype(np.float64)
    own = np.zeros((len(starts), N_OWN), np.float32)
    for i, members in enumerate(_SETS):
        own[:, i] = texts.count(members, starts, ends) / np.maximum(length, 1)
    line_of = np.searchsorted(starts, texts.starts, side="right") - 1
    # Words that their line has said before.
    keys = texts.word_hash() ^ mix(line_of.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    base = len(_SETS)
    own[:, base] = np.bincount(line_of[again], minlength=len(starts)) / np.maximum(words, 1)
    own[:, base + 1] = np.minimum(length / np.maximum(words, 1), 40) / 10
    own[:, base + 2] = np.log1p(words) / 4
    own[:, base + 3] = words == 0
    line_keys = texts.span_hash(starts, ends) ^ mix(texts.line_doc.astype(np.uint64))
    order = np.argsort(line_keys, kind="stable")
    later = order[1:][line_keys[order][1:] == line_keys[order][:-1]]
    own[later, base + 4] = 1
    own[:, base + 5] = 1
    edge_first, edge_last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    edge_first[texts.line_first[:-1]] = True
    edge_last[texts.line_first[1:] - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[edge_first] = 0
    after[edge_last] = 0
    return np.concatenate([own, before, after], axis=1), length


def _scan(first: np.ndarray, messages: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Forward messages of a chain for each line, each scaled to sum to 1.

    ``messages`` are the lines' own factors (n, 2), ``pair`` the 2x2 transition factors, ``first`` marks lines that
    begin a document. A line's message is the product of all matrices up to it; products are doubled in span until
    they reach the document's first line.
    """
    n = len(messages)
    step = pair[None, :, :] * messages[:, None, :]
    step[first] = messages[first][:, None, :] * np.ones((1, 2, 1))
    done = first.copy()
    span = 1
    while not done.all():
        at = np.flatnonzero(~done)
        left = step[at - span]
        product = np.einsum("nij,njk->nik", left, step[at])
        product /= product.sum(axis=(1, 2), keepdims=True)
        finished = done[at - span]
        step = step.copy()
        step[at] = product
        done[at] = finished
        span *= 2
    out = step[:, 0, :]
    return out / out.sum(axis=1, keepdims=True) if n else out


@dataclass
class LineField:
    """Weights of the field: one score for good against bad by feature, and the 2x2 table of neighbouring labels."""

    weights: np.ndarray
    pair: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line and P(before, own) of each line's pair with the one before (zero for a first line)."""
        score = np.clip(((features - self.centre) / self.scale) @ self.weights, -30, 30)
        own = np.stack([np.exp(-score / 2 - np.abs(score) / 2), np.exp(score / 2 - np.abs(score) / 2)], axis=1)
        pair = np.exp(self.pair - self.pair.max())
        forward = _scan(first, own, pair)
        last = np.append(first[1:], True)
        backward = _scan(last[::-1], own[::-1], pair.T)[::-1]
        joint = forward * backward / own
        good = joint[:, 1] / joint.sum(axis=1)
        both = np.zeros((len(own), 2, 2))
        inner = np.flatnonzero(~first)
        both[inner] = forward[inner - 1][:, :, None] * pair * backward[inner][:, None, :]
        both[inner] /= both[inner].sum(axis=(1, 2), keepdims=True)
        return good, both

    def quality(self, features: np.ndarray, lengths: np.ndarray, line_first: np.ndarray) -> np.ndarray:
        """The length-weighted mean marginal of each document's lines."""
        first = np.zeros(len(features), bool)
        first[line_first[:-1]] = True
        good, _ = self.marginals(features, first)
        weight = lengths + 1
        sums = lambda x: np.add.reduceat(x, line_first[:-1]) if len(x) else np.zeros(0)
        return sums(good * weight) / sums(weight)

    def score(self, features: np.ndarray, lengths: np.ndarray, line_first: np.ndarray) -> np.ndarray:
        mean = self.quality(features, lengths, line_first)
        return 1 / (1 + np.exp(-np.clip(self.slope * mean + self.shift, -30, 30)))


def fit(features: np.ndarray, lengths: np.ndarray, line_first: np.ndarray, labels: np.ndarray, steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> LineField:
    """Maximum likelihood by Adam over whole passes. Each document weighs the same, however many lines it has."""
    centre, scale = features.mean(axis=0), features.std(axis=0)
    fixed = scale < 1e-6
    centre, scale = np.where(fixed, 0, centre), np.where(fixed, 1, scale)
    field = LineField(np.zeros(features.shape[1]), np.zeros((2, 2)), centre, scale)
    per = np.diff(line_first)
    first = np.zeros(len(features), bool)
    first[line_first[:-1]] = True
    target = np.repeat(labels, per).astype(np.float64)
    weight = np.repeat(1 / per, per) / len(per)
    scaled = (features - centre) / scale
    same = np.zeros((len(features), 2, 2))
    inner = np.flatnonzero(~first)
    same[inner, target[inner].astype(int), target[inner].astype(int)] = 1
    m1, v1, m2, v2 = (np.zeros_like(x) for x in (field.weights, field.weights, field.pair, field.pair))
    for t in range(1, steps + 1):
        good, both = field.marginals(features, first)
        g1 = scaled.T @ ((target - good) * weight) - decay * field.weights
        g2 = ((same - both) * weight[:, None, None]).sum(axis=0) - decay * field.pair
        for g, m, v, x in ((g1, m1, v1, field.weights), (g2, m2, v2, field.pair)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    mean = field.quality(features, lengths, line_first)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * mean + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((labels - p) * mean).sum() - 1e-2 * a, (labels - p).sum()])
        hessian = np.array([[(w * mean * mean).sum() + 1e-2, (w * mean).sum()], [(w * mean).sum(), w.sum()]])
        a, b = np.array([a, b]) + np.linalg.solve(hessian, gradient)
    field.slope, field.shift = float(a), float(b)
    return field


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never reads: the checksum of the id's text is a multiple of 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _lines_of(rows: pa.RecordBatch) -> tuple[Texts, np.ndarray, np.ndarray]:
    texts = Texts(rows.column("text"))
    features, lengths = line_features(texts)
    return texts, features, lengths


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, longest: int = TRAIN_CHARS, lines: int = TRAIN_LINES) -> LineField:
    """A field fitted to at most ``limit`` labelled documents, none longer than ``longest`` characters, that are not held
    out, and to at most ``lines`` lines of them (180 bytes each). Of rows that repeat a doc_id the least text is read.

    Labels of one doc_id that disagree, and ones that are neither 0 nor 1, count as none. Without any labelled
    document the field scores every text 0.5.
    """
    agreed = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .where(~held_out())
    )
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").join(F.broadcast(chosen), "doc_id")
    rows = rows.where(F.length(F.coalesce("text", F.lit(""))) <= longest).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch):
                texts, features, lengths = _lines_of(part)
                edges = texts.line_first
                data = [features[s:e].astype("<f4").tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)]
                long = [lengths[s:e].astype("<f8").tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(data), pa.array(long)], ["doc_id", "quality", "features", "lengths"])

    read_rows = cut(rows.mapInArrow(read, "doc_id long, quality int, features binary, lengths binary"), "quality-sample")
    got = within(read_rows, F.octet_length("lengths") / 8, lines).toArrow().sort_by([("doc_id", "ascending"), ("lengths", "ascending")])
    width = 3 * N_OWN
    if not got.num_rows:
        return LineField(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), 0.0, 0.0)
    features = [np.frombuffer(x, "<f4").reshape(-1, width) for x in got.column("features").to_pylist()]
    lengths = np.concatenate([np.frombuffer(x, "<f8") for x in got.column("lengths").to_pylist()])
    line_first = np.concatenate([[0], np.cumsum([len(x) for x in features])])
    return fit(np.concatenate(features).astype(np.float64), lengths, line_first, np.asarray(got.column("quality")).astype(np.float64))


def score_quality(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs`` (doc_id, text).

    Scores lie in 0 to 1. A null or empty text is one empty line and is scored as such. Only the text is read; rows
    that repeat a doc_id are scored alone, and an empty table gives an empty result.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                texts, features, lengths = _lines_of(rows)
                score = field.score(features, lengths, texts.line_first)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(judge, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the field predicts to be good, with all their columns."""
    columns = docs.columns
    at = columns.index("text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                texts = Texts(rows.column(at))
                features, lengths = line_features(texts)
                yield rows.filter(pa.array(field.score(features, lengths, texts.line_first) >= threshold))

    return docs.mapInArrow(pick, docs.schema)
