r"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field for what they miss.

The field's nodes are the tokens of a text that hold a digit or an @. Tokens that stand side by side share a chain
potential; a token and the last one before it with the same digits, or with the same last seven, share a skip
potential however far apart they stand, and so do a token and the nearest found ones before and after it. What the
patterns find is given; loopy sum-product messages carry it to the other tokens, so that a number said once in full
and earlier or later in another form gets one label everywhere.

Weights are trained by pseudo-likelihood on a bounded sample, with the patterns' findings as labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.llm.sample import within
from testimony.llm.textbatch import Texts, byte_table, groups

KINDS = ("email", "ip", "card", "phone")
#: Documents read for training at most, those whose doc_id hashes lowest, none longer than so many characters.
TRAIN_DOCS = 6000
TRAIN_CHARS = 200_000
#: Tokens of them that training reads at most.
TRAIN_TOKENS = 1_000_000
#: A token gets a label that the patterns did not give from this marginal on.
SURE = 0.8
#: Messages of a text stop once none changes by more than this. ROUNDS only ends those that never settle.
SETTLED = 1e-6
ROUNDS = 1000
#: Prior mean of a skip edge's weight for equal labels; repeats are too rare in most samples to teach it from nothing.
AGREEMENT = 6.0
#: Tokens that stand together are one added span up to so many digits.
SPAN_DIGITS = {"email": 0, "ip": 0, "card": 19, "phone": 15}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only start where its run of digits starts: the rest of the run decides alike for every later start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_TRIM = "#*$%&|<>\"'`,;:.!?=[]{}"
_CLUE = byte_table(r"[0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the fixed patterns find, by kind and start; offsets in code points, ends exclusive."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@dataclass
class Tokens:
    """Nodes of one or more texts: text, start, end, label given by the patterns (0: none), features, edges."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    given: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


_BUCKETS = (0, 1, 4, 7, 9, 13, 20)
N_FEATURES = 1 + len(_BUCKETS) + 10


def _shape(token: str, digits: str, before: str, after: str) -> list[float]:
    n = len(digits)
    bucket = [0.0] * len(_BUCKETS)
    bucket[max(i for i, b in enumerate(_BUCKETS) if n >= b)] = 1.0
    parts = token.split(".")
    return [
        1.0,
        *bucket,
        float("@" in token),
        float("." in token.partition("@")[2]),
        float(len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(13 <= n <= 19 and luhn(digits)),
        float(token[0] == "+"),
        float(token[0] == "(" or token[-1] == ")"),
        float("-" in token),
        float(before[:1] == "+" or before[-1:] == ")"),
        float(after[:1] == "("),
        float(sum(c.isalpha() for c in token[:64]) > n),
    ]


def tokens_of(texts: list[tuple[int, str, list[tuple[str, int, int]]]]) -> Tokens:
    """The nodes and edges of some texts, each given as (number, text, findings of the patterns)."""
    doc, start, end, given, features, chain, skip = [], [], [], [], [], [], []
    for number, text, found in texts:
        base = len(doc)
        own = []
        for m in _TOKEN.finditer(text):
            raw = m[0]
            left = len(raw) - len(raw.lstrip(_TRIM))
            token = raw.strip(_TRIM)
            if token:
                own.append((m.start() + left, m.start() + left + len(token), token, _digits(token)))
        label = np.zeros(len(own), np.int64)
        starts = np.array([o[0] for o in own], np.int64)
        ends = np.array([o[1] for o in own], np.int64)
        for kind, s, e in found:
            label[np.searchsorted(ends, s, side="right") : np.searchsorted(starts, e)] = KINDS.index(kind) + 1
        last: dict[str, int] = {}
        sure: dict[str, int] = {}
        named, linked = [], set()
        for i, (s, e, token, digits) in enumerate(own):
            near_before = own[i - 1][2] if i and s - own[i - 1][1] <= 3 else ""
            near_after = own[i + 1][2] if i + 1 < len(own) and own[i + 1][0] - e <= 3 else ""
            doc.append(number)
            start.append(s)
            end.append(e)
            features.append(_shape(token, digits, near_before, near_after))
            if near_before:
                chain.append((base + i - 1, base + i))
            keys = [f"={digits}"] if len(digits) >= 5 else []
            keys += [f"~{digits[-7:]}"] if len(digits) >= 7 else []
            keys += [f"@{token}"] if "@" in token else []
            named.append(keys)
            linked.update((seen[k], i) for seen in (last, sure) for k in keys if k in seen)
            last.update(dict.fromkeys(keys, i))
            if label[i]:
                sure.update(dict.fromkeys(keys, i))
        coming: dict[str, int] = {}
        for i in reversed(range(len(own))):
            linked.update((i, coming[k]) for k in named[i] if k in coming)
            if label[i]:
                coming.update(dict.fromkeys(named[i], i))
        skip.extend((base + a, base + b) for a, b in sorted(linked))
        given.extend(label.tolist())
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Tokens(np.array(doc, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(given, np.int64), np.array(features, np.float64).reshape(-1, N_FEATURES), pairs(chain), pairs(skip))


LABELS = len(KINDS) + 1


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class SkipChain:
    """Log potentials: features x labels for nodes, labels x labels for chain and for skip edges."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, t: Tokens, rounds: int = ROUNDS, damping: float = 0.3) -> np.ndarray:
        """Label marginals by loopy sum-product messages. Each text's run until they settle, whatever stands beside it."""
        n = len(t.doc)
        own = t.features @ self.node
        known = np.flatnonzero(t.given)
        # Found labels are observed: however many mentions lean another way, they do not overrule them.
        own[known] = np.where(np.eye(LABELS, dtype=bool)[t.given[known]], 0.0, -1e6)
        edges = np.concatenate([t.chain, t.skip])
        if not n or not len(edges):
            return _softmax(own)
        tables = np.exp(np.stack([self.chain, self.skip, self.chain.T, self.skip.T]))
        kind = np.repeat([0, 1], [len(t.chain), len(t.skip)])
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        kind = np.concatenate([kind, kind + 2])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        _, text = np.unique(t.doc[source], return_inverse=True)
        message = np.zeros((len(source), LABELS))
        open_ = np.arange(len(source))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, target[open_], message[open_])
            out = belief[source[open_]] - message[back[open_]]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", out, tables[kind[open_]]) + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            moved = np.zeros(len(source))
            moved[open_] = np.abs(new - message[open_]).max(axis=1)
            message[open_] = damping * message[open_] + (1 - damping) * new
            most = np.zeros(int(text.max()) + 1)
            np.maximum.at(most, text, moved)
            open_ = open_[most[text[open_]] > SETTLED]
            if not len(open_):
                break
        belief = own
        np.add.at(belief, target, message)
        return _softmax(belief)


def fit(t: Tokens, steps: int = 150, rate: float = 0.2, decay: float = 1e-3) -> SkipChain:
    """Pseudo-likelihood: each node's label given its features and its neighbours' labels, by Adam."""
    n = len(t.doc)
    if not n:
        return SkipChain(np.eye(N_FEATURES, LABELS) * np.eye(1, LABELS) * 20, np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    truth = np.eye(LABELS)[t.given]

    def around(edges: np.ndarray) -> np.ndarray:
        out = np.zeros((n, LABELS))
        np.add.at(out, edges[:, 0], truth[edges[:, 1]])
        np.add.at(out, edges[:, 1], truth[edges[:, 0]])
        return out

    seen = np.concatenate([t.features, around(t.chain), around(t.skip)], axis=1)
    prior, m, v = (np.zeros((seen.shape[1], LABELS)) for _ in range(3))
    prior[-LABELS:] = AGREEMENT * np.eye(LABELS)
    weights = prior.copy()
    for step in range(1, steps + 1):
        g = seen.T @ (truth - _softmax(seen @ weights)) / n - decay * (weights - prior)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        weights += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    chain, skip = weights[N_FEATURES : N_FEATURES + LABELS], weights[N_FEATURES + LABELS :]
    return SkipChain(weights[:N_FEATURES], (chain + chain.T) / 2, np.diag(np.maximum(np.diag(skip), 0)))


def _with_clues(column: pa.Array) -> list[tuple[int, str]]:
    """Rows whose text holds a digit or an @, with their text."""
    texts = Texts(column)
    rows = np.flatnonzero(texts.count(_CLUE, texts.offsets[:-1], texts.offsets[1:]))
    return [(int(r), texts.text(r).decode()) for r in rows]


def spans_of(column: pa.Array, field: SkipChain, sure: float = SURE) -> tuple[dict[int, list[tuple[str, int, int]]], dict[int, list[tuple[str, int, int]]]]:
    """By row of the column: the patterns' spans, and those that the field adds."""
    read = [(row, text, base_spans(text)) for row, text in _with_clues(column)]
    t = tokens_of(read)
    label = np.zeros(len(t.doc), np.int64)
    if len(t.doc):
        p = field.marginals(t)
        best = p.argmax(axis=1)
        label = np.where((p[np.arange(len(best)), best] >= sure) & (t.given == 0), best, 0)
    linked, texts = set(map(tuple, t.chain.tolist())), {row: text for row, text, _ in read}
    added: dict[int, list[tuple[str, int, int]]] = {}
    previous = -2
    for i in np.flatnonzero(label).tolist():
        own = added.setdefault(int(t.doc[i]), [])
        together = previous == i - 1 and label[i] == label[previous] and (previous, i) in linked
        if together and len(_digits(texts[int(t.doc[i])][own[-1][1] : int(t.end[i])])) <= SPAN_DIGITS[own[-1][0]]:
            own[-1] = (own[-1][0], own[-1][1], int(t.end[i]))
        else:
            own.append((KINDS[label[i] - 1], int(t.start[i]), int(t.end[i])))
        previous = i
    return {row: found for row, _, found in read if found}, added


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return KINDS.index(span[0]), span[1], span[2]


def train(docs: DataFrame, limit: int = TRAIN_DOCS, longest: int = TRAIN_CHARS, tokens: int = TRAIN_TOKENS) -> SkipChain:
    """Weights from at most ``limit`` documents of at most ``longest`` characters, and from at most ``tokens`` tokens of them
    (about 150 bytes each). Without any, nothing is added."""
    ids = docs.selectExpr("cast(doc_id as long) as doc_id").where("doc_id is not null").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").join(F.broadcast(chosen), "doc_id")
    texts = texts.where(F.length("text") <= longest).groupBy("doc_id").agg(F.min("text").alias("text")).where("text rlike '[0-9@]'")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, text in _with_clues(batch.column("text")):
                t = tokens_of([(0, text, base_spans(text))])
                parts = [pa.array([x.tobytes()]) for x in (t.given, t.features, t.chain, t.skip)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[row]], pa.int64()), *parts], ["doc_id", "given", "features", "chain", "skip"])

    read_rows = cut(texts.mapInArrow(read, "doc_id long, given binary, features binary, chain binary, skip binary"), "personal-sample")
    rows = within(read_rows, F.octet_length("given") / 8, tokens).toArrow().sort_by("doc_id").to_pylist()
    given = [np.frombuffer(r["given"], np.int64) for r in rows]
    base = np.concatenate([[0], np.cumsum([len(g) for g in given])]).astype(np.int64)
    edges = lambda k: np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(r[k], np.int64).reshape(-1, 2) + b for r, b in zip(rows, base, strict=False))])
    features = np.concatenate([np.zeros((0, N_FEATURES)), *(np.frombuffer(r["features"]).reshape(-1, N_FEATURES) for r in rows)])
    labels = np.concatenate([np.zeros(0, np.int64), *given])
    zero = np.zeros(len(labels), np.int64)
    return fit(Tokens(zero, zero, zero, labels, features, edges("chain"), edges("skip")))


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_personal_data(docs: DataFrame, field: SkipChain) -> DataFrame:
    """(doc_id, base, added) for each row of ``docs`` (doc_id, text): spans by kind and start, in code points.

    A null or empty text has none. Rows that repeat a doc_id, or have none, are read alone; other columns are not read;
    an empty table gives an empty result. Spans of different kinds may overlap, those of one kind never do.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                base, added = spans_of(rows.column("text"), field)
                lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(found.get(r, ()), key=_order)] for r in range(rows.num_rows)], span) for found in (base, added)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *lists], ["doc_id", "base", "added"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(look, f"doc_id long, base {_SPANS}, added {_SPANS}")


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame, field: SkipChain) -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become one
    mark, named for the first. All columns stay; n_chars, where there is one, counts the new text."""
    at = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                base, added = spans_of(rows.column(at), field)
                if not base and not added:
                    yield rows
                    continue
                new = [_masked(t.as_py(), base.get(r, []) + added.get(r, [])) if r in base or r in added else t.as_py() for r, t in enumerate(rows.column(at))]
                columns = list(rows.columns)
                columns[at] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
