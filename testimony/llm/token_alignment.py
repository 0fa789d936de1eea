"""Tokens of two tokenizers over the same bytes, aligned where both end.

Both lists of token ends of a text grow strictly. The shorter one drives: each of its ends looks for its place in the
longer one by steps that double from a known lower bound, then by halving. Common ends cut both lists into groups, and
what lies between two common indices of a list is its range in the group.

Tokens that end together are linked. They are the last so many bytes of one string, so one is the end of the other, and
the pairs of ids that can ever be linked follow from the two vocabularies: at most one for each ending of each token.
Links are counted over the corpus by that list, so counts are a table of bounded size however much text there is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut

#: Characters of text that are encoded together; longer texts are cut at single blanks.
PIECE = 1 << 18
#: Ends of the shorter list between two that are looked up from nothing.
LEADERS = 4
#: A worker forgets the stretches that it has encoded when there are so many, or so many ids of them.
REMEMBER, REMEMBER_IDS = 400_000, 1 << 22

#: Fixed: how the usual byte-level models split texts before their merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"^\s|\s\Z|\s | \s")
_BLANK = "▁"

Encode = Callable[[str], np.ndarray]


@dataclass
class Pair:
    """Two tokenizers: what their files hold, the bytes of their tokens, and the pairs of ids that may end together."""

    byte_level: str
    pieces: bytes
    #: Bytes of each token.
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    #: a * len(b_bytes) + b of every possible link, ascending.
    links: np.ndarray

    @classmethod
    def load(cls, byte_level: str, pieces: str) -> Pair:
        import sentencepiece

        with open(byte_level, encoding="utf-8") as file:
            held = file.read()
        with open(pieces, "rb") as file:
            proto = file.read()
        spec = json.loads(held)
        byte_of = {c: b for b, c in _byte_characters().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for name, i in spec["model"]["vocab"].items():
            a_bytes[i] = b"" if name in special else bytes(byte_of[c] for c in name)
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        b_bytes = []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            b_bytes.append(bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(_BLANK, " ").encode() if plain else b"")
        if any(re.search(rb"[^ ] ", x) for x in b_bytes):
            raise ValueError("a piece holds a blank after another character, so texts can't be cut there")
        return cls(held, proto, a_bytes, b_bytes, _possible(a_bytes, b_bytes))


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _possible(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """Codes of the pairs of which one token is the end of the other."""
    by_bytes: dict[bytes, list[int]] = defaultdict(list)
    for b, token in enumerate(b_bytes):
        if token:
            by_bytes[token].append(b)
    a_by_bytes: dict[bytes, list[int]] = defaultdict(list)
    for a, token in enumerate(a_bytes):
        if token:
            a_by_bytes[token].append(a)
    n = len(b_bytes)
    found = [a * n + b for token, ids in a_by_bytes.items() for k in range(len(token)) for b in by_bytes.get(token[k:], ()) for a in ids]
    found += [a * n + b for token, ids in by_bytes.items() for k in range(1, len(token)) for a in a_by_bytes.get(token[k:], ()) for b in ids]
    return np.unique(np.array(found, np.int64))


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The index of the first entry of ``long`` at or above each entry of ``short``; both ascend.

    Every ``LEADERS``-th entry is looked up by halving. The others start at their leader's place and double their step
    until they have passed, then halve what is between. All take a step at a time together.
    """
    size = len(long)
    if not len(short) or not size:
        return np.zeros(len(short), np.int64)
    low = np.repeat(np.searchsorted(long, short[::LEADERS]), LEADERS)[: len(short)]
    high = low.copy()
    # low: all before it are smaller. high: the first place known to be at or above, or the end.
    going, step = np.arange(len(short)), 1
    while len(going):
        at = high[going]
        under = at < size
        under[under] = long[at[under]] < short[going[under]]
        going, at = going[under], at[under]
        low[going] = at + 1
        high[going] = np.minimum(at + step, size)
        step *= 2
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        less = long[middle] < short[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both lists of the ends that they share."""
    if len(a_ends) > len(b_ends):
        b, a = common_ends(b_ends, a_ends)
        return a, b
    at = gallop(a_ends, b_ends)
    met = at < len(b_ends)
    met[met] = b_ends[at[met]] == a_ends[met]
    return np.flatnonzero(met), at[met]


class _Growing:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.held, self.n = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.resize(self.held, 2 * (self.n + len(values)))
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Stretches:
    """Ids of stretches between single blanks, by one tokenizer each. Stretches are known by their number."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.fits = _Growing(bool)
        self.first = [_Growing(np.int64), _Growing(np.int64)]
        self.length = [_Growing(np.int64), _Growing(np.int64)]
        self.ids = [_Growing(np.int32), _Growing(np.int32)]

    def full(self) -> bool:
        return len(self.number) > REMEMBER or max(x.n for x in self.ids) > REMEMBER_IDS

    def learn(self, new: list[str], fits: bool, ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds stretches, whose ids follow each other up to the given places."""
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.fits.extend(np.full(len(new), fits))
        for first, length, held, own, end in zip(self.first, self.length, self.ids, ids, ends, strict=True):
            sizes = np.diff(end, prepend=0)
            first.extend(held.n + end - sizes)
            length.extend(sizes)
            held.extend(own)

    def joined(self, which: int, numbers: np.ndarray) -> np.ndarray:
        """The ids of some stretches, one after the other."""
        length = self.length[which].held[numbers]
        ends = np.cumsum(length)
        places = np.repeat(self.first[which].held[numbers] - ends + length, length) + np.arange(ends[-1])
        return self.ids[which].held[places].astype(np.int64)


class Aligner:
    """A worker's two tokenizers, and what it has encoded lately."""

    def __init__(self, pair: Pair):
        import sentencepiece

        self.pair = pair
        self.a = _ranked(pair) or _merged(pair)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.pieces)
        self.a_length = np.array([len(x) for x in pair.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in pair.b_bytes], np.int64)
        # Every id before a comma, a bar and a semicolon.
        self.written = [b"%d%c" % (i, c) for i in range(max(len(self.a_length), len(self.b_length))) for c in b",|;"]
        self.stretches = _Stretches()

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a blank and the text by A, and of the text by B; None where the bytes of either are not those.

        A single blank between two other characters begins anew with both: no split and no piece reaches over it. So what
        stands between two of them is encoded by itself, and once for as long as it is remembered.
        """
        if self.stretches.full():
            self.stretches = _Stretches()
        known, parts = self.stretches.number, _CUT.split(text) if _ODD.search(text) else text.split(" ")
        new = [x for x in dict.fromkeys(parts) if x not in known]
        if new:
            self._learn(new)
        numbers = np.array([known[x] for x in parts], np.int64)
        if not self.stretches.fits.held[numbers].all():
            return None
        return self.stretches.joined(0, numbers), self.stretches.joined(1, numbers)

    def _learn(self, new: list[str]) -> None:
        """Encodes stretches as one text, but for those with white space at an end, which would meet that of the next one."""
        plain = [x for x in new if x and not (x[0].isspace() or x[-1].isspace())]
        for stretches in ([plain] if plain else []) + [[x] for x in new if not x or x[0].isspace() or x[-1].isspace()]:
            text = " ".join(stretches)
            a, b = self.a(" " + text), np.array(self.b.encode(text, num_threads=1), np.int64)
            if self._holds(text, a, b):
                ends = np.cumsum([len(x.encode()) + 1 for x in stretches])
                ends = tuple(np.searchsorted(np.cumsum(length[ids]), ends) + 1 for ids, length in ((a, self.a_length), (b, self.b_length)))
                self.stretches.learn(stretches, True, (a, b), ends)
            elif len(stretches) > 1:
                for some in (stretches[: len(stretches) // 2], stretches[len(stretches) // 2 :]):
                    self._learn(some)
            else:
                self.stretches.learn(stretches, False, (a, b), (np.array([len(a)]), np.array([len(b)])))

    def _holds(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        whole = (" " + text).encode()
        return all(b"".join([held[i] for i in ids.tolist()]) == whole for ids, held in ((a, self.pair.a_bytes), (b, self.pair.b_bytes)))

    def pieces(self, text: str) -> Iterator[str]:
        """The text, cut at single blanks where it is long: there both begin anew, and the blank is the one they put before a text."""
        at = 0
        while len(text) - at > PIECE:
            found = _CUT.search(text, at + PIECE)
            if not found:
                break
            yield text[at : found.start()]
            at = found.end()
        yield text[at:] if at else text

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, digest of the groups, links, how often each) of a text; links are indices of ``Pair.links``, ascending."""
        none = 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int32)
        if not text:
            return none
        n_a = n_b = n_groups = 0
        digest, links, counts = hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for piece in self.pieces(text):
            ids = self.encoded(piece)
            if ids is None:
                return none
            a, b = ids
            at_a, at_b = common_ends(np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b]))
            digest.update(self.groups(a, b, at_a, at_b, first=not n_groups))
            codes, many = np.unique(a[at_a] * len(self.b_length) + b[at_b], return_counts=True)
            seen = np.searchsorted(self.pair.links, codes)
            if len(links):
                seen, place = np.unique(np.concatenate([links, seen]), return_inverse=True)
                many = np.bincount(place, np.concatenate([counts, many])).astype(np.int64)
            links, counts = seen, many
            n_a, n_b, n_groups = n_a + len(a), n_b + len(b), n_groups + len(at_a)
        return n_a, n_b, n_groups, digest.hexdigest(), links.astype(np.int32), counts.astype(np.int32)

    def groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, first: bool) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: ids in groups. Not the first: with a ``;`` before."""
        rank_a, rank_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + np.repeat(np.cumsum(rank_b) - rank_b, rank_a)] = 3 * a
        ids[np.arange(len(b)) + np.repeat(np.cumsum(rank_a), rank_b)] = 3 * b
        ends = np.cumsum(rank_a + rank_b) - 1
        ids[ends - rank_b] += 1
        ids[ends] += 2
        written = b"".join([self.written[i] for i in ids.tolist()])[:-1]
        return written if first else b";" + written


def _merged(pair: Pair) -> Encode:
    import tokenizers

    model = tokenizers.Tokenizer.from_str(pair.byte_level)
    model.encode_special_tokens = True
    return lambda text: np.array(model.encode(text, add_special_tokens=False).ids, np.int64)


def _ranked(pair: Pair) -> Encode | None:
    """A faster encoder with the same merges, where the byte-level model splits as usual and its ids are the ranks of its merges."""
    import tiktoken

    spec = json.loads(pair.byte_level)
    ranks = {token: i for i, token in enumerate(pair.a_bytes) if token}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    vocab = spec["model"]["vocab"]
    before = spec["pre_tokenizer"]
    usual = spec["model"]["type"] == "BPE" and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and spec["normalizer"] is None
    if not usual or any(vocab[x + y] != 256 + i for i, (x, y) in enumerate(merges)) or len(ranks) != 256 + len(merges):
        return None
    fast = tiktoken.Encoding("pair", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


@lru_cache(maxsize=1)
def _aligner(given: Broadcast) -> Aligner:
    return Aligner(given.value)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def _aligned(batches: Iterator[pa.RecordBatch], given: Broadcast) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(given)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            found = [aligner.align(t.as_py()) for t in rows.column("text")]
            numbers = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            columns = [rows.column("doc_id"), *numbers, pa.array([f[3] for f in found], pa.string()), _lists([f[4] for f in found]), _lists([f[5] for f in found])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times"])


def _counted(batches: Iterator[pa.RecordBatch], given: Broadcast) -> Iterator[pa.RecordBatch]:
    """(link, n): the links of one task, each once."""
    counts = np.zeros(len(given.value.links), np.int64)
    for batch in batches:
        links, times = (np.asarray(batch.column(c).flatten()) for c in ("links", "times"))
        if len(links):
            counts += np.bincount(links, times, len(counts)).astype(np.int64)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["link", "n"])


def _summed(batches: Iterator[pa.RecordBatch], counted: Broadcast) -> Iterator[pa.RecordBatch]:
    count, best = counted.value
    for batch in batches:
        lists = batch.column("links")
        links, times = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("links", "times"))
        ends = np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))
        starts = np.concatenate([[0], ends])[:-1]

        sums = [np.concatenate([[0], np.cumsum(values)]) for values in (times, times * best[links], times * count[links])]
        columns = [*[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], *[pa.array(x[ends] - x[starts], pa.int64()) for x in sums], batch.column("groups_sha256")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, pair: Pair) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, n_a, n_b, n_groups, groups_sha256, links, times) of each row of ``docs`` (doc_id, text), and
    (link, a, b, n) of the links of the corpus. ``links`` are the places of a text's links in ``pair.links``, each once,
    ``times`` how often each occurs.

    Null and empty texts, and those of which either tokenizer keeps other bytes than a blank and the text, have no tokens:
    zeros, no links, an empty digest. Rows with a null or repeated doc_id are kept and counted each; other columns are not
    read; an empty table gives no rows. A text is held and encoded in pieces of some hundred thousand characters; only a
    stretch without a single blank between two other characters is encoded whole.
    """
    given = docs.sparkSession.sparkContext.broadcast(pair)  # bounded by the vocabularies
    keyed = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, times array<int>"
    texts = cut(keyed.mapInArrow(lambda it: _aligned(it, given), schema), "aligned-texts")
    counts = texts.select("links", "times").mapInArrow(lambda it: _counted(it, given), "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    n_b, codes = len(pair.b_bytes), pair.links
    named = cut(counts, "aligned-links")
    pairs = named.mapInArrow(lambda it: (_named(b, codes, n_b) for b in it), "link long, a int, b int, n long")
    return texts, pairs


def _named(batch: pa.RecordBatch, codes: np.ndarray, n_b: int) -> pa.RecordBatch:
    code = codes[np.asarray(batch.column("link"))]
    return pa.RecordBatch.from_arrays([batch.column("link"), pa.array((code // n_b).astype(np.int32)), pa.array((code % n_b).astype(np.int32)), batch.column("n")], ["link", "a", "b", "n"])


def summarise(texts: DataFrame, pairs: DataFrame, pair: Pair) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of the tables of ``align``.

    n_best: links whose pair is linked as often as any with its B id; count_sum: how often the corpus links the pairs, over
    the links. The counts come to the driver and go to all workers: at most as many as ``pair.links``.
    """
    spark = texts.sparkSession
    count = np.zeros(len(pair.links), np.int64)
    table = pairs.select("link", "n").toArrow()
    count[np.asarray(table.column("link"))] = np.asarray(table.column("n"))
    b = (pair.links % len(pair.b_bytes)).astype(np.int64)
    most = np.zeros(len(pair.b_bytes), np.int64)
    np.maximum.at(most, b, count)
    counted = spark.sparkContext.broadcast((count, (count == most[b]).astype(np.int64)))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times").mapInArrow(lambda it: _summed(it, counted), schema)
