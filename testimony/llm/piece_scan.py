"""SentencePiece encoding by a max-plus parallel scan, and decoding.

The given vocabularies are byte-fallback BPE models. Their encoding is put as a best path: a node is a piece at a
place of the text, neighbours score 0 where BPE of the two joined gives just the two and minus infinity otherwise.
Exactly one path scores 0, and it is the encoding, so the max-plus algebra that finds best paths finds it.

A text is split into chunks. A chunk's transfer matrix holds the best score from every state at its left boundary
to every state at its right one, a state being the piece that reaches or crosses the boundary. Matrices of a document
are multiplied in the max-plus sense, which tells each chunk its entry and exit, and every chunk is then traced back by
itself. Places that no piece of the vocabulary can span (a blank after another character) have one state; chunks end
there where they can.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.llm.textbatch import groups

BLANK = "▁"
#: Code points of one chunk.
CHUNK = 1 << 15
#: Encoded stretches that a worker remembers, in two generations, and the longest of them.
REMEMBER, REMEMBER_LENGTH = 200_000, 48
#: Pairs of pieces whose fit a worker remembers, likewise.
REMEMBER_FITS = 400_000
#: Pieces that begin at a place are looked up by so many characters.
NEAR = 5

_UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
State = tuple[int, int]


@dataclass
class Vocabulary:
    """Pieces of a model: ids by text, merge order (lower first), byte ids. Small: it is sent to every worker."""

    ids: dict[str, int]
    order: dict[str, float]
    bytes: list[int]
    texts: list[bytes]
    unknown: int
    longest: int = 0
    prefixes: dict[str, bool] = field(default_factory=dict)
    splittable: bool = True
    inside: set[str] = field(default_factory=set)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a BPE model with an identity normaliser, a dummy prefix and blanks kept."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " ﬁ  x "
        if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("the model changes texts before it encodes them")
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        byte_ids = {names[i]: i for i in range(n) if model.is_byte(i)}
        texts = [b"" if model.is_control(i) or model.is_unknown(i) else names[i].encode() for i in range(n)]
        for name, i in byte_ids.items():
            texts[i] = bytes([int(name[3:5], 16)])
        out = cls({names[i]: i for i in plain}, {names[i]: -model.get_score(i) for i in plain}, [byte_ids.get(f"<0x{b:02X}>", -1) for b in range(256)], texts, model.unk_id())
        out.longest = max(map(len, out.ids), default=1)
        # Every beginning of a piece, and whether it is one.
        out.prefixes = {p[:k]: False for p in out.ids for k in range(1, len(p) + 1)} | dict.fromkeys(out.ids, True)
        out.splittable = not any(BLANK in p.lstrip(BLANK) for p in out.ids)
        # Characters that some piece holds side by side. Between any others a piece always ends.
        out.inside = {p[i : i + 2] for p in out.ids for i in range(len(p) - 1)}
        return out

    def ids_of(self, piece: str) -> list[int]:
        """One id, or the UTF-8 bytes of a character that no piece holds."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] if self.bytes[b] >= 0 else self.unknown for b in piece.encode()]


class Lattice:
    """Best paths over one vocabulary; a worker keeps one for all its texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits: dict[str, dict[str, bool]] = {}
        self.fits_before: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.near: dict[str, tuple[str, ...]] = {}
        self.whole: dict[str, bytes] = {}
        self.whole_before: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a few characters: the pair of lowest order first, the leftmost of equals."""
        parts, order, none = list(text), self.v.order, np.inf
        scores = [order.get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while scores and (least := min(scores)) < none:
            i = scores.index(least)
            parts[i] += parts.pop(i + 1)
            scores.pop(i)
            if i:
                scores[i - 1] = order.get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = order.get(parts[i] + parts[i + 1], none)
        return parts

    def fit(self, left: str, right: str) -> bool:
        """Whether two pieces can be neighbours; with an empty left, whether the right one stands for itself."""
        row = self.fits.get(left)
        if row is None:
            row = self.fits[left] = {}
        known = row.get(right)
        if known is None:
            known = self.fits_before.get(left, {}).get(right)
            if known is None:
                known = self.merged(left + right) == ([left, right] if left else [right])
            row[right] = known
            self.n_fits += 1
            if 2 * self.n_fits > REMEMBER_FITS:
                self.fits_before, self.fits, self.n_fits = self.fits, {}, 0
        return known

    def begin(self, text: str, q: int) -> tuple[str, ...]:
        """Pieces that begin at a place, longest first. Remembered by the next few characters where those decide."""
        found, prefixes = [], self.v.prefixes
        key, whole = text[q : q + NEAR], None
        for p in range(q + 1, min(q + self.v.longest, len(text)) + 1):
            piece = text[q:p]
            whole = prefixes.get(piece)
            if whole or p == q + 1:
                found.append(piece)
            if whole is None:
                break
        out = tuple(found[::-1])
        if p - q <= NEAR and (whole is None or len(key) < NEAR):
            if len(self.near) >= REMEMBER:
                self.near.clear()
            self.near[key] = out
        return out

    def straight(self, text: str) -> list[str]:
        """The pieces of a text from one state to one state. Only one path scores above minus infinity, so the lattice is
        searched from the left, longer pieces first, and a piece that ends in nothing is never tried again."""
        n, near, fits, fit = len(text), self.near, self.fits, self.fit
        out: list[str] = []
        dead: set[State] = set()
        left, q, before = "", 0, n + 1
        while q < n:
            found = near.get(text[q : q + NEAR]) or self.begin(text, q)
            row = fits.get(left) or {}
            for piece in found:
                p = q + len(piece)
                if p < before and not (dead and (q, p) in dead):
                    known = row.get(piece)
                    if fit(left, piece) if known is None else known:
                        out.append(piece)
                        left, q, before = piece, p, n + 1
                        break
            else:
                if not out:
                    raise ValueError("no path through the lattice")
                before = q
                left = out.pop()
                q -= len(left)
                dead.add((q, before))
                left = out[-1] if out else ""
        return out

    def forward(self, text: str, starts: dict[State, int], begin: int, stop: int) -> list[dict[int, int]]:
        """For every place the pieces that can end there, by their start, with the set (as bits) of entry states that
        reach them with score 0. Pieces begin at ``begin`` or later and before ``stop``."""
        at: list[dict[int, int]] = [{} for _ in range(len(text) + 1)]
        for (s, e), bits in starts.items():
            at[e][s] = bits
        prefixes, ids, fit = self.v.prefixes, self.v.ids, self.fit
        for q in range(begin, stop):
            here = at[q]
            if not here:
                continue
            lefts = [(text[r:q] if r >= 0 else "", bits) for r, bits in here.items()]
            for p in range(q + 1, min(q + self.v.longest, len(text)) + 1):
                piece = text[q:p]
                if piece in ids or p == q + 1:
                    bits = 0
                    for left, b in lefts:
                        if fit(left, piece):
                            bits |= b
                    if bits:
                        at[p][q] = at[p].get(q, 0) | bits
                if piece not in prefixes:
                    break
        return at

    def back(self, text: str, at: list[dict[int, int]], end: State, bit: int, begin: int) -> list[str]:
        """The pieces from ``begin`` on of the path that ends with the piece ``end``."""
        q, p = end
        out = []
        while q >= begin:
            piece = text[q:p]
            out.append(piece)
            q, p = next(r for r, bits in at[q].items() if bits & bit and self.fit(text[r:q] if r >= 0 else "", piece)), q
        return out[::-1]

    def encode_stretch(self, stretch: str) -> bytes:
        """Ids of a text between two places that no piece spans, as 32-bit numbers."""
        found = self.whole.get(stretch)
        if found is not None:
            return found
        found = self.whole_before.get(stretch)
        if found is None:
            ids, inside = self.v.ids, self.v.inside
            ends = [i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in inside]
            if ends:
                found = b"".join([self.encode_stretch(x) for x in map(stretch.__getitem__, map(slice, [0, *ends], [*ends, None]))])
            else:
                found = array("i", [i for p in self.straight(stretch) for i in ((ids[p],) if p in ids else self.v.ids_of(p))]).tobytes()
        if len(stretch) <= REMEMBER_LENGTH:
            self.whole[stretch] = found
            if 2 * len(self.whole) > REMEMBER:
                # What was asked for lately stays; what was not for a whole generation goes.
                self.whole_before, self.whole = self.whole, {}
        return found

    def encode_stretches(self, text: str) -> bytes:
        known, encode = self.whole.get, self.encode_stretch
        return b"".join([known(x) or encode(x) for x in (_UNIT.findall(text) if self.v.splittable else [text])])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text: one chunk, one state at either end."""
        if not text:
            return b""
        return self.encode_stretches(BLANK + text.replace(" ", BLANK))

    def states(self, text: str, at: int) -> list[State]:
        """The pieces that reach or cross a boundary, in order; a piece no vocabulary holds is one character."""
        out = []
        for s in range(max(0, at - self.v.longest), at):
            for e in range(at, min(s + self.v.longest, len(text)) + 1):
                if e > s and (text[s:e] in self.v.ids or e == s + 1):
                    out.append((s, e))
        return out


def is_cut(text: str, at: int) -> bool:
    """Whether no piece of a splittable vocabulary can span this place."""
    return at == 0 or at == len(text) or (text[at] == BLANK and text[at - 1] != BLANK)


def chunks_of(text: str, v: Vocabulary, size: int) -> list[tuple[int, int]]:
    """Bounds of the chunks: at the last cut of each chunk's second half, else after ``size`` characters."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and v.splittable:
            p = text.rfind(BLANK, at + size // 2, end + 1)
            while p > at and not is_cut(text, p):
                p = text.rfind(BLANK, at + size // 2, p)
            end = p if p > at else end
        out.append((at, end))
        at = end
    return out


@dataclass
class Chunk:
    """A chunk with what stands around it, as far as a piece can reach: text, own bounds, whether the bounds are cuts."""

    text: str
    begin: int
    end: int
    open_left: bool
    open_right: bool

    def entries(self, lattice: Lattice) -> list[State]:
        return lattice.states(self.text, self.begin) if self.open_left else [(-1, self.begin)]

    def exits(self, lattice: Lattice) -> list[State]:
        return lattice.states(self.text, self.end) if self.open_right else [(-1, self.end)]

    def solve(self, lattice: Lattice) -> tuple[list[dict[int, int]], list[State], list[State]]:
        """Forward over the whole chunk from all entries at once."""
        entries, exits = self.entries(lattice), self.exits(lattice)
        return lattice.forward(self.text, {s: 1 << k for k, s in enumerate(entries)}, self.begin, self.end), entries, exits

    def transfer(self, lattice: Lattice) -> np.ndarray:
        """Best scores, entries by exits. Between two cuts it is a single 0."""
        if not self.open_left and not self.open_right:
            return np.zeros((1, 1), np.float32)
        at, entries, exits = self.solve(lattice)
        reach = [_either(at[self.end].values())] if not self.open_right else [at[e].get(s, 0) for s, e in exits]
        return np.array([[0.0 if bits >> k & 1 else -np.inf for bits in reach] for k in range(len(entries))], np.float32)

    def trace(self, lattice: Lattice, entry: int, exit_: int) -> bytes:
        """Ids of the pieces that begin in the chunk, given its states."""
        if not self.open_left and not self.open_right:
            return lattice.encode_stretches(self.text[self.begin : self.end])
        entries, exits = self.entries(lattice), self.exits(lattice)
        at = lattice.forward(self.text, {entries[entry]: 1}, self.begin, self.end)
        end = exits[exit_] if self.open_right else (next(iter(at[self.end])), self.end)
        begin = entries[entry][1] if self.open_left else self.begin
        if end[0] < begin:
            return b""
        return np.array([i for p in lattice.back(self.text, at, end, 1, begin) for i in lattice.v.ids_of(p)], "<i4").tobytes()


def _either(values: Iterable[int]) -> int:
    out = 0
    for v in values:
        out |= v
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative, so runs of chunks can be multiplied in any grouping."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def path(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) of every chunk on the best path from the first chunk's only entry to the last one's only exit."""
    reach = [np.zeros((1, 1), np.float32)]
    for m in matrices:
        reach.append(product(reach[-1], m))
    at, out = 0, []
    for m, before in zip(matrices[::-1], reach[-2::-1], strict=True):
        entry = int((before[0] + m[:, at]).argmax())
        out.append((entry, at))
        at = entry
    return out[::-1]


def cut_up(text: str, v: Vocabulary, size: int = CHUNK) -> list[Chunk]:
    """Chunks of a text as it is given (blanks not yet replaced)."""
    whole = BLANK + text.replace(" ", BLANK) if text else ""
    margin = v.longest
    out = []
    for s, e in chunks_of(whole, v, size):
        left = max(0, s - margin)
        hard = [not (v.splittable and is_cut(whole, x) or x in (0, len(whole))) for x in (s, e)]
        out.append(Chunk(whole[left : e + margin], s - left, e - left, *hard))
    return out


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids: bytes put together, blanks restored, the leading one taken off."""
    text = b"".join([v.texts[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if text[:1] == " " else text


_LATTICES: dict[int, Lattice] = {}


def _lattice(shared: Broadcast) -> Lattice:
    """The worker's lattice for a broadcast vocabulary."""
    if shared.value is not None and id(shared.value) not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[id(shared.value)] = Lattice(shared.value)
    return _LATTICES[id(shared.value)]


def _given(rows: DataFrame, vocabulary: Vocabulary | Broadcast) -> Broadcast:
    return vocabulary if isinstance(vocabulary, Broadcast) else rows.sparkSession.sparkContext.broadcast(vocabulary)


def encode_parts(docs: DataFrame, vocabulary: Vocabulary | Broadcast, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk and longer ones, each as (uid, doc_id, chunk, ids) for ``docs`` (doc_id, text): ids of each chunk
    of each row as packed 32-bit numbers.

    Rows' ids are their chunks' in order. A null or empty text has one chunk without ids. A text of one chunk is
    encoded where it is read; chunks of longer ones are dealt to all tasks, and only their transfer matrices meet. uid
    tells rows of the second table apart that repeat a doc_id or have none. Other columns are not read.
    """
    shared = _given(docs, vocabulary)
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(cast(text as string), '') as text")
    schema = "uid long, doc_id long, chunk long, ids binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            for part in groups(batch):
                ids = [lattice.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), pa.array([0] * len(ids), pa.int64()), pa.array(ids, pa.binary())], ["uid", "doc_id", "chunk", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for part in groups(batch):
                for uid, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("uid", "doc_id", "text")), strict=True):
                    found = cut_up(text, v, chunk)
                    columns = [[uid] * len(found), [doc_id] * len(found), list(range(len(found))), [c.text for c in found], [c.begin for c in found], [c.end for c in found], [c.open_left for c in found], [c.open_right for c in found]]
                    kinds = [pa.int64()] * 3 + [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uid", "doc_id", "chunk", "text", "begin", "end", "open_left", "open_right"])

    def chunk_rows(batch: pa.RecordBatch) -> Iterator[Chunk]:
        for values in zip(*(batch.column(c).to_pylist() for c in ("text", "begin", "end", "open_left", "open_right")), strict=True):
            yield Chunk(*values)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            for part in groups(batch):
                found = [c.transfer(lattice) for c in chunk_rows(part)]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("chunk"), pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], ["uid", "chunk", "entries", "matrix"])

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        matrices = [np.frombuffer(m, np.float32).reshape(n, -1) for n, m in zip(table.column("entries").to_pylist(), table.column("matrix").to_pylist(), strict=True)]
        entry, exit_ = zip(*path(matrices), strict=True)
        return pa.table({"uid": table.column("uid"), "chunk": table.column("chunk"), "entry": pa.array(entry, pa.int32()), "exit": pa.array(exit_, pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            for part in groups(batch):
                ids = [c.trace(lattice, a, b) for c, a, b in zip(chunk_rows(part), part.column("entry").to_pylist(), part.column("exit").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), part.column("chunk"), pa.array(ids, pa.binary())], ["uid", "doc_id", "chunk", "ids"])

    number = F.monotonically_increasing_id()
    short = rows.where(F.length("text") < chunk).withColumn("uid", number).mapInArrow(whole, schema)
    long = cut(rows.where(F.length("text") >= chunk).withColumn("uid", number), "piece-long")
    pieces = long.mapInArrow(split, "uid long, doc_id long, chunk long, text string, begin int, end int, open_left boolean, open_right boolean")
    pieces = cut(pieces.repartition("uid", "chunk"), "piece-chunks")
    scanned = pieces.mapInArrow(transfer, "uid long, chunk long, entries int, matrix binary").groupBy("uid").applyInArrow(scan, "uid long, chunk long, entry int, exit int")
    # Written, so that no task holds a worker for scan and one for trace.
    return short, pieces.join(cut(scanned, "piece-scanned"), ["uid", "chunk"]).mapInArrow(trace, schema)


def _whole(long: DataFrame) -> DataFrame:
    """(doc_id, ids) of the longer texts, put together from their chunks."""
    parts = long.groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return parts.select("doc_id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def encode(docs: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of each row of ``docs``: all ids of its text as packed 32-bit numbers; see encode_parts."""
    short, long = encode_parts(docs, vocabulary, chunk)
    return short.select("doc_id", "ids").union(_whole(long))


def _read(doc_id: pa.Array, packed: pa.Array, v: Vocabulary, lists: bool) -> pa.RecordBatch:
    ids = [np.frombuffer(x, "<i4") for x in packed.to_pylist()]
    told = packed
    if lists:
        told = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), pa.array(np.concatenate(ids)))
    return pa.RecordBatch.from_arrays([doc_id, pa.array([decode(x, v) for x in ids], pa.string()), pa.array([len(x) for x in ids], pa.int64()), told], ["doc_id", "text", "n_tokens", "ids"])


def _decoded_schema(lists: bool) -> str:
    return f"doc_id long, text string, n_tokens long, ids {'array<int>' if lists else 'binary'}"


def decoded(rows: DataFrame, vocabulary: Vocabulary | Broadcast, lists: bool = False) -> DataFrame:
    """(doc_id, text, n_tokens, ids) of encode's rows. ids are packed 32-bit
    numbers, or with ``lists`` arrays. A text comes back as it was, but for a literal sign that stands for blanks."""
    shared = _given(rows, vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, "ids"):
                yield _read(part.column("doc_id"), part.column("ids"), shared.value, lists)

    return rows.mapInArrow(read, _decoded_schema(lists))


def encode_decoded(docs: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, lists: bool = False) -> DataFrame:
    """The rows of decoded(encode(docs)). A text of one chunk is decoded by the worker that encodes it: a task that decodes
    what another worker of its own sends holds two, and executors keep both for later tasks."""
    shared = _given(docs, vocabulary)  # once, as a worker keeps every broadcast that it reads

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            for part in groups(batch):
                ids = [lattice.encode(t) for t in part.column("text").to_pylist()]
                yield _read(part.column("doc_id"), pa.array(ids, pa.binary()), shared.value, lists)

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(cast(text as string), '') as text")
    short = rows.where(F.length("text") < chunk).mapInArrow(both, _decoded_schema(lists))
    _, long = encode_parts(docs, shared, chunk)
    return short.union(decoded(_whole(long), shared, lists))
