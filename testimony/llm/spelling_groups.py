"""Spelling variants of the words of a corpus, met by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one edit apart, so
every reduced word generates its full neighbourhood (itself, all deletions, insertions and replacements over the few
symbols), these keys are joined to the vocabulary of reduced words, and what meets is verified on the strings.

Shorter words have more symbols, so that each length has at least as many reduced words as the corpus has words. Two
words of different length meet in the alphabet of the longer one, so a word is also kept in the alphabet of the next
length where that differs. Reduced words that hold more than ``FULL`` words are not opened: what reaches them is
looked up in the same way once more with every letter a symbol of its own, where a key is one word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.llm.textbatch import mix, powers

#: Letters of a run, after A-Z are lower-cased.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A reduced word of more words than this is looked up letter by letter.
FULL = 256
#: Counts that a task holds before it passes them on, and characters that it looks at together.
HELD, PIECE = 300_000, 1 << 20
#: Keys that a worker makes at once.
KEYS = 1 << 20

_U = np.uint64
_BASE = 0xB5AD4ECEDA1CE2A9
_LOWER = bytes(range(256)).lower()
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _pieces(text: str) -> Iterator[str]:
    """A text in parts that end where no run does."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        run = RUN.match(text, end)
        end = run.end() if run else end
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _counted(batches: Iterator[pa.RecordBatch], shortest: int, one_in: int) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            if not (text := value.as_py()):
                continue
            seed = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
            for piece in _pieces(text.encode().translate(_LOWER).decode()):
                for run, n in Counter(RUN.findall(piece)).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= shortest:
                        found[run] += n
                if len(found) > HELD:
                    yield told()
                    found.clear()
    if found:
        yield told()


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, one_in: int = 97) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more; one run of a document in ``one_in`` loses a letter."""
    keyed = docs.selectExpr("cast(doc_id as string) as doc_id", "cast(text as string) as text")
    counts = keyed.mapInArrow(lambda it: _counted(it, shortest, one_in), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def alphabet(length: int, words: int) -> int:
    """How many symbols the letters of words of a length are hashed to: a power of two, and that to the length at least ``words``."""
    k = 2
    while k < 64 and length * (k.bit_length() - 1) < words.bit_length():
        k *= 2
    return k


@lru_cache(maxsize=8)
def _symbols(k: int) -> str:
    """The symbol of each of LETTERS, as a character from ``0`` on. 0: each its own."""
    hashed = mix(np.array([ord(c) for c in LETTERS], np.uint64) * _U(_BASE)) >> _U(20)
    return "".join(chr(48 + (i if not k else int(h) % k)) for i, h in enumerate(hashed))


def _reduced(words: DataFrame, k: Column, sizes: list[int]) -> DataFrame:
    out = F.lit(None).cast("string")
    for size in sizes:
        out = F.when(k == size, F.translate("word", LETTERS, _symbols(size))).otherwise(out)
    return words.withColumn("reduced", out)


def _powers(n: int) -> np.ndarray:
    return powers(_BASE, n)[0]


def _hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """The key of each row of symbols, apart for each alphabet and length."""
    n = symbols.shape[1]
    return mix((_CODE[symbols] * _powers(n + 2)[:n]).sum(axis=1, dtype=np.uint64) + _U(k * 0x10001 + n))


def neighbourhood(symbols: np.ndarray, k: int, letters: int, same: bool, shorter: bool, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) for all that is one edit from each row of symbols: replacements and the row itself, deletions, insertions.

    No string is generated twice: of a run of equal symbols only the first is deleted, and no symbol is inserted before
    its like. Long rows are done in stretches.
    """
    rows, n = symbols.shape
    power, code = _powers(n + 2), _CODE[:letters]
    weighed = _CODE[symbols] * power[:n]
    before = np.zeros((rows, n + 1), np.uint64)
    np.cumsum(weighed, axis=1, out=before[:, 1:])
    total = before[:, -1:]
    after = total - before  # of what begins at a place
    inverse = _U(pow(_BASE, -1, 1 << 64))
    salt = [_U(k * 0x10001 + n + d) for d in (-1, 0, 1)]
    stretch = max(1, KEYS // (rows * letters))
    every = np.arange(rows)
    if same:
        yield every, mix(total[:, 0] + salt[1])
    for at in range(0, n + 1, stretch):
        end = min(at + stretch, n)
        own = symbols[:, at:end]
        if same and end > at:
            keys = mix(total[:, :, None] + (code[None, None, :] - _CODE[own][:, :, None]) * power[at:end][None, :, None] + salt[1])
            kept = np.arange(letters)[None, None, :] != own[:, :, None]
            yield np.nonzero(kept)[0], keys[kept]
        if shorter and end > at:
            first = np.ones(own.shape, bool)
            first[:, 1:] = own[:, 1:] != own[:, :-1]
            if at:
                first[:, 0] = own[:, 0] != symbols[:, at - 1]
            keys = mix(before[:, at:end] + after[:, at + 1 : end + 1] * inverse + salt[0])
            yield np.nonzero(first)[0], keys[first]
        if longer:
            stop = end + 1 if end == n else end
            keys = mix((before[:, at:stop] + after[:, at:stop] * _U(_BASE))[:, :, None] + code[None, None, :] * power[at:stop][None, :, None] + salt[2])
            kept = np.ones(keys.shape, bool)
            kept[:, : end - at] = np.arange(letters)[None, None, :] != own[:, :, None]
            yield np.nonzero(kept)[0], keys[kept]
        if end == n:
            return


def _by_shape(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(alphabet, rows, symbols) for the rows of one alphabet and length, some at a time."""
    strings = batch.column(text).to_pylist()
    ks = np.asarray(batch.column("k"))
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    for k, n in np.unique(np.stack([ks, lengths]), axis=1).T.tolist():
        rows = np.flatnonzero((ks == k) & (lengths == n))
        many = max(1, KEYS // (2 * max(n, 1) * (k or len(LETTERS))))
        for at in range(0, len(rows), many):
            some = rows[at : at + many]
            points = np.frombuffer("".join(strings[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), n)
            yield k, some, points - 48


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, source) for the neighbourhoods of reduced words (k, reduced, source, same, longer). ``same``: in the alphabet of
    its length, so with replacements and deletions; ``longer``: in that of the next one, so with insertions."""
    for batch in batches:
        source = np.asarray(batch.column("source"))
        same, longer = (np.asarray(batch.column(c)).astype(bool) for c in ("same", "longer"))
        for k, rows, symbols in _by_shape(batch, "reduced"):
            one = rows[0]  # both are the same for all words of one alphabet and length
            for row, key in neighbourhood(symbols, k, k or len(LETTERS), same[one], same[one], longer[one]):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(source[rows[row]])], ["key", "source"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = np.zeros(batch.num_rows, np.uint64)
        for k, rows, symbols in _by_shape(batch, "reduced"):
            key[rows] = _hash(symbols, k)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("target")], ["key", "target"])


def near_words(words: DataFrame, full: int = FULL) -> DataFrame:
    """(id, other, other_word, other_n) for every two words one edit apart, either way round. ``words`` (id, word, n) is a written table."""
    lengths = words.agg(F.count("*").alias("n"), F.collect_set(F.least(F.length("word"), F.lit(64))).alias("lengths")).first()
    most = lengths["n"]
    sizes = sorted({alphabet(n + d, most) for n in lengths["lengths"] for d in (0, 1)}, reverse=True)
    reach = [(k, max((n for n in range(1, 66) if alphabet(n, most) == k), default=0)) for k in sizes]

    def alphabet_of(length: Column) -> Column:
        out = F.lit(2)
        for k, longest in reversed(reach):
            out = F.when(length <= longest, k).otherwise(out) if k > 2 else out
        return out

    own, next_one = alphabet_of(F.length("word")), alphabet_of(F.length("word") + 1)
    placed = words.withColumn("k", F.explode(F.array_distinct(F.array(own, next_one))))
    entries = _reduced(placed, F.col("k"), sizes)
    cells = entries.groupBy("k", "reduced").agg(F.count("*").alias("size")).withColumn("cell", F.monotonically_increasing_id())
    cells = cut(cells, "spelling-cells")
    members = cut(entries.join(cells, ["k", "reduced"]).select("cell", "id", "word", "n"), "spelling-members")
    n = F.length("reduced")
    shaped = cells.select("k", "reduced", F.col("cell").alias("source"), (F.col("k") == alphabet_of(n)).alias("same"), (F.col("k") == alphabet_of(n + 1)).alias("longer"))
    keys = shaped.mapInArrow(_keys, "key long, source long")
    sizes_of = cells.select("k", "reduced", F.col("cell").alias("target"))
    targets = sizes_of.mapInArrow(_own, "key long, target long").join(cells.select(F.col("cell").alias("target"), (F.col("size") > full).alias("crowded")), "target")
    # Merged, whatever the sizes look like: what is known of keys is the size of the words that they are made of.
    met = cut(keys.hint("merge").join(targets, "key").select("source", "target", "crowded"), "spelling-met")
    sources = met.where("not crowded").join(members.select(F.col("cell").alias("source"), "id", "word"), "source")
    others = members.select(F.col("cell").alias("target"), F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    one_edit = F.levenshtein("word", "other_word", 1) == 1
    near = sources.join(others, "target").where(one_edit).select("id", "other", "other_word", "other_n")
    # What reaches a crowded cell is looked up with all letters.
    letters = F.translate("word", LETTERS, _symbols(0))
    askers = members.join(met.where("crowded").select(F.col("source").alias("cell")).distinct(), "cell").select("id", "word").distinct()
    asked = askers.select(F.lit(0).alias("k"), letters.alias("reduced"), F.col("id").alias("source"), F.lit(True).alias("same"), F.lit(True).alias("longer"))
    inside = members.join(cells.where(F.col("size") > full).select("cell"), "cell").select(F.col("id").alias("target"), "word", "n").distinct()
    known = inside.select(F.lit(0).alias("k"), letters.alias("reduced"), "target").mapInArrow(_own, "key long, target long")
    exact = cut(asked.mapInArrow(_keys, "key long, source long").hint("merge").join(known, "key").select("source", "target"), "spelling-exact")
    far = exact.join(askers.withColumnRenamed("id", "source"), "source").join(inside.select("target", F.col("word").alias("other_word"), F.col("n").alias("other_n")), "target")
    far = far.where(one_edit).select(F.col("source").alias("id"), F.col("target").alias("other"), "other_word", "other_n")
    return near.union(far).dropDuplicates(["id", "other"])


def _roots(words: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of the words that have a form: forms are followed to the last. A form has twice its word's count, so
    chains are short, and each round halves what is left of them."""
    links = cut(words.where("form is not null").select("word", F.col("form").alias("root")), "spelling-links")
    for _ in range(rounds):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = cut(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-links")
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return links
    raise RuntimeError("chains of forms did not end")


def spelling_groups(docs: DataFrame, shortest: int = 5, least: int = 3, one_in: int = 97, full: int = FULL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text) that occurs ``least`` times or more.

    Words are maximal runs of Latin letters, A-Z lower-cased; one (document, run) in ``one_in`` loses a letter, by the
    CRC-32 of both. Two words are near if one inserted, deleted or replaced code point turns one into the other. The form of
    a word is its near word of the largest count, of equals the first in code-point order, if that has twice the word's
    count or more, else null; its root is the last of its chain of forms. Null and empty texts have no words, a null
    doc_id counts as an empty one, repeated rows count each, other columns are not read, an empty table gives no rows.
    Runs of any length take part.
    """
    found = cut(vocabulary(docs, shortest, least, one_in).withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = near_words(found, full).withColumn("best", F.struct((-F.col("other_n")).alias("n"), F.col("other_word").alias("word")))
    best = near.groupBy("id").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    formed = F.when(-F.col("best.n") >= 2 * F.col("n"), F.col("best.word"))
    words = found.join(best, "id", "left").select("word", formed.alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed.isNotNull(), -F.col("best.n")).alias("form_n"))
    words = cut(words, "spelling-forms")
    return words.join(_roots(words), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
