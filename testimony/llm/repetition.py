"""Quality rules on repetition: how many characters lie inside n-grams and lines that a text repeats.

Rolling hashes of several n-gram lengths are taken over all words of a batch at once in numpy; a window that its
text holds twice marks its words, and the marked words' characters are set against those of the whole text.
No rows meet each other, so there is no shuffle, however hot a source is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from testimony.llm.textbatch import PLAIN_WORD, Texts, byte_table, covered, gram_sums, grams, groups, mix

SYMBOLS = byte_table(r"[#*$%&|<>]")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, gram_chars array<long>, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """Base: fewest words, largest percentage of words in repeated 3-word windows. Method: largest percentage of
    characters in duplicated lines, and in duplicated n-grams by n."""

    min_words: int = 50
    repeat_percent: int = 50
    line_percent: int = 30
    gram_percent: dict[int, int] = field(default_factory=lambda: {5: 30, 7: 26, 10: 20})


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    inorder = np.sort(keys)
    twice = inorder[1:][inorder[1:] == inorder[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    low = np.uint64((1 << 20) - 1)
    likely = np.zeros(1 << 20, bool)
    likely[twice & low] = True
    out = likely[keys & low]
    some = np.flatnonzero(out)
    out[some] = twice[np.minimum(np.searchsorted(twice, keys[some]), len(twice) - 1)] == keys[some]
    return out


def measure(texts: Texts, lengths: list[int]) -> dict[str, np.ndarray]:
    """Counts of each text: words, characters, symbols, duplicated lines, words and characters in repeated n-grams."""
    texts.find_words(PLAIN_WORD)
    texts.find_lines()
    n, doc = texts.n, texts.doc
    chars = texts.points(texts.starts, texts.ends)
    out = {
        "n_words": np.diff(texts.first),
        "word_chars": np.bincount(doc, chars, n).astype(np.int64),
        "n_symbols": texts.count(SYMBOLS, texts.offsets[:-1], texts.offsets[1:]),
    }
    own = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    spoken = np.searchsorted(texts.starts, texts.line_ends) > np.searchsorted(texts.starts, texts.line_starts)
    starts, ends, line_doc = texts.line_starts[spoken], texts.line_ends[spoken], texts.line_doc[spoken]
    keys = texts.span_hash(starts, ends) ^ own[line_doc]
    order = np.argsort(keys, kind="stable")
    later = order[1:][keys[order][1:] == keys[order][:-1]]
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    twice = repeated(keys)
    line_chars = np.zeros(len(texts.starts) + 1, np.int64)
    np.cumsum(chars, out=line_chars[1:])
    inside = line_chars[np.searchsorted(texts.starts, ends)] - line_chars[np.searchsorted(texts.starts, starts)]
    out["dup_line_chars"] = np.bincount(line_doc[twice], inside[twice], n).astype(np.int64)

    sums = gram_sums(texts.word_hash())
    for size in lengths:
        windows = grams(sums, size)
        whole = np.flatnonzero(doc[: len(windows)] == doc[size - 1 :]) if len(windows) else np.zeros(0, np.int64)
        found = whole[repeated(windows[whole] ^ own[doc[whole]])]
        marked = covered(len(doc), found, size)
        out[f"words_{size}"] = np.bincount(doc[marked], minlength=n)
        out[f"chars_{size}"] = np.bincount(doc[marked], chars[marked], n).astype(np.int64)
    return out


def repetition_quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Base counts, duplicated characters and a verdict for each row of ``docs`` (doc_id, text).

    A null or empty text has no words, so it fails the base rule; a text shorter than an n-gram has none of that
    length. Rows that repeat a doc_id are each judged alone. Other columns are not read. An empty table gives an
    empty result.
    """
    lengths = sorted({3, *limits.gram_percent})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                m = measure(Texts(rows.column("text")), lengths)
                failed = (m["n_words"] < limits.min_words) | (100 * m["words_3"] > limits.repeat_percent * m["n_words"])
                bad = 100 * m["dup_line_chars"] > limits.line_percent * m["word_chars"]
                for size, percent in limits.gram_percent.items():
                    bad |= 100 * m[f"chars_{size}"] > percent * m["word_chars"]
                wide = np.stack([m[f"chars_{size}"] for size in sorted(limits.gram_percent)], axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, wide.size + 1, wide.shape[1], dtype=np.int32), pa.array(wide.ravel()))
                longs = [pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "words_3", "dup_line_chars")]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *longs, lists, pa.array(failed), pa.array(~failed & ~bad)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "gram_chars", "base_failed", "kept"],
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(judge, SCHEMA)
