"""Near copies by exact Jaccard similarity of five-word shingles, looked for by covering simhash first.

Texts whose five-word fingerprints meet in the covering tables, and those that meet in a bucket's first text, are compared
first; what that connects needs no more. The rest is found without loss: two sets with a similarity of 0.8 or more share one of the first fifth of their shingles, plus one, in any order that
is the same for all texts. So texts meet under those shingles only, no pair is missed, and whatever meets is compared
whole, but for pairs that their sketches rule out: the parities of hashed shingles differ in no more bits than the sets do
in shingles, so a pair with too many differing bits cannot reach 0.8. The order is that of the hashes, but for the shingles that are most often met in texts that are read together:
these come last, by how often, so that a passage of very many texts brings few of them together. What comes last is also
dealt out over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.llm import covering_simhash
from testimony.llm.components import connected_components
from testimony.llm.textbatch import PLAIN_WORD, Texts, gram_sums, grams, groups

SHINGLE = 5
#: So many shingles at most come last in the order; their rows are dealt over so many tasks each.
COMMON, DEALT = 1 << 17, 16
#: Bits of the filter that tells which texts are compared (a megabyte).
BITS = 1 << 23
#: Longs of the sketch that stands beside a bucket's rows; the whole one has about a bit for each shingle.
BRIEF = 8
#: Rounds at most in which a bucket's members are held against one of them each time, before all that is left is compared;
#: they end when at most so many pairs are left for each row, or less than one of so many that are compared is linked.
TURNS, LEFT, FRUIT = 4, 2, 20

#: Two sets of these sizes can have a similarity of 0.8.
_SIZED = "greatest({0}, {1}) * 4 <= least({0}, {1}) * 5"
#: Two sets whose first common shingle stands at these places can: what follows is all that they can still share.
_REACHES = "9 * least({0} - {1}, {2} - {3}) >= 4 * ({0} + {2})"
#: Two sets with these brief sketches can.
_BRIEFLY = "9 * (" + " + ".join(f"bit_count({{2}}[{i}] ^ {{3}}[{i}])" for i in range(BRIEF)) + ") <= {0} + {1}"
#: The same by whole sketches, one of which may be twice as long: then its halves are laid over each other.
_HALVED = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"
_ALIKE = f"9 * aggregate(zip_with({_HALVED.format('{2}', '{3}')}, {_HALVED.format('{3}', '{2}')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {{0}} + {{1}}"


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the different shingles of each text, ASCII letters lowered; a shorter text is one shingle."""
    texts = Texts(column, lower=True)
    texts.find_words(PLAIN_WORD)
    words = np.diff(texts.first)
    sums = gram_sums(texts.word_hash())
    local = np.arange(len(texts.starts)) - texts.first[:-1][texts.doc]
    at = np.flatnonzero(local + size <= words[texts.doc])
    docs, hashes = [texts.doc[at]], [grams(sums, size, at)]
    for n in range(1, size):
        few = np.flatnonzero(words == n)
        docs.append(few)
        hashes.append(grams(sums, n, texts.first[few]))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _nodes(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingle of each of n texts (n + 1 entries), and a hash of its set."""
    first = np.searchsorted(doc, np.arange(n + 1))
    return first, np.array([xxhash.xxh64_intdigest(value[s:e].tobytes(), 7) for s, e in zip(first[:-1], first[1:], strict=True)], np.uint64)


def _sketches(doc: np.ndarray, value: np.ndarray, longs: np.ndarray) -> pa.ListArray:
    """For each text the parities of the shingles that fall on each of so many longs' bits; longs are powers of two."""
    begins = np.concatenate([[0], np.cumsum(longs)])
    bit = begins[doc] * 64 + (value & (longs[doc] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=int(begins[-1]) * 64) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view("<i8")))


def _rows(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, size, fp, sketch, brief) of every text, the latter four once for a node of the texts read together, and
    (key, n) of the shingles that several of these have."""
    for batch in batches:
        for rows in groups(batch):
            doc, value = shingle_sets(rows.column("text"))
            first, node = _nodes(doc, value, rows.num_rows)
            n, size = rows.num_rows, np.diff(first)
            _, one = np.unique(node, return_index=True)
            of = np.zeros(n, bool)
            of[one] = True
            held = np.flatnonzero(of)
            at = of[doc]
            own = (np.cumsum(of) - 1)[doc[at]]
            longs = np.maximum(BRIEF, 1 << np.ceil(np.log2(np.maximum(size[held], 1) / 64)).clip(0).astype(np.int64))
            fps = np.array([covering_simhash.fingerprint((rows.column("text")[int(i)].as_py() or "").encode(), SHINGLE) for i in held], np.uint64)
            parts = [fps.view(np.int64), size[held].astype(np.int32), _sketches(own, value[at], longs), _sketches(own, value[at], np.full(len(held), BRIEF))]
            place = pa.array(np.cumsum(of) - 1, mask=~of)
            fp, size, sketch, brief = [(x if isinstance(x, pa.Array) else pa.array(x)).take(place) for x in parts]
            none = pa.nulls(n, pa.int64())
            yield _rows(doc_id=rows.column("doc_id"), node=node.view(np.int64), size=size, fp=fp, sketch=sketch, brief=brief, key=none, n=none)
            inorder = np.sort(value[at])
            begins = np.flatnonzero(np.concatenate([[True], inorder[1:] != inorder[:-1]])) if len(inorder) else np.zeros(0, np.int64)
            times = np.diff(begins, append=len(inorder))
            many = times > 1
            none, no_list = pa.nulls(int(many.sum()), pa.int64()), pa.nulls(int(many.sum()), pa.list_(pa.int64()))
            key, times = inorder[begins[many]].view(np.int64), times[many].astype(np.int64)
            yield _rows(doc_id=none, node=none, size=none.cast(pa.int32()), fp=none, sketch=no_list, brief=no_list, key=key, n=times)


def _sets(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """(node, held) of the texts whose doc_id has its bit set."""
    for batch in batches:
        bit = np.asarray(batch.column("doc_id")) % BITS
        asked = (wanted.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)
        for rows in groups(batch.filter(pa.array(asked.astype(bool)))):
            doc, value = shingle_sets(rows.column("text"))
            first, node = _nodes(doc, value, rows.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), lists], ["node", "held"])


def _keys(batches: Iterator[pa.RecordBatch], common: Broadcast) -> Iterator[pa.RecordBatch]:
    """(key, deal, node, size, place) for the first fifth of the shingles of each set, plus one; each set once a task. ``deal`` is
    -1 but for common shingles."""
    last, rank = common.value
    seen: set[int] = set()
    for batch in batches:
        for rows in groups(batch):
            doc, value = shingle_sets(rows.column("text"))
            first, node = _nodes(doc, value, rows.num_rows)
            new = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
            if len(last):
                at = np.minimum(np.searchsorted(last, value), len(last) - 1)
                late = np.where(last[at] == value, rank[at], 0)
                order = np.lexsort((value, late, doc))
                value, late = value[order], late[order]
            else:
                late = np.zeros(len(value), np.int64)
            size = np.diff(first)
            place = np.arange(len(doc)) - first[:-1][doc]
            kept = np.flatnonzero((place <= size[doc] // 5) & new[doc])
            of = doc[kept]
            deal = np.where(late[kept] > 0, (node[of] % np.uint64(DEALT)).astype(np.int64), -1)
            yield _rows(key=value[kept].view(np.int64), deal=deal.astype(np.int32), node=node[of].view(np.int64), size=size[of].astype(np.int32), place=place[kept].astype(np.int32))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, deal, node), each once: those of keys that several nodes have, and all of common keys, with the
    first node of their (key, deal), its size and its place. Holds one batch and one row."""
    before, head, told = None, None, False  # the last row, the first row of its key, whether that is out
    names = ["key", "deal", "node", "size", "place"]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)).astype(np.int64) for c in names]
        if before is not None:
            columns = [np.concatenate([[x], c]) for x, c in zip(before, columns, strict=True)]
        key, deal, node = columns[:3]
        begins = np.ones(len(key), bool)
        begins[1:] = (key[1:] != key[:-1]) | (deal[1:] != deal[:-1])
        new = begins.copy()
        new[1:] |= node[1:] != node[:-1]
        starts = np.flatnonzero(begins)
        start = starts[np.cumsum(begins) - 1]
        first, first_size, first_place = node[start], columns[3][start], columns[4][start]
        if before is not None:
            new[0] = begins[0] = False
            own = start == 0
            first[own], first_size[own], first_place[own] = head
        # A first row goes out with the second one of its key, or alone where its key is common.
        follows = new & ~begins
        out = follows.copy()
        out[start[follows]] = True
        out |= begins & (deal >= 0)
        if before is not None:
            out[0] = not told and bool(follows[start == 0].any())
        some = np.flatnonzero(out)
        yield _rows(**{c: x[some] for c, x in zip(names, columns, strict=True)}, first=first[some], first_size=first_size[some], first_place=first_place[some])
        last = len(key) - 1
        same = start == start[last]
        told = bool(out[same].any()) or (told and start[last] == 0)
        # Where the key goes on, its first row stands for it: it is what must still go out.
        before = [c[last] if told else c[start[last]] for c in columns]
        head = (first[last], first_size[last], first_place[last])


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a similarity of 0.8 or more."""
    asked = cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "near-asked")
    told = asked.select("node", "size", "sketch")
    sized = pairs.join(told.toDF("a", "m", "p"), "a").join(told.toDF("b", "n", "q"), "b").where(_SIZED.format("m", "n"))
    pairs = cut(sized.where(_ALIKE.format("m", "n", "p", "q")).select("a", "b"), "near-alike")
    need = cut(asked.select("node", "first_id").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "near-needed")
    wanted = docs.sparkSession.sparkContext.broadcast(_bits(need))
    sets = docs.mapInArrow(lambda it: _sets(it, wanted), "node long, held array<long>")
    sets = cut(sets.join(need.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    # Row by row in the JVM: no batch of sets is held.
    return cut(both.where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b"), "near-links")


def _met_by_simhash(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes that span what is linked by covering simhash: one pair less than a group has nodes, for each bucket at most."""
    one = cut(nodes.groupBy("fp").agg(F.min("node").alias("one"), F.max("node").alias("last")), "near-fingerprints")
    same = nodes.select("fp", "node").join(one.where("one <> last"), "fp").where("node <> one").selectExpr("one as a", "node as b")
    links = cut(covering_simhash.near_links(one.select("fp")), "near-simhash")
    names = one.select("fp", "one")
    linked = links.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(linked)


def _parted(rows: DataFrame, parts: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows of keys that hold several parts, with theirs; how many, and how many pairs across parts they make."""
    placed = cut(rows.join(parts, "node", "left").select("key", "node", "size", "place", F.coalesce("component", "node").alias("part")), "near-placed")
    shares = placed.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    mixed = cut(shares.where("n * n > own"), "near-mixed")
    count, pairs = mixed.agg(F.sum("n"), F.expr("sum((n * n - own) div 2)")).first()
    return cut(placed.join(mixed.select("key"), "key"), "near-open"), count or 0, pairs or 0


def _bits(need: DataFrame) -> np.ndarray:
    """BITS bits, with that of each first_id set: which texts to read again, and some more, without moving any."""
    bit = need.select(F.expr(f"pmod(first_id, {BITS}L)").alias("bit"))
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[np.asarray(words.column("word")).astype(np.int64)] = np.asarray(words.column("bits")).astype(np.int64).view(np.uint64)
    return out


def _common(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON shingles met most often, ascending, and their ranks from 1 on."""
    top = told.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    key, n = np.asarray(top.column("key")).astype(np.int64).view(np.uint64), np.asarray(top.column("n")).astype(np.int64)
    rank = np.empty(len(key), np.int64)
    rank[np.lexsort((key, n))] = np.arange(1, len(key) + 1)
    order = np.argsort(key)
    return key[order], rank[order]


def near_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row with a doc_id, and (node, first_id, component_id) of each different shingle set.

    Texts meet as different shingle sets, so copies are one node; those without words are one as well. component_id is
    the smallest doc_id reachable over pairs with a similarity of 0.8 or more. What meets in the covering tables is
    compared first, and members of a bucket with one of them, with another one each round while buckets hold many pairs of
    different parts; what is connected after that needs no more, and of the rest those pairs are compared that can still
    reach 0.8 where the shingle is the first that they share.
    """
    spark = docs.sparkSession
    keyed = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").where("doc_id is not null")
    told = cut(keyed.mapInArrow(_signed, "doc_id long, node long, size int, fp long, sketch array<long>, brief array<long>, key long, n long"), "near-signed")
    signed = told.where("key is null").select("doc_id", "node")
    # Texts of one node differ at most in what its fingerprint counts twice.
    one = [F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), *[F.first(c, ignorenulls=True).alias(c) for c in ("size", "sketch", "brief")]]
    nodes = cut(told.where("key is null").groupBy("node").agg(*one), "near-nodes")
    common = spark.sparkContext.broadcast(_common(told))  # COMMON rows at most
    met = keyed.mapInArrow(lambda it: _keys(it, common), "key long, deal int, node long, size int, place int")
    dealt = met.repartition("key", "deal").sortWithinPartitions("key", "deal", "node")
    shared = cut(dealt.mapInArrow(_shared, "key long, deal long, node long, size long, place long, first long, first_size long, first_place long"), "near-buckets")
    within = shared.where("node <> first").select("first", "node", "first_size", "size", "first_place", "place")
    # The first nodes of a common key's deals meet the least of them.
    firsts = cut(shared.where("deal >= 0").select("key", "first", "first_size", "first_place").distinct(), "near-firsts")
    least = cut(firsts.groupBy("key").agg(F.min(F.struct("first", "first_size", "first_place")).alias("least")), "near-least")
    others = firsts.select("key", F.col("first").alias("node"), F.col("first_size").alias("size"), F.col("first_place").alias("place"))
    among = others.join(least, "key").select("least.first", "node", "least.first_size", "size", "least.first_place", "place")
    # A pair that cannot reach 0.8 if this shingle is the first that it shares meets at an earlier one, or is none.
    sized = within.union(among).where("node <> first").where(_SIZED.format("size", "first_size")).where(_REACHES.format("size", "place", "first_size", "first_place"))
    stars = sized.select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    tried = cut(stars.union(_met_by_simhash(nodes)).distinct(), "near-stars")
    links = _confirmed(tried, nodes, keyed)
    parts = cut(connected_components(links), "near-parts")
    open_, count, pairs = _parted(shared, parts)
    for turn in range(TURNS):
        if pairs <= LEFT * count:
            break
        # Another member each time, the same one in all buckets that hold it.
        head = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node", "size", "place", "part")).alias("head")
        heads = cut(open_.groupBy("key").agg(head).select("key", F.col("head.node").alias("first"), *[F.col(f"head.{c}").alias(f"first_{c}") for c in ("size", "place", "part")]), "near-heads")
        can_meet = "part <> first_part and " + _REACHES.format("size", "place", "first_size", "first_place")
        met = open_.join(heads, "key").where(can_meet).where(_SIZED.format("size", "first_size"))
        met = cut(met.select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct(), "near-met")
        found = _confirmed(met, nodes, keyed)
        tried, links = tried.union(met), links.union(found)
        parts = cut(connected_components(links), "near-parts")
        open_, count, pairs = _parted(open_, parts)
        if FRUIT * found.count() < met.count():
            break
    briefed = cut(open_.join(nodes.select("node", "brief"), "node").select("key", "node", "size", "place", "part", "brief"), "near-briefed")
    other = briefed.toDF("key", "other", "other_size", "other_place", "other_part", "other_brief")
    can_meet = "part <> other_part and node < other and " + _REACHES.format("size", "place", "other_size", "other_place")
    rest = briefed.join(other, "key").where(_SIZED.format("size", "other_size")).where(can_meet).where(_BRIEFLY.format("size", "other_size", "brief", "other_brief"))
    rest = rest.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"), "near-rest")
    parts = connected_components(links.union(_confirmed(rest, nodes, keyed)))
    grouped = cut(nodes.select("node", "first_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-grouped")
    least = cut(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "near-least")
    return signed, grouped.join(least, "component").select("node", "first_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their group; all columns, in their order. Rows without a doc_id
    stay. Of rows that repeat a kept doc_id all stay where they are in the same group."""
    signed, named = near_groups(docs)
    gone = signed.join(named, "node").where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
