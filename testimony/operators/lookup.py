"""Record-level evidence index, term and vector lookup, grounding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import among, cut, top_k
from testimony.functions.text import tokens

PREVIEW_CHARS = 80
#: Query vectors scored in one pass over the index.
QUERY_BLOCK = 1024
#: Cells that vectors are placed in.
CELLS = 64
#: What a bound allows for rounding to six places and for sums in another order.
SLACK = 2e-6


def evidence_index(*records: DataFrame) -> DataFrame:
    """One row per whole record; a record is never split.

    Each input has project_id, source_id, source_type, text.
    """
    every = reduce(DataFrame.unionByName, [r.select("project_id", "source_id", "source_type", "text") for r in records])
    return (
        every.withColumn("terms", tokens(F.col("text")))
        .withColumn("preview", F.substring("text", 1, PREVIEW_CHARS))
        .withColumn("record_level", F.lit(True))
        .withColumn("chunked", F.lit(False))
        .withColumn("segment_index", F.lit(0))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of a batch of queries with query_id and text."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))


def ground(results: DataFrame, records: DataFrame) -> DataFrame:
    """Results joined back to the full record, the only authoritative text. Only texts that may be results are moved."""
    hits = cut(results, "ground-hits")
    return hits.join(records.where(among(hits, "source_id")).select("source_id", "project_id", "source_type", "text"), "source_id")


def index_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.sum(F.size("terms")).cast("long").alias("term_count"),
        F.count_if("chunked").alias("chunked_count"),
    )


def fingerprints(records: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint of each project."""
    value = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256), 1, 15), 16, 10)
    return records.groupBy("project_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(value.cast("decimal(20,0)")).cast("decimal(38,0)").alias("content_sum"))


def stale_projects(current: DataFrame, built: DataFrame) -> DataFrame:
    """Projects whose inputs differ from those their index was built from."""
    return current.join(built, ["project_id", "rows", "content_sum"], "left_anti")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def vector_index(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit-length vectors, one per record."""
    norm = F.sqrt(dot(F.col(column), F.col(column)))
    out = vectors.withColumn("norm", norm)
    unit = F.transform(column, lambda x: x.cast("double") / F.col("norm"))
    return out.withColumn("unit", F.when(F.col("norm") > 0, unit)).withColumn("record_level_no_split", F.lit(True))


def _numbers(values: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).flatten()
    return np.asarray(flat, dtype=np.float64).reshape(-1, dims)


def vector_cells(index: DataFrame, cells: int = CELLS) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors by the nearest of some of them: (vec_id, unit, cell) as a written table; centres, radii and sizes of the cells.

    Centres are the ``cells`` vectors whose ids hash lowest, so they follow the data. A radius is the largest angle of a
    member to its centre.
    """
    usable = index.where(F.col("unit").isNotNull()).select("vec_id", "unit")
    top = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).select("unit").toArrow()
    if not top.num_rows:
        return usable.withColumn("cell", F.lit(0)), np.zeros((0, 1)), np.zeros(0), np.zeros(0)
    dims = len(top.column("unit")[0])
    centres = _numbers(top.column("unit"), dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.asarray(batch.column("unit").flatten(), dtype=np.float64).reshape(-1, dims) @ centres.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], ["vec_id", "unit", "cell", "angle"])

    kind = index.schema["vec_id"].dataType.simpleString()
    placed = cut(usable.mapInArrow(place, f"vec_id {kind}, unit array<double>, cell int, angle double"), "vector-cells")
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[r.cell], sizes[r.cell] = r.radius, r.n
    return placed.select("vec_id", "unit", "cell"), centres, radii, sizes


def vector_topk(index: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK, cells: int = CELLS, told: dict | None = None) -> DataFrame:
    """The k nearest records of each query vector by cosine, ties by id: (query_id, vec_id, similarity, rank).

    ``queries`` has query_id and unit and may be of any number: it is dealt in blocks of about ``block``, each of which
    travels as one matrix. No record of a cell is nearer to a query than the angle to the cell's centre less its radius.
    So the most promising cells of each query are read first, and after that those alone that could still hold one of
    the best. Scores are products of blocks of rows; each task passes on k rows of a query. ``told`` takes how many pairs
    were scored, and of how many.
    """
    placed, centres, radii, sizes = vector_cells(index, cells)
    schema = f"query_no int, vec_id {index.schema['vec_id'].dataType.simpleString()}, similarity double"
    dims, blocks = centres.shape[1], queries.count() // block + 1
    found, scored, pairs = None, 0.0, 0.0
    for number in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select("query_id", "unit").toArrow()
        if not part.num_rows or not len(centres):
            continue
        asked = _numbers(part.column("unit"), dims)
        angle = np.arccos(np.clip(asked @ centres.T / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300), -1, 1))
        best = np.linalg.norm(asked, axis=1, keepdims=True) * np.cos(np.maximum(angle - radii, 0)) + SLACK
        order = np.argsort(-best, axis=1, kind="stable")
        ahead = np.cumsum(sizes[order], axis=1) - sizes[order]
        first = np.zeros(best.shape, bool)
        np.put_along_axis(first, order, ahead < k, axis=1)

        def look(batches: Iterator[pa.RecordBatch], open_: np.ndarray, asked: np.ndarray = asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = np.asarray(batch.column("cell"))
                unit = np.asarray(batch.column("unit").flatten(), dtype=np.float64).reshape(-1, dims)
                for c in np.unique(cell):
                    rows, qs = np.flatnonzero(cell == c), np.flatnonzero(open_[:, c])
                    if not len(qs):
                        continue
                    ids = batch.column("vec_id").take(pa.array(rows))
                    _, rank = np.unique(np.asarray(ids.to_pylist()), return_inverse=True)
                    near = np.round(asked[qs] @ unit[rows].T, 6)
                    for i, q in enumerate(qs):
                        some = np.lexsort((rank, -near[i]))[:k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q, np.int32)), ids.take(pa.array(some)), pa.array(near[i][some])], ["query_no", "vec_id", "similarity"])

        def scan(open_: np.ndarray, look=look) -> DataFrame:
            here = np.flatnonzero(open_.any(axis=0)).tolist()
            return placed.where(F.col("cell").isin(here)).mapInArrow(lambda it: look(it, open_), schema)

        early = cut(top_k(scan(first), ["query_no"], [F.desc("similarity"), F.asc("vec_id")], k).drop("rank"), "vector-first")
        bound = np.full(len(asked), -np.inf)
        for r in early.groupBy("query_no").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).collect():
            bound[r.query_no] = r.least if r.n >= k else -np.inf
        later = ~first & (best >= bound[:, None]) & (sizes > 0)
        scored += float((first * sizes).sum() + (later * sizes).sum())
        pairs += float(len(asked) * sizes.sum())
        every = early.unionByName(scan(later)) if later.any() else early
        kind = queries.schema["query_id"].dataType.simpleString()
        names = queries.sparkSession.createDataFrame(list(enumerate(part.column("query_id").to_pylist())), f"query_no int, query_id {kind}")
        rows = top_k(every, ["query_no"], [F.desc("similarity"), F.asc("vec_id")], k).join(names, "query_no").select("query_id", "vec_id", "similarity", "rank")
        found = rows if found is None else found.unionByName(rows)
    if told is not None:
        told.update(scored=scored, pairs=pairs)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {index.schema['vec_id'].dataType.simpleString()}, similarity double, rank int")
    return found


def centroids(vectors: DataFrame, label: str, column: str = "embedding") -> DataFrame:
    """Mean direction of each label as a query vector, from exact integer sums."""
    parts = vectors.select(label, F.posexplode(column).alias("pos", "x"))
    sums = parts.groupBy(label, "pos").agg(F.sum(F.round(F.col("x").cast("double") * 1_000_000).cast("long")).alias("s"))
    grouped = sums.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("ps"))
    vec = F.transform("ps", lambda p: p["s"].cast("double"))
    out = grouped.select(F.col(label).alias("query_id"), vec.alias("v")).withColumn("n", F.sqrt(dot(F.col("v"), F.col("v"))))
    return out.where(F.col("n") > 0).select("query_id", F.transform("v", lambda x: x / F.col("n")).alias("unit"))
