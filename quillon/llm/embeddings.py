"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Vectors are scaled to length one in double precision. Equal vectors are one node from the
start. The vectors of a tile are quantised to int8, and the length of each one's quantisation
error is kept. For two vectors x = x' + e and y = y' + f the product x'y' is exact in integers,
and |xy - x'y'| <= |x'||f| + |e||y'| + |e||f|. A tile's product is first compared with the
bound of the largest errors, then with each pair's own; only the pairs that are left are
computed in full precision.

Vectors are put in tiles with near ones (by the nearest of some pivot vectors). A tile keeps
its centre and radius; a pair of tiles that the triangle inequality on angles shows to hold no
link isn't compared. Tiles are sent to the remaining pairs by key and each pair is one task's
product. It emits the number of links of each vector and a spanning forest of its links, at
most one row a vector, however many links there are.

Defined results: a vector that is null, zero, of another length than most, or holds a null or
non-finite component links with nothing; a null vec_id has no links and no component; repeated
rows with one vec_id are one vector each and count as links; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written
from quillon.llm.components import components, local_forest

#: Vectors in a tile, those of a product at once, and pivots at most.
TILE, PART, PIVOTS = 4096, 1024, 2048
#: Bytes of tiles' centres that are sent out at once.
CENTRES = 32 << 20
#: Bound on rounding in double precision, far above what 64 or 4096 products can add up.
SLACK = 1e-9


def unit_rows(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are good vectors, those scaled to length one)."""
    values, good = [], []
    for i, v in enumerate(column.to_pylist()):
        if not v or width is not None and len(v) != width or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        size = np.abs(x).max()
        if np.isfinite(x).all() and size > 0:
            x /= size
            values.append(x / np.sqrt((x * x).sum()))
            good.append(i)
    return np.array(good, np.int64), np.array(values).reshape(len(good), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 rows, their scale, and the error length of each: x = scale * q + error."""
    scale = float(np.abs(x).max()) / 127 if x.size else 1.0
    q = np.rint(x / scale).astype(np.int8)
    error = np.sqrt(((x - q * scale) ** 2).sum(axis=1)) * (1 + 1e-12)
    return q, scale, error


def part_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) with product >= threshold, those of PART rows on either side at once; i < j if
    both are one tile."""
    if not len(x) or not len(y):
        return
    q, s, e = quantise(x)
    r, t, f = quantise(y)
    # Sums of int8 products are exact in float32 below 2**24, which 1040 components can't reach.
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    q, r = q.astype(kind), r.astype(kind)
    # Quantised vectors are as long as the vector and its error together at most.
    worst = (1 + e.max()) * f.max() + e.max() * (1 + 2 * f.max())
    least = kind((threshold - worst - SLACK) / (s * t)) - kind(1)
    for a in range(0, len(x), PART):
        for b in range(a - a % PART if same else 0, len(y), PART):
            product = q[a : a + PART] @ r[b : b + PART].T
            i, j = np.divmod(np.flatnonzero(product.reshape(-1) >= least).astype(np.int32), np.int32(product.shape[1]))
            exact = product[i, j].astype(np.float64) * (s * t)
            i, j = i + a, j + b
            near = exact + (1 + e[i]) * f[j] + e[i] * (1 + 2 * f[j]) >= threshold - SLACK
            if same:
                near &= i < j
            i, j = i[near], j[near]
            keep = np.zeros(len(i), bool)
            for c in range(0, len(i), 1 << 16):
                d = slice(c, c + (1 << 16))
                keep[d] = np.einsum("ij,ij->i", x[i[d]], y[j[d]]) >= threshold
            if keep.any():
                yield i[keep], j[keep]


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """part_links() of whole tiles, for tiles with few links."""
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip((none, none), *part_links(x, y, threshold, same)))


def vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, unit (doubles as bytes) of the rows that can link."""
    sizes = rows.select(F.size(vector_column).alias("n")).filter("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    width = sizes["n"] if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, unit = unit_rows(batch.column("vector"), width)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), pa.array([v.tobytes() for v in unit], pa.binary())], ["id", "unit"])

    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).filter("id is not null and vector is not null").mapInArrow(run, "id long, unit binary")


def matrix(column: pa.Array) -> np.ndarray:
    data = [v.as_buffer() for v in column]
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1) if data else np.zeros((0, 0))


TILE_SCHEMA = "tile string, n int, ids binary, units binary, copies binary, centre binary, radius double"


def tiles(classes: DataFrame, pivots: np.ndarray, tile: int, salts: int) -> DataFrame:
    """Classes (rep, unit, copies) dealt to tiles of near vectors."""
    spark = classes.sparkSession
    sent = spark.sparkContext.broadcast(pivots)  # PIVOTS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (matrix(batch.column("unit")) @ sent.value.T).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "cell"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, cell = TaskContext.get().partitionId(), 0, None
        ids, units, copies = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, units, copies
            x = np.concatenate(units)
            centre = x.sum(axis=0)
            length = np.sqrt((centre * centre).sum())
            centre = centre / length if length > 0 else x[0]
            radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
            values = [[f"{part}-{number}"], [len(x)], [np.concatenate(ids).tobytes()], [x.tobytes()], [np.concatenate(copies).tobytes()], [centre.tobytes()], [radius]]
            number, ids, units, copies = number + 1, [], [], []
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["tile", "n", "ids", "units", "copies", "centre", "radius"])

        held = 0
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1 if len(cells) else 0))
            for a, b in zip(edges, np.append(edges[1:], len(cells))):
                if cells[a] != cell and held:
                    yield flush()
                    held = 0
                cell = cells[a]
                while a < b:
                    part_ = batch.slice(a, min(tile - held, b - a))
                    ids.append(part_.column("rep").to_numpy())
                    units.append(matrix(part_.column("unit")))
                    copies.append(part_.column("copies").to_numpy())
                    held += part_.num_rows
                    a += part_.num_rows
                    if held == tile:
                        yield flush()
                        held = 0
        if held:
            yield flush()

    dealt = classes.select("rep", "unit", "copies").mapInArrow(assign, "rep long, unit binary, copies long, cell int")
    # A cell is dealt to more tasks the more vectors there are, as one cell may hold many.
    salt = F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.withColumn("salt", salt).repartition(count, "cell", "salt").sortWithinPartitions("cell", "salt", "rep").select("rep", "unit", "copies", "cell").mapInArrow(cut, TILE_SCHEMA)


def pairs_of_tiles(made: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a <= b: pairs of tiles that may hold a link.

    Tile summaries, not vectors, meet here: each tile is tested against all tiles' centres and
    radii, which are sent out in blocks of bounded size, one after the other.
    """
    angle = float(np.arccos(threshold)) + 1e-7
    summary = made.select("tile", "centre", "radius")
    spark = made.sparkSession
    size = made.agg(F.count("*").alias("n"), F.max(F.octet_length("centre")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] * ((size["bytes"] or 0) + 64) // CENTRES))
    out = None
    for k in range(blocks):
        part = summary.filter(F.pmod(F.xxhash64("tile"), F.lit(blocks)) == k).collect()
        if not part:
            continue
        names = [r["tile"] for r in part]
        sent = spark.sparkContext.broadcast((names, np.frombuffer(b"".join(bytes(r["centre"]) for r in part), np.float64).reshape(len(part), -1), np.array([r["radius"] for r in part])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, centres, radii = sent.value
            for batch in batches:
                own = matrix(batch.column("centre"))
                for i, (name, radius) in enumerate(zip(batch.column("tile").to_pylist(), batch.column("radius").to_pylist())):
                    apart = np.arccos(np.clip(centres @ own[i], -1, 1)) - radii - radius
                    others = [names[j] for j in np.flatnonzero(apart <= angle) if names[j] >= name]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(others), pa.string()), pa.array(others, pa.string())], ["a", "b"])

        found = written(summary.mapInArrow(run, "a string, b string"))
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "a string, b string")


RESULT = "kind int, a long, b long"


def compare(pairs: DataFrame, made: DataFrame, threshold: float) -> DataFrame:
    """kind 0: vector class a has b links to others; kind 1: a forest link (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                same = row["a"] == row["b"]
                ids = [np.frombuffer(row[f"ids_{c}"], np.int64) for c in "ab"]
                units = [np.frombuffer(row[f"units_{c}"], np.float64).reshape(len(i), -1) for c, i in zip("ab", ids)]
                copies = [np.frombuffer(row[f"copies_{c}"], np.int64) for c in "ab"]
                counts = [np.zeros(len(i), np.int64) for i in ids]
                forest = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for i, j in part_links(*units, threshold, same):
                    # Only sums and a forest of the links so far are held.
                    counts[0] += np.bincount(i, copies[1][j], len(ids[0])).astype(np.int64)
                    counts[1] += np.bincount(j, copies[0][i], len(ids[1])).astype(np.int64)
                    a, b = local_forest(ids[0][i], ids[1][j])
                    forest = local_forest(np.append(forest[0], a), np.append(forest[1], b))
                for own, n in zip(ids, counts):
                    yield out(0, own[n > 0], n[n > 0])
                yield out(1, *forest)

    left, right = (made.select(F.col("tile").alias(c), F.col("ids").alias(f"ids_{c}"), F.col("units").alias(f"units_{c}"), F.col("copies").alias(f"copies_{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", *(f"{n}_{c}" for c in "ab" for n in ("ids", "units", "copies")))
    return joined.mapInArrow(run, RESULT)


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = rows.sparkSession
    good = written(vectors(rows, id_column, vector_column))
    classes = written(good.groupBy("unit").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    count = classes.count()
    # Pivots are vectors with the least hash; any choice gives the same links.
    chosen = classes.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(min(PIVOTS, 1 + count // (2 * tile))).collect()
    pivots = np.frombuffer(b"".join(bytes(r["unit"]) for r in chosen), np.float64).reshape(len(chosen), -1) if chosen else np.zeros((1, 1))
    made = written(tiles(classes, pivots, tile, 1 + count // (len(pivots) * tile * 8)))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(compare(pairs_of_tiles(made, threshold).repartition(spread, "a", "b"), made, threshold))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("other"))
    joined = components(found.filter("kind = 1").select("a", "b")).select(F.col("id").alias("rep"), "component")
    table = classes.join(links, "rep", "left").join(joined, "rep", "left").select("unit", (F.coalesce("other", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    members = good.join(table, "unit").select("id", "n_links", "component_id")
    alone = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("_v"))
    return result(alone, members)


def result(rows: DataFrame, members: DataFrame) -> DataFrame:
    """All rows; those that can't link are alone."""
    one = members.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.join(one, rows["vec_id"] == one["id"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())
