"""Vector codes of a few bytes: product quantisation in exact integers, fitted by rounds over all rows.

Components become floors of `scale` times their value. A vector is cut into equal consecutive parts, and each part
is coded by the index of its nearest codebook entry (squared distance, first of equals). The distances need
inner products of all parts with all entries: both are split into limbs of `LIMB_BITS` bits, the limbs are
multiplied as float64 matrices, whose sums stay below 2 ** 53 and are therefore exact, and the products are put
together again as 64-bit integers. Sums per entry are products with the matrix of assignments, exact likewise.

A round is one pass of Spark over the stored integers: a task sends counts and sums per entry, Spark adds them up,
and the driver sees one row per entry and component, whatever the number of rows.

Defined results. Vectors that are null or hold null or non-finite components take no part; shorter ones are filled with
zeros, and lengths up to a multiple of the number of parts. Rows without id are coded but start no entry. Repeated
rows count as often as they stand; rows of equal id are ordered by their components. Fewer rows than entries give
fewer entries. An empty table gives no rows. Other columns, whatever their names, are left out. Components that are
so large that exact sums of squares would not fit a long are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.llm.storage import stored
from surveyframe.llm.vectors import check_range, extent, floored, packed, unpacked, usable

LIMB_BITS = 15
#: Rows multiplied at a time.
BLOCK_ROWS = 4096


def limbs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low limb as float64: values == high * 2 ** LIMB_BITS + low, with 0 <= low < 2 ** LIMB_BITS."""
    high = values >> LIMB_BITS
    return high.astype(np.float64), (values - (high << LIMB_BITS)).astype(np.float64)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact 64-bit integers, for components below 2 ** 29: float64 products stay below 2 ** 53."""
    if a.shape[1] > 1 << (53 - 2 * LIMB_BITS):
        raise ValueError("too many components for exact limb products")
    ah, al = limbs(a)
    bh, bl = limbs(b)
    high = (ah @ bh.T).astype(np.int64)
    mid = (ah @ bl.T).astype(np.int64) + (al @ bh.T).astype(np.int64)
    low = (al @ bl.T).astype(np.int64)
    return (high << (2 * LIMB_BITS)) + (mid << LIMB_BITS) + low


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the first of equals, and the squared distance to it."""
    rest = (entries * entries).sum(axis=1)[None, :] - 2 * exact_products(part, entries)
    index = rest.argmin(axis=1)
    return index, rest[np.arange(len(part)), index] + (part * part).sum(axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, unpacked(part.column("v"), length)


def _sums(rows: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """(slot, at, n, total): per entry and component, over all rows; slot = part * entries + entry."""
    parts, k, width = books.shape

    def run(batches):
        counts = np.zeros((parts, k), dtype=np.int64)
        totals = np.zeros((parts, k, width), dtype=np.int64)
        for _, values in _blocks(batches, length):
            for p in range(parts):
                part = values[:, p * width : (p + 1) * width]
                index, _ = nearest(part, books[p])
                one = np.zeros((k, len(part)))
                one[index, np.arange(len(part))] = 1.0
                counts[p] += np.bincount(index, minlength=k)
                totals[p] += (one @ part.astype(np.float64)).astype(np.int64)
        slot = np.flatnonzero(counts.ravel())
        if len(slot):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(counts.ravel()[slot]), pa.array(list(totals.reshape(-1, width)[slot]), pa.list_(pa.int64()))],
                names=["slot", "n", "totals"],
            )

    sent = rows.mapInArrow(run, "slot long, n long, totals array<long>")
    wide = sent.select("slot", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("totals").alias("at", "total"))
    return wide.groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def integers(vectors: DataFrame, scale: int, parts: int) -> tuple[DataFrame, int]:
    """Stored rows (vec_id, label, v) of all usable vectors, v packed, and the padded length."""
    kept = usable(vectors.select("vec_id", "label", F.col("embedding").alias("e")), "e")
    length, top = extent(kept, "e")
    length = max(1, -(-length // parts)) * parts
    check_range(top, scale, length)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), packed(floored(batch.column("e"), scale, length))], names=["vec_id", "label", "v"]
            )

    kinds = dict(kept.dtypes)
    return stored(kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary")), length


def fit_codebooks(rows: DataFrame, length: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component): start from the rows of smallest id, then means of what is nearest, floored."""
    width = length // parts

    def order(batches):  # components as a list, whose order is that of the numbers
        for batch in batches:
            values = unpacked(batch.column("v"), length)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(values), pa.list_(pa.int64()))], names=["vec_id", "c"])

    named = rows.where(F.col("vec_id").isNotNull())
    bound = named.select("vec_id").orderBy("vec_id").limit(entries).agg(F.max("vec_id").alias("m")).first()["m"]
    if bound is None:
        return np.zeros((parts, 0, width), dtype=np.int64)
    kind = dict(rows.dtypes)["vec_id"]
    first = named.where(F.col("vec_id") <= bound).mapInArrow(order, f"vec_id {kind}, c array<long>").orderBy("vec_id", "c").limit(entries).collect()
    seeds = np.array([row["c"] for row in first], dtype=np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        fresh = books.copy().reshape(-1, width)
        for row in _sums(rows, books, length).collect():  # one row per entry and component, in one job
            fresh[row["slot"], row["at"]] = int(row["total"]) // int(row["n"])
        books = fresh.reshape(books.shape)
    return books


def encode(rows: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    parts, k, width = books.shape
    hexes = np.array([f"{i:02x}" for i in range(k)])

    def run(batches):
        for block, values in _blocks(batches, length):
            code, error = np.full(len(values), "", dtype=object), np.zeros(len(values), dtype=np.int64)
            for p in range(parts):
                index, distance = nearest(values[:, p * width : (p + 1) * width], books[p])
                code = code + hexes[index].astype(object)
                error += distance
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id"), block.column("label"), pa.array(code, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(
    vectors: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6
) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code, error) of all usable vectors, and the codebooks (part, entry, component)."""
    if entries > 256:
        raise ValueError("two hex digits name up to 256 entries")
    rows, length = integers(vectors, scale, parts)
    books = fit_codebooks(rows, length, parts, entries, rounds)
    if not books.shape[1]:  # no row has an id: nothing to start from
        return encode(rows.limit(0), np.zeros((parts, 1, length // parts), dtype=np.int64), length), books
    return encode(rows, books, length), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def code_report(vectors: DataFrame) -> DataFrame:
    """Codes with the error per row, the error of all rows of the same label, and a digest of the codebooks."""
    codes, books = compress(vectors)
    codes = stored(codes)
    by_label = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
