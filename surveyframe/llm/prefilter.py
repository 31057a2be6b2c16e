"""Drop rows that cannot join before their texts are shuffled.

A bitmap of fixed size (2 ** FILTER_BITS bits, 2 MB) holds the hashed ids of the small side, whatever its
length, so it may be broadcast. It lets through all wanted rows and some others; the exact join follows. With
very many ids it lets through everything and the join is as it was.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 24
_BLOCK = 1 << 15


def _slot(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of the ids' slots; gathered as blocks of distinct slots."""

    def pack(key, table):
        bits = np.zeros(_BLOCK, dtype=np.uint8)
        bits[table["at"].to_numpy()] = 1
        return pa.table({"block": [key[0].as_py()], "bits": [np.packbits(bits).tobytes()]})

    slots = ids.where(F.col(column).isNotNull()).select(_slot(column).alias("slot")).distinct()
    blocks = slots.select(F.floor(F.col("slot") / _BLOCK).alias("block"), F.pmod("slot", F.lit(_BLOCK)).alias("at"))
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in blocks.groupBy("block").applyInArrow(pack, "block long, bits binary").toLocalIterator():
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        out[row["block"] * len(part) : (row["block"] + 1) * len(part)] = part
    return out


def likely_members(docs: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows of `docs` whose `column` may be among the ids; columns as they are."""
    return split_members(docs, column, ids, id_column)[0]


def split_members(docs: DataFrame, column: str, ids: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` whose `column` may be among the ids, and the others; columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(id_bitmap(ids, id_column))
    names = docs.columns

    def take(likely):
        def run(batches):
            bits = shared.value
            for batch in batches:
                slot = batch.column("likely_slot").to_numpy()
                keep = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
                yield batch.select(names).filter(pa.array(keep == likely))

        return docs.withColumn("likely_slot", _slot(column)).mapInArrow(run, docs.schema)

    return take(True), take(False)
