"""Language identification with bit-sliced Bloom filters over byte n-grams.

Training counts every n-gram of the training texts per language in `SLICES` hashed tables of fixed size,
over all rows, with sums merged per task before the shuffle. A slot's bit for a language is set where the
language uses the slot at a rate of at least `keep` times that of the language using it most: so a slot
holds a bitmask of languages, and the AND of a gram's slots returns all languages containing it. A text
adds up one popcount per language, from which the share expected from false positives (the product of
the slices' fill rates) is taken off; the largest corrected count decides, ties to the first name in order.

The score is the winner's part of the sum of corrected counts. Null texts and texts without a letter are
`und` with score 0. A text with letters but no known gram gets the language with most training text and
score 0. The filters take 2 ** SLOT_BITS slots per slice, whatever the input, one 64-bit word per 64
languages; only they travel through the driver.

Training rows are those whose crc32(doc_id as text) mod 4 is not 2 and whose language is not null. Where
there is none, every document is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.llm import words as W

SLOT_BITS = 16
SLICES = 2
GRAMS = (3, 4)
_BLOCK = 1 << 12
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)

_NORMAL = np.full(256, 32, dtype=np.uint8)
_NORMAL[128:] = np.arange(128, 256)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)


def normalised(buf: np.ndarray) -> np.ndarray:
    """Letters lower-cased (ASCII and Latin-1), other ASCII as spaces; byte positions stay."""
    out = _NORMAL[buf]
    if len(out) > 1:
        upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][upper] += 32
    return out


def slots(buf: np.ndarray):
    """For each gram length: length and one slot array per slice, indexed by the gram's first byte."""
    wide = np.zeros(len(buf) + max(GRAMS), dtype=np.uint64)
    wide[: len(buf)] = buf
    for n in GRAMS:
        gram = wide[: len(buf)].copy()
        for k in range(1, n):
            gram = (gram << np.uint64(8)) | wide[k : len(buf) + k]
        gram |= np.uint64(n << 56)
        yield n, [((gram * salt) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for salt in _SALTS]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches):
    size = 1 << SLOT_BITS
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for lo, hi, raw, offsets in W.chunks(batch.column("text")):
            buf = normalised(raw)
            names = sorted(set(languages[lo:hi]))
            number = {name: k for k, name in enumerate(names)}
            of = np.repeat([number[x] for x in languages[lo:hi]], np.diff(offsets))
            room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(buf))
            for n, found in slots(buf):
                whole = room >= n
                for s, slot in enumerate(found):
                    counted = np.bincount(of[whole] * size + slot[whole], minlength=size * len(names))
                    for name, k in number.items():
                        seen.setdefault(name, np.zeros((SLICES, size), dtype=np.int64))[s] += counted[k * size : (k + 1) * size]
    for name, counted in seen.items():
        for block in range(0, SLICES * size, _BLOCK):
            part = counted.reshape(-1)[block : block + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block // _BLOCK]), pa.array([part.tolist()], pa.list_(pa.int64()))],
                    names=["lang", "block", "counts"],
                )


def learn(docs: DataFrame, keep: float = 0.3) -> tuple[list[str], np.ndarray, np.ndarray, str]:
    """Languages, bit-sliced filters (slice, slot, word), expected false share per language, most common language."""
    training = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    per_task = training.mapInArrow(_count, "lang string, block long, counts array<long>")
    rows = _summed(per_task).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    size = 1 << SLOT_BITS
    counts = np.zeros((len(names), SLICES * size))
    for name, block, part in zip(*(rows.column(c).to_pylist() for c in ("lang", "block", "counts"))):
        counts[names.index(name), block * _BLOCK : (block + 1) * _BLOCK] = part
    if not names:
        return [], np.zeros((SLICES, size, 1), dtype=np.uint64), np.zeros(0), "und"
    totals = counts.sum(axis=1)
    rate = counts / np.maximum(totals, 1)[:, None]
    member = (rate > 0) & (rate >= keep * rate.max(axis=0))
    masks = np.zeros((SLICES * size, -(-len(names) // 64)), dtype=np.uint64)
    for k in range(len(names)):
        masks[:, k // 64] |= member[k].astype(np.uint64) << np.uint64(k % 64)
    fill = member.reshape(len(names), SLICES, size).mean(axis=2).prod(axis=1)
    return names, masks.reshape(SLICES, size, -1), fill, names[int(totals.argmax())]


def _summed(per_task: DataFrame) -> DataFrame:
    def add(key, table):
        total = np.zeros(_BLOCK, dtype=np.int64)
        for part in table.column("counts"):
            total += np.array(part.as_py(), dtype=np.int64)
        return pa.table({"lang": [key[0].as_py()], "block": [key[1].as_py()], "counts": [total.tolist()]})

    return per_task.groupBy("lang", "block").applyInArrow(add, "lang string, block long, counts array<long>")


def _popcounts(raw: np.ndarray, offsets: np.ndarray, masks: np.ndarray, n_languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text and language: grams whose slots all have the bit; and the number of grams per text."""
    hits = np.zeros((len(offsets) - 1, n_languages))
    grams = np.zeros(len(offsets) - 1)
    for n, found in slots(normalised(raw)):
        end = np.maximum(offsets[1:] - (n - 1), offsets[:-1])
        grams += end - offsets[:-1]
        for word in range(masks.shape[2]):
            both = masks[0, :, word][found[0]]
            for s in range(1, SLICES):
                both &= masks[s, :, word][found[s]]
            for k in range(64 * word, min(n_languages, 64 * word + 64)):
                sums = np.zeros(len(raw) + 1, dtype=np.int32)
                np.cumsum((both >> np.uint64(k % 64)) & np.uint64(1), out=sums[1:], dtype=np.int32)
                hits[:, k] += sums[end] - sums[offsets[:-1]]
    return hits, grams


def _predictor(names: list[str], fill: np.ndarray, common: str):
    """Labels and scores of the texts of a chunk."""
    import regex

    letter = regex.compile(r"\p{L}")

    def predict(raw: np.ndarray, offsets: np.ndarray, masks: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        hits, grams = _popcounts(raw, offsets, masks, len(names))
        corrected = np.maximum(hits - grams[:, None] * fill, 0) / np.maximum(1 - fill, 1e-9)
        total = corrected.sum(axis=1)
        best = corrected.argmax(axis=1) if names else np.zeros(n, dtype=int)
        score = corrected.max(axis=1, initial=0) / np.maximum(total, 1e-9)
        plain = (raw >= 97) & (raw <= 122) | (raw >= 65) & (raw <= 90)
        has_letter = W.count_in(plain, offsets) > 0
        for k in np.flatnonzero(~has_letter & (np.diff(offsets) > 0)):
            has_letter[k] = letter.search(raw[offsets[k] : offsets[k + 1]].tobytes().decode()) is not None
        score[~has_letter] = 0
        label = ["und" if not has_letter[k] or not names else names[best[k]] if total[k] > 0 else common for k in range(n)]
        return label, score

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; reads doc_id only to return it."""
    names, masks, fill, common = model
    shared = docs.sparkSession.sparkContext.broadcast(masks)

    def run(batches):
        predict = _predictor(names, fill, common)
        for batch in batches:
            for lo, hi, raw, offsets in W.chunks(batch.column("text")):
                label, score = predict(raw, offsets, shared.value)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(label), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, str]) -> DataFrame:
    """The rows of `docs` whose text is in some language, all columns as they are."""
    names, masks, fill, common = model
    shared = docs.sparkSession.sparkContext.broadcast(masks)

    def run(batches):
        predict = _predictor(names, fill, common)
        for batch in batches:
            for lo, hi, raw, offsets in W.chunks(batch.column("text")):
                label, _ = predict(raw, offsets, shared.value)
                yield batch.slice(lo, hi - lo).filter(pa.array([x != "und" for x in label]))
            W.free_memory()

    return docs.mapInArrow(run, docs.schema)
