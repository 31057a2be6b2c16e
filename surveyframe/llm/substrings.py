"""Removal of long repeated spans through a compacted De Bruijn graph of words.

Edges of the graph are windows of `k` words, nodes their k - 1 overlapping words. A window that starts
earlier too (smaller doc_id, or same document and earlier start) loses its words. Every window counts, on
the input texts; words are compared as they stand.

1. Texts with the same words: all but the one with the smallest doc_id lose every word (from k words on)
   and stay out of the graph.
2. Anchors. Of the m-word grams in a window, the one with the smallest hash is the window's anchor; equal
   windows have equal anchors, and neighbours mostly share one. Anchors, about two per k - m + 2 words, are
   exchanged by hash range; windows whose anchor occurs nowhere else cannot be repeated.
3. Edges. The windows left are exchanged with their predecessor and successor. The range answers whether the
   edge is repeated and whether its ends branch (different or missing neighbours among its occurrences).
4. Compaction. Repeated edges that follow each other without a branch between are one path. All occurrences
   of a path's first edge run along the whole path, so one row per path occurrence is left: first edge,
   digest of the path, length, source coordinates.
5. A join per path, on first edge, digest and length together, verifies the spans and finds the earliest
   source coordinates; all other occurrences are removed. Spans join their text once.

Keys are 64-bit hashes of exact words; neighbours are compared by 32 bits each (a branch is overlooked with
probability 2 ** -32; the path's digest then keeps different texts apart). No row per window ever leaves a
task. Hot passages: a key travels once per batch, and path joins have one row per path on one side, a table by
itself, so that Spark can split the other side of a hot path.

Null and blank texts have no words. Rows without doc_id are only counted. Rows that share doc_id and words
are taken for the same document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.llm import words as W
from surveyframe.llm.ranges import ask, dump, group_span, load
from surveyframe.llm.storage import stored

ANCHOR_WORDS = 8
FLUSH_WORDS = 500_000
RANGE_BYTES = 12 << 20
_U = np.uint64
_MANY = _U(0xFFFFFFFFFFFFFFFF)


def window_anchors(hashes: np.ndarray, bounds: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k words, and for each the start of its anchor (leftmost smallest m-gram)."""
    starts = W.windows(bounds, k)
    if not len(starts):
        return starts, starts
    n = len(hashes) - m + 1
    grams = W.sequence_hash(hashes, np.arange(n), np.arange(m, n + m))
    best, at = grams[starts], starts.copy()
    for step in range(1, k - m + 1):
        other = grams[starts + step]
        less = other < best
        best = np.where(less, other, best)
        at[less] = starts[less] + step
    return starts, at


def _words(buf: np.ndarray, offsets: np.ndarray):
    starts, ends = W.spans(buf, offsets, W.SPACE_WORDS)
    return W.byte_hash(buf, starts, ends), W.per_text(starts, offsets)


# 1 and 2: documents, and positions of anchors that occur elsewhere


def _prepare_anchors(k: int, m: int):
    def whole(held):
        keys = np.concatenate([h["key"] for h in held])
        texts = np.concatenate([h["text"] for h in held])
        own = np.concatenate([h["own"] for h in held])
        distinct, index = np.unique(keys, return_inverse=True)
        _, low, high, _ = group_span(index.astype(np.uint64), texts) if len(keys) else (None, texts, texts, None)
        summary = np.zeros(len(distinct), dtype=np.uint64)
        summary[index] = np.where(low == high, low, _MANY)
        summary[index[own]] = _MANY
        header = dump(
            index=index.astype(np.int32), at=np.concatenate([h["at"] for h in held]).astype(np.int32),
            counts=np.concatenate([h["counts"] for h in held]).astype(np.int32), ids=sum((h["ids"] for h in held), []),
            n_words=np.concatenate([h["n_words"] for h in held]), seq=b"".join(h["seq"] for h in held), sha=sum((h["sha"] for h in held), []),
        )
        return distinct, [summary], header

    def prepare(batches):
        held, size = [], 0
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for lo, hi, buf, offsets in W.chunks(batch.column("text")):
                hashes, bounds = _words(buf, offsets)
                joined = [b" ".join(buf[offsets[i] : offsets[i + 1]].tobytes().split()) for i in range(hi - lo)]
                seq = [hashlib.md5(j).digest() for j in joined]
                _, anchors = window_anchors(hashes, bounds, k, m)
                anchors = np.unique(anchors)
                known = np.array([numbers[lo + i] is not None for i in range(hi - lo)], dtype=bool)
                of = W.owner(anchors, bounds)
                anchors, of = anchors[known[of]], of[known[of]]
                key = W.sequence_hash(hashes, anchors, anchors + m)
                text = np.frombuffer(b"".join(s[:8] for s in seq), dtype=np.uint64)[of] & ~_U(1)
                order = np.lexsort((key, of))
                twice = np.zeros(len(key), dtype=bool)  # more than once in the same text
                same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                held.append({
                    "key": key, "text": text, "own": twice, "at": anchors - bounds[of], "counts": np.bincount(of, minlength=hi - lo),
                    "ids": numbers[lo:hi], "n_words": np.diff(bounds), "seq": b"".join(seq), "sha": [hashlib.sha256(j).hexdigest() for j in joined],
                })
                size += len(hashes)
                if size >= FLUSH_WORDS:
                    yield whole(held)
                    held, size = [], 0
        if held:
            yield whole(held)

    return prepare


def _judge_anchors(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """1 where an anchor stands in two different texts, or twice in one."""
    _, low, high, _ = group_span(keys, text)
    return (low != high) | (high == _MANY)


def _finish_anchors(header: bytes, flags: np.ndarray, copies: int) -> pa.Table:
    h = load(header)
    hit = flags[h["index"]] > 0 if len(h["index"]) else np.zeros(0, bool)
    edges = np.concatenate([[0], np.cumsum(h["counts"])])
    places = [h["at"][a:b][hit[a:b]] for a, b in zip(edges[:-1], edges[1:])]
    seq = h["seq"]
    one = pa.table({
        "doc_id": pa.array(h["ids"], pa.int64()), "n_words": pa.array(h["n_words"], pa.int64()),
        "seq": pa.array([seq[16 * i : 16 * i + 16] for i in range(len(places))], pa.binary()), "sha": pa.array(h["sha"], pa.string()),
        "anchors": pa.array([p.tobytes() if len(p) else None for p in places], pa.binary()),
    })
    return pa.concat_tables([one] * copies)


# 3 and 4: edges, and paths of repeated edges


def _prepare_edges(k: int, m: int):
    def summary(index, values, n):
        _, low, high, _ = group_span(index.astype(np.uint64), values)
        out = np.zeros(n, dtype=np.uint64)
        out[index] = np.where(low == high, low, _U(0))
        return out

    def whole(held):
        keys = np.concatenate([h["key"] for h in held])
        distinct, index, counts = np.unique(keys, return_inverse=True, return_counts=True)
        before = summary(index, np.concatenate([h["before"] for h in held]), len(distinct))
        after = summary(index, np.concatenate([h["after"] for h in held]), len(distinct))
        header = dump(
            index=index.astype(np.int32), keys=distinct, at=np.concatenate([h["at"] for h in held]).astype(np.int32),
            counts=np.concatenate([h["counts"] for h in held]).astype(np.int32), ids=np.concatenate([h["ids"] for h in held]),
        )
        # 0 is a branch, so neighbours are 1 to 2 ** 31 - 1; the top bit says "more than once in this batch"
        both = (before << _U(32)) | after | ((counts > 1).astype(np.uint64) << _U(63))
        return distinct, [both], header

    def prepare(batches):
        held, size = [], 0
        for batch in batches:
            for row in range(len(batch)):
                raw = zstandard.ZstdDecompressor().decompress(batch.column("packed")[row].as_py())
                buf = np.frombuffer(raw, dtype=np.uint8)
                hashes, bounds = _words(buf, np.array([0, len(buf)]))
                starts, at = window_anchors(hashes, bounds, k, m)
                wanted = np.flatnonzero(np.isin(at, np.frombuffer(batch.column("anchors")[row].as_py(), np.int32)))
                edge = W.sequence_hash(hashes, starts, starts + k)
                short = (edge % _U((1 << 31) - 3)) + _U(2)
                around = np.concatenate([[_U(1)], short, [_U(1)]])  # 1: the text begins or ends
                held.append({
                    "key": edge[wanted], "before": around[wanted], "after": around[wanted + 2], "at": wanted,
                    "counts": [len(wanted)], "ids": [batch.column("doc_id")[row].as_py()],
                })
                size += len(wanted)
                if size >= FLUSH_WORDS // 4:
                    yield whole(held)
                    held, size = [], 0
        if held:
            yield whole(held)

    return prepare


REPEATED, BRANCH_BEFORE, BRANCH_AFTER = 1, 2, 4


def _judge_edges(keys: np.ndarray, both: np.ndarray) -> np.ndarray:
    multiple = (both >> _U(63)).astype(np.int64)
    before, after = (both >> _U(32)) & _U((1 << 31) - 1), both & _U((1 << 32) - 1)
    counts, low, high, of = group_span(keys, before)
    out = np.where((low != high) | (low == 0), BRANCH_BEFORE, 0)
    _, low, high, _ = group_span(keys, after)
    out |= np.where((low != high) | (low == 0), BRANCH_AFTER, 0)
    some = np.bincount(of, weights=multiple)[of] if len(keys) else counts
    return out | np.where((counts > 1) | (some > 0), REPEATED, 0)


def _finish_edges(header: bytes, flags: np.ndarray, copies: int) -> pa.Table:
    h = load(header)
    flag = flags[h["index"]] if len(h["index"]) else np.zeros(0, np.uint8)
    doc = np.repeat(np.arange(len(h["counts"])), h["counts"])
    keep = (flag & REPEATED) > 0
    flag, doc, at, key = flag[keep], doc[keep], h["at"][keep], h["keys"][h["index"]][keep]
    n = len(key)
    start = np.ones(n, dtype=bool)
    start[1:] = (
        (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | ((flag[:-1] & BRANCH_AFTER) > 0) | ((flag[1:] & BRANCH_BEFORE) > 0)
    )
    first = np.flatnonzero(start)
    end = np.append(first[1:], n)[: len(first)]
    digest = W.sequence_hash(key, first, end)
    return pa.table({
        "edge": pa.array(W.signed(key[first])), "digest": pa.array(W.signed(digest)), "edges": pa.array(end - first, pa.int64()),
        "doc_id": pa.array(np.asarray(h["ids"], dtype=np.int64)[doc[first]]), "start": pa.array(at[first], pa.int64()),
    })


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id and its text as one zstd frame: what travels when texts meet their spans."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                packed = pa.array([pack.compress((t.as_py() or "").encode()) for t in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed], names=["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def repeated_spans(docs: DataFrame, k: int = 20, m: int = ANCHOR_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with word counts, digests and first copy; spans (doc_id, start, length in words) to remove)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    profile = stored(ask(
        read, _prepare_anchors(k, m), _judge_anchors, _finish_anchors, max(8, -(-size // RANGE_BYTES)), 1,
        "doc_id long, n_words long, seq binary, sha string, anchors binary",
    ))
    first = stored(profile.where(F.col("doc_id").isNotNull()).groupBy(F.col("seq").alias("o_seq")).agg(F.min("doc_id").alias("original")))
    documents = profile.join(first, F.col("seq") == F.col("o_seq"), "left").select(
        "doc_id", "n_words", "sha", "anchors", F.coalesce(F.col("doc_id") != F.col("original"), F.lit(False)).alias("copy")
    )
    asked = documents.where(~F.col("copy") & F.col("anchors").isNotNull()).groupBy("doc_id").agg(F.min("anchors").alias("anchors"))
    texts = packed_texts(read).withColumnRenamed("doc_id", "t_doc")
    edges = asked.join(texts, F.col("doc_id") == F.col("t_doc")).select("doc_id", "anchors", "packed")
    paths = stored(ask(
        edges, _prepare_edges(k, m), _judge_edges, _finish_edges, max(8, -(-size // RANGE_BYTES)), 1,
        "edge long, digest long, edges long, doc_id long, start long",
    ))
    name = ["edge", "digest", "edges"]
    earliest = stored(
        paths.groupBy(*name).agg(F.min(F.struct("doc_id", "start")).alias("source"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    spans = paths.join(earliest, name).where(F.struct("doc_id", "start") != F.col("source")).select(
        "doc_id", "start", (F.col("edges") + (k - 1)).alias("length")
    )
    return documents, spans


def _apply(text_out: bool):
    names = ["doc_id", "n_removed", "kept_sha256"] + ["kept"] * text_out

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                removed, kept = [], []
                for row in range(len(part)):
                    words = unpack.decompress(part.column("packed")[row].as_py()).split()
                    gone = np.array(part.column("spans")[row].as_py(), dtype=np.int64).reshape(-1, 2)
                    mask = W.covered(gone[:, 0], gone[:, 1], len(words))
                    kept.append(b" ".join(w for w, out in zip(words, mask.tolist()) if not out))
                    removed.append(int(mask.sum()))
                arrays = [part.column("doc_id"), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                if text_out:
                    arrays.append(pa.array([x.decode() for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run, "doc_id long, n_removed long, kept_sha256 string" + ", kept string" * text_out


def substring_dedup(docs: DataFrame, k: int = 20, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per document; with keep_text also `kept`, null where nothing changed."""
    documents, spans = repeated_spans(docs, k)
    lists = spans.groupBy(F.col("doc_id").alias("s_doc")).agg(F.collect_list(F.array("start", "length")).alias("lists"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _apply(keep_text)
    changed = (
        lists.join(packed_texts(read), F.col("s_doc") == F.col("doc_id"))
        .select("doc_id", F.flatten("lists").alias("spans"), "packed").mapInArrow(run, schema).withColumnRenamed("doc_id", "c_doc")
        .withColumnRenamed("n_removed", "c_removed").dropDuplicates(["c_doc"])
    )
    whole_copy = F.col("copy") & (F.col("n_words") >= k)
    nothing = hashlib.sha256(b"").hexdigest()
    out = documents.join(changed, F.col("doc_id") == F.col("c_doc"), "left").select(
        "doc_id", "n_words", F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("c_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole_copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(whole_copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )
    return out


def remove_spans(docs: DataFrame, k: int = 20) -> DataFrame:
    """`docs` without the words of repeated spans, n_chars renewed; unchanged texts stay as they are.

    A changed text is its kept words joined by one space. Documents that lose every word go.
    """
    documents, spans = repeated_spans(docs, k)
    whole = documents.where(F.col("copy") & (F.col("n_words") >= k)).select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"))
    names = docs.columns
    gone_name = "removed_spans"
    while gone_name in names:
        gone_name += "_"
    lists = spans.select("doc_id", "start", "length").unionByName(whole).groupBy("doc_id").agg(
        F.flatten(F.collect_list(F.array("start", "length"))).alias(gone_name)
    )
    at_text, at_chars = names.index("text"), names.index("n_chars")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                chars = part.column("n_chars").to_pylist()
                keep = np.ones(len(part), dtype=bool)
                for row, gone in enumerate(part.column(gone_name)):
                    if not gone.is_valid or texts[row] is None:
                        continue
                    words = texts[row].encode().split()
                    edges = np.array(gone.as_py(), dtype=np.int64).reshape(-1, 2)
                    mask = W.covered(edges[:, 0], edges[:, 1], len(words))
                    texts[row] = b" ".join(w for w, out in zip(words, mask.tolist()) if not out).decode()
                    chars[row] = len(texts[row])
                    keep[row] = not mask.all()
                arrays = [part.column(n) for n in names]
                arrays[at_text] = pa.array(texts, pa.string())
                arrays[at_chars] = pa.array(chars, part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))

    joined = docs.join(lists, "doc_id", "left").select(*(F.col(f"`{n}`") for n in names), gone_name)
    return joined.mapInArrow(run, docs.schema)
