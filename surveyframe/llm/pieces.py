"""SentencePiece encoding and decoding by suffix-array matching.

A text becomes units: a run of spaces with the characters up to the next space (with the model's leading
space); no piece reaches across a unit's end, so a batch needs every distinct unit once. A worker keeps the
ids of up to `KNOWN_UNITS` units and forgets them all when more come. A batch's new units are concatenated and indexed by their sorted suffixes (to the
length of the longest piece, as 64-bit words of numbered characters); every piece of several characters finds its range of
occurrences by binary search. The occurrences are edges between character
positions. Sorted by position, they are relaxed in order of score: an edge whose inside is exactly two
symbols joins them, best score first, then leftmost, until no edge applies. Short units do so side by side,
one join per unit and round; units over `LONG_UNIT` characters use a heap each. What is left of a character
without a piece falls back to bytes.

Decoding gathers the bytes of the pieces, bytes pieces as they are, and drops the leading space.

Models: byte-pair models with byte fallback, a leading space and no text normalisation; others are an error.
Null and empty texts have no pieces and decode to the empty text. The character U+2581 is the model's space,
as in the library, and decodes as one.
"""

from __future__ import annotations

import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.llm import words as W

LONG_UNIT = 48
MARK = "▁"
CHUNK = 1 << 20
KNOWN_UNITS = 200_000


class PieceModel:
    """Pieces by length with their scores, ids and bytes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not spec.trainer_spec.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback, leading space and identity normalisation")
        if spec.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in spec.pieces):
            raise ValueError("white space suffixes and user-defined pieces are not covered")
        normal = [(p.piece, k, p.score) for k, p in enumerate(spec.pieces) if p.type == 1]
        if any(MARK in p.lstrip(MARK) for p, _, _ in normal):
            raise ValueError("a piece reaches across a space")
        self.width = max(len(p) for p, _, _ in normal)
        normal.sort(key=lambda x: len(x[0]))
        self.length = np.array([len(p) for p, _, _ in normal], dtype=np.int64)
        self.id = np.array([k for _, k, _ in normal], dtype=np.int64)
        text = np.array([p for p, _, _ in normal], dtype=f"U{self.width}").view(np.uint32).reshape(-1, self.width)
        letters = np.setdiff1d(text, [0])
        self.letter = np.zeros(0x110000, dtype=np.uint16 if len(letters) < 1 << 16 else np.uint32)  # 0: in no piece
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.text = self.letter[text]
        one = self.length == 1
        self.single = np.full(len(letters) + 1, -1, dtype=np.int64)
        self.single[self.text[one, 0]] = self.id[one]
        _, rank = np.unique(-np.array([s for _, _, s in normal]), return_inverse=True)
        self.rank = rank.astype(np.int64)
        self.byte_id = np.zeros(256, dtype=np.int64)
        texts = [b""] * len(spec.pieces)
        for k, p in enumerate(spec.pieces):
            if p.type == 6:
                value = int(p.piece[3:-1], 16)
                self.byte_id[value] = k
                texts[k] = bytes([value])
            elif p.type == 1:
                texts[k] = p.piece.replace(MARK, " ").encode()
            elif p.type == 2:
                texts[k] = " ⁇ ".encode()
        self.forget()
        self.bytes_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted, with each unit's number
        self.known_unit = np.zeros(0, dtype=np.int32)
        self.known_ids = np.zeros(0, dtype=np.int32)
        self.known_at = np.zeros(1, dtype=np.int64)

    def is_known(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.known, keys)
        found = place < len(self.known)
        found[found] = self.known[place[found]] == keys[found]
        return found

    def remember(self, keys: np.ndarray, units: list[bytes]) -> None:
        """Add sorted new keys of units."""
        ids, at = self.unit_ids(units)
        place = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, place, keys)
        self.known_unit = np.insert(self.known_unit, place, np.arange(len(self.known_at) - 1, len(self.known_at) - 1 + len(keys)))
        self.known_at = np.concatenate([self.known_at, len(self.known_ids) + at[1:]])
        self.known_ids = np.concatenate([self.known_ids, ids.astype(np.int32)])

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and piece of every occurrence of pieces of several characters in `code`, by position, then length.

        The characters that occur are numbered anew, so that a 64-bit word holds eight of them, or four where they are many. Suffixes
        are sorted by their first word, then by ranks of neighbouring words (prefix doubling) as far as longer pieces need it.
        """
        letters = np.concatenate([self.letter[code], np.zeros(self.width, self.letter.dtype)])
        used = np.zeros(len(self.single), dtype=bool)
        used[letters] = True
        used[0] = True
        number = np.cumsum(used) - 1
        piece = np.flatnonzero((self.length > 1) & used[self.text].all(axis=1))
        bits = next(b for b in (8, 16, 32) if number[-1] < 1 << b)
        span = 64 // bits
        key = number[letters].astype(np.uint64)
        for k in range(span.bit_length() - 1):
            key = key << np.uint64(bits << k) | _after(key, 1 << k)
        shift = np.arange(span - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)
        blocks = -(-self.width // span)
        text = np.zeros((len(piece), blocks * span), dtype=np.uint64)
        text[:, : self.width] = number[self.text[piece]]
        inside = np.arange(blocks * span) < self.length[piece, None]
        words = lambda filled: np.bitwise_or.reduce(filled.reshape(len(piece), blocks, span) << shift, axis=2)
        low, high = words(text), words(np.where(inside, text, np.uint64((1 << bits) - 1)))
        found = []
        while True:
            order = np.argsort(key)
            ranked = key[order]
            here = self.length[piece] <= span
            first = np.searchsorted(ranked, low[here, 0], side="left")
            counts = np.maximum(np.searchsorted(ranked, high[here, 0], side="right") - first, 0)
            found.append(order[_ranges(first, counts)] << 32 | np.repeat(piece[here], counts))
            piece, low, high = piece[~here], low[~here], high[~here]
            if not len(piece):
                break
            fresh = np.diff(ranked, prepend=ranked[:1] + np.uint64(1)) != 0
            distinct, rank = ranked[fresh], np.empty(len(key), np.uint64)
            rank[order] = (np.cumsum(fresh) - 1).astype(np.uint64)
            low, high = np.searchsorted(distinct, low, side="left"), np.searchsorted(distinct, high, side="right") - 1
            live = (low <= high).all(axis=1)  # a block that occurs nowhere ends its piece
            piece, low, high = piece[live], low[live].astype(np.uint64), high[live].astype(np.uint64)
            key = rank << np.uint64(32) | _after(rank, span)
            if low.shape[1] % 2:
                low, high = np.pad(low, ((0, 0), (0, 1))), np.pad(high, ((0, 0), (0, 1)), constant_values=len(distinct) - 1)
            low, high = (x[:, ::2] << np.uint64(32) | x[:, 1::2] for x in (low, high))
            span *= 2
        places = np.sort(np.concatenate(found))  # pieces are numbered by length
        return places >> 32, places & 0xFFFFFFFF

    def relax(self, code: np.ndarray, unit_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(borders: truth per position, edge places, edge pieces) after all joins.

        `unit_at` are the units' first positions; every unit is followed by one separator in `code`.
        """
        at, piece = self.edges(code)
        border = np.ones(len(code) + 1, dtype=bool)
        start, kind = at, piece
        end = start + self.length[kind]
        unit = np.searchsorted(unit_at, start, side="right") - 1
        unit_end = np.append(unit_at[1:], len(code)) - 1
        long_ = (unit_end - unit_at)[unit] > LONG_UNIT
        edges = np.flatnonzero(long_)
        for u in np.unique(unit[long_]):
            mine = edges[np.searchsorted(unit[edges], u) : np.searchsorted(unit[edges], u, side="right")]
            self._join_one(border, int(unit_at[u]), int(unit_end[u]), start[mine].tolist(), end[mine].tolist(), self.rank[kind[mine]].tolist())
        short = np.flatnonzero(~long_)
        start, end, unit = (x[short].astype(np.int32) for x in (start, end, unit))
        order = self.rank[kind[short]] * (len(code) + 1) + start
        inside = end - start - 1
        while len(now := np.flatnonzero(inside == 1)):
            own = unit[now]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            best = np.repeat(np.minimum.reduceat(order[now], first), np.diff(np.append(first, len(own))))
            chosen = now[order[now] == best]
            a, b = start[chosen], end[chosen]
            for step in range(1, int((b - a).max())):
                border[(a + step)[a + step < b]] = False
            inner = np.cumsum(border, dtype=np.int32)
            live = np.flatnonzero(border[start] & border[end])
            start, end = start[live], end[live]
            inside = inner[end - 1] - inner[start]
            some = np.flatnonzero(inside > 0)
            start, end, inside = start[some], end[some], inside[some]
            unit, order = unit[live[some]], order[live[some]]
        return border, at, piece

    @staticmethod
    def _join_one(border, low, high, start, end, rank) -> None:
        """The same joins for one long unit, with a heap of the edges that span two symbols."""
        by_span = {(a, b): r for a, b, r in zip(start, end, rank)}
        after = {p: p + 1 for p in range(low, high)}
        before = {p + 1: p for p in range(low, high)}
        heap = [(r, a, b) for (a, b), r in by_span.items() if b - a == 2]
        heapq.heapify(heap)
        middle = {(r, a, b): a + 1 for r, a, b in heap}

        def offer(a, m, b):
            r = by_span.get((a, b))
            if r is not None:
                middle[(r, a, b)] = m
                heapq.heappush(heap, (r, a, b))

        while heap:
            r, a, b = heapq.heappop(heap)
            m = middle[(r, a, b)]
            if after.get(a) != m or after.get(m) != b:
                continue
            border[m] = False
            after[a], before[b] = b, a
            del after[m]
            if a in before:
                offer(before[a], a, b)
            if b in after:
                offer(a, b, after[b])

    def unit_ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the units, flat, and where each unit's ids begin (with the end at the end)."""
        text = b"\0".join(units).replace(b" ", MARK.encode()) + b"\0"
        code = np.frombuffer(text.decode().encode("utf-32-le"), dtype=np.uint32)
        raw = np.frombuffer(b"".join(units), np.uint8)
        ends = np.cumsum([len(u) for u in units])
        lengths = np.diff(np.cumsum((raw & 0xC0) != 0x80)[ends - 1], prepend=0)
        unit_at = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        border, at, piece = self.relax(code, unit_at)
        separator = unit_at + lengths
        begins = border[:-1].copy()
        begins[separator] = False
        symbol = np.flatnonzero(begins)
        nexts = np.flatnonzero(border)
        size = nexts[np.searchsorted(nexts, symbol, side="right")] - symbol
        keys = at * (self.width + 1) + self.length[piece]
        wanted = symbol * (self.width + 1) + size
        place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        known = (keys[place] == wanted) if len(keys) else np.zeros(len(symbol), bool)
        ids = np.where(size == 1, self.single[self.letter[code[symbol]]], -1)
        ids[known] = self.id[piece[place[known]]]
        known |= ids >= 0
        owner = np.searchsorted(unit_at, symbol, side="right") - 1
        if not known.all():
            rest = [chr(c).encode() for c in code[symbol[~known]].tolist()]
            repeat = np.ones(len(symbol), dtype=np.int64)
            repeat[~known] = [len(c) for c in rest]
            flat = np.repeat(ids, repeat)
            flat[flat < 0] = self.byte_id[np.frombuffer(b"".join(rest), np.uint8)]
            ids, owner = flat, np.repeat(owner, repeat)
        return ids, np.searchsorted(owner, np.arange(len(units) + 1))


def _after(values: np.ndarray, step: int) -> np.ndarray:
    """Each position's value `step` further on, 0 beyond the end."""
    return np.concatenate([values[step:], np.zeros(min(step, len(values)), values.dtype)])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])


def spaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U+2581 as a space, and the leading space before every text that has something."""
    if MARK.encode() in buf.tobytes():
        data = buf.tobytes()
        texts = [data[a:b].replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:])]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    some = np.diff(offsets) > 0
    out = np.insert(buf, offsets[:-1][some], 32)
    return out, offsets + np.concatenate([[0], np.cumsum(some)])


def encode(model: PieceModel, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of a chunk's texts (as of `spaced`) and each text's first place in them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = buf == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(buf))
    keys, sample, which = np.unique(W.byte_hash(buf, starts, ends), return_index=True, return_inverse=True)
    new = np.flatnonzero(~model.is_known(keys))
    if len(model.known) + len(new) > KNOWN_UNITS:
        model.forget()
        new = np.arange(len(keys))
    if len(new):
        data = buf.tobytes()
        places = zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())
        model.remember(keys[new], [data[a:b] for a, b in places])
    unit = model.known_unit[np.searchsorted(model.known, keys)][which]
    sizes = np.diff(model.known_at)[unit]
    places = np.concatenate([[0], np.cumsum(sizes)])
    return model.known_ids[_ranges(model.known_at[:-1][unit], sizes)], places[np.searchsorted(starts, offsets)]


def decode(model: PieceModel, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts behind flat ids, without their leading space."""
    sizes = np.diff(model.bytes_at)[ids]
    out = model.bytes[_ranges(model.bytes_at[:-1][ids], sizes)]
    places = np.concatenate([[0], np.cumsum(sizes)])[at]
    some = np.diff(places) > 0
    lead = places[:-1][some]
    lead = lead[out[lead] == 32]
    keep = np.ones(len(out), dtype=bool)
    keep[lead] = False
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[places]


_models: dict[str, PieceModel] = {}


def load_model(model: str) -> PieceModel:
    if model not in _models:
        import public_tokenizers

        _models[model] = PieceModel(model if os.path.isabs(model) else str(public_tokenizers.path(model)))
    return _models[model]


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_bytes, n_pieces, pieces, round_trip (decoding gives the text back) for every document."""

    def run(batches):
        known = load_model(model)
        for batch in batches:
            for lo, hi, raw, raw_at in W.chunks(batch.column("text"), CHUNK):
                buf, offsets = spaced(raw, raw_at)
                ids, at = encode(known, buf, offsets)
                back, back_at = decode(known, ids, at)
                plain, plain_at = np.delete(buf, offsets[:-1][np.diff(offsets) > 0]), offsets - np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
                same = np.diff(back_at) == np.diff(plain_at)
                for i in np.flatnonzero(same):
                    same[i] = np.array_equal(back[back_at[i] : back_at[i + 1]], plain[plain_at[i] : plain_at[i + 1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(raw_at)), pa.array(np.diff(at)),
                        W.list_array(ids, at, pa.int32()), pa.array(same),
                    ],
                    names=["doc_id", "n_bytes", "n_pieces", "pieces", "round_trip"],
                )
                del raw, buf, ids, back, plain
                W.free_memory()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, pieces array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and the text of its `pieces`; null pieces give an empty text."""

    def run(batches):
        known = load_model(model)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                lists = [np.array(x.as_py() or [], dtype=np.int64) for x in part.column("pieces")]
                places = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                out, edges = decode(known, np.concatenate(lists) if lists else np.zeros(0, np.int64), places)
                data = out.tobytes()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
