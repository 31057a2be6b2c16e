"""Token counts through a finite-state transducer.

The pre-tokeniser of a byte-level BPE is compiled to a deterministic transducer over eight character
classes (one character of look-ahead folded into the class, two after an apostrophe). It has eight
states; its transitions say whether a new piece starts at the character. A chunk of texts is cut into
short runs, each run's map from every entry state to its exit state is built, and the maps are composed
with a parallel prefix scan. That gives every run's entry state without a walk over the text; a second
sweep annotates each character's transition.

A piece that ends emits a number of tokens that depends on its bytes alone. Those annotations are
compiled once per distinct piece, by the vocabulary's own merges, and kept in a bounded table of the
worker. Counts per text are differences of prefix sums.

Null texts are empty: no bytes, no tokens. The vocabulary's added special string inside a text is one
token and cuts the text, as the tokenizers library does by default. Every row gives a row.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.llm import words as W

LETTER, NUMBER, OTHER, APOS_ONE, APOS_TWO, SPACE, SPACE_JOIN, SPACE_ALONE = range(8)
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, JOINING, FRESH, ONE_LEFT, TWO_LEFT = range(8)
RUN = 32
TABLE_BITS = 20


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece starts here", each indexed by class * 8 + state.

    Classes 8 to 15 are classes 0 to 7 at a text's first character: every entry state acts as FRESH.
    """
    step = np.zeros((16, 8), dtype=np.uint8)
    start = np.ones((16, 8), dtype=np.uint8)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}
    for state in range(8):
        for kind, run in runs.items():
            step[kind, state] = run
            start[kind, state] = state not in (run, JOINING)
        if state in (ONE_LEFT, TWO_LEFT):
            step[LETTER, state] = FRESH if state == ONE_LEFT else ONE_LEFT
            start[LETTER, state] = 0
        for kind, left in ((APOS_ONE, ONE_LEFT), (APOS_TWO, TWO_LEFT)):
            inside = state in (IN_OTHER, JOINING)
            step[kind, state] = IN_OTHER if inside else left
            start[kind, state] = not inside
        step[SPACE, state] = IN_SPACE
        start[SPACE, state] = state != IN_SPACE
        step[SPACE_JOIN, state] = JOINING
        step[SPACE_ALONE, state] = FRESH
    step[8:] = step[:8, [FRESH]]
    return step.reshape(-1), start.reshape(-1)


_STEP, _START = compile_transducer()
_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    global _classes
    if _classes is None:
        import regex

        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for base in range(0, 0x110000, 0x10000):
            points = [chr(c) for c in range(base, base + 0x10000) if not 0xD800 <= c < 0xE000]
            text = "".join(points)
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
                for m in regex.finditer(pattern, text):
                    a, b = ord(text[m.start()]), ord(text[m.end() - 1]) + 1
                    table[a:b] = kind
        _classes = table
    return _classes


def classify(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Transducer input for code points; `first` marks the positions at which a text begins."""
    n = len(code)
    kind = character_classes()[code]
    ends = np.zeros(n + 2, dtype=bool)  # position i: the text of i - 1 has ended
    ends[first] = True
    ends[n:] = True
    space = kind == SPACE
    more = np.zeros(n, dtype=bool)  # the next character is not white space
    more[:-1] = ~space[1:] & ~ends[1:n]
    out = kind.copy()
    alone = space & more
    out[alone] = SPACE_ALONE
    out[alone & (code == 32)] = SPACE_JOIN
    apos = np.flatnonzero(code == 39)
    if len(apos):
        ahead = np.zeros(n + 2, dtype=np.uint32)
        ahead[:n] = code
        one = np.where(ends[apos + 1], 0, ahead[apos + 1])
        two = np.where(ends[apos + 1] | ends[np.minimum(apos + 2, n + 1)], 0, ahead[np.minimum(apos + 2, n + 1)])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(apos), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        out[apos[single]] = APOS_ONE
        out[apos[double & ~single]] = APOS_TWO
    out[first] += 8
    return out


def piece_starts(kind: np.ndarray) -> np.ndarray:
    """Run maps, their prefix composition, and the annotated second sweep."""
    n = len(kind)
    m = -(-n // RUN)
    rows = np.zeros(m * RUN, dtype=np.uint8)
    rows[:n] = kind << 3
    rows = np.ascontiguousarray(rows.reshape(m, RUN).T)
    with_case = rows.astype(np.intp)
    maps = np.tile(np.arange(8, dtype=np.uint8), (m, 1))
    for row in with_case:
        maps = _STEP[row[:, None] | maps]
    reach = 1
    while reach < m:  # maps[i] becomes the map from the entry of run i - 2 * reach + 1 to the exit of run i
        ahead = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        maps = np.concatenate([maps[:reach], ahead])
        reach *= 2
    state = np.full(m, FRESH, dtype=np.uint8)
    state[1:] = maps[:-1, FRESH]
    flags = np.empty((RUN, m), dtype=np.uint8)
    for k, row in enumerate(with_case):
        at = row | state
        flags[k] = _START[at]
        state = _STEP[at]
    return flags.T.reshape(-1)[:n] != 0


class PieceCounts:
    """Tokens per distinct piece, compiled on first sight; at most half of 2 ** TABLE_BITS entries stay."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.compiler = Tokenizer.from_file(path)
        self.compiler.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"].encode() for t in json.load(f).get("added_tokens", [])]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, dtype=np.uint64)
        self.counts = np.zeros(1 << TABLE_BITS, dtype=np.int64)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the keys; -1 where a key is not compiled."""
        mask = np.uint64((1 << TABLE_BITS) - 1)
        slot = keys & mask
        out = np.full(len(keys), -1, dtype=np.int64)
        left = None
        while True:
            held = self.keys[slot]
            hit = held == keys
            if left is None:
                out[hit] = self.counts[slot[hit]]
                left = np.flatnonzero(~hit & (held != 0))
            else:
                out[left[hit]] = self.counts[slot[hit]]
                left = left[~hit & (held != 0)]
            if not len(left):
                return out
            keep = ~hit & (held != 0)
            keys = keys[keep]
            slot = (slot[keep] + np.uint64(1)) & mask

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys that the table does not hold."""
        if self.used + len(keys) > 1 << (TABLE_BITS - 1):
            self.clear()
        mask = np.uint64((1 << TABLE_BITS) - 1)
        slot = keys & mask
        self.used += len(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.counts[slot[won]] = counts[won]
            keys, counts, slot = keys[~won], counts[~won], (slot[~won] + np.uint64(1)) & mask

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = W.byte_hash(buf, starts, ends) | np.uint64(1)
        out = self.find(keys)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            fresh, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            first = missing[first]
            data = buf.tobytes()
            pieces = [data[a:b].decode() for a, b in zip(starts[first], ends[first])]
            found = np.array([len(e) for e in self.compiler.encode_batch(pieces, add_special_tokens=False)], dtype=np.int64)
            if len(fresh) <= 1 << (TABLE_BITS - 1):
                self.add(fresh, found)
            out[missing] = found[back]
        return out


_compiled: dict[str, PieceCounts] = {}


def count_tokens(counts: PieceCounts, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text of a chunk."""
    data = buf.tobytes()
    cuts, special = offsets, []
    for mark in counts.special:
        at = data.find(mark)
        while at >= 0:
            end = int(offsets[np.searchsorted(offsets, at, side="right")])
            if at + len(mark) <= end:
                special.append(at)
                at = data.find(mark, at + len(mark))
            else:
                at = data.find(mark, at + 1)
    marked = np.array(sorted(special), dtype=np.int64)
    n_mark = len(counts.special[0]) if len(marked) else 0
    if len(marked):
        cuts = np.unique(np.concatenate([offsets, marked, marked + n_mark]))
    char_at = np.flatnonzero((buf & 0xC0) != 0x80)
    code = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    first = np.searchsorted(char_at, cuts[cuts < len(buf)])
    starts = char_at[piece_starts(classify(code, np.unique(first)))] if len(code) else char_at
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    emitted = counts.of(buf, starts, ends)
    if len(marked):
        within = (starts >= 0) & (np.searchsorted(marked, starts, side="right") > 0)
        begin = marked[np.maximum(np.searchsorted(marked, starts, side="right") - 1, 0)]
        within &= starts < begin + n_mark
        emitted[within] = starts[within] == begin[within]
    sums = np.concatenate([[0], np.cumsum(emitted)])
    at = np.searchsorted(starts, offsets)
    return sums[at[1:]] - sums[at[:-1]]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document; `vocabulary` is a path or a public file's name."""

    def run(batches):
        if vocabulary not in _compiled:
            import public_tokenizers

            path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
            _compiled[vocabulary] = PieceCounts(str(path))
        counts = _compiled[vocabulary]
        for batch in batches:
            for lo, hi, buf, offsets in W.chunks(batch.column("text"), 1 << 20):
                tokens = count_tokens(counts, buf, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
