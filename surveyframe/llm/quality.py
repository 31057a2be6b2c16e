"""Quality rules with cross-document line frequency.

A line is its words with A-Z lower-cased, joined by one space; lines without a word do not count. A line is over the
limit of its host if more of the host's different texts hold it than `max_share` of them and than
`min_texts` (exact copies of a text count once: copies are a matter for deduplication, not for this rule). The limit follows the
size of the host; `min_texts` keeps hosts of a few texts from losing lines that two or three share. A document
whose remaining words fall below `min_left` of its words is depleted and rejected, besides the rules
on the document by itself. `clean_lines` gives the texts without the lines over the limit.

Lines are hashed where the text is read and leave it as one pair of numbers each. Counting merges
partial counts before the shuffle; the join back has one row per line over the limit on one side, so
a line that a third of all documents hold is a large partition of a sort-merge join that Spark can
split.

Null, empty and blank texts have no words, fail the base rules and are not kept. A null source is a
host of its own. Rows that share a doc_id and a host each get a result for their own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.llm import words as W
from surveyframe.llm.prefilter import split_members
from surveyframe.llm.storage import stored

SYMBOLS = b"#*$%&|<>"
_STATS = (
    "doc_id long, source string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<long>, line_words array<int>"
)


def _repeated(group: np.ndarray, key: np.ndarray, later_only: bool) -> np.ndarray:
    """Which (group, key) pairs occur twice or more; with later_only the first one is not marked."""
    out = np.zeros(len(key), dtype=bool)
    if len(key):
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
        marked = np.zeros(len(key), dtype=bool)
        marked[1:] = same
        if not later_only:
            marked[:-1] |= same
        out[order] = marked
    return out


def text_statistics(buf: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Per text: counts, the hash of its words, and its normalised lines with their word counts."""
    starts, ends = W.spans(buf, offsets, W.SPACE_WORDS)
    bounds = W.per_text(starts, offsets)
    letters = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(W.SPACE_WORDS[buf] & ((buf & 0xC0) != 0x80), out=letters[1:])
    symbols = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(~W.byte_table(SYMBOLS)[buf], out=symbols[1:])

    plain = W.byte_hash(buf, starts, ends)
    at = W.windows(bounds, window)
    seen = W.sequence_hash(plain, at, at + window)
    again = at[_repeated(W.owner(at, bounds), seen, later_only=False)]
    repeat = W.count_in(W.covered(again, window, len(starts)), bounds)

    line_starts, line_ends = W.spans(buf, offsets, W.LINES)
    first = np.searchsorted(starts, line_starts)
    last = np.searchsorted(starts, line_ends)
    worded = last > first
    line_starts, line_ends, first, last = line_starts[worded], line_ends[worded], first[worded], last[worded]
    of = W.per_text(line_starts, offsets)
    exact = W.byte_hash(buf, line_starts, line_ends)
    doubled = _repeated(W.owner(np.arange(len(exact)), of), exact, later_only=True)
    lower = W.byte_hash(W.LOWER[buf], starts, ends)
    return {
        "text_key": W.signed(W.sequence_hash(plain, bounds[:-1], bounds[1:])),
        "n_words": np.diff(bounds),
        "word_chars": letters[offsets[1:]] - letters[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": W.count_in(doubled, of),
        "n_repeat_words": repeat,
        "lines": W.list_array(W.signed(W.sequence_hash(lower, first, last)), of, pa.int64()),
        "line_words": W.list_array(last - first, of, pa.int32()),
    }


def _statistics(window: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in W.chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                found = text_statistics(buf, offsets, window)
                arrays = [part.column("doc_id"), part.column("source"), *(pa.array(v) for v in found.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "source", *found])

    return run


def _read(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("source"), F.col("text").cast("string").alias("text")
    )


def frequent_lines(stats: DataFrame, max_share: float, min_texts: int) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, source, text_key, line, words), and the stored (o_source, o_line) over their host's limit."""
    texts = (
        stats.where(F.col("n_words") > 0).groupBy("source", "text_key").agg(F.lit(1).alias("one"))
        .groupBy(F.col("source").alias("t_source")).agg(F.count("*").alias("all_texts"))
    )
    lines = stats.select(
        "doc_id", "source", "text_key", F.explode(F.arrays_zip("lines", "line_words")).alias("x")
    ).select("doc_id", "source", "text_key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    counted = (
        lines.groupBy("source", "line", "text_key").agg(F.lit(1).alias("one"))
        .groupBy("source", "line").agg(F.count("*").alias("texts")).where(F.col("texts") > min_texts)
    )
    over = counted.join(texts, F.col("source").eqNullSafe(F.col("t_source"))).where(F.col("texts") > max_share * F.col("all_texts"))
    return lines, stored(over.select(F.col("source").alias("o_source"), F.col("line").alias("o_line")))


def _over_limit(lines: DataFrame, over: DataFrame) -> DataFrame:
    return lines.join(over, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("line") == F.col("o_line")), "left_semi")


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    window: int = 8,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_share: float = 0.05,
    min_texts: int = 5,
    min_left: float = 0.3,
    max_symbol_share: float = 0.06,
    max_dup_lines_share: float = 0.5,
) -> DataFrame:
    """One row per document: counts, base_failed, n_line_words_removed, depleted, kept."""
    stats = stored(_read(docs, host).mapInArrow(_statistics(window), _STATS))
    lines, over = frequent_lines(stats, max_share, min_texts)
    key = ["doc_id", "source", "text_key"]
    copies = stats.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    copies = copies.select(F.col("doc_id").alias("c_doc"), F.col("source").alias("c_source"), F.col("text_key").alias("c_key"), "copies")
    removed = _over_limit(lines, over).groupBy(*key).agg(F.sum("words").alias("words"))
    repeated = F.col("doc_id").eqNullSafe(F.col("c_doc")) & F.col("source").eqNullSafe(F.col("c_source")) & (F.col("text_key") == F.col("c_key"))
    # A row that stands several times has its lines several times.
    each = F.floor(F.col("words") / F.coalesce("copies", F.lit(1)))
    removed = removed.join(copies, repeated, "left").select(
        F.col("doc_id").alias("r_doc"), F.col("source").alias("r_source"), F.col("text_key").alias("r_key"), each.alias("line_words_removed")
    )
    n = F.col("n_words")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    gone = F.coalesce(F.col("line_words_removed"), F.lit(0))
    n_lines = F.size("lines")
    depleted = n - gone < min_left * n
    verdict = ~depleted & (F.col("n_symbols") <= max_symbol_share * F.col("word_chars")) & (F.col("n_dup_lines") <= max_dup_lines_share * n_lines)
    same = F.col("doc_id").eqNullSafe(F.col("r_doc")) & F.col("source").eqNullSafe(F.col("r_source")) & (F.col("text_key") == F.col("r_key"))
    return stats.join(removed, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & verdict).alias("kept"), gone.cast("long").alias("n_line_words_removed"), depleted.alias("depleted"),
    )


def clean_lines(docs: DataFrame, host: str = "source", max_share: float = 0.05, min_texts: int = 5) -> DataFrame:
    """`docs` with the lines over their host's limit taken out of the texts; other columns as they are.

    Only texts that may lose a line are shuffled. Rows that share doc_id and host lose the same lines, which are
    over the limit there whichever row holds them. A text that loses nothing, or is null, stays as it is.
    """
    stats = stored(_read(docs, host).mapInArrow(_statistics(8), _STATS))
    lines, over = frequent_lines(stats, max_share, min_texts)
    sets = stored(
        _over_limit(lines, over).groupBy(F.col("doc_id").alias("s_doc"), F.col("source").alias("s_source")).agg(F.collect_set("line").alias("s_lines"))
    )
    names = docs.columns
    known = docs.where(F.col("doc_id").isNotNull())
    touched, whole = split_members(known, "doc_id", sets, "s_doc")
    touched = touched.unionByName(docs.where(F.col("doc_id").isNull()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("s_doc")) & F.col(host).cast("string").eqNullSafe(F.col("s_source"))
    joined = touched.join(sets, same, "left").drop("s_doc", "s_source")

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, gone in enumerate(batch.column("s_lines").to_pylist()):
                if not gone or texts[k] is None:
                    continue
                gone, kept = set(gone), []
                found = text_statistics(*_bytes(texts[k]), 8)["lines"].values.to_pylist()
                at = 0
                for line in texts[k].split("\n"):
                    worded = bool(line.strip(" \t\n\v\f\r"))
                    if not (worded and found[at] in gone):
                        kept.append(line)
                    at += worded
                texts[k] = "\n".join(kept)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return whole.unionByName(joined.mapInArrow(cut, docs.schema))


def _bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(text.encode(), dtype=np.uint8)
    return buf, np.array([0, len(buf)], dtype=np.int64)
