"""Benchmark decontamination by canonical templates.

Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII and Latin-1 lower-cased. Typed placeholders
replace numbers (a word with a digit), units (a unit word after a number) and names (an initial capital
inside a sentence, the rest not capital). Windows of `k` template words are hashed. A window with fewer than
`min_literals` words that are no placeholder grows until it has so many: a window that starts at a word ends
where it has enough, and behind the last start of an item for which that is possible, windows that end at a
word begin where they have enough. So all of an item is covered, however dense its slots are. An item with
fewer literal words altogether, or with fewer than `k` words, is one template window of its whole length, if
it has a literal word; one of placeholders alone has no shape of its own and is matched by plain words only.
Items under 4 words cannot be told from ordinary text and take no part.

Benchmark windows fill a filter of fixed size, which lets documents drop windows that cannot match before
anything is shuffled; the hash join that follows is exact, whatever passed. Windows of plain words are
matched as well, so that words that stand verbatim match even where their surroundings change what counts as
a name. Matches are collected per document, item and
alignment; in an alignment the slots must agree one to one (a number or name of the item always becomes the
same one in the document, and no two become one), which tells a re-parameterised question from text that has
the same shape by chance. A document is contaminated by an item if the windows matched in consistent
alignments are at least `min_share` of the item's, of template windows or of plain ones, or if neighbouring
ones of an alignment cover at least `min_run` words: half of a long item is much more than a chance quotation.

Items with the same template are one family. Items of a family whose slots repeat at the same places agree
with the same documents, so the smallest item_id of them stands for their template windows; items that repeat
a value elsewhere keep theirs. Plain windows stay for every item. Those without a placeholder are the same in
a whole family and are joined once for it; they then count for its smallest item_id and for every item of
which the document also holds a window with its own values.

Documents that hold the same benchmark windows at the same distances, with slots that agree in the same places,
are one class (`match_classes`): sums of hashes per document tell them apart, nothing is gathered. Only the
smallest doc_id of a class is joined with the items, so a passage that many documents hold meets the items that hold it
once. `contaminated_documents` gives one row per document with its class; `contaminated` expands classes to pairs.

Null and empty texts match nothing. Rows without doc_id or item_id take no part. Repeated rows count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.llm import words as W
from surveyframe.llm.storage import stored

#: Unit words, taken as such only after a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ton tons ml cl dl l liter liters "
    "litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "c f k celsius fahrenheit kelvin v w kw kwh a j n pa hz percent usd eur gbp dollar dollars euro euros cent cents mph kmh"
).split()
FILTER_BITS = 22
LITERAL, NUMBER, NAME, UNIT = range(4)
_SIGNS = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B], dtype=np.uint64)
_BREAKS = W.byte_table(b".!?:;\n\r\"")


def _word_hashes(words: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    return W.byte_hash(buf, *W.spans(buf, np.array([0, len(buf)]), W.ALNUM_WORDS))


_UNIT_HASHES = np.sort(_word_hashes(UNITS))


def canonical(buf: np.ndarray, offsets: np.ndarray):
    """Word hashes, their kinds, and each text's first word."""
    lower = W.lowered(buf)
    starts, ends = W.spans(lower, offsets, W.ALNUM_WORDS)
    bounds = W.per_text(starts, offsets)
    literal = W.byte_hash(lower, starts, ends)
    n = len(starts)
    kinds = np.zeros(n, dtype=np.int8)
    if not n:
        return literal, kinds, bounds
    digits = np.flatnonzero((buf >= 48) & (buf <= 57))
    if len(digits):
        kinds[np.unique(np.searchsorted(starts, digits, side="right") - 1)] = NUMBER
    first = buf[starts]
    second = buf[np.minimum(starts + 1, len(buf) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    plain_rest = (ends - starts > 1) & ~((second >= 65) & (second <= 90))
    at = np.flatnonzero(capital & plain_rest & (kinds == LITERAL))
    opens = np.zeros(n, dtype=bool)
    opens[bounds[:-1][bounds[:-1] < n]] = True
    breaks = np.flatnonzero(~_BREAKS[buf])
    before = np.where(at > 0, ends[at - 1], 0)
    broken = np.searchsorted(breaks, starts[at]) > np.searchsorted(breaks, before)
    kinds[at[~broken & ~opens[at]]] = NAME
    after = np.flatnonzero(kinds[:-1] == NUMBER) + 1
    after = after[(kinds[after] == LITERAL) & ~opens[after]]
    place = np.minimum(np.searchsorted(_UNIT_HASHES, literal[after]), len(_UNIT_HASHES) - 1)
    kinds[after[_UNIT_HASHES[place] == literal[after]]] = UNIT
    return literal, kinds, bounds


def anchored(kinds: np.ndarray, bounds: np.ndarray, k: int, min_literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the windows with enough literals that start at a word, then of those over k words that end at one."""
    places = np.flatnonzero(kinds == LITERAL)
    before = np.searchsorted(places, np.arange(len(kinds) + 1))
    word = np.arange(len(kinds))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if len(places) < min_literals:
        return (np.zeros(0, np.int64),) * 4
    nth = before[:-1] + min_literals - 1
    stops = np.where(nth < len(places), np.maximum(places[np.minimum(nth, len(places) - 1)] + 1, word + k), len(kinds) + 1)
    fits = stops <= bounds[text + 1]
    nth = before[1:] - min_literals
    starts = np.where(nth >= 0, np.minimum(places[np.maximum(nth, 0)], word + 1 - k), -1)
    long = (starts >= bounds[text]) & (word + 1 - starts > k)
    return word[fits], stops[fits], starts[long], word[long] + 1


def whole_windows(kinds: np.ndarray, bounds: np.ndarray, size: int, k: int, min_literals: int) -> np.ndarray:
    """Starts of windows of `size` words with a literal word; from k words on, only those with fewer than `min_literals`."""
    at = W.windows(bounds, size)
    placed = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    n = placed[at + size] - placed[at]
    return at[(n > 0) & ((n < min_literals) | (size < k))]


def window_hashes(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int, kind: int) -> np.ndarray:
    return W.sequence_hash(words, starts, stops) ^ np.uint64(4 * size + kind)


def _slot_lists(literal: np.ndarray, kinds: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.ListArray:
    """Words of the number and name slots of each window."""
    places = np.flatnonzero((kinds == NUMBER) | (kinds == NAME))
    low, high = np.searchsorted(places, starts), np.searchsorted(places, stops)
    bounds = np.concatenate([[0], np.cumsum(high - low)])
    taken = np.repeat(low - bounds[:-1], high - low) + np.arange(bounds[-1])
    return W.list_array(W.signed(literal[places[taken]]), bounds, pa.int64())


def slot_patterns(literal: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: a hash of which of its slots hold the same word."""
    places = np.flatnonzero((kinds == NUMBER) | (kinds == NAME))
    of = W.owner(places, bounds)
    order = np.lexsort((places, literal[places], of))
    new = np.ones(len(places), dtype=bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (literal[places][order][1:] != literal[places][order][:-1])
    first = np.empty(len(places), dtype=np.int64)
    first[order] = places[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    at = np.searchsorted(places, bounds)
    return W.sequence_hash(W.mix((first - bounds[of] + 1).astype(np.uint64)), at[:-1], at[1:])


_ITEM_ROWS = (
    "id long, key long, family long, pattern long, at long, window long, slots array<long>, typed boolean, own boolean, "
    "size long, n_windows long, seq long, stop long"
)
#: Windows that start at a word, that end at one, of a whole item; each of template words, and plain ones.
OPENED, CLOSED, WHOLE, PLAIN = range(4)
_DOC_ROWS = "doc_id long, d_at long, d_window long, d_slots array<long>"


def benchmark_windows(benchmark: DataFrame, k: int, min_literals: int) -> DataFrame:
    """Windows of the items with their number per item; `own` marks plain windows that not all of the family hold.

    `key` tells texts that share an item_id apart.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in W.chunks(batch.column("text"), 1 << 16):
                numbers = batch.column("item_id").slice(lo, hi - lo)
                literal, kinds, bounds = canonical(buf, offsets)
                template = np.where(kinds == LITERAL, literal, _SIGNS[kinds])
                family = W.sequence_hash(template, bounds[:-1], bounds[1:])
                key = W.mix(W.sequence_hash(literal, bounds[:-1], bounds[1:])) ^ family
                pattern = slot_patterns(literal, kinds, bounds)
                placed = np.concatenate([[0], np.cumsum(kinds != LITERAL)])
                sizes = np.diff(bounds)

                def packed(parts, typed, size):
                    starts, stops, hashes = (np.concatenate(x) for x in zip(*parts))
                    of = W.owner(starts, bounds)
                    order = np.lexsort((stops, starts, of))
                    starts, stops, hashes, of = starts[order], stops[order], hashes[order], of[order]
                    seq = np.arange(len(of)) - np.searchsorted(of, of)
                    return pa.RecordBatch.from_arrays(
                        [
                            numbers.take(pa.array(of)), pa.array(W.signed(key[of])), pa.array(W.signed(family[of])), pa.array(W.signed(pattern[of])),
                            pa.array(starts - bounds[of], pa.int64()), pa.array(W.signed(hashes)),
                            _slot_lists(literal, kinds if typed else np.zeros_like(kinds), starts, stops),
                            pa.array(np.full(len(of), typed)), pa.array((placed[stops] > placed[starts]) & (not typed)),
                            pa.array(np.full(len(of), size)), pa.array(np.bincount(of, minlength=len(sizes))[of]),
                            pa.array(seq), pa.array(stops - bounds[of], pa.int64()),
                        ],
                        names=[c.split()[0] for c in _ITEM_ROWS.split(", ")],
                    )

                a, b, c, d = anchored(kinds, bounds, k, min_literals)
                last = np.zeros(len(sizes), dtype=np.int64)  # behind the last window that starts at a word
                np.maximum.at(last, W.owner(a, bounds), b)
                enough = sizes >= k
                a, b = a[enough[W.owner(a, bounds)]], b[enough[W.owner(a, bounds)]]
                behind = enough[W.owner(c, bounds)] & (d > last[W.owner(c, bounds)])
                c, d = c[behind], d[behind]
                yield packed([(a, b, window_hashes(template, a, b, k, OPENED)), (c, d, window_hashes(template, c, d, k, CLOSED))], True, k)
                for size in np.unique(sizes[(sizes >= 4) & ((sizes < k) | (last == 0))]).tolist():
                    at = whole_windows(kinds, bounds, size, k, min_literals)
                    at = at[sizes[W.owner(at, bounds)] == size]
                    yield packed([(at, at + size, window_hashes(template, at, at + size, size, WHOLE))], True, size)
                for size in [k, *range(4, k)]:
                    at = W.windows(bounds, size)
                    own = sizes[W.owner(at, bounds)]
                    at = at[own >= k if size == k else own == size]
                    yield packed([(at, at + size, window_hashes(literal, at, at + size, size, PLAIN))], False, size)

    read = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).distinct()
    rows = stored(read.mapInArrow(run, _ITEM_ROWS))
    # plain windows without a placeholder: one item for the family; template windows: one for the family and slot pattern
    group = ["family", "typed", F.when(F.col("typed"), F.col("pattern")).otherwise(0).alias("pattern")]
    chosen = rows.where(~F.col("own")).groupBy(*group).agg(F.min(F.struct("id", "key")).alias("c")).select(
        F.col("family").alias("c_family"), F.col("typed").alias("c_typed"), F.col("pattern").alias("c_pattern"),
        F.col("c.id").alias("c_id"), F.col("c.key").alias("c_key"),
    )
    shared = rows.where(~F.col("own")).join(
        chosen,
        (F.col("family") == F.col("c_family")) & (F.col("typed") == F.col("c_typed")) & (F.col("id") == F.col("c_id")) & (F.col("key") == F.col("c_key"))
        & (~F.col("typed") | (F.col("pattern") == F.col("c_pattern"))),
        "left_semi",
    )
    return stored(shared.unionByName(rows.where("own")).drop("pattern").distinct())


def held_windows(docs: DataFrame, items: DataFrame, k: int, min_literals: int) -> DataFrame:
    """Stored distinct windows (doc_id, d_at, d_window, d_slots) of the documents that some item holds."""
    shift = 64 - FILTER_BITS
    slots = items.select(F.shiftrightunsigned("window", shift).alias("slot"), "size", "typed").distinct().toArrow()
    possible = np.zeros(1 << FILTER_BITS, dtype=bool)
    possible[slots.column("slot").to_numpy().astype(np.int64)] = True
    lengths = sorted(set(zip(slots.column("size").to_pylist(), slots.column("typed").to_pylist())))
    longest = items.where("typed").agg(F.max(F.col("stop") - F.col("at"))).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(possible))

    def run(batches):
        allowed = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for lo, hi, buf, offsets in W.chunks(batch.column("text")):
                literal, kinds, bounds = canonical(buf, offsets)
                numbers = batch.column("doc_id").slice(lo, hi - lo)
                template = np.where(kinds == LITERAL, literal, _SIGNS[kinds])

                def packed(starts, stops, words, size, kind):
                    held = stops - starts <= longest if kind != PLAIN else slice(None)
                    starts, stops = starts[held], stops[held]
                    hashes = window_hashes(words, starts, stops, size, kind)
                    keep = allowed[hashes >> np.uint64(shift)]
                    starts, stops, of = starts[keep], stops[keep], W.owner(starts[keep], bounds)
                    return pa.RecordBatch.from_arrays(
                        [
                            numbers.take(pa.array(of)), pa.array(starts - bounds[of], pa.int64()), pa.array(W.signed(hashes[keep])),
                            _slot_lists(literal, kinds if kind != PLAIN else np.zeros_like(kinds), starts, stops),
                        ],
                        names=[c.split()[0] for c in _DOC_ROWS.split(", ")],
                    )

                a, b, c, d = anchored(kinds, bounds, k, min_literals)
                yield packed(a, b, template, k, OPENED)
                yield packed(c, d, template, k, CLOSED)
                for size, typed in lengths:
                    at = whole_windows(kinds, bounds, size, k, min_literals) if typed else W.windows(bounds, size)
                    yield packed(at, at + size, template if typed else literal, size, WHOLE if typed else PLAIN)

    read = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = stored(items.select("window").distinct())
    found = read.mapInArrow(run, _DOC_ROWS).join(known, F.col("d_window") == F.col("window"), "left_semi")
    return stored(found.distinct())


def match_classes(held: DataFrame) -> DataFrame:
    """Stored (doc_id, match_class): the smallest doc_id with the same windows at the same distances and the same equal slots."""

    def both(*columns: str) -> list:  # 128 bits; all rows hashed are distinct, so none cancels another
        return [F.bit_xor(F.xxhash64(F.lit(seed), *columns)).alias(f"h{seed}") for seed in (1, 2)]

    first = held.groupBy(F.col("doc_id").alias("f_doc")).agg(F.min("d_at").alias("first"))
    placed = held.join(first, F.col("doc_id") == F.col("f_doc")).withColumn("at", F.col("d_at") - F.col("first"))
    windows = placed.groupBy("doc_id").agg(*both("at", "d_window"), F.count(F.lit(1)).alias("n"))
    slots = placed.select("doc_id", "at", "d_window", F.posexplode("d_slots").alias("i", "word"))
    equal = slots.groupBy("doc_id", "word").agg(*both("at", "d_window", "i"), F.count(F.lit(1)).alias("n"))
    slots = equal.groupBy(F.col("doc_id").alias("s_doc")).agg(
        *(h.alias(f"s{k}") for k, h in enumerate(both("h1", "h2", "n"), 1)), F.count(F.lit(1)).alias("s_n")
    )
    marks = ["h1", "h2", "n", "s1", "s2", "s_n"]
    signed = stored(windows.join(slots, F.col("doc_id") == F.col("s_doc"), "left").select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in marks)))
    classes = stored(signed.groupBy(*(F.col(c).alias(f"c_{c}") for c in marks)).agg(F.min("doc_id").alias("match_class")))
    return stored(signed.join(classes, [F.col(c) == F.col(f"c_{c}") for c in marks]).select("doc_id", "match_class"))


def _judged(docs: DataFrame, benchmark: DataFrame, k: int, min_literals: int, min_share: float, min_run: int) -> tuple[DataFrame, DataFrame]:
    """Contaminating items of the first document of each class, and the classes."""
    items = benchmark_windows(benchmark, k, min_literals)
    held = held_windows(docs, items, k, min_literals)
    classes = match_classes(held)
    first = classes.where(F.col("doc_id") == F.col("match_class")).select("match_class")
    found = held.join(first, F.col("doc_id") == F.col("match_class"), "left_semi")
    matches = stored(
        found.join(items, F.col("d_window") == F.col("window")).select(
            "doc_id", F.col("id").alias("item_id"), "key", "family", "at", "n_windows", (F.col("d_at") - F.col("at")).alias("shift"),
            "slots", "d_slots", "typed", "own", "seq", "stop",
        )
    )
    place = ["doc_id", "item_id", "key", "shift"]
    pairs = matches.where("typed").select(*place, F.explode(F.arrays_zip("slots", "d_slots")).alias("x")).select(
        *place, F.col("x.slots").alias("mine"), F.col("x.d_slots").alias("theirs")
    )
    broken = pairs.groupBy(*place, "mine").agg((F.min("theirs") != F.max("theirs")).alias("bad")).unionByName(
        pairs.groupBy(*place, "theirs").agg((F.min("mine") != F.max("mine")).alias("bad")).withColumnRenamed("theirs", "mine")
    ).where("bad").select(*(F.col(c).alias(f"x_{c}") for c in place)).distinct()
    columns = [*place, "at", "n_windows", "typed", "seq", "stop"]
    consistent = matches.where("typed").join(broken, [F.col(c) == F.col(f"x_{c}") for c in place], "left_anti")
    plain = matches.where(~F.col("typed"))
    holders = plain.where("own").select(
        F.col("doc_id").alias("h_doc"), F.col("family").alias("h_family"), F.col("item_id").alias("h_item"), F.col("key").alias("h_key")
    ).distinct()
    lent = plain.where(~F.col("own")).join(holders, (F.col("doc_id") == F.col("h_doc")) & (F.col("family") == F.col("h_family"))).select(
        "doc_id", F.col("h_item").alias("item_id"), F.col("h_key").alias("key"), *columns[3:]
    )
    counted = consistent.select(*columns).unionByName(plain.select(*columns)).unionByName(lent)
    share = F.col("n_matched") / F.col("n_windows")
    kind = ["doc_id", "item_id", "key", "typed"]
    per_kind = counted.groupBy(*kind).agg(F.countDistinct("seq").alias("n_matched"), F.max("n_windows").alias("n_windows"))
    once = counted.groupBy(*kind, "shift", "seq").agg(F.min("at").alias("at"), F.max("stop").alias("stop"))
    island = F.col("seq") - F.row_number().over(Window.partitionBy(*kind, "shift").orderBy("seq"))
    runs = once.withColumn("island", island).groupBy(*kind, "shift", "island").agg((F.max("stop") - F.min("at")).alias("run"))
    runs = runs.groupBy("doc_id", "item_id").agg(F.max("run").alias("run_words"))
    best = per_kind.groupBy("doc_id", "item_id").agg(F.max(F.struct(share.alias("share"), "n_matched", "n_windows")).alias("x"))
    judged = best.join(runs, ["doc_id", "item_id"]).where((F.col("x.share") >= min_share) | (F.col("run_words") >= min_run)).select(
        F.col("doc_id").alias("of_class"), "item_id", "x.n_matched", "x.n_windows", "x.share", "run_words"
    )
    return judged, classes


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 8, min_literals: int = 5, min_share: float = 0.5, min_run: int = 50) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, share, run_words: one row per contaminated document and item.

    Where only template windows match, the item is the smallest one of its family and slot pattern.
    """
    judged, classes = _judged(docs, benchmark, k, min_literals, min_share, min_run)
    return classes.join(judged, F.col("match_class") == F.col("of_class")).drop("of_class", "match_class")


def contaminated_documents(
    docs: DataFrame, benchmark: DataFrame, k: int = 8, min_literals: int = 5, min_share: float = 0.5, min_run: int = 50
) -> DataFrame:
    """doc_id, match_class, item_id, n_matched, n_windows, share, run_words, n_items, items: one row per contaminated document.

    The item is the one with the largest share (then longest run, then smallest id); n_items counts all of them. `items`, ascending,
    stands on the row of the class's smallest doc_id (doc_id = match_class) and is null on the others, to which it applies alike.
    """
    judged, classes = _judged(docs, benchmark, k, min_literals, min_share, min_run)
    best = F.max(F.struct("share", "run_words", (-F.col("item_id")).alias("least"), "n_matched", "n_windows")).alias("x")
    of = stored(judged.groupBy("of_class").agg(best, F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items")))
    return classes.join(of, F.col("match_class") == F.col("of_class")).select(
        "doc_id", "match_class", (-F.col("x.least")).alias("item_id"), "x.n_matched", "x.n_windows", "x.share", "x.run_words", "n_items",
        F.when(F.col("doc_id") == F.col("match_class"), F.col("items")).alias("items"),
    )
