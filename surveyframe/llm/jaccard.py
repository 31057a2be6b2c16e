"""N-gram Jaccard join with signature trees: exact links between documents, as components.

1. Repeated shingles. Documents send the part of each shingle hash that a hash range does not imply,
   packed per batch and range, once per batch; each range finds which of its values occur in several
   different sets. A document whose share of such shingles is below the threshold cannot have a partner.
   (Shortened hashes can only make a shingle look repeated, which is the safe side.)
2. Equal sets become one vertex, their smallest doc_id, by a 128-bit digest of the whole set.
3. The vertices left count their tokens' sets, again by hash range, and give their prefix, rarest tokens
   first; two sets at the threshold share a token of both prefixes. Vertices that share one form candidate
   groups (connected components over tables). Passages that many sets share come last in the order, so
   they do not tie groups together.
4. A group is cut into tiles of bounded token count by hash, and the sets of each tile are linked. A task
   builds a signature tree: nodes hold the OR and the AND of their sets' token bitmaps and their size range.
   The dual traversal drops node pairs whose largest possible overlap misses the threshold; what is left
   is compared exactly. Pairs already connected are not compared again.
5. A prefix token is open while sets of different tiles and different components hold it. In star rounds
   each set with open tokens goes once to one set of the component it shares most of them with, in bounded
   chunks; links found close tokens. A large group of near copies is one component after that, whatever
   the number of its tiles. Rounds go on while they halve the sets with open tokens.
6. Sets whose tokens stay open are grouped and tiled anew, and every tile pair is one task's work. So no link
   is lost where the stars did not find it.
7. Links of all steps are joined to components once more.

Null and empty texts, and texts without a word, have an empty set and are linked with nothing. A null
doc_id has a null component. Rows that share a doc_id each get a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.llm import words as W
from surveyframe.llm.graph import components
from surveyframe.llm.prefilter import likely_members
from surveyframe.llm.ranges import ask, dump, header_range, load
from surveyframe.llm.storage import stored

FLUSH_TOKENS = 500_000
RANGE_BYTES = 8 << 20
TILE_TOKENS = 500_000
BITS = 1024
FANOUT = 8
PAIR_BLOCK = 1 << 12

_PACKED = "r long, batch binary, docs binary, counts binary, marks binary, hashes binary, known binary, ids binary, sizes binary, base binary, keys binary"
_PACKED_NAMES = [f.split()[0] for f in _PACKED.split(", ")]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle."""
    buf = W.LOWER[buf]
    starts, ends = W.spans(buf, offsets, W.SPACE_WORDS)
    bounds = W.per_text(starts, offsets)
    hashes = W.byte_hash(buf, starts, ends)
    sizes = np.diff(bounds)
    at = W.windows(bounds, k)
    shingles = W.sequence_hash(hashes, at, at + k)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    whole = W.sequence_hash(hashes, bounds[short], bounds[short + 1])
    out = []
    place = 0
    alone = dict(zip(short.tolist(), whole))
    for i, n in enumerate(sizes.tolist()):
        if n >= k:
            out.append(np.unique(shingles[place : place + n - k + 1]))
            place += n - k + 1
        else:
            out.append(np.array([alone[i]], dtype=np.uint64) if n else np.zeros(0, np.uint64))
    return out


def _pack(sets: list[np.ndarray], ids: list[int | None], n_ranges: int):
    keys = [hashlib.md5(s.tobytes()).digest() if len(s) else bytes(16) for s in sets]
    first: dict[bytes, int] = {}
    same_as = np.array([first.setdefault(key, i) for i, key in enumerate(keys)], dtype=np.int32)
    chosen = np.unique(same_as)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tokens = np.concatenate([sets[i] for i in chosen])
    owner = np.repeat(chosen, sizes[chosen])
    order = np.argsort(tokens)
    ranked = tokens[order]
    same = np.zeros(len(tokens) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    repeated = np.zeros(len(tokens), dtype=bool)
    repeated[order] = same[1:] | same[:-1]
    base = np.bincount(owner[repeated], minlength=len(sets)).astype(np.int64)
    known = np.unique(tokens[repeated])
    open_tokens, open_owner = tokens[~repeated], owner[~repeated]
    marks = np.frombuffer(b"".join(key[:8] for key in keys), dtype=np.uint64)

    def range_of(x):
        return ((x >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)

    r = range_of(open_tokens)
    order = np.argsort(r, kind="stable")
    r, open_tokens, open_owner = r[order], open_tokens[order].astype(np.uint32), open_owner[order]
    edges = np.searchsorted(r, np.arange(n_ranges + 1))
    known_r = range_of(known)
    known_edges = np.searchsorted(known_r, np.arange(n_ranges + 1))
    known = known.astype(np.uint32)
    numbers = np.array([0 if i is None else i for i in ids], dtype=np.int64)
    valid = np.array([i is not None for i in ids], dtype=np.int64)
    batch = hashlib.md5(b"".join(keys) + numbers.tobytes()).digest()
    rows = []
    for k in np.union1d(r, known_r).astype(np.int64).tolist():
        part = slice(edges[k], edges[k + 1])
        news = slice(known_edges[k], known_edges[k + 1])
        own = open_owner[part]
        turn = np.flatnonzero(np.diff(own, prepend=-1))
        counts = np.diff(np.append(turn, len(own)))
        rows.append((k, batch, own[turn].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), marks[own[turn]].tobytes(), open_tokens[part].tobytes(), known[news].tobytes(), None, None, None, None))
    header = (
        header_range(batch, n_ranges), batch, None, None, None, None, None, numbers.tobytes() + valid.tobytes(), sizes.tobytes(),
        base.tobytes() + same_as.tobytes(), b"".join(keys),
    )
    rows.append(header)
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[k] for row in part], pa.int64() if k == 0 else pa.binary()) for k in range(len(_PACKED_NAMES))], names=_PACKED_NAMES
        )


def _send(k: int, n_ranges: int):
    def run(batches):
        sets, ids, held = [], [], 0
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for lo, hi, buf, offsets in W.chunks(batch.column("text")):
                found = shingle_sets(buf, offsets, k)
                sets += found
                ids += numbers[lo:hi]
                held += sum(map(len, found))
                if held >= FLUSH_TOKENS:
                    yield from _pack(sets, ids, n_ranges)
                    sets, ids, held = [], [], 0
                    W.free_memory()
        if sets:
            yield from _pack(sets, ids, n_ranges)
        W.free_memory()

    return run


def _find_repeated(key, table):
    hashes = [np.frombuffer(h.as_py() or b"", np.uint32) for h in table.column("hashes")]
    known = [np.frombuffer(h.as_py() or b"", np.uint32) for h in table.column("known")]
    sets = [
        np.repeat(np.frombuffer(m.as_py() or b"", np.uint64), np.frombuffer(c.as_py() or b"", np.int32)) for m, c in zip(table.column("marks"), table.column("counts"))
    ]
    values, of = np.concatenate(hashes), np.concatenate(sets)
    order = np.lexsort((of, values))
    values, of = values[order], of[order]
    more = np.unique(np.concatenate([values[1:][(values[1:] == values[:-1]) & (of[1:] != of[:-1])], *known]))
    out = []
    for k, mine in enumerate(hashes):
        docs = np.frombuffer(table.column("docs")[k].as_py() or b"", np.int32)
        if not len(docs):
            continue
        counts = np.frombuffer(table.column("counts")[k].as_py(), np.int32)
        at = np.minimum(np.searchsorted(more, mine), max(len(more) - 1, 0))
        hit = (more[at] == mine) if len(more) else np.zeros(len(mine), bool)
        found = np.add.reduceat(hit.astype(np.int32), np.concatenate([[0], np.cumsum(counts)[:-1]]))
        some = found > 0
        out.append((table.column("batch")[k].as_py(), docs[some].tobytes(), found[some].astype(np.int32).tobytes(), None, None, None, None))
    for k, ids in enumerate(table.column("ids")):
        if ids.is_valid:
            out.append((table.column("batch")[k].as_py(), None, None, *(table.column(c)[k].as_py() for c in ("ids", "sizes", "base", "keys"))))
    del hashes, known, sets, values, of, order, more
    W.free_memory()
    names = ["batch", "docs", "found", "ids", "sizes", "base", "keys"]
    return pa.table({n: pa.array([row[k] for row in out], pa.binary()) for k, n in enumerate(names)})


def _add_up(key, table):
    headers = [k for k, x in enumerate(table.column("ids")) if x.is_valid]
    first = headers[0]
    sizes = np.frombuffer(table.column("sizes")[first].as_py(), np.int64)
    numbers, valid = np.frombuffer(table.column("ids")[first].as_py(), np.int64).reshape(2, -1)
    base = table.column("base")[first].as_py()
    total = np.frombuffer(base[: 8 * len(sizes)], np.int64).copy()
    keys = table.column("keys")[first].as_py()
    for docs, found in zip(table.column("docs"), table.column("found")):
        if docs.is_valid:
            np.add.at(total, np.frombuffer(docs.as_py(), np.int32), np.frombuffer(found.as_py(), np.int32))
    total = np.minimum(total, sizes)[np.frombuffer(base[8 * len(sizes) :], np.int32)]
    n = len(sizes)
    one = pa.table({
        "doc_id": pa.array(numbers, pa.int64(), mask=valid == 0), "n_shingles": pa.array(sizes), "repeated": pa.array(total),
        "set_key": pa.array([keys[16 * i : 16 * i + 16] if sizes[i] else None for i in range(n)], pa.binary()),
    })
    return pa.concat_tables([one] * len(headers))


def shingle_profile(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, repeated (shingles that other sets hold too), set_key per document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(8, -(-size // RANGE_BYTES))
    sent = docs.mapInArrow(_send(k, n_ranges), _PACKED)
    found = sent.groupBy("r").applyInArrow(
        _find_repeated, "batch binary, docs binary, found binary, ids binary, sizes binary, base binary, keys binary"
    )
    return found.groupBy("batch").applyInArrow(_add_up, "doc_id long, n_shingles long, repeated long, set_key binary")


def _sets_of(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in W.chunks(batch.column("text")):
                sets = shingle_sets(buf, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n", "tokens"],
                )

    return run


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(token, doc) of each set's n - ceil(num * n / den) + 1 rarest tokens."""

    def whole(held, ids):
        keys, index, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        header = dump(keys=keys, index=index.astype(np.int32), sizes=np.array([len(h) for h in held]), ids=np.array(ids, dtype=np.int64))
        return keys, [counts.astype(np.uint64)], header

    def prepare(batches):
        held, ids, size = [], [], 0
        for batch in batches:
            for number, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("tokens")):
                held.append(np.frombuffer(tokens.as_py(), np.uint64))
                ids.append(number)
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield whole(held, ids)
                    held, ids, size = [], [], 0
        if held:
            yield whole(held, ids)

    def judge(keys, counts):
        _, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, weights=counts.astype(np.float64))[of]
        return np.minimum(255, np.floor(8 * np.log2(total)))

    def finish(header, flags, copies):
        h = load(header)
        edges = np.concatenate([[0], np.cumsum(h["sizes"])])
        tokens, owners = [], []
        for number, a, b in zip(h["ids"], edges[:-1], edges[1:]):
            at = h["index"][a:b]
            own, n = h["keys"][at], int(b - a)
            cut = np.lexsort((own, flags[at]))[: n - (num * n + den - 1) // den + 1]
            tokens.append(own[cut])
            owners.append(np.full(len(cut), number))
        return pa.table({"token": pa.array(W.signed(np.concatenate(tokens))), "doc": pa.array(np.concatenate(owners), pa.int64())})

    size = (sets.agg(F.sum("n")).first()[0] or 0) * 16
    return ask(sets.select("doc_id", "tokens"), prepare, judge, finish, max(8, -(-size // RANGE_BYTES)), 1, "token long, doc long")


class SignatureTree:
    """Sets in a fixed order, grouped FANOUT at a time; level 0 holds the sets themselves."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        maps = np.zeros((len(sets), BITS // 8), dtype=np.uint8)
        for i, s in enumerate(sets):
            bits = np.zeros(BITS, dtype=np.uint8)
            bits[(s & np.uint64(BITS - 1)).astype(np.intp)] = 1
            maps[i] = np.packbits(bits)
        either = maps.view(np.uint64)
        self.levels = [(either, either, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > 1:
            any_, all_, low, high = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(any_, at), np.bitwise_and.reduceat(all_, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
            ))

    def possible(self, level: int, a: np.ndarray, other: SignatureTree, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which node pairs may hold sets with den * overlap >= num * union."""
        any_a, all_a, low_a, high_a = (x[a] for x in self.levels[level])
        any_b, all_b, low_b, high_b = (x[b] for x in other.levels[level])
        most = np.minimum(
            high_a - np.bitwise_count(all_a & ~any_b).sum(axis=1, dtype=np.int64), high_b - np.bitwise_count(all_b & ~any_a).sum(axis=1, dtype=np.int64)
        )
        return ((num + den) * most >= num * (low_a + low_b)) & (den * high_a >= num * low_b) & (den * high_b >= num * low_a)

    def depth(self) -> int:
        return len(self.levels)


def tree_pairs(left: SignatureTree, right: SignatureTree, num: int, den: int):
    """Blocks of leaf pairs (i, j) that survive the dual traversal; within one tree only i < j."""
    selfish = left is right
    top = min(left.depth(), right.depth()) - 1
    a = np.repeat(np.arange(len(left.levels[top][0])), len(right.levels[top][0]))
    b = np.tile(np.arange(len(right.levels[top][0])), len(left.levels[top][0]))
    stack = [(top, a[s : s + PAIR_BLOCK], b[s : s + PAIR_BLOCK]) for s in range(0, len(a), PAIR_BLOCK)]
    while stack:
        level, a, b = stack.pop()
        if selfish:
            keep = a <= b if level else a < b
            a, b = a[keep], b[keep]
        keep = left.possible(level, a, right, b, num, den)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            yield a, b
            continue
        step = np.arange(FANOUT)
        x = (a[:, None, None] * FANOUT + step[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
        y = (b[:, None, None] * FANOUT + step[None, None, :] + np.zeros((1, FANOUT, 1), np.int64)).ravel()
        inside = (x < len(left.levels[level - 1][0])) & (y < len(right.levels[level - 1][0]))
        x, y = x[inside], y[inside]
        stack += [(level - 1, x[s : s + PAIR_BLOCK], y[s : s + PAIR_BLOCK]) for s in range(0, len(x), PAIR_BLOCK)]


def link_sets(ids: np.ndarray, sets: list[np.ndarray], tile: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest connected id for each set, over exact links; if two tiles meet, only pairs across them."""
    bands = np.log([len(s) for s in sets]) // 0.22
    order = np.lexsort((np.array([s[0] for s in sets]), bands))
    parts = [order[tile[order] == t] for t in np.unique(tile)]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    trees = [SignatureTree([sets[i] for i in part]) for part in parts]
    for a, b in tree_pairs(trees[0], trees[-1], num, den):
        left, right = parts[0][a].tolist(), parts[-1][b].tolist()
        for i, j in zip(left, right):
            x, y = root(i), root(j)
            if x == y:
                continue
            s, t = sets[i], sets[j]
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            overlap = int(np.count_nonzero(t[at] == s))
            if (num + den) * overlap >= num * (len(s) + len(t)):
                if ids[x] > ids[y]:
                    x, y = y, x
                parent[y] = x
    return ids, np.array([ids[root(i)] for i in range(len(sets))], dtype=np.int64)


def _link_group(num: int, den: int):
    def run(key, table):
        ids = np.array(table.column("doc_id"), dtype=np.int64)
        sets = [np.frombuffer(t.as_py(), np.uint64) for t in table.column("tokens")]
        tile = np.array(table.column("tile"), dtype=np.int64)
        across = key[1].as_py() != key[2].as_py()
        if across and len(np.unique(tile)) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = link_sets(ids, sets, tile if across else np.zeros_like(tile), num, den)
        del sets
        W.free_memory()
        return pa.table({"a": a[a != b], "b": b[a != b]})

    return run


def compare(sets: DataFrame, places: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among the sets that `places` (root, i, j, tile, node) brings together; only across tiles where i and j differ."""
    work = sets.join(places, F.col("doc_id") == F.col("node")).select("root", "i", "j", "tile", "doc_id", "tokens")
    return stored(work.groupBy("root", "i", "j").applyInArrow(_link_group(num, den), "a long, b long"))


def tiled(near: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, root, tiles, tile: candidate groups of sets that share tokens, cut by hash into tiles of about TILE_TOKENS."""
    blocks = near.groupBy("token").agg(F.min("doc").alias("b"), F.max("doc").alias("most")).where(F.col("b") != F.col("most"))
    edges = near.join(blocks.select(F.col("token").alias("t"), "b"), F.col("token") == F.col("t")).select(F.col("doc").alias("a"), "b")
    members = components(edges).join(sizes, F.col("node") == F.col("doc_id")).select("node", "root", "n")
    tiles = members.groupBy("root").agg(F.sum("n").alias("total")).select(
        F.col("root").alias("g_root"), F.ceil(F.col("total") / TILE_TOKENS).cast("long").alias("tiles")
    )
    return stored(
        members.join(tiles, F.col("root") == F.col("g_root")).select("node", "root", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile"))
    )


def open_tokens(held: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `held` (token, doc, tile) whose token stands in several tiles and components, with a set of the smallest component."""
    of = known.select(F.col("node").alias("k_node"), F.col("root").alias("k_root"))
    now = held.join(of, F.col("doc") == F.col("k_node"), "left").select("token", "doc", "tile", F.coalesce("k_root", "doc").alias("component"))
    shared = now.groupBy("token").agg(
        F.min(F.struct("component", "doc")).alias("first"), F.max("component").alias("last"), F.min("tile").alias("t_low"), F.max("tile").alias("t_high")
    ).where((F.col("first.component") != F.col("last")) & (F.col("t_low") != F.col("t_high"))).select(
        F.col("token").alias("o_token"), F.col("first.component").alias("c_component"), F.col("first.doc").alias("center")
    )
    return stored(now.join(shared, F.col("token") == F.col("o_token")).drop("o_token"))


def stars(open_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Places of one round: each set at the center it shares most open tokens with, in chunks of about TILE_TOKENS."""
    asked = open_rows.where(F.col("component") != F.col("c_component")).groupBy("doc", "c_component", "center").agg(F.count(F.lit(1)).alias("shared"))
    chosen = asked.groupBy("doc").agg(F.max(F.struct("shared", (-F.col("center")).alias("least"))).alias("best")).select(
        F.col("doc").alias("node"), (-F.col("best.least")).alias("root")
    )
    chosen = stored(chosen.join(sizes, F.col("node") == F.col("doc_id")).select("node", "root", "n"))
    chunks = chosen.groupBy("root").agg(F.ceil(F.sum("n") / TILE_TOKENS).cast("long").alias("chunks"))
    leaves = chosen.join(chunks.withColumnRenamed("root", "g_root"), F.col("root") == F.col("g_root")).select(
        "root", F.lit(0).cast("long").alias("i"), (1 + F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("j"), F.lit(1).cast("long").alias("tile"), "node"
    )
    centers = chunks.select("root", F.lit(0).cast("long").alias("i"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("chunks"))).alias("j"),
                            F.lit(0).cast("long").alias("tile"), F.col("root").alias("node"))
    return leaves.unionByName(centers)


def linked(sets: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of every set with a link; `near` holds the prefix tokens (token, doc)."""
    sizes = stored(sets.groupBy("doc_id").agg(F.sum("n").alias("n")))
    placed = tiled(near, sizes)
    known = components(compare(sets, placed.select("root", F.col("tile").alias("i"), F.col("tile").alias("j"), "tile", "node"), num, den))
    split = placed.where(F.col("tiles") > 1).select(F.col("node").alias("p_node"), "tile")
    held = stored(near.join(split, F.col("doc") == F.col("p_node")).select("token", "doc", "tile"))

    def more(links: DataFrame) -> DataFrame:
        return components(links.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    def docs_of(rows: DataFrame) -> int:
        return rows.agg(F.countDistinct("doc")).first()[0]

    rows = open_tokens(held, known)
    left = docs_of(rows)
    while left:
        known = more(compare(sets, stars(rows, sizes), num, den))
        rows = open_tokens(held, known)
        before, left = left, docs_of(rows)
        if 2 * left > before:
            break
    if left:
        pairs = tiled(rows.select("token", "doc"), sizes).select(
            "node", "root", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("meets")
        )
        pairs = pairs.select("root", F.least("tile", "meets").alias("i"), F.greatest("tile", "meets").alias("j"), "tile", "node")
        known = more(compare(sets, pairs, num, den))
    return known


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; links where den * overlap >= num * union."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = stored(shingle_profile(read, k))
    vertices = profile.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    same = vertices.groupBy("set_key").agg(
        F.min("doc_id").alias("vertex"), F.max(den * F.col("repeated") >= num * F.col("n_shingles")).alias("possible")
    )
    wanted = stored(same.where("possible").select(F.col("vertex").alias("w_doc")))
    likely = likely_members(read, "doc_id", wanted, "w_doc")
    sets = stored(
        likely.join(wanted, F.col("doc_id") == F.col("w_doc"), "left_semi").mapInArrow(_sets_of(k), "doc_id long, n long, tokens binary")
        .where(F.col("n") > 0)
    )
    near = stored(prefixes(sets, num, den))
    found = linked(sets, near, num, den)
    of_set = same.select(F.col("set_key").alias("s_key"), "vertex").join(found, F.col("vertex") == F.col("node"), "left").select(
        "s_key", F.coalesce("root", "vertex").alias("component")
    )
    return profile.join(of_set, F.col("set_key") == F.col("s_key"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )
