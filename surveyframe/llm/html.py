"""Main text of web pages: nearest-URL page differencing, checked against page structure.

A page is cut into blocks in page order. Blocks inside scripts, styles, forms, navigation, asides, footers,
page headers, and inside elements whose class, id or role names them as such (adverts, notices, sidebars,
comments and the like) are left out. If the page marks its main part (article, main, or role main), its
candidates are the blocks in there, else all blocks that are left.

Every page is differenced: pages are paired within their host by the longest shared URL path (whole
segments) with pages of other content, so copies of a page never are its partners. The block sequences are aligned by longest
common subsequence, and shared blocks are deleted as template lines. A marked main part is the check on that: its text
is the article, and sentences that other articles hold too stay in it. There a shared block goes only if the page's structure
also says template: it is no heading, most of its characters are link text, it belongs to the unbroken run of such
blocks at the start or at the end of the part, and every partner that shares anything shares it.

On a page that marks no main part, if a pair shares more than `copy_share` of the page's characters, it may be
two versions of an article or short articles under long menus; then only lines are deleted that the page shares
with all of its up to PARTNERS nearest partners that share any. With one partner alone this cannot be told, and
what the two share is deleted. A partner's blocks are all its blocks, also those outside a main part it marks.

Partners come from aggregates over path prefixes (smallest and largest content hash and next segment per prefix), so a host with
a third of all pages is neither sorted nor gathered anywhere. What is deleted is decided on block hashes; pages are read again for their texts, and a
bitmap of fixed size lets only the texts of pages that may lose lines be shuffled, whatever their number.

Character references are decoded, white space within a block becomes one space, blocks are joined by an
empty line. A null html or one without text gives an empty text. A null url has no partner. Every row
gives a row; rows that share page_id are told apart nowhere but in their own html.
"""

from __future__ import annotations

import html as entities
import re
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.llm.prefilter import split_members
from surveyframe.llm.storage import stored

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul caption".split()
)
_LEFT_OUT = frozenset("nav aside footer form menu select button dialog fieldset head object canvas audio video map".split())
_OPTIONAL_END = frozenset("p li dt dd option tr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_SPACES = frozenset("br td th img".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments complementary "
    "contentinfo cookie cookies consent disqus footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice "
    "notices notification pager pagination popup promo promoted promotion related replies reply respond responses search share sharing sidebar "
    "sidebars signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_NAME = re.compile(r"[a-z]+")
#: Pages of other content that a page is differenced with, at most.
PARTNERS = 4


def _attributes(text: str) -> tuple[bool, bool]:
    """Whether the names say boilerplate, and whether the role says main."""
    left_out = main = False
    for m in _ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            left_out = True
        elif name != "aria-hidden":
            value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
            left_out |= not _BOILERPLATE.isdisjoint(_NAME.findall(value))
            main |= name == "role" and value == "main"
    return left_out, main


def blocks(page: str | None) -> tuple[list[str], bool, list[str], list[bool]]:
    """Texts of the kept blocks in page order, whether they come from a marked main part, the texts of all
    blocks, and for each kept block whether it is link text for the most part and no heading."""
    page = page or ""
    inside: list[str] = []
    every: list[str] = []
    text: list[str] = []
    linked: list[str] = []
    inside_links: list[bool] = []
    every_links: list[bool] = []
    in_link = in_heading = False
    skip_tag, skip_depth = "", 0
    mains: list[str] = []
    marked = False
    at = 0

    def close() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                links = not in_heading and bool(linked) and 2 * len(" ".join(entities.unescape("".join(linked)).split())) > len(joined)
                every.append(joined)
                every_links.append(links)
                if mains:
                    inside.append(joined)
                    inside_links.append(links)
            text.clear()
            linked.clear()

    for m in _MARKUP.finditer(page):
        if not skip_depth and m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked.append(text[-1])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        ending = m[2] == "/"
        if skip_depth:
            if tag == skip_tag and not m[4].endswith("/"):
                if skip_tag in _OPTIONAL_END and not ending:
                    skip_depth = 0
                else:
                    skip_depth += -1 if ending else 1
            elif skip_tag in _OPTIONAL_END and ending and tag in _BLOCKS and tag not in _OPTIONAL_END:
                skip_depth = 0
            if skip_depth or ending and tag == skip_tag:
                continue
        if tag in _BLOCKS:
            close()
            if tag in _HEADINGS:
                in_heading = not ending
        elif tag == "a":
            in_link = not ending
        elif tag in _SPACES:
            text.append(" ")
        if ending:
            if mains and tag == mains[-1]:
                mains.pop()
            continue
        left_out, main_role = _attributes(m[4]) if m[4] else (False, False)
        is_main = tag in ("article", "main") or main_role
        if tag in _LEFT_OUT or tag == "header" and not mains or left_out and not is_main and tag not in ("body", "html"):
            if tag not in _VOID and not m[4].endswith("/"):
                close()
                skip_tag, skip_depth = tag, 1
        elif is_main or mains and tag == mains[-1]:
            mains.append(tag)
            marked |= is_main
    if not skip_depth and at < len(page):
        text.append(page[at:])
    close()
    return (inside, marked, every, inside_links) if marked else (every, marked, every, every_links)


def shared_positions(mine: list[int], other: list[int]) -> set[int]:
    """Positions of `mine` in a longest common subsequence with `other`, exact for any number of repeats.

    Common ends are cut off and values of one side left out; the rest is a row of bits per value of `mine`
    (bit-parallel dynamic programming). Every root-th row is kept and those between are computed again on the
    way back, so memory grows with the length times its root.
    """
    low, n, m = 0, len(mine), len(other)
    while low < min(n, m) and mine[low] == other[low]:
        low += 1
    out = set(range(low))
    while min(n, m) > low and mine[n - 1] == other[m - 1]:
        n, m = n - 1, m - 1
        out.add(n)
    held = set(other[low:m])
    at = [i for i in range(low, n) if mine[i] in held]
    held = {mine[i] for i in at}
    b = [value for value in other[low:m] if value in held]
    places: dict[int, list[int]] = {}
    for j, value in enumerate(b):
        places.setdefault(value, []).append(j)
    full = (1 << len(b)) - 1

    def bits(value: int) -> int:
        out = bytearray(places[value][-1] // 8 + 1)
        for j in places[value]:
            out[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(out, "little")

    frequent = {value: bits(value) for value, js in places.items() if len(js) > 64}

    def after(row: int, i: int) -> int:
        value = mine[at[i]]
        match = row & (frequent[value] if value in frequent else bits(value))
        return (row + match | row - match) & full

    step = isqrt(len(at)) + 1
    kept, row = [], full
    for i in range(len(at)):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    j = len(b) - 1
    for block in range(len(kept) - 1, -1, -1):
        rows = [kept[block]]
        for i in range(block * step, min(len(at), (block + 1) * step)):
            rows.append(after(rows[-1], i))
        rows = [r.to_bytes(len(b) // 8 + 1, "little") for r in rows]
        for k in range(len(rows) - 1, 0, -1):  # a cleared bit: the subsequence gets longer at this place
            while j >= 0 and rows[k][j >> 3] >> (j & 7) & 1:
                j -= 1
            if j < 0:
                return out
            if rows[k - 1][j >> 3] >> (j & 7) & 1:
                out.add(at[block * step + k - 1])
                j -= 1
    return out


def template_lines(
    mine: list[int], lengths: list[int], links: list[bool], others: list[list[int]], marked: bool, copy_share: float
) -> list[int]:
    """Places of the blocks that the partners, nearest first, show to be template lines."""
    found = [shared for shared in (shared_positions(mine, other) for other in others) if shared]
    if not found:
        return []
    if marked:
        drop = {i for i in set.intersection(*found) if links[i]}
        n = len(mine)
        start = next((i for i in range(n) if i not in drop), n)
        end = next((i for i in range(n, 0, -1) if i - 1 not in drop), 0)
        return sorted(i for i in drop if i < start or i >= end)
    drop = found[0]
    if sum(lengths[i] for i in drop) > copy_share * sum(lengths):
        drop = set.intersection(*found)
    return sorted(drop)


def block_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


_CUT = "page_id long, url string, marked boolean, content long, mine array<long>, lengths array<int>, links array<boolean>, lines array<long>"
_TEXTS = "page_id long, url string, content long, blocks array<string>"


def _parsed(names: list[str], make):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                found = [blocks(h.as_py()) for h in part.column("html")]
                content = pa.array([block_hash("\n".join(t)) if t else None for t, *_ in found], pa.int64())
                made = {"page_id": part.column("page_id"), "url": part.column("url"), "content": content, **make(found)}
                yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

    return run


def _hashes(found):
    longs = pa.list_(pa.int64())
    return {
        "marked": pa.array([m for _, m, _, _ in found]),
        "mine": pa.array([[block_hash(x) for x in t] for t, *_ in found], longs),
        "lengths": pa.array([[len(x) for x in t] for t, *_ in found], pa.list_(pa.int32())),
        "links": pa.array([links for *_, links in found], pa.list_(pa.bool_())),
        "lines": pa.array([[block_hash(x) for x in every] if m else None for _, m, every, _ in found], longs),
    }


def _texts(found):
    return {"blocks": pa.array([t for t, *_ in found], pa.list_(pa.string()))}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def partners(pages: DataFrame) -> DataFrame:
    """The nearest pages of other content, deepest shared path first, at most PARTNERS for each page and content.

    From aggregates over path prefixes: with the smallest and the largest content of a prefix at hand, a page
    finds another content there if there is one.
    """
    split = pages.where(F.col("url").isNotNull() & F.col("page_id").isNotNull() & F.col("content").isNotNull()).select(
        "page_id", "content", F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1).alias("host"),
        F.split(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1), "/").alias("segments"),
    )
    levels = split.select(
        "page_id", "content", F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("level"), "host", "segments"
    ).select(
        "page_id", "content", "level", F.xxhash64("host", F.slice("segments", 1, F.col("level"))).alias("prefix"),
        F.when(F.col("level") < F.size("segments"), F.xxhash64(F.get("segments", F.col("level")))).alias("branch"),
    )
    by_content, by_branch = F.struct("content", "page_id"), F.struct("branch", "content", "page_id")
    groups = stored(
        levels.groupBy("level", "prefix").agg(
            F.min(by_content).alias("low"), F.max(by_content).alias("high"), F.min(by_branch).alias("first"), F.max(by_branch).alias("last")
        ).where(F.col("low.content") != F.col("high.content"))
    )
    ends = F.array(*(F.struct(F.col(f"{c}.content").alias("content"), F.col(f"{c}.page_id").alias("page_id")) for c in ("low", "high", "first", "last")))
    met = levels.join(groups, ["level", "prefix"]).select("page_id", F.col("content").alias("own"), "level", F.explode(ends).alias("other")).where(
        F.col("other.content") != F.col("own")
    )
    ranked = met.groupBy("page_id", "own").agg(
        F.array_sort(F.collect_set(F.struct((-F.col("level")).alias("depth"), F.col("other.content").alias("content"), F.col("other.page_id").alias("page"))))
        .alias("all")
    )
    once = F.filter("all", lambda x, i: ~F.exists(F.slice("all", F.lit(1), i), lambda y: y["content"] == x["content"]))
    return ranked.select("page_id", "own", F.posexplode(F.slice(once, 1, PARTNERS)).alias("rank", "x")).select(
        F.col("page_id").alias("p_page"), F.col("own").alias("p_content"), "rank", F.col("x.page").alias("partner"), F.col("x.content").alias("partner_content")
    )


def extract_text(pages: DataFrame, copy_share: float = 0.8) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    cut = stored(read.mapInArrow(_parsed(_names(_CUT), _hashes), _CUT))

    def decide(batches):
        columns = ["mine", "lengths", "links", "others", "marked"]
        for batch in batches:
            drops = [template_lines(*(x.as_py() for x in row), copy_share) for row in zip(*(batch.column(c) for c in columns))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("content"), pa.array(drops, pa.list_(pa.int32()))], names=["d_page", "d_content", "drop"]
            )

    lines = cut.select(F.col("page_id").alias("o_page"), F.col("content").alias("o_content"), F.coalesce("lines", "mine").alias("lines"))
    others = (
        partners(cut).join(lines, (F.col("partner") == F.col("o_page")) & (F.col("partner_content") == F.col("o_content")))
        .groupBy("p_page", "p_content").agg(F.array_sort(F.collect_set(F.struct("rank", "lines"))).alias("ranked"))
        .select("p_page", "p_content", F.col("ranked.lines").alias("others"))
    )
    asked = cut.join(others, (F.col("page_id") == F.col("p_page")) & (F.col("content") == F.col("p_content"))).select(
        "page_id", "content", "marked", "mine", "lengths", "links", "others"
    )
    dropped = stored(
        asked.mapInArrow(decide, "d_page long, d_content long, drop array<int>").where(F.size("drop") > 0)
        .groupBy("d_page", "d_content").agg(F.min("drop").alias("drop"))
    )
    touched, whole = split_members(read, "page_id", dropped, "d_page")
    texts = touched.mapInArrow(_parsed(_names(_TEXTS), _texts), _TEXTS).join(
        dropped, (F.col("page_id") == F.col("d_page")) & (F.col("content") == F.col("d_content")), "left"
    )
    left = F.filter("blocks", lambda x, i: F.col("drop").isNull() | ~F.array_contains("drop", i))
    out = whole.mapInArrow(_parsed(_names(_TEXTS), _texts), _TEXTS).select("page_id", "url", "blocks").unionByName(
        texts.select("page_id", "url", left.alias("blocks"))
    )
    return out.select("page_id", "url", F.array_join("blocks", "\n\n").alias("text")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
