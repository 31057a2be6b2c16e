"""Chat formatting, hard negatives and vector codes: brute force, round trips, odd rows, empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyframe.llm import chat, compress, negatives
from surveyframe.llm.chat import Template, Turn, chat_digests, format_chats, loss_text, read_back

CHATS = "conv_id long, turn long, role string, text string, row string, segments string"
VECTORS = "vec_id long, embedding array<float>, label int, v string, ref int, window string"


def said(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def brute_chats(rows):
    """Per conversation: (ordered turns, loss text)."""
    groups = {}
    for c, turn, role, text, *_ in rows:
        groups.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(g)] for c, g in groups.items()}
    return {c: (g, "".join(t for r, t in g if r == "assistant")) for c, g in turns.items()}


def escaped(text, template):
    out = []
    for k, ch in enumerate(text):
        out.append(ch)
        if ch == "\\" or any(text.startswith(c, k) for c in template.controls):
            out.append("\\")
    return "".join(out)


def brute_format(turns, template):
    out = [template.start]
    for role, text in turns:
        if role in template.turns:
            out += [template.turns[role].before, escaped(text, template), template.turns[role].after]
        else:
            a, b, c = template.other
            out += [a, escaped(role, template), b, escaped(text, template), c]
    return "".join(out)


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", " [/INST]", "[TEXT]", "\\", "\\\\", "<", "[", "/s>", "é", "\U0001f600", "\n", " ", "$1", "ok", "</", "s>", "[/"]
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "[ROLE]x", "", None])
            rows.append((c, t, role, "".join(rng.choices(bits, k=rng.randrange(0, 9))), "a", "b"))
    rows += [(50, 0, "user", None, None, None), (50, 1, "assistant", "", None, None), (51, None, "user", "x", None, None), (51, None, "user", "x", None, None)]
    rows += [(51, 3, "assistant", "b", None, None), (51, 3, "assistant", "a", None, None), (None, 0, "user", "n", None, None), (None, None, None, None, None, None)]
    rows += [(52, 0, "user", "word " * 200_000, None, None), (52, 1, "assistant", "[INST]" * 100_000, None, None)]
    return rows


def test_chats_against_brute_force(spark, chats):
    template = Template()
    out = {r["conv_id"]: r for r in format_chats(spark.createDataFrame(chats, CHATS)).select("*", read_back("formatted").alias("read"), loss_text("segments").alias("loss")).collect()}
    want = brute_chats(chats)
    assert set(out) == set(want)
    for c, (turns, loss) in want.items():
        assert out[c]["formatted"] == brute_format(turns, template)
        assert [(t["role"], t["text"]) for t in out[c]["read"]] == turns
        assert out[c]["loss"] == loss
        assert "".join(s["text"] for s in out[c]["segments"]) == out[c]["formatted"]
        assert sum(out[c]["formatted"].count(x) for x in ("[/INST]", "[/SYS]", "</s>", "[/TEXT]")) == len(turns)
    digests = {r["conv_id"]: r for r in chat_digests(format_chats(spark.createDataFrame(chats, CHATS))).collect()}
    for c, (turns, loss) in want.items():
        r = digests[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"]) == (len(turns), said(turns), len(loss))
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["formatted_chars"] == len(out[c]["formatted"])


def test_role_machine(spark):
    orders = {
        1: ["user", "assistant"], 2: ["system", "user", "assistant", "user"], 3: ["user", "user", "assistant"],
        4: ["assistant"], 5: ["system", "system"], 6: ["user", "tool", "assistant"], 7: ["user", "assistant", "user", "assistant"],
    }
    rows = [(c, k, r, "t", None, None) for c, rs in orders.items() for k, r in enumerate(rs)]
    out = {r["conv_id"]: (r["valid"], r["n_taken"]) for r in format_chats(spark.createDataFrame(rows, CHATS)).collect()}
    assert out == {1: (True, 2), 2: (False, 4), 3: (False, 1), 4: (False, 0), 5: (False, 1), 6: (False, 1), 7: (True, 4)}


def test_chats_of_an_empty_table_and_own_template(spark):
    none = chat_digests(format_chats(spark.createDataFrame([], CHATS)))
    assert none.count() == 0 and none.columns[0] == "conv_id"
    own = Template(
        start="{b}", turns={"q": Turn("{q}", "{/q}"), "a": Turn("{a}", "{/a}", loss=True)}, other=("{o}", "{t}", "{/o}"),
        controls=("{b}", "{q}", "{/q}", "{a}", "{/a}", "{o}", "{t}", "{/o}"), steps={"start": ("q",), "q": ("a",), "a": ("q",)}, accepted=("a",),
    )
    rows = [(1, 0, "q", "{a}{/q}", None, None), (1, 1, "a", "x{b}", None, None), (1, 2, "z{t}", "{", None, None)]
    r = format_chats(spark.createDataFrame(rows, CHATS), own).select("formatted", read_back("formatted", own).alias("t")).first()
    assert r["formatted"] == "{b}{q}{\\a}{\\/q}{/q}{a}x{\\b}{/a}{o}z{\\t}{t}{{/o}"
    assert [tuple(t) for t in r["t"]] == [("q", "{a}{/q}"), ("a", "x{b}"), ("z{t}", "{")]
    for bad in (dict(controls=("<s>", "<s><s>")), dict(turns={"a": Turn("[INST] ", "</s>"), "b": Turn("[INST]", " [/INST]")}), dict(turns={"a": Turn(" ", " end")})):
        with pytest.raises(ValueError):
            Template(**bad)


def vector_rows(seed, n, dim=16, scale=1.0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * scale
    x[:copies] = x[0]
    x[copies : 2 * copies] = x[copies] + rng.normal(size=(copies, dim)) * 0.01 * scale
    return [(int(i), [float(np.float32(c)) for c in row], int(rng.integers(0, 4)), "v", 1, "w") for i, row in enumerate(x)]


def odd_vectors(dim=16):
    bad = [0.5] * dim
    return [
        (900, None, 1, "v", 1, "w"), (950, bad[:3] + [None] + bad[4:], 1, None, None, None), (1000, bad[:3] + [float("nan")] + bad[4:], 1, None, None, None),
        (1050, bad[:3] + [float("-inf")] + bad[4:], 1, None, None, None), (1100, bad, None, None, None, None), (None, bad, 2, None, None, None),
        (1150, [0.0] * dim, 1, None, None, None), (1200, [], 2, None, None, None), (1250, bad[:5], 3, None, None, None), (1250, bad[:5], 3, None, None, None),
    ]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, scale=256, n_pos=5, n_neg=3, every=50):
    kept = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and finite(v):
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    width = max((len(v) for _, v in kept.values()), default=0)
    ints = {i: [math.floor(scale * x) for x in v] + [0] * (width - len(v)) for i, (_, v) in kept.items()}
    out = set()
    for a in (i for i in kept if i % every == 0):
        score = {i: sum(p * q for p, q in zip(ints[a], ints[i])) for i in kept if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == kept[a][0]][:n_pos]:
            good = [i for i in order if kept[i][0] != kept[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:n_neg]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(good, 1)}
    return out


@pytest.mark.parametrize("rows, wave", [(vector_rows(1, 400) + odd_vectors(), 1 << 20), (vector_rows(2, 300, scale=40.0, copies=100), 256), (odd_vectors(), 1 << 20)])
def test_negatives_against_brute_force(spark, rows, wave):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, wave_bytes=wave, n_ranges=5)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)


def test_negatives_without_rows_or_queries(spark):
    df = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).count() == 0
    df = spark.createDataFrame([(1, [1.0], 1, "v", 1, "w"), (2, [1.0], 2, "v", 1, "w")], VECTORS)
    assert negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).count() == 0


def test_windows_reach_every_wanted_row():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    x = np.floor(256 * np.concatenate([rng.normal(size=(200, 8)), centre + 0.05 * rng.normal(size=(200, 8))])).astype(np.int64)
    refs = negatives.directions(x, 5)
    rows_angle, rows_ref = negatives.angles(x, refs), negatives.angles(x, refs).argmin(axis=1)
    q = negatives.Queries(np.arange(50), np.zeros(50, np.int64), x[::8], refs, np.zeros((50, 1), np.int64), np.zeros((50, 1), np.int64))
    pruned = 0
    for ref in range(5):
        here = np.flatnonzero(rows_ref == ref)
        here = here[np.argsort(rows_angle[here, ref])]
        norms = np.sqrt((x[here].astype(float) ** 2).sum(axis=1))
        scores = q.values @ x[here].T
        for low, high in ((-20_000, 5_000), (1, 40_000), (60_000, 10**9)):
            start, end = negatives._window(q, np.arange(50), ref, rows_angle[here, ref], norms, np.full(50, float(low)), np.full(50, float(high)))
            inside = (np.arange(len(here)) >= start[:, None]) & (np.arange(len(here)) < end[:, None])
            assert not (((scores >= low) & (scores <= high)) & ~inside).any()
            pruned += (~inside).sum()
    assert pruned > 1000


def brute_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    kept = [(i, label, v) for i, v, label, *_ in rows if finite(v)]
    width = max((len(v) for _, _, v in kept), default=0)
    width = max(1, -(-width // parts))
    ints = [[math.floor(scale * x) for x in v] + [0] * (width * parts - len(v)) for _, _, v in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    first = sorted((i, v) for (i, _, _), v in zip(kept, ints) if i is not None)[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v in first] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(v[p], books[p])[1] for v in cut]
            books[p] = [
                [sum(v[p][c] for v, o in zip(cut, of) if o == k) // of.count(k) for c in range(width)] if k in of else e for k, e in enumerate(books[p])
            ]
    out = []
    for (i, label, _), v in zip(kept, cut):
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, e, sum(x[3] for x in out if x[1] == label), digest) for i, label, code, e in out]


@pytest.mark.parametrize("rows", [vector_rows(5, 150) + odd_vectors(), vector_rows(6, 80, dim=11, scale=900.0, copies=30), vector_rows(7, 5)])
def test_codes_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    out = compress.code_report(df)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute_codes(rows), key=repr)


def test_codes_of_an_empty_table_and_of_too_large_components(spark):
    assert compress.code_report(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        compress.code_report(spark.createDataFrame([(1, [1e30] * 8, 1, "v", 1, "w")], VECTORS))


def test_limb_products_are_exact():
    rng = np.random.default_rng(8)
    a, b = (rng.integers(-(2**29) + 1, 2**29, size=(n, 8)) for n in (40, 16))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert compress.exact_products(a, b).tolist() == want
    ties = np.array([[3, 3], [3, 3], [0, 0]])
    assert compress.nearest(np.array([[3, 3], [2, 1]]), ties)[0].tolist() == [0, 0] and compress.nearest(np.array([[1, 1]]), ties)[1].tolist() == [2]


def test_chat_module_uses_no_python_on_workers(spark):
    plan = chat.chat_digests(chat.format_chats(spark.createDataFrame([(1, 0, "user", "x", None, None)], CHATS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_codebook_rounds_take_one_job_each_at_any_number_of_partitions(spark):
    table = [(i, i % 3, [math.sin(i * k + 1.0) for k in range(16)]) for i in range(60)]
    rows, length = compress.integers(spark.createDataFrame(table, "vec_id long, label int, embedding array<float>"), 4096, 8)
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    context = spark.sparkContext
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        context.setJobGroup("codebooks", "codebooks")
        compress.fit_codebooks(rows, length, 8, 16, 6)
        assert len(context.statusTracker().getJobIdsForGroup("codebooks")) < 40
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
