"""Each corpus operator against brute force, on odd rows, and on empty tables."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from surveyframe.llm import decontaminate, html, jaccard, language, licenses, pieces, quality, ranges, substrings, tokens, warc
from surveyframe.llm import words as W
from surveyframe.llm.graph import components
from surveyframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, token string, r int, header string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def rows(texts, start=1):
    return [(i, t, "en", "s", len(t or ""), 7, "x", 3, "h") for i, t in enumerate(texts, start)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    base = rng.choices(vocabulary, k=80)
    near = base[:40] + ["changed"] + base[41:]
    texts = [None, "", " \n\t ", "one", "one", passage, "lead " + passage + " tail", " ".join(base), " ".join(near), " ".join(base).upper()]
    texts += [passage[:200] + "\n" + passage, " ".join(["de"] * 70), " ".join(["de"] * 55) + " end", " ".join(f"u{k}" for k in range(60_000)), "é ü ß ▁ x y"]
    data = rows(texts)
    data += [data[5], (None, passage, None, None, None, None, None, None, None), (99, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").limit(10_000)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def all_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# shared pieces


def test_spans_and_hashes_do_not_cross_texts():
    texts = ["ab c", "", None, "c d", " x"]
    for _, _, buf, at in W.chunks(pa.array(texts)):
        starts, ends = W.spans(buf, at, W.SPACE_WORDS)
        assert [buf[a:b].tobytes() for a, b in zip(starts, ends)] == [b"ab", b"c", b"c", b"d", b"x"]
        assert W.per_text(starts, at).tolist() == [0, 2, 2, 2, 4, 5]
        hashes = W.byte_hash(buf, starts, ends)
        assert hashes[1] == hashes[2] and len(set(hashes.tolist())) == 4


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (9, 8), (8, 7), (7, 9), (5, 5)]
    found = collected(components(spark.createDataFrame(edges, "a long, b long")), "node", "root")
    assert found == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# 1


def jaccard_brute(data):
    sets = []
    for doc, text in data:
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((d, len(s), root(d)) for d, s in sets), key=repr)


@pytest.mark.parametrize("name", ["odd", "real"])
def test_jaccard(request, name):
    docs = request.getfixturevalue(name)
    assert collected(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == jaccard_brute(all_rows(docs))


def test_jaccard_tiles_and_tree(spark, monkeypatch):
    rng = random.Random(1)
    data = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(100)]
        for c in range(12):
            w = list(base)
            w[rng.randrange(100)] = f"n{g}{c}"
            data.append(" ".join(w))
    docs = spark.createDataFrame(rows(data), SCHEMA)
    monkeypatch.setattr(jaccard, "TILE_TOKENS", 300)
    assert collected(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == jaccard_brute(all_rows(docs))


def test_jaccard_large_group_sends_each_set_a_few_times(spark, monkeypatch):
    sent = []
    compare = jaccard.compare

    def counting(sets, places, num, den):
        sent.append(places.count())
        return compare(sets, places, num, den)

    monkeypatch.setattr(jaccard, "compare", counting)
    monkeypatch.setattr(jaccard, "TILE_TOKENS", 2_400)
    per_set = []
    for n in (100, 400):
        rng = random.Random(n)
        data = [" ".join(f"n{c}" if k == at else f"w{k}" for k in range(100)) for c in range(n) for at in [rng.randrange(100)]]
        docs = spark.createDataFrame(rows(data), SCHEMA)
        sent.clear()
        assert collected(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == jaccard_brute(all_rows(docs))
        per_set.append(sum(sent) / n)
    assert max(per_set) < 2.5 and per_set[1] < 1.25 * per_set[0]


def test_jaccard_chain_over_tiles(spark, monkeypatch):
    """Each text links with its two neighbours only: what the stars leave is found by tile pairs."""
    monkeypatch.setattr(jaccard, "TILE_TOKENS", 500)
    order = list(range(40))
    random.Random(2).shuffle(order)
    docs = spark.createDataFrame(rows([" ".join(f"w{k}" for k in range(8 * i, 8 * i + 100)) for i in order]), SCHEMA)
    found = collected(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    assert found == jaccard_brute(all_rows(docs)) and {x[2] for x in found} == {1}


def test_signature_tree_finds_every_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        core = rng.integers(1, 1 << 63, rng.integers(2, 60)).astype(np.uint64)
        sets += [np.unique(core), np.unique(np.concatenate([core, rng.integers(1, 1 << 63, 2).astype(np.uint64)]))]
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 180 * o >= 80 * (len(sets[i]) + len(sets[j])):
                want.add((i, j))
    tree = jaccard.SignatureTree(sets)
    got = {(int(i), int(j)) for a, b in jaccard.tree_pairs(tree, tree, 80, 100) for i, j in zip(a, b)}
    assert want <= got and len(got) < 400


# 2


def test_warc(spark):
    data = [(1, "u", "a"), (2, "u\r\nx", "é\r\n\r\nWARC/1.1\r\n"), (3, None, "a"), (4, "z", None), (None, "q", "a"), (7, "z", ""), (None, None, "only"), (8, "w", "x" * 300_000), (3, None, "a"), (1, "u2", "solo")]
    pages = spark.createDataFrame([(*d, "clash", 1) for d in data], "page_id long, url string, html string, payload string, original int")
    path = warc.write_archives(pages)
    found = warc.resolve(warc.read_archives(spark, path))
    best = {}
    for p, _, h in data:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in data:
        raw = (h or "").encode()
        top = best[h or ""]
        revisit = top >= 0 and top != p
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert collected(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    kept = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path, payloads=True).where("record_type = 'response'").collect()}
    assert bytes(kept[2]).decode() == data[1][2] and len(kept[8]) == 300_000
    nothing = warc.write_archives(pages.limit(0))
    assert warc.resolve(warc.read_archives(spark, nothing)).count() == 0


# 3


def substring_brute(data, k=20):
    seen, out = set(), {}
    for doc, text in sorted(data, key=lambda x: (x[0] is None, x[0])):
        if doc is None:
            continue
        w = SPACE.findall(text or "")
        gone = [False] * len(w)
        if doc not in out:
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                if key in seen:
                    gone[i : i + k] = [True] * k
                seen.add(key)
            out[doc] = (doc, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return [out[doc] if doc is not None else None for doc, _ in data]


@pytest.mark.parametrize("name", ["odd", "real"])
def test_substring_dedup(request, name):
    docs = request.getfixturevalue(name)
    got = [x for x in collected(substrings.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") if x[0] is not None]
    assert got == sorted((x for x in substring_brute(all_rows(docs)) if x), key=repr)


def test_removed_spans_leave_other_columns(odd):
    out = substrings.remove_spans(odd)
    assert out.columns == odd.columns
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[7]["text"] == "lead tail" and by_id[7]["n_chars"] == 9 and by_id[7]["token"] == "x" and by_id[2]["text"] == ""


# 4


def test_licences(odd, spark):
    extra = ["CC-BY cc by. All-rights\nRESERVED", "SPDX-License-Identifier: MIT OR (GPL-3.0-only AND Apache-2.0 WITH LLVM-exception)", "cc by " * 400, "Lesser General Public License", "ccby cc"]
    docs = odd.unionByName(spark.createDataFrame(rows(extra, 200), SCHEMA))
    out = licenses.license_scan(docs)
    want = []
    for doc, text in all_rows(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            q = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(q)] == q]
            at += hits
            labels |= {label} if hits else set()
        want.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert collected(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[201]["labels"] == "apache-2.0,gpl-3.0-only,llvm-exception,mit" and by_id[201]["score"] == 1.0
    prose = ["A license identifier is required", "SPDX license identifier of the file", "license-expression: see LICENSE file", "License identifier: WITH care"]
    tagged = ["SPDX-License-Identifier:\n# GPL-2.0-or-later WITH Classpath-exception-2.0", "license expression = (mit) -- see below", '"License-Identifier": "Apache-2.0 OR nonsense"']
    got = licenses.license_scan(spark.createDataFrame(rows(prose + tagged), SCHEMA)).orderBy("doc_id").collect()
    assert [(r["labels"], r["score"]) for r in got[:4]] == [("", 0.0)] * 4
    assert [r["labels"] for r in got[4:]] == ["classpath-exception-2.0,gpl-2.0-or-later", "mit", "apache-2.0"]
    assert licenses.to_postfix("(MIT OR") == [] and licenses.to_postfix("A AND B OR C") == ["A", "B", "and", "C", "or"]


# 5


@pytest.mark.parametrize("name", ["odd", "real"])
def test_token_counts(request, name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    docs = request.getfixturevalue(name)
    want = []
    for d, t in all_rows(docs):
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        want.append((d, len((t or "").encode()), n, n > 1024))
    assert collected(tokens.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_token_counts_of_odd_strings():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer, counts = Tokenizer.from_file(path), tokens.PieceCounts(path)
    rng = random.Random(1)
    alphabet = ["a", "'s", "'re", "'", "'ll", " ", "  ", "\n", "1", "²", "é", "漢", "!", "…", "\x1c", "\x85", "🙂", "<|endoftext|>", "<|endof", "'S", "́", "　"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(3000)]
    got = np.concatenate([tokens.count_tokens(counts, buf, at) for _, _, buf, at in W.chunks(pa.array(texts), 4000)])
    assert got.tolist() == [len(e) for e in tokenizer.encode_batch(texts)]


# 6


def test_language(real, odd, empty):
    model = language.learn(real)
    out = language.identify(real, model).collect()
    truth = {r["doc_id"]: r["lang"] for r in real.collect()}
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    marks = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert marks[1] == marks[2] == marks[3] == ("und", 0.0) and marks[8][0] in model[0]
    assert language.learn(empty)[0] == [] and language.identify(odd, language.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.keep_identified(odd, model).columns == odd.columns


# 7


@pytest.mark.parametrize("name", ["odd", "real"])
def test_pieces(request, name):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    docs = request.getfixturevalue(name)
    out = pieces.encode_documents(docs)
    want = sorted(((d, library.encode(t or "")) for d, t in all_rows(docs)), key=repr)
    assert collected(out, "doc_id", "pieces") == want
    assert out.where("not round_trip").count() == 0
    texts = sorted(((d, (t or "").replace("▁", " ")) for d, t in all_rows(docs)), key=repr)
    assert collected(pieces.decode_documents(out), "doc_id", "text") == texts


def test_pieces_of_odd_strings():
    from sentencepiece import SentencePieceProcessor

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library, model = SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    rng = random.Random(2)
    alphabet = ["a", "the", "ing", " ", "   ", "\n", "1", "²", "漢", "🙂", "▁", "<s>", "<0x0A>", "\0", "tion", "er", "ab"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)] + ["abcthe" * 60, " " * 70]
    got = []
    for _, _, raw, at in W.chunks(pa.array(texts), 5000):
        ids, places = pieces.encode(model, *pieces.spaced(raw, at))
        got += [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:])]
    assert got == library.encode(texts)


def test_piece_index_of_few_and_many_letters():
    """Every occurrence of a piece of several characters, out of 64-bit words: no fixed-width text per position."""
    from sentencepiece import SentencePieceProcessor

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library, model = SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    longest = sorted((library.id_to_piece(i) for i in range(library.get_piece_size()) if not library.is_control(i) and not library.is_byte(i) and not library.is_unknown(i)), key=len)
    rng = random.Random(6)
    for text in (longest[-300:], [p for p in longest if len(p) > 1][::40] + longest[:700]):  # words of eight letters, of four
        some = "".join(rng.choice(text) + rng.choice(["", "\0", "\U0010fffe"]) for _ in range(600)) + text[0]
        vocabulary = set(longest)
        want = [(i, some[i : i + n]) for i in range(len(some)) for n in range(2, model.width + 1) if i + n <= len(some) and some[i : i + n] in vocabulary]
        at, piece = model.edges(np.array([ord(c) for c in some], dtype=np.uint32))
        assert [(i, library.id_to_piece(k)) for i, k in zip(at.tolist(), model.id[piece].tolist())] == want
    code = np.array([ord(c) for c in rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100_000)], dtype=np.uint32)
    tracemalloc.start()
    model.edges(code)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * len(code)


# 8


@pytest.mark.parametrize("name", ["odd", "real"])
def test_quality(request, name):
    docs = request.getfixturevalue(name)
    want = []
    for doc, text in all_rows(docs):
        w = SPACE.findall(text or "")
        lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        want.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality.quality_rules(docs)
    assert collected(out, *names) == sorted(want, key=repr)
    assert out.where("base_failed and kept").count() == 0


def test_line_frequency(spark):
    body = [" ".join(f"b{d}x{k}" for k in range(40)) for d in range(6)]
    menu = "Home  News about us contact imprint all of this again and again for ever and more words than there are elsewhere to read on " * 4
    texts = [f"{menu}\n{b}" for b in body[:5]] + [menu + "\n" + body[5][:20]]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    rules = dict(max_share=0.5, min_texts=4, max_repeat_percent=100, min_left=0.25)
    out = {r["doc_id"]: r for r in quality.quality_rules(docs, **rules).collect()}
    assert out[1]["kept"] and out[1]["n_line_words_removed"] == len(menu.split()) and not out[6]["kept"] and out[6]["depleted"]


def test_line_rule_against_brute_force(spark):
    """Counts per host, removed words, verdicts and cleaned texts, with copies, shared ids and a null host."""
    rng = random.Random(9)
    pool = [" ".join(f"l{k}w{j}" for j in range(rng.randrange(1, 12))) for k in range(30)]
    texts = []
    for d in range(120):
        lines = rng.choices(pool[: 3 + d % 27], k=rng.randrange(1, 9)) + [" ".join(f"own{d}x{j}" for j in range(rng.randrange(0, 30)))]
        texts.append((d // 2, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines), rng.choice(["a", "b", None])))
    texts += [texts[0], texts[0], (None, texts[1][1], "a"), (500, None, "a"), (501, " \n ", "b")]
    data = [(i, t, "en", h, 0, 1, "x", 2, "y") for i, t, h in texts]
    docs = spark.createDataFrame(data, SCHEMA)
    norm = lambda line: " ".join(SPACE.findall(line)).lower()
    of_host, held = {}, {}
    for _, t, h in texts:
        if SPACE.search(t or ""):
            key = tuple(SPACE.findall(t))
            of_host.setdefault(h, set()).add(key)
            for line in t.split("\n"):
                if SPACE.search(line):
                    held.setdefault((h, norm(line)), set()).add(key)
    over = {k for k, v in held.items() if len(v) > 5 and len(v) > 0.2 * len(of_host[k[0]])}
    want, cleaned = [], []
    for i, t, h in texts:
        lines = (t or "").split("\n")
        n = len(SPACE.findall(t or ""))
        gone = sum(len(SPACE.findall(x)) for x in lines if SPACE.search(x) and (h, norm(x)) in over)
        want.append((i, n, gone, n - gone < 0.3 * n))
        cleaned.append((i, h, None if t is None else "\n".join(x for x in lines if not (SPACE.search(x) and (h, norm(x)) in over))))
    out = quality.quality_rules(docs, max_share=0.2)
    assert collected(out, "doc_id", "n_words", "n_line_words_removed", "depleted") == sorted(want, key=repr)
    assert any(w[3] for w in want) and out.where("depleted and kept").count() == 0
    clean = quality.clean_lines(docs, max_share=0.2)
    assert clean.columns == docs.columns and collected(clean, "doc_id", "source", "text") == sorted(cleaned, key=repr)


def test_kept_is_the_stated_verdict(real):
    out = quality.quality_rules(real)
    for r in out.collect():
        if r["base_failed"] or r["depleted"]:
            assert not r["kept"]
        elif r["n_symbols"] > 0.06 * r["word_chars"]:
            assert not r["kept"]


# 9


def test_html(spark):
    page = (
        "<body><header>H</header><div id=cookie-notice>C<div>x</div></div><main><header><h1>T &amp; t</h1></header><p>a<br>b &nbsp; c<p class=ad>buy<p>d"
        '<script>var t="</p>"</script><ul><li>1<li>2</ul><section class="comments"><article>c1</article></section><form>f<input></form></main><aside>s</aside>'
    )
    data = [(1, "http://h/a/1", "<div>Menu x</div><div>Story one here</div><div>foot</div>"), (2, "http://h/a/2", "<div>Menu x</div><div>Story two there</div><div>foot</div>")]
    data += [(3, None, None), (4, "http://h/b/2", "<div>Menu x</div><div>Story 3</div><div>foot</div>"), (None, "http://h/b/2", "<p>n")]
    data += [(5, "x", page), (6, "http://m/a", "<p>same text twice"), (7, "http://m/b", "<p>same text twice"), (8, "http://h/a/1", "")]
    pages = spark.createDataFrame([(*d, "clash") for d in data], "page_id long, url string, html string, blocks string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_text(pages).collect()}
    assert got[5][0] == "T & t\n\na b c\n\nd\n\n1\n\n2" and got[3] == ("", 0) and got[8] == ("", 0) and got[None][0] == "n"
    assert got[2] == ("Story two there", 15) and got[4][0] == "Story 3" and got[6][0] == got[7][0] == "same text twice"
    assert html.extract_text(pages.limit(0)).count() == 0


def test_common_subsequence():
    assert html.shared_positions([1, 2, 3, 4, 2], [2, 9, 4, 2]) == {1, 3, 4}
    assert html.shared_positions([], [1]) == set() and len(html.shared_positions([7] * 500, [7] * 500)) >= 64


def test_common_subsequence_is_longest():
    rng = random.Random(11)
    for n, m, values in [(500, 500, 1), (90, 70, 2), (70, 90, 3), (40, 40, 30), (300, 200, 4), (1, 5, 2)]:
        a, b = rng.choices(range(values), k=n), rng.choices(range(values), k=m)
        best = [0] * (m + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, best[j] = best[j], max(best[j], best[j - 1], last + (x == y))
        got = [a[i] for i in sorted(html.shared_positions(a, b))]
        rest = iter(b)
        assert len(got) == best[m] and all(x in rest for x in got)
    assert len(html.shared_positions([1] + [7] * 200 + [2], [3] + [7] * 200 + [4])) == 200


def test_html_partners(spark):
    """Copies are no partners, long menus go, versions of an article stay, marked pages show their template."""
    menu = "".join(f"<div>Long menu entry number {k}</div>" for k in range(30))
    story = "".join(f"<div>Story line {k} of the long story</div>" for k in range(30))
    data = [(k, f"http://a/x/{k}", "<div>Menu</div><div>Copy</div>") for k in (1, 2, 3)] + [(4, "http://a/y/1", "<div>Menu</div><div>Else</div>")]
    data += [(5, "http://b/x/1", menu + "<div>One</div>"), (6, "http://b/x/2", menu + "<div>Two</div>"), (7, "http://b/y", menu + "<div>Three</div>")]
    data += [(8, "http://c/1", "<div>Top</div><div>Mine</div>"), (9, "http://c/2", "<div>Top</div><main><p>Marked</p></main>")]
    data += [(10, "http://d/x/1", "<div>Menu</div>" + story + "<div>at 1</div>"), (11, "http://d/x/1", "<div>Menu</div>" + story + "<div>at 2</div>")]
    data += [(12, "http://d/y", "<div>Menu</div><div>Far</div>")]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12)] == ["Copy"] * 3 + ["Else", "One", "Two", "Three", "Mine", "Marked", "Far"]
    assert got[10].startswith("Story line 0") and got[10].endswith("at 1") and got[10].count("Story") == 30 and got[11].endswith("at 2")


def test_html_marked_pages_are_differenced(spark):
    """Inside a marked part only link lines at its ends go that all partners share; sentences and headings stay."""
    link = '<a href="/x">{}</a>'.format

    def article(*lines):
        return "<article><h1>" + link("Same title") + "</h1>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"

    def only(*lines):
        return "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"

    data = [(k, f"http://a/x/{k}", only(link("Share this story"), "Introduction", f"Story {k} told here", link("A link inside"), "Conclusion", link("Read more") + " now")) for k in (1, 2)]
    shared = ["One long line of an article that stands twice", "and another long line of it"]
    data += [(3, "http://b/x/1", article(*shared, "seen at 1")), (4, "http://b/x/1", article(*shared, "seen at 2")), (5, "http://b/y", article("seen at 1", "Other text of some length"))]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for k in (1, 2):
        assert got[k].split("\n\n") == ["Introduction", f"Story {k} told here", "A link inside", "Conclusion"]
    assert got[3].split("\n\n") == ["Same title", *shared, "seen at 1"] and got[4].split("\n\n") == ["Same title", *shared, "seen at 2"]
    assert got[5].split("\n\n") == ["Same title", "seen at 1", "Other text of some length"]


def test_no_article_block_is_lost(spark):
    """Every block of the given articles is in the text, whatever other pages hold; nothing else is."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    for r in pages.collect():
        inside, marked, _, _ = html.blocks(r["html"])
        assert marked and got[r["page_id"]] == "\n\n".join(inside)


def test_template_lines_against_brute_force():
    """Deletion from marked and unmarked pages, stated plainly over all subsequences of tiny pages."""
    from itertools import combinations

    def longest(a, b):
        return max((len(c) for k in range(len(a) + 1) for c in combinations(range(len(a)), k) if _in_order([a[i] for i in c], b)), default=0)

    rng = random.Random(6)
    for _ in range(60):
        mine = rng.choices(range(5), k=rng.randrange(1, 7))
        others = [rng.choices(range(5), k=rng.randrange(0, 7)) for _ in range(rng.randrange(1, 4))]
        links = [rng.random() < 0.6 for _ in mine]
        found = [html.shared_positions(mine, o) for o in others]
        assert [len(f) for f in found] == [longest(mine, o) for o in others]
        sharing = [f for f in found if f]
        inside = html.template_lines(mine, [1] * len(mine), links, others, True, 0.8)
        good = [bool(sharing) and links[i] and all(i in f for f in sharing) for i in range(len(mine))]
        assert inside == [i for i in range(len(mine)) if good[i] and (all(good[:i]) or all(good[i:]))]
        loose = html.template_lines(mine, [1] * len(mine), links, others, False, 0.8)
        want = set() if not sharing else sharing[0] if len(sharing[0]) <= 0.8 * len(mine) else set.intersection(*sharing)
        assert loose == sorted(want)


def _in_order(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


# 10


def test_decontamination(spark, odd, empty, real):
    items = spark.createDataFrame(
        [
            (1, "A train travels 60 miles in 2 hours from Boston to Chicago. How far does the train travel in 5 hours?", 1),
            (2, "A train travels 70 miles in 3 hours from Paris to Rome. How far does the train travel in 9 hours?", 1),
            (3, None, 1), (4, "", 1), (5, "how many stones are there", 1), (6, "short", 1), (None, "a b c d e f g h i j", 1),
        ],
        "item_id long, text string, window int",
    )
    asked = [
        "x y A train travels 80 miles in 4 hours from Berlin to Bonn. How far does the train travel in 7 hours? ok",
        "A train travels 80 miles in 80 hours from Berlin to Berlin. How far does the train travel in 80 hours? ok",
        "and HOW MANY STONES ARE THERE today", "how many birds are there", "short", "a b c d e f g h i j",
    ]
    docs = odd.unionByName(spark.createDataFrame(rows(asked, 300), SCHEMA))
    assert collected(decontaminate.contaminated(docs, items), "doc_id", "item_id") == [(300, 1), (302, 5)]
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")

    def normal(t):
        return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))

    want = {(d, b["item_id"]) for d, t in all_rows(real) for b in benchmark.collect() if f" {normal(b['text'])} " in f" {normal(t)} "}
    assert want <= set(collected(decontaminate.contaminated(real, benchmark), "doc_id", "item_id"))


def test_decontamination_families(spark):
    """Every item of a template family is found verbatim, whichever slots repeat; the family's shared windows count for each."""
    shape = "A train takes {} hours to reach the city and another {} hours to come back home again"
    items = spark.createDataFrame([(1, shape.format(2, 2)), (2, shape.format(3, 9)), (3, shape.format(4, 7))], "item_id long, text string")
    docs = spark.createDataFrame([(1, shape.format(2, 2)), (2, shape.format(3, 9)), (3, shape.format(4, 7)), (4, shape.format(5, 8)), (5, shape.format(6, 6))], "doc_id long, text string")
    got = set(collected(decontaminate.contaminated(docs, items), "doc_id", "item_id"))
    assert {(1, 1), (2, 2), (3, 3), (4, 2), (5, 1)} <= got and (4, 1) not in got and (5, 2) not in got
    short = "{0} of {1} or {2} of {1} or {3}"
    dense = spark.createDataFrame([(1, short.format(1, 2, 1, 2)), (2, short.format(3, 4, 5, 6))], "item_id long, text string")
    copy = spark.createDataFrame([(9, "they ask " + short.format(3, 4, 5, 6) + " at last")], "doc_id long, text string")
    assert collected(decontaminate.contaminated(copy, dense), "doc_id", "item_id") == [(9, 2)]


def test_decontamination_few_literals(spark):
    """Items dense with slots, short items with slots, and long verbatim runs below half of an item."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "ra", "si", "to", "ve", "wa") for b in ("dan", "fel", "gor", "hin", "jup")]
    long = rng.choices(words, k=200)
    dense = "What is {} km plus {} km minus {} km"
    trailing = "Please add all of these lengths now {} km {} km {} km {} km {} km {} km {} km {} km"
    items = [(1, dense.format(12, 7, 5)), (2, "What is 7 plus 5"), (3, "how old will Anna be then"), (4, " ".join(long)), (5, trailing.format(*range(1, 9))), (6, "7 8 9 10")]
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = [
        (1, "they ask: " + dense.format(31, 8, 2) + " and so on"), (2, "Q: What is 9 plus 3? ok"), (3, "and how old will Berta be then"),
        (4, "so " + " ".join(long[60:140]) + " end"), (5, "so " + " ".join(long[60:100]) + " end"), (6, dense.format(31, 8, 31)),
        (7, trailing.format(*range(11, 19))), (8, "they say 1 2 3 4 and 7 8 9 10 too"), (9, "Please add all of these lengths now 3 km or so"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = [(1, 1), (2, 2), (3, 3), (4, 4), (7, 5), (8, 6)]
    assert collected(decontaminate.contaminated(docs, items), "doc_id", "item_id") == found


def test_decontamination_classes(spark):
    """A passage that 40 items and 60 documents hold: rows per document, not per document and item; pairs are those of the classes."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "ra", "si", "to", "ve", "wa") for b in ("dan", "fel", "gor", "hin", "jup")]
    middle = " ".join(rng.choices(words, k=40)) + " in {} hours and {} days " + " ".join(rng.choices(words, k=12))

    def around(i, kind):
        return f"{kind}{chr(97 + i // 26)}{chr(97 + i % 26)} "

    items = spark.createDataFrame([(i, around(i, "head") + middle.format(2, 3) + " " + around(i, "tail")) for i in range(40)], "item_id long, text string")
    docs = [(i, around(i, "lead") * 9 + middle.format(2, 3) + " " + around(i, "rest") * (i % 5)) for i in range(60)]
    docs += [(i, middle.format(i, i + 1)) for i in range(60, 70)] + [(i, middle.format(i, i)) for i in range(70, 75)]  # other values; a broken slot
    docs += [(80, around(3, "head") + middle.format(2, 3) + " " + around(3, "tail")), (5, docs[5][1]), (None, docs[5][1]), (81, "nothing of this"), (82, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    windows = decontaminate.benchmark_windows(items, 8, 5)
    held = decontaminate.held_windows(docs, windows, 8, 5)
    classes = dict(collected(decontaminate.match_classes(held), "doc_id", "match_class"))
    assert {classes[d] for d in range(60)} == {0} and {classes[d] for d in range(60, 70)} == {60} and {classes[d] for d in range(70, 75)} == {70} and classes[80] == 80
    rows_out = {r["doc_id"]: r for r in decontaminate.contaminated_documents(docs, items).collect()}
    pairs = collected(decontaminate.contaminated(docs, items), "doc_id", "item_id")
    assert len(rows_out) == len({d for d, _ in pairs}) and set(rows_out) == {d for d, _ in pairs} and set(range(60)) | {80} <= set(rows_out)
    by_doc = {}
    for d, i in pairs:
        by_doc.setdefault(d, []).append(i)
    for d, r in rows_out.items():
        shared = rows_out[r["match_class"]]["items"]
        assert sorted(by_doc[d]) == shared and r["n_items"] == len(shared) and (r["items"] is None) == (d != r["match_class"])
    assert rows_out[80]["item_id"] == 3 and rows_out[80]["share"] == 1.0 and len(by_doc[0]) == 40


def test_headers_spread_over_all_ranges():
    names = [hashlib.md5(bytes([k & 255, k >> 8])).digest() for k in range(5000)]
    assert len({ranges.header_range(n, 2500) for n in names}) > 2000
    batches = ranges.pack(np.array([5], np.uint64), [np.array([1], np.uint64)], b"head", 2500)
    sent = [r for b in batches for r in b.to_pylist() if r["header"]]
    assert [r["r"] for r in sent] == [ranges.header_range(hashlib.md5(b"head").digest(), 2500)]


# all


def test_empty_tables(empty):
    assert jaccard.jaccard_components(empty).count() == 0
    assert substrings.substring_dedup(empty).count() == 0 and substrings.remove_spans(empty).count() == 0
    assert licenses.license_scan(empty).count() == 0 and tokens.token_counts(empty).count() == 0
    assert pieces.encode_documents(empty).count() == 0 and quality.quality_rules(empty).count() == 0


def test_pipeline(spark, odd, tmp_path):
    docs = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[1:]:
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        out = spark.read.parquet(path)
        assert name == "sentencepiece" or out.columns == docs.columns
        docs = out
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0.7 * n[0] and docs.where("not round_trip").count() == 0
    rest = odd.where("text is not null")
    for _, stage in corpus_pipeline.STAGES[:4]:
        rest = stage(spark, rest, SMALL)
        assert rest.columns == odd.columns
    assert rest.count() >= 5


def test_registered_queries(spark):
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert QUERIES["op5_token_counts"](spark, SMALL).count() == 200
