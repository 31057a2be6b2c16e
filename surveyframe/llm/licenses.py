"""Licence scans: one Aho-Corasick automaton for notice phrases and identifier tags, and a parser for expressions.

A text's words are its runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
The automaton runs over the words joined by one space, so a phrase stands wherever its words stand
consecutively, whatever is between them; all its places count, overlapping ones too. Base phrases give
the counts, places and base labels. Further notice phrases and the expressions behind identifier tags
add labels only.

A tag counts where the automaton finds it and a colon or an equals sign follows in the original text; what is behind
that sign, on its line or, if the rest of that line is blank, on the next, is read by a
shunting-yard parser that turns `A OR (B AND C WITH exception)` into postfix. Operands must be known licence
identifiers and exceptions (or LicenseRef- names), so prose behind a tag gives nothing; the longest prefix that is a whole
expression counts, so a trailing remark does no harm. Identifiers and exceptions become labels. The score
is the least restrictive reading: OR takes the larger, AND the smaller, WITH adds a little; a text with
only phrases has the score of its most specific phrase, one with nothing 0.

Null and empty texts have no words, null places, empty labels and score 0.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of common public licences: (label, weight). Fixed values.
NOTICES = {
    "academic free license": ("afl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "apache license": ("apache", 0.8),
    "apache software license": ("apache", 0.8),
    "artistic license": ("artistic", 0.9),
    "boost software license": ("bsl", 0.9),
    "bsd license": ("bsd", 0.8),
    "cecill": ("cecill", 0.8),
    "common development and distribution license": ("cddl", 0.9),
    "common public license": ("cpl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.9),
    "do what the fuck you want to public license": ("wtfpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "european union public licence": ("eupl", 0.9),
    "free documentation license": ("gfdl", 0.9),
    "gnu gpl": ("gpl", 0.7),
    "gnu lgpl": ("lgpl", 0.7),
    "isc license": ("isc", 0.8),
    "lesser general public license": ("lgpl", 0.9),
    "library general public license": ("lgpl", 0.9),
    "licensed under the apache license": ("apache", 0.9),
    "microsoft public license": ("ms-pl", 0.9),
    "mit license": ("mit", 0.8),
    "mozilla public license": ("mpl", 0.9),
    "open database license": ("odbl", 0.9),
    "open font license": ("ofl", 0.9),
    "open software license": ("osl", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "public domain": ("public-domain", 0.7),
    "python software foundation license": ("psf", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "zlib license": ("zlib", 0.8),
}
#: Licence identifiers without a version, as patterns of whole families where they have one. Fixed values.
_IDENTIFIER = re.compile(
    r"(?i)(?:"
    r"0BSD|AAL|Beerware|BSD-[1-4]-Clause(?:-[A-Za-z-]+)?|BSD-Source-Code|bzip2-1\.0\.[56]|CC0-1\.0|CC-BY(?:-NC)?(?:-ND|-SA)?-[1-4]\.[05](?:-[A-Z]{2,3})?"
    r"|curl|FSFAP|FTL|HPND|ICU|IJG|ImageMagick|ISC|JSON|Libpng|libpng-2\.0|libtiff|MIT(?:-0|-CMU|-Modern-Variant|-advertising|-enna|-feh)?|MITNFA"
    r"|MS-[PR]L|MulanPSL-[12]\.0|NCSA|NTP|OpenSSL|PDDL-1\.0|PostgreSQL|PSF-2\.0|Python-2\.0(?:\.1)?|Ruby|SGI-B-[12]\.[01]|SMLNJ|TCL|Unlicense|UPL-1\.0|Vim|W3C"
    r"|WTFPL|X11|XFree86-1\.1|Zend-2\.0|Zlib|zlib-acknowledgement|ZPL-[12]\.[01]"
    r"|(?:A|L)?GPL-[123]\.[01](?:-only|-or-later|\+)?|GFDL-1\.[123](?:-(?:no-)?invariants)?(?:-only|-or-later)?"
    r"|(?:AFL|APSL|OSL)-[123]\.[012]|Apache-[12]\.[01]|Artistic-[12]\.0(?:-Perl|-cl8)?|BSL-1\.0|CDDL-1\.[01]|CECILL-(?:[12]\.[01]|B|C)|CPL-1\.0|ECL-[12]\.0|EFL-[12]\.0"
    r"|EPL-[12]\.0|EUPL-1\.[012]|IPL-1\.0|LPPL-1\.(?:[012]|3[ac])|MPL-(?:1\.[01]|2\.0)(?:-no-copyleft-exception)?|NPL-1\.[01]|ODbL-1\.0|ODC-By-1\.0|OFL-1\.[01]|PHP-3\.0[01]?"
    r"|QPL-1\.0|Sleepycat|SSPL-1\.0|BUSL-1\.1|SPL-1\.0|Elastic-2\.0"
    r"|(?:DocumentRef-[A-Za-z0-9.-]+:)?LicenseRef-[A-Za-z0-9.-]+"
    r")\+?"
)
#: Exception identifiers. Fixed values.
EXCEPTIONS = frozenset(
    "389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 "
    "clisp-exception-2.0 digirule-foss-exception ecos-exception-2.0 fawkes-runtime-exception fltk-exception font-exception-2.0 "
    "freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception gpl-3.0-linking-exception "
    "gpl-3.0-linking-source-exception gpl-cc-1.0 i2p-gpl-java-exception lgpl-3.0-linking-exception libtool-exception "
    "linux-syscall-note llvm-exception lzma-exception mif-exception ocaml-lgpl-linking-exception occt-exception-1.0 openjdk-assembly-exception-1.0 "
    "openvpn-openssl-exception ps-or-pdf-font-exception-20170817 qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 "
    "swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1".split()
)
TAGS = ("spdx license identifier", "license expression", "license identifier")
BASE_WEIGHT = {"cc-by": 0.7, "gpl": 0.6, "reserved": 0.1}
#: How freely an identifier's family lets a text be used; others get UNKNOWN.
FAMILIES = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc": 0.8, "mpl": 0.7, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3}
UNKNOWN = 0.5

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_BEHIND_TAG = re.compile(r"[\"'\]]?[ \t]*[:=][ \t\"']*(?:\r?\n[^A-Za-z0-9(\n]*)?([^\n]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def known_operand(token: str, exception: bool) -> bool:
    """Whether a token is a licence identifier, or behind WITH an exception."""
    return token.lower() in EXCEPTIONS if exception else _IDENTIFIER.fullmatch(token) is not None


def to_postfix(text: str, known=lambda token, exception: True) -> list[str]:
    """Shunting-yard: postfix of the longest prefix of `text` that is an expression; empty if none is.

    `known` says of a token and whether it stands behind WITH if it can be an operand.
    """
    best: list[str] = []
    output: list[str] = []
    stack: list[str] = []
    operand = True
    at = 0
    while m := _TOKEN.match(text, at):
        token, at = m[1], m.end()
        low = token.lower()
        if operand:
            if token == "(":
                stack.append(token)
                continue
            if token == ")" or low in _RANK or not token[0].isalnum():
                break
            token = token.rstrip(".:")
            if not known(token, bool(stack) and stack[-1] == "with"):
                break
            output.append(token)
            operand = False
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                output.append(stack.pop())
            stack.append(low)
            operand = True
            continue
        elif token == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                output.append(top)
        else:
            break
        if "(" not in stack:
            best = output + stack[::-1]
    return best


def family(identifier: str) -> str:
    return re.match(r"[a-z]*(?:cc0)?", "cc0" if identifier.lower().startswith("cc0") else identifier.lower())[0]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels (exceptions among them) and score of a postfix expression."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token == "with":
            (exception, _), (names, score) = stack.pop(), stack.pop()
            stack.append((names | exception, min(1.0, score + 0.1)))
        elif token in ("and", "or"):
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a | b, min(x, y) if token == "and" else max(x, y)))
        else:
            stack.append(({token.lower()}, FAMILIES.get(family(token), UNKNOWN)))
    return stack[-1] if stack else (set(), 0.0)


def build_automaton(base: Mapping[str, str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    entries: dict[str, list[tuple[str, str, float]]] = {}
    for phrase, label in base.items():
        entries.setdefault(phrase, []).append(("base", label, BASE_WEIGHT.get(label, UNKNOWN)))
    for phrase, (label, weight) in NOTICES.items():
        entries.setdefault(phrase, []).append(("notice", label, weight))
    for phrase in TAGS:
        entries.setdefault(phrase, []).append(("tag", "", 0.0))
    for phrase, kinds in entries.items():
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, kinds))
    automaton.make_automaton()
    return automaton


def scan(text: str | None, automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    split = (text or "").encode().translate(_TO_WORDS).split()
    if not split:
        return 0, 0, None, None, "", "", 0.0
    joined = (b" " + b" ".join(split) + b" ").decode()
    base, more, places, score, tags = set(), set(), [], 0.0, set()
    for end, (length, kinds) in automaton.iter(joined):
        for kind, label, weight in kinds:
            if kind == "tag":
                tags.add(joined.count(" ", 0, end))  # words up to the tag's last one
                continue
            if kind == "base":
                base.add(label)
                places.append(end - length + 1)
            more.add(label)
            score = max(score, weight)
    if tags:
        last_tag = max(tags)
        for k, word in enumerate(_WORD.finditer(text), 1):
            if k in tags and (behind := _BEHIND_TAG.match(text, word.end())):
                names, value = evaluate(to_postfix(behind[1], known_operand))
                more |= names
                score = max(score, value)
            if k == last_tag:
                break
    first = last = None
    if places:
        first, last = (joined.count(" ", 0, at) for at in (min(places), max(places)))
    return len(split), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = BASE_PHRASES) -> DataFrame:
    """One row per document."""
    phrases = dict(phrases)
    names = _SCHEMA.split(", ")

    def run(batches):
        automaton = build_automaton(phrases)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(batch), 256):
                part = texts.slice(at, 256)
                found = [scan(t.as_py(), automaton) for t in part]
                columns = [batch.column("doc_id").slice(at, 256)]
                for k, kind in enumerate([pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]):
                    columns.append(pa.array([f[k] for f in found], kind))
                yield pa.RecordBatch.from_arrays(columns, names=[n.split()[0] for n in names])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, _SCHEMA)
