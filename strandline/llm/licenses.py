"""Licence scans: Aho-Corasick finds tags and phrases, shunting-yard reads expressions.

One automaton finds identifier tags in the lower-cased text, another holds all
notice phrases as word sequences and reads the text's words with single spaces.
What follows a tag, up to the line's end, the comment's end or the next tag, may be
an expression; the shunting-yard algorithm accepts it or not, orders its AND, OR and
WITH and so decides which licences hold, how surely and how freely they permit use:
AND holds both sides, the stricter one counting; OR leaves the choice, so the freer
side holds; WITH turns its left side into that licence with an exception. Identifiers
belong to families, told by their beginnings, and must be whole: beside the family
there is a version or a usual suffix and nothing else.

After a tag made for expressions the longest accepted beginning counts. After
``license:`` and the like, which stand in prose too, all up to the sentence's end
must be accepted and every identifier known, so prose names no licence.

Nulls: a null text is empty. A text without words has no places and score 0.
Repeated rows give repeated results; an empty table gives an empty one. Of several
expressions the last one sets the freedom. Labels are sorted; in OR, sides that
permit as much hold both. Very long texts are read whole, in time that grows
with their length. Only the id and text columns are read; further columns,
whatever their names, change nothing and aren't returned.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases with their labels, then the added ones.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
ADDED = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
#: Beginnings of identifiers with the label of their family; the longest that fits counts, up to a version.
FAMILIES = {
    "mit": "mit", "apache": "apache-2", "apache-1": "apache-1", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "x11": "mit", "ncsa": "ncsa", "postgresql": "postgresql", "psf": "psf", "python": "psf",
    "bsl": "bsl", "busl": "busl", "unlicense": "unlicense", "wtfpl": "wtfpl", "cc0": "cc0", "pddl": "pddl", "cc-pddc": "cc0",
    "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by-nc": "cc-by-nc", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd",
    "gpl": "gpl", "agpl": "agpl", "lgpl": "lgpl", "gfdl": "gfdl", "mpl": "mpl", "epl": "epl", "eupl": "eupl", "cddl": "cddl", "cpl": "epl", "osl": "osl", "afl": "afl", "artistic": "artistic", "ms-pl": "ms-pl", "ms-rl": "ms-rl",
    "cecill": "cecill", "odbl": "odbl", "odc-by": "odc-by", "ofl": "ofl", "lppl": "lppl", "sspl": "sspl", "elastic": "elastic", "ruby": "ruby", "php": "php", "vim": "vim", "curl": "mit", "w3c": "w3c", "unicode": "unicode",
    "licenseref-proprietary": "proprietary", "proprietary": "proprietary", "unlicensed": "proprietary",
}
#: How freely a label permits use.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "apache-1": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "ncsa": 1.0, "postgresql": 1.0, "psf": 1.0, "bsl": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "cc0": 1.0, "pddl": 1.0, "unicode": 1.0, "w3c": 1.0, "afl": 1.0,
    "cc-by": 0.9, "odc-by": 0.9, "artistic": 0.8, "ruby": 0.8, "php": 0.8, "vim": 0.8, "ofl": 0.8, "lppl": 0.8, "ms-pl": 0.8, "mpl": 0.7, "epl": 0.7, "cddl": 0.7, "ms-rl": 0.7, "lgpl": 0.6, "eupl": 0.5, "cecill": 0.5, "osl": 0.5, "cc-by-sa": 0.5, "odbl": 0.5, "gfdl": 0.5,
    "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "busl": 0.2, "elastic": 0.2, "sspl": 0.2, "cc-by-nc-nd": 0.1, "proprietary": 0.0,
}
#: What announces an expression.
TAGS = ("spdx-license-identifier:", "license-expression:", '"license":', "license =", "license:")
#: Those that stand before expressions and nothing else.
STRICT = TAGS[:2]
ENDS = re.compile(rb"\*/|-->")
SENTENCE = re.compile(r"[.;,](?:\s|$)|[}\]]")
#: Weight of evidence: a tag's known licence, a base phrase, an added phrase.
TAG_WEIGHT, BASE_WEIGHT, ADDED_WEIGHT = 0.95, 0.8, 0.6
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
EXPRESSION = re.compile(r"[A-Za-z0-9.+-]+|[()]|[^\s\"']")
#: What may follow a family's name in an identifier besides versions, and words that may follow an identifier.
SUFFIXES = {"only", "or", "later", "clause", "patent", "clear", "attribution", "universal", "international", "license", "licence", "expat", "cmu", "new", "revised", "simplified", "style", "public", "domain"}
NOISE = {"license", "licence", "version"}
VERSION = re.compile(r"v?[0-9]+(?:\.[0-9]+)*[a-z]?")
GLUED = re.compile(r"([a-z][a-z-]*?)v?([0-9]+(?:\.[0-9]+)*)")
#: How sure an operand that names no known licence is, and how much of it an exception leaves, known by its name or not.
UNKNOWN, EXCEPTED, ODD_EXCEPTION = 0.5, 1.0, 0.8
#: Every ASCII byte that is in no word becomes a space.
SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@functools.lru_cache(100_000)
def label(identifier: str) -> str | None:
    """The label of a whole identifier: of its longest beginning that is a family's, if only versions and suffixes follow."""
    parts = identifier.rstrip("+").split("-")
    for k in range(len(parts), 0, -1):
        if found := FAMILIES.get("-".join(parts[:k])):
            return found if all(p in SUFFIXES or VERSION.fullmatch(p) for p in parts[k:]) else None
    if (m := GLUED.fullmatch(parts[0])) and m[1] in FAMILIES:  # gplv3
        return label("-".join([m[1], m[2], *parts[1:]]))
    return None


def words_of(expression: str) -> list[str]:
    """Tokens: "GPL v2 or later" and "the MIT License" are identifiers as well."""
    out: list[str] = []
    operand = False
    found = EXPRESSION.findall(expression.lower())
    for k, t in enumerate(found):
        if t == "the" and not out:
            continue
        if operand and t in NOISE:
            continue
        if operand and VERSION.fullmatch(t) and label(out[-1]):
            out[-1] += "-" + t
        elif operand and t == "later" and out[-1] == "or":
            out.pop()
            out[-1] += "+"
        elif t == "or" and operand and found[k + 1 : k + 2] == ["later"]:
            out.append(t)
            continue
        else:
            out.append(t)
            operand = t not in PRECEDENCE and t not in "()"
    return out


def accepted(tokens: list[str]) -> int:
    """How many tokens the longest expression at the beginning has."""
    depth, operand_next, good = 0, True, 0
    for k, t in enumerate(tokens):
        if t == "(":
            if not operand_next:
                break
            depth += 1
        elif t == ")":
            if operand_next or not depth:
                break
            depth -= 1
        elif t in PRECEDENCE:
            if operand_next:
                break
            operand_next = True
            continue
        elif not operand_next or not t[0].isalnum():
            break
        else:
            operand_next = False
        if not depth and not operand_next:
            good = k + 1
    return good


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if it doesn't parse."""
    if not tokens or accepted(tokens) < len(tokens):
        return None
    out, stack = [], []
    for t in tokens:
        if t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif t in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
        else:
            out.append(t)
    return out + stack[::-1]


@dataclass(frozen=True)
class Value:
    """What an expression comes to: the licences that hold, how surely and how freely."""

    labels: frozenset[str]
    sure: float
    free: float


def operand(identifier: str) -> Value:
    known = label(identifier)
    return Value(frozenset([known] if known else []), TAG_WEIGHT if known else UNKNOWN, FREEDOM[known] if known else 0.0)


def combine(operator: str, left: Value, right: Value, exception: str) -> Value:
    if operator == "and":
        return Value(left.labels | right.labels, min(left.sure, right.sure), min(left.free, right.free))
    if operator == "or":
        if left.free != right.free:
            return max(left, right, key=lambda v: v.free)
        return Value(left.labels | right.labels, max(left.sure, right.sure), left.free)
    part = EXCEPTED if "exception" in exception or exception.endswith("-note") else ODD_EXCEPTION
    return Value(frozenset(f"{x}-exception" for x in left.labels), left.sure * part, left.free + (1 - left.free) / 2)


def evaluate(expression: str, strict: bool = True) -> tuple[Value, set[str]] | None:
    """The value of what an expression says and all labels that it names; None if it is none."""
    tokens = words_of(expression if strict else SENTENCE.split(expression, maxsplit=1)[0])
    if strict:
        tokens = tokens[: accepted(tokens)]
    postfix = to_postfix(tokens)
    if postfix is None:
        return None
    named = {label(t) for k, t in enumerate(tokens) if t not in PRECEDENCE and t not in "()" and (not k or tokens[k - 1] != "with")}
    if not strict and None in named:
        return None
    stack: list[tuple[Value, str]] = []
    for t in postfix:
        if t in PRECEDENCE:
            (right, name), (left, _) = stack.pop(), stack.pop()
            stack.append((combine(t, left, right, name), ""))
        else:
            stack.append((operand(t), t))
    return stack[0][0], named - {None}


def tag_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for tag in TAGS:
        a.add_word(tag, len(tag))
    a.make_automaton()
    return a


def expressions(low: bytes, tags: ahocorasick.Automaton) -> Iterator[tuple[str, bool]]:
    """What follows each tag on its line, up to the end of a comment or the next tag, and whether the tag is strict."""
    found = sorted((end - size + 1, end + 1) for end, size in tags.iter(low.decode("latin-1")))
    line = -1  # the end of the line last looked at
    for k, (begin, start) in enumerate(found):
        if line < start:
            line = low.find(b"\n", start)
            line = len(low) if line < 0 else line
        end = min(line, found[k + 1][0]) if k + 1 < len(found) else line
        if end > start:
            yield ENDS.split(low[start:end], maxsplit=1)[0].decode("utf-8", "replace"), low[begin:start].decode() in STRICT


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrases, base in ((BASE, True), (ADDED, False)):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (len(phrase), label, base))
    a.make_automaton()
    return a


def scan(text: str | None, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, freedom, named)."""
    low = (text or "").encode("utf-8", "replace").lower()
    words = low.translate(SPACED).split()
    plain = " " + b" ".join(words).decode("latin-1") + " "
    starts, base, labels, evidence = [], set(), set(), {}
    at = before = 0  # words before a place, counted onwards from the last one
    for end, (size, name, is_base) in phrases.iter(plain):
        start = end - size - 1
        labels.add(name)
        evidence[name] = max(evidence.get(name, 0.0), BASE_WEIGHT if is_base else ADDED_WEIGHT)
        if is_base:
            before, at = (before + plain.count(" ", at, start), start) if start >= at else (plain.count(" ", 0, start), start)
            starts.append(before)
            base.add(name)
    freedom = min((FREEDOM[x] for x in labels), default=0.0)
    named = set(labels)
    for expression, strict in expressions(low, tags):
        if said := evaluate(expression, strict):
            value, all_named = said
            named |= all_named
            if value.labels:
                freedom = value.free
            labels |= value.labels
            for x in value.labels:
                evidence[x] = max(evidence.get(x, 0.0), value.sure)
    doubt = 1.0
    for x in sorted(evidence):
        doubt *= 1 - evidence[x]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - doubt, 6), freedom, ",".join(sorted(named))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, freedom, named); ``named`` are all licences, chosen or not."""
    id_type = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2 + [pa.string()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "freedom", "named"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = automaton(), tag_automaton()
        for batch in batches:
            rows = [scan(t.as_py(), phrases, tags) for t in batch.column(1)]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, *names])

    schema = f"`{id_col}` {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double, named string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
