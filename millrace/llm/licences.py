"""Licence scans: Aho-Corasick over words for tags and notices, shunting-yard for expressions.

Texts become runs of lower-case words with one separator between them. One automaton holds all notice
phrases and the words of the identifier tag; it reads each slice once. A tag's expression is read from
the raw text behind it, to the end of the line or to the first word that cannot belong to it, and evaluated
with ``WITH`` before ``AND`` before ``OR``.

Defined results: NULL and empty texts have no words, no places, empty label lists and score 0. Overlapping
places all count. Of an expression followed by other words its longest valid beginning counts, of any length;
without one, and where an operator has no right side, no label is added. Phrases never cross texts. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.textbytes import ALPHANUMERIC, find_words, text_slices

# Phrases of the scan contract and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notices, by their usual wording.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mit license": "mit",
    "apache license 2": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license version 2": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "released into the public domain": "public-domain",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "all-rights-reserved",
}
PERMISSIVE = frozenset("mit apache-2 bsd bsd-2-clause bsd-3-clause isc cc0 cc-by public-domain unlicense zlib 0bsd".split())
TAG = "spdx license identifier"
# End of the fixed values.

TAG_EVIDENCE, NOTICE_EVIDENCE = 0.9, 0.6
BEFORE = re.compile(rb"[ \t:]*")
TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9](?:[A-Za-z0-9.+:]|-(?!-))*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def label_of(identifier: str) -> str:
    """Short label of a licence identifier: no version suffix .0, no -only, -or-later or +."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    if name.startswith("cc-by"):
        return re.sub(r"-\d.*$", "", name)
    return re.sub(r"^cc0-.*$", "cc0", re.sub(r"\.0$", "", name))


def tokens_at(body: bytes, at: int, stop: int) -> Iterator[str]:
    """Brackets and words of an expression from a place on; anything else, a line break too, ends it."""
    while found := TOKEN.match(body, at, stop):
        at = found.end()
        yield found.group(1).decode("ascii").rstrip(".:")


def parse_expression(text: str) -> list[str] | None:
    """Reverse Polish form of a whole text by the shunting-yard rule; None if malformed."""
    tokens = list(tokens_at(text.encode(), 0, len(text.encode())))
    polish, used = longest_expression(tokens)
    return polish if used == len(tokens) else None


def longest_expression(tokens: Iterable[str]) -> tuple[list[str] | None, int]:
    """(Reverse Polish form of the longest beginning that is an expression, its tokens); None and 0 without any.

    Where an operator stands without a right side, the whole is malformed: None.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next, depth, used = True, 0, 0
    whole: tuple[int, list[str]] | None = None  # what the form has after the last valid end
    for number, token in enumerate(tokens, 1):
        word = token.lower()
        if token == "(":
            if not operand_next:
                break
            waiting.append(token)
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif word in PRECEDENCE:
            if operand_next:
                return None, 0
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(token)
            operand_next = False
        if not operand_next and not depth:
            whole, used = (len(out), waiting[::-1]), number  # at most one operator of each kind waits
    return (out[: whole[0]] + whole[1], used) if whole and not operand_next else (None, 0)


def evaluate(polish: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[set[str], bool]:
    """(labels named, whether an allowed choice satisfies the expression)."""
    stack: list[tuple[set[str], bool]] = []
    for token in polish:
        if token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if token == "with":  # the exception belongs to the licence before it
                stack.append(left)
            else:
                stack.append((left[0] | right[0], (left[1] and right[1]) if token == "and" else (left[1] or right[1])))
        else:
            label = label_of(token)
            stack.append(({label}, label in allowed))
    return stack[0]


def automaton(base: Mapping[str, str], notices: Mapping[str, str]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in {*base, *notices, TAG}:
        machine.add_word(phrase, phrase)
    machine.make_automaton()
    return machine


def scan_licences(docs: DataFrame, text: str = "text", base: Mapping[str, str] = BASE_PHRASES, notices: Mapping[str, str] = NOTICES, allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """The table with n_words, n_base, first_word, last_word, base_labels, labels, score, n_tags, permitted.

    ``permitted``: whether every tag and notice found allows free use; NULL without any.
    """
    base, notices = dict(base), dict(notices)
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_tags", "permitted"]
    kinds = ["long", "long", "long", "long", "string", "string", "double", "long", "boolean"]
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_()]
    names = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("_t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(base, notices)
        for batch in batches:
            rows: list[tuple] = []
            for part in text_slices(batch.column(batch.num_columns - 1)):
                rows += _scan_slice(part, machine, base, notices, allowed)
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), arrow)] if rows else [pa.array([], k) for k in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *made])

    schema = named.drop("_t").schema
    for name, kind in zip(made, kinds):
        schema = schema.add(name, kind)
    result = named.mapInArrow(work, schema)
    return result.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c.lower() not in made], *made)


def _scan_slice(part, machine, base, notices, allowed) -> list[tuple]:
    count = len(part.offsets) - 1
    words = find_words(part.data, part.offsets, ALPHANUMERIC, hashed=False)
    per_doc = np.bincount(words.doc, minlength=count) if len(words.doc) else np.zeros(count, np.int64)
    first_of = np.cumsum(per_doc) - per_doc
    length = words.end - words.start
    at = np.cumsum(length + 1) - length - 1  # start of each word in the joined text
    joined = np.full(int((length + 1).sum()), 32, np.uint8)
    if len(length):
        own = np.flatnonzero(ALPHANUMERIC[part.data])
        joined[np.arange(len(own)) + np.repeat(np.arange(len(length)), length)] = LOWER[part.data[own]]
        last = np.flatnonzero(np.diff(np.append(words.doc, count)))
        joined[at[last] + length[last]] = 10  # texts do not meet
    body = joined.tobytes().decode("latin-1")
    found: dict[int, dict] = {}
    whole: bytes | None = None
    for end, phrase in machine.iter(body):
        start = end - len(phrase) + 1
        if (start and body[start - 1] not in " \n") or (end + 1 < len(body) and body[end + 1] not in " \n"):
            continue
        word = int(np.searchsorted(at, start))
        doc = int(words.doc[word])
        own = found.setdefault(doc, {"places": [], "base": set(), "labels": set(), "tags": 0, "notices": 0, "allowed": []})
        if phrase in base:
            own["places"].append(word - int(first_of[doc]))
            own["base"].add(base[phrase])
            own["allowed"].append(base[phrase] in allowed)
            own["notices"] += 1
        if phrase in notices:
            own["labels"].add(notices[phrase])
            own["allowed"].append(notices[phrase] in allowed)
            own["notices"] += 1
        if phrase == TAG:
            whole = part.data.tobytes() if whole is None else whole
            behind, stop = int(words.end[word + TAG.count(" ")]), int(part.offsets[doc + 1])
            polish, _ = longest_expression(tokens_at(whole, BEFORE.match(whole, behind, stop).end(), stop))
            if polish:
                labels, ok = evaluate(polish, allowed)
                own["labels"] |= labels
                own["allowed"].append(ok)
                own["tags"] += 1
    rows = []
    for doc in range(count):
        own = found.get(doc)
        if own is None:
            rows.append((int(per_doc[doc]), 0, None, None, "", "", 0.0, 0, None))
            continue
        places = own["places"]
        score = 1.0 - (1.0 - TAG_EVIDENCE) ** own["tags"] * (1.0 - NOTICE_EVIDENCE) ** own["notices"]
        rows.append((
            int(per_doc[doc]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own["base"])),
            ",".join(sorted(own["base"] | own["labels"])), score, own["tags"], all(own["allowed"]) if own["allowed"] else None,
        ))
    return rows
