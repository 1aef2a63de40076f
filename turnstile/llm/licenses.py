"""License scans with ordered signature rules.

A text is lower-cased and reduced to its words. A keyword automaton runs over
every text once; only the rules whose keyword it found are tried. Each rule is a
regular expression over the words with a label, a priority and a confidence. A
detection whose words lie within those of a kept detection of at least its own
priority is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from turnstile.llm.words import LOWER, passes, text_bytes

#: Phrases that are always reported, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: True for the bytes of words: 0-9, a-z after lower-casing, and everything above 0x7F.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


#: Label, names (regular expressions over words), short names, versions.
FAMILIES = (
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "agpl", ("1 0", "3 0", "3")),
    ("apache", r"apache (?:software )?licen[cs]e", "apache", ("1 0", "1 1", "2 0", "2")),
    ("artistic", r"(?:perl )?artistic licen[cs]e", "artistic", ("1 0", "2 0")),
    ("boost", r"boost software licen[cs]e", "bsl", ("1 0",)),
    ("bsd", r"bsd (?:style )?licen[cs]e", "bsd", ("0 clause", "1 clause", "2 clause", "3 clause", "4 clause")),
    ("cc-by", r"creative commons attribution(?: licen[cs]e)?", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: licen[cs]e)?", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?", "cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: licen[cs]e)?", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", r"creative commons (?:zero|public domain dedication)", "cc0", ("1 0",)),
    ("cddl", r"common development and distribution licen[cs]e", "cddl", ("1 0", "1 1")),
    ("cecill", r"cecill (?:free software )?licen[cs]e", "cecill", ("1 0", "2 0", "2 1")),
    ("cpl", r"common public licen[cs]e", "cpl", ("1 0",)),
    ("epl", r"eclipse public licen[cs]e", "epl", ("1 0", "2 0")),
    ("eupl", r"european union public licen[cs]e", "eupl", ("1 0", "1 1", "1 2")),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "gfdl", ("1 1", "1 2", "1 3")),
    ("gpl", r"(?:gnu )?general public licen[cs]e", "gpl", ("1 0", "2 0", "2", "3 0", "3")),
    ("isc", r"isc licen[cs]e", "isc", ()),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl", ("2 0", "2 1", "3 0", "3")),
    ("mit", r"mit licen[cs]e", "mit", ()),
    ("mpl", r"mozilla public licen[cs]e", "mpl", ("1 0", "1 1", "2 0")),
    ("ms-pl", r"microsoft (?:public|reciprocal) licen[cs]e", "ms pl", ()),
    ("odbl", r"open database licen[cs]e", "odbl", ("1 0",)),
    ("ofl", r"(?:sil )?open font licen[cs]e", "ofl", ("1 0", "1 1")),
    ("osl", r"open software licen[cs]e", "osl", ("1 0", "2 0", "2 1", "3 0")),
    ("psf", r"python software foundation licen[cs]e", "psf", ("2 0",)),
    ("unlicense", r"(?:the )?unlicense", "unlicense", ()),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", "wtfpl", ("1 0", "2 0")),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", ()),
)

#: Whole sentences that stand for a licence or a claim.
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification"),
    ("zlib", r"this software is provided as is without any express or implied warranty"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", r"no part of this (?:work|publication|document|page|text) may be (?:reproduced|copied)"),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution)[a-z ]{0,40} (?:is )?(?:strictly )?prohibited"),
    ("noncommercial", r"for (?:personal|non ?commercial|academic) use only"),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d"),
)


def signature_rules() -> tuple[Rule, ...]:
    """All rules in order, made from the families: identifier, text and name forms, with and without version."""
    rules = []
    for label, name, short, versions in FAMILIES:
        keyword = short.split()[0] if short.split()[0] not in ("bsl", "ms", "osl", "psf", "ofl") else "spdx"
        named = "creative commons" if name.startswith("creative") else "licen" if "licen[cs]e" in name else short
        for version in versions:
            full = f"{label}-{version.replace(' clause', '').replace(' ', '.')}"
            rules.append(Rule(full, "spdx", rf"spdx licen[cs]e identifier {short} {version}(?: or later| only)?", 9, 1.0))
            rules.append(Rule(full, named, rf"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{name} (?:version |v ?)?{version}", 8, 0.95))
            rules.append(Rule(full, named, rf"{name} (?:version |v ?)?{version}", 7, 0.9))
            if keyword != "spdx":
                rules.append(Rule(full, keyword, rf"{short} ?(?:version |v ?)?{version}", 6, 0.8))
        rules.append(Rule(label, "spdx", rf"spdx licen[cs]e identifier {short}", 5, 0.95))
        rules.append(Rule(label, named, rf"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{name}", 4, 0.85))
        rules.append(Rule(label, named, name, 3, 0.7))
    for label, pattern in SENTENCES:
        keyword = next(w for w in ("permission", "redistribution", "warranty", "public domain", "proprietary", "reproduced", "prohibited", "use only", "copyright", "copied") if w in pattern)
        keyword = "no part of this" if pattern.startswith("no part") else keyword
        rules.append(Rule(label, keyword, pattern, 4, 0.75))
    return tuple(rules)


RULES = signature_rules()


class Scanner:
    """Compiled rules; built once per Python worker."""

    def __init__(self, rules: Sequence[Rule] = RULES, phrases: Sequence[tuple[str, str]] = PHRASES):
        self.automaton = ahocorasick.Automaton()
        gates: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            gates.setdefault(f" {rule.keyword}", []).append(i)
        for i, (phrase, _) in enumerate(phrases):
            gates.setdefault(f" {phrase} ", []).append(-1 - i)
        for keyword, owners in gates.items():
            self.automaton.add_word(keyword, tuple(owners))
        self.automaton.make_automaton()
        self.rules = [(r, re.compile(rf"(?<= ){r.pattern}(?= )")) for r in rules]
        self.phrases = [(label, re.compile(rf"(?= {re.escape(phrase)} )")) for phrase, label in phrases]

    def scan(self, text: str) -> tuple[list, list]:
        """Base places (word, label) and kept detections (first word, last word, label, confidence).

        ``text`` holds the words, each with one space before and after it.
        """
        hits: set[int] = set()
        for _, owners in self.automaton.iter(text):
            hits.update(owners)
        if not hits:
            return [], []
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32).tolist()
        word = lambda at: bisect_right(spaces, at) - 1  # noqa: E731  a space belongs to the word after it
        base, found = [], []
        for i in sorted(hits):
            if i < 0:
                label, pattern = self.phrases[-1 - i]
                base += [(word(m.start()), label) for m in pattern.finditer(text)]
            else:
                rule, pattern = self.rules[i]
                found += [(-rule.priority, i, word(m.start()), word(m.end() - 1), rule.label, rule.confidence) for m in pattern.finditer(text)]
        return sorted(base), suppress(found)


def suppress(found: list[tuple]) -> list[tuple]:
    """Keep a detection unless a kept one of at least its priority contains it; of equal spans the earlier rule stays.

    Kept spans none of which contains another are ordered by both ends, so a
    containing one is found by bisection.
    """
    firsts: list[int] = []
    spans: list[tuple] = []
    kept = []
    for detection in sorted(found, key=lambda d: (d[0], d[2] - d[3], d[1], d[2])):
        _, _, first, last, label, confidence = detection
        at = bisect_right(firsts, first)
        if at and spans[at - 1][1] >= last:
            continue
        kept.append((first, last, label, confidence))
        reach = at
        while reach < len(spans) and spans[reach][1] <= last:
            reach += 1
        begin = at - 1 if at and firsts[at - 1] == first else at
        firsts[begin:reach] = [first]
        spans[begin:reach] = [(first, last)]
    return sorted(kept)


@cache
def scanner() -> Scanner:
    return Scanner()


def normal_words(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one space before each and one at the end of each text, as bytes with bounds.

    A text without words becomes a single space.
    """
    n = len(bounds) - 1
    low = np.full(len(buffer) + n, 32, np.uint8)
    at = np.arange(len(buffer)) + np.repeat(np.arange(1, n + 1), np.diff(bounds))
    low[at] = np.where(WORD_BYTES[LOWER[buffer]], LOWER[buffer], np.uint8(32))
    lower_bounds = bounds + np.arange(n + 1)
    low = np.append(low, np.uint8(32))
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[lower_bounds[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], kept[lower_bounds]


def _row(scan: Scanner, words: str) -> tuple:
    text = words if words.endswith(" ") else f"{words} "
    base, found = scan.scan(text)
    labels = sorted({label for _, label in base})
    wider = sorted({*labels, *(label for *_, label, _ in found)})
    doubt = 1.0
    for sure in [0.6] * bool(base) + [c for *_, c in found]:
        doubt *= 1.0 - sure
    n_words = text.count(" ") - 1 if len(text) > 1 else 0
    first, last = (base[0][0], base[-1][0]) if base else (None, None)
    return n_words, len(base), first, last, ",".join(labels), ",".join(wider), 1.0 - doubt, [{"first": a, "last": b, "label": c, "confidence": d} for a, b, c, d in found]


SCAN = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("detections", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])))]
)


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds what the rules find to every row: counts, labels, score and the kept detections.

    n_words; n_base (all places of the base phrases), first_word and last_word
    (their smallest and largest start, words from 0, else null); base_labels and
    labels (distinct, sorted, joined by commas, else empty); score (0 to 1: one
    minus the product of the doubts); detections with first and last word. Null
    and empty texts have none. Repeated rows give repeated results; other
    columns pass through, except those that have one of the new names.
    """
    kept = [c for c in df.columns if c not in SCAN.names]
    rows = df.select(kept)
    added = (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, detections array<struct<first: bigint, last: bigint, label: string, confidence: double>>"
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, text):
                words, bounds = normal_words(*text_bytes(part.column(text)))
                data = words.tobytes()
                found = [_row(scanner(), data[a:b].decode()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), SCAN.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *SCAN.names])

    return rows.mapInArrow(scan, StructType([*rows.schema, *StructType.fromDDL(added)]))
