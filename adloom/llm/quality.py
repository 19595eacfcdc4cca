"""Line-first cleaning: rules judge single lines, failing lines go, and a document that loses too much goes.

Words are runs of characters other than ASCII white space; a line is what stands between line feeds.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from adloom.llm.rows import column, per_batch, texts

# fixed values: what may end a sentence, what separates menu entries, symbols, and stock phrases
TERMINAL = tuple(s.encode() for s in (".", "!", "?", ":", ";", ",", "\"", "'", ")", "…", "”", "’", "»", "。", "！", "？"))
SEPARATORS = frozenset(s.encode() for s in ("|", "/", ">", "»", "›", "·", "•"))
SYMBOLS = b"#*$%&|<>"
BOILERPLATE = (b"all rights reserved", b"licensed under", b"privacy policy", b"terms of use", b"terms of service", b"cookie",
               b"javascript", b"lorem ipsum", b"click here", b"subscribe to", b"sign up for", b"log in")
# whole words only (bytes above ASCII count as letters); a plural is the same phrase
STOCK = re.compile(rb"(?<![\w\x80-\xff])(?:" + b"|".join(map(re.escape, BOILERPLATE)) + rb")s?(?![\w\x80-\xff])")


@dataclass(frozen=True)
class Rules:
    """Limits in whole percent, so that they can be checked in integers."""

    short_line: int = 5  # a line with fewer words must end like a sentence
    separators: int = 25  # words of a line that are separators
    stock_line: int = 20  # a line with at most so many words fails by one stock phrase
    stock: int = 20  # words of a longer line that are in stock phrases
    symbols: int = 60  # symbols of a line per 100 words
    lost: int = 50  # words of a document on failing lines
    min_words: int = 50
    repeated: int = 50  # words in repeated 3-word windows


def line_fails(line: bytes, words: list[bytes], rules: Rules) -> bool:
    """Whether a line with words is navigation, symbol junk, boilerplate or a fragment."""
    n = len(words)
    if n < rules.short_line and not words[-1].endswith(TERMINAL):
        return True
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols and 100 * symbols > rules.symbols * n:
        return True
    if 100 * sum(w in SEPARATORS for w in words) > rules.separators * n:
        return True
    low = line.lower()
    if not any(p in low for p in BOILERPLATE):
        return False
    found = STOCK.findall(low)
    return bool(found) and (n <= rules.stock_line or 100 * sum(len(p.split()) for p in found) > rules.stock * n)


def repeated_words(counts: list[int], hashes: np.ndarray) -> list[int]:
    """Per text, the words inside 3-word windows that occur twice or more in it; hashes of all texts in a row."""
    total = len(hashes)
    if total < 3:
        return [0] * len(counts)
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    h = hashes.view(np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    g = (h[:-2] * m + h[1:-1]) * m + h[2:]
    g ^= g >> np.uint64(29)
    g = (g * m + doc[:-2].astype(np.uint64)) * m  # windows of different texts never meet
    inside = doc[:-2] == doc[2:]
    at = np.flatnonzero(inside)
    order = at[np.argsort(g[at], kind="stable")]
    same = g[order][1:] == g[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    starts = order[again]
    hit = np.zeros(total, bool)
    for k in range(3):
        hit[starts + k] = True
    return np.bincount(doc[hit], minlength=len(counts)).tolist()


def measure(raw: list[bytes], rules: Rules, with_text: bool) -> tuple[list, ...]:
    """Per text: words, their code points, symbols, repeated lines, words in repeated windows, base failure,
    verdict, words on failing lines, text without these lines."""
    counts, chars, symbols, dups, lost, cleaned = [], [], [], [], [], []
    words: list[bytes] = []
    for text in raw:
        before = len(words)
        seen: set[bytes] = set()
        repeats = gone = 0
        good: list[bytes] = []
        for line in text.split(b"\n"):
            own = line.split()
            if not own:
                continue
            words += own
            if line in seen:
                repeats += 1
                gone += len(own)
            else:
                seen.add(line)
                if line_fails(line, own, rules):
                    gone += len(own)
                else:
                    good.append(line)
        counts.append(len(words) - before)
        chars.append(len(b"".join(words[before:]).decode("utf-8")))
        symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
        dups.append(repeats)
        lost.append(gone)
        cleaned.append(b"\n".join(good).decode("utf-8") if with_text else None)
    again = repeated_words(counts, np.fromiter(map(hash, words), np.int64, len(words)))
    failed = [n < rules.min_words or 100 * r > rules.repeated * n for n, r in zip(counts, again)]
    kept = [not f and 100 * x <= rules.lost * n for f, x, n in zip(failed, lost, counts)]
    return counts, chars, symbols, dups, again, failed, kept, lost, cleaned


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, lost_words long, clean_text string")


def clean_lines(docs: DataFrame, rules: Rules | None = None, with_text: bool = True) -> DataFrame:
    """Measures, verdict and cleaned text per row.

    word_chars counts code points in words; n_dup_lines the lines with a word that equal an earlier
    line; lost_words the words on failing lines (repeats of an earlier line fail too); kept is false
    for a document that fails the base rules or loses more than `lost` percent of its words. A null
    or empty text has no words and is not kept; a null doc_id is carried; repeated rows each give a
    row; an empty table gives none; other columns are not looked at. One narrow pass.
    """
    rules = rules or Rules()

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            *longs, failed, kept, lost, cleaned = measure(texts(batch), rules, with_text)
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *[pa.array(c, pa.int64()) for c in longs], pa.array(failed, pa.bool_()),
                 pa.array(kept, pa.bool_()), pa.array(lost, pa.int64()), pa.array(cleaned, pa.string())],
                [c.split()[0] for c in SCHEMA.split(", ")])

        return step

    return per_batch(docs.select("doc_id", "text"), start, SCHEMA)


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of docs, unchanged and with all their columns, that are kept."""
    rules = rules or Rules()

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(measure(texts(batch), rules, False)[6], pa.bool_()))

        return step

    return per_batch(docs, start, docs.schema)
