"""Exact ids for BPE vocabularies whose pre-tokenizer drops white space.

Such a tokenizer never looks across white space: its normalizer keeps ASCII white space as white
space, its split removes it, and special strings hold none. So the ids of a text are the ids of its
white-space words in a row, and a bounded memo of words gives them without the library's cost per
text. ASCII words are cut by the vocabulary's own pattern, all others by the library itself; merges
are always the library's.
"""

from __future__ import annotations

import json
import os
import re
import struct

from tokenizers import Tokenizer

#: Entries of a memo's generation; one holds about 150 bytes.
MEMO_ENTRIES = 200_000
#: Longer words are computed each time.
MEMO_WORD = 48

# fixed values: the only pre-tokenizer pattern these operators know; words of visible ASCII and of letters
# that no normal form changes; and the pattern's form for such words in lower case
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE = re.compile("[!-~À-ÖØ-öø-įĲ-ſ]+")
SIMPLE_PATTERN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")


def load(path: str) -> Tokenizer:
    """The library's tokenizer without truncation and padding, checked to treat words one by one."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    spec = json.loads(tok.to_str())
    steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    fits = (
        spec["model"]["type"] == "BPE" and steps == ["NFC", "Replace", "Lowercase"] and spec["post_processor"] is None
        and splits[0].get("pattern") == {"Regex": WORD_PATTERN} and splits[0].get("invert")
        and splits[0].get("behavior") == "Removed" and [s["type"] for s in splits[1:]] == ["ByteLevel"]
        and not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["content"].split() != [a["content"]]
                    for a in spec["added_tokens"])
    )
    if not fits:
        raise ValueError(f"{path} does not encode white-space words one by one")
    return tok


def byte_alphabet() -> dict[int, str]:
    """Byte -> character of the byte alphabet: visible Latin-1 characters stand for themselves, the
    other bytes in order for the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces:
    """Pre-tokens of a white-space word, in the byte alphabet of the vocabulary."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.special = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special) if self.special else None
        self.alphabet = byte_alphabet()

    def is_plain(self, word: bytes) -> bool:
        return self.mark is None or self.mark not in word or not any(s in word for s in self.special)

    def of(self, word: bytes) -> list[str]:
        """Pre-tokens of a word without special strings."""
        if word.isalpha():
            return [word.lower().decode()]
        text = word.decode("utf-8")
        if SIMPLE.fullmatch(text):
            found = SIMPLE_PATTERN.findall(text.lower())
            return found if word.isascii() else [p.encode().decode("latin-1").translate(self.alphabet) for p in found]
        normal = self.tok.normalizer.normalize_str(text)
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)]


class Memo(dict):
    """Computes what it lacks. When it is full its entries become the old generation, of which those
    that are asked for again come back, so frequent words stay and memory is bounded."""

    def __init__(self, compute, entries: int):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.compute(key)
        if len(key) <= MEMO_WORD:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class WordIds:
    """Packed ids (little-endian unsigned 32-bit integers) of white-space words and of texts."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        self.tok = load(path)
        self.pieces = Pieces(self.tok)
        self.packed = [struct.pack("<I", i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.parts = Memo(self._merge, entries)
        self.words = Memo(self._word, entries)

    def _word(self, word: bytes) -> bytes:
        if self.pieces.is_plain(word):
            return b"".join(map(self.parts.__getitem__, self.pieces.of(word)))
        return b"".join(map(self.packed.__getitem__, self.tok.encode(word.decode("utf-8"), add_special_tokens=False).ids))

    def _merge(self, piece: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tok.model.tokenize(piece)])

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        return b"".join(map(self.words.__getitem__, text.split()))


_KEPT: dict[tuple, object] = {}


def kept(make, *args):
    """make(*args), made once in a Python worker: a worker that runs several tasks keeps its memo."""
    key = (make, *args)
    if key not in _KEPT:
        _KEPT[key] = make(*args)
    return _KEPT[key]
