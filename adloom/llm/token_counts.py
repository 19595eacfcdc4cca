"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone by the library; those that come
back as exactly their own id are proven whole tokens. In a text, a pre-token in that table counts one
without any merging; only the others are merged.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from adloom.llm.rows import column, per_batch, texts
from adloom.llm.wordbpe import MEMO_ENTRIES, Memo, Pieces, byte_alphabet, kept, load

END = "</w>"


def whole_tokens(path: str) -> frozenset[str]:
    """Pre-tokens (byte alphabet) proven to encode alone as one token; size bounded by the vocabulary."""
    tok = load(path)
    ends = {s[: -len(END)]: i for s, i in tok.get_vocab(with_added_tokens=False).items() if s.endswith(END)}
    back = {c: b for b, c in byte_alphabet().items()}
    proven = []
    for piece, i in ends.items():
        raw = bytes(back[c] for c in piece)
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:  # a part of a character is no text of its own
            continue
        # the text must also come through normalizing and splitting as this very pre-token
        if tok.encode(text, add_special_tokens=False).ids == [i]:
            pieces = [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))]
            if pieces == [piece]:
                proven.append(piece)
    return frozenset(proven)


class WordCounts:
    """Number of tokens of white-space words."""

    def __init__(self, path: str, proven: frozenset[str], entries: int = MEMO_ENTRIES):
        self.tok = load(path)
        self.pieces, self.proven = Pieces(self.tok), proven
        self.merged = Memo(lambda piece: len(self.tok.model.tokenize(piece)), entries)
        self.words = Memo(self._word, entries)

    def _word(self, word: bytes) -> int:
        if self.pieces.is_plain(word):
            proven, merged = self.proven, self.merged
            return sum([1 if p in proven else merged[p] for p in self.pieces.of(word)])
        return len(self.tok.encode(word.decode("utf-8"), add_special_tokens=False).ids)

    def count(self, text: bytes) -> int:
        return sum(map(self.words.__getitem__, text.split()))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) per row.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id is carried; repeated rows each give
    a row; an empty table gives none; other columns are not looked at. One narrow pass: no shuffle.
    """
    proven = whole_tokens(tokenizer)

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        counts = kept(WordCounts, tokenizer, proven)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = texts(batch)
            n = [counts.count(t) for t in raw]
            return pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return per_batch(docs.select("doc_id", "text"), start, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
