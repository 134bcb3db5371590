"""Token counts by offset-mapped attribution.

A whole document is encoded once with a byte-level BPE vocabulary; the character span of each token is then joined to
the sections of the document (its lines, each with its line end), or to fields laid end to end, by binary search over
the section bounds. Tokens lie within words, so a word whose characters are all in one section brings all its tokens there;
the tokens of a word that crosses a boundary are looked at one by one.
The rule for a token that crosses a boundary: it belongs to the section that has most of its characters, of
equal ones to the first. A token of a part of a character has that character's span.

Null texts count as empty: no tokens, one empty section. Null fields count as empty fields. Repeated rows give
repeated results; an empty table gives no rows; further columns are ignored. The vocabulary file is a parameter; each
Python worker loads it once. Special tokens' strings inside texts are ordinary text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalith.llm._text import give_back
from chromalith.llm.bpe import Ranks, byte_symbols, merge_word

# fixed values: the pattern that cuts texts into words before byte-level BPE
LETTER, DIGIT = r"\p{L}", r"\p{N}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{DIGIT}+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+"
#: Within these characters letters and digits are plain ranges, so the standard library's faster matcher does.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
BEYOND_LATIN = re.compile(f"[^\\x00-\\x1b!-~ {LATIN}]").search
#: Characters in the keys of one generation of the memo of words.
MEMO_CHARS = 3_000_000
LONGEST_KEPT = 64


class _Memo(dict):
    """The number of tokens of words, long ones aside, in two generations: memory is bounded and frequent words stay."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe, self.held, self.old = bpe, 0, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = len(self.bpe.ids(word))
        if len(word) <= LONGEST_KEPT:
            self[word] = n
            self.held += len(word)
        return n

    def trim(self) -> None:
        if self.held > MEMO_CHARS:
            self.old = dict(self)
            self.clear()
            self.held = 0

    def forget(self) -> None:
        """Workers live on after a task, and other operators need their memory."""
        self.old, self.held = {}, 0
        self.clear()


class ByteBpe:
    """Byte-level BPE as described by a tokenizer JSON file: tokens of words, and the bytes of each token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.bytes_of = {i: len(s) for s, i in vocab.items()}
        self.byte_ids = [vocab[s] for s in byte_symbols()]
        self.pairs, self.made = Ranks(), []
        for i, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.pairs.add(vocab[left], vocab[right], i)
            self.made.append(vocab[left + right])
        self.find = regex.compile(PATTERN).findall
        self.find_latin = re.compile(PATTERN.replace(LETTER + DIGIT, f"{LATIN}0-9").replace(LETTER, f"[{LATIN}]").replace(DIGIT, "[0-9]")).findall
        self.memo = _Memo(self)

    def words(self, text: str) -> list[str]:
        """The words, which laid end to end are the text."""
        return (self.find if BEYOND_LATIN(text) else self.find_latin)(text)

    def ids(self, word: str) -> list[int]:
        return merge_word([self.byte_ids[b] for b in word.encode("utf-8", "surrogatepass")], self.pairs, self.made)

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word."""
        self.memo.trim()
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def spans(self, word: str) -> np.ndarray:
        """(start, end) in characters of each token of a word."""
        char = np.cumsum((np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80) - 1
        end = np.cumsum([self.bytes_of[i] for i in self.ids(word)])
        return np.stack([char[np.concatenate(([0], end[:-1]))], char[end - 1] + 1], axis=1)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def attribute(spans: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each section; spans: (start, end) rows, bounds: ascending section starts, then the text's length."""
    n = len(bounds) - 1
    out = np.zeros(n, np.int64)
    for start, end in spans.tolist():
        # empty sections share their bound with the next one, which has the characters
        first = min(int(np.searchsorted(bounds, start, "right")) - 1, n - 1)
        last = min(max(int(np.searchsorted(bounds, end, "left")) - 1, first), n - 1)
        out[max(range(first, last + 1), key=lambda s: (min(end, bounds[s + 1]) - max(start, bounds[s]), -s))] += 1
    return out


def section_counts(bpe: ByteBpe, text: str, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each section of a text."""
    n = len(bounds) - 1
    words = bpe.words(text)
    if not words:
        return np.zeros(n, np.int64)
    counts = bpe.counts(words)
    if n == 1:
        return np.array([counts.sum()])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    whole = first == last
    out = np.bincount(first[whole], counts[whole], n).astype(np.int64)
    for w in np.flatnonzero(~whole).tolist():
        a, b = int(first[w]), int(last[w]) + 1
        out[a:b] += attribute(bpe.spans(words[w]), np.concatenate(([0], bounds[a + 1 : b] - starts[w], [ends[w] - starts[w]])))
    return out


def line_bounds(text: str) -> np.ndarray:
    lengths = [len(x) + 1 for x in text.split("\n")]
    lengths[-1] -= 1
    return np.concatenate(([0], np.cumsum(lengths)))


def count_tokens(docs: DataFrame, vocab_path: str, fields: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_sections and section_tokens for every document.

    Sections are the lines of text_col, or, if given, the string columns `fields` laid end to end.
    """
    names = fields or [text_col]

    def run(batches):
        bpe = load(vocab_path)
        for batch in batches:
            columns = [batch.column(i + 1).fill_null("").to_pylist() for i in range(len(names))]
            sections = []
            for r in zip(*columns, strict=True):
                text = "".join(r)
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in r]))) if fields else line_bounds(text)
                sections.append(section_counts(bpe, text, bounds))
            totals = [int(s.sum()) for s in sections]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sections]))).astype(np.int32)
            flat = np.concatenate(sections) if sections else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], ["k", "n_tokens", "n_sections", "section_tokens"])
        bpe.memo.forget()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), *[F.col(f"`{c}`").cast("string").alias(f"f{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(run, f"k {kind}, n_tokens bigint, n_sections bigint, section_tokens array<bigint>").withColumnRenamed("k", id_col)
