"""BPE encoding and decoding with a published vocabulary file.

Per word: a priority queue of merge ranks over a doubly linked symbol list; entries whose symbols have since
merged are skipped as stale. Decoding joins vocabulary strings as the file's decoder setting says (none: one
space between them). The vocabulary file is a parameter and is loaded once in each Python worker.

Defined results: a null text counts as empty (0 tokens, digests of the empty string); repeated rows give
repeated results; extra columns of the input are ignored by `encode_table`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chromalith.llm._text import give_back

#: Within these characters letters and digits are plain ranges, so the standard library's faster matcher does.
LATIN_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
BEYOND_LATIN = re.compile(f"[^\\x00-\\x1b!-~ {LATIN_LETTERS}]").search
CACHE_WORDS = 160_000
LONGEST_KEPT = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Ranks(dict):
    """The merge rank of a pair, by its left symbol and then its right one: ranks[left].get(right)."""

    NONE: dict[int, int] = {}

    def add(self, left: int, right: int, rank: int) -> None:
        self.setdefault(left, {})[right] = rank

    def __missing__(self, left):
        return self.NONE


def merge_word(ids: list[int], pairs: Ranks, made: list[int]) -> list[int]:
    """Merge by lowest rank, leftmost first, until no ranked pair is left.

    ids: a symbol id for each position; pairs: ranks of pairs; made: rank to the new symbol's id.
    """
    n = len(ids)
    if n == 1:
        return ids
    shift = n.bit_length()
    ranks = [pairs[a].get(b, -1) for a, b in zip(ids, ids[1:], strict=False)]
    queue = [r << shift | i for i, r in enumerate(ranks) if r >= 0]
    if not queue:
        return ids
    heapq.heapify(queue)
    pop, push, mask = heapq.heappop, heapq.heappush, (1 << shift) - 1
    ranks.append(-1)  # ranks[i]: of the pair that begins at i now
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    while queue:
        top = pop(queue)
        i, r = top & mask, top >> shift
        if ranks[i] != r:
            continue  # stale: one of the two has merged since
        j = after[i]
        new = ids[i] = made[r]
        ids[j] = ranks[j] = -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            r = ranks[i] = pairs[new].get(ids[k], -1)
            if r >= 0:
                push(queue, r << shift | i)
        else:
            ranks[i] = -1
        p = before[i]
        if p >= 0:
            r = ranks[p] = pairs[ids[p]].get(new, -1)
            if r >= 0:
                push(queue, r << shift | p)
    return [x for x in ids if x >= 0]


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        found = self.make(word)
        if len(word) <= LONGEST_KEPT:  # so that the number of words bounds the bytes
            self[word] = found
        return found


class WordBpe:
    """Word-level BPE with an end-of-word suffix, as described by a tokenizer JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        latin = split["pattern"]["Regex"].replace(r"[\p{L}]", f"[{LATIN_LETTERS}]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", f"{LATIN_LETTERS}0-9")
        self.find_latin = re.compile(latin).findall if "\\p" not in latin else self.find
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        # symbols may be missing from the vocabulary: such ones get ids past its end and are left out at the end
        known = dict(self.vocab)
        name = lambda s: known.setdefault(s, len(known) + (1 << 20))
        self.byte_ids = [name(s) for s in symbols]
        self.last_ids = [name(s + self.suffix) for s in symbols]
        self.pairs, self.made = Ranks(), []
        for i, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.pairs.add(name(left), name(right), i)
            self.made.append(name(left + right))
        self.complete = max(*self.byte_ids, *self.last_ids) < 1 << 20
        self.memo, self.old = _Memo(self._word), {}

    def ids_of_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.byte_ids[b] for b in raw]
        ids[-1] = self.last_ids[raw[-1]]
        return [i for i in merge_word(ids, self.pairs, self.made) if i < 1 << 20]

    def _word(self, word: str) -> tuple[str, str]:
        """The ids and the vocabulary strings of a word, each joined by spaces."""
        found = self.old.get(word)
        if found is None:
            ids = self.ids_of_word(word)
            found = " ".join(map(str, ids)), self.decode(ids)
        return found

    def _trim(self) -> None:
        """Keep what was looked up lately in two generations, so that memory is bounded and frequent words stay."""
        if len(self.memo) > CACHE_WORDS:
            self.old = dict(self.memo)
            self.memo.clear()

    def forget(self) -> None:
        """Empty the memo: workers live on after a task, and other operators need their memory."""
        self.old = {}
        self.memo.clear()

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # character by character, as a final sigma has no rule of its own here
        text = text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()
        return (self.find_latin if not BEYOND_LATIN(text) else self.find)(text)

    def pieces(self, text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """For each word or special token in turn: ids and vocabulary strings, each joined by spaces."""
        self._trim()
        found = []
        parts = self.cut.split(text) if self.cut and any(x in text for x in self.special) else (text,)
        for part in parts:
            if part in self.special:
                found.append((str(self.special[part]), part))
            elif part:
                found += map(self.memo.__getitem__, self.words(part))
        if not self.complete:
            found = [x for x in found if x[0]]
        return tuple(zip(*found, strict=True)) if found else ((), ())

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids in self.pieces(text or "")[0] for i in ids.split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def digest(self, text: str | None) -> tuple[int, str, str, str, str]:
        """Number of tokens, SHA-256 of the ids joined by spaces, SHA-256 of the decoded text, and both of these."""
        coded, shown = map(" ".join, self.pieces(text or ""))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return coded.count(" ") + bool(coded), sha(coded), sha(shown), coded, shown


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_table(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 for every row; with ids or decoded also the ids or the decoded text."""
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if ids else {}) | ({"decoded": pa.string()} if decoded else {})

    def run(batches):
        bpe = load(vocab_path)
        for batch in batches:
            cols = {k: [] for k in kinds}
            for t in batch.column(1):
                n, coded_sha, shown_sha, coded, shown = bpe.digest(t.as_py())
                found = {"n_tokens": n, "ids_sha256": coded_sha, "decoded_sha256": shown_sha, "decoded": shown}
                if ids:
                    found["ids"] = np.fromstring(coded, np.int32, sep=" ")
                for k, c in cols.items():
                    c.append(found[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[k]) for k, c in cols.items())], ["k", *kinds])
        bpe.forget()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"k {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    out = docs.selectExpr(f"`{id_col}` as k", f"`{text_col}` as t").mapInArrow(run, schema)
    return out.withColumnRenamed("k", id_col)
