"""Token counts (operator 5) of a byte-level BPE vocabulary.

Method: heap-and-linked-list byte-pair merging. The bytes of a piece form a
doubly linked list, all adjacent pairs that have a merge rank a heap; the lowest
rank (leftmost first) is popped and merged, and the two new pairs are pushed. Only
the number of merges is kept: tokens = bytes minus merges; no identifier is
emitted.

A text is cut at special strings (one token each, as the library does by
default), then at each space between two non-space characters, where the
vocabulary's pre-tokeniser always cuts; a chunk's count depends on the chunk
alone, so counts of distinct chunks are and pre-tokens are kept per worker in bounded memos and a
text's count is a sum over its chunks. No shuffle.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows repeat;
extra columns are ignored; the vocabulary is read where the task runs, by name.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import ship

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
_MEMO_MAX = 600_000
_LONG = 256  # longer chunks are not kept
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, every other
    byte for the next letter from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Merge ranks and pre-tokeniser of a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        names: dict[bytes, int] = {}

        def number(token: str) -> int:
            return names.setdefault(bytes(letters[c] for c in token), len(names))

        self.first = [number(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[number(a), number(b)] = rank, number(a + b)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        # the byte-level pre-tokeniser's fixed pattern, with white space spelt out
        self.piece = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        self.memo: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(piece)
        if n < 2:
            return n
        sym = [self.first[b] for b in piece]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            if found := ranks.get((sym[i], sym[i + 1])):
                heap.append((found[0], i, sym[i], sym[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = new, -1
            merges += 1
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                if found := ranks.get((new, sym[after])):
                    heapq.heappush(heap, (found[0], i, new, sym[after], found[1]))
            before = left[i]
            if before >= 0 and (found := ranks.get((sym[before], new))):
                heapq.heappush(heap, (found[0], before, sym[before], new, found[1]))
        return n - merges

    def chunk(self, chunk: str) -> int:
        total, kept = 0, self.pieces
        for p in self.piece.findall(chunk):
            n = kept.get(p)
            if n is None:
                n = self.merged(p.encode("utf-8", "surrogatepass"))
                if len(p) <= _LONG:
                    kept[p] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def _plain(self, text: str) -> int:
        memo, total = self.memo, 0
        for kept in (memo, self.pieces):
            if len(kept) > _MEMO_MAX:
                kept.clear()
        chunks = _CUT.split(text)
        # every chunk but the first has its space back in front
        first = chunks[0]
        if first:
            total += self.chunk(first)
        for c, times in Counter(chunks[1:]).items():
            n = memo.get(c)
            if n is None:
                n = self.chunk(" " + c)
                if len(c) <= _LONG:
                    memo[c] = n
            total += n * times
        return total


_LOADED: dict[str, Bpe] = {}


def loaded(name: str) -> Bpe:
    """The vocabulary of that name, read once per worker."""
    if name not in _LOADED:
        import public_tokenizers
        _LOADED[name] = Bpe(str(public_tokenizers.path(name)))
    return _LOADED[name]


def with_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(vocabulary)
        for texts in batches:
            yield pd.Series([bpe.count(t) for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", tokens("text"))


def op5(docs: DataFrame) -> DataFrame:
    counted = with_tokens(docs.select("doc_id", "text"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
