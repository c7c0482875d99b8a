"""Exact byte-pair token counts without identifiers: initial symbols minus merges, by a heap over a linked list.

A pre-token's bytes form a doubly linked list; a heap holds the rank and place of each adjacent pair that the
vocabulary merges. The lowest rank, leftmost first, is popped and merged until none is left. Only counts leave a task.

Null and empty texts have 0 bytes and 0 tokens. Texts of any length are counted whole: a pre-token of n bytes costs
O(n log n). Repeated rows are counted again, rows with null ids stay, extra columns are ignored, an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, picked, remembered

SPACE = r"\t-\r \x85\xa0  -     　"
#: A pre-token: contraction, word, number or sign run with at most one leading space, or white space.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A blank inside a longer run of white space: there pieces between blanks can't be counted one by one.
RUN = re.compile(r"\s \s|\s \Z")
#: Bytes of a worker's memory of counted pieces, and of an entry besides its letters; it is emptied when full.
MEMORY, ENTRY = 96 << 20, 150
PLACES = 1 << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return [table[b] for b in range(256)]


class BytePairCounter:
    """Counts tokens as the vocabulary file (tokenizers' JSON, byte-level BPE) gives them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told["pre_tokenizer"]
        if told["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or told["normalizer"] or told["model"].get("ignore_merges"):
            raise ValueError("a byte-level BPE without normalizer, prefix space and ignore_merges is needed")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"])
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.letters = byte_letters()
        special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.memo: dict[str, int] = {}
        self.held = 0

    def pretoken(self, text: str) -> int:
        """Initial symbols minus merges of one pre-token."""
        sym: list = [self.letters[b] for b in text.encode()]
        n, ranks = len(sym), self.ranks
        heap = [r * PLACES + i for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = divmod(heappop(heap), PLACES)
            if (j := after[i]) >= n or sym[i] is None or ranks.get((sym[i], sym[j])) != r:
                continue  # the pair has changed since it was pushed
            sym[i] += sym[j]
            sym[j] = None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (q := ranks.get((sym[i], sym[k]))) is not None:
                    heappush(heap, q * PLACES + i)
            if (k := before[i]) >= 0 and (q := ranks.get((sym[k], sym[i]))) is not None:
                heappush(heap, q * PLACES + k)
        return n - merges

    def whole(self, text: str) -> int:
        return sum(map(self.pretoken, PRETOKEN.findall(text)))

    def __getitem__(self, piece: str) -> int:
        """Tokens of a blank and the piece after it."""
        n = self.memo.get(piece)
        if n is None:
            n = self.whole(" " + piece)
            if len(piece) < 64:
                self.held += ENTRY + 2 * len(piece)
                if self.held > MEMORY:
                    self.memo.clear()
                    self.held = 0
                self.memo[piece] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings. A pre-token starts at each blank that ends a run of white space,
        so what lies between blanks is counted by itself, and only once for each distinct piece."""
        if RUN.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        known = [*map(self.memo.get, rest)]
        if None not in known:
            return self.whole(first) + sum(known)
        return self.whole(first) + sum(n if n is not None else self[p] for n, p in zip(known, rest))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text) if text else 0
        return len(self.special.findall(text)) + sum(self.plain(x) for x in self.special.split(text) if x)


def counter(path: str) -> BytePairCounter:
    """One counter a worker process, with its memory."""
    return remembered("token_counts", path, lambda: BytePairCounter(path))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. Narrow: no shuffle, one pass, no text leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        bpe = counter(vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [*map(bpe.count, texts)]
            yield {"doc_id": b.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return arrow_map(picked(docs, id_col, text_col), run, "n_bytes long, n_tokens long, over_limit boolean", ("doc_id",), "token_counts")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
