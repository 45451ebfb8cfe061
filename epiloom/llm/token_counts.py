"""Operator 1: token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol a byte.  A heap holds the adjacent pairs
that some rule merges, by rank and then place; the pair of lowest rank is
popped, its symbols are joined in a linked list, and the pairs it makes with
its neighbours are pushed.  A piece's count is its first symbols minus its
merges; no identifiers are emitted.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null doc_id
stays null; repeated rows give repeated rows; an empty table gives an empty
table; other columns, whatever their names, are not read.  Very long pieces
take n log n steps and aren't remembered.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from .common import batches_of, encode, table

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"

# Character classes of the split pattern below U+0250.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = r"\t-\r \x85\xa0"
NEAR = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND = re.compile("[ɐ-\U0010ffff]")
#: Printable characters of the files' byte alphabet, by byte.
KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    rest = [b for b in range(256) if b not in set(KEPT)]
    return {chr(b): b for b in KEPT} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteMerges:
    """Merge rules by pairs of symbol numbers, and the pieces a text is split into before merging."""

    def __init__(self, path: str, remembered: int = 1 << 19):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        alphabet, model = byte_alphabet(), held["model"]
        number = {t: i for t, i in model["vocab"].items()}
        self.of_byte = [0] * 256
        for ch, b in alphabet.items():
            self.of_byte[b] = number[ch]
        self.rules: dict[int, tuple[int, int]] = {}
        for rank, rule in enumerate(model["merges"]):
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            self.rules[number[a] << 32 | number[b]] = (rank, number[a + b])
        self.specials = [x["content"] for x in held["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}
        self.remembered = remembered
        self._strange: re.Pattern | None = None
        self._far = None

    def merged_count(self, data: bytes) -> int:
        """Symbols left once no rule applies."""
        sym = [self.of_byte[b] for b in data]
        n = len(sym)
        if n < 2:
            return n
        rules, left, right = self.rules, list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rules.get(sym[i] << 32 | sym[i + 1]))]
        # entries are (rank, new symbol, place, left symbol, right symbol); the two last tell stale ones
        heap = [(rank, i, a, b, new) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            merges += 1
            sym[i], sym[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if r := rules.get(new << 32 | sym[k]):
                    heapq.heappush(heap, (r[0], i, new, sym[k], r[1]))
            if (h := left[i]) >= 0 and (r := rules.get(sym[h] << 32 | new)):
                heapq.heappush(heap, (r[0], h, sym[h], new, r[1]))
        return n - merges

    def pieces(self, text: str) -> list[str]:
        """The pieces of the split pattern, as the library's own pre-tokenizer cuts them."""
        if text.isascii() or not BEYOND.search(text):
            return NEAR.findall(text)
        if self._strange is None:
            import public_tokenizers
            import regex

            new = [c for c in range(0x250, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
            spans, start = [], None
            for c, after in zip(new, [*new[1:], None], strict=True):
                start = c if start is None else start
                if after != c + 1:
                    spans.append(f"{chr(start)}-{chr(c)}")
                    start = None
            self._strange, self._far = re.compile("[" + "".join(spans) + "]"), regex.compile(public_tokenizers.PATTERN)
        if self._strange.search(text):  # characters whose class depends on the version of Unicode: ask the library
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self._far.findall(text)

    def count(self, text: str) -> int:
        specials = 0
        parts = [text]
        for special in self.specials:
            if special in text:
                parts = [q for p in parts for q in p.split(special)]
                specials = len(parts) - 1
        known, total = self.known, specials
        for part in parts:
            for piece in self.pieces(part):
                c = known.get(piece)
                if c is None:
                    c = self.merged_count(encode(piece))
                    if len(piece) <= 48:
                        if len(known) >= self.remembered:
                            known.clear()
                        known[piece] = c
                total += c
        return total


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text)."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)

    def count(batches):
        import pyarrow as pa

        merges = None
        for batch in batches:
            merges = merges or ByteMerges(path)
            for part in batches_of(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = [merges.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(encode(t)) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
