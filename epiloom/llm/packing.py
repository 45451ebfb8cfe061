"""Operator 5: best-fit packing with certified bin counts.

Documents become pieces of at most `capacity` tokens.  Pieces are dealt into
partitions, and each is packed best-fit decreasing.  Dual-feasible functions
bound from below how many sequences its pieces need; a partition that uses no
more is certified.  One with a gap gives up the pieces of its loosest
sequences: the partitions of a group exchange them, they are packed anew
together, and the new packing is kept where it saves a sequence.  Rounds go on,
the groups growing eightfold, until no gap is left or all partitions have met.
A partition gives up at most a `released` share of its pieces, so that no task
holds more pieces however many partitions exchange.

Defined results: null text counts as empty, a document of one token, the end
mark; a row is a document, so repeated rows are packed each; a null doc_id
stays null; extra columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, table, written

CAPACITY, END, PART_PIECES, GROUP, RELEASED = 2048, 0, 10_000, 8, 1 / 8
FAR = re.compile("[ɐ-\U0010ffff]")


class Tokens:
    """Ids of whole texts: the rank file's quick encoder, which has the library's ids but for characters newer than its Unicode.

    The library itself encodes texts with such characters, and those that the
    quick encoder gives up, as it does on white space of a million characters.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = Tokenizer.from_file(json_path)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._strange: re.Pattern | None = None

    def strange(self, text: str) -> bool:
        if text.isascii() or not FAR.search(text):
            return False
        if self._strange is None:
            self._strange = re.compile("[" + "".join(chr(c) for c in range(0x250, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Cn", "Cs")) + "]")
        return bool(self._strange.search(text))

    def ids(self, text: str) -> np.ndarray:
        if not self.strange(text):
            try:
                return self.quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:  # its pattern's stack has an end
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end mark, only longer ones cut; the first piece may be shorter."""
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def cut(batches):
        import pyarrow as pa

        tokens = None
        for batch in batches:
            tokens = tokens or Tokens(json_path, ranks_path)
            for part in batches_of(batch):
                rows, out = [], ([], [], [], [])
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(tokens.ids(text or ""), np.array([end], "<u4")).astype("<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        rows.append(row)
                        for column, value in zip(out, (i, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                            column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound of two families of dual-feasible functions: threshold (large pieces up, small ones down) and rounding."""
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    total, mass = np.cumsum(count), np.cumsum(count * x)
    a = np.arange(0, capacity // 2 + 1)  # threshold: pieces over capacity - a count as capacity, those under a as nothing
    big = total[-1] - total[capacity - a]
    middle = mass[capacity - a] - np.where(a > 0, mass[np.maximum(a - 1, 0)], 0)
    best = max(best, int((-(-(big * capacity + middle) // capacity)).max()))
    for k in range(1, 21):  # rounding: shares x = s / capacity with (k+1) x whole stay, others become floor((k+1) x) / k
        up = x * (k + 1)
        value = np.where(up % capacity == 0, k * x, (up // capacity) * capacity)  # times 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free tokens
    some = 0  # bit r: a bin has r free tokens
    made = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                some &= ~(1 << room)
        else:
            b, room, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            with_room[room - size].append(b)
            some |= 1 << (room - size)
    return bins, offsets


#: What a packing round returns; stay_used and stay_bound certify what is left of a partition once its loose pieces are gone.
SCHEMA = (
    "doc_id string, piece int, start long, length long, ids_crc32 long, round int, part long, sequence_id long, offset long, "
    "bins_used long, bins_bound long, stay_used long, stay_bound long, loose boolean"
)


def _packer(round_: int, capacity: int, released: float):
    def pack(key, pdf):
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        names = (np.int64(round_) << 58) + (np.int64(key[0]) << 26) + bins
        used = int(bins.max()) + 1
        if round_ and used >= pdf["sequence_id"].nunique():  # nothing saved: the packing stays as it was
            names, offsets = pdf["sequence_id"].to_numpy(), pdf["offset"].to_numpy()
            _, bins = np.unique(names, return_inverse=True)
            used = int(bins.max()) + 1
        loose, bound = np.zeros(len(lengths), bool), lower_bound(lengths, capacity)
        if used > bound:
            fill, held = np.bincount(bins, lengths, used), np.bincount(bins, minlength=used)
            order = np.lexsort((np.arange(used), fill))
            order = order[fill[order] < capacity]
            most = max(released * len(lengths), held[order[:2]].sum()) if len(order) else 0
            loose = np.isin(bins, order[np.cumsum(held[order]) <= most])
        stay_used, stay_bound = (len(np.unique(bins[~loose])), lower_bound(lengths[~loose], capacity)) if loose.any() else (used, bound)
        return pdf.assign(round=round_, part=key[0], sequence_id=names, offset=offsets, bins_used=used, bins_bound=bound, stay_used=stay_used, stay_bound=stay_bound, loose=loose)

    return pack


def packed(cut: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int | None = None, released: float = RELEASED) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32) with sequence_id, offset and the certificate: round, part, bins_used, bins_bound.

    Round and part name the pieces that were packed together last and came to stay:
    bins_used is the number of sequences that hold them, bins_bound the number that
    they need at least.  No sequence holds pieces of two such sets, so the sets'
    bins_used add up to all sequences.  rounds: None for as many as find partners.
    """
    # doc_id travels as text, as pandas reads whole numbers beside nulls as fractions
    cut = written(cut.withColumn("doc_id", F.col("doc_id").cast("string")))
    parts = max(1, -(-cut.count() // part_pieces))
    state = cut.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("sequence_id", "long"), ("offset", "long"))]
    state = written(state.select("*", *empty).groupBy("part").applyInPandas(_packer(0, capacity, released), SCHEMA))
    kept, r = None, 0
    while parts > 1 and (rounds is None or r < rounds):
        loose = state.filter("loose")
        if loose.isEmpty():
            break
        left = state.filter("NOT loose").withColumns({"bins_used": F.col("stay_used"), "bins_bound": F.col("stay_bound")})
        kept = left if kept is None else kept.unionByName(left)
        r, parts = r + 1, -(-parts // GROUP)
        loose = loose.withColumn("part", F.floor(F.col("part") / GROUP).cast("long"))
        # a group's pieces stay about as many: each of GROUP partitions gave up at most its share
        state = written(loose.groupBy("part").applyInPandas(_packer(r, capacity, released), SCHEMA))
    every = state if kept is None else kept.unionByName(state)
    return every.drop("loose", "stay_used", "stay_bound").withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed(pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "part", "bins_used", "bins_bound")
