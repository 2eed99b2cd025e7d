"""Best-two-fit packing of tokenised documents into sequences of one length."""

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from evalgrid.llm.common import small_batches, strings, table

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 2048
#: id after each document
END = 0
#: pieces that are packed together at most; more are packed in turns
PACKED_AT_ONCE = 1_000_000
#: stretches of text whose ids a worker keeps before it starts anew
_CACHE_ROWS = 200_000

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_PLAIN = re.compile("[!-~\u00a1-\u024f]+")


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: its own if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class _Ids:
    """Ids of stretches between spaces, as little-endian bytes; a worker keeps them for a task.

    This tokenizer's splitting never joins a space to what stands before it, so a text may be cut
    before any space that follows something else, and the ids of the cuts joined. Stretches of plain
    Latin letters and signs that are new to a worker get their ids from tiktoken, which merges the
    same file's vocabulary several times as fast; all others, and the tests, from tokenizers.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        of_letter = {c: bytes([b]) for b, c in enumerate(_byte_letters())}
        added = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {
            b"".join(map(of_letter.__getitem__, x)): i for x, i in self.tokenizer.get_vocab(False).items() if x not in added
        }
        self.added = tuple(added)
        self.merges = Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = np.uint32(self.merges.encode_ordinary("\n")[0])
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}  # without the space they begin with

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _learn_rest(self, stretches: set[str]) -> None:
        # a line end is one id wherever it stands before a space, so it tells apart what is encoded at once
        plain = list(filter(_PLAIN.fullmatch, stretches))
        text = " " + "\n ".join(plain)
        if any(a in text for a in self.added):
            plain = [x for x in plain if not any(a in x for a in self.added)]
            text = " " + "\n ".join(plain)
        if len(plain) < len(stretches):
            for x in stretches.difference(plain):
                self.rest[x] = self._encode(" " + x)
        if not plain:
            return
        ids = self.merges.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        breaks = np.flatnonzero(ids == self.line_end) * 4
        ends = [*breaks.tolist(), 4 * len(ids)]
        data, starts = ids.tobytes(), [0, *(breaks + 4).tolist()]
        self.rest.update(zip(plain, map(data.__getitem__, map(slice, starts, ends)), strict=True))

    def forget(self) -> None:
        self.first.clear()
        self.rest.clear()

    def of(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts that are given by their stretches."""
        if len(self.first) + len(self.rest) > _CACHE_ROWS:
            self.forget()
        unknown = set().union(*texts).difference(self.rest)
        if unknown:
            self._learn_rest(unknown)
        known, out = self.rest.__getitem__, []
        for t in texts:
            first = self.first.get(t[0])
            if first is None:
                first = self.first[t[0]] = self._encode(t[0])
            out.append(first + b"".join(map(known, t[1:])))
        return out


@cache
def _ids_of(path: str) -> _Ids:
    return _Ids(path)


def _stretches(text: str) -> list[str]:
    if not _SPACE_AFTER_SPACE.search(text):
        return text.split(" ")
    cut = _BEFORE_SPACE.split(text)
    return cut[:1] + [x[1:] for x in cut[1:]]


def tokenised_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every row.

    The ids of a text and then ``end``; more than ``length`` are cut into pieces of that length, of
    which the first may be shorter.
    """
    small_batches(docs.sparkSession)
    closing = array("I", [end]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids_of(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            texts = strings(batch.column("text"))
            owner, piece, start, size, crc = [], [], [], [], []
            done = 0
            while done < len(texts):
                now, held = [], 0
                while done + len(now) < len(texts) and held < 50_000:
                    now.append(_stretches(texts[done + len(now)]))
                    held += len(now[-1])
                for i, found in enumerate(ids.of(now), done):
                    data = memoryview(found + closing)
                    n = len(data) // 4
                    at, to = 0, (n - 1) % length + 1
                    while at < n:
                        owner.append(i)
                        piece.append((at + length - 1) // length)
                        start.append(at)
                        size.append(to - at)
                        crc.append(zlib.crc32(data[4 * at:4 * to]))
                        at, to = to, to + length
                done += len(now)
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, size, crc)]
            yield pa.RecordBatch.from_arrays(columns, names)
        # the worker lives on and may have other work next
        ids.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, none over ``room``, and the number of bins.

    A bin is filled greedily with the largest piece that still fits. If a gap is left, the bin's
    smallest piece gives way to the two unpacked pieces that fill the room it leaves best, if they
    fill more of it than the piece did.
    """
    order = np.argsort(lengths, kind="stable").tolist()
    left = np.bincount(lengths, minlength=room + 1).tolist()
    top = np.cumsum(left).tolist()  # the unpacked pieces of a length lie below its top
    lower = list(range(room + 1))  # the largest length that has pieces, by path halving

    def fits(gap: int) -> int:
        while gap > 0 and not left[gap]:
            if lower[gap] == gap:
                lower[gap] = gap - 1
            lower[gap] = lower[lower[gap]]
            gap = lower[gap]
        return max(gap, 0)

    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while size := fits(room):
        chosen, gap = [], room
        while size:
            chosen.append(size)
            left[size] -= 1
            gap -= size
            size = fits(gap)
        if gap and len(chosen) > 1:
            smallest = chosen[-1]
            space, best, pair = gap + smallest, smallest, None
            large = fits(space - 1)
            while large and 2 * large > best:
                small = fits(min(large - (left[large] < 2), space - large))
                if small and large + small > best:
                    best, pair = large + small, (large, small)
                    if best == space:
                        break
                large = fits(large - 1)
            if pair:
                left[smallest] += 1
                lower[smallest] = smallest
                chosen[-1:] = pair
                for x in pair:
                    left[x] -= 1
        at = 0
        for size in chosen:
            top[size] -= 1
            piece = order[top[size]]
            bins[piece], offsets[piece] = number, at
            at += size
        number += 1
    return bins, offsets, number


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Each piece of ``tokenised_pieces`` with its sequence_id and offset in a sequence of ``length`` tokens.

    Only numbers are shuffled: the pieces' lengths are gathered into partitions of the size Spark is
    told to aim at, and each is packed by ``best_two_fit``, so that at most one badly filled sequence
    remains for each. Sequence numbers are unique, not dense.

    NULL and empty texts are one piece of one token. Rows with NULL or repeated ids are packed as
    rows of their own. Columns other than doc_id and text are ignored. No documents, no pieces.
    """
    pieces = tokenised_pieces(docs, path, length, end).hint("rebalance")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held, rows = [], 0

        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            whole = pa.Table.from_batches(held).combine_chunks()
            bins, offsets, number = best_two_fit(whole.column("length").to_numpy(), length)
            whole = whole.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
            first += number
            yield from whole.to_batches(max_chunksize=20_000)

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= PACKED_AT_ONCE:
                yield from packed(held)
                held, rows = [], 0
        if rows:
            yield from packed(held)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(pack, f"{kinds}, sequence_id long, offset long")


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
