"""Archives and documents that are larger than a cell of a table: read by their places, not as a whole.

A zip archive's own directory becomes a table with a row for each member, which Spark deals out to
tasks; each reads its members where they lie in the file. A JSON document that is a list of records
is streamed by one task and cut into records, an object of columns into parts of its columns. Tasks
reach the files through Arrow's file systems; for a file system that only Spark reads, see ``reaches``.
"""

import bz2
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyarrow import ArrowException, BufferedInputStream, CompressedInputStream, NativeFile, RecordBatch
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Texts are handed over in batches of about this many characters or rows.
_BATCH_CHARS = 8_000_000
_BATCH_ROWS = 20_000
_CHUNK = 1 << 20
# Characters from which a part of a column is closed.
_PART_CHARS = 1 << 16
# Unpacked bytes that a task reads of archives.
_TASK = 1 << 27

PATH, ROW, WHOLE = "__path", "__row", "__whole"


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    local = re.match(r"file:/*(/.*)", path)
    return (LocalFileSystem(), local[1]) if local else FileSystem.from_uri(path)


def reaches(path: str) -> bool:
    """Whether Arrow has a file system for the path, as tasks need it."""
    try:
        file_system(path)
    except (ArrowException, OSError):
        return False
    return True


def _opened(path: str) -> NativeFile:
    system, inside = file_system(path)
    return system.open_input_file(inside)


def files_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, length`` of the files; their contents are not read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length")


class _Batches:
    """Rows gathered into frames of bounded size."""

    def __init__(self, names: Sequence[str]):
        self.names, self.rows, self.chars = list(names), [], 0

    def add(self, *row) -> Iterator[pd.DataFrame]:
        self.rows.append(row)
        self.chars += len(row[-1])
        if self.chars >= _BATCH_CHARS or len(self.rows) >= _BATCH_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.rows:
            yield pd.DataFrame(self.rows, columns=self.names)
        self.rows, self.chars = [], 0


def zip_members(files: DataFrame) -> DataFrame:
    """``path, member, place, packed, size`` of each member of the zip archives in ``path``; folders are left out."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _opened(path) as raw, zipfile.ZipFile(raw) as archive:
                    found = [x for x in archive.infolist() if not x.is_dir()]
                yield pd.DataFrame({
                    "path": path, "member": [x.filename for x in found], "place": [x.header_offset for x in found],
                    "packed": [x.compress_size for x in found], "size": [x.file_size for x in found],
                })

    return files.select("path").mapInPandas(listed, "path string, member string, place long, packed long, size long")


def member_texts(members: DataFrame, whole: bool = False) -> DataFrame:
    """``__path, place, __row, value``: lines of the members, or with ``whole`` each as one text.

    Members are dealt out by their place, those of one archive to many tasks; a task opens an
    archive once for the members it has of it and reads only these. Lines are streamed, and numbered
    within their member; blank ones are left out.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Batches([PATH, "place", ROW, "value"])
        for batch in batches:
            for path, mine in batch.groupby("path", sort=False):
                with _opened(path) as raw, zipfile.ZipFile(raw) as archive:
                    at = {x.header_offset: x for x in archive.infolist()}
                    for place in mine["place"]:
                        with archive.open(at[place]) as packed:
                            text = io.TextIOWrapper(packed, encoding="utf-8", newline="\n")
                            pieces = [text.read()] if whole else (x for x in text if x.strip())
                            for i, piece in enumerate(pieces):
                                yield from out.add(path, place, i, piece if whole else piece.rstrip("\r\n"))
        yield from out.rest()

    # a member is a short row however long it is, so the number of tasks follows the bytes to unpack
    sums = members.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    cores = members.sparkSession.sparkContext.defaultParallelism
    dealt = members.repartition(max(1, min(sums.n, max(cores, sums.bytes // _TASK))), "path", "place")
    return dealt.select("path", "place").mapInPandas(read, f"{PATH} string, place long, {ROW} long, value string")


def numbered_through(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Lines of ``member_texts`` with ``__row`` counted through all members of their archive, in the order of the file."""
    if members.groupBy("path").count().where("count > 1").limit(1).count():
        in_order = Window.partitionBy(PATH).orderBy("place")
        before = F.sum("n").over(in_order) - F.col("n")
        firsts = texts.groupBy(PATH, "place").agg(F.count(F.lit(1)).alias("n")).select(PATH, "place", before.alias("before"))
        texts = texts.join(firsts, [PATH, "place"]).withColumn(ROW, F.col(ROW) + F.col("before"))
    return texts.select(PATH, ROW, "value")


def archives_in(folder: str, lines: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas``: each task writes its lines to one archive of JSON-Lines, ``lines`` to a member, and returns its path."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = f"{folder}/{TaskContext.get().partitionId():05d}.jsonl.zip"
        system, inside = file_system(path)
        system.create_dir(inside.rpartition("/")[0])
        member = 0
        with system.open_output_stream(inside) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for at in range(0, len(batch), lines):
                    archive.writestr(f"{member:06d}.jsonl", "".join(f"{x}\n" for x in batch["value"][at:at + lines]))
                    member += 1
        yield pd.DataFrame({"path": [path]})

    return write


def bzip2_in(folder: str) -> Callable[[Iterator[RecordBatch]], Iterator[RecordBatch]]:
    """For ``mapInArrow``: each task packs its lines into one file of JSON-Lines in the folder and returns its path.

    The C library took 30 % less time than Spark's codec for lines that are much alike. A file gets its name
    when it is whole, so a task that runs again leaves no other; without lines there is none.
    """

    def write(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
        task = TaskContext.get()
        system, inside = file_system(folder)
        begun, path = f"{inside}/_begun-{task.taskAttemptId()}", f"{inside}/part-{task.partitionId():05d}.json.bz2"
        system.create_dir(inside)
        packer, some = bz2.BZ2Compressor(), False
        with system.open_output_stream(begun, compression=None) as out:
            for batch in batches:
                some = some or batch.num_rows > 0
                out.write(packer.compress("".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode()))
            out.write(packer.flush())
        if some:
            system.move(begun, path)
            yield RecordBatch.from_pydict({"path": [path]})
        else:
            system.delete_file(begun)

    return write


class RecordSplitter:
    """Cuts the text of a list of records, given in pieces, into the texts of its records.

    Only strings, their escapes and the depth of brackets are followed, so a record may be malformed
    inside; ``ended`` tells whether the list was closed, and ``odd`` whether anything but white space
    and one list was found. No more than one record is held.
    """

    _SIGNS = re.compile(r'["\\\[\]{},]')
    _IN_STRING = re.compile(r'["\\]')

    def __init__(self) -> None:
        self.depth, self.in_string, self.escaped = 0, False, False
        self.held: list[str] = []
        self.begun = self.ended = self.odd = False

    def _taken(self, last: str) -> Iterator[str]:
        self.held.append(last)
        text = "".join(self.held).strip()
        self.held = []
        if text:
            yield text

    def feed(self, piece: str) -> Iterator[str]:
        at, start = 0, 0
        if not self.begun:
            text = piece.lstrip("\ufeff \t\r\n")
            if not text:
                return
            self.begun, self.odd = True, text[0] != "["
            at = start = len(piece) - len(text) + 1
            self.depth = 1
        while not self.odd and not self.ended:
            if self.escaped:
                if at >= len(piece):
                    break
                self.escaped, at = False, at + 1
            found = (self._IN_STRING if self.in_string else self._SIGNS).search(piece, at)
            if not found:
                break
            sign, at = found.group(), found.end()
            if sign == "\\":
                self.escaped = self.in_string
            elif sign == '"':
                self.in_string = not self.in_string
            elif sign in "[{":
                self.depth += 1
            elif sign in "]}":
                self.depth -= 1
                if not self.depth:
                    self.ended = True
                    yield from self._taken(piece[start:at - 1])
                    start = at
            elif self.depth == 1:
                yield from self._taken(piece[start:at - 1])
                start = at
        if self.ended:
            self.odd = self.odd or bool(piece[start:].strip())
        else:
            self.held.append(piece[start:])


class ColumnSplitter:
    """Cuts the text of an object of columns, given in pieces, into objects that hold a part of one column each.

    ``feed`` gives them with the place of their first cell in the column. Strings in either quotes, their
    escapes and the depth of brackets are followed. The parts hold the whole text up to the end of the object, so what is
    malformed in it is malformed in a part; ``odd`` tells what shows in none, as an empty place beside a comma or a
    column that is a list, and ``ended`` whether the object was closed. No more than one part, or one longer cell, is held.
    """

    _SIGNS = re.compile(r"""["'\[\]{},]""")
    _IN_STRING = {'"': re.compile(r'["\\]'), "'": re.compile(r"['\\]")}
    _BLANK = " \t\r\n"

    def __init__(self, most: int) -> None:
        self.most = most
        self.depth, self.quote, self.escaped = 0, "", False
        self.held: list[str] = []
        self.chars = 0
        # the text up to a column's first cell, the place of the next cell and of the first one held
        self.head, self.cell, self.first = "", 0, 0
        # whether the column that the text follows is closed, and whether there was a comma between columns
        self.closed = self.several = False
        self.begun = self.ended = self.odd = False

    def _taken(self, last: str) -> str:
        self.held.append(last)
        text = "".join(self.held)
        self.held, self.chars = [], 0
        return text

    def _part(self, last: str, at_end: bool) -> Iterator[tuple[int, str]]:
        cells = self._taken(last)
        self.odd = not cells.strip(self._BLANK) and not (at_end and self.cell == 0)
        yield self.first, f"{{{self.head}{cells}}}}}"
        self.first = self.cell

    def _between(self, last: str, at_end: bool) -> Iterator[tuple[int, str]]:
        """What stands at a comma between columns, or before the end, and is no part of a column."""
        text = self._taken(last)
        blank = not text.strip(self._BLANK)
        if self.closed:
            self.odd = not blank
        elif blank:
            self.odd = self.several or not at_end
        else:
            yield 0, f"{{{text}}}"
        self.closed, self.several = False, True

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        at, start = 0, 0
        if not self.begun:
            text = piece.lstrip(" ")
            if not text:
                return
            self.begun, self.odd = True, text[0] != "{"
            at = start = len(piece) - len(text) + 1
            self.depth = 1
        while not self.odd and not self.ended:
            if self.escaped:
                if at >= len(piece):
                    break
                self.escaped, at = False, at + 1
            found = (self._IN_STRING[self.quote] if self.quote else self._SIGNS).search(piece, at)
            if not found:
                break
            sign, at = found.group(), found.end()
            if sign == "\\":
                self.escaped = True
            elif sign in "\"'":
                self.quote = "" if self.quote else sign
            elif sign in "[{":
                self.depth += 1
                if self.depth == 2:
                    self.odd = self.closed or sign == "["
                    self.head, self.cell, self.first = self._taken(piece[start:at]), 0, 0
                    start = at
            elif sign == ",":
                if self.depth == 1:
                    yield from self._between(piece[start:at - 1], at_end=False)
                    start = at
                elif self.depth == 2:
                    if self.chars + at - start > self.most:
                        self.cell += 1
                        yield from self._part(piece[start:at - 1], at_end=False)
                        start = at
                    else:
                        self.cell += 1
            else:
                self.depth -= 1
                if self.depth < 2:
                    self.odd = sign == "]"
                    if self.odd:
                        break
                    if self.depth:
                        yield from self._part(piece[start:at - 1], at_end=True)
                        self.closed = True
                    else:
                        yield from self._between(piece[start:at - 1], at_end=True)
                        self.ended = True
                    start = at
        if not self.ended:
            self.held.append(piece[start:])
            self.chars += len(piece) - start


def _streamed(path: str) -> NativeFile:
    """The bytes of a document, plain, gzip or bzip2."""
    raw = BufferedInputStream(_opened(path), _CHUNK)
    kind = {".gz": "gzip", ".bz2": "bz2"}.get(path[path.rfind("."):])
    return CompressedInputStream(raw, kind) if kind else raw


def list_records(files: DataFrame) -> DataFrame:
    """``__path, __row, value, __whole``: the records of documents that are lists, as texts, by their position.

    One task streams a document, plain, gzip or bzip2, of any length. ``__whole`` is false for a last row that
    stands for the end of a document that breaks off, or for one that is no list; its text is empty.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Batches([PATH, ROW, WHOLE, "value"])
        for batch in batches:
            for path in batch["path"]:
                splitter, row = RecordSplitter(), 0
                with _streamed(path) as raw:
                    text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="")
                    while piece := text.read(_CHUNK):
                        for record in splitter.feed(piece):
                            yield from out.add(path, row, True, record)
                            row += 1
                        if splitter.odd:
                            break
                if splitter.odd or splitter.begun and not splitter.ended:
                    yield from out.add(path, row, False, "")
        yield from out.rest()

    return files.select("path").mapInPandas(read, f"{PATH} string, {ROW} long, {WHOLE} boolean, value string")


def column_parts(files: DataFrame) -> DataFrame:
    """``__path, __row, value, __whole``: documents that are objects of columns, as smaller ones that hold a part of one column.

    ``__row`` is the place of a part's first cell in its column. One task streams a document, plain, gzip or bzip2, of any
    length. Its last row is an object without columns; ``__whole`` is false there if the document breaks off or
    is malformed between the parts. Of other documents no more than the beginning is read, and they have no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Batches([PATH, ROW, WHOLE, "value"])
        for batch in batches:
            for path in batch["path"]:
                splitter = ColumnSplitter(_PART_CHARS)
                with _streamed(path) as raw:
                    text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="")
                    start = text.read(1)
                    while start == " ":
                        start = text.read(1)
                    if start != "{":
                        continue
                    while start:
                        for first, part in splitter.feed(start):
                            yield from out.add(path, first, True, part)
                        if splitter.odd or splitter.ended:
                            break
                        start = text.read(_CHUNK)
                yield from out.add(path, 0, splitter.ended and not splitter.odd, "{}")
        yield from out.rest()

    return files.select("path").mapInPandas(read, f"{PATH} string, {ROW} long, {WHOLE} boolean, value string")
