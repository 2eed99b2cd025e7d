"""Reading on in results files that grow.

A run hands in its responses by appending lines. The source below keeps, as the state of a streaming
query, how many bytes of each file have been read; a trigger reads what has been added since, up to
the last line that is ended. A line is read once, however often the query is stopped and started, and
a line that a crash or a slow writer has cut off waits for its end.
"""

import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from evalgrid import constants as K
from evalgrid import schemas
from evalgrid.functions import labels
from evalgrid.operators.assemble import assemble_trials_and_results_df
from evalgrid.sources.pieces import file_system, reaches

# Bytes that a task reads at most, and that are looked through at a time for the end of a line.
_SPLIT, _BLOCK = 1 << 27, 1 << 16
# Lines that are handed over at once.
_BATCH = 10_000


class _Range(InputPartition):
    """Lines that begin from ``start`` on and before ``end``; ``first`` is where a line is known to begin."""

    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.ending = options["path"], options.get("ending", K.RESULTS_ENDING)
        self.split = int(options.get("split", _SPLIT))
        self.ends: dict[str, tuple[int, int]] = {}  # size and end of the last whole line, of files seen

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        system, folder = file_system(self.folder)
        found = {}
        for file in system.get_file_info(FileSelector(folder, recursive=True, allow_not_found=True)):
            if file.type != FileType.File or not file.path.endswith(self.ending):
                continue
            size, end = self.ends.get(file.path, (-1, 0))
            if size != file.size:
                with system.open_input_file(file.path) as raw:
                    end = _last_line_end(raw, file.size)
                self.ends[file.path] = file.size, end
            found[file.path] = end
        return {"files": found}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        ranges = []
        for path, stop in sorted(end["files"].items()):
            first = start["files"].get(path, 0)
            if stop < first:
                raise ValueError(f"{path} is shorter than what has been read of it, so it is another file")
            ranges += [_Range(path, first, at, min(at + self.split, stop)) for at in range(first, stop, self.split)]
        return ranges

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.folder)
        with io.BufferedReader(system.open_input_file(partition.path), _BLOCK) as raw:
            at, lines = partition.start, []
            if at > partition.first:
                # a line that begins before is another range's
                raw.seek(at - 1)
                at += len(raw.readline()) - 1
            else:
                raw.seek(at)
            while at < partition.end:
                line = raw.readline()
                at += len(line)
                if line.strip():
                    lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                if len(lines) >= _BATCH:
                    yield _batch(partition.path, lines)
                    lines = []
            if lines:
                yield _batch(partition.path, lines)


def _batch(path: str, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(lines)], ["path", "value"])


def _last_line_end(raw: pa.NativeFile, size: int) -> int:
    """The number of bytes up to the last line feed, 0 if there is none."""
    while size > 0:
        at = max(0, size - _BLOCK)
        raw.seek(at)
        found = raw.read(size - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        size = at
    return 0


class GrowingLines(DataSource):
    """Lines of the files below the folder ``path`` whose names end in ``ending``, with their path.

    ``split`` bytes of a file are one task. A file that has become shorter fails the query. The state
    has a number for each file.
    """

    @classmethod
    def name(cls) -> str:
        return "evalgrid_growing_lines"

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options)


def read_growing_results(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Responses with labels of every results file below a folder, those added later included.

    A malformed line that is ended fails the query. Files have to be plain JSON-Lines.
    """
    if not reaches(folder):
        raise ValueError(f"tasks cannot read on in the files of {folder}")
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format(GrowingLines.name()).options(path=folder, **options).load()
    parsed = F.from_json("value", schemas.RESULTS, {"mode": "FAILFAST"})
    # labels are read off encoded paths, which these are not
    encoded = F.replace("path", F.lit("%"), F.lit("%25")).alias("path")
    rows = lines.select(parsed.alias("r"), encoded).select("r.*", "path")
    return labels.with_labels(rows, "path").drop("path")


def ingest_growing_results(
    spark: SparkSession, trials: DataFrame, folder: str, table: str, checkpoint: str, **options
) -> StreamingQuery:
    """Append the assembled rows of all lines added since the last call to the Parquet ``table``, then stop.

    The file sink commits each batch once, and the state of ``checkpoint`` tells what has been read,
    so a call that fails is repeated without a row lost or doubled.
    """
    assembled = assemble_trials_and_results_df(trials, read_growing_results(spark, folder, **options))
    return (
        assembled.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
