"""Benchmark decontamination: test phrases searched in an FM-index of each shard of documents."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import blocks, byte_set, lower_table, run_hashes, runs, small_batches, table, utf8
from evalgrid.llm.fm_index import FMIndex
from evalgrid.session import materialise

WINDOW = 10
#: characters of benchmark text that are broadcast together; a larger benchmark is searched in turns
BENCHMARK_CHARS = 32_000_000
#: bytes of documents that share an index
SHARD = 8 << 20

_WORD = byte_set(range(48, 58), range(97, 123), range(128, 256))
_LOWER = lower_table()
_NO_SPANS = np.zeros((0, 4), np.int64)


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, hash of the words and words per row."""
    data = _LOWER[data]
    begin, end, per_row = runs(_WORD[data], starts)
    return begin, end, run_hashes(data, begin, end), per_row


@dataclass
class Phrases:
    """The windows of benchmark items over the numbers of their words."""

    vocabulary: np.ndarray  # sorted hashes; a word's number is its place plus 1
    hint: np.ndarray  # flags by the hash's last 20 bits: no flag, no word
    windows: np.ndarray  # distinct, aligned to the right
    lengths: np.ndarray
    items: list[np.ndarray]  # of each window, places in ``ids``
    ids: list[str]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.hint[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes[maybe]
        out[maybe[hit]] = at[hit] + 1
        return out


def phrases_of(ids: list[str], texts: list[str | None], window: int = WINDOW) -> Phrases | None:
    """None if no item has a word."""
    data, starts = utf8(pa.array(texts, pa.string()))
    _, _, hashes, per_row = _words(data, starts)
    if not len(hashes):
        return None
    vocabulary = np.unique(hashes)
    hint = np.zeros(1 << 20, bool)
    hint[(vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
    numbers = np.searchsorted(vocabulary, hashes) + 1
    names = sorted(set(ids))
    place = {x: i for i, x in enumerate(names)}
    found: dict[bytes, set[int]] = {}
    at = 0
    for item, n in zip(ids, per_row.tolist(), strict=True):
        for i in range(at, at + max(1, n - window + 1) if n else at):
            row = np.zeros(window, np.int64)
            own = numbers[i:min(i + window, at + n)]
            row[window - len(own):] = own
            found.setdefault(row.tobytes(), set()).add(place[item])
        at += n
    windows = np.frombuffer(b"".join(found), np.int64).reshape(len(found), window)
    return Phrases(
        vocabulary, hint, windows, (windows > 0).sum(1), [np.array(sorted(x)) for x in found.values()], names
    )


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (row, first, past the last, ...) in order, those of a row that touch made one."""
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    if not len(spans):
        return spans
    out = [spans[0].copy()]
    for s in spans[1:]:
        if s[0] == out[-1][0] and s[1] <= out[-1][2]:
            out[-1][2] = max(out[-1][2], s[2])
        else:
            out.append(s.copy())
    return np.array(out)


def search_shard(numbers: np.ndarray, per_row: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word is hit, distinct (row, item) pairs) of the rows whose words have these numbers.

    The index holds each run of benchmark words that is long enough for the shortest phrase: no
    phrase can lie elsewhere.
    """
    hit = np.zeros(len(numbers), bool)
    starts = np.concatenate([[0], np.cumsum(per_row)])
    begin, end, _ = runs(numbers > 0, starts)
    long = end - begin >= phrases.lengths.min()
    begin, end = begin[long], end[long]
    if not len(begin):
        return hit, np.zeros((0, 2), np.int64)
    sizes = end - begin
    # where each run stands in the indexed sequence; a zero follows it
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    origin = np.arange(at[-1]) + np.repeat(begin - at[:-1], sizes + 1)
    symbols = np.zeros(at[-1], np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    symbols[inside] = numbers[origin[inside]]
    index = FMIndex(symbols, len(phrases.vocabulary))
    low, high = index.ranges(phrases.windows, phrases.lengths)
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[found], times)
    word = origin[index.locate(rows)]
    phrase = np.repeat(found, times)
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + phrases.lengths[phrase], -1)
    hit = np.cumsum(change)[:-1] > 0
    row = np.searchsorted(starts, word, "right") - 1
    pairs = np.unique(np.stack([row, phrase], 1), axis=0)
    items = [np.stack([np.full(len(phrases.items[p]), r), phrases.items[p]], 1) for r, p in pairs]
    return hit, np.unique(np.concatenate(items), axis=0) if items else np.zeros((0, 2), np.int64)


def _searcher(shared):
    """Adds n_words and the spans and items of one part of the benchmark to rows that carry earlier ones."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases | None = shared.value
        for batch in batches:
            texts = batch.column("text")
            for first, past, data, starts in blocks(texts, SHARD, 1 << 30):
                n = past - first
                parts, row = [], 0
                for a, b, piece, piece_starts in blocks(texts[first:past]):
                    begin, end, hashes, per_row = _words(piece, piece_starts)
                    numbers = phrases.numbers(hashes) if phrases else np.zeros(len(hashes), np.int64)
                    own = np.repeat(piece_starts[:-1], per_row)
                    parts.append((begin - own, end - own, numbers, per_row))
                begin, end, numbers, per_row = (np.concatenate(x) for x in zip(*parts, strict=True))
                word_starts = np.concatenate([[0], np.cumsum(per_row)])
                spans, pairs = _NO_SPANS, np.zeros((0, 2), np.int64)
                if phrases:
                    hit, pairs = search_shard(numbers, per_row, phrases)
                    a, b, count = runs(hit, word_starts)
                    owner = np.repeat(np.arange(n), count)
                    spans = np.stack([owner, a - word_starts[owner], b - word_starts[owner]], 1)
                rows = batch.slice(first, n)
                earlier = rows.column("spans").to_pylist() if batch.schema.get_field_index("spans") >= 0 else None
                if earlier is not None and any(earlier):
                    old = [(i, s["first"], s["past"]) for i, x in enumerate(earlier) for s in x]
                    spans = merged(np.concatenate([spans[:, :3], np.array(old, np.int64).reshape(-1, 3)]))
                cells = [[] for _ in range(n)]
                for r, f, p in spans.tolist():
                    w = word_starts[r]
                    cells[r].append({"first": f, "past": p, "begin": int(begin[w + f]), "end": int(end[w + p - 1])})
                items = rows.column("items").to_pylist() if earlier is not None else [[] for _ in range(n)]
                for r, k in pairs.tolist():
                    items[r].append(phrases.ids[k])
                base = rows.select([c for c in rows.schema.names if c not in ("n_words", "spans", "items")])
                yield pa.RecordBatch.from_arrays(
                    [*base.columns, pa.array(per_row.astype(np.int64)), pa.array(cells, _SPANS), pa.array(items, pa.list_(pa.string()))],
                    [*base.schema.names, "n_words", "spans", "items"],
                )

    return search


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words long, spans array<struct<first:long,past:long,begin:long,end:long>>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_chars: int = BENCHMARK_CHARS) -> DataFrame:
    """Every row of ``docs`` (all columns) with n_words, spans and items.

    ``spans`` are the stretches of words that stand in an occurrence of a window of a benchmark item,
    merged where they touch: word numbers ``first`` to ``past`` and UTF-8 bytes ``begin`` to ``end``.
    ``items`` are the ids, as text, of the items that have such windows. A window is ``window`` words
    of an item in a row, or a shorter item as a whole.

    Documents are not shuffled. Each task indexes its rows in shards of about ``SHARD`` bytes. The
    benchmark is broadcast in parts of about ``part_chars`` characters, all of which each shard is searched
    for; a hash of the id deals the items out to the parts. Rows are written out between parts, so that a
    task holds one part only.

    NULL texts have no words. Items that are NULL or have no word have no windows; items of one id are
    one item, a NULL id is written as empty text. Rows of repeated ids are searched one by one.
    Columns of ``docs`` named n_words, spans or items are replaced. An empty benchmark hits nothing.
    """
    small_batches(docs.sparkSession)
    clashing = [c for c in docs.columns if c in ("n_words", "spans", "items")]
    found = docs.drop(*clashing)
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // part_chars))
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    dealt = benchmark.select(item.alias("item"), "text", F.pmod(F.xxhash64(item), F.lit(parts)).alias("part"))
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).select("item", "text").toArrow()
        phrases = phrases_of(rows.column("item").to_pylist(), rows.column("text").to_pylist(), window)
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        found = found.mapInArrow(_searcher(shared), f"{base}, {_FOUND}")
        if part < parts - 1:
            found = materialise(found, "searched")
            shared.unpersist()
    return found


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of rows that ``find_contamination`` gave."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_spans(found: DataFrame) -> DataFrame:
    """The rows with their spans cut out of ``text``, without the columns that the search added."""
    names = [c for c in found.columns if c not in ("n_words", "spans", "items")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    raw, done, kept = texts[i].encode(), 0, []
                    for s in spans:
                        kept.append(raw[done:s["begin"]])
                        done = s["end"]
                    texts[i] = b"".join([*kept, raw[done:]]).decode()
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(names).schema))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows with all columns, ``text`` without the spans that ``find_contamination`` finds.

    ``n_chars``, where there is one that holds integers, is the length of the text that is left.
    """
    aside = {c: f"{c} of the document" for c in ("n_words", "spans", "items") if c in docs.columns}
    cut = without_spans(find_contamination(docs.withColumnsRenamed(aside), benchmark, window))
    cut = cut.withColumnsRenamed({new: old for old, new in aside.items()})
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.typeName() in ("integer", "long"):
        length = F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", length)
    return cut


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(find_contamination(docs, table(spark, sf_dir, "benchmark")))


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[0-9a-z\\x{80}-\\x{10FFFF}]+')"
)
SQL = f"""
WITH item_words AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) t(i) WHERE len(w) > 0
), doc_words AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM doc_words, sizes, unnest(range(1, len(w) - n + 2)) t(i)
), hits AS (SELECT r, i, n, item FROM spots JOIN windows USING (win, n)),
hit_words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) t(k) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
