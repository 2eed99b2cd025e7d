"""Personal data: identifiers by their form, and others by contexts that are learnt from those."""

import bisect
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import blocks, byte_set, lower_table, mix, run_hashes, runs, small_batches, strings, table
from evalgrid.session import materialise

KINDS = ("email", "ip", "card", "phone")

#: different instances that a pattern needs, and the share of its occurrences that hold one
SUPPORT, CONFIDENCE = 3, 0.5
#: score from which an instance is taken for an identifier
ACCEPTED = 0.8
#: rounds of scoring; the scores settle earlier as a rule
ROUNDS = 5
#: most bits of the filter of learnt contexts, which every task gets: 16 MB
_FILTER_BITS = 1 << 27

# Runs are possessive and start where a run starts, so that no text takes time by the square of its length.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_HOST = re.compile(r"[A-Za-z0-9-]++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?[\[({][Aa][Tt][\])}] ?")
_DOT_HOST = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\.|[\[({][Dd][Oo][Tt][\])}]) ?[A-Za-z0-9-]++)*+")
_LOCAL_PHONE = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])++")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2}[0-9A-Fa-f:]{0,31}[0-9A-Fa-f](?![0-9A-Fa-f:])")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_IN_TOKEN = byte_set(range(48, 58), range(65, 91), range(97, 123), range(128, 256))
_LOWER = lower_table()
_STEP = np.uint64(0x9E3779B97F4A7C15)

Span = tuple[int, int]


def _local_part(text: str, at: int, floor: int) -> int:
    """Where the run of characters of a local part begins that ends before ``at``."""
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def emails(text: str) -> list[Span]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = _local_part(text, at, end)
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", found.end() if found else at + 1)
    return out


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and passes_luhn(digits)


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each kind that their form alone gives, leftmost and without overlap in a kind."""
    out: list[list[Span]] = [emails(text), [], [], []]
    if _DIGIT.search(text):
        for kind, (pattern, passes) in enumerate(((_IP, _is_ip), (_CARD, _is_card), (_PHONE, _is_phone)), 1):
            out[kind] = [m.span() for m in pattern.finditer(text) if passes(m.group())]
    return out


def _alone(text: str, start: int, end: int) -> bool:
    """Whether a span is not a piece of a longer word."""
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def loose_spans(text: str, taken: list[Span]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what might be an identifier of unusual form; none overlaps a taken span.

    Addresses without a top domain or with "(at)" and "[dot]"; dotted numbers over 255 and version 6
    addresses; card numbers that fail the check digit or have 12 digits; phone numbers without "+".
    """
    starts = [s for s, _ in taken]
    reach = [0, *accumulate((e for _, e in taken), max)]  # how far the first so many taken spans reach

    def free(start: int, end: int) -> bool:
        return _alone(text, start, end) and reach[bisect.bisect_left(starts, end)] <= start

    at, end = text.find("@"), 0
    while at >= 0:
        start, host = _local_part(text, at, end), _HOST.match(text, at + 1)
        if start < at and host and free(start, host.end()):
            yield 0, start, host.end()
            end = host.end()
        at = text.find("@", at + 1)
    end = 0
    for sign in _AT.finditer(text):
        start, host = _local_part(text, sign.start(), end), _DOT_HOST.match(text, sign.end())
        if start < sign.start() and host and free(start, host.end()):
            yield 0, start, host.end()
            end = host.end()
    if not _DIGIT.search(text):
        return
    for pattern, kind, passes in (
        (_IP, 1, lambda x: True), (_IP6, 1, lambda x: _DIGIT.search(x) is not None),
        (_CARD, 2, lambda x: 12 <= len(_digits(x)) <= 19), (_LOCAL_PHONE, 3, lambda x: 7 <= len(_digits(x)) <= 15),
    ):
        for m in pattern.finditer(text):
            if passes(m.group()) and free(*m.span()):
                yield kind, *m.span()


def instance(kind: int, text: str) -> str:
    """What an identifier is however it is written: the digits of a number, other things in lower case."""
    return _digits(text) if kind > 1 else text.lower().replace(" ", "")


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * _STEP + hashes[1:])


def _contexts(text: str, spans: list[Span]) -> list[list[tuple[int, int, str]]]:
    """(side, key, words) of the patterns each span stands in: one and two words before it, one and two behind it.

    Sides are 1 and 2 for the words before, 3 and 4 for those behind.
    """
    places = [m.span() for m in _TOKEN.finditer(text)]
    begins, ends = [b for b, _ in places], [e for _, e in places]
    out = []
    for start, end in spans:
        before = bisect.bisect_right(ends, start)  # words that end before the span
        behind = bisect.bisect_left(begins, end)
        found = []
        for side, words in ((1, places[max(0, before - 2):before]), (3, places[behind:behind + 2])):
            tokens = [text[b:e].encode().lower() for b, e in words]
            if not tokens:
                continue
            stops = np.cumsum([len(t) for t in tokens])
            hashes = run_hashes(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], stops[:-1]]), stops)
            near = -1 if side == 1 else 0
            found.append((side, int(hashes[near].view(np.int64)), tokens[near].decode()))
            if len(tokens) == 2:
                found.append((side + 1, int(_bigrams(hashes)[0].view(np.int64)), b" ".join(tokens).decode()))
        out.append(found)
    return out


_SPAN = "struct<kind:int,start:bigint,end:bigint>"
_MENTION = (
    "struct<kind:int,start:bigint,end:bigint,seed:boolean,instance:string,"
    "contexts:array<struct<side:int,gram:bigint,words:string>>>"
)


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, base, mentions`` of every row.

    ``base`` are the spans found by form; ``mentions`` those and the loose ones, with the patterns
    they stand in. ``row_key`` tells the id and the text of rows that have loose ones, NULL else.
    """
    small_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    context = pa.struct([("side", pa.int32()), ("gram", pa.int64()), ("words", pa.string())])
    mention = pa.struct([
        *span, pa.field("seed", pa.bool_()), pa.field("instance", pa.string()), pa.field("contexts", pa.list_(context))
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, mentions, keys = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                by_kind = base_spans(text)
                seeds = [(kind, *s) for kind, spans in enumerate(by_kind) for s in spans]
                loose = list(loose_spans(text, sorted(s for spans in by_kind for s in spans)))
                base.append([dict(kind=k, start=s, end=e) for k, s, e in seeds])
                every = [(*x, True) for x in seeds] + [(*x, False) for x in loose]
                found = _contexts(text, [x[1:3] for x in every]) if every else []
                mentions.append([
                    dict(kind=k, start=s, end=e, seed=seed, instance=instance(k, text[s:e]),
                         contexts=[dict(side=a, gram=b, words=c) for a, b, c in patterns])
                    for (k, s, e, seed), patterns in zip(every, found, strict=True)
                ])
                keys.append(f"{doc}:{hashlib.md5(text.encode()).hexdigest()}" if loose else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.string()), pa.array(base, pa.list_(span)), pa.array(mentions, pa.list_(mention))],
                ["doc_id", "row_key", "base", "mentions"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key string, base array<{_SPAN}>, mentions array<{_MENTION}>"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _filter_of(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of two bits for each gram, as a table of 64-bit words."""
    wanted = 16 * grams.count()
    bits = min(_FILTER_BITS, 1 << max(16, wanted.bit_length()))
    places = F.explode(F.array(F.pmod("gram", F.lit(bits)), F.pmod(F.shiftright("gram", 32), F.lit(bits))))
    words = (
        grams.select(places.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()  # a word at most for each 64 bits of the filter
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _held(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    mask, low = np.uint64(len(bloom) * 64 - 1), np.uint64(63)
    out = np.ones(len(keys), bool)
    for place in (keys & mask, (keys >> np.uint64(32)) & mask):
        out &= (bloom[place >> np.uint64(6)] >> (place & low) & np.uint64(1)).astype(bool)
    return out


def gram_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, n``: how often each of the given words and pairs of words stands in all texts.

    A filter of bounded size keeps others from being shuffled; a false hit goes in the join.
    """
    bloom = docs.sparkSession.sparkContext.broadcast(_filter_of(grams))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = bloom.value
        if not kept.any():
            return
        for batch in batches:
            for _, _, data, starts in blocks(batch.column("text")):
                begin, end, per_row = runs(_IN_TOKEN[data], starts)
                hashes = run_hashes(_LOWER[data], begin, end)
                row = np.repeat(np.arange(len(per_row)), per_row)
                pairs = _bigrams(hashes)[row[1:] == row[:-1]] if len(hashes) else hashes
                keys = np.concatenate([hashes, pairs])
                keys, n = np.unique(keys[_held(kept, keys)], return_counts=True)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    counts = docs.select("text").mapInArrow(work, "gram long, n long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n_all")).join(grams, "gram")


def pattern_graph(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """Edges ``side, gram, words, kind, instance, seed, n, n_all`` of patterns with ``SUPPORT`` different instances.

    ``n`` is how often the instance stands in the pattern, ``n_all`` how often the pattern's words occur at all.
    """
    mentions = extracted.select(F.explode("mentions").alias("m")).select("m.kind", "m.instance", "m.seed", F.explode("m.contexts").alias("c"))
    edges = materialise(
        mentions.groupBy("c.side", "c.gram", "kind", "instance").agg(
            F.min("c.words").alias("words"), F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")
        ), "edges"
    )
    # an instance stands once in each pattern and kind
    patterns = edges.groupBy("side", "gram", "kind").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= SUPPORT).drop("m")
    edges = materialise(edges.join(patterns, ["side", "gram", "kind"], "left_semi"), "edges")
    small_batches(docs.sparkSession)
    return materialise(edges.join(gram_counts(docs, edges.select("gram").distinct()), "gram"), "graph")


def confident_patterns(graph: DataFrame, scores: DataFrame) -> DataFrame:
    """``side, gram, kind, words, confidence, support`` of the patterns whose occurrences hold scored instances often enough."""
    known = graph.join(scores, ["kind", "instance"])
    share = F.round(F.sum(F.col("n") * F.col("score")) / F.max("n_all"), 9)
    patterns = known.groupBy("side", "gram", "kind").agg(
        F.min("words").alias("words"), F.least(share, F.lit(1.0)).alias("confidence"), F.count(F.lit(1)).alias("support")
    )
    return patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))


def discover(graph: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, instance, score`` of all identifiers: the seeds, of score 1, and those that patterns find.

    In turn, patterns get their confidence from the instances known so far, and the other instances
    the score that at least one of their confident patterns is right. Those of ``ACCEPTED`` join the
    known ones for the next round; an instance that several kinds accept is of the one that scores most.
    """
    seeds = materialise(seeds.select("kind", "instance", F.lit(1.0).alias("score")).distinct(), "seeds")
    known, found = seeds, 0
    for _ in range(rounds):
        patterns = confident_patterns(graph, known)
        doubt = F.sum(F.log(F.lit(1.0) - F.least("confidence", F.lit(0.999))))
        scored = (
            graph.where(~F.col("seed"))
            .join(patterns.select("side", "gram", "kind", "confidence"), ["side", "gram", "kind"])
            .groupBy("kind", "instance").agg(F.round(1 - F.exp(doubt), 9).alias("score"))
            .where(F.col("score") >= ACCEPTED)
            .groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("less"))).alias("best"))
            .select((-F.col("best.less")).alias("kind"), "instance", "best.score")
        )
        scored = materialise(scored.join(seeds, ["kind", "instance"], "left_anti"), "scored")
        known = seeds.unionByName(scored)
        now = scored.count()
        if now == found:
            break
        found = now
    return known


def find_identifiers(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, base, spans`` of every row: arrays of (kind, start, end), sorted, in code points; ``spans`` holds ``base``.

    Identifiers found by form are the seeds of a graph of instances and the words they stand
    between, counted over all texts; confident patterns tell which loose forms are identifiers as
    well (``discover``). A loose form that names a seed, differently written, is one too. NULL and
    empty texts have no spans. Rows with NULL or repeated ids are rows of their own; other columns
    are ignored. No documents, no rows.
    """
    extracted = materialise(extract(docs), "extracted")
    mentions = extracted.select("row_key", F.explode("mentions").alias("m")).select("row_key", "m.*")
    seeds = mentions.where("seed").select("kind", "instance")
    known = discover(pattern_graph(docs, extracted), seeds, rounds)
    added = (
        mentions.where(~F.col("seed")).join(known.select("kind", "instance"), ["kind", "instance"])
        .groupBy("row_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    )
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as array<{_SPAN}>)"))))
    return extracted.join(added, "row_key", "left").select("doc_id", F.array_sort("base").alias("base"), spans.alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")
    )), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts of each kind by form, the digest of those spans, and all spans written out."""
    def of_kind(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [of_kind(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op13_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return report(find_identifiers(table(spark, sf_dir, "documents")))
