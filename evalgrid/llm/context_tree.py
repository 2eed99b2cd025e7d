"""Language-model scores by context-tree weighting over bytes, beside a unigram base."""

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm.common import fold, small_batches, strings, table
from evalgrid.session import materialise

#: bytes of context of the deepest trees
DEPTH = 6
#: a context is a node of its own if it precedes so many training bytes; else it shares one leaf
LEAST_SEEN = 2
#: subtrees below contexts of so many bytes are weighed by tasks, what is above them by the driver
ROOT = 3
#: n-grams whose scores are broadcast at most, the most frequent ones; the others' come by a join
FREQUENT_GRAMS = 2_000_000
#: bounds of ``fit``, a model in the driver's memory; ``score_texts`` has neither
CONTEXTS, MOST_PAIRS = 1 << 19, 1_200_000
#: words of at least one in so many tokens are looked up where the text is, the others by a join
FREQUENT = 1 << 20
FOLDS, HELD_OUT = 5, 1

_END = 10  # the byte after each text, and before it as context
_BLOCK = 4 << 20
#: distinct n-grams that a task holds before it gives them on
_HELD_GRAMS = 4_000_000
#: distinct words that a task holds before it gives them on, those of training texts and others apart
_HELD_WORDS = 100_000
#: n-grams of whole subtrees that a task weighs at once
_CHUNK = 150_000
_MEMO = 1 << 20
_LN10 = float(np.log(10))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode().lower().split()


def _padded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of the context and byte, for each byte of each text and its end; starts; lengths).

    A text is coded as its words with one blank between them and an end; before it stand ends.
    """
    pad = bytes([_END]) * DEPTH
    coded = [b" ".join(words) + bytes([_END]) for words in texts]
    # eight bytes from each place on, the highest first, are a number whose lower bytes are the n-gram
    data = bytes(7 - DEPTH) + b"".join(x for text in coded for x in (pad, text))
    lengths = np.array([len(x) for x in coded])
    n = len(data) - 7
    gram = np.ndarray(n, ">u8", data, strides=(1,)).astype(np.uint64) & np.uint64((1 << 8 * (DEPTH + 1)) - 1)
    # between two texts stand DEPTH bytes that are context only
    own = np.ones(n, bool)
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + DEPTH)])
    for end in (starts[1:]).tolist():
        own[end - DEPTH:end] = False
    return gram[own], np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths


def _summed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams and the sums of their two counts."""
    grams, n, n_train = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(grams)
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(n[order], first), np.add.reduceat(n_train[order], first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, word, n, n_train): words and n-grams with their counts in the task, or in parts of it if these are many."""

    def rows(grams, words, n, n_train):
        cells = [
            pa.array(grams, pa.int64()) if grams is not None else pa.nulls(len(n), pa.int64()),
            pa.array(words, pa.binary()) if words is not None else pa.nulls(len(n), pa.binary()),
            pa.array(n, pa.int64()), pa.array(n_train, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cells, ["gram", "word", "n", "n_train"])

    def gram_rows(held):
        grams, n, n_train = _summed(held)
        for at in range(0, len(grams), 100_000):
            part = slice(at, at + 100_000)
            yield rows(grams[part].astype(np.int64), None, n[part], n_train[part])

    def word_rows(learnt, unlearnt):
        keys = [*learnt, *(k for k in unlearnt if k not in learnt)]
        n_train = np.zeros(len(keys), np.int64)
        n_train[:len(learnt)] = list(learnt.values())
        yield rows(None, keys, n_train + np.fromiter(map(unlearnt.get, keys, repeat(0)), np.int64, len(keys)), n_train)

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    learnt, unlearnt = Counter(), Counter()
    for batch in batches:
        texts, training = batch.column("text"), batch.column("training").to_pylist()
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        row = 0
        while row < len(training):
            size, trained, others = 0, [], []
            while row < len(training) and size < _BLOCK:
                words = words_of(texts[row].as_py() or "")
                size += 8 + sizes[row]
                counts, part = (learnt, trained) if training[row] else (unlearnt, others)
                # the empty word stands for the end
                counts.update(words)
                counts[b""] += 1
                part.append(words)
                row += 1
            if len(learnt) + len(unlearnt) > _HELD_WORDS:
                yield from word_rows(learnt, unlearnt)
                learnt, unlearnt = Counter(), Counter()
            for part, teaches in ((trained, 1), (others, 0)):
                if part:
                    grams, n = np.unique(_padded(part)[0], return_counts=True)
                    held.append((grams, n, n * teaches))
            if sum(len(x[0]) for x in held) > _HELD_GRAMS:
                held = [_summed(held)]
            if held and len(held[0][0]) > _HELD_GRAMS // 2:
                yield from gram_rows(held)
                held = []
    if held:
        yield from gram_rows(held)
    if learnt or unlearnt:
        yield from word_rows(learnt, unlearnt)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x of 0.5 or more."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        series -= np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


def _found(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value among sorted ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _decisions(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The eight binary decisions that make up a byte, from its highest bit: (number from 1 to 255, outcome)."""
    for bit in range(8):
        yield (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1


def _level(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, zeros, ones) of the decisions met in each context, by context number times 256 plus decision."""
    keys, ones = [], []
    for decision, one in _decisions(byte):
        keys.append(context * 256 + decision)
        ones.append(one)
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    n_one = np.bincount(place, np.concatenate(ones) * np.tile(n, 8), len(found))
    return found, np.bincount(place, np.tile(n, 8), len(found)) - n_one, n_one


def _fresh_memo() -> tuple[np.ndarray, np.ndarray]:
    return np.full(_MEMO, np.iinfo(np.uint64).max, np.uint64), np.zeros(_MEMO)


@dataclass
class Model:
    """Contexts by depth; probabilities of a one at the decisions met in them; log10 of those of bytes met."""

    contexts: list[np.ndarray]  # sorted; of each depth from 0
    first: list[int]  # number of a depth's first context
    nodes: np.ndarray  # context number times 256 plus decision, sorted
    p_one: np.ndarray
    pairs: np.ndarray  # context number times 256 plus byte, sorted
    logs: np.ndarray

    def fresh_memo(self) -> tuple[np.ndarray, np.ndarray]:
        return _fresh_memo()

    def _path(self, gram: np.ndarray) -> np.ndarray:
        """Numbers of the known contexts of each depth, -1 beyond the deepest."""
        path = np.full((len(self.contexts), len(gram)), -1)
        path[0] = 0
        rest = np.arange(len(gram))
        for depth in range(1, len(self.contexts)):
            context = (gram[rest] >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
            at, hit = _found(self.contexts[depth], context)
            rest, at = rest[hit], at[hit]
            path[depth, rest] = self.first[depth] + at
        return path

    def _of(self, gram: np.ndarray) -> np.ndarray:
        path, byte = self._path(gram), (gram & np.uint64(255)).astype(np.int64)
        at, hit = _found(self.pairs, path.max(0) * 256 + byte)
        out = np.where(hit, self.logs[at] if len(self.logs) else 0, 0).astype(np.float64)
        # a byte not met in the deepest context: each decision is that of the deepest one that met it
        rest = np.flatnonzero(~hit)
        for decision, one in _decisions(byte[rest]):
            p, open_ = np.full(len(rest), 0.5), np.ones(len(rest), bool)
            for depth in range(len(self.contexts) - 1, -1, -1):
                own = path[depth, rest]
                at, met = _found(self.nodes, own * 256 + decision)
                met &= open_ & (own >= 0)
                p[met] = self.p_one[at[met]]
                open_ &= ~met
            out[rest] += np.log10(np.where(one, p, 1 - p))
        return out

    def score(self, gram: np.ndarray, memo: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 of each byte's probability; ``memo`` keeps what was looked up last for each slot."""
        return _remembered(gram, memo, self._of)


def _slots(gram: np.ndarray) -> np.ndarray:
    return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _remembered(gram: np.ndarray, memo: tuple[np.ndarray, np.ndarray], look_up: Callable) -> np.ndarray:
    """Values of n-grams from the memo, or from ``look_up``, which gets each n-gram once."""
    keys, values = memo
    slot = _slots(gram)
    out = values[slot].astype(np.float64)
    miss = np.flatnonzero(keys[slot] != gram)
    if len(miss):
        wanted, place = np.unique(gram[miss], return_inverse=True)
        found = look_up(wanted)
        out[miss] = found[place]
        # keys and values of a slot that is written twice must be of the same n-gram
        slots = _slots(wanted)
        keys[slots] = wanted
        kept = keys[slots] == wanted
        values[slots[kept]] = found[kept]
    return out


@dataclass
class _Trees:
    """Levels of the trees from one depth on: contexts, and the (key, zeros, ones) of the decisions met in them."""

    contexts: list[np.ndarray]
    rows: list[np.ndarray]  # context number in its depth times 256 plus byte
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    parents: list  # where a node's parent is in the table before: the decision in the context without its oldest byte


def _trees(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], at: int = 0) -> _Trees:
    """The trees of (context, byte, count) of each depth from ``at`` on, as far as there are contexts."""
    out = _Trees([], [], [], [])
    for depth, (context, byte, n) in enumerate(levels, at):
        known = np.unique(context) if depth else np.zeros(1, np.uint64)
        if depth and not len(known):
            break
        number = np.searchsorted(known, context)
        out.contexts.append(known)
        out.rows.append(number * 256 + byte)
        out.tables.append(_level(number, byte, n))
        out.parents.append(_parents(out.contexts[-2], out.tables[-2], known, out.tables[-1], depth) if depth > at else None)
    return out


def _parents(contexts, table_, child_contexts, child_table, depth: int) -> np.ndarray:
    """Places in a table of the parents of the nodes of the next, which is of ``depth``."""
    keys = child_table[0]
    up = np.searchsorted(contexts, child_contexts & np.uint64((1 << 8 * (depth - 1)) - 1))
    return np.searchsorted(table_[0], up[keys >> 8] * 256 + (keys & 255))


def _weights(trees: _Trees, log_pw: np.ndarray | None = None) -> tuple[list, np.ndarray]:
    """Weight of each node's own estimate and estimate of the leaf of its other contexts, by depth; ln of the
    weighted probabilities of the first depth. ``log_pw`` has those of the last depth, if it is weighed already."""
    last = len(trees.tables) - 1
    weights: list = [None] * len(trees.tables)
    if log_pw is None:
        last, log_pw = last + 1, np.zeros(0)
    for depth in range(last - 1, -1, -1):
        _, zeros, ones = trees.tables[depth]
        log_pe = _log_kt(zeros, ones)
        other_zeros, other_ones, below = zeros.copy(), ones.copy(), np.zeros(len(zeros))
        leaf = np.ones(len(zeros), bool)
        if depth + 1 < len(trees.tables):
            _, child_zeros, child_ones = trees.tables[depth + 1]
            parent = trees.parents[depth + 1]
            other_zeros -= np.bincount(parent, child_zeros, len(zeros))
            other_ones -= np.bincount(parent, child_ones, len(zeros))
            below = np.bincount(parent, log_pw, len(zeros))
            leaf[parent] = False
        below += _log_kt(other_zeros, other_ones)
        w = np.where(leaf, 1.0, 1 / (1 + np.exp(np.clip(below - log_pe, -700, 700))))
        # other contexts that were never met say nothing against the estimate without them
        rest = (other_ones + 0.5) / (other_zeros + other_ones + 1)
        rest = np.where(other_zeros + other_ones > 0, rest, (ones + 0.5) / (zeros + ones + 1))
        weights[depth] = (w, rest)
        log_pw = np.where(leaf, log_pe, np.log(0.5) + np.logaddexp(log_pe, below))
    return weights, log_pw


def _estimates(
    trees: _Trees, weights: list, before: np.ndarray, remaining: np.ndarray, total: int = 0
) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model of the weighed depths, whose contexts are numbered from ``total``, from the share of the estimate
    that is settled above each node of the first depth and the weight that remains; those of the last depth."""
    nodes, p_one, pairs, logs, first = [], [], [], [], []
    for depth, weighed in enumerate(weights):
        if weighed is None:
            break
        keys, zeros, ones = trees.tables[depth]
        own_rows, (w, rest) = trees.rows[depth], weighed
        if depth:
            before, remaining = before[trees.parents[depth]], remaining[trees.parents[depth]]
        own = before + remaining * w * (ones + 0.5) / (zeros + ones + 1)
        p = np.clip(own + remaining * (1 - w) * rest, 1e-12, 1 - 1e-12)
        before, remaining = own, remaining * (1 - w)
        log = np.zeros(len(own_rows))
        for decision, one in _decisions(own_rows & 255):
            q = p[np.searchsorted(keys, (own_rows >> 8) * 256 + decision)]
            log += np.log10(np.where(one, q, 1 - q))
        nodes.append(keys + total * 256)
        p_one.append(p.astype(np.float32))
        order = np.argsort(own_rows)
        pairs.append(own_rows[order] + total * 256)
        logs.append(log[order].astype(np.float32))
        first.append(total)
        total += len(trees.contexts[depth])
    model = Model(trees.contexts[:len(first)], first, *map(np.concatenate, (nodes, p_one, pairs, logs)))
    return model, before, remaining


def weigh(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """The weighted trees of all binary decisions, from (context, byte, count) of each depth.

    At each node, the evidence of its own KT estimate is weighed against that of its known child
    contexts and of one more leaf that all its other contexts share. The mixture of all depths on
    the path to a context is then one estimate for each decision met there.
    """
    trees = _trees(levels)
    nodes = len(trees.tables[0][0])
    return _estimates(trees, _weights(trees)[0], np.zeros(nodes), np.ones(nodes))[0]


def known_levels(
    gram: np.ndarray, n: np.ndarray, depths: range, least_seen: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, byte, count) of each depth for contexts seen so often; any count of the empty context will do."""
    out = []
    for depth in depths:
        key, place = np.unique(gram & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        count = np.bincount(place, n, len(key)).astype(np.int64)
        context = key >> np.uint64(8)
        if depth:
            found, place = np.unique(context, return_inverse=True)
            kept = (np.bincount(place, count, len(found)) >= least_seen)[place]
            key, count, context = key[kept], count[kept], context[kept]
        out.append((context, (key & np.uint64(255)).astype(np.int64), count))
    return out


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, counts, training counts) of whole subtrees, from rows in the order of their roots."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("root", "gram", "n", "n_train")])
        size += batch.num_rows
        if size >= _CHUNK:
            root, *cells = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(root, root[-1]))
            held, size = [[root[cut:], *(c[cut:] for c in cells)]], 0
            if cut:
                yield cells[0][:cut].astype(np.uint64), cells[1][:cut], cells[2][:cut]
    if held:
        gram, n, n_train = [np.concatenate(x) for x in zip(*held, strict=True)][1:]
        yield gram.astype(np.uint64), n, n_train


def score_grams(grams: DataFrame, least_seen: int = LEAST_SEEN, root: int = ROOT) -> DataFrame:
    """(gram, n, log) of each row of counted n-grams (gram, n, n_train): log10 of the probability of its byte.

    Every context that ``least_seen`` training bytes follow is a node. Tasks get whole subtrees, of contexts that
    end in the same ``root`` bytes, and give the evidence of these. The driver weighs what is above, which
    grows with the different runs of ``root`` bytes and one more only. Then tasks weigh their subtrees
    below it and score the n-grams, those never learnt as well.
    """
    spark = grams.sparkSession
    mask = (1 << 8 * root) - 1
    dealt = grams.select(F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(mask)).alias("root"), "gram", "n", "n_train")
    dealt = dealt.repartition("root").sortWithinPartitions("root")
    below = range(root, DEPTH + 1)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, _, n in _subtrees(batches):
            trees = _trees(known_levels(gram[n > 0], n[n > 0], below, least_seen), root)
            if trees.tables:
                keys = trees.tables[0][0]
                node = (trees.contexts[0].astype(np.int64)[keys >> 8] << 8) | (keys & 255)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_weights(trees)[1])], ["node", "log_pw"])

    weighed = dealt.where("n_train > 0").mapInArrow(evidence, "node long, log_pw double").toArrow()
    top = grams.where("n_train > 0").groupBy(F.col("gram").bitwiseAND(F.lit((mask << 8) | 255)).alias("gram"))
    top = top.agg(F.sum("n_train").alias("n")).toArrow()
    trees = _trees(known_levels(top.column("gram").to_numpy().astype(np.uint64), top.column("n").to_numpy(), range(root + 1), least_seen))
    log_pw = None
    if len(trees.tables) > root:
        node, log_pw = weighed.column("node").to_numpy(), weighed.column("log_pw").to_numpy()
        log_pw = log_pw[np.argsort(node)]  # in the order of the last table
    weights, _ = _weights(trees, log_pw)
    nodes = len(trees.tables[0][0])
    upper, before, remaining = _estimates(trees, weights, np.zeros(nodes), np.ones(nodes))
    shared = spark.sparkContext.broadcast((upper, trees.tables[len(upper.first) - 1], before, remaining))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, last, before, remaining = shared.value
        for gram, n, n_train in _subtrees(batches):
            learnt = n_train > 0
            trees = _trees(known_levels(gram[learnt], n_train[learnt], below, least_seen), root)
            model = upper
            if trees.tables:
                up = _parents(upper.contexts[-1], last, trees.contexts[0], trees.tables[0], root)
                own, _, _ = _estimates(
                    trees, _weights(trees)[0], before[up], remaining[up], upper.first[-1] + len(upper.contexts[-1])
                )
                model = Model(upper.contexts + own.contexts, upper.first + own.first, *(
                    np.concatenate([getattr(upper, x), getattr(own, x)]) for x in ("nodes", "p_one", "pairs", "logs")
                ))
            log = model._of(gram)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n), pa.array(log)], ["gram", "n", "log"])

    return dealt.mapInArrow(score, "gram long, n long, log double")


def fit(grams: DataFrame, contexts: int = CONTEXTS, most_pairs: int = MOST_PAIRS) -> Model:
    """A model of counted n-grams (gram, n) that fits into the driver, to look into; no query uses it.

    A context is known if it precedes at least one in ``contexts`` training bytes, so per depth at most
    that many are; the number is halved until the known contexts' pairs with the byte after them are
    at most ``most_pairs``. That bounds what the driver gets. Other contexts' counts stay in the leaf they
    share.
    """
    bits = [(1 << 8 * (d + 1)) - 1 for d in range(DEPTH + 1)]
    level = F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), F.col("gram").bitwiseAND(F.lit(m)).alias("key")) for d, m in enumerate(bits)
    ])).alias("level")
    levels = grams.select(level, "n").groupBy("level.depth", "level.key").agg(F.sum("n").alias("n"))
    levels = materialise(levels.withColumn("context", F.shiftrightunsigned("key", 8)), "byte_counts")
    total = levels.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    seen = materialise(
        levels.groupBy("depth", "context").agg(F.sum("n").alias("seen"), F.count("*").alias("pairs")), "context_counts"
    )
    while True:
        known = seen.where(F.col("seen") * contexts >= total)
        if (known.agg(F.sum("pairs")).first()[0] or 0) <= most_pairs or contexts <= 1:
            break
        contexts //= 2
    kept = levels.join(known.select("depth", "context"), ["depth", "context"], "left_semi")
    kept = kept.select("depth", "key", "n").toArrow()
    depth, key, n = (kept.column(c).to_numpy() for c in ("depth", "key", "n"))
    key = key.astype(np.uint64)
    out = []
    for d in range(DEPTH + 1):
        own = depth == d
        out.append((key[own] >> np.uint64(8), (key[own] & np.uint64(255)).astype(np.int64), n[own]))
    return weigh(out)


def _least_frequent(scored: DataFrame, most: int) -> int:
    """The least count of which there are at most ``most`` n-grams with that count or a higher one."""
    found = scored.groupBy("n").count().toArrow()
    least, held = 1 << 62, 0
    for n, rows in sorted(zip(found.column("n").to_pylist(), found.column("count").to_pylist(), strict=True), reverse=True):
        held += rows
        if held > most:
            break
        least = n
    return least


def _gram_keys(gram: np.ndarray) -> pa.Array:
    """Join keys of n-grams, which no word has: a line end, g and the n-gram's eight bytes from the highest."""
    data = np.empty((len(gram), 10), np.uint8)
    data[:, 0], data[:, 1] = _END, ord("g")
    data[:, 2:] = gram.astype(">u8").view(np.uint8).reshape(-1, 8)
    offsets = np.arange(len(gram) + 1, dtype=np.int32) * 10
    return pa.Array.from_buffers(pa.binary(), len(gram), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def score_texts(
    docs: DataFrame, training: str, least_seen: int = LEAST_SEEN, frequent: int = FREQUENT,
    frequent_grams: int = FREQUENT_GRAMS,
) -> DataFrame:
    """Scores of every row of ``docs``; rows whose boolean column ``training`` is true teach.

    Adds to each row's doc_id and ``training``: n_tokens, n_known, train_tokens, base_score and score
    (the definition of the base is in the query's contract), and bits_per_byte, the model's code length.
    The model codes a text's words, one blank between them, and its end.

    One pass counts words and byte n-grams, combining within blocks before the shuffle. Words that
    make up at least one of ``frequent`` tokens, so at most that many, are broadcast; the other words
    of a text meet their counts in a join, none of which has a large key then. n-grams are scored as a
    table (``score_grams``); at most ``frequent_grams`` of them, the most frequent, are broadcast, and
    the others of a text meet their scores in the same join. Neither number changes a result.

    NULL texts are empty: one token, the end. NULL ``training`` counts as false. Rows with repeated or
    NULL ids are scored as rows of their own. Other columns are ignored. Without training rows all
    bytes are equally likely and the base of any text is 0. No documents, no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.coalesce(F.col(training), F.lit(False)).alias("training"))
    counted = docs.select("text", "training").mapInArrow(_count, "gram long, word binary, n long, n_train long")
    # tasks have summed already: one more sum before the exchange would find next to nothing to combine
    counted = counted.repartition("gram", "word")
    counted = counted.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))
    counted = materialise(counted, "counts")
    words = counted.where("word is not null").select("word", "n", "n_train")
    n_all, n_train, n_words = words.agg(
        F.sum("n"), F.sum("n_train"), F.count(F.when(F.col("n_train") > 0, 1))
    ).first()
    n_all, n_train = n_all or 0, n_train or 0
    common = F.col("n") * frequent >= max(2 * frequent, n_all)
    table_ = words.where(common).select("word", "n_train").toArrow()
    scored = score_grams(counted.where("gram is not null").select("gram", "n", "n_train"), least_seen)
    scored = materialise(scored, "scores")
    least = _least_frequent(scored, frequent_grams)
    kept = scored.where(F.col("n") >= least).select("gram", "log").toArrow()
    known_grams, logs = kept.column("gram").to_numpy().astype(np.uint64), kept.column("log").to_numpy()
    order = np.argsort(known_grams)
    known_grams, logs = known_grams[order], logs[order]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known_grams, logs, table_.column("word").to_pylist(), table_.column("n_train").to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_grams, logs, frequent_words, found = shared.value
        # a word that is not frequent has the place behind them
        known, rest = {w: i for i, w in enumerate(frequent_words)}, len(frequent_words)
        known_logs, known_hits = np.append(np.log10(found + 0.5), 0), np.append(found > 0, False)
        memo = _fresh_memo()

        def look_up(gram):
            at, hit = _found(known_grams, gram)
            return np.where(hit, logs[at] if len(logs) else 0, np.nan)

        number = TaskContext.get().partitionId() << 40
        names = ["row", "word", "doc_id", "training", "n_tokens", "n_known", "base", "score", "n_bytes", "times"]
        for batch in batches:
            texts, row = strings(batch.column("text")), 0
            while row < len(texts):
                part, held = [], 0
                while row + len(part) < len(texts) and held < _BLOCK // 4:
                    part.append(words_of(texts[row + len(part)]))
                    held += len(texts[row + len(part) - 1]) + 8
                gram, starts, lengths = _padded(part)
                each = _remembered(gram, memo, look_up)
                rare = np.flatnonzero(np.isnan(each))
                each[rare] = 0
                scores = np.add.reduceat(each, starts)
                # a text's rare n-grams, each once with how often it stands there
                grams, at = np.unique(gram[rare], return_inverse=True)
                text = np.searchsorted(starts, rare, "right") - 1
                cell, times = np.unique(text * max(1, len(grams)) + at, return_counts=True)
                gram_row, gram_key = cell // max(1, len(grams)) + number, _gram_keys(grams[cell % max(1, len(grams))])
                for words in part:
                    words.append(b"")
                n_words = np.array([len(words) for words in part])
                tokens = list(chain.from_iterable(part))
                place = np.fromiter(map(known.get, tokens, repeat(rest)), np.int64, len(tokens))
                begin = np.cumsum(n_words) - n_words
                base, n_known = np.add.reduceat(known_logs[place], begin), np.add.reduceat(known_hits[place].astype(np.int64), begin)
                missing = np.flatnonzero(place == rest)
                rare_word = [tokens[i] for i in missing.tolist()]
                rare_row = np.searchsorted(begin, missing, "right") - 1 + number
                # a text's own row has a word that no text has, so that these rows spread
                own = [b"\n%d" % (number + i) for i in range(len(part))]
                size, extra = len(part), len(rare_row) + len(cell)
                cells = [
                    pa.array(np.concatenate([np.arange(number, number + size), rare_row, gram_row]), pa.int64()),
                    pa.concat_arrays([pa.array([*own, *rare_word], pa.binary()), gram_key]),
                    pa.concat_arrays([batch.column("doc_id")[row:row + size], pa.nulls(extra, batch.column("doc_id").type)]),
                    pa.concat_arrays([batch.column("training")[row:row + size], pa.nulls(extra, pa.bool_())]),
                ]
                for values, kind in (
                    (n_words, pa.int64()), (n_known, pa.int64()), (base, pa.float64()),
                    (scores, pa.float64()), (lengths, pa.int64()),
                ):
                    cells.append(pa.concat_arrays([pa.array(values, kind), pa.nulls(extra, kind)]))
                cells.append(pa.concat_arrays([pa.nulls(size + len(rare_row), pa.int64()), pa.array(times)]))
                yield pa.RecordBatch.from_arrays(cells, names)
                row += size
                number += size

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(score, (
        f"row long, word binary, doc_id {kind}, training boolean, n_tokens long, n_known long, base double, "
        "score double, n_bytes long, times long"
    ))
    rare = words.where(~common).select("word", F.col("n_train").alias("c"), F.lit(None).cast("double").alias("log"))
    key = F.concat(F.lit(b"\ng"), F.unhex(F.lpad(F.hex("gram"), 16, "0")))
    rare_grams = scored.where(F.col("n") < least).select(key.alias("word"), F.lit(None).cast("long").alias("c"), "log")
    met = rows.join(rare.unionAll(rare_grams), "word", "left")
    is_rare = F.col("n_tokens").isNull() & F.col("times").isNull()
    c = F.coalesce("c", F.lit(0))
    summed = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("training").alias("training"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_rare, (c > 0).cast("long")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(is_rare, F.log10(c + 0.5)).otherwise(F.col("base"))).alias("base"),
        F.sum(F.coalesce(F.col("times") * F.col("log"), "score")).alias("score"), F.max("n_bytes").alias("n_bytes"),
    )
    denominator = float(np.log10(n_train + 0.5 * (n_words + 1)))
    return summed.select(
        "doc_id", "training", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(denominator)).alias("base_score"), "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", FOLDS) == HELD_OUT
    docs = table(spark, sf_dir, "documents").withColumn("training", ~held_out)
    scored = score_texts(docs, "training").withColumn("held_out", ~F.col("training"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )
