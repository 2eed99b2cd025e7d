"""Conversation structure repair: the cheapest edits that give roles in order, by Viterbi with coalescing survivors."""

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalgrid.llm.common import small_batches, table

# Costs of the edits; what the edit leaves of a cut-off text costs as well.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States are what the repaired roles end in: nothing yet, the system, the user, the assistant.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEPT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
# the only role that may follow each state, if an edit is to give it, and the state it leads to
_GIVEN = (("user", _USER), ("user", _USER), ("assistant", _ASSISTANT), ("user", _USER))
_LEGAL = {"su", "ua", "au"}

_SPACE = " \t\n\x0b\x0c\r"
_SEED = 20


class _Node:
    """Edits that survivors share, behind those of the parent; ``refs`` of it are its children and its survivor."""

    __slots__ = ("parent", "edits", "kids", "state")

    def __init__(self, parent: "_Node | None", edits: bytes, state: int | None):
        self.parent, self.edits, self.kids, self.state = parent, bytearray(edits), [], state

    @property
    def refs(self) -> int:
        return len(self.kids) + (self.state is not None)


class Survivors:
    """The cheapest edits of the rows seen so far for each state, ties going to the ASCII-least edits.

    Backpointers form a tree whose runs of edits without a branch are one node, so it has at most
    seven nodes. A node nothing refers to is dropped; the root takes in its child as soon as it has
    but one reference left: these edits are settled. Two candidates of equal cost part at their last
    common node, where one letter decides for the whole of their unresolved edits: equal edits from
    one state lead to one state, and edits of equal cost are never one the beginning of the other.
    A survivor that another one beats with certainty is dropped, which lets the others coalesce. Of
    texts, only a running digest is kept for each survivor.
    """

    def __init__(self) -> None:
        self.root = _Node(None, b"", _NOTHING)
        self.best: dict[int, tuple[int, _Node, object]] = {_NOTHING: (0, self.root, None)}
        self._insert_anywhere()

    @property
    def settled(self) -> bytearray:
        return self.root.edits

    @staticmethod
    def _path(node: _Node) -> list[_Node]:
        out = [node]
        while node := node.parent:
            out.append(node)
        return out[::-1]

    def _before(self, a: _Node, a_next: bytes, b: _Node, b_next: bytes) -> bool:
        """Whether the edits up to ``a`` and then ``a_next`` come before those of ``b``."""
        if a is b:
            return a_next < b_next
        left, right = self._path(a), self._path(b)
        at = 0
        while at < min(len(left), len(right)) and left[at] is right[at]:
            at += 1
        first = left[at].edits if at < len(left) else a_next
        second = right[at].edits if at < len(right) else b_next
        return first[:1] < second[:1]

    @staticmethod
    def _digest(so_far, role: str, text: str):
        out = so_far.copy() if so_far else hashlib.sha256()
        out.update(f"{chr(10) if so_far else ''}{role}:{text}".encode())
        return out

    def step(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """Take in the next row."""
        found: dict[int, tuple] = {}

        def offer(state: int, cost: int, node: _Node, edit: bytes, digest, given: str | None) -> None:
            held = found.get(state)
            if held is None or cost < held[0] or cost == held[0] and self._before(node, edit, held[1], held[2]):
                found[state] = (cost, node, edit, digest, given)

        for state, (cost, node, digest) in self.best.items():
            offer(state, cost + DELETE, node, b"D", digest, None)
            if not must_go:
                stays = cost + (TRUNCATED if truncated else 0)
                if (kept := _KEPT[state].get(role[:1])) is not None:
                    offer(kept, stays, node, b"K", digest, role)
                given, to = _GIVEN[state]
                offer(to, stays + REROLE, node, b"R", digest, given)

        for _, node, _ in self.best.values():
            node.state = None
        self.best = {}
        for state, (cost, node, edit, digest, given) in found.items():
            if given is not None:
                digest = self._digest(digest, given, text)
            self._settle(state, cost, node, edit, digest)
        self._insert_anywhere()
        self._prune()
        self._tidy(self.root)

    def _settle(self, state: int, cost: int, node: _Node, edit: bytes, digest) -> None:
        leaf = _Node(node, edit, state)
        node.kids.append(leaf)
        self.best[state] = (cost, leaf, digest)

    def _insert_anywhere(self) -> None:
        self._insert((_NOTHING, _SYSTEM, _ASSISTANT))
        self._insert((_USER,))

    def _insert(self, sources: tuple[int, ...]) -> None:
        """Let a row be inserted behind these states where that is cheaper, or as cheap and earlier in ASCII."""
        for source in sources:
            if source not in self.best:
                continue
            cost, node, digest = self.best[source]
            given, to = _GIVEN[source]
            held = self.best.get(to)
            if held is None or cost + INSERT < held[0] or (
                cost + INSERT == held[0] and self._before(node, b"I", held[1], b"")
            ):
                if held is not None:
                    held[1].state = None
                self._settle(to, cost + INSERT, node, b"I", self._digest(digest, given, ""))

    def _prune(self) -> None:
        if _ASSISTANT not in self.best:
            return
        cost = self.best[_ASSISTANT][0]
        # what may follow nothing, or the system, may follow the assistant too, but for a system row: that is deleted
        for state, more in ((_NOTHING, DELETE), (_SYSTEM, 0)):
            if state in self.best and cost + more < self.best[state][0]:
                self.best.pop(state)[1].state = None

    def _tidy(self, node: _Node) -> None:
        """Drop nodes without references, and join a node to its only reference if that is a child."""
        for kid in node.kids:
            self._tidy(kid)
        node.kids = [kid for kid in node.kids if kid.refs]
        if node.refs == 1 and node.state is None:
            kid = node.kids[0]
            node.edits += kid.edits
            node.kids, node.state = kid.kids, kid.state
            for x in node.kids:
                x.parent = node
            if node.state is not None:
                cost, _, digest = self.best[node.state]
                self.best[node.state] = (cost, node, digest)

    def finish(self) -> tuple[int, str, str]:
        """Cost, edits and the digest of the repaired rows."""
        ends = [self.best[s] for s in (_NOTHING, _ASSISTANT) if s in self.best]
        chosen = ends[0]
        for other in ends[1:]:
            if other[0] < chosen[0] or other[0] == chosen[0] and self._before(other[1], b"", chosen[1], b""):
                chosen = other
        cost, node, digest = chosen
        edits = b"".join(bytes(x.edits) for x in self._path(node))
        return cost, edits.decode(), (digest or hashlib.sha256()).hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """The rows after damage drawn from ``conv_id`` and ``turn``, with ``copies``: 0 for a dropped row, 2 for a repeated one.

    NULL in role and text becomes one space, as it does in what the damage is drawn from.
    """
    def spaced(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    drawn = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % _SEED
    text = F.when(drawn == 1, "").when(drawn == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return rows.select(
        "conv_id", "turn",
        F.when(drawn == 4, "user").when(drawn != 0, spaced("role")).alias("role"),
        F.when(drawn != 0, text).alias("text"),
        F.when(drawn == 0, 0).when(drawn == 3, 2).otherwise(1).alias("copies"),
    )


def find_faults(rows: DataFrame) -> DataFrame:
    """Adds ``blank``, ``truncated`` and ``repeated`` (role and text stand at an earlier turn too) to damaged rows.

    Equal rows are found by an aggregate over digests that combines before its exchange; only those
    that stand at several turns are joined back.
    """
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = rows.withColumn("__digest", F.md5(F.col("text").cast("binary")))
    several = (
        rows.where("copies > 0").groupBy("conv_id", "role", "__digest")
        .agg(F.min("turn").alias("__first"), F.max("turn").alias("__last"), F.max(F.col("turn").isNull()).alias("__none"))
        .where("__first < __last OR __none AND __first IS NOT NULL")
        .select(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("__digest").alias("__same"), "__first", "__none")
    )
    on = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("__digest") == F.col("__same"))
    later = F.when(F.col("__none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("__first"))
    return rows.join(several, on, "left").select(
        "conv_id", "turn", "role", "text", "copies",
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.coalesce(later, F.lit(False)).alias("repeated"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


_COLUMNS = ("conv_id", "turn", "role", "text", "copies", "blank", "truncated", "repeated")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, role, text, fault) of sorted rows; a dropped row has no role."""
    last = None
    for batch in batches:
        for conv, turn, role, text, copies, blank, truncated, repeated in zip(
            *(batch.column(c).to_pylist() for c in _COLUMNS), strict=True
        ):
            if not copies:
                yield conv, None, None, None, None
                continue
            for _ in range(copies):
                row = conv, turn, role, text
                fault = "blank" if blank else "duplicate" if repeated or row == last else "truncated" if truncated else None
                last = row
                yield *row, fault


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost and edits of the repair, digest of the repaired rows.

    Takes the rows of ``find_faults``. Each conversation streams through one task in the order of
    its turns, as its digest has to be taken in that order; a task holds one batch of rows and, of
    the conversation, letters of edits and four digests, never its texts. Rows of equal turn are
    taken in order of role and text. A conversation all of whose rows were dropped has zeros, no
    edits and the digest of nothing. NULL is a conversation like any other. No rows, no report.
    """
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        conv, now, low, high, distinct, before = None, None, None, None, 0, None
        seen = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

        def close() -> None:
            cost, edits, digest = now.finish()
            gaps = high - low + 1 - distinct if distinct else 0
            held.append((conv, gaps, *seen.values(), cost, edits, digest))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for key, turn, role, text, fault in _rows(batches):
            if now is None or key != conv:
                if now is not None:
                    close()
                    if len(held) == 1000:
                        yield flushed()
                conv, now, low, high, distinct, before = key, Survivors(), None, None, 0, None
                seen = dict.fromkeys(seen, 0)
            if role is None:
                continue
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
            if fault:
                seen[fault] += 1
            if before is not None and before[:1] + role[:1] not in _LEGAL:
                seen["illegal"] += 1
            before = role
            now.step(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        if now is not None:
            close()
        if held:
            yield flushed()

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    key_type = pa.string() if isinstance(rows.schema["conv_id"].dataType, T.StringType) else pa.int64()
    types = [key_type] + [pa.int64()] * 6 + [pa.string()] * 2
    counts = ", ".join(f"{n} long" for n in names[1:7])
    key = "string" if key_type == pa.string() else "long"
    return _in_order(rows).mapInArrow(report, f"conv_id {key}, {counts}, audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The edits as rows: ``conv_id, place, edit, turn, role, text``; a deleted row has no place, an inserted one no turn.

    ``place`` counts the rows of the repaired conversation. Takes the rows of ``find_faults``, like
    ``repair_report``. A row leaves the task as soon as its edit is settled; until then its text is held.
    """
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, now, waiting, done, state, place = None, None, deque(), 0, _NOTHING, 0

        def emit(edits: bytes) -> None:
            nonlocal state, place
            for edit in edits:
                turn, role, text = waiting.popleft() if edit != 73 else (None, None, "")  # 73: I
                if edit == 68:  # D
                    out.append((conv, None, "D", turn, role, text))
                    continue
                if edit == 75:  # K
                    state = _KEPT[state][role[:1]]
                else:
                    role, state = _GIVEN[state]
                out.append((conv, place, chr(edit), turn, role, text))
                place += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for key, turn, role, text, fault in _rows(batches):
            if now is None or key != conv:
                if now is not None:
                    emit(now.finish()[1].encode()[done:])
                conv, now, done, state, place = key, Survivors(), 0, _NOTHING, 0
            if role is None:
                continue
            waiting.append((turn, role, text))
            now.step(role, text, fault in ("blank", "duplicate"), fault == "truncated")
            if len(now.settled) > done:
                emit(bytes(now.settled[done:]))
                done = len(now.settled)
            if len(out) >= 1000:
                yield flushed()
        if now is not None:
            emit(now.finish()[1].encode()[done:])
        if out:
            yield flushed()

    names = ["conv_id", "place", "edit", "turn", "role", "text"]
    text_key = isinstance(rows.schema["conv_id"].dataType, T.StringType)
    types = [pa.string() if text_key else pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    key = "string" if text_key else "long"
    return _in_order(rows).mapInArrow(repair, f"conv_id {key}, place long, edit string, turn long, role string, text string")


def op11_survivor_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired."""
    return repair_report(find_faults(damage(table(spark, sf_dir, "conversations"))))
