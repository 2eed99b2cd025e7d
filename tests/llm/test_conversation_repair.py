import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalgrid.llm import conversation_repair as C

SPACE = " \t\n\x0b\x0c\r"
ORDER = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, edits, repaired rows) of (role, text, must go, truncated) rows: uniform-cost search over all edits.

    The queue is ordered by cost and then by the edits, so the first way to each (row, end of the
    roles) that leaves the queue is the cheapest and ASCII-least, whatever the shape of the survivors.
    """
    def fits(roles, whole):
        if whole:
            return ORDER.fullmatch("".join(roles)) is not None
        # the beginning of something that fits
        return re.fullmatch(r"s?(ua)*u?", "".join(roles)) is not None

    queue, seen = [(0, "", 0, ())], set()
    while queue:
        cost, edits, at, out = heapq.heappop(queue)
        initials = tuple(r[:1] for r, _ in out)
        if at == len(rows) and fits(initials, True):
            return cost, edits, list(out)
        key = at, initials[-1:] if initials else ()
        if key in seen:
            continue
        seen.add(key)
        ways = [(3, "I", at, (*out, (r, ""))) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, must_go, truncated = rows[at]
            ways.append((4, "D", at + 1, out))
            if not must_go:
                ways.append((3 * truncated, "K", at + 1, (*out, (role, text))))
                ways += [(3 + 3 * truncated, "R", at + 1, (*out, (r, text))) for r in ("user", "assistant")]
        for more, edit, to, then in ways:
            new = [r[:1] for r, _ in then]
            if all(new) and fits(new, False):
                heapq.heappush(queue, (cost + more, edits + edit, to, then))


def brute_force(table):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        rows += [(turn, role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, seen, given = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            given.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, edits, repaired = cheapest(given)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), illegal, cost, edits, digest))
    return sorted(out, key=str)


ROLES = ["user", "assistant", "system", "tool", "", "u"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.booleans(), st.booleans()), max_size=9))
def test_survivors_equal_a_search_of_all_edits(rows):
    rows = [(role, f"t{i}", go, cut and not go) for i, (role, go, cut) in enumerate(rows)]
    survivors = C.Survivors()
    for row in rows:
        survivors.step(*row)
    cost, edits, repaired = cheapest(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    assert survivors.finish() == (cost, edits, digest)


def _nodes(node):
    return 1 + sum(map(_nodes, node.kids))


def test_memory_is_bounded():
    survivors, longest = C.Survivors(), 0
    rng = random.Random(5)
    for i in range(4000):
        role = rng.choice(["user", "assistant", "system"]) if i % 7 == 0 else ("user", "assistant")[i % 2]
        survivors.step(role, "x", rng.random() < 0.05, rng.random() < 0.05)
        longest = max(longest, sum(len(e) for e in _edits(survivors.root)))
        assert _nodes(survivors.root) <= 7
    assert longest < 400 and len(survivors.settled) > 3600


def _edits(node):
    for kid in node.kids:
        yield kid.edits
        yield from _edits(kid)


def test_survivors_that_never_coalesce_keep_letters_only():
    survivors = C.Survivors()
    for i in range(2001):
        survivors.step("system", f"t{i}", False, False)
    assert _nodes(survivors.root) <= 7
    rows = [("system", f"t{i}", False, False) for i in range(61)]
    short = C.Survivors()
    for row in rows:
        short.step(*row)
    assert short.finish()[:2] == cheapest(rows)[:2]


def _table(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(0, 14)):
            role = rng.choice([("user", "assistant")[turn % 2]] * 5 + ["system", "tool", None, ""])
            text = rng.choice([f"Text {turn}.", f"Text {turn}.", "Same.", "same", " \n", "", None, "Cut off\n", "Ünï 🙂!\x0b"])
            rows.append((conv, rng.choice([turn] * 8 + [None, turn * 3, 1]), role, text))
    rows += [(1000, 0, "user", "Long. " * 20_000), (1001, 5, "user", "a."), (1001, 5, "user", "a."), (1001, 5, "user", "a.")]
    rows += [(1002, t, "user", "the same.") for t in range(40)]
    rows += [(c, 0, "user", "gone.") for c in range(2000, 2030)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, blank string, copies int"
    )


def test_equals_brute_force(spark):
    rows = _table()
    found = C.repair_report(C.find_faults(C.damage(_frame(spark, rows)))).collect()
    expected = brute_force(rows)
    assert sorted(map(tuple, found), key=str) == expected
    assert any(e[7] == "" and e[6] == 0 and e[0] is not None and e[0] >= 2000 for e in expected)  # all rows dropped


def test_edits_as_rows(spark):
    rows = _table()
    faulty = C.find_faults(C.damage(_frame(spark, rows)))
    report = {r.conv_id: r for r in C.repair_report(faulty).collect()}
    edits = {}
    for r in C.repaired_rows(faulty).collect():
        edits.setdefault(r.conv_id, []).append(r)
    for conv, r in report.items():
        mine = edits.get(conv, [])
        assert "".join(e.edit for e in mine) == r.audit
        kept = [e for e in mine if e.place is not None]
        assert [e.place for e in kept] == list(range(len(kept)))
        text = "\n".join(f"{e.role}:{e.text}" for e in kept)
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_table_of_conversations(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, C.op11_survivor_viterbi(spark, path).collect()), key=str) == brute_force(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_few_rows(spark, rows):
    found = C.repair_report(C.find_faults(C.damage(_frame(spark, rows)))).collect()
    assert sorted(map(tuple, found), key=str) == brute_force(rows)
