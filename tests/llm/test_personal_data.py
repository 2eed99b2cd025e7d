import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalgrid.llm import personal_data as P

# The patterns of the four kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def written(spans):
    order = list(PATTERNS)
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order.index(x[0]), x[1], x[2])))


def card(rng, right=True):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    last = next(c for c in "0123456789" if luhn(digits + c))
    return digits + (last if right else str((int(last) + 3) % 10))


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aB1209.@@-+ ().()%é"), max_size=40))
def test_base_spans_equal_the_patterns(text):
    found = [(kind, *s) for kind, spans in zip(P.KINDS, P.base_spans(text)) for s in spans]
    assert found == base(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["+1 (555) 123-4567", "4539578763621486", "1.2.3.4", "999.1.1.1", "a.b@c.d.e", "@", " ", "x", "-", ".", "+", "1", "@x.y"]), max_size=14))
def test_base_spans_of_whole_identifiers(parts):
    text = "".join(parts)
    found = [(kind, *s) for kind, spans in zip(P.KINDS, P.base_spans(text)) for s in spans]
    assert found == base(text)


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000, "(at)" * 100_000, "ab:" * 130_000])
def test_long_runs_take_no_square_time(text):
    start = time.perf_counter()
    taken = sorted(s for spans in P.base_spans(text) for s in spans)
    list(P.loose_spans(text, taken))
    assert time.perf_counter() - start < 10


def discovered(docs):
    """Known (kind, instance) by the scoring rules, over plain dictionaries."""
    token = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
    edges, seeds, cands, total = Counter(), set(), set(), Counter()
    for _, text in docs:
        text = text or ""
        words = [(m.start(), m.end(), m.group().encode().lower().decode()) for m in token.finditer(text)]
        plain = [w for _, _, w in words]
        total.update((w,) for w in plain)
        total.update(zip(plain, plain[1:]))
        by_kind = P.base_spans(text)
        taken = sorted(s for spans in by_kind for s in spans)
        mentions = [(k, *s, True) for k, spans in enumerate(by_kind) for s in spans] + [(*x, False) for x in P.loose_spans(text, taken)]
        for kind, start, end, seed in mentions:
            name = kind, P.instance(kind, text[start:end])
            (seeds if seed else cands).add(name)
            before = [w for _, e, w in words if e <= start]
            behind = [w for b, _, w in words if b >= end]
            for side, gram in ((1, before[-1:]), (2, before[-2:]), (3, behind[:1]), (4, behind[:2])):
                if len(gram) == (side + 1) % 2 + 1:
                    edges[(side, tuple(gram), *name)] += 1
    known, scores = dict.fromkeys(seeds, 1.0), {}
    for _ in range(P.ROUNDS):
        held = defaultdict(list)
        for (side, gram, *name), n in edges.items():
            if tuple(name) in known:
                held[side, gram, name[0]].append(n * known[tuple(name)])
        sure = {p: min(1.0, round(sum(x) / total[p[1]], 9)) for p, x in held.items() if len(x) >= P.SUPPORT}
        sure = {p: c for p, c in sure.items() if c >= P.CONFIDENCE}
        doubt = defaultdict(float)
        for (side, gram, *name), _n in edges.items():
            if tuple(name) in cands - seeds and (side, gram, name[0]) in sure:
                doubt[tuple(name)] += math.log(1 - min(sure[side, gram, name[0]], 0.999))
        new = {n: round(1 - math.exp(d), 9) for n, d in doubt.items()}
        new = {n: s for n, s in new.items() if s >= P.ACCEPTED}
        best = {}
        for (kind, text), s in new.items():
            best[text] = max(best.get(text, (-1, 0)), (s, -kind))
        new = {(-k, t): s for t, (s, k) in best.items()}
        if len(new) == len(scores):
            scores = new
            break
        scores = new
        known = dict.fromkeys(seeds, 1.0) | new
    return set(seeds) | set(scores)


def expected(docs):
    known = discovered(docs)
    out = []
    for doc, text in docs:
        text = text or ""
        mine = base(text)
        taken = sorted((s, e) for _, s, e in mine)
        more = [(P.KINDS[k], s, e) for k, s, e in P.loose_spans(text, taken) if (k, P.instance(k, text[s:e])) in known]
        counts = Counter(k for k, _, _ in mine)
        digest = hashlib.sha256(written(mine).encode()).hexdigest()
        out.append((doc, *(counts[k] for k in PATTERNS), digest, written(set(mine + more)), len(set(more))))
    return sorted(out, key=str)


def _docs():
    rng = random.Random(11)
    words = "the of and wind house river stone über läuft 12 3.5 tree".split()

    def filler(n):
        return " ".join(rng.choice(words) for _ in range(n))

    docs = [(i, filler(30)) for i in range(60)]
    for i in range(8):
        docs.append((100 + i, f"{filler(6)} write to user{i}@mail{i}.example.com for {filler(5)}"))
        docs.append((200 + i, f"{filler(6)}\nCard number: {card(rng)}, {filler(5)}"))
        docs.append((300 + i, f"{filler(4)} call me at +1 (555) 123-45{i}7 today {filler(3)}"))
        docs.append((400 + i, f"{filler(4)} host 10.0.{i}.7 {filler(3)}"))
    docs += [
        (500, f"{filler(5)} write to jane(at)home[dot]org for {filler(3)}"), (501, f"{filler(5)} Card number {card(rng, False)} {filler(3)}"),
        (502, f"{filler(5)} call me at (555) 987-6543 today"), (503, f"{filler(5)} host 10.0.300.7 or host fe80::1:2 {filler(3)}"),
        (504, "my new line is (555) 987-6543 now"), (505, "my new line is 555 222 3333 now"), (506, "write to root@localhost for"),
        (507, "call me at 15551234507"), (508, "in 2024 there were 1234567 houses and 4111111111111 trees"), (509, None), (510, ""),
        (None, "call me at (555) 987-6543 today"), (None, "call me at (555) 987-6543 today"), (511, "🙂 a@b.co 🙂 call me at 555.111.2222 today"),
        (512, "+49 30 1234567 " * 4000), (513, "write to the house"), (514, "x" * 50_000),
    ]
    return docs


def _frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 5) for d, t in docs], "doc_id long, text string, spans string, n_email int")


def test_equals_brute_force(spark):
    docs = _docs()
    found = sorted(map(tuple, P.report(P.find_identifiers(_frame(spark, docs))).collect()), key=str)
    assert found == expected(docs)
    added = {r[0]: r[-2] for r in found if r[-1]}
    # patterns find unseen identifiers of each kind, and no plain numbers
    assert {500, 501, 502, 503, 506, 511, None} <= set(added) and 508 not in added and 505 not in added
    # known in another place, the same number is found without its pattern
    assert added[504].startswith("phone:")


def test_patterns_are_what_the_texts_say(spark):
    frame = _frame(spark, _docs())
    extracted = P.materialise(P.extract(frame), "extracted")
    graph = P.pattern_graph(frame, extracted)
    seeds = graph.where("seed").selectExpr("kind", "instance", "1D score").distinct()
    words = {(P.KINDS[r.kind], r.side, r.words) for r in P.confident_patterns(graph, seeds).collect()}
    assert {("email", 2, "write to"), ("card", 1, "number"), ("phone", 2, "me at"), ("ip", 1, "host")} <= words
    assert not any(w == "the" for _, _, w in words)


def test_copies_do_not_make_a_pattern(spark):
    docs = [(i, "see also a@b.org here") for i in range(50)] + [(99, "see also c@home here")]
    found = {r.doc_id: r.n_added for r in P.report(P.find_identifiers(_frame(spark, docs))).collect()}
    assert not any(found.values())


@pytest.mark.parametrize("docs", [[], [(None, None)], [(1, "call 5551234567 now")]])
def test_few_rows(spark, docs):
    found = sorted(map(tuple, P.report(P.find_identifiers(_frame(spark, docs))).collect()), key=str)
    assert found == expected(docs)


def test_table_of_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, P.op13_bootstrapped_contexts(spark, path).collect()), key=str) == expected(docs)
