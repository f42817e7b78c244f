"""Ranked search, conversation repair and mixing against plain versions, at their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from txnweave.llm import conversations as C
from txnweave.llm import mixing, search

from .conftest import LOW

# --- op11 ------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    texts = [(i, Counter(WORD.findall((t or "").translate(LOW)))) for i, t in docs]
    n_docs, total = sum(1 for _, c in texts if c), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        asked = Counter(WORD.findall((text or "").translate(LOW)))
        scored = []
        for doc, c in texts:
            n = sum(c.values())
            score = 0
            for t, times in asked.items():
                if c[t]:
                    m = 100 - 75 + (75 * n * n_docs) // total
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.fixture(params=[(search.BLOCK, search.LEAF, search.GROUP_BYTES), (40, 1, 200), (300, 3, search.GROUP_BYTES)])
def sizes(request, monkeypatch):
    """Also many small blocks, splits down to one document, and several groups of queries."""
    for name, value in zip(("BLOCK", "LEAF", "GROUP_BYTES"), request.param, strict=True):
        monkeypatch.setattr(search, name, value)


def test_search_equals_plain(spark, docs, items, sizes):
    got = search.search(docs, items).collect()
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == want


def test_search_ties_and_copies(spark, sizes):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(300)] + [(1000 + i, "w1 w2 w3 Same text") for i in range(200)] + [(None, "w1 w2 w3 same TEXT"), (5, None), (5, "w7 w7")]
    rng.shuffle(rows)
    asked = [(1, "w1 w2 w3 same"), (2, "w1 w1 w7 absent"), (3, "nothing here"), (4, None), (5, ""), (1, "w1 w2 w3 same"), (None, " ".join(words * 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = search.search(docs, spark.createDataFrame(asked, "item_id long, text string")).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search(rows, asked)


def test_search_empty_tables_and_other_ids(spark, docs, items, empty):
    assert search.search(empty, items).collect() == []
    assert search.search(docs, items.where("false")).collect() == []
    named = spark.createDataFrame([("b", "one two", 1), ("a", "one two", 2)], "doc string, body string, score long")
    got = search.search(named, spark.createDataFrame([("q", "two")], "q string, t string"), 5, "doc", "body", "q", "t").collect()
    assert [(r.q, r["rank"], r.doc) for r in sorted(got, key=lambda r: r["rank"])] == [] or {r.doc for r in got} == {"a", "b"}


def test_range_maxima():
    import numpy as np

    rng = np.random.default_rng(0)
    doc, term = np.repeat(np.arange(50), 4), np.tile(np.arange(4), 50)
    block = search.Block(np.full(50, 9), doc, term, rng.integers(1, 9, 200), np.array([5, 0, 3, 7]), 50, 450)
    lo = rng.integers(0, 200, 500)
    hi = np.minimum(lo + rng.integers(0, 51, 500), 200)
    place, most = block.best(lo, hi)
    for a, b, p, m in zip(lo, hi, place, most, strict=True):
        part = block.impact[a:b]
        assert m == (part.max() if len(part) else 0)
        assert not len(part) or (block.impact[p] == m and p == a + int(part.argmax()))


# --- op12 ------------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(original, damaged):
    """All least-cost scripts by recursion over (row, state); the least string of those."""
    groups = defaultdict(list)
    for r in damaged:
        groups[r[0]].append(r)
    results = []
    for conv in {r[0] for r in original}:
        rows = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in rows:
            said = text.strip(BLANKS)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        n = len(rows)
        after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        full = {"u": "user", "a": "assistant"}
        best = {("end", s): (0, "", ()) if s in ("", "a") else None for s in ("", "s", "u", "a")}

        def options(i, s, inserts, best):
            if i < n:
                nxt = lambda t: best[(i + 1, t)]
                if nxt(s):
                    c, a, lines = nxt(s)
                    yield c + 4, "D" + a, lines
                if faults[i] not in ("blank", "duplicate"):
                    extra = 3 * (faults[i] == "truncated")
                    t = after.get((s, rows[i][2][:1]))
                    if t and nxt(t):
                        c, a, lines = nxt(t)
                        yield c + extra, "K" + a, (f"{rows[i][2]}:{rows[i][3]}", *lines)
                    for role in "ua":
                        t = after.get((s, role))
                        if t and nxt(t):
                            c, a, lines = nxt(t)
                            yield c + extra + 3, "R" + a, (f"{full[role]}:{rows[i][3]}", *lines)
            elif s in ("", "a"):
                yield 0, "", ()
            if inserts:
                for role in "ua":
                    t = after.get((s, role))
                    if t:
                        for c, a, lines in options(i, t, inserts - 1, best):
                            yield c + 3, "I" + a, (f"{full[role]}:", *lines)

        for i in range(n, -1, -1):
            for s in ("", "s", "u", "a"):
                best[(i, s)] = min(options(i, s, 3, best), default=None)
        cost, audit, lines = best[(0, "")]
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        results.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(results)


def conversation_rows(seed, n, convs):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle", " "]
    texts = ["Hi.", "What?", "no end", "ok!", " . ", "", "  \n", None, "Ümlaut.", "a\nb?"]
    return [(rng.choice(convs), rng.choice([None, *range(60)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"{rng.choice('abc')}{rng.randrange(99)}{rng.choice(['.', '?', '', ' '])}") for _ in range(n)]


@pytest.mark.parametrize("chunk", [1024, 8])
def test_repair_equals_plain(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = conversation_rows(1, 350, [None, 7, 7, 7, *range(40)]) + [(99, None, None, None), (98, 1, "user", "x."), (98, 1, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kinds", F.lit(1))
    got = C.repaired(df, C.damage(df)).collect()
    assert Counter(tuple(r) for r in got) == plain_repair(rows, plain_damage(rows))


def test_one_hot_conversation(spark, monkeypatch):
    """One conversation over many chunks equals one walk over all its rows."""
    rows = conversation_rows(2, 1500, ["hot"]) + conversation_rows(3, 40, ["a", "b"])
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    whole = Counter(tuple(r) for r in C.repair(df).collect())
    monkeypatch.setattr(C, "CHUNK", 32)
    assert Counter(tuple(r) for r in C.repair(df).collect()) == whole == plain_repair(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repaired(df, C.damage(df)).collect() == []


def test_checkpoints_keep_the_walk():
    """The walk by checkpoints equals one that keeps all vectors, from each state."""
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 5, 17, 64, 200):
        kinds = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(n))
        vectors = [C.END]
        for k in reversed(kinds):
            vectors.append(C.step(k, vectors[-1]))
        vectors.reverse()
        for start in range(4):
            s, out = start, []
            for i, k in enumerate(kinds):
                some, s = C.letters(k, vectors[i], vectors[i + 1], s)
                out.append(some)
            assert C.walk(kinds, C.END, start) == (out, s, vectors[0][start])


# --- op13 ------------------------------------------------------------------------


def water(sizes, weights, share, epochs):
    """Clamp and share again until none is above."""
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed and w > 0 and sizes[s] > 0}
        left = total - sum(fixed.values())
        target = {s: left * w / sum(free.values()) for s, w in free.items()}
        above = {s for s in target if target[s] > epochs * sizes[s] + 1e-9}
        if not above:
            return fixed | target
        fixed |= {s: epochs * sizes[s] for s in above}


def mixed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "target": F.lit(1)})
    return mixing.mix_sources(df, **more).collect()


def test_mix_meets_its_targets(spark):
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]) if i % 50 else None, rng.choice(["a", "a", "a", "a", "b", "é", "z", None, f"s{i % 23}"])) for i in range(3000)] + [(None, "x y", "a"), (None, "x y", "a"), (3, "long " * 20000, "z")]
    for share in (1.5, 0.3, 1.95, 2.0):
        got = mixed(spark, rows, share=share)
        assert Counter(mixed(spark, rows, share=share)) == Counter(got) and len(got) == len(rows)
        sizes = Counter()
        for _, text, source in rows:
            sizes[source] += len((text or "").split())
        named = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(named)}, share, 2)
        taken = Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, want.get(r.source, 0), rel_tol=1e-9)
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want.get(s, 0)) <= 1 for s in sizes)


def test_mix_by_a_table_of_weights(spark):
    rows = [(i, "one two three", s) for i, s in enumerate("aaaabbbccd")]
    weights = spark.createDataFrame([("a", 0.5), ("b", 2.5), ("c", 0.0)], "source string, weight double")
    got = mixed(spark, rows, weights=weights, share=0.5, epochs=3)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    want = water({"a": 12, "b": 9, "c": 6, "d": 3}, {"a": 0.5, "b": 2.5}, 0.5, 3)
    assert all(abs(taken[s] - want.get(s, 0)) <= 1 for s in "abcd")
    assert all(r.target == 0 for r in got if r.source in "cd")


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [(r.size, r.taken, r.target) for r in mixed(spark, [(1, None, None), (2, "", "a")])] == [(0, 0, 0.0)] * 2


def test_mix_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 4}") for i in range(500)], "doc_id long, text string, source string")
    one, many = (Counter(mixing.mix_sources(df.repartition(n)).collect()) for n in (1, 9))
    assert one == many
