"""Each operator against a plain version, on rows with nulls, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txnweave.llm import archives, bpe, decontaminate, lattice_lm, line_dedup, minhash, quality_rules, secrets, sharding, token_files
from txnweave.llm.common import new_path

from .conftest import LOW, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def key(r):
    return tuple((x is None, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


# --- line dedup ---------------------------------------------------------------


def plain_line_dedup(rows):
    lines = []
    for d, (i, t) in enumerate(rows):
        for no, raw in enumerate(t.split("\n") if t is not None else []):
            w = WORD.findall(raw)
            if len(w) >= line_dedup.MIN_TOKENS:
                m = ["<*>" if re.search("[0-9]", x) else x for x in w]
                lines.append((d, i, t, no, (len(m), *m[: line_dedup.DEPTH]), w, m))
    counts = collections.Counter((leaf, p, x) for *_, leaf, w, m in lines for p, x in enumerate(m))
    groups = collections.defaultdict(list)
    for d, i, t, no, leaf, w, m in lines:
        form = tuple(x if x != "<*>" and counts[leaf, p, x] >= line_dedup.MIN_DOCS else "<*>" for p, x in enumerate(m))
        if sum(x != "<*>" for x in form) >= line_dedup.MIN_CONSTANT * len(form):
            groups[leaf, form].append((i, t, no, d))
        elif len(w) >= line_dedup.LONG_TOKENS:
            groups[leaf, " ".join(w)].append((i, t, no, d))
    sizes, shared = collections.Counter(), collections.Counter()
    for i, t, _, n in {(i, t, no, len(w)) for _, i, t, no, _, w, _ in lines}:
        sizes[i, t] += n
    pair = lambda leaf, members: frozenset((i, t) for i, t, _, _ in members) if leaf[0] >= line_dedup.LONG_TOKENS else frozenset()
    for (leaf, _), members in groups.items():
        shared[pair(leaf, members)] += leaf[0]
    gone = collections.defaultdict(set)
    for (leaf, _), members in groups.items():
        two = pair(leaf, members)
        if len(two) == line_dedup.LONG_DOCS and line_dedup.VERSION * shared[two] >= min(sizes[x] for x in two):
            continue
        enough = line_dedup.LONG_DOCS if leaf[0] >= line_dedup.LONG_TOKENS else line_dedup.MIN_DOCS
        if len({(i, t) for i, t, _, _ in members}) >= enough:
            first = min((x[:3] for x in members), key=lambda x: (x[0] is not None, x[0] or 0))
            for i, t, no, d in members:
                if (i, t, no) != first:
                    gone[d].add(no)
    return [(i, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[d])) for d, (i, t) in enumerate(rows)]


def test_line_dedup(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = line_dedup.drop_recurring_lines(spark, docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    got = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
    # The four rows of one text and its exact copies tie on nothing but the id; null ids come first.
    same(got, plain_line_dedup(rows))
    assert out.agg(F.sum("__n_dropped")).first()[0] > 0


def test_line_dedup_alone_and_empty(spark, empty):
    assert line_dedup.drop_recurring_lines(spark, empty).count() == 0
    few = spark.createDataFrame([(1, "a b c d\nq"), (2, "a b c d")], "doc_id long, text string")
    assert {r.text for r in line_dedup.drop_recurring_lines(spark, few).collect()} == {"a b c d\nq", "a b c d"}


def test_line_dedup_long_passages(spark):
    """A passage of fifty tokens or more goes from the second of two documents, a shorter one stays; other numbers are another passage."""
    passage = lambda n, mark="x": " ".join(f"{mark}{i}" if i % 2 else f"w{'abcdefgh'[i % 8]}" for i in range(n))
    own = lambda i: "\n".join(f"line {j} of {i} says {chr(97 + i)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(40))
    rows = [(1, own(1) + "\n" + passage(60)), (2, passage(60) + "\n" + own(2)), (3, own(3) + "\n" + passage(60, "y")), (4, own(4) + "\n" + passage(49)), (5, passage(49) + "\n" + own(5))]
    # Two versions of one document; a null id and a repeated row.
    rows += [(6, "six " * 8 + "\n" + passage(90, "z")), (7, "seven " * 9 + "\n" + passage(90, "z")), (None, own(8) + "\n" + passage(55, "q")), (9, own(9) + "\n" + passage(55, "q")), (9, own(9) + "\n" + passage(55, "q"))]
    got = [(r.doc_id, r.text) for r in line_dedup.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    same(got, plain_line_dedup(rows))
    texts = dict(got)
    assert [i for i, t in rows if texts[i] != t] == [2, 9, 9] and passage(60) not in texts[2] and passage(55, "q") not in texts[9]


def test_line_dedup_names(spark):
    """Columns with the operator's own names."""
    names = ["__id", "__key", "__no", "id", "key", "no", "k", "lines", "c0", "leaf", "__n_lines", "text"]
    rows = [(i, *["x"] * 10, "a b c d e\nown" + str(i)) for i in range(3)]
    out = line_dedup.drop_recurring_lines(spark, spark.createDataFrame(rows, names), id_col="__id")
    assert out.columns == [*[n for n in names if n != "__n_lines"], "__n_lines", "__n_dropped"]
    assert sorted(r.text for r in out.collect()) == ["a b c d e\nown0", "own1", "own2"]


# --- near duplicates ------------------------------------------------------------


def plain_components(rows, k=4, percent=80):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d, d == (least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)]


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(minhash.near_duplicates(spark, docs, shingle=4).collect(), plain_components(rows))
    kept = minhash.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id IN (6, 7, 8) AND text LIKE '%lorem%' AND text NOT LIKE '%x%'").count() <= 1


def test_near_duplicates_of_a_table(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in source.collect()]
    same(minhash.query(spark, "/root/testdata/sf0.001").collect(), plain_components(rows))


def test_near_duplicates_empty(spark, empty):
    assert minhash.near_duplicates(spark, empty).count() == 0


def test_chains_and_clouds(spark):
    """A chain whose ends are unlike, and a cloud around one text."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 200 - 8 * i] + [f"z{i}_{j}" for j in range(8 * i)])) for i in range(12)]
    rows += [(100 + i, " ".join([f"c{j}" if (j * 7 + i) % 40 else f"v{i}_{j}" for j in range(160)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(minhash.near_duplicates(spark, df, shingle=4).collect(), plain_components(rows))


@pytest.mark.parametrize("table", [minhash.TABLE, 0])
def test_pairs_of_large_buckets(spark, table, monkeypatch):
    """A bucket of 70 copies that no centre joins: the ten pairs edited in the same places are compared, and few others."""
    monkeypatch.setattr(minhash, "TABLE", table)
    rng = random.Random(5)
    places = [rng.sample(range(4, 296, 4), 6) for _ in range(50)] + [rng.sample(range(4, 296, 4), 7) for _ in range(10)] * 2
    rows = [(i, " ".join(f"e{i}_{j}" if j in at else f"w{j}" for j in range(300))) for i, at in enumerate(places)]
    want = plain_components(rows)
    links = {(r[0], r[2]) for r in want if not r[3]}
    assert len(links) >= 10
    mixed = spark.createDataFrame([(1, r[0], r[1], len(rows), r[0]) for r in want], "bucket long, cid long, n long, m long, comp long")
    texts = spark.createDataFrame(rows, "cid long, text string")
    pairs = {tuple(r) for r in minhash._prefix_pairs(spark, texts, mixed, 4, 80).collect()}
    assert links <= pairs and all(a > b for a, b in pairs)
    edges = {(r.a, r.b) for r in minhash.confirm_edges(spark, texts, spark.createDataFrame(list(pairs), "a long, b long"), 4, 80).where("ok").collect()}
    assert links == edges


def test_drop_near_duplicates_by_row(spark):
    """Rows that share a null or repeated id with a near copy, and are none, stay; of a group of null ids one stays."""
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:50], "x", *base[51:]])
    other = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [(3, " ".join(base)), (None, near), (None, other("a")), (9, near + " y"), (9, other("b")), (None, other("c")), (None, other("c") + " z"), (None, None), (9, "")]
    left = minhash.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {tuple(r) for r in left}
    assert got - set(rows[5:7]) == {rows[i] for i in (0, 2, 4, 7, 8)}
    assert len(left) == 6 and len(got & set(rows[5:7])) == 1


def test_drop_keeps_another_text_of_the_id(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (3, " ".join([*base[:99], "x"])), (3, " ".join(f"b{i}" for i in range(60)))]
    same(minhash.drop_near_duplicates(spark, spark.createDataFrame([*rows, rows[2]], "doc_id long, text string")).collect(), [rows[0], rows[2]])


# --- language model ---------------------------------------------------------------


def test_base_scores(spark, docs):
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = collections.Counter()
    for d, t in rows:
        if (d or 0) % 3 != 0:
            counts.update([*words(t), "\0end"])
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d is None, d or 0), len(words(t)) + 1, sum(counts[x] > 0 for x in [*words(t), "\0end"]), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*words(t), "\0end"])) for d, t in rows)
    for head in (10, 1000):  # most words by the join, and most by the broadcast table
        out = lattice_lm.score_documents(spark, docs, training, head=head)
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out.collect())
        for a, b in zip(got, want, strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_lattice_sums_all_segmentations():
    pieces = [b" a", b" ab", b"b", b"a", b"ab"]
    weights = np.log(np.array([0.1, 0.05, 0.2, 0.1, 0.07, *[0.001] * 256, 0.1]))
    lattice = lattice_lm.Lattice(pieces, weights)
    p = {**dict(zip(pieces, np.exp(weights), strict=False)), **{}}

    def marginal(word):
        if not word:
            return 1.0
        total = 0.001 * marginal(word[1:])
        return total + sum(p[x] * marginal(word[len(x) :]) for x in pieces if word.startswith(x))

    got, expected = lattice.run([b"ab", b"abab", b"zab"], np.ones(3))
    assert np.exp(got) == pytest.approx([marginal(b" ab"), marginal(b" abab"), marginal(b" zab")])
    lattice_lm.LONG, keep = 2, lattice_lm.LONG
    try:
        slow, slow_expected = lattice.run([b"ab", b"abab", b"zab"], np.ones(3))
    finally:
        lattice_lm.LONG = keep
    assert slow == pytest.approx(got) and slow_expected == pytest.approx(expected)


def test_document_scores(spark, tmp_path_factory):
    """The query with its crc32 split against plain sums over all segmentations, learning included."""
    rng = random.Random(3)
    known = ["banana", "Ban", "nab", "the", "thee", "x", "a1", "é"]
    rows = [(i, " ".join(rng.choice(known) for _ in range(rng.randrange(12))) if i % 9 else None) for i in range(40)] + [(None, "banana qq"), (4, "the"), (4, "the")]
    folder = new_path(spark, "lm")
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").write.parquet(f"{folder}/documents.parquet")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    names, first = lattice_lm.read_pieces(P.path(lattice_lm.VOCABULARY))
    number = {x: i for i, x in enumerate(names)}
    counts = collections.Counter(w for d, t in rows if not held(d) for w in words(t))
    ends = sum(not held(d) for d, _ in rows)
    n = sum(counts.values()) + ends
    p, stop = np.exp(first) * (1 - lattice_lm.FIRST_STOP), lattice_lm.FIRST_STOP

    def ways(word):
        """All segmentations as lists of piece numbers."""
        if not word:
            return [[]]
        out = [[len(names) + word[0], *rest] for rest in ways(word[1:])]
        for k in range(1, len(word) + 1):
            if word[:k] in number:
                out += [[number[word[:k]], *rest] for rest in ways(word[k:])]
        return out

    every = {w: ways(b" " + w.encode()) for w in {w for _, t in rows for w in words(t)}}
    last = -math.inf
    for _ in range(lattice_lm.MOST_ROUNDS):
        expected = np.full(len(p), 0.01)
        gained = math.log(stop)
        for w in counts:
            likely = [math.prod(p[i] for i in way) for way in every[w]]
            gained += math.log(sum(likely)) / len(counts)
            for way, x in zip(every[w], likely, strict=True):
                for i in way:
                    expected[i] += x / sum(likely)
        total = expected.sum() + len(counts) + 0.01
        p, stop = expected / total, (len(counts) + 0.01) / total
        if gained - last < lattice_lm.LEAST_GAIN * abs(gained):
            break
        last = gained
    tokens, once, twice = sum(counts.values()), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d1 = (once + 0.5) / (once + 2 * twice + 1)
    end = (ends + 1) / (n + 2)
    word = lambda w: (max(counts[w] - d1, 0) + d1 * len(counts) * stop * sum(math.prod(p[i] for i in way) for way in every[w])) / tokens
    score = lambda t: math.log10(end) + sum(math.log10((1 - end) * word(w)) for w in words(t))
    want = sorted(((d is None, d or 0), held(d), len(words(t)) + 1, n, score(t)) for d, t in rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.train_tokens, r.score) for r in lattice_lm.query(spark, folder).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def test_learning_helps_held_out_text(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = lattice_lm.crc_bucket("doc_id") == 2
    score = {}
    for rounds in (0, 2):
        out = lattice_lm.score_documents(spark, source, ~held, em_rounds=rounds).join(source.where(held).select("doc_id"), "doc_id", "left_semi")
        score[rounds] = out.agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert score[2] > score[0] + 1


def test_scores_of_nothing(spark, empty, docs):
    assert lattice_lm.score_documents(spark, empty, F.lit(True)).count() == 0
    none = lattice_lm.score_documents(spark, docs.limit(3), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none)


# --- sharding -----------------------------------------------------------------------


def test_shards(spark, docs, empty):
    names = sharding.shard_names(7)
    table = sharding.fill_table(names, 101)
    # Turn by turn, from whole preference lists.
    owner, lists = {}, [[(sharding._digest(x, "offset") + k * (sharding._digest(x, "skip") % 100 + 1)) % 101 for k in range(101)] for x in names]
    while len(owner) < 101:
        for i, wish in enumerate(lists):
            if len(owner) < 101:
                owner[next(s for s in wish if s not in owner)] = i
    assert [owner[s] for s in range(101)] == list(table)
    assert set(collections.Counter(table).values()) <= {14, 15}
    fewer = sharding.fill_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 40
    out = sharding.assign_shards(spark, docs, "doc_id", names, 101)
    assert out.count() == docs.count()
    assert out.where("doc_id = 3").select("shard").distinct().count() == 1
    assert sharding.assign_shards(spark, empty, "doc_id", names, 101).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(names, 100)


def test_shards_of_clashing_columns(spark):
    names = sharding.shard_names(7)
    df = spark.createDataFrame([(i, f"k{i}", "x", "y") for i in range(20)], "slot long, shard string, __slot string, __place string")
    by = {r[0]: (r.slot, r.shard) for r in sharding.assign_shards(spark, df.select(F.col("shard").alias("k")), "k", names, 101).collect()}
    out = sharding.assign_shards(spark, df.withColumn("k", F.col("shard")), "shard", names, 101)
    assert out.columns == ["k", "slot", "shard_id", "shard"]
    assert {r.k: (r.slot, r.shard) for r in out.collect()} == by


# --- decontamination ------------------------------------------------------------------


def plain_hits(rows, items, window=10):
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: alnum.findall((t or "").translate(LOW))
    pats = []
    for i, t in items:
        w = split(t)
        m = min(window, len(w))
        pats += [("" if i is None else str(i), tuple(w[p : p + m])) for p in range(len(w) - m + 1) if m]
    out = []
    for d, t in rows:
        w, hit, names = split(t), set(), set()
        for name, pat in pats:
            for p in range(len(w) - len(pat) + 1):
                if tuple(w[p : p + len(pat)]) == pat:
                    hit.update(range(p, p + len(pat)))
                    names.add(name)
        out.append((d, len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, docs, items, limit, monkeypatch):
    """By broadcast tables, and by the join for larger benchmarks."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = decontaminate.contamination(spark, docs, items, ["doc_id"]).collect()
    same(got, plain_hits(rows, [(r.item_id, r.text) for r in items.collect()]))
    clean = decontaminate.drop_contaminated(spark, docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(r["__n_hit"] == 0 for r in got)


def test_decontamination_without_items_or_documents(spark, docs, empty, items):
    assert decontaminate.contamination(spark, docs, items.limit(0), ["doc_id"]).where("__n_hit > 0").count() == 0
    assert decontaminate.contamination(spark, empty, items, ["doc_id"]).count() == 0


# --- encoding -----------------------------------------------------------------------


def test_encode_and_decode(spark, docs, empty):
    ids = bpe.encode(spark, docs.drop("ids"), carry=["doc_id", "text"])
    out = bpe.decode(spark, ids.withColumn("n_tokens", F.size("ids")))
    for r in out.collect():
        assert bytes(r.decoded).decode() == (r.text or "")
        assert len(r.ids_le) == 4 * r.n_tokens
    assert bpe.decode(spark, bpe.encode(spark, empty, carry=["doc_id"])).count() == 0


def test_encode_keeps_no_second_column(spark, docs):
    """docs has a column ids: the result takes its place."""
    out = bpe.encode(spark, docs)
    assert out.columns == [*[c for c in docs.columns if c != "ids"], "ids"] and out.select("ids").schema["ids"].dataType.typeName() == "array"
    again = bpe.decode(spark, out.withColumn("ids_le", F.lit("x")).withColumn("decoded", F.lit("y")))
    assert again.columns == [*out.columns[:-1], "ids_le", "decoded"]


def test_token_files(spark, docs, empty):
    out = new_path(spark, "tokens")
    token_files.write_token_files(spark, docs, out)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, out).collect()), key=lambda r: r[0])
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter(r[1:] for r in got) == want
    place = 0
    for start, _, n, _ in got:
        assert start == place
        place += n
    order = [-1 if r[1] is None else r[1] for r in got]
    assert order == sorted(order)
    assert token_files.find_documents(spark, out, [5]).count() == 2
    none = new_path(spark, "tokens")
    token_files.write_token_files(spark, empty, none)
    assert token_files.read_tokens(spark, none).count() == 0


def test_token_files_of_other_ids(spark, monkeypatch):
    """String ids, the string of an added token inside texts, and more files for more text."""
    mark = "<|endoftext|>"
    rows = [("b", f"one {mark} two"), ("a", mark), ("c", f" {mark}{mark} x"), ("é", "<|endoftext"), (None, None), ("d" * 50, f"it's{mark}" * 300), *[(f"r{i}", "word " * 500) for i in range(60)]]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, place = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        place += len(ids)
    assert 50256 in library.encode(rows[0][1], add_special_tokens=False).ids
    sizes = []
    for limit in (1 << 30, 20_000):
        monkeypatch.setattr(token_files, "FILE_BYTES", limit)
        out = new_path(spark, "tokens")
        token_files.write_token_files(spark, df, out)
        assert sorted(map(tuple, token_files.read_tokens(spark, out).collect()), key=lambda r: r[1]) == want
        assert [r.doc_id for r in token_files.find_documents(spark, out, ["é"]).collect()] == ["é"]
        sizes.append(spark.read.orc(out).select("file_no").distinct().count())
    assert sizes[0] == 1 and sizes[1] > 4


# --- quality rules ----------------------------------------------------------------------


def plain_metrics(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_metrics(spark, docs, labels, empty):
    out = quality_rules.judge(spark, docs, labels.select("doc_id", "quality"), ["doc_id", "text"]).collect()
    assert len(out) == docs.count()
    for r in out:
        m = plain_metrics(r.text)
        assert (r["__q_n_words"], r["__q_word_chars"], r["__q_n_symbols"], r["__q_n_dup_lines"], r["__q_n_repeat_words"]) == m
        assert r["__base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert r["__kept"] == (not r["__base_failed"])  # too few labels to certify any cutoff
    assert quality_rules.judge(spark, empty, labels, ["doc_id"]).count() == 0
    assert quality_rules.filter_documents(spark, docs, labels.limit(0)).columns == docs.columns


def test_binomial_tail(spark):
    for k, n, p in ((0, 10, 0.3), (3, 40, 0.2), (17, 2000, 0.02), (0, 5000, 0.02)):
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(exact, rel=1e-9)


def test_certified_cutoff(spark):
    """Bad texts go, and cutoffs that would reject good ones are not certified."""
    good = [(i, " ".join(f"word{j}x{i}" for j in range(30)), "en") for i in range(1500)]
    bad = [(10000 + i, " ".join(f"w{j}### " for j in range(30)), "en") for i in range(50)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i, _, _ in good], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.filter_documents(spark, df, marks).collect()}
    assert kept == {i for i, _, _ in good}


def plain_cutoffs(rows, good, alpha, delta):
    """rows: (id, stratum, text, {rule: signal}) that pass the base rules. One row for each text of a stratum."""
    held = collections.defaultdict(lambda: ([], []))
    for stratum, text, x in {(s, t): (s, t, x) for i, s, t, x in rows if i in good}.values():
        held[stratum][hashlib.md5(text.encode()).digest()[0] % 2].append(x)
    grid, choice, tested = quality_rules.GRID, {}, {}
    for stratum, (a, b) in held.items():
        for rule, cuts in grid.items():
            fit = [k for k, cut in enumerate(cuts) if sum(x[rule] > cut for x in a) <= len(a) * alpha / len(grid)] if a else []
            if fit:
                choice[stratum, rule] = fit[0]
        mine = {rule: k for (s, rule), k in choice.items() if s == stratum}
        if b and mine:
            for level in range(quality_rules.LEVELS):
                cuts = {rule: grid[rule][k + level] for rule, k in mine.items() if k + level < len(grid[rule])}
                tested[stratum, level] = (len(b), sum(any(x[rule] > cut for rule, cut in cuts.items()) for x in b), cuts)
    best = {}
    for (stratum, level), (n, k, cuts) in sorted(tested.items()):
        p = sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
        if p <= delta / len(tested):
            best.setdefault(stratum, cuts)
    return {(stratum, rule, cut) for stratum, cuts in best.items() for rule, cut in cuts.items()}


def test_cutoffs_by_stratum(spark):
    """Enough clean labels, labels that need leniency, and too few; a null stratum; against a plain version."""
    rng = random.Random(11)
    rows = []
    for stratum, n, noise in (("a", 700, 0.0), ("b", 900, 0.012), ("c", 60, 0.0), (None, 800, 0.004)):
        for _ in range(n):
            extra = "### " * 12 if rng.random() < noise else "!! " * 9 if rng.random() < noise else ""
            rows.append((len(rows), " ".join(f"word{rng.randrange(10**6)}" for _ in range(20)) + " " + extra + ("UPPER" if rng.random() < 0.1 else ""), stratum))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = {i for i, _, _ in rows if i % 19}
    marks = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in range(0, len(rows), 19)], "doc_id long, quality int")
    scored = quality_rules._scored(df, ["doc_id", "lang"], "text").cache()
    texts = {i: t for i, t, _ in rows}
    held = scored.where(~quality_rules.base_failed()).select("doc_id", F.coalesce("lang", F.lit("")).alias("s"), *[x.alias(r) for r, x in quality_rules.signals().items()]).collect()
    for alpha, delta in ((0.02, 0.05), (0.05, 0.2)):
        got = {tuple(r) for r in quality_rules.fit_cutoffs(spark, scored, marks, "doc_id", "lang", alpha, delta).collect()}
        want = plain_cutoffs([(r.doc_id, r.s, texts[r.doc_id], r.asDict()) for r in held], good, alpha, delta)
        assert got == want
        assert {s for s, _, _ in want} >= {"a"} and "c" not in {s for s, _, _ in want}
    # Copies of labelled texts, under ids of their own, change no cutoff.
    more = [(10_000 + k, rows[i][1], rows[i][2]) for k, i in enumerate([*range(40)] * 30)]
    twice = quality_rules._scored(spark.createDataFrame(rows + more, df.schema), ["doc_id", "lang"], "text")
    marked = marks.union(spark.createDataFrame([(i, 1) for i, _, _ in more], marks.schema))
    all_good = good | {i for i, _, _ in more}
    copied = {tuple(r) for r in quality_rules.fit_cutoffs(spark, twice, marked, "doc_id", "lang").collect()}
    once = [(r.doc_id, r.s, texts[r.doc_id], r.asDict()) for r in held]
    fresh = {rows[i][1] for i in range(40)}
    assert copied == plain_cutoffs(once, {i for i, t, _ in rows if i in good or t in fresh}, quality_rules.ALPHA, quality_rules.DELTA) and all_good


def test_certified_rules_equal_sql(spark):
    """At a scale where levels are certified and documents go by them."""
    import duckdb

    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = {(r[0], r[-2], r[-1]) for r in con.execute(quality_rules.ORACLE_SQL).fetchall()}
    got = {(r.doc_id, r.base_failed, r.kept) for r in quality_rules.query(spark, folder).collect()}
    assert got == want
    assert sum(not failed and not kept for _, failed, kept in got) > 100


# --- archives -------------------------------------------------------------------------


def test_archives(spark, tmp_path_factory):
    big = "é<p>" * 100
    pages = [(1, "http://a/x y", big), (2, None, big), (5, "http://b", "short"), (6, "http://b", "short"), (7, "u", None), (8, "http://c\n", "\n\nWARC/1.1\r\n\r\n" + big), (2, None, big), (None, "http://n", big), (9, "", "\r\n" * 80)]
    folder = new_path(spark, "pages")
    spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string").write.parquet(f"{folder}/pages.parquet")
    got = archives.query(spark, folder).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= archives.MIN_REVISIT and i is not None and i != first[h or ""]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    same(got, want)
    none = new_path(spark, "pages")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{none}/pages.parquet")
    assert archives.query(spark, none).count() == 0


def test_archives_of_other_pages(spark):
    """String ids, one id with two payloads, a page of 50 MB; the files hold what WARC asks for."""
    big, huge = "<p>text</p>" * 30, "0123456789abcde\n" * (50 << 16)
    pages = [("p:1", "http://a", big), ("p 2", "http://b", big), ("p 2", "http://b", big + "!"), ("p é", "http://c", huge), ("q", "http://d", huge), ("z", "http://a", "x" * 200)]
    folder = new_path(spark, "pages")
    spark.createDataFrame(pages, "page_id string, url string, html string").write.parquet(f"{folder}/pages.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(h), sha(h), "response", None) for i, _, h in pages]
    want[0] = ("p:1", len(big), sha(big), "revisit", "p 2")
    want[4] = ("q", len(huge), sha(huge), "revisit", "p é")
    same(archives.query(spark, folder).collect(), want)
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    small = spark.read.parquet(f"{folder}/pages.parquet").where("length(html) < 1000")
    archives.write_arc(spark, small, arc, 2)
    archives.convert_arc(spark, arc, warc, 2, "string")
    heads = []
    for raw in archives.read_archives(spark, warc).collect():
        heads += [f for f, _ in archives.parse_warc(archives._unpack(bytes(raw.content)))]
    kinds = collections.Counter(f["warc-type"] for f in heads)
    assert kinds["warcinfo"] == len(heads) - 4 and kinds["revisit"] == 1
    assert len({f["warc-record-id"] for f in heads}) == len(heads)
    revisit = next(f for f in heads if f["warc-type"] == "revisit")
    first = next(f for f in heads if f["warc-record-id"] == revisit["warc-refers-to"])
    assert (revisit["warc-refers-to-target-uri"], revisit["warc-refers-to-date"]) == (first["warc-target-uri"], first["warc-date"])
    assert revisit["warc-payload-digest"] == first["warc-payload-digest"]


def test_arc_versions():
    for version in (1, 2):
        raw = b"\n".join([archives.version_block(version, "f.arc"), archives.arc_record(version, "http://a b", "20200101000000", b"HTTP/1.1 200 OK\r\n\r\nbody\n\n", "f.arc"), archives.arc_record(version, "http://c", "x", b"", "f.arc"), b""])
        first, second = archives.parse_arc(raw)
        assert first["url"] == "http://a%20b" and archives.split_http(first["block"])[2] == b"body\n\n" and second["block"] == b""
    with pytest.raises(ValueError, match="declares"):
        list(archives.parse_arc(archives.version_block(1, "f.arc") + b"\n" + archives.arc_record(1, "http://a", "x", b"body", "f.arc")[:-2]))
    assert archives.warc_date("20200102030405") == "2020-01-02T03:04:05Z" and archives.warc_date("x") == "1970-01-01T00:00:00Z"


# --- secrets --------------------------------------------------------------------------


def plain_base(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(spans)]


def test_base_spans(spark, docs, empty):
    for r in secrets.scan(spark, docs, ["doc_id", "text"]).collect():
        assert [(s.kind, s.start, s.end) for s in r["__spans"] if s.kind != "lexed"] == plain_base(r.text)
    assert secrets.scan(spark, empty, ["doc_id"]).count() == 0


LEXED = [
    ("db_pwd: 'S3cr3tPa55!x'", ["S3cr3tPa55!x"]),
    ("raw = 'q9Zt7Lp2Xw4K'\ndb_pwd = raw", ["q9Zt7Lp2Xw4K"]),
    ("db_pwd = raw\nraw = 'q9Zt7Lp2Xw4K'", ["q9Zt7Lp2Xw4K"]),
    ("auth_key = 'q9Zt7Lp2' + \"Xw4Kr8\"", ["q9Zt7Lp2", "Xw4Kr8"]),
    ("export DB_PASSPHRASE=q9Zt7Lp2Xw4K", ["q9Zt7Lp2Xw4K"]),
    ('{"clientCredential": "q9Zt7Lp2Xw4K"}', ["q9Zt7Lp2Xw4K"]),
    ("db_pwd = 'changeme'", []),
    ("title = 'q9Zt7Lp2Xw4K'", []),
    ("db_pwd = '${OTHER}'", []),
    ("a = b\nb = a\ndb_pwd = a", []),
    ("conf['db_pwd'] = 'q9Zt7Lp2Xw4K'", ["q9Zt7Lp2Xw4K"]),
    ('<db:passphrase kind="x"> q9Zt7Lp2Xw4K </db:passphrase>', ["q9Zt7Lp2Xw4K"]),
    ("url=http://h/p?x=1&db_pwd=q9Zt7Lp2Xw4K&y=2", ["q9Zt7Lp2Xw4K"]),
    ("auth_key: aa1:bb2:cc3:dd4x", ["aa1:bb2:cc3:dd4x"]),
    ("env:DB_PWD=q9Zt7Lp2Xw4K==", ["q9Zt7Lp2Xw4K=="]),
    ("x0 = 'q9Zt7Lp2Xw4K'\n" + "\n".join(f"x{i} = x{i - 1}" for i in range(1, 3000)) + "\ndb_pwd = x2999", ["q9Zt7Lp2Xw4K"]),
    ("x0 = 'q9Zt7Lp2'\n" + "\n".join(f"x{i} = x{i - 1} + x{i - 1}" for i in range(1, 300)) + "\ndb_pwd = x299", ["q9Zt7Lp2"]),
    ("db_pwd = " + " + ".join(f"'q9Zt{i:03}'" for i in range(100)), [f"q9Zt{i:03}" for i in range(100)]),
    ("client_pwd = " + "aB3x9" * 2000, ["aB3x9" * 2000]),
]


@pytest.mark.parametrize(("text", "want"), LEXED)
def test_lexed_spans(text, want):
    assert [text[a:b] for kind, a, b in secrets.find_spans(text) if kind == "lexed"] == want


@pytest.mark.parametrize("part", ["a=", "db_pwd=", "db_pwd:", "x/db_pwd=", "a:db_pwd=", "db_pwd='a' + ", "'db_pwd", "<db_pwd>", "&db_pwd=ab1", "db_pwd\t", "k = 'a' 'b' "])
def test_lexing_is_linear(part):
    began = time.process_time()
    secrets.lexed_spans(part * (400_000 // len(part)))
    assert time.process_time() - began < 20  # hours, were it quadratic


LONG = "aB3" + "x9Kq" * 1500


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('api_access = "aB3dE5fG7hJ9"', "aB3dE5fG7hJ9"), ('a-p-i-k-e-y = "aB3dE5fG7hJ9"', "aB3dE5fG7hJ9"), ("client_pwd" + " " * 12 + '= "Zx9kQ2mB7"', "Zx9kQ2mB7"),
        ("client_pwd =" + "\t" * 12 + '"Zx9kQ2mB7"', "Zx9kQ2mB7"), (f'client_pwd = "{LONG}"', LONG), ("n" * 90 + '_pwd = "Zx9kQ2mB7"', "Zx9kQ2mB7"), ('client_pwd = "Zx9k"' + " " * 12 + '+ "Q2mB7w"', "Zx9k"),
    ],
)
def test_lexed_without_bounds(text, value):
    at = text.index(value)
    assert (at, at + len(value)) in secrets.lexed_spans(text)


def test_schema_is_shared(docs):
    assert len(docs.columns) == len(SCHEMA.split(","))
