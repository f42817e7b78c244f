"""Damage to conversations and their repair by a square-root checkpointed DP.

A conversation's roles must read ``(s?(ua)+)?``: nothing, or user and assistant
in turn, after a system message or not. Each row is kept (cost 0), given the role
user or assistant (3) or deleted (4, the only choice for blank and repeated
rows), and rows user or assistant with empty text may be inserted anywhere (3); a
truncated row that stays costs 3 more. Of the cheapest edit scripts the one whose
letters D, I, K, R are least in ASCII order is taken.

Four states are enough: start, after system, after user, after assistant. A state
and a letter leave one choice (the role that an insertion or a new role can have
follows from the state), so least costs from a row to the end are a vector of four
numbers, and the least script is found walking forward along letters that keep the
cost. Vectors are stored at every sqrt(n)-th row only; the walk computes each block
between two of them again.

Rows stand in the order conversation, turn (nulls first), role, digest of the text,
copy, in chunks of ``CHUNK`` rows (``operators.ranges``), whatever conversations
they belong to: a conversation that holds a third of all rows is many chunks. A
conversation inside one chunk is done there. The first and last of a chunk may go
on elsewhere, and are carried as segments: each segment's 4 x 4 matrix of least
costs, folded from the last segment back, gives the vector at each segment's end
(these are checkpoints too); with it a segment walks from each of the four states
it may begin in; where it then ends is folded forward to find the state it does
begin in, and the segment walks once more from there. Folds read a few hundred bytes
a segment in order, in constant memory. Rows equal to an earlier one are found
inside a chunk by their contents, across segments by a SHA-256 digest. The digest
of a repaired conversation reads its text in order, as a SHA-256 does: one task
streams it, part by part, and holds one part.

Defined cases: a null role or text is one blank (so such a text is blank); null
conversations are one conversation with a null id; null turns come first and are no
gap; rows equal in all columns are repeats; an empty table gives an empty result;
columns other than the four named are ignored; a conversation of which nothing is
left has zeros, an empty audit and the digest of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators import ranges
from .common import materialize

#: Rows of one chunk.
CHUNK = 1024

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: 0 start, 1 after system, 2 after user, 3 after assistant. The state that an inserted or renamed row leads to.
NEED = (2, 2, 3, 2)
ROLE = (None, None, "user", "assistant")
FAR = 1 << 60
#: The state after keeping a row of an initial (s, u, a, other) in each state; -1: not allowed.
NEXT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
MUST_GO = 8
END = (0, 6, 3, 0)

Vector = tuple[int, int, int, int]


def initial(role: str) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)


def step(kind: int, b: Vector) -> Vector:
    """Least costs before a row, from those after it. kind: initial + 4 if truncated, or MUST_GO."""
    c = [DELETE + x for x in b]
    if kind != MUST_GO:
        extra = TRUNCATED if kind >= 4 else 0
        after = NEXT[kind & 3]
        for s in range(4):
            c[s] = min(c[s], REROLE + extra + b[NEED[s]], extra + b[after[s]] if after[s] >= 0 else FAR)
    two, three = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + two), min(c[1], INSERT + two), two, three


def letters(kind: int, here: Vector, b: Vector, s: int) -> tuple[str, int]:
    """The least tight letters from before a row to after it, and the state then."""
    out = ""
    while True:
        want = here[s]
        if DELETE + b[s] == want:
            return out + "D", s
        if INSERT + here[NEED[s]] == want:
            out, s = out + "I", NEED[s]
            continue
        extra = TRUNCATED if kind >= 4 else 0
        after = NEXT[kind & 3][s] if kind != MUST_GO else -1
        if after >= 0 and extra + b[after] == want:
            return out + "K", after
        return out + "R", NEED[s]


def walk(kinds: bytes, end: Vector, s: int) -> tuple[list[str], int, int]:
    """(letters for each row, state after the last, cost). Vectors are kept at every sqrt(n)-th row."""
    n = len(kinds)
    width = max(isqrt(n), 1)
    marks, b = {n: end}, end
    for i in range(n - 1, -1, -1):
        b = step(kinds[i], b)
        if i % width == 0:
            marks[i] = b
    cost, out = b[s], []
    for lo in range(0, n, width):
        hi = min(lo + width, n)
        block = [marks[hi]]
        for i in range(hi - 1, lo, -1):
            block.append(step(kinds[i], block[-1]))
        block.append(marks[lo])
        for i in range(lo, hi):
            done, s = letters(kinds[i], block[hi - i], block[hi - i - 1], s)
            out.append(done)
    return out, s, cost


def closing(s: int) -> str:
    """Insertions after the last row."""
    return {0: "", 1: "II", 2: "I", 3: ""}[s]


def lines(script: str, role: str, text: str, s: int) -> tuple[list[str], int]:
    """The repaired role:text lines that a row's letters leave, and the state then."""
    out = []
    for letter in script:
        if letter == "K":
            out.append(f"{role}:{text}")
            s = NEXT[initial(role)][s]
        elif letter != "D":
            s = NEED[s]
            out.append(f"{ROLE[s]}:{text if letter == 'R' else ''}")
    return out, s


def matrix(kinds: bytes) -> list[int]:
    """Least costs from each state before the rows to each state after them, row by row."""
    columns = []
    for e in range(4):
        b = tuple(0 if s == e else FAR for s in range(4))
        for k in reversed(kinds):
            b = step(k, b)
        columns.append(b)
    return [columns[e][s] for s in range(4) for e in range(4)]


class Segment:
    """Consecutive rows of one conversation: faults, counts, and what neighbours need to know."""

    def __init__(self, turns: list[int | None], roles: list[str], texts: list[str]):
        self.roles, self.texts = roles, texts
        kinds, seen = bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        for role, text in zip(roles, texts, strict=True):
            said = text.strip(BLANK)
            if not said:
                self.blank += 1
                kinds.append(MUST_GO)
                continue
            if (role, text) in seen:
                self.duplicate += 1
                kinds.append(MUST_GO)
                continue
            seen.add((role, text))
            cut = said[-1] not in ".!?"
            self.truncated += cut
            kinds.append(initial(role) + 4 * cut)
        self.kinds = bytes(kinds)
        firsts = [r[:1] for r in roles]
        self.illegal = sum(not legal(a, b) for a, b in zip(firsts, firsts[1:], strict=False))
        known = [t for t in turns if t is not None]
        self.lo, self.hi, self.distinct = min(known, default=None), max(known, default=None), len(set(known))


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SEGMENT = "blank long, duplicate long, truncated long, illegal long, lo long, hi long, distinct_turns long, first_initial string, last_initial string, kinds binary, roles array<string>, texts array<string>, digests array<string>"


def _split_chunk(chunk: pa.Table) -> tuple[list[dict], list[dict]]:
    """(results of whole conversations, segments that may go on in other chunks)."""
    rows = chunk.sort_by("__r_at")
    ids, turns, roles, texts, places = (rows[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "__r_at"))
    part = rows["__r_part"][0].as_py()
    cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
    done, edges = [], []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        seg = Segment(turns[lo:hi], roles[lo:hi], texts[lo:hi])
        counts = {"conv_id": ids[lo], "blank": seg.blank, "duplicate": seg.duplicate, "truncated": seg.truncated, "illegal": seg.illegal}
        if 0 < k < len(cuts) - 2:
            scripts, s, cost = walk(seg.kinds, END, 0)
            repaired, at = [], 0
            for script, role, text in zip(scripts, seg.roles, seg.texts, strict=True):
                some, at = lines(script, role, text, at)
                repaired += some
            repaired += lines(closing(s), "", "", s)[0]
            digest = hashlib.sha256("\n".join(repaired).encode("utf-8", "surrogatepass")).hexdigest()
            gaps = 0 if seg.lo is None else seg.hi - seg.lo + 1 - seg.distinct
            done.append(counts | {"gaps": gaps, "cost": cost, "audit": "".join(scripts) + closing(s), "repaired_sha256": digest})
        else:
            digests = ["" if kind == MUST_GO else hashlib.sha256(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).hexdigest() for kind, r, t in zip(seg.kinds, seg.roles, seg.texts, strict=True)]
            edges.append(counts | {"seq": (part << ranges.PLACE_BITS) + places[lo], "lo": seg.lo, "hi": seg.hi, "distinct_turns": seg.distinct, "first_initial": seg.roles[0][:1], "last_initial": seg.roles[-1][:1], "kinds": seg.kinds, "roles": seg.roles, "texts": seg.texts, "digests": digests})
    return done, edges


def _each(df: DataFrame, schema: StructType, of: Callable[[dict], dict]) -> DataFrame:
    """A row for each row."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([of(r) for r in batch.to_pylist()], arrow)

    return df.mapInArrow(run, schema)


def _folded(df: DataFrame, schema: StructType, start: Callable[[], Any], take: Callable[[Any, dict], tuple[Any, dict | None]], end: Callable[[Any], dict | None] = lambda state: None, backwards: bool = False) -> DataFrame:
    """Rows of a conversation in the order of seq, one after the other, with a state; a row may give a row, and so may the end."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, began = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not began or row["conv_id"] != conv:
                    if began and (x := end(state)) is not None:
                        out.append({"conv_id": conv} | x)
                    state, conv, began = start(), row["conv_id"], True
                state, x = take(state, row)
                if x is not None:
                    out.append({"conv_id": conv} | x)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if began and (x := end(state)) is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv} | x], arrow)

    order = F.col("seq").desc() if backwards else F.col("seq")
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), order).mapInArrow(run, schema)


def _with(id_type: str, columns: str) -> StructType:
    return StructType.fromDDL(f"conv_id {id_type}, {columns}")


def _joined(a: DataFrame, b: DataFrame, *also: str, how: str = "inner") -> DataFrame:
    """a with the other columns of b, by conversation (null equals null) and more."""
    keys = ("conv_id", *also)
    named = b.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in b.columns])
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id"))
    for c in also:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return a.join(named, same, how).drop(*[f"__{c}" for c in keys])


def _mend(seg: dict) -> dict:
    """A segment whose rows at ``again`` repeat rows of earlier segments."""
    kinds = bytearray(seg["kinds"])
    for i in seg["again"] or ():
        if kinds[i] != MUST_GO:
            seg["truncated"] -= kinds[i] >= 4
            seg["duplicate"] += 1
            kinds[i] = MUST_GO
    return {k: seg[k] for k in ("conv_id", "seq", "blank", "duplicate", "truncated", "illegal", "lo", "hi", "distinct_turns", "first_initial", "last_initial", "roles", "texts")} | {"kinds": bytes(kinds), "costs": matrix(bytes(kinds))}


def _back(state: Vector, row: dict) -> tuple[Vector, dict]:
    m = row["costs"]
    before = tuple(min(FAR, *(m[4 * s + e] + state[e] for e in range(4))) for s in range(4))
    return before, {"seq": row["seq"], "at_end": list(state)}


def _finish(row: dict) -> dict:
    s = row["entry"]
    scripts, e, cost = walk(row["kinds"], tuple(row["at_end"]), s)
    repaired = []
    for script, role, text in zip(scripts, row["roles"], row["texts"], strict=True):
        some, s = lines(script, role, text, s)
        repaired += some
    keep = ("conv_id", "seq", "blank", "duplicate", "truncated", "illegal", "lo", "hi", "distinct_turns", "first_initial", "last_initial")
    return {k: row[k] for k in keep} | {"script": "".join(scripts), "part": "\n".join(repaired) if repaired else None, "exit": e, "cost": cost}


class _Whole:
    """What the segments of a conversation add up to."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.lo = self.hi = self.last = self.cost = None
        self.script, self.exit, self.any, self.digest = [], 0, False, hashlib.sha256()

    def add(self, text: str) -> None:
        if self.any:
            self.digest.update(b"\n")
        self.digest.update(text.encode("utf-8", "surrogatepass"))
        self.any = True

    def take(self, row: dict) -> None:
        for c in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + row[c])
        if self.last is None:
            self.cost = row["cost"]  # from the start to the end of the conversation
        elif not legal(self.last, row["first_initial"]):
            self.illegal += 1
        self.last = row["last_initial"]
        if row["lo"] is not None:
            self.turns += row["distinct_turns"] - (self.hi == row["lo"])
            self.lo, self.hi = row["lo"] if self.lo is None else self.lo, row["hi"]
        self.script.append(row["script"])
        self.exit = row["exit"]
        if row["part"] is not None:
            self.add(row["part"])

    def result(self) -> dict:
        for line in lines(closing(self.exit), "", "", self.exit)[0]:
            self.add(line)
        audit = "".join(self.script) + closing(self.exit)
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost, "audit": audit, "repaired_sha256": self.digest.hexdigest()}


def _take(state: _Whole, row: dict) -> tuple[_Whole, None]:
    state.take(row)
    return state, None


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations (conv_id, turn, role, text)."""
    spark = rows.sparkSession
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    id_type = plain.schema["conv_id"].dataType.simpleString()
    placed = ranges.place(plain, [F.col("conv_id"), F.col("turn"), F.col("role"), F.md5(F.col("text").cast("binary"))], "turns")
    chunked = placed.withColumn("chunk", F.shiftright("__r_at", CHUNK.bit_length() - 1))
    both = _with(id_type, f"whole boolean, seq long, {COUNTS}, lo long, hi long, distinct_turns long, first_initial string, last_initial string, kinds binary, roles array<string>, texts array<string>, digests array<string>")
    arrow = to_arrow_schema(both)

    def split_chunk(chunk: pa.Table) -> pa.Table:
        done, edges = _split_chunk(chunk)
        return pa.Table.from_pylist([{"whole": True} | r for r in done] + [{"whole": False} | r for r in edges], arrow)

    split = materialize(spark, chunked.groupBy("__r_part", "chunk").applyInArrow(split_chunk, both), "turn-chunks")
    counts = [f.split()[0] for f in COUNTS.split(", ")]
    whole = split.where("whole").select("conv_id", *counts)
    edges = split.where("NOT whole")

    # Rows of a segment that an earlier segment of the conversation has.
    said = edges.select("conv_id", "seq", F.posexplode("digests").alias("i", "digest")).where("digest != ''")
    first = said.groupBy("conv_id", "digest").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = _joined(said, first, "digest").where("seq > first").groupBy("conv_id", "seq").agg(F.collect_list("i").alias("again"))  # at most CHUNK
    mended = _joined(edges.select("conv_id", "seq", *[c.split()[0] for c in SEGMENT.split(", ")]), again, "seq", how="left")
    segments = materialize(spark, _each(mended, _with(id_type, "seq long, blank long, duplicate long, truncated long, illegal long, lo long, hi long, distinct_turns long, first_initial string, last_initial string, roles array<string>, texts array<string>, kinds binary, costs array<long>"), _mend), "turn-segments")

    ends = _folded(segments.select("conv_id", "seq", "costs"), _with(id_type, "seq long, at_end array<long>"), lambda: END, _back, backwards=True)
    ends = materialize(spark, ends, "turn-ends")
    ended = _joined(segments, ends, "seq")
    exits = _each(ended.select("conv_id", "seq", "kinds", "at_end"), _with(id_type, "seq long, exits array<long>"), lambda r: {"conv_id": r["conv_id"], "seq": r["seq"], "exits": [walk(r["kinds"], tuple(r["at_end"]), s)[1] for s in range(4)]})
    entries = _folded(exits, _with(id_type, "seq long, entry long"), lambda: 0, lambda s, r: (r["exits"][s], {"seq": r["seq"], "entry": s}))
    entries = materialize(spark, entries, "turn-entries")
    ready = _joined(ended, entries, "seq")
    parts = _each(ready, _with(id_type, "seq long, blank long, duplicate long, truncated long, illegal long, lo long, hi long, distinct_turns long, first_initial string, last_initial string, script string, part string, exit long, cost long"), _finish)
    sums = _folded(parts, _with(id_type, COUNTS), _Whole, _take, lambda s: s.result())
    return whole.unionByName(sums)


def damage(rows: DataFrame) -> DataFrame:
    """Rows by crc32(conv_id:turn) % 20: 0 goes, 1 loses its text, 2 its . ! ?, 3 comes twice, 4 gets the role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    x = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("__kind")).where("__kind != 0")
    said = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    out = x.select("conv_id", "turn", role.alias("role"), said.alias("text"), F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"))
    return out.drop("__copy")


def repaired(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """What ``repair`` says of the damaged rows, for every conversation of the original ones."""
    out = _joined(rows.select("conv_id").distinct(), repair(damaged), how="left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return out.select("conv_id", *[F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in out.columns if c != "conv_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(rows, damage(rows))
