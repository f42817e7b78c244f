"""Sharding by a permutation-filled lookup table. DataFrame functions only.

Each shard has a preference order of the slots of a prime-sized table: offset +
k * skip modulo the size, with offset and skip from digests of its name. The
shards take turns; at its turn a shard claims the first slot of its order that
nobody has claimed. Every shard ends with floor or ceil of size / shards slots,
and adding or removing a shard moves few other slots. A row goes to the shard
of slot (first 32 bits of md5(key)) modulo the size: one lookup in a broadcast table whose size is
a parameter, whatever the data's size.

Rows are placed one by one, so a source or key prefix that holds a third of all
rows spreads like any other. Filling the table is work for (size x
log size) steps over numbers of the configuration, not of the data, and is done
where the query is built.

Defined cases: a null key is the key ``''`` and goes to that key's shard; equal
keys go to one shard; other columns are kept, but for those called slot, shard_id or
shard, whose place the results take (one of them may be the key); an empty table gives
an empty result; names must be distinct and fewer than the table's slots.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

TABLE_SIZE = 65537
SHARDS = 64


def shard_names(n: int = SHARDS) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(n))


def _digest(name: str, what: str) -> int:
    return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:8], "big")


@lru_cache(maxsize=8)
def fill_table(names: tuple[str, ...], size: int = TABLE_SIZE) -> tuple[int, ...]:
    """The shard's index for each slot."""
    if not names or len(set(names)) != len(names) or len(names) > size:
        raise ValueError("distinct shard names, at most one for each slot, are needed")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime, so that each preference order visits every slot")
    place = [_digest(x, "offset") % size for x in names]
    skip = [_digest(x, "skip") % (size - 1) + 1 for x in names]
    owner, left = [-1] * size, size
    while left:
        for i in range(len(names)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % size
            owner[place[i]] = i
            left -= 1
            if not left:
                break
    return tuple(owner)


def lookup_table(spark: SparkSession, names: tuple[str, ...], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard_id, shard): ``size`` rows."""
    owners = ",".join(map(str, fill_table(names, size)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard_id"))
    named = F.element_at(F.split(F.lit("\n".join(names)), "\n"), F.col("shard_id").cast("int") + 1)
    return table.select(F.col("slot").cast("long"), F.col("shard_id").cast("long"), named.alias("shard"))


def assign_shards(spark: SparkSession, df: DataFrame, key_col: str, names: tuple[str, ...], size: int = TABLE_SIZE) -> DataFrame:
    """The rows with slot, shard_id and shard; broadcasts a table of ``size`` rows."""
    digest = F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size))
    table = lookup_table(spark, names, size).toDF("__slot", "__shard_id", "__shard")
    mine = {"slot": F.col("__slot"), "shard_id": F.col("__shard_id"), "shard": F.col("__shard")}
    carry = [c for c in df.columns if c not in (*mine, "__place", "__slot", "__shard_id", "__shard")]
    placed = df.select(slot.alias("__place"), *carry)
    return placed.join(F.broadcast(table), F.col("__place") == F.col("__slot")).select(*carry, *[c.alias(x) for x, c in mine.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark, documents(spark, sf_dir).select("doc_id"), "doc_id", shard_names())


def _oracle() -> str:
    return f"""
WITH s AS (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT % {TABLE_SIZE})::BIGINT AS slot FROM documents
), t AS (
  SELECT string_split('{",".join(map(str, fill_table(shard_names())))}', ',') AS owners
)
SELECT doc_id, slot, owners[slot + 1]::BIGINT AS shard_id, printf('shard-%05d', owners[slot + 1]::INTEGER) AS shard FROM s, t
"""


ORACLE_SQL = _oracle()
