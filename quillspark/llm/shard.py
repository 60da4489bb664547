"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table, from an offset and a skip. The shards take turns
claiming the first free slot of their permutation until the table is full, so their shares differ by a slot at most, and
a shard that leaves moves little else. The table has `slots` rows whatever the data's size; it is broadcast, and placing
a row is one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 65_537
#: The largest table that is broadcast (about 16 bytes a slot).
MOST_SLOTS = 2_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot."""
    if not shards or len(set(shards)) < len(shards) or not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"need distinct shards and a prime number of slots, at least as many and at most {MOST_SLOTS}")
    place, skip = [], []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(d[:8], "big") % slots)
        skip.append(int.from_bytes(d[8:16], "big") % (slots - 1) + 1)
    out, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            if not left:
                break
            p = place[i]
            while out[p] >= 0:
                p = (p + skip[i]) % slots
            out[p], place[i] = i, (p + skip[i]) % slots
            left -= 1
    return out


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The key's slot, from 60 bits of its digest as text; a null key has the empty text's slot."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def place(rows: DataFrame, key: str, shards: list[str] | None = None, slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """`rows` with two columns more, slot and shard (names that must be free in `rows`); nothing is shuffled.

    Equal keys share a shard, repeated rows stay, and null keys all go to one defined shard. An empty table stays empty;
    no other column is read. The table that is broadcast has at most MOST_SLOTS rows.
    """
    spark: SparkSession = rows.sparkSession
    taken = {c.lower() for c in rows.columns}
    while slot.lower() in taken or shard.lower() in taken:
        slot, shard = f"{slot}_", f"{shard}_"
    shards = shards or names()
    claimed = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup(shards, slots))], f"`__slot` int, `{shard}` string")
    placed = rows.withColumn(slot, slot_of(rows[key], slots))
    return placed.join(F.broadcast(claimed), F.col(slot) == F.col("__slot")).drop("__slot")


def oracle() -> str:
    """The same in DuckDB SQL: the claims, decided by whole permutations, as two hexadecimal digits a slot."""
    orders = []
    for name in names():
        d = hashlib.sha256(name.encode()).digest()
        at, skip = int.from_bytes(d[:8], "big") % SLOTS, int.from_bytes(d[8:16], "big") % (SLOTS - 1) + 1
        orders.append(map(lambda j, at=at, skip=skip: (at + j * skip) % SLOTS, range(SLOTS)))
    claimed: dict[int, int] = {}
    while len(claimed) < SLOTS:
        i = len(claimed) % SHARDS
        claimed[next(p for p in orders[i] if p not in claimed)] = i
    claims = "".join(f"{claimed[p]:02x}" for p in range(SLOTS))
    return f"""
WITH d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INT AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad((('0x' || substr('{claims}', 2 * slot + 1, 2))::INT)::VARCHAR, 5, '0') AS shard FROM d"""
