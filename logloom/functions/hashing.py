"""Hashes that decide where an operation goes, and the order of typed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of value types in comparisons, which are also their codes in the shard hash (fixed values).
RANKS = {"minkey": 0, "number": 10, "string": 15, "oid": 35, "maxkey": 100}


def string_hash(text: Column) -> Column:
    """31-polynomial of the code points modulo 2^32, as a long."""
    points = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)).cast("long"))
    return F.aggregate(points, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % F.lit(1 << 32))


def id_hash(kind: Column, text: Column, number: Column) -> Column:
    """Hash of an id: strings and object ids (their hex text) by ``string_hash``, whole numbers by themselves, else 0."""
    return F.when(kind.isin("string", "oid"), string_hash(text)).when(kind == "number", F.pmod(number, F.lit(1 << 32))).otherwise(F.lit(0).cast("long"))


def _little_endian(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 17 - 2 * (k + 1), 2) for k in range(size)]))


def _digest(code: int, payload: Column) -> Column:
    head = F.unhex(F.lit("00000000" + code.to_bytes(4, "little").hex()))
    first = F.substring(F.md5(F.concat(head, payload)), 1, 16)
    turned = F.concat(*[F.substring(first, 15 - 2 * k, 2) for k in range(8)])
    return F.conv(turned, 16, -10).cast("long")


def shard_hash_number(value: Column) -> Column:
    """Hash of a number in a hashed shard key; fractions are cut off."""
    return _digest(RANKS["number"], _little_endian(value.cast("long"), 8))


def shard_hash_string(text: Column) -> Column:
    data = text.cast("binary")
    return _digest(RANKS["string"], F.concat(_little_endian((F.length(data) + 1).cast("long"), 4), data, F.unhex(F.lit("00"))))


def shard_hash_oid(hex24: Column) -> Column:
    return _digest(RANKS["oid"], F.unhex(hex24))


def ordered_key(kind: Column, number: Column, text: Column) -> Column:
    """Struct that orders values of any type: by rank, then by value."""
    rank = F.lit(RANKS["number"])
    for k, v in RANKS.items():
        rank = F.when(kind == k, F.lit(v)).otherwise(rank)
    return F.struct(rank.alias("rank"), F.when(kind == "number", number.cast("double")).alias("num"), F.when(kind.isin("string", "oid"), text).alias("str"))


def worker_by_collection(op: Column, ns: Column, n: int) -> Column:
    """Worker of a log: by namespace; commands, logs without namespace and a single worker give 0."""
    if n <= 1:
        return F.lit(0).cast("long")
    return F.when((op == "c") | (F.coalesce(ns, F.lit("")) == ""), F.lit(0).cast("long")).otherwise(string_hash(ns) % n)


def worker_by_id(op: Column, ns: Column, hashed_id: Column, n: int) -> Column:
    """Worker of a log: by id for data, by namespace for commands and where there is no id, 0 for no-ops."""
    if n <= 1:
        return F.lit(0).cast("long")
    return F.when(op == "n", F.lit(0).cast("long")).when(op == "c", string_hash(ns) % n).otherwise(F.coalesce(hashed_id, string_hash(ns)) % n)


def worker_by_whitelist(op: Column, ns: Column, hashed_id: Column, by_id: list[str], n: int) -> Column:
    """Worker of a log: by id in the namespaces listed, else by collection."""
    return F.when(ns.isin(by_id), worker_by_id(op, ns, hashed_id, n)).otherwise(worker_by_collection(op, ns, n)) if by_id else worker_by_collection(op, ns, n)


def worker_auto(any_unique: bool, op: Column, ns: Column, hashed_id: Column, n: int) -> Column:
    """Worker of a log: by collection if any index is unique, so that its order holds, else by id."""
    return worker_by_collection(op, ns, n) if any_unique else worker_by_id(op, ns, hashed_id, n)


def sub_worker(hashed_id: Column, n_workers: int, n_executors: int) -> Column:
    """Executor within a worker, from what the worker's share of the hash leaves."""
    return F.pmod(hashed_id, F.lit(n_executors)).cast("long")


def replayer(shard: Column, n: int) -> Column:
    """Which of n replayers gets a shard of a tunnel."""
    return F.pmod(shard, F.lit(n))
