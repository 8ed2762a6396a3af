"""The binary tunnel format: a data source for its files, and the batch encoding.

A file is a 32-byte header and blocks; a block is six big-endian words (checksum,
tag, shard, compressor, 0xeeeeeeee, length) and logs with their lengths in front.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC, PROTOCOL, BLOCK_MAGIC = 0xEEEEEEEEEE201314, 1, 0xEEEEEEEE
RETRANSMISSION, PROBE, RESIDENT, PERSISTENT, STORAGE_BACKEND = 0x1, 0x10, 0x100, 0x1000, 0x10000
COMPRESSORS = {"none": 0, "gzip": 1, "snappy": 2, "zlib": 3, "deflate": 4}


def compress(data: bytes, how: int) -> bytes:
    if how == COMPRESSORS["gzip"]:
        return gzip.compress(data, 9, mtime=0)
    if how == COMPRESSORS["zlib"]:
        return zlib.compress(data, 9)
    if how == COMPRESSORS["deflate"]:
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()
    if how == COMPRESSORS["snappy"]:
        import pyarrow as pa

        return pa.Codec("snappy").compress(data, asbytes=True)
    return data


def decompress(data: bytes, how: int) -> bytes:
    if how == COMPRESSORS["gzip"]:
        return gzip.decompress(data)
    if how == COMPRESSORS["zlib"]:
        return zlib.decompress(data)
    if how == COMPRESSORS["deflate"]:
        return zlib.decompress(data, -15)
    if how == COMPRESSORS["snappy"]:
        import pyarrow as pa

        size = shift = 0  # the block begins with its plain size, seven bits a byte
        for b in data:
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        return pa.Codec("snappy").decompress(data, size, asbytes=True)
    return data


def checksum(logs: list[bytes]) -> int:
    return reduce(lambda a, b: a ^ zlib.crc32(b), logs, 0)


def _with_lengths(logs: list[bytes]) -> bytes:
    return b"".join(struct.pack(">I", len(x)) + x for x in logs)


def encode_block(logs: list[bytes], tag: int = 0, shard: int = 0, how: int = 0) -> bytes:
    """A block of a file; the checksum is of the logs before compression."""
    body = _with_lengths([compress(x, how) for x in logs])
    return struct.pack(">6I", checksum(logs), tag | PERSISTENT | STORAGE_BACKEND, shard, how, BLOCK_MAGIC, len(body)) + body


def encode_message(logs: list[bytes], tag: int = 0, shard: int = 0, how: int = 0) -> bytes:
    """One batch as a message: checksum, tag, shard, compressor, count, then the logs."""
    return struct.pack(">5I", checksum(logs), tag, shard, how, len(logs)) + _with_lengths([compress(x, how) for x in logs])


def decode_message(data: bytes) -> tuple[int, int, int, int, list[bytes]]:
    check, tag, shard, how, n = struct.unpack_from(">5I", data)
    at, logs = 20, []
    for _ in range(n):
        (size,) = struct.unpack_from(">I", data, at)
        logs.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return check, tag, shard, how, logs


def encode_file(blocks: list[bytes]) -> bytes:
    return struct.pack(">QI", MAGIC, PROTOCOL).ljust(32, b"\0") + b"".join(blocks)


def decode_file(data: bytes) -> Iterator[tuple[int, int, int, int, int, bytes, bool]]:
    """(block, position, tag, shard, compressor, log, whether the block's checksum holds) of a file's logs.

    A file with a wrong header is refused; reading ends at a broken block.
    """
    if len(data) < 32 or struct.unpack_from(">QI", data) != (MAGIC, PROTOCOL):
        raise ValueError("not a tunnel file")
    at, block = 32, 0
    while at + 24 <= len(data):
        check, tag, shard, how, magic, size = struct.unpack_from(">6I", data, at)
        if magic != BLOCK_MAGIC or at + 24 + size > len(data):
            return
        at, end, logs = at + 24, at + 24 + size, []
        while at < end:
            (n,) = struct.unpack_from(">I", data, at)
            logs.append(decompress(data[at + 4 : at + 4 + n], how))
            at += 4 + n
        good = checksum(logs) == check
        for k, log in enumerate(logs):
            yield block, k, tag | RETRANSMISSION, shard, how, log, good
        block += 1


def read_files(spark: SparkSession, path: str, replayers: int | None = None) -> DataFrame:
    """(path, block, pos, tag, shard, compressor, log, valid) of tunnel files, read by Spark, so from any store.

    Shards beyond the number of replayers wrap around. Rows that aren't ``valid``
    belong in quarantine.
    """

    def run(batches):
        import pyarrow as pa

        names = ["path", "block", "pos", "tag", "shard", "compressor", "log", "valid"]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, *r) for r in decode_file(data)]
                for start in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[start : start + 10_000])], names=names)

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    out = raw.mapInArrow(run, "path string, block long, pos long, tag long, shard long, compressor long, log binary, valid boolean")
    return out.withColumn("shard", F.pmod("shard", F.lit(replayers))) if replayers else out


def batch_tag(probe: Column) -> Column:
    return F.when(probe, F.lit(PROBE)).otherwise(F.lit(0))
