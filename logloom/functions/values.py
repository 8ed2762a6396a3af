"""Scalar functions on timestamps, names, sizes and versions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIGH = 1 << 32
#: Texts of the service states, and names of the stages of buffered fetching (fixed values).
STATUS = {0: "Good", 1: "prepare for ready", 2: "can't fetch oplog from source MongoDB", 4: "collector send oplog to tunnel failed", 8: "receiver fetch from tunnel failed", 16: "receiver replica executed failed"}
STAGES = {1: "store disk and no apply", 2: "store disk and apply", 3: "store memory and apply"}


def ts_pack(t: Column, i: Column) -> Column:
    """Seconds and ordinal as one ordered long."""
    return t * F.lit(_HIGH) + i


def ts_seconds(ts: Column) -> Column:
    """Seconds of a packed timestamp, unsigned; null gives -1."""
    return F.coalesce(F.shiftrightunsigned(ts, 32), F.lit(-1).cast("long"))


def ts_ordinal(ts: Column) -> Column:
    """Ordinal of a packed timestamp, unsigned; null gives -1."""
    return F.coalesce(ts.bitwiseAND(F.lit(_HIGH - 1)), F.lit(-1).cast("long"))


def ts_text(ts: Column) -> Column:
    return F.format_string("ts[%d, %d]", ts_seconds(ts), ts_ordinal(ts))


def ns_db(ns: Column) -> Column:
    """Database of a namespace: what stands before the first dot."""
    return F.substring_index(ns, ".", 1)


def ns_coll(ns: Column) -> Column:
    """Collection of a namespace, which may hold dots; null without a dot."""
    return F.get(F.split(ns, r"\.", 2), F.lit(1))


def to_int(value: Column) -> Column:
    """Whole number of any value; null if it isn't one."""
    return value.try_cast("bigint")


def status_text(code: Column) -> Column:
    return _choose(code, STATUS, "unknown")


def stage_name(code: Column) -> Column:
    return F.coalesce(_choose(code, STAGES, None), F.format_string("invalid[%d]", code))


def op_label(op: Column) -> Column:
    from logloom.schema import OP_LABELS

    return _choose(op, OP_LABELS, "unknown")


def _choose(value: Column, table: dict, other: str | None) -> Column:
    out = F.lit(other).cast("string")
    for k, v in table.items():
        out = F.when(value == F.lit(k), F.lit(v)).otherwise(out)
    return out


def size_text(n: Column, largest: str = "PB") -> Column:
    """Bytes with two decimals in the largest unit that they exceed, none above ``largest``."""
    out, value = F.format_string("%.2fB", n.cast("double")), n.cast("double")
    units = ("KB", "MB", "GB", "TB", "PB")
    for power, unit in enumerate(units[: units.index(largest) + 1], 1):
        out = F.when(value > F.lit(float(1024**power)), F.format_string(f"%.2f{unit}", value / F.lit(float(1024**power)))).otherwise(out)
    return out


def version_at_least(version: Column, least: Column) -> Column:
    """Whether a dotted version reaches another; only the first two parts count."""
    part = lambda v, k: F.coalesce(F.get(F.split(v, r"\."), F.lit(k)).try_cast("int"), F.lit(0))
    return F.struct(part(version, 0), part(version, 1)) >= F.struct(part(least, 0), part(least, 1))


def version_compatible(version: Column, oldest: int, current: int) -> Column:
    return version.between(oldest, current)


def delay_due(first_t: Column, now_t: Column, delay: Column, full_finish_t: Column) -> Column:
    """Whether a batch may go: no delay, or its first second isn't behind the full copy, or it is old enough (3 s of slack)."""
    return (delay <= 0) | (first_t <= full_finish_t) | (first_t <= now_t - delay + 3)


def mask_password(url: Column, mask: str = "***") -> Column:
    """A connection string with the credential between its first user colon and ``@`` masked.

    The colon of ``scheme://`` doesn't count. Strings without such a pair, or
    with nothing behind them, stay as they are.
    """
    return F.regexp_replace(url, r"(?s)^([^:@]*:/[^:@]*:|[^:@]*:(?!/))([^@]*)(@.+)$", F.concat(F.lit("$1"), F.lit(mask.replace("$", r"\$")), F.lit("$3")))


def object_id_parts(hex24: Column) -> Column:
    """seconds, machine, process and counter of a 24-digit object id."""
    number = lambda a, n: F.conv(F.substring(hex24, a, n), 16, 10).cast("long")
    return F.struct(number(1, 8).alias("seconds"), number(9, 6).alias("machine"), number(15, 4).alias("process"), number(19, 6).alias("counter"))


def optime_less(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Order of operation times (term, ts): terms count first, but only if both are there."""
    both = a["term"].isNotNull() & b["term"].isNotNull()
    return F.when(both & (a["term"] != b["term"]), a["term"] < b["term"]).otherwise(a["ts"] < b["ts"])


def optime_equal(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["ts"] == b["ts"]) & a["term"].eqNullSafe(b["term"]) & a["hash"].eqNullSafe(b["hash"])
