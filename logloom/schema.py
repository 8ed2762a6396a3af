"""Envelope schemas: the operation log, change events, checkpoints and chunk maps.

Documents are JSON text in extended form, so that field order and the difference
between a missing field and a null survive. ``seq`` is the order of arrival and
breaks ties of the timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPLOG = (
    "source string, seq long, ts_t long, ts_i long, term long, h long, v int, op string, gid string, ns string, o string, o2 string, "
    "uk map<string,array<string>>, lsid binary, txn_number long, prev_optime binary, from_migrate boolean, document_key string, ui binary, raw_size int"
)
EVENT = (
    "resume_token string, operation_type string, full_document string, ns struct<db:string,coll:string>, to struct<db:string,coll:string>, "
    "document_key string, update_description struct<updated_fields:string,removed_fields:array<string>>, cluster_t long, cluster_i long, txn_number long, lsid binary"
)
CHECKPOINT = "name string, ckpt long, version int, fetch_method string, oplog_disk_queue string, oplog_disk_queue_apply_finish_ts long"
CHUNK = "replset string, ns string, keys array<string>, shard_type string, mins array<string>, maxs array<string>"
INDEX = "ns string, name string, key string, is_unique boolean, background boolean, v int"

#: Labels of the operation codes; every command counts as "create".
OP_LABELS = {"i": "insert", "u": "update", "d": "delete", "c": "create", "n": "noop"}
#: The database in which this engine keeps its own state, and the one for conflicts.
APP_DB, CONFLICT_DB = "logloom", "logloom_conflict"


def known_columns(frame: DataFrame, schema: str = OPLOG) -> DataFrame:
    """The columns of ``frame`` that the schema has, in its order; missing ones are null, others go."""
    from pyspark.sql.types import _parse_datatype_string

    low = {c.lower(): c for c in frame.columns}
    fields = _parse_datatype_string(schema).fields
    return frame.select(*[(F.col(low[f.name]) if f.name in low else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def dump(frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A subset of the envelope's columns in envelope order; all of them without ``keys``."""
    return frame if not keys else frame.select(*[c for c in frame.columns if c in set(keys)])
