"""Options that change results or ordering, with their defaults and conflicts."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


#: Allowed values by option (fixed values).
ALLOWED = {
    "sync_mode": ("all", "full", "incr"),
    "tunnel": ("direct", "rpc", "tcp", "file", "kafka", "mock"),
    "tunnel_message": ("raw", "bson", "json"),
    "tunnel_json_format": ("", "canonical_extended_json"),
    "full_sync_create_index": ("none", "foreground", "background"),
    "incr_sync_mongo_fetch_method": ("oplog", "change_stream"),
    "incr_sync_shard_key": ("auto", "id", "collection"),
    "incr_sync_worker_oplog_compressor": ("none", "gzip", "zlib", "deflate", "snappy"),
    "incr_sync_conflict_write_to": ("none", "db", "sdk"),
}


@dataclass
class Config:
    """Options of a replication run; names follow the dotted keys of a configuration file with underscores."""

    conf_version: int = 10
    id: str = "logloom"
    sync_mode: str = "incr"
    filter_namespace_white: list[str] = field(default_factory=list)
    filter_namespace_black: list[str] = field(default_factory=list)
    filter_pass_special_db: list[str] = field(default_factory=list)
    filter_ddl_enable: bool = False
    filter_oplog_gids: bool = False
    transform_namespace: list[str] = field(default_factory=list)
    checkpoint_storage_url: str = ""
    checkpoint_start_position: int = 1
    checkpoint_interval: int = 5000
    tunnel: str = "direct"
    tunnel_address: list[str] = field(default_factory=list)
    tunnel_message: str = "raw"
    tunnel_json_format: str = ""
    tunnel_kafka_partition_number: int = 1
    full_sync_reader_collection_parallel: int = 6
    full_sync_reader_write_document_parallel: int = 8
    full_sync_reader_document_batch_size: int = 128
    full_sync_reader_fetch_batch_size: int = 1024
    full_sync_reader_parallel_thread: int = 1
    full_sync_reader_parallel_index: str = "_id"
    full_sync_collection_exist_drop: bool = False
    full_sync_create_index: str = "foreground"
    full_sync_reader_oplog_store_disk: bool = False
    full_sync_reader_oplog_store_disk_max_size: int = 256000
    full_sync_executor_insert_on_dup_update: bool = False
    full_sync_executor_filter_orphan_document: bool = False
    incr_sync_mongo_fetch_method: str = "oplog"
    incr_sync_change_stream_watch_full_document: bool = False
    incr_sync_reader_fetch_batch_size: int = 1024
    incr_sync_reader_buffer_time: int = 1
    incr_sync_oplog_gids: list[str] = field(default_factory=list)
    incr_sync_shard_key: str = "collection"
    incr_sync_shard_by_object_id_whitelist: list[str] = field(default_factory=list)
    incr_sync_worker: int = 8
    incr_sync_tunnel_write_thread: int = 0
    incr_sync_target_delay: int = 0
    incr_sync_worker_batch_queue_size: int = 64
    incr_sync_adaptive_batching_max_size: int = 1024
    incr_sync_fetcher_buffer_capacity: int = 256
    incr_sync_executor_upsert: bool = False
    incr_sync_executor_insert_on_dup_update: bool = False
    incr_sync_conflict_write_to: str = "none"
    incr_sync_worker_oplog_compressor: str = "none"
    incr_sync_dbref: bool = False
    incr_sync_executor: int = 1
    skip_nsshardkey_verify: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Config:
        """From lines ``key = value``; ``#`` starts a comment, lists are split at semicolons or commas. Unknown keys are left out."""
        kinds, found = {f.name: f.type for f in fields(cls)}, {}
        for line in text.splitlines():
            key, eq, value = line.partition("#")[0].partition("=")
            name, value = key.strip().replace(".", "_"), value.strip()
            if not eq or name not in kinds:
                continue
            kind = kinds[name]
            if kind == "bool":
                found[name] = value.lower() == "true"
            elif kind == "int":
                found[name] = int(value or 0)
            elif kind == "list[str]":
                found[name] = [x.strip() for x in value.replace(",", ";").split(";") if x.strip()]
            else:
                found[name] = value
        return cls(**found).checked()

    def checked(self, sharded: bool = False, source_shards: int = 0) -> Config:
        """This configuration with defaults for what isn't positive, or an error that names the conflict."""
        fresh = Config()
        for f in fields(self):
            value = getattr(self, f.name)
            default = getattr(fresh, f.name)
            if (f.type == "int" and value <= 0) or (f.type == "str" and value == "" and default):
                setattr(self, f.name, default)
            if f.name in ALLOWED and getattr(self, f.name) not in ALLOWED[f.name]:
                raise ValueError(f"{f.name} should be one of {ALLOWED[f.name]}")
        problems = [
            (self.full_sync_reader_parallel_thread > 128, "full_sync.reader.parallel_thread should be 128 or less"),
            (self.incr_sync_worker > 256, "incr_sync.worker should be 256 or less"),
            (self.filter_namespace_white and self.filter_namespace_black, "only one of the white and the black list can be given"),
            (self.incr_sync_shard_by_object_id_whitelist and self.incr_sync_shard_key != "collection", "the object id list needs incr_sync.shard_key = collection"),
            (self.sync_mode != "incr" and self.tunnel != "direct", "a full copy needs the direct tunnel"),
            (self.tunnel_kafka_partition_number > self.incr_sync_worker, "more partitions than workers"),
            (sharded and self.filter_ddl_enable and self.incr_sync_mongo_fetch_method == "oplog", "DDL of a sharded source can't be ordered in oplog mode"),
            (self.full_sync_reader_oplog_store_disk and self.sync_mode != "all", "full_sync.reader.oplog_store_disk needs sync_mode = all"),
        ]
        for wrong, what in problems:
            if wrong:
                raise ValueError(what)
        self.incr_sync_tunnel_write_thread = self.incr_sync_tunnel_write_thread or self.incr_sync_worker
        if self.incr_sync_tunnel_write_thread % self.incr_sync_worker:
            raise ValueError("incr_sync.tunnel.write_thread should be a multiple of incr_sync.worker")
        if self.tunnel_message != "raw":
            self.incr_sync_worker_oplog_compressor = "none"
        if self.tunnel == "direct":
            self.incr_sync_change_stream_watch_full_document = False
        if self.sync_mode != "incr":
            self.checkpoint_start_position = 1
        if sharded and source_shards and self.incr_sync_mongo_fetch_method == "oplog":
            self.incr_sync_worker = source_shards
        return self

    @property
    def collision_detection(self) -> bool:
        return self.incr_sync_executor != 1




def file_version(text: str) -> int:
    """Version of a configuration file: its first line that begins with conf.version; 0 without one."""
    for line in text.splitlines():
        if line.strip().startswith("conf.version"):
            return int(line.partition("=")[2].strip() or 0)
    return 0
