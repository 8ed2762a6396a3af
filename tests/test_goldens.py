"""Small fixed cases of each operator."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.config import Config, file_version
from logloom.functions import documents as D
from logloom.functions import hashing as H
from logloom.functions import values as V
from logloom.operators import checkpoint, commands, epochs, filters, orphan, replay, transforms, txn
from logloom.plans import pipelines
from logloom.sources import readers, tunnel_file
from logloom.streaming import apply


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hash_values(spark):
    s = lambda t: H.string_hash(F.lit(t))
    n = lambda v: H.shard_hash_number(F.lit(v))
    assert tuple(one(spark, s("test.h4"), s("shard_collection.g4"), s(""))) == (2872464296, 4230947676, 0)
    assert tuple(one(spark, n(106402199), n(-5))) == (5799870413937531812, -1180238566395260968)
    assert one(spark, H.shard_hash_string(F.lit("a")))[0] != one(spark, H.shard_hash_oid(F.lit("61" * 12)))[0]


def test_order_of_typed_keys(spark):
    rows = [("minkey", None, None), ("number", -3.0, None), ("number", 20.0, None), ("string", None, "a"), ("string", None, "b"), ("oid", None, "00"), ("maxkey", None, None)]
    keys = spark.createDataFrame(rows[::-1], "kind string, n double, s string").select("*", H.ordered_key(F.col("kind"), F.col("n"), F.col("s")).alias("k")).orderBy("k").collect()
    assert [(r.kind, r.n, r.s) for r in keys] == rows


@pytest.mark.parametrize(("url", "want"), [("x://a:b@c", "x://a:***@c"), ("a:b@c", "a:***@c"), ("x://a@c", "x://a@c"), ("x://a:b", "x://a:b"), ("plain", "plain"), ("x://a:b@", "x://a:b@")])
def test_password(spark, url, want):
    assert one(spark, V.mask_password(F.lit(url)))[0] == want


def test_small_values(spark):
    v = lambda a, b: V.version_at_least(F.lit(a), F.lit(b))
    assert tuple(one(spark, v("3.4.0", "3.2"), v("3.10.0", "3.1"), v("3.6", "4.2.5"), v("4.0.0", "4.0.1"))) == (True, True, False, True)
    assert tuple(one(spark, V.size_text(F.lit(1024)), V.size_text(F.lit(1536)), V.stage_name(F.lit(3)), V.stage_name(F.lit(9)), V.ts_seconds(F.lit(None).cast("long")))) == ("1024.00B", "1.50KB", "store memory and apply", "invalid[9]", -1)
    assert tuple(one(spark, V.to_int(F.lit("12")), V.to_int(F.lit("x")), V.ns_coll(F.lit("a.b.c")), V.ns_coll(F.lit("a")))) == (12, None, "b.c", None)
    assert tuple(one(spark, *[V.delay_due(F.lit(t), F.lit(100), F.lit(d), F.lit(0)) for t, d in ((99, 0), (99, 10), (93, 10))])) == (True, False, True)


FILTERS = [
    (dict(white=["gogo.test1", "gogo.test2"]), "gogo.$cmd", False),
    (dict(), "zz.mm", False),
    (dict(black=["zz", "cc.x"]), "zz.mm", True),
    (dict(black=["zz", "cc.x"]), "cc.$cmd", False),
    (dict(black=["zz", "cc.x"]), "cc.x", True),
    (dict(black=["zz", "cc.x"]), "cc.y", False),
    (dict(white=["a.b"]), "a.bc", True),
]


@pytest.mark.parametrize(("rule", "ns", "dropped"), FILTERS)
def test_ns_filter(spark, rule, ns, dropped):
    assert one(spark, filters.drop_ns(F.lit(ns), **rule))[0] is dropped


@pytest.mark.parametrize(("ns", "plain", "passed"), [("a.b", 0, 0), ("", 0, 0), ("logloom.x", 1, 1), ("local.x.z.y", 1, 1), ("a.system.views", 1, 0), ("a.system.view", 0, 0), ("admin.x", 1, 0), ("admin.$cmd", 0, 0), ("adminx", 0, 0)])
def test_own_ns(spark, ns, plain, passed):
    assert tuple(one(spark, filters.drop_own_ns(F.lit(ns)), filters.drop_own_ns(F.lit(ns), ["admin", "system.views"]))) == (bool(plain), bool(passed))


def test_gid_and_guards(spark):
    rows = spark.createDataFrame([("1",), (None,), ("8",), ("5",)], "gid string")
    assert [r[0] for r in rows.select(filters.drop_gid(F.col("gid"), ["5", "6", "7"])).collect()] == [True, True, True, False]
    assert [r[0] for r in rows.select(filters.drop_gid(F.col("gid"), [])).collect()] == [False] * 4
    log = spark.createDataFrame([("i", "a.b", "{}", 5, 0, True)], "op string, ns string, o string, ts_t long, ts_i long, from_migrate boolean")
    with pytest.raises(Exception, match="balancer"):
        filters.fail_on_migration(log).collect()
    ddl = log.withColumns({"op": F.lit("c"), "o": F.lit('{"drop":"x"}')})
    assert filters.fail_on_early_ddl(ddl, (5 << 32) - 1).count() == 1
    with pytest.raises(Exception, match="full copy"):
        filters.fail_on_early_ddl(ddl, 5 << 32).collect()


def test_chain_treats_null_as_no(spark):
    assert one(spark, filters.chain(F.lit(None).cast("boolean"), F.lit(False)))[0] is False


def test_rename():
    rules = [("fromDB1", "toDB1"), ("fromDB2.fromCol2", "toDB2.toCol2")]
    for ns, want in (("fromDB1.fromCol1", "toDB1.fromCol1"), ("fromDB1", "toDB1"), ("fromDB2", "fromDB2"), ("fromDB2.fromCol2", "toDB2.toCol2")):
        assert transforms.rename_text(ns, rules) == want
    first = [("fromDB1.fromCol2", "toDB2.toCol2"), ("fromDB1", "toDB1")]
    assert [transforms.rename_text(f"fromDB1.fromCol{k}", first) for k in (1, 2)] == ["toDB1.fromCol1", "toDB2.toCol2"]
    with pytest.raises(ValueError, match="transform rule"):
        transforms.parse_rules(["a:b.c"])


def test_rename_logs_of_every_kind():
    rules = [("a.b", "c.d"), ("a", "fff")]
    child = '{"applyOps":[{"op":"i","ns":"a.b","o":{"_id":1,"r":{"$ref":"e","$id":2}}}]}'
    ns, o = transforms.rename_log("c", "admin.$cmd", child, rules, True)
    assert (ns, json.loads(o)["applyOps"][0]) == ("admin.$cmd", {"op": "i", "ns": "c.d", "o": {"_id": 1, "r": {"$ref": "e", "$id": 2, "$db": "fff"}}})
    assert transforms.rename_log("c", "a.$cmd", '{"create":"b","idIndex":{"ns":"a.b"}}', rules) == ("c.d", '{"create":"d","idIndex":{"ns":"c.d"}}')
    assert transforms.rename_log("c", "a.$cmd", '{"dropDatabase":1}', rules) == ("fff.$cmd", '{"dropDatabase":1}')
    assert transforms.rename_log("c", "admin.$cmd", '{"renameCollection":"a.b","to":"a.x"}', rules) == ("c.d", '{"renameCollection":"c.d","to":"fff.x"}')
    assert transforms.rename_log("c", "a.$cmd", '{"unknown":1}', rules) is None
    assert D.rewrite_dbref({"x": [{"$ref": "b"}], "y": {"z": {"$ref": "b", "$id": 1}}}, "a", lambda n: transforms.rename_text(n, rules)) == {"x": [{"$ref": "b"}], "y": {"z": {"$ref": "d", "$id": 1, "$db": "c"}}}


def test_diff():
    diff = {
        "d": {"info": False}, "i": {"extra": "c"},
        "sarrname": {"a": True, "s0": {"u": {"count": 5, "nm": "c"}, "i": {"extra": "ps"}}, "s1": {"u": {"count": 6}}, "sm1": {"d": {"n": False}}, "sn1": {"i": {"l": 2}}, "u0": {"count": 10, "nm": "e"}},
    }
    found, pipeline = D.diff_to_update(diff)
    assert not pipeline
    assert found == [
        ("$unset", {"info": False}), ("$set", {"extra": "c"}), ("$set", {"arrname.0.count": 5, "arrname.0.nm": "c"}), ("$set", {"arrname.0.extra": "ps"}), ("$set", {"arrname.1.count": 6}),
        ("$unset", {"arrname.m1.n": False}), ("$set", {"arrname.n1.l": 2}), ("$set", {"arrname.0": {"count": 10, "nm": "e"}}),
    ]
    assert D.diff_to_update({"sarrname": {"a": True, "l": 1}}) == ([("$set", {"arrname": {"$slice": ["$arrname", 1]}})], True)
    assert D.diff_to_update({"u": {"x": 1}, "sarr": {"a": True, "l": 2, "u0": 7}}) == ([("$set", {"arr": {"$slice": ["$arr", 2]}}), ("$set", {"x": 1}), ("$set", {"arr.0": 7})], True)
    assert replay._apply({"x": 0, "arr": [1, 2, 3]}, "u", {"$v": 2, "diff": {"u": {"x": 1}, "sarr": {"a": True, "l": 2, "u0": 7}}}, {}, True, "skip") == {"x": 1, "arr": [7, 2]}
    assert D.diff_text('{"d":{"q":false},"sarr":{"a":true,"l":1}}') == '[{"$set":{"arr":{"$slice":["$arr",1]}}},{"$unset":["q"]}]'
    for wrong in ({"q": 1}, {"s1": {"i": {"a": 1}, "l": 2}}):
        with pytest.raises(ValueError):
            D.diff_to_update(wrong)


def test_documents():
    assert D.remove_field('{"a":1,"b":2}', "a") == '{"b":2}' and D.set_field('{"a":1}', "b", "2") == '{"a":1}'
    assert D.clean_apply_ops('{"applyOps":[{"op":"i","ui":1}],"$db":"x","ui":2}') == '{"applyOps":[{"op":"i"}]}'
    assert D.commit_index_build_command('{"commitIndexBuild":"c","indexBuildUUID":1,"indexes":[{"v":2}]}') == '{"createIndexes":"c","indexes":[{"v":2}]}'
    assert D.clean_create('{"create":"c","autoIndexId":true}') == '{"create":"c","autoIndexId":true}'
    assert D.at_path({"$set": {"a.b": 1}}, "a.b") == 1 and D.at_path({"a": {"b": 2}}, "a.b") == 2 and D.at_path({}, "a.b") is None
    assert D.unique_key('{"a":1,"b":{"c":"x"}}', "a|b.c") == '[1,"x"]' and D.unique_key("{}", "a") is None
    assert D.equal('{"a":1,"b":[1]}', '{"b":[1],"a":1}') and not D.equal('{"a":1}', '{"a":2}')
    assert D.to_map('{"b":{"d":1,"c":2},"a":[{"z":1}]}') == {"a": [{"z": 1}], "b": {"c": 2, "d": 1}}


@pytest.mark.parametrize(
    ("count", "size", "cells", "want"),
    [
        (10, 16, [("1", 0.001)] * 4, [4]), (3, 16, [("1", 0.001)] * 4, [3, 1]), (10, 16, [("1", 5), ("1", 7), ("1", 8), ("1", 0.001)], [2, 2]), (10, 16, [("1", 16), ("1", 13), ("1", 8), ("1", 0.001)], [1, 1, 2]),
        (10, 16, [("1", 16), ("2", 13), ("1", 8), ("1", 0.001), ("1", 7), ("1", 1), ("1", 0)], [1, 1, 3, 2]), (10, 12, [(n, 16) for n in "1211131"], [1] * 7),
    ],
)
def test_groups(spark, count, size, cells, want):
    rows = spark.createDataFrame([(0, k, "i", n, int(b * 1048576)) for k, (n, b) in enumerate(cells)], "w long, seq long, op string, ns string, raw_size long")
    found = [r.batch for r in epochs.grouped_by_size(rows, "w", ["seq"], max_count=count, max_bytes=size << 20).orderBy("seq").collect()]
    assert [found.count(b) for b in sorted(set(found))] == want


def test_epochs_by_range_agree(spark):
    rows = spark.range(500).select(F.col("id").alias("a"), (F.col("id") % 7 == 3).alias("is_barrier"))
    near = {r.a: r.epoch for r in epochs.barrier_epochs(rows, ["a"]).collect()}
    assert near == {r.a: r.epoch for r in epochs._epochs_by_range(rows, ["a"], "is_barrier").collect()}
    assert (near[2], near[3], near[4], near[10]) == (0, 1, 2, 3)


def test_full_copy_fails_on_a_repeated_key(spark):
    rows = spark.createDataFrame([("a.b", 1, "x"), ("a.b", 1, "y"), ("a.b", 2, "z")], "ns string, id long, v string")
    with pytest.raises(Exception, match="duplicate key in a.b"):
        pipelines.full_copy(rows, Config.parse(""), ["id"]).collect()
    assert pipelines.full_copy(rows.filter("v <> 'x'"), Config.parse(""), ["id"]).count() == 2


def txn_rows(spark, rows):
    return spark.createDataFrame([(k, 100 + k, 0, "c" if o.startswith('{"ap') or "Transaction" in o else "i", "a.b", o, None, b"s" if t is not None else None, t, None) for k, (o, t) in enumerate(rows)], "seq long, ts_t long, ts_i long, op string, ns string, o string, o2 string, lsid binary, txn_number long, prev_optime binary")


def test_transactions(spark):
    ops = lambda *ids, more="": '{"applyOps":[' + ",".join(f'{{"op":"i","ns":"a.b","o":{{"_id":{i}}}}}' for i in ids) + "]" + more + "}"
    log = txn_rows(spark, [(ops(1, 2, more=',"partialTxn":true'), 7), ('{"_id":50}', None), (ops(3), 7), (ops(4, more=',"prepare":true'), 8), ('{"abortTransaction":1}', 8), (ops(5), 9), (ops(6, more=',"partialTxn":true'), 10), (ops(20), None)])
    out = txn.release(txn.classify(log)).select(D.get_field(F.col("o")).alias("id"), "release_t", "ts_t", "is_barrier", "pos").orderBy("release_t", "ts_t", "pos").collect()
    assert [(r.id, r.release_t, r.ts_t, r.is_barrier) for r in out] == [("50", 101, 101, False), ("1", 102, 100, True), ("2", 102, 100, True), ("3", 102, 102, True), ("5", 105, 105, False), ("20", 107, 107, False)]
    assert [r.txn_number for r in txn.oldest_open(txn.classify(log)).collect()] == [10]
    children = txn.explode_ops(log.filter("seq = 0"), keep_children_ts=True).orderBy("pos").collect()
    assert [r.ts_i for r in children] == [0, 0] and len(txn.EMPTY_PREV) == 28


STATES = [
    ([("i", {"a": 1})], "skip", False, {"a": 1}), ([("i", {"a": 1}), ("i", {"b": 2})], "skip", False, {"a": 1}), ([("i", {"a": 1}), ("i", {"b": 2})], "merge", False, {"a": 1, "b": 2}),
    ([("i", {"a": 1}), ("i", {"b": 2})], "replace", False, {"b": 2}), ([("i", {"a": 1}), ("u", {"$set": {"a": 3}})], "skip", False, {"a": 3}), ([("u", {"$set": {"a": 3}})], "skip", False, None),
    ([("u", {"$set": {"a": 3}})], "skip", True, {"a": 3}), ([("i", {"a": 1}), ("u", {"z": 1})], "skip", False, {"z": 1}), ([("i", {"a": 1}), ("d", {})], "skip", False, None), ([("d", {})], "skip", False, None),
    ([("i", {"a": 1}), ("n", {})], "skip", False, {"a": 1}), ([("i", {"a": 1}), ("d", {}), ("i", {"c": 1})], "skip", False, {"c": 1}),
    ([("i", {"a": {"b": 1, "c": 2}}), ("u", {"$v": 2, "diff": {"sa": {"u": {"b": 9}, "d": {"c": False}}}})], "skip", False, {"a": {"b": 9}}),
    ([("i", {"l": [1, 2, 3]}), ("u", {"$v": 2, "diff": {"sl": {"a": True, "l": 1}}})], "skip", False, {"l": [1]}), ([("i", {"l": [1, 2]}), ("u", {"$set": {"l.1": 5}, "$unset": {"x": 1}})], "skip", False, {"l": [1, 5]}),
]


@pytest.mark.parametrize(("ops", "dup", "upsert", "want"), STATES)
def test_replay_states(spark, ops, dup, upsert, want):
    rows = spark.createDataFrame([("a.b", "1", op, json.dumps(o), "{}", 1, k, k) for k, (op, o) in enumerate(ops)], "ns string, id string, op string, o string, o2 string, ts_t long, ts_i long, seq long")
    found = [json.loads(r.doc) for r in replay.fold_documents(rows, ["ns", "id"], upsert, dup).collect()]
    assert found == ([] if want is None else [want])


def test_writer_modes_and_errors(spark):
    assert [replay.writer_mode(True, False, "4.2", "a.b"), replay.writer_mode(True, True, "4.2", "a.b"), replay.writer_mode(True, False, "3.0", "a.b"), replay.writer_mode(True, True, "4.2", "a.system.indexes")] == ["bulk", "command", "single", "single"]
    rows = [("u", 28, True), ("u", 28, False), ("i", 11000, True), ("d", 26, False), ("i", 26, False), ("i", 61, False)]
    frame = spark.createDataFrame(rows, "op string, code int, full boolean")
    assert [r[0] for r in frame.select(replay.error_is_ignorable(F.col("op"), F.col("code"), F.col("full"))).collect()] == [True, False, True, True, False, True]


def test_orphans(spark):
    chunks = spark.createDataFrame([((1,), (10,)), ((50,), (100,))], "mins struct<k0:long>, maxs struct<k0:long>")
    docs = spark.createDataFrame([(7,), (6,), (12,), (10,), (50,), (99,), (100,), (0,)], "x long")
    assert sorted(r.x for r in orphan.owned(docs, chunks, [F.col("x")]).collect()) == [6, 7, 50, 99]
    assert sorted(r.x for r in orphan.owned(docs, chunks, [F.col("x")], limit=1).collect()) == [6, 7, 50, 99]
    assert orphan.owned(docs, chunks.limit(0), [F.col("x")]).count() == 8


def test_checkpoints(spark, tmp_path):
    table = checkpoint.CheckpointTable(spark, str(tmp_path / "ckpt"))
    assert table.get("rs0") == 1 and table.get("rs0", 5) == 5 << 32
    table.save("rs0", 7)
    table.save("rs0", 9)
    assert table.get("rs0") == 9 and checkpoint.advance(9, 7) == 9 and checkpoint.advance(9, None) == 9
    nodes = spark.createDataFrame([("rs0", 10 << 32, 100 << 32)], "replset string, oldest long, newest long")
    saved = spark.createDataFrame([("rs0", 15 << 32, "")], "name string, ckpt long, oplog_disk_queue string")
    assert tuple(checkpoint.sync_mode(nodes, saved, "all", 1, direct=False).first())[:2] == ("incr", 15 << 32)
    early = saved.withColumn("ckpt", F.lit(5 << 32))
    assert checkpoint.sync_mode(nodes, early, "all", 1, direct=False).first().error


def test_tunnel_files(spark, tmp_path):
    blocks = [tunnel_file.encode_block([b"one", b"two", "drei ü".encode()], shard=5, how=how) for how in range(5)]
    (tmp_path / "a.bin").write_bytes(tunnel_file.encode_file(blocks))
    out = tunnel_file.read_files(spark, str(tmp_path / "*.bin"), replayers=3).orderBy("block", "pos").collect()
    assert [(r.block, r.pos, r.shard, bytes(r.log), r.valid) for r in out] == [(b, p, 2, x, True) for b in range(5) for p, x in enumerate((b"one", b"two", "drei ü".encode()))]
    assert tunnel_file.decode_message(tunnel_file.encode_message([b"x"], 0, 3))[1:] == (0, 3, 0, [b"x"])
    with pytest.raises(ValueError, match="tunnel file"):
        list(tunnel_file.decode_file(b"\0" * 40))


def test_config():
    c = Config.parse("conf.version = 10\nsync_mode = all # comment\nincr_sync.worker = 4\nfilter.namespace.white = a;b.c\nincr_sync.executor.upsert = true\nunknown.key = 3")
    assert (c.sync_mode, c.incr_sync_worker, c.filter_namespace_white, c.incr_sync_executor_upsert, c.incr_sync_tunnel_write_thread) == ("all", 4, ["a", "b.c"], True, 4)
    assert file_version("# x\nconf.version = 7\n") == 7 and file_version("") == 0
    for wrong in ("tunnel = pigeon", "filter.namespace.white = a\nfilter.namespace.black = b", "sync_mode = all\ntunnel = kafka", "tunnel.kafka.partition_number = 9", "incr_sync.worker = 300"):
        with pytest.raises(ValueError):
            Config.parse(wrong)


def test_readers(spark):
    log = spark.createDataFrame([(5, 0), (9, 3)], "ts_t long, ts_i long")
    assert readers.check_start(log, 6 << 32) == "ok" and readers.check_start(log, 10 << 32) == "ahead"
    with pytest.raises(ValueError, match="lost"):
        readers.check_start(log, 3 << 32)
    assert readers.split_bounds(spark.range(1, 101).withColumnRenamed("id", "k"), "k", 4) == [25, 50, 75] and readers.pieces_for(20 << 30, 1) == 3
    names = spark.createDataFrame([("b", "x", "collection"), ("a", "y", "timeseries"), ("a", "system.z", "collection"), ("a", "v", "view")], "db string, coll string, kind string")
    assert [r.ns for r in readers.namespaces(names).collect()] == ["a.y", "b.x"]


def test_control():
    assert apply.lease(100, "a", 90, "b") == "a" and apply.lease(106, "a", 90, "b") == "b" and apply.lease(1, None, 0, "b") == "b"
    assert apply.ticket(5, 10, 3) == (True, 2) and apply.ticket(2, 10, 3) == (False, 2) and apply.ticket(0, 0, 9) == (True, 0)


def test_repeated_batch_changes_nothing(spark, tmp_path):
    table = apply.VersionedTable(spark, str(tmp_path / "t"))
    run = apply.apply_batch(table, ["id"], ["x"])
    batch = spark.createDataFrame([("i", 1, 10, 1, 0, 0), ("d", 2, 0, 1, 1, 1)], "op string, id long, x long, ts_t long, ts_i long, seq long")
    later = spark.createDataFrame([("u", 1, 11, 2, 0, 2), ("i", 3, 5, 2, 1, 3)], "op string, id long, x long, ts_t long, ts_i long, seq long")
    for b, k in ((batch, 0), (batch, 0), (later, 1), (later, 1)):
        run(b, k)
    assert sorted(map(tuple, table.read().select("id", "x").collect())) == [(1, 11), (3, 5)] and table.versions() == [0, 1]


def test_unknown_commands(spark):
    frame = spark.createDataFrame([("c", "a.$cmd", '{"foo":1}'), ("c", "a.$cmd", '{"drop":"x","create":"y"}'), ("i", "a.b", None)], "op string, ns string, o string")
    found = frame.select(commands.command_name(F.col("o")), commands.target_ns(F.col("op"), F.col("ns"), F.col("o")), commands.is_ddl(F.col("op"), F.col("ns"), F.col("o"))).collect()
    assert [tuple(r) for r in found] == [(None, "a.$cmd", True), ("drop", "a.x", True), (None, "a.b", False)]
    assert commands.command_table(spark).count() == 16
