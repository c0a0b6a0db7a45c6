"""Tokenizers, conversions, times, bits, blocks, channels, joint quorum and sources over the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import hashing as hs
from tessera.functions import jsonops, mathops, timeops
from tessera.functions import strings as st
from tessera.functions.timeops import micros
from tessera.operators import assign, folds, kvapi, metrics, trace
from tessera.session import table
from tessera.sources import importers, raftlog


def _part(spark, d):
    return table(spark, d, "part")


def tokens(spark, d):
    s = F.concat(F.col("p_brand"), F.lit(' "a b'), F.col("p_size").cast("string"), F.lit("\\\" c\" "), F.col("p_type"), F.lit(" 'x"))
    return _part(spark, d).select("p_partkey", F.array_join(st.quoted_tokens(s, " ", "\"'"), "|").alias("quoted"), F.array_join(st.quoted_tokens(F.col("p_type"), " A", keep_delims=True), "|").alias("kept"))


def find(spark, d):
    s = F.col("p_type")
    return _part(spark, d).select(
        "p_partkey",
        st.find(s, F.lit("A")).cast("int").alias("first_a"),
        st.find(s, F.lit("A"), 6).cast("int").alias("next_a"),
        st.rfind(s, F.lit("E")).cast("int").alias("last_e"),
        st.find_first_of(s, "AEIOU").cast("int").alias("vowel"),
        st.find_first_of(s, "ABCDEFGHIJKLMNOPQRS", negated=True).cast("int").alias("other"),
        st.find_last_of(s, " ").cast("int").alias("space"),
        st.without_ends(s, 2, 3).alias("middle"),
        st.compare(s, F.lit("M")).cast("int").alias("cmp"),
        st.equals_ignoring_case(s, F.lower(s)).alias("same"),
        st.equals_ignoring_case(s, F.lit("stand"), 5).alias("standard"),
        F.format_string("%05d:%s", "p_size", "p_brand").alias("printed"),
    )


def convert(spark, d):
    n = F.col("p_partkey")
    text = F.when(n % 4 == 0, F.concat(n.cast("string"), F.lit(".5e1"))).when(n % 4 == 1, F.concat(F.lit("-"), n.cast("string"))).when(n % 4 == 2, F.lit("1e999")).otherwise(F.lit("x1"))
    h = F.when(n % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex(n)))).when(n % 3 == 1, F.concat(F.lit("-"), F.hex(n))).otherwise(F.lit("FFFFFFFFFFFFFFFFF"))
    return _part(spark, d).select(
        "p_partkey",
        st.to_double(text)["ok"].alias("ok"),
        st.to_double(text)["value"].alias("num"),
        st.to_unsigned(text)["ok"].alias("u_ok"),
        st.hex_to_int(h)["ok"].alias("h_ok"),
        st.hex_to_int(h)["value"].alias("h_num"),
        st.hex_digit(F.substring(F.hex(n), -1, 1)).alias("digit"),
        F.decode(st.hex_to_bytes(F.hex("p_brand")), "UTF-8").alias("brand"),
        (st.from_utf16(st.to_utf16(F.col("p_name"))) == F.col("p_name")).alias("utf16_same"),
        st.from_latin1(F.unhex(F.lit("41E9"))).alias("latin"),
    )


def names(spark, d):
    s = F.concat(F.col("p_size").cast("string"), F.lit("-"), F.col("p_brand"), F.lit(".x_Z999_"))
    e = _part(spark, d).select("p_partkey", s.alias("s"), st.encode_name(s).alias("encoded"))
    return e.select("p_partkey", "encoded", (st.decode_name(F.col("encoded")) == F.col("s")).alias("same"))


def valid_text(spark, d):
    c = table(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.unhex(F.lit("41C3"))).when(F.col("c_custkey") % 3 == 1, F.unhex(F.lit("EFBFBE"))).otherwise(F.col("c_name").cast("binary"))
    return c.select("c_custkey", st.is_utf8_text(raw).alias("ok"))


def spans(spark, d):
    o = table(spark, d, "orders")
    us = F.col("o_orderkey") * 7_654_321 - F.lit(timeops.delta(days=1, hours=2, seconds=0.5))
    return o.select("o_orderkey", *[c.alias(k) for k, c in timeops.span_parts(us).items()])


def parse_times(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", micros("o_orderdate").alias("us"))
    ts = F.col("o_orderdate").cast("timestamp_ntz")
    kinds = ("yyyy-MM-dd HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm:ss")
    text = F.when(F.col("o_orderkey") % 5 == 4, F.lit("soon"))
    for i, k in enumerate(kinds):
        text = text.when(F.col("o_orderkey") % 5 == i, F.concat(F.date_format(ts, k), F.lit(" GMT" if i == 1 else "")))
    x = timeops.exploded(ts)
    built = timeops.from_exploded(x["year"], x["month"], x["day_of_month"], x["hour"], x["minute"], x["second"])
    spec = timeops.timespec(-F.col("us") - 1)
    return o.select("o_orderkey", timeops.parse_time(text).alias("parsed"), built.alias("built"), spec["sec"].alias("sec"), spec["nsec"].alias("nsec"), timeops.from_timespec(spec).alias("back"))


def finite(spark, d):
    li = table(spark, d, "lineitem")
    x = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("-inf"))).otherwise(F.col("l_tax"))
    return li.groupBy("l_linenumber").agg(F.count(F.when(mathops.is_finite(x), 1)).alias("n"))


def bits(spark, d):
    p = _part(spark, d)
    i = F.col("p_partkey") % 128
    two = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    w = mathops.bits_set(mathops.bits_set(two, i), F.lit(100).cast("long"))
    off = mathops.bits_set(w, F.lit(100).cast("long"), on=False)
    at = F.lit(70).cast("long")
    return p.select(
        "p_partkey",
        mathops.bits_get(w, F.col("p_size") % 128).alias("held"),
        mathops.bits_first(w, F.lit(0).cast("long"), F.lit(128).cast("long")).cast("long").alias("first"),
        mathops.bits_first(w, at, F.lit(128).cast("long")).cast("long").alias("later"),
        mathops.bits_first(off, at, F.lit(120).cast("long")).cast("long").alias("bounded"),
        mathops.bits_first(mathops.bits_cleared(w, i + 1), F.lit(0).cast("long"), F.lit(128).cast("long")).cast("long").alias("cleared"),
    )


def packed(spark, d):
    c = table(spark, d, "customer")
    raw = hs.raw_pack((F.col("c_custkey"), 4), (F.col("c_nationkey"), 2), (-F.col("c_custkey"), 8))
    a, b, e = hs.raw_unpack(raw, 4, 2, 8)
    head, rest = hs.cut(raw, F.lit(4))
    u = hs.cut_until(F.concat("c_name", F.lit("::"), "c_mktsegment").cast("binary"), "::")
    none = hs.cut_until(F.col("c_name").cast("binary"), "::")
    return c.select("c_custkey", F.hex(raw).alias("raw"), a.alias("a"), b.alias("b"), e.alias("e"), F.hex(head).alias("head"), F.octet_length(rest).alias("n_rest"), F.decode(u["head"], "UTF-8").alias("name"), F.decode(u["rest"], "UTF-8").alias("segment"), (none["head"].isNull() & ~none["found"]).alias("missing"))


def random(spark, d):
    c = table(spark, d, "customer").select("c_custkey", hs.random_int(3, 7, F.col("c_custkey")).alias("r"), hs.guid(F.col("c_custkey")).alias("g"), hs.random_printable(12, F.col("c_custkey")).alias("p"), hs.base64_decode(F.when(F.col("c_custkey") % 2 == 0, F.lit("aGk=")).otherwise(F.lit("a*"))).alias("b"))
    return c.select("c_custkey", F.col("r").between(3, 7).alias("inside"), hs.is_guid(F.col("g")).alias("valid"), hs.is_guid(F.concat("g", F.lit("0"))).alias("longer"), F.col("p").rlike("^[!-~]{12}$").alias("printable"), F.col("b.ok").alias("ok"), F.decode("b.value", "UTF-8").alias("text"))


def zipped(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("a"), F.sort_array(F.collect_set("l_suppkey")).alias("b"))
    return li.select("l_orderkey", F.posexplode(jsonops.zip_by_position(F.col("a"), F.col("b"))).alias("pos", "x")).select("l_orderkey", "pos", "x.a", "x.b")


def case_map(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("es"))
    entries = F.transform("es", lambda x: F.struct(F.when(x["event_id"] % 2 == 0, F.upper(x["event_type"])).otherwise(x["event_type"]).alias("key"), x["event_id"].alias("value")))
    return e.select("user_id", jsonops.get_ignoring_case(jsonops.map_ignoring_case(entries), F.lit("Click")).alias("click"))


def reduced(spark, d):
    li = table(spark, d, "lineitem")
    return metrics.reduce_by(li, ["l_returnflag"], F.col("l_orderkey"), lambda a, b: a.bitwiseXOR(b), F.lit(0).cast("long"), "folded")


def stats(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_shipdate", "l_returnflag").agg(metrics.stat(F.col("l_linenumber").cast("long")).alias("s"))
    a = li.groupBy("l_returnflag").agg(F.struct(F.sum("s.sum").alias("sum"), F.sum("s.num").alias("num")).alias("every"))
    one = table(spark, d, "lineitem").where("l_quantity > 25").groupBy("l_returnflag").agg(metrics.stat(F.col("l_linenumber").cast("long")).alias("big"))
    both = metrics.derived(a.join(one, "l_returnflag"), rest=metrics.merged_stat(F.col("every"), F.col("big"), unmerge=True))
    return both.select("l_returnflag", F.col("rest.sum").alias("total"), F.col("rest.num").alias("num"), F.round(F.col("rest.sum") / F.col("rest.num"), 9).alias("mean"))


def timers(spark, d):
    e = table(spark, d, "events").select("event_type", micros("ts").alias("begin"), (micros("ts") + F.floor("value").cast("long")).alias("over"))
    return metrics.timed(e, "event_type", "begin", "over", 30 * timeops.DAY)


def counters(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor("value").cast("long").alias("v"))
    return metrics.counter_bundle(e, "event_type", "v")


def mru_state(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "click", "get").when(F.col("event_type") == "error", "erase").when(F.col("event_type") == "signup", "peek").otherwise("put")
    return trace.mru_state(e.select("user_id", "event_id", op.alias("op")), "user_id", "event_id", "op", 10)


def sortedness(spark, d):
    o = table(spark, d, "orders")
    a = trace.is_sorted(o, "o_orderkey", "o_orderkey").select(F.lit("key").alias("what"), "is_sorted")
    return a.unionByName(trace.is_sorted(o, "o_orderkey", "o_totalprice").select(F.lit("price").alias("what"), "is_sorted"))


def _servers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("server"), F.col("s_nationkey").alias("zone"), F.concat((F.floor(F.col("s_suppkey") / 2) % 6).cast("string"), F.lit("/"), F.when(F.col("s_suppkey") % 2 == 0, "3").otherwise("4")).alias("tag"))


def watchers(spark, d):
    s = _servers(spark, d)
    return assign.feed(s.where("server % 3 <> 0"), s.where("server % 4 <> 0"), "server", {"low": F.col("zone") < 12, "all": F.lit(True)})


def skipped(spark, d):
    li = table(spark, d, "lineitem")
    calls = li.groupBy("l_orderkey", F.pmod("l_partkey", F.lit(4)).alias("pid")).agg(F.sum(F.floor("l_quantity")).alias("q"), F.max((F.col("l_discount") > 0.09).cast("int")).alias("bad"))
    action = F.when((F.col("pid") == 3) & (F.col("l_orderkey") % 5 == 0), "bad").when(F.col("pid") == 2, "skip").otherwise("call")
    return assign.sub_calls(calls, "l_orderkey", action, F.col("bad") == 1, F.col("q"), 2)


def probed(spark, d):
    alive = [i % 3 != 1 for i in range(10)]
    return assign.randomized(table(spark, d, "orders").select("o_orderkey"), (F.col("o_orderkey") % 20) / F.lit(20.0), 4, alive)


def dynamic(spark, d):
    u = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return assign.dynamic_partitions(table(spark, d, "orders").select("o_orderkey"), u, _servers(spark, d)).select("o_orderkey", "parts")


def retries(spark, d):
    li = table(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return assign.retried(li, "l_orderkey", "o", F.col("l_discount") > 0.03, F.col("l_returnflag") != "R", 2)


def backups(spark, d):
    o = table(spark, d, "orders")
    b = assign.backup(F.col("o_orderkey") % 1000, F.col("o_custkey") % 300, 400)
    return o.select("o_orderkey", b["us"].alias("us"), b["backed_up"].alias("backed_up"))


def admitted(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", micros("ts").alias("begin"), (micros("ts") + F.floor(F.col("value") * 100_000_000).cast("long")).alias("over"))
    return assign.constant_limit(e, "event_type", "begin", "over", 3).select("event_id", "under_way", "admitted")


def joint(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 11).alias("grp"), "l_suppkey").agg(F.sum("l_linenumber").alias("at"))
    m = m.withColumns({"old": F.col("l_suppkey") % 3 != 0, "new": F.col("l_suppkey") % 2 == 0})
    return folds.joint_quorum(m, "grp", "at", "old", "new")


def _ops(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("log_index"), F.col("event_type").alias("value"))


def snapshot_replay(spark, d):
    ops = _ops(spark, d)
    return folds.replay_from(folds.snapshot_at(ops, "key", "log_index", 500), ops, "key", "log_index", 500)


def throttle_returns(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.struct("l_orderkey", "l_partkey", "l_extendedprice").alias("o"), "l_orderkey", F.floor("l_quantity").cast("long").alias("bytes"), F.lit(0).cast("long").alias("used"))
    t = folds.throttle(li, ["l_suppkey"], "l_linenumber", "o", "bytes", 40, used="used")
    return t.select("l_suppkey", "l_linenumber", "l_orderkey", "granted")


def blocks(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    w = c.select("conv_id", "turn", (F.col("turn") * 5).cast("long").alias("at"), F.col("role").cast("binary").alias("data"))
    return importers.read_blocks(w, "conv_id", "turn", 3, 12).select("conv_id", F.hex("data").alias("data"))


def replicas(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("write"), F.lit(3).alias("replicas"))
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("write"), F.col("l_linenumber").alias("node"), (F.col("l_discount") < 0.08).alias("ok"))
    return kvapi.replicated(o, a)


def copied(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), F.col("c_nationkey").alias("pid"))
    return kvapi.copy_batches(c, F.lit(7), 10).groupBy("batch").agg(F.count("*").alias("n"))


def json_lines(spark, d):
    e = table(spark, d, "events")
    lines = e.select(F.when(F.col("event_id") % 7 == 0, F.lit("{oops")).when(F.col("event_id") % 7 == 1, F.lit(" ")).otherwise(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('"}'))).alias("value"))
    r = importers.load_json_lines(lines, "id long, kind string")
    return r.groupBy("ok", F.col("request.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum("request.id").alias("ids"))


def endpoints(spark, d):
    c = table(spark, d, "customer")
    t = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("[::1]:"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("host-"), F.col("c_nationkey").cast("string"), F.lit(":80"))).otherwise(F.lit("host:99999"))
    return c.select("c_custkey", mathops.endpoint(t)["host"].alias("host"), mathops.endpoint(t)["port"].alias("port"))


def typed_fields(spark, d):
    s = F.concat_ws(",", F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("x"), "p_brand")
    e = st.with_flag(F.col("p_brand"), st.remove_chars(F.col("p_brand"), "3"))
    return _part(spark, d).select(st.fields_as(s, ",", {"id": "long", "size": "int", "brand": "string"}).alias("f"), e.alias("e")).select("f.*", F.col("e.value").alias("less"), F.col("e.changed").alias("changed"))


def channels(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return assign.selective(o, "o_orderkey", 5, lambda c: (F.col("o_custkey") + c) % 3 == 0, 1, 2).select("o_orderkey", "channel")


def log_segments(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("es"))

    def run(batches):
        for b in batches:
            out = []
            for user, es in zip(b["user_id"], b["es"], strict=True):
                rows = [(i + 1, int(x["event_id"]), 1, x["event_type"].encode()) for i, x in enumerate(es)]
                raw = b"".join(raftlog.entry(term, kind, data, i % 2) for i, term, kind, data in rows)
                out.append((user, len(raw), list(raftlog.entries(raw + raw[:10], 1, len(rows))) == rows))
            yield pd.DataFrame(out, columns=["user_id", "n_bytes", "same"])

    return e.mapInPandas(run, "user_id long, n_bytes long, same boolean")


QUERIES = {
    "log_segments": log_segments,
    "str_typed_fields": typed_fields, "selective_channel": channels,
    "str_tokens": tokens, "str_find": find, "str_convert": convert, "str_encode_name": names, "str_valid_text": valid_text,
    "time_spans": spans, "time_parse": parse_times, "math_finite": finite, "bit_array": bits, "bytes_pack_cut": packed,
    "random_guid": random, "zip_by_position": zipped, "map_ignoring_case": case_map, "metric_reduce_op": reduced, "metric_stat_unmerge": stats,
    "metric_timers": timers, "metric_counter_bundle": counters, "mru_state": mru_state, "is_sorted": sortedness, "server_watchers": watchers,
    "sub_call_actions": skipped, "randomized_probe": probed, "dynamic_partitions": dynamic, "retry_attempts": retries, "backup_request": backups,
    "constant_limit": admitted, "quorum_joint": joint, "snapshot_replay": snapshot_replay, "throttle_returns": throttle_returns, "block_read": blocks,
    "kv_replicated_write": replicas, "kv_copy_batches": copied, "json_lines": json_lines, "net_endpoints": endpoints,
}

_BUNDLE = "SELECT event_type, count(*) AS count, CAST(trunc(sum(v) / count(*)) AS BIGINT) AS avg, max(v) AS max, {0}list(v ORDER BY v)[CAST(ceil(0.8 * count(*)) AS BIGINT)] AS p80, list(v ORDER BY v)[CAST(ceil(0.9 * count(*)) AS BIGINT)] AS p90, list(v ORDER BY v)[CAST(ceil(0.99 * count(*)) AS BIGINT)] AS p99, list(v ORDER BY v)[CAST(ceil(0.999 * count(*)) AS BIGINT)] AS p999, list(v ORDER BY v)[CAST(ceil(0.9999 * count(*)) AS BIGINT)] AS p9999 FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS v FROM events WHERE floor(value) >= 0) GROUP BY 1"
_SPLIT = "list_filter(string_split(p_type, '{0}'), lambda x: x <> '')"
_QUORUM = "(SELECT grp, l[CAST(floor(len(l) / 2) AS INTEGER) + 1] AS c FROM (SELECT grp, list(m ORDER BY m DESC) AS l FROM m WHERE {0} GROUP BY grp))"
ORACLES = {
    "log_segments": "SELECT user_id, CAST(sum(24 + strlen(event_type)) AS BIGINT) AS n_bytes, true AS same FROM events GROUP BY 1",
    "str_typed_fields": "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size END AS size, p_brand AS brand, replace(p_brand, '3', '') AS less, p_brand LIKE '%3%' AS changed FROM part",
    "selective_channel": "SELECT o_orderkey, CAST(list_filter(list_transform(range(2), lambda k: (o_orderkey + k) * 2 % 5), lambda c: (o_custkey + c) % 3 <> 0)[1] AS INTEGER) AS channel FROM orders",
    "str_tokens": r"""SELECT p_partkey, p_brand || '|"a b' || p_size || '\" c"|' || replace(p_type, ' ', '|') || '|''x' AS quoted, array_to_string(list_filter(string_split_regex(regexp_replace(p_type, '([ A])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), '|') AS kept FROM part""",
    "str_find": """SELECT p_partkey, CAST(strpos(p_type, 'A') - 1 AS INTEGER) AS first_a, CAST(CASE WHEN strpos(substr(p_type, 7), 'A') > 0 THEN strpos(substr(p_type, 7), 'A') + 5 ELSE -1 END AS INTEGER) AS next_a, CAST(CASE WHEN strpos(p_type, 'E') > 0 THEN length(p_type) - strpos(reverse(p_type), 'E') ELSE -1 END AS INTEGER) AS last_e, CAST(CASE WHEN regexp_matches(p_type, '[AEIOU]') THEN length(regexp_extract(p_type, '^[^AEIOU]*')) ELSE -1 END AS INTEGER) AS vowel, CAST(CASE WHEN regexp_matches(p_type, '[^A-S]') THEN length(regexp_extract(p_type, '^[A-S]*')) ELSE -1 END AS INTEGER) AS other, CAST(CASE WHEN strpos(p_type, ' ') > 0 THEN length(p_type) - strpos(reverse(p_type), ' ') ELSE -1 END AS INTEGER) AS space, substr(p_type, 3, length(p_type) - 5) AS middle, CASE WHEN p_type < 'M' THEN -1 WHEN p_type > 'M' THEN 1 ELSE 0 END AS cmp, true AS same, p_type LIKE 'STAND%' AS standard, printf('%05d:%s', p_size, p_brand) AS printed FROM part""",
    "str_convert": """SELECT p_partkey, p_partkey % 4 < 2 AS ok, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey || '.5e1' AS DOUBLE) WHEN 1 THEN CAST(-p_partkey AS DOUBLE) END AS num, false AS u_ok, p_partkey % 3 < 2 AS h_ok, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN -p_partkey END AS h_num, CAST(p_partkey % 16 AS INTEGER) AS digit, p_brand AS brand, true AS utf16_same, 'Aé' AS latin FROM part""",
    "str_encode_name": "SELECT p_partkey, '_Z0' || ascii(CAST(p_size AS VARCHAR)) || '_' || substr(CAST(p_size AS VARCHAR), 2) || '_Z045_' || replace(p_brand, '#', '_Z035_') || '_Z046_x_Z999_' AS encoded, true AS same FROM part",
    "str_valid_text": "SELECT c_custkey, c_custkey % 3 = 2 AS ok FROM customer",
    "time_spans": "SELECT o_orderkey, " + ", ".join(f"CAST(sign(us) AS BIGINT) * (abs(us) // {n}) AS {k}" for k, n in (("days", 86_400_000_000), ("hours", 3_600_000_000), ("minutes", 60_000_000), ("seconds", 1_000_000), ("ms", 1000))) + ", CASE WHEN us > 0 THEN (us + 999) // 1000 ELSE -(abs(us) // 1000) END AS ms_up FROM (SELECT o_orderkey, o_orderkey * 7654321 - 93600500000 AS us FROM orders)",
    "time_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN us // 1000000 * 1000000 END AS parsed, us // 1000000 * 1000000 AS built, -(us // 1000000) - 1 AS sec, 1000000000 - 1000 * (us % 1000000 + 1) AS nsec, -us - 1 AS back FROM (SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders)",
    "math_finite": "SELECT l_linenumber, CASE WHEN l_linenumber < 3 THEN 0 ELSE count(*) END AS n FROM lineitem GROUP BY 1",
    "bit_array": "SELECT p_partkey, p_size % 128 IN (i, 100) AS held, least(i, 100) AS first, CASE WHEN i >= 70 THEN least(i, 100) ELSE 100 END AS later, CASE WHEN i >= 70 AND i < 120 AND i <> 100 THEN i ELSE 120 END AS bounded, CAST(CASE WHEN i < 100 THEN 100 ELSE 128 END AS BIGINT) AS cleared FROM (SELECT p_partkey, p_size, p_partkey % 128 AS i FROM part)",
    "bytes_pack_cut": "SELECT c_custkey, printf('%08X', c_custkey) || printf('%04X', c_nationkey) || lpad(hex(-c_custkey), 16, '0') AS raw, c_custkey AS a, CAST(c_nationkey AS BIGINT) AS b, -c_custkey AS e, printf('%08X', c_custkey) AS head, 10 AS n_rest, c_name AS name, c_mktsegment AS segment, true AS missing FROM customer",
    "random_guid": "SELECT c_custkey, true AS inside, true AS valid, false AS longer, true AS printable, c_custkey % 2 = 0 AS ok, CASE WHEN c_custkey % 2 = 0 THEN 'hi' END AS text FROM customer",
    "zip_by_position": "WITH a AS (SELECT l_orderkey, l_partkey AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS pos FROM lineitem), b AS (SELECT l_orderkey, b, row_number() OVER (PARTITION BY l_orderkey ORDER BY b) - 1 AS pos FROM (SELECT DISTINCT l_orderkey, l_suppkey AS b FROM lineitem)) SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, a, b FROM a LEFT JOIN b USING (l_orderkey, pos)",
    "map_ignoring_case": "SELECT user_id, max(event_id) FILTER (WHERE event_type = 'click') AS click FROM events GROUP BY 1",
    "metric_reduce_op": "SELECT l_returnflag, CAST(bit_xor(l_orderkey) AS BIGINT) AS folded FROM lineitem GROUP BY 1",
    "metric_stat_unmerge": "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS num, round(sum(l_linenumber) / count(*), 9) AS mean FROM lineitem WHERE l_quantity <= 25 GROUP BY 1",
    "metric_timers": _BUNDLE.format("CAST(round(count(*) * 1e6 / 2592000000000) AS BIGINT) AS qps, "),
    "metric_counter_bundle": _BUNDLE.format(""),
    "mru_state": "SELECT user_id, last_touch FROM (SELECT user_id, max(event_id) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS last_touch, max(event_id) FILTER (WHERE event_type IN ('view', 'purchase')) AS put, coalesce(max(event_id) FILTER (WHERE event_type = 'error'), -1) AS gone FROM events GROUP BY 1) WHERE put > gone ORDER BY last_touch DESC, user_id LIMIT 10",
    "is_sorted": "SELECT 'key' AS what, true AS is_sorted UNION ALL SELECT 'price', count(*) = 0 FROM (SELECT o_totalprice < lag(o_totalprice) OVER (ORDER BY o_orderkey) AS fell FROM orders) WHERE fell",
    "server_watchers": "WITH c AS (SELECT s_suppkey AS server, s_nationkey AS zone, CASE WHEN s_suppkey % 4 = 0 THEN 'added' ELSE 'removed' END AS change FROM supplier WHERE (s_suppkey % 3 <> 0) <> (s_suppkey % 4 <> 0)) SELECT 'all' AS watcher, server, change FROM c UNION ALL SELECT 'low', server, change FROM c WHERE zone < 12",
    "sub_call_actions": "SELECT l_orderkey, CASE WHEN max(x) = 0 THEN CAST(coalesce(sum(q) FILTER (WHERE pid <> 2 AND bad = 0), 0) AS BIGINT) ELSE 0 END AS value, max(x) = 0 AND count(*) FILTER (WHERE pid <> 2) > 0 AND coalesce(sum(bad) FILTER (WHERE pid <> 2), 0) < least(2, count(*) FILTER (WHERE pid <> 2)) AS ok FROM (SELECT l_orderkey, l_partkey % 4 AS pid, sum(CAST(floor(l_quantity) AS BIGINT)) AS q, max(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS bad, CASE WHEN l_partkey % 4 = 3 AND l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS x FROM lineitem GROUP BY 1, 2, 5) GROUP BY 1",
    "randomized_probe": "SELECT o_orderkey, CAST(list_filter(list_transform(range(10), lambda i: (CAST(floor((o_orderkey % 20) / 2.0) AS BIGINT) + i * 7) % 10), lambda s: s % 3 <> 1)[1] AS INTEGER) AS server FROM orders",
    "dynamic_partitions": "WITH t AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 4 END AS total, s_suppkey // 2 % 6 AS i FROM supplier), p AS (SELECT total, count(DISTINCT i) AS n, count(*) AS w FROM t WHERE i < total GROUP BY 1), s AS (SELECT total, w, sum(w) OVER (ORDER BY total) AS hi, sum(w) OVER () AS every FROM p WHERE n = total), r AS (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM orders) SELECT o_orderkey, total AS parts FROM r, s WHERE floor(u * every) >= hi - w AND floor(u * every) < hi",
    "retry_attempts": "WITH a AS (SELECT l_orderkey, l_discount > 0.03 AS f, l_returnflag <> 'R' AS again, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, CAST(min(i) AS INTEGER) AS attempt, NOT arg_min(f, i) AS ok FROM a WHERE i <= 2 AND (NOT f OR NOT again OR i = least(2, n - 1)) GROUP BY 1",
    "backup_request": "SELECT o_orderkey, CASE WHEN a > 400 THEN least(a, b + 400) ELSE a END AS us, a > 400 AND b + 400 < a AS backed_up FROM (SELECT o_orderkey, o_orderkey % 1000 AS a, o_custkey % 300 AS b FROM orders)",
    "constant_limit": "WITH e AS (SELECT event_type, event_id, epoch_us(ts) AS b, epoch_us(ts) + CAST(floor(value * 100000000) AS BIGINT) AS x FROM events), u AS (SELECT event_type, event_id, b AS t, 1 AS step, b, x FROM e UNION ALL SELECT event_type, NULL, x, -1, NULL, NULL FROM e), s AS (SELECT *, sum(step) OVER (PARTITION BY event_type ORDER BY t, step, b, x, event_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS n FROM u) SELECT event_id, CAST(n AS BIGINT) AS under_way, n <= 3 AS admitted FROM s WHERE step = 1",
    "quorum_joint": f"WITH m AS (SELECT l_suppkey % 11 AS grp, l_suppkey AS s, CAST(sum(l_linenumber) AS BIGINT) AS m FROM lineitem GROUP BY 1, 2) SELECT coalesce(a.grp, b.grp) AS grp, least(a.c, b.c) AS committed FROM {_QUORUM.format('s % 3 <> 0')} a FULL JOIN {_QUORUM.format('s % 2 = 0')} b ON a.grp = b.grp",
    "snapshot_replay": "SELECT user_id AS key, max(event_id) AS log_index, arg_max(event_type, event_id) AS value FROM events GROUP BY 1",
    "throttle_returns": "SELECT l_suppkey, l_linenumber, l_orderkey, least(40, CAST(floor(l_quantity) AS BIGINT)) AS granted FROM lineitem",
    "block_read": "WITH w AS (SELECT conv_id, turn, unnest(range(length(role))) AS i, role FROM conversations WHERE text IS NOT NULL), x AS (SELECT conv_id, turn * 5 + i AS place, arg_max(hex(substr(role, CAST(i + 1 AS BIGINT), 1)), turn) AS h FROM w GROUP BY 1, 2), k AS (SELECT DISTINCT conv_id FROM x WHERE place BETWEEN 3 AND 14) SELECT k.conv_id, string_agg(coalesce(h, '00'), '' ORDER BY p) AS data FROM k CROSS JOIN (SELECT unnest(range(3, 15)) AS p) LEFT JOIN x ON x.conv_id = k.conv_id AND place = p GROUP BY 1",
    "kv_replicated_write": "SELECT o_orderkey AS write, coalesce(n, 0) >= 3 AS ok FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_discount < 0.08 GROUP BY 1) ON l_orderkey = o_orderkey",
    "kv_copy_batches": "SELECT b AS batch, least(10, n - 10 * b) AS n FROM (SELECT count(*) AS n FROM customer WHERE c_nationkey = 7), (SELECT unnest(range(100000)) AS b) WHERE 10 * b < n",
    "json_lines": "SELECT event_id % 7 <> 0 AS ok, CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind, count(*) AS n, CAST(sum(CASE WHEN event_id % 7 <> 0 THEN event_id END) AS BIGINT) AS ids FROM events WHERE event_id % 7 <> 1 GROUP BY 1, 2",
    "net_endpoints": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey <= 65535 THEN '::1' END WHEN 1 THEN 'host-' || c_nationkey END AS host, CAST(CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey <= 65535 THEN c_custkey END WHEN 1 THEN 80 END AS INTEGER) AS port FROM customer",
}
