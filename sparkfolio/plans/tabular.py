"""Queries of tables, renditions, conversations and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions import models, text
from ..operators import access, chunking, context, tables
from ..operators import tree as folder_tree
from ..operators.store import FileStore
from ..session import shared_folder
from ..sources import event_stream, log_stream
from ..sources import events as parse_events
from ..sources import read_table
from ..streaming import decisions, ingest
from .registry import query

_AT = "to_timestamp('2026-01-02 00:00:00')"


@query("""
    select doc_id::varchar as file_uid, case when doc_id % 2 = 0 then 'v2' else 'v1' end as source_version,
           md5(case when doc_id % 4 = 0 then 'new ' || lang else text end) as text_md5, doc_id % 2 = 0 as updated from documents
    union all select 'new' || region.r_regionkey, 'v2', md5('new ' || r_name), true from region""")
def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    old = docs.select(F.col("doc_id").cast("string").alias("file_uid"), F.lit("v1").alias("source_version"), F.col("text").alias("content_md"), F.lit("2026-01-01").cast("timestamp").alias("created_at"), F.lit("2026-01-01").cast("timestamp").alias("updated_at"))
    new = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("file_uid"), F.lit("v2").alias("source_version"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("new "), "lang")).alias("content_md"))
    more = read_table(spark, sf_dir, "region").select(F.concat(F.lit("new"), "r_regionkey"), F.lit("v2"), F.concat(F.lit("new "), "r_name"))
    out = tables.upsert(old, new.union(more), F.lit("2026-01-02").cast("timestamp"))
    return out.select("file_uid", "source_version", F.md5(F.col("content_md").cast("binary")).alias("text_md5"), (F.col("updated_at") == F.lit("2026-01-02").cast("timestamp")).alias("updated"))


@query("""
    select 'orders' as kind, count(*) as n from orders where o_custkey % 3 <> 0
    union all select 'lineitem', count(*) from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 3 <> 0""")
def doc_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents and their lines as chunks."""
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    docs = orders.select(F.col("o_orderkey").alias("file_uid"), "o_custkey")
    gone = docs.filter("o_custkey % 3 = 0")
    kept, chunks = tables.delete(docs, gone), tables.delete(lines.select(F.col("l_orderkey").alias("file_uid")), gone)
    counted = lambda df, kind: df.select(F.lit(kind).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return counted(kept, "orders").union(counted(chunks, "lineitem"))


@query("""
    select l_orderkey, count(*) as n, sum(case when l_orderkey % 2 = 0 then 1 else 0 end)::bigint as fresh
    from (select l_orderkey from lineitem where l_orderkey % 2 = 1 union all select o_orderkey from orders where o_orderkey % 2 = 0) group by 1""")
def chunk_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(0).alias("fresh"))
    new = read_table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("fresh"))
    return tables.replace(lines, new, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("fresh").alias("fresh"))


@query("select user_id, max(event_id) as event_id from events group by 1")
def newest_version_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").withColumn("version", F.format_string("%012d", "event_id"))
    return tables.newest(rows, "user_id", "version").select("user_id", "event_id")


def _file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's events as file events of the JSON log."""
    rows = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "file.created").when(F.col("event_type") == "view", "file.updated").when(F.col("event_type") == "purchase", "file.deleted").otherwise(F.concat(F.lit("x."), "event_type"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), kind.alias("type"), F.lit("t").alias("tenant"), F.col("user_id").cast("string").alias("file_uid"), ingest.stamp(F.col("ts")).alias("ts"), (F.col("event_id") % 10 == 0).alias("is_rendition"), F.lit(1).alias("unknown")))
    return parse_events(rows.select(line.alias("value")))


_ROUTED = """
    select event_id::varchar as event_id, user_id::varchar as file_uid, ts,
           case event_type when 'click' then 'convert' when 'view' then 'convert' when 'purchase' then 'delete' end as action
    from events where event_type in ('click', 'view', 'purchase') and event_id % 10 <> 0"""


@query(f"select event_id, file_uid, action from ({_ROUTED})")
def event_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.routed(_file_events(spark, sf_dir)).select("event_id", "file_uid", "action")


@query("select event_id::varchar as event_id from events")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _file_events(spark, sf_dir)
    return ingest.deduplicated(twice.union(twice)).select("event_id")


@query(f"select file_uid, max(strftime(ts, '%Y%m%d_%H%M%S.%g')) as ts from ({_ROUTED}) group by 1")
def event_latest_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_actions(_file_events(spark, sf_dir)).select("file_uid", "ts")


@query(f"""
    select file_uid, arg_max(action, (ts, event_id)) as action, strftime(max(ts), '%Y%m%d_%H%M%S.%g') as ts from ({_ROUTED}) group by 1""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream in one batch, its result left as a table: files to convert and to delete."""
    folder = shared_folder(spark)
    log, out = f"{folder}/log-{uuid.uuid4().hex}", f"{folder}/out-{uuid.uuid4().hex}"
    _file_events(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(log)
    def handle(convert: DataFrame, delete: DataFrame, number: int) -> None:
        both = convert.union(delete).select("file_uid", "action", "ts")
        both.write.mode("overwrite").parquet(f"{out}/batch={number}")

    ingest.ingest(event_stream(spark, log, 100), handle, f"{out}-checkpoint", once=True).awaitTermination()
    return tables.newest(spark.read.parquet(out), "file_uid", "ts").select("file_uid", "action", "ts")


@query("""
    select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.windowed(read_table(spark, sf_dir, "events"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from g)
    select user_id, min(ts) as start, max(ts) + interval 30 minute as end, count(*) as n from s group by user_id, k""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.sessions(read_table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""
    select o_orderkey::varchar as file_uid, case when o_orderstatus = 'P' or (o_orderstatus = 'F' and o_orderkey % 2 = 0) then 'conversion.failed' else 'conversion.complete' end as type,
           case when o_orderstatus = 'P' then 'unsupported' when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'error' end as reason,
           case when o_orderstatus = 'P' or (o_orderstatus = 'F' and o_orderkey % 2 = 0) then '' when o_orderkey % 2 = 0 then 'text,pdf' when o_orderstatus = 'O' then 'text,pdf' else 'text' end as renditions
    from orders""")
def terminal_event_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "unsupported").otherwise("indexed")
    text = (F.col("o_orderkey") % 2 == 1) | (F.col("o_orderstatus") == "O")
    children = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("v-1-pdf.pdf"), F.lit("v-1-pdf.PDF"), F.lit("other.pdf"))).otherwise(F.array(F.lit("notes-x.txt")))
    found = tables.terminal_events(rows.select(F.col("o_orderkey").cast("string").alias("file_uid"), status.alias("status"), text.alias("has_text"), children.alias("children")))
    return found.select("file_uid", "type", "reason", F.array_join("renditions", ",").alias("renditions"))


@query("""
    select case when o_orderkey % 11 = 0 then 'skipped' when o_orderkey % 3 = 0 and o_orderstatus <> 'P' then 'current' else 'outdated' end as status, count(*) as n from orders group by 1""")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    files = orders.select(F.col("o_orderkey").alias("file_uid"), F.lit("v2").alias("version"), (F.col("o_orderkey") % 11 == 0).alias("is_dir"))
    docs = orders.select(F.col("o_orderkey").alias("file_uid"), F.when(F.col("o_orderkey") % 3 == 0, "v2").otherwise("v1").alias("source_version"), F.when(F.col("o_orderstatus") == "P", "unsupported").otherwise("indexed").alias("status"))
    return tables.sweep_counts(files, docs)


@query("""
    select p_partkey, p_brand || '-' || p_size as version, case p_size % 3 when 0 then 'preview' when 1 then 'pdf' end as kind, 'png' as ending
    from part where p_size % 3 < 2""")
def rendition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "preview").when(F.col("p_size") % 3 == 1, "pdf").otherwise("notes")
    name = F.concat("p_brand", F.lit("-"), "p_size", F.lit("-"), kind, F.lit(".png"))
    found = read_table(spark, sf_dir, "part").select("p_partkey", tables.rendition_parts(name).alias("r")).filter("r is not null")
    return found.select("p_partkey", "r.version", "r.kind", "r.ending")


@query("""
    select p_partkey as file_uid, 'v' || k || '-pdf.pdf' as name from part, (select unnest([1, 2, 3]) as k) where k <> p_size % 3 + 1""")
def rendition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    names = F.array(*(F.lit(n) for n in ("v1-pdf.pdf", "v2-pdf.pdf", "v3-pdf.pdf", "report.pdf", "v9-notes.txt")))
    there = part.select(F.col("p_partkey").alias("file_uid"), F.explode(names).alias("name"))
    keep = part.select(F.col("p_partkey").alias("file_uid"), F.concat(F.lit("v"), F.col("p_size") % 3 + 1).alias("version"))
    return tables.stale_renditions(there, keep).select("file_uid", "name")


@query("""
    select p_partkey as file_uid, 'v1-preview.png,v1-thumbnail.png' as names from part""")
def rendition_write_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_uid"))
    there = part.withColumn("name", F.lit("v1-preview.png"))
    made = part.withColumn("name", F.explode(F.array(F.lit("v1-preview.png"), F.lit("v1-thumbnail.png"))))
    whole = there.union(tables.new_renditions(made, there)).union(part.withColumn("name", F.lit("v2-pdf.pdf")))
    return tables.rendition_list(whole, "v1").select("file_uid", F.array_join("names", ",").alias("names"))


@query("""
    select conv_id, count(*) as turns, md5(string_agg(role || ':' || text, chr(10) order by turn)) as said_md5 from conversations group by 1""")
def conversation_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages hold no personal data, so redaction changes nothing."""
    found = context.transcript(read_table(spark, sf_dir, "conversations"))
    turns = F.from_json("transcript", "array<struct<role:string,content:string>>")
    said = F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return found.select("conv_id", "turns", F.md5(said.cast("binary")).alias("said_md5"))


_CONVERSATIONS = "select o_orderkey::varchar as id, o_custkey::varchar as user_id, o_orderdate as updated_at from orders"


@query(f"select id, updated_at from ({_CONVERSATIONS}) where user_id = (select min(o_custkey)::varchar from orders) order by updated_at desc, id limit 200")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    user = str(orders.agg(F.min("o_custkey")).first()[0])
    rows = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderdate").alias("updated_at"))
    return tables.conversation_list(rows, user).select("id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("""
    select conv_id::varchar as id, count(*)::int as n, string_agg(role, ',' order by turn) as roles from conversations where conv_id = 0 group by 1""")
def conversation_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations")
    heads = said.select(F.col("conv_id").cast("string").alias("id"), F.lit("u").alias("user_id")).distinct()
    messages = said.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("message_id"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("citations"))
    found = tables.conversation_get(heads, messages, "u", "0")
    return found.select("id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("""
    select user_id, event_id from events e where event_type = 'view'
      and not exists (select 1 from events x where x.event_type = 'purchase' and x.event_id % 50 = 0 and x.user_id = e.user_id)
      and e.event_id not in (select event_id - 1 from events where event_type = 'error')""")
def governance_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions left after a member's role change voids the member's, and a change of rights a file's."""
    rows = read_table(spark, sf_dir, "events")
    decided = rows.filter("event_type = 'view'").select(F.lit("t").alias("tenant"), F.col("user_id").cast("string").alias("user"), F.col("event_id").cast("string").alias("file_uid"), "user_id", "event_id")
    roles = rows.filter("event_type = 'purchase' and event_id % 50 = 0").select(F.lit("role.assigned").alias("type"), F.lit("t").alias("tenant"), F.lit(None).cast("string").alias("file_uid"), F.col("user_id").cast("string").alias("member"))
    rights = rows.filter("event_type = 'error'").select(F.lit("acl.changed").alias("type"), F.lit("t").alias("tenant"), (F.col("event_id") - 1).cast("string").alias("file_uid"), F.lit(None).cast("string").alias("member"))
    return access.forget(decided, roles.union(rights)).select("user_id", "event_id")


@query("""
    select case when event_type = 'purchase' then 'member' else 'resource' end as scope, user_id::varchar as id, count(*) as n from events where event_type in ('purchase', 'error') group by 1, 2""")
def governance_invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "role.member_removed").when(F.col("event_type") == "error", "acl.changed").otherwise("file.moved")
    events = rows.select(kind.alias("type"), F.lit("t").alias("tenant"), F.col("user_id").cast("string").alias("file_uid"), F.col("user_id").cast("string").alias("member"))
    return decisions.invalidations(events).groupBy("scope", "id").agg(F.count("*").alias("n"))


@query("""
    select 'r' || n_regionkey as parent, string_agg(n_name, ', ' order by n_name) as folders, '' as files from nation group by 1""")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    return tables.folder_listing(nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit(True).alias("is_container")))


@query("""
    select '/' || r_name || '/' || n_name as path, 'n' || n_nationkey as uid, null::varchar as missing from nation join region on n_regionkey = r_regionkey
    union all select r_name || '/none/more', null, '/' || r_name || '/none' from region""")
def resolve_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    entries = region.select(F.lit("").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("uid"), F.col("r_name").alias("name"), F.lit(True).alias("is_container")).union(
        nation.select(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"), "n_name", F.lit(True)))
    paths = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("path")).union(region.select(F.concat("r_name", F.lit("/none/more"))))
    return tables.resolve_paths(paths, entries)


@query("""
    select s_suppkey, case when s_suppkey % 2 = 0
        then 'See (<a href="/files?file=abcdef-' || lpad(s_suppkey::varchar, 6, '0') || '&amp;tenant=t">📄 ' || s_name || '</a>).'
        else 'See (📄 file).' end as html from supplier""")
def link_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.concat(F.lit("abcdef-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    rows = read_table(spark, sf_dir, "supplier")
    texts = rows.select("s_suppkey", F.concat(F.lit("See (file "), uid, F.lit(").")).alias("html"))
    names = rows.filter("s_suppkey % 2 = 0").select(uid.alias("file_uid"), F.col("s_name").alias("name"))
    return tables.link_file_references(texts, names, "t", key="s_suppkey")


@query(f"""
    with l as (select file_uid from ({_ROUTED}) group by 1)
    select file_uid, file_uid in ('3', '17') as dead from l""")
def stream_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of which two files make the handler fail, and which is not writable at first: these go to the dead letters, all others through."""
    folder = shared_folder(spark)
    log, out = f"{folder}/log-{uuid.uuid4().hex}", f"{folder}/out-{uuid.uuid4().hex}"
    _file_events(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(log)
    tries = []

    def handle(convert: DataFrame, delete: DataFrame, number: int) -> None:
        tries.append(number)
        if len(tries) == 1:
            raise ingest.ReadOnly("not now")
        both = convert.union(delete).select("file_uid")
        if not both.filter("file_uid in ('3', '17')").isEmpty():
            raise ValueError("cannot be converted")
        both.write.mode("append").parquet(out)

    ingest.ingest(event_stream(spark, log, 100), handle, f"{out}-checkpoint", once=True, dead=f"{out}-dead", pause=0.1).awaitTermination()
    through, dead = (spark.read.schema("file_uid string").parquet(p).distinct() for p in (out, f"{out}-dead"))
    return through.withColumn("dead", F.lit(False)).union(dead.withColumn("dead", F.lit(True)))


@query("select 'o' || o_orderkey as file_uid, o_orderstatus as status from orders where o_custkey % 7 = 0 union all select 'none', null")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    docs = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("file_uid"), F.col("o_orderstatus").alias("status"))
    asked = orders.filter("o_custkey % 7 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("file_uid")).union(spark.createDataFrame([("none",)], "file_uid string"))
    return tables.status_of(docs, asked)


@query("""
    with d as (select doc_id, doc_id % 5 <> 0 as may, case when doc_id % 3 <> 0 then text end as t from documents),
    k as (select *, list_max(list_filter(range(0, 1001), lambda k: strlen(substr(t, 1, k::int)) <= 1000)) as k from d)
    select 'f' || doc_id as file_uid, case when not may then 'denied' when t is null then 'missing' else 'ok' end as outcome,
           case when may then md5(substr(t, 1, k::int)) end as text_md5, coalesce(may and strlen(t) > 1000, false) as trimmed from k
    union all select 'gone', 'denied', null, false union all select 'granted', 'missing', null, false""")
def get_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").withColumn("file_uid", F.concat(F.lit("f"), "doc_id"))
    docs = rows.select("file_uid", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("content_md"))
    more = spark.createDataFrame([("gone",), ("granted",)], "file_uid string")
    grants = rows.filter("doc_id % 5 <> 0").select("file_uid").union(more.filter("file_uid = 'granted'"))
    found = access.get_text(docs, rows.select("file_uid").union(more), grants, 1000)
    return found.select("file_uid", "outcome", F.md5(F.col("text").cast("binary")).alias("text_md5"), "trimmed")


@query("""
    with m as (select o_custkey as u, min(o_orderkey) as low, max(o_orderkey) as high from orders where o_custkey = (select min(o_custkey) from orders) group by 1)
    select o_orderkey::varchar as id, case when o_orderkey = low then 1 else 0 end as folders from orders, m where o_orderkey <> high""")
def conversation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of a user's conversations gets a scope and another is deleted; what the user asks of another's changes nothing."""
    orders = read_table(spark, sf_dir, "orders")
    heads = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.array().cast("array<struct<uid:string,path:string>>").alias("scope"))
    user = orders.agg(F.min("o_custkey")).first()[0]
    mine, others = orders.filter(F.col("o_custkey") == user), orders.filter(F.col("o_custkey") != user)
    low, high, other = *mine.agg(F.min("o_orderkey"), F.max("o_orderkey")).first(), others.agg(F.min("o_orderkey")).first()[0]
    scope = F.array(F.struct(F.lit("r1").alias("uid"), F.lit("/r1").alias("path")))
    for key in (low, other):
        heads = tables.set_scope(heads, str(user), str(key), scope)
    messages = heads.select(F.col("id").alias("conversation_id"))
    for key in (high, other):
        heads, messages = tables.delete_conversation(heads, messages, str(user), str(key))
    return heads.join(messages, F.col("id") == F.col("conversation_id")).select("id", F.size("scope").alias("folders"))


@query("""
    select 'c' || c_custkey as file_uid, case when c_custkey % 2 = 0 then 'current' else 'outdated' end as status
    from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 3 and n_nationkey <> 4""")
def tree_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers under the root but those of region 3 and nation 4, which cannot be listed."""
    nation, customer = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "customer")
    name = lambda sign, c: F.concat(F.lit(sign), c)
    regions = nation.select(F.lit("root").alias("parent"), name("r", "n_regionkey").alias("child"), F.lit(True).alias("is_container")).distinct()
    edges = regions.union(nation.select(name("r", "n_regionkey"), name("n", "n_nationkey"), F.lit(True))).union(customer.select(name("n", "c_nationkey"), name("c", "c_custkey"), F.lit(False)))
    files = customer.select(name("c", "c_custkey").alias("file_uid"), F.lit("v2").alias("version"))
    docs = customer.select(name("c", "c_custkey").alias("file_uid"), F.when(F.col("c_custkey") % 2 == 0, "v2").otherwise("v1").alias("source_version"), F.lit("indexed").alias("status"))
    closed = spark.createDataFrame([("r3",), ("n4",)], "uid string")
    return access.sweep(edges, files, docs, "root", closed).select("file_uid", "status")


@query("""
    select s_suppkey, case when s_suppkey % 2 = 0 then 'Result 1 for ' || s_name || ' https://example.com/1' || chr(10) || 'Result 2 for ' || s_name || ' https://example.com/2' else 'there is no tool files' end as text,
           case when s_suppkey % 2 = 0 then 2 else 0 end as sources from supplier""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "supplier")
    calls = rows.select(F.col("s_suppkey").alias("call_id"), F.when(F.col("s_suppkey") % 2 == 0, "web_search").otherwise("files").alias("name"), F.create_map(F.lit("query"), F.col("s_name")).alias("args"))
    found = providers.run_tools(calls, [providers.web_search_tool("fake", 2)])
    return found.select(F.col("call_id").alias("s_suppkey"), "text", F.size("sources").alias("sources"))


_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_QUOTED = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"


@query(f"""
    with t as (select conv_id, turn, role, case when text = '' then '' else '<p>' || {_ESCAPED} || '</p>' end as html, {_QUOTED.format('text')} as quoted from conversations)
    select conv_id, md5('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Record of ' || conv_id || '</title></head><body><p>u · t · v1</p>' ||
        string_agg('<section class="' || role || '"><h2>' || role || '</h2>' || html || '</section>', '' order by turn) ||
        '<h2>Sources</h2><ul><li>[1] <a href="https://a.org/' || conv_id || '?x=1&amp;y=2" rel="noopener">Page ' || conv_id || '</a></li><li>[2] (file f-' || conv_id || ')</li></ul>' ||
        '<script type="application/json" id="record">{{"report":{{"uid":"' || conv_id || '","version":"v1"}},"chatted_by":"u","tenant":"t","citations":"' ||
        '[{{\\"marker\\":\\"1\\",\\"kind\\":\\"web\\",\\"url\\":\\"https://a.org/' || conv_id || '?x=1&y=2\\",\\"title\\":\\"Page ' || conv_id || '\\"}},' ||
        '{{\\"marker\\":\\"2\\",\\"kind\\":\\"document\\",\\"file_uid\\":\\"f-' || conv_id || '\\"}}]' ||
        '","transcript":[' || string_agg('{{"role":"' || role || '","content":"' || quoted || '"}}', ',' order by turn) || ']}}</script></body></html>') as page_md5
    from t group by 1""")
def provenance_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole page with its embedded record; the messages are paragraphs without marks."""
    said = read_table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    told = said.groupBy("conv_id").agg(turns.alias("transcript"))
    cite = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    web = cite(marker=F.lit("1"), kind=F.lit("web"), url=F.concat(F.lit("https://a.org/"), "conv_id", F.lit("?x=1&y=2")), title=F.concat(F.lit("Page "), "conv_id"), file_uid=F.lit(None).cast("string"))
    document = cite(marker=F.lit("2"), kind=F.lit("document"), url=F.lit(None).cast("string"), title=F.lit(None).cast("string"), file_uid=F.concat(F.lit("f-"), "conv_id"))
    record = F.struct(F.struct(F.col("conv_id").cast("string").alias("uid"), F.lit("v1").alias("version")).alias("report"), F.lit("u").alias("chatted_by"), F.lit("t").alias("tenant"), F.to_json(F.array(web, document)).alias("citations"), "transcript")
    pages = context.provenance_page(told.select("conv_id", F.to_json(record).alias("record")), "conv_id")
    return pages.select("conv_id", F.md5(F.col("page").cast("binary")).alias("page_md5"))


@query("""
    with d as (select *, case when doc_id % 20 = 3 then null when doc_id % 4 = 2 then 'new ' || lang else text end as t from documents where doc_id % 10 <> 3 or doc_id % 20 = 3)
    select 'f' || doc_id as file_uid, case when doc_id % 20 = 3 then 'v4' when doc_id % 2 = 0 then 'v2' else 'v1' end as source_version, md5(t) as text_md5,
           case when trim(coalesce(t, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' then 1 else 0 end as chunks from d""")
def file_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that gets its batches the wrong way round, one of them twice: it ends as if they had come in order."""
    docs = read_table(spark, sf_dir, "documents")
    file = lambda rows, version, text: rows.select(F.lit("t").alias("tenant"), F.concat(F.lit("f"), "doc_id").alias("file_uid"), F.lit(version).alias("source_version"), text.cast("string").alias("content_md"))
    batches = {
        "back": file(docs.filter("doc_id % 20 = 3"), "v4", F.lit(None)),
        "gone": file(docs.filter("doc_id % 10 = 3"), "v3", F.lit(None)).withColumn("deleted", F.lit(True)),
        "changed": file(docs.filter("doc_id % 2 = 0"), "v2", F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("new "), "lang"))),
        "first": file(docs, "v1", F.col("text")),
    }
    store = FileStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", 32, lambda d: chunking.chunk(d).withColumn("tenant", F.lit("t")))
    for name in (*batches, "changed"):
        store.apply(name, batches[name])
    chunks = store.chunks().groupBy("file_uid").agg(F.count("*").cast("int").alias("chunks"))
    found = store.documents().join(chunks, "file_uid", "left")
    return found.select("file_uid", "source_version", F.md5(F.col("content_md").cast("binary")).alias("text_md5"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("""
    with e as (select event_id as id, user_id, event_id % 3 as file, event_type from events),
    a as (select q.id, q.user_id, q.file, max(d.id) as decided from e q left join e d on d.event_type = 'click' and d.user_id = q.user_id and d.file = q.file and d.id < q.id
          where q.event_type = 'view' group by all),
    f as (select a.*, exists (select 1 from e where e.event_type = 'purchase' and e.user_id = a.user_id and e.id > a.decided and e.id < a.id) as forgotten from a)
    select user_id::varchar as user, file::varchar as file_uid, case when id - decided < 3000 and not forgotten then decided % 2 = 0 end as allowed, count(*) as n from f group by all""")
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks note a decision, views ask for one that is less than 3,000 events old, purchases forget the user's."""
    folder = f"{shared_folder(spark)}/decisions-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "click", "decision").when(F.col("event_type") == "view", "ask").when(F.col("event_type") == "purchase", "forget")
    user = F.col("user_id").cast("string")
    rows = read_table(spark, sf_dir, "events").select(
        F.lit("t").alias("tenant"), user.alias("user"), kind.alias("kind"), F.when(kind != "forget", (F.col("event_id") % 3).cast("string")).alias("file_uid"),
        F.when(kind == "decision", F.col("event_id") % 2 == 0).alias("allowed"), F.col("event_id").cast("double").alias("at"),
    ).filter("kind is not null")
    rows.write.parquet(f"{folder}/in")
    answers = decisions.cached_decisions(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), 3000)
    answers.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(decisions.ANSWERS).parquet(f"{folder}/out").groupBy("user", "file_uid", "allowed").agg(F.count("*").alias("n"))


_ADDRESSES = {
    "93.184.216.34": True, "8.8.8.8": True, "2606:2800:220:1::1": True, "127.0.0.1": False, "10.0.0.7": False, "192.168.0.1": False, "169.254.1.1": False,
    "224.0.0.251": False, "0.0.0.0": False, "::1": False, "fe80::1": False, "::ffff:192.168.1.1": False, "not an address": False,
}


@query(f"""
    with a as (select {list(_ADDRESSES)} as addresses, {list(_ADDRESSES.values())} as open),
    p as (select *, case page_id % 3 when 0 then 'http' else 'https' end || regexp_replace(url, '^[a-z]+', '') as link, page_id % {len(_ADDRESSES)} + 1 as i, page_id // 7 % {len(_ADDRESSES)} + 1 as j from pages, a)
    select page_id, link, coalesce(link like 'https://%' and page_id % 11 <> 0 and open[i] and open[j], false) as fetchable from p""")
def fetch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's link with two addresses that its host resolves to; every eleventh resolves to none."""
    n, known = len(_ADDRESSES), F.array(*map(F.lit, _ADDRESSES))
    pick = lambda k: F.element_at(known, (k % n + 1).cast("int"))
    rows = read_table(spark, sf_dir, "pages").withColumn("link", F.concat(F.when(F.col("page_id") % 3 == 0, "http").otherwise("https"), F.regexp_replace("url", "^[a-z]+", "")))
    resolved = F.when(F.col("page_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(F.col("page_id")), pick(F.floor(F.col("page_id") / 7))))
    return rows.select("page_id", "link", text.fetchable(F.col("link"), resolved).alias("fetchable"))


@query(f"select event_id, file_uid, action from ({_ROUTED})")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as segments read by bytes, stopped and started again: every event once."""
    folder = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    lines = _file_events(spark, sf_dir).select("event_id", F.to_json(F.struct("*")).alias("value"))
    for half in (0, 1):
        lines.filter(F.col("event_id").cast("long") % 2 == half).select("value").write.mode("append").text(f"{folder}/log")
        asked = ingest.routed(parse_events(log_stream(spark, f"{folder}/log", piece=1 << 18))).select("event_id", "file_uid", "action")
        asked.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(asked.schema).parquet(f"{folder}/out")


@query("""
    select 'c' || c_custkey as file_uid from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 or n_nationkey = 4
    union select 's' || s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1 or n_nationkey = 4""")
def scope_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of a region and of one more nation, by the stored intervals of the tree."""
    name = lambda sign, c: F.concat(F.lit(sign), c)
    nation = read_table(spark, sf_dir, "nation")
    edges = nation.select(F.lit("root").alias("parent"), name("r", "n_regionkey").alias("child"), F.lit(True).alias("is_container")).distinct().union(nation.select(name("r", "n_regionkey"), name("n", "n_nationkey"), F.lit(True)))
    for table, sign in (("customer", "c"), ("supplier", "s")):
        edges = edges.union(read_table(spark, sf_dir, table).select(name("n", f"{sign}_nationkey"), name(sign, f"{sign}_{dict(c='cust', s='supp')[sign]}key"), F.lit(False)))
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    folder_tree.store_labels(edges, path)
    labels, files = (spark.read.parquet(f"{path}/{kind}") for kind in ("folders", "files"))
    return folder_tree.stored_scope(labels, files, ["r1", "n4"])


@query("""
    select n_nationkey, '<h1>' || n_name || '</h1>' || chr(10) || '<p>Suppliers of <strong>' || n_name || '</strong>, by <em>key</em>:</p>' || chr(10) ||
           '<table>' || chr(10) || '<thead>' || chr(10) || '<tr>' || chr(10) || '<th>key</th>' || chr(10) || '<th style="text-align: right;">name</th>' || chr(10) || '</tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) ||
           string_agg('<tr>' || chr(10) || '<td>' || s_suppkey || '</td>' || chr(10) || '<td style="text-align: right;"><code>' || s_name || '</code></td>' || chr(10) || '</tr>' || chr(10), '' order by s_suppkey) ||
           '</tbody>' || chr(10) || '</table>' || chr(10) || '<ul>' || chr(10) || '<li>region ' || n_regionkey || chr(10) || '<ol>' || chr(10) || '<li>a &lt; b</li>' || chr(10) || '</ol>' || chr(10) || '</li>' || chr(10) || '</ul>' as html
    from nation join supplier on s_nationkey = n_nationkey group by n_nationkey, n_name, n_regionkey""")
def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each nation's suppliers, written as Markdown and rendered."""
    rows = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: F.concat(F.lit("| "), s["s_suppkey"], F.lit(" | `"), s["s_name"], F.lit("` |\n"))), "")
    report = F.concat(F.lit("# "), "n_name", F.lit("\n\nSuppliers of **"), "n_name", F.lit("**, by _key_:\n\n| key | name |\n| --- | ---: |\n"), "lines", F.lit("\n- region "), "n_regionkey", F.lit("\n    1. a < b\n"))
    return rows.groupBy("n_nationkey", "n_name", "n_regionkey").agg(lines.alias("lines")).select("n_nationkey", text.to_html(report).alias("html"))


@query("""
    with g as (select n_nationkey, n_name from nation),
    o as (select n_nationkey::varchar as file_uid, rpad('P' || n_nationkey, 22, '0') as id, 'IfcProject' as type, 'Model; of ''' || n_name || '''' as name, null as parent from g
          union all select n_nationkey::varchar, rpad('B' || n_nationkey, 22, '0'), 'IfcBuilding', 'IfcBuilding', rpad('P' || n_nationkey, 22, '0') from g
          union all select s_nationkey::varchar, rpad('W' || s_suppkey, 22, '0'), 'IfcWall', s_name, rpad('B' || s_nationkey, 22, '0') from supplier)
    select * from o""")
def ifc_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A building model a nation, its suppliers as walls, written as a Part-21 file and read back as a tree."""
    key = lambda sign, c: F.rpad(F.concat(F.lit(sign), c), 22, "0")
    nation, supplier = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "supplier")
    ref = lambda k: F.concat(F.lit("#"), (k + 100).cast("string"))
    walls = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.array_join(F.collect_list(F.concat(ref(F.col("s_suppkey")), F.lit("=IFCWALL('"), key("W", "s_suppkey"), F.lit("',$,'"), "s_name", F.lit("',$,$,(#1,(2.,'a,b')),$,$);\n"))), "").alias("walls"),
        F.array_join(F.collect_list(ref(F.col("s_suppkey"))), ",").alias("refs"),
    )
    file = F.concat(
        F.lit("ISO-10303-21;\nHEADER;\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n#1=IFCPROJECT('"), key("P", "n_nationkey"), F.lit("',$,'Model; of ''"), "n_name", F.lit("''',$,$,$,$,$,$);\n#2=IFCBUILDING('"),
        key("B", "n_nationkey"), F.lit("',$,$,$,$,$,$,$,$,$,$,$); /* (#3 */\n#3=IFCRELAGGREGATES('"), key("R", "n_nationkey"), F.lit("',$,$,$,#1,(#2));\n"), F.coalesce("walls", F.lit("")),
        F.when(F.col("refs").isNotNull(), F.concat(F.lit("#4=IFCRELCONTAINEDINSPATIALSTRUCTURE('"), key("S", "n_nationkey"), F.lit("',$,$,$,("), "refs", F.lit("),#2);\n"))).otherwise(""),
        F.lit("#5=IFCPROPERTYSET('"), key("Q", "n_nationkey"), F.lit("',$,'Set',$,());\nENDSEC;\nEND-ISO-10303-21;\n"),
    )
    files = nation.join(walls, "n_nationkey", "left").select(F.col("n_nationkey").cast("string").alias("file_uid"), F.encode(file, "UTF-8").alias("content"))
    return models.ifc_objects(files).select("file_uid", "id", "type", "name", "parent")
