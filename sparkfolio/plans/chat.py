"""Queries of what surrounds an answer: arguments, records, markers, roles, addresses, Markdown's blocks, scores of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, search
from ..sources import read_table
from .registry import query
from .retrieval import _TRIGRAMS
from .tabular import _QUOTED


@query("""
    with s as (select conv_id, turn, 'role=' || role || ', text=' || s || ', again=' || s || ', more=' || s || ', last=' || s as line
               from (select *, case when length(text) > 80 then substr(text, 1, 79) || '…' else text end as s from conversations))
    select conv_id, turn, case when length(line) > 300 then substr(line, 1, 299) || '…' else line end as line from s""")
def argument_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as arguments of a tool: long ones are cut, and so is a long line."""
    args = F.create_map(*(x for name in ("role", "text", "again", "more", "last") for x in (F.lit(name), F.col("role" if name == "role" else "text"))))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", text.argument_summary(args).alias("line"))


@query("""
    select c_custkey, case when c_custkey % 3 = 0 then '8.8.4.4' when c_custkey % 7 = 0 then '10.1.1.1' when c_custkey % 5 = 0 then '10.2.2.2' else '9.9.9.' || c_custkey % 250 end as address,
           case when c_custkey % 7 = 0 then case when c_custkey % 3 = 0 then '8.8.4.4' else '10.1.1.1' end when c_custkey % 5 = 0 then '10.2.2.2' else '1.1.1.1' end as first from customer""")
def client_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a list of proxies the right-most hop that is none, from a proxy only; without one the first hop."""
    k = F.col("c_custkey")
    peer = F.when(k % 3 == 0, "8.8.4.4").otherwise("10.1.1.1")
    hops = F.when(k % 7 == 0, None).when(k % 5 == 0, "10.2.2.2, 10.0.0.1").otherwise(F.concat(F.lit("1.1.1.1, 9.9.9."), (k % 250).cast("string"), F.lit(" ,10.0.0.2")))
    return read_table(spark, sf_dir, "customer").select("c_custkey", text.client_ip(peer, hops, ["10.0.0.0/8"]).alias("address"), text.client_ip(peer, hops).alias("first"))


@query("""
    select c_custkey, lower(c_mktsegment) || case when c_nationkey % 2 = 0 then ',administrators,tenant_admin' else '' end as roles,
           lower(c_mktsegment) || case when c_nationkey % 2 = 0 then ',administrators,tenant_admin,system_admin' else '' end as agent_roles from customer""")
def role_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.concat(F.array(F.lower("c_mktsegment")), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("administrators"))).otherwise(F.array().cast("array<string>")))
    joined = lambda agent: F.array_join(text.effective_roles(roles, agent), ",")
    return read_table(spark, sf_dir, "customer").select("c_custkey", joined(False).alias("roles"), joined(True).alias("agent_roles"))


@query(r"""
    select page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g'), 1, 20) || '-' || substr(sha256(url || ':v' || page_id % 9), 1, 32) as key,
           case page_id % 4 when 0 then 'word' when 1 then 'cell' when 2 then 'slide' end as family from pages""")
def editor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the pages' versions in an editor, and the family of the file that each would be."""
    k = F.col("page_id") % 4
    ending = F.when(k == 0, ".docx").when(k == 1, ".XLSX").when(k == 2, ".pptx").otherwise(".html")
    version = F.concat(F.lit("v"), (F.col("page_id") % 9).cast("string"))
    return read_table(spark, sf_dir, "pages").select("page_id", text.document_key(F.col("url"), version).alias("key"), text.editor_type(F.concat("url", ending))["family"].alias("family"))


@query("select conv_id, turn, md5('Here: ' || text || ' and ' || role || case when turn % 2 = 0 then ' end' else '' end) as text_md5 from conversations")
def markers_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in reports' marks, closed or not; the marks go and the texts stay."""
    said = F.concat(F.lit('Here: [[SAVE_REPORT path="a/b" file="c.html"]]'), "text", F.lit("[[/save_report]] and "), F.lit('[[save_report file="d.md"]]'), "role", F.when(F.col("turn") % 2 == 0, "[[/SAVE_REPORT]] end").otherwise(""))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.strip_report_markers(said).cast("binary")).alias("text_md5"))


@query("""
    select p_partkey, unnest(range(0, 8))::int as position, unnest(['heading', 'paragraph', 'list', 'quote', 'rule', 'table', 'code', 'paragraph']) as kind,
           unnest(['# ' || p_name, 'of ' || p_type || chr(10) || 'by ' || p_brand, '- ' || p_brand || chr(10) || '2. ' || p_type, '> size ' || p_size, '***', '| a | b |' || chr(10) || '| --- | --- |', '# ' || p_name || chr(10) || '  - x', 'end']) as text from part""")
def markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown text a part, cut into blocks by kind."""
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    body = F.concat(
        F.lit("# "), name, F.lit("\nof "), kind, F.lit("\nby "), brand, F.lit("\n\n- "), brand, F.lit("\n2. "), kind, F.lit("\n> size "), F.col("p_size").cast("string"), F.lit("\n***\n| a | b |\n| --- | --- |\n```md\n# "), name,
        F.lit("\n  - x\n```\nend\n"),
    )
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.markdown_blocks(body)).alias("position", "b"))
    return rows.select("p_partkey", "position", "b.kind", "b.text")


@query(f"""
    with q as (select conv_id, turn, role, {_QUOTED.format('text')} as t from conversations)
    select conv_id || '-' || turn as uid, '{{"report":{{"uid":"' || conv_id || '-' || turn || '","version":"v1"}},"chatted_by":"u","tenant":"t","citations":"[]","transcript":[' ||
           case when turn % 2 = 0 then '{{"role":"system","content":"card [redacted-card]"}},' else '' end ||
           '{{"role":"user","content":"' || t || ' or [redacted-email]"}},{{"role":"assistant","content":"' || role || ' [redacted-ssn]"}}],"pii_redacted":true}}' as record from q""")
def provenance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a question with an address in it; what is personal is in no record."""
    said = read_table(spark, sf_dir, "conversations")
    history = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.lit("system").alias("role"), F.lit("card 4111 1111 1111 1111").alias("content"))))
    answers = said.select(
        F.concat_ws("-", "conv_id", "turn").alias("uid"), F.lit("v1").alias("version"), F.lit("u").alias("user"), F.lit("t").alias("tenant"), F.concat("text", F.lit(" or u"), "conv_id", F.lit("@mail.example.org")).alias("message"),
        F.concat("role", F.lit(" 078-05-1120")).alias("answer_text"), history.alias("history"), F.lit("[]").alias("citations"),
    )
    return context.provenance(answers)


@query("select s_suppkey, (8 + row_number() over (order by s_acctbal desc, s_suppkey))::int as marker from supplier")
def tool_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tools found, numbered on after eight texts."""
    rows = read_table(spark, sf_dir, "supplier").select("s_suppkey", (-F.col("s_acctbal")).alias("far"))
    return context.tool_citations(rows, 8, ["far", "s_suppkey"]).select("s_suppkey", "marker")


@query(f"""
    with p as (select p_partkey, p_brand, p_name, regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}_]+') as w from part where p_partkey % 5 <> 0),
    t as (select *, flatten(list_transform(w, lambda x: list_transform(range(1, len(x) + 2), lambda i: substr('  ' || x || ' ', i::int, 3)))) as g, {_TRIGRAMS.format("'widget'")} as q, {_TRIGRAMS.format('p_brand')} as b from p),
    r as (select p_partkey, q, unnest(flatten(list_transform(range(1, len(g) + 1), lambda i: list_transform(range(i, len(g) + 1), lambda j: list_distinct(g[i:j]))))) as run from t),
    n as (select p_partkey, max(len(list_intersect(run, q)) / (len(q) + len(run) - len(list_intersect(run, q)))) as near from r group by 1),
    s as (select p_partkey, p_brand, list_contains(w, 'widget') as hit, near, len(list_intersect(b, q)) / len(list_distinct(list_concat(b, q))) as named from t join n using (p_partkey)),
    f as (select p_partkey::varchar as file_uid, p_brand as name, case when hit then 0.1 / 1.64493406685 else 0 end + greatest(near, named) as score from s where hit or near >= 0.6 or named >= 0.3)
    select file_uid, name, round(score, 6) as score from f order by f.score desc, file_uid limit 100""")
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hundred of the parts that a user may see, by rank and similarity; every fifth part is not theirs."""
    parts = read_table(spark, sf_dir, "part").withColumn("file_uid", F.col("p_partkey").cast("string"))
    docs = parts.select("file_uid", F.col("p_brand").alias("name"), F.col("p_name").alias("content_md"), F.lit("indexed").alias("status"))
    found = search.search(docs, None, parts.filter("p_partkey % 5 <> 0").select("file_uid"), "widget", 100)
    return found.select("file_uid", "name", F.round("score", 6).alias("score"))
