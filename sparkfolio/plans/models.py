"""Queries of model files, each written from a table's row and read back, and of scans and conversions of files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..operators import conversion
from ..session import shared_folder
from ..sources import read_files, read_metadata, read_table
from .registry import query
from .text import _BODY


def _cat(*parts: Column | str) -> Column:
    """The parts one after the other; those with a blank at an end or a sign that no column has are texts."""
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


@query("""
    select p_partkey, '# OBJ mesh' || chr(10) || chr(10) || '## Comments' || chr(10) || '- ' || p_type || ' of ' || p_brand || chr(10) || chr(10) ||
           '## Names' || chr(10) || '- all.mtl' || chr(10) || '- ' || p_name || chr(10) || '- ' || p_type || chr(10) || '- ' || p_brand as text from part""")
def obj_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh a part; its name comes twice."""
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    file = _cat("#  ", kind, " of ", brand, "\r\nmtllib all.mtl\no ", name, "\nv 0 0 0\ng ", kind, "\nusemtl ", brand, "\nf 1 1 1\n  o ", name, "\n#\n")
    return read_table(spark, sf_dir, "part").select("p_partkey", models.obj_text(_bytes(file)).alias("text"))


@query("""
    select s_suppkey, '# VRML model' || chr(10) || chr(10) || '## Names' || chr(10) || '- S_' || s_suppkey || chr(10) || '- N_' || s_nationkey || chr(10) || chr(10) ||
           '## Strings' || chr(10) || '- ' || s_name || chr(10) || '- of nation ' || s_nationkey as text from supplier""")
def vrml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation, name = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.col("s_name")
    file = _cat("#VRML V2.0 utf8\nDEF S_", key, ' Group { info "', name, '" children DEF  N_', nation, ' Shape { title "', name, '" note " of nation ', nation, '" } }\n')
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", models.vrml_text(_bytes(file)).alias("text"))


@query("""
    select c_custkey, '# IGES CAD model' || chr(10) || chr(10) || '## Start section' || chr(10) || '- Drawing of ' || c_name || chr(10) || chr(10) ||
           '## Global' || chr(10) || '- ,' || chr(10) || '- ;' || chr(10) || '- ' || c_name || chr(10) || '- ' || c_mktsegment as text from customer""")
def iges_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of 80 signs; of the counted strings the number is left out."""
    counted = lambda c: _cat(F.length(c).cast("string"), "H", c)
    card = lambda letter, text: _cat(F.rpad(text, 72, " "), f"{letter}0000001\n")
    file = _cat(card("S", _cat("Drawing of ", F.col("c_name"))), card("G", _cat("1H,,1H;,", counted(F.col("c_name")), ",", counted(F.col("c_mktsegment")), ",4H1.25;")), card("T", F.lit("S1G1")))
    return read_table(spark, sf_dir, "customer").select("c_custkey", models.iges_text(_bytes(file)).alias("text"))


@query("""
    select p_partkey, case when p_partkey % 7 <> 0 then '# Point cloud (LAS 1.' || p_size % 5 || ')' || chr(10) || 'System: ' || p_type ||
           case when p_partkey % 3 <> 0 then chr(10) || 'Software: ' || p_brand else '' end end as text from part""")
def las_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of point clouds; every third names no software, every seventh is too short to be one."""
    field = lambda c: F.encode(F.rpad(c, 32, "\0"), "ISO-8859-1")
    software = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise("")
    file = F.concat(F.lit(b"LASF" + bytes(20) + b"\x01"), F.unhex(F.lpad(F.hex(F.col("p_size") % 5), 2, "0")), field(F.col("p_type")), field(software), F.lit(bytes(137)))
    file = F.when(F.col("p_partkey") % 7 == 0, F.substring(file, 1, 95)).otherwise(file)
    return read_table(spark, sf_dir, "part").select("p_partkey", models.las_text(file).alias("text"))


@query("""
    select s_suppkey, case when s_suppkey % 5 = 0 then null else '# STL mesh' || chr(10) || case when s_suppkey % 2 = 0 then 'Name: ' || s_name else s_name || ' of ' || s_nationkey end end as text from supplier""")
def stl_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ones as text, odd ones binary, every fifth without a name."""
    plain = _bytes(_cat("solid ", F.col("s_name"), "\nfacet normal 0 0 1\nendsolid\n"))
    binary = F.concat(F.encode(F.rpad(_cat(F.col("s_name"), " of ", F.col("s_nationkey").cast("string")), 80, "\0"), "ISO-8859-1"), F.lit(bytes(54)))
    file = F.when(F.col("s_suppkey") % 5 == 0, F.lit(b"solid\nfacet normal 0 0 1\n")).when(F.col("s_suppkey") % 2 == 0, plain).otherwise(binary)
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", models.stl_text(file).alias("text"))


@query("""
    select p_partkey, '# PLY mesh' || chr(10) || 'comment ' || p_name || chr(10) || 'element vertex ' || p_size || chr(10) || 'obj_info ' || p_brand as text from part""")
def ply_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the header once each, nothing of what follows it."""
    size = F.col("p_size").cast("string")
    file = _cat("ply\nformat ascii 1.0\ncomment ", F.col("p_name"), "\nelement vertex ", size, "\nproperty float x\nelement vertex ", size, "\nobj_info ", F.col("p_brand"), "\nend_header\ncomment late\n")
    return read_table(spark, sf_dir, "part").select("p_partkey", models.ply_text(_bytes(file)).alias("text"))


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (file_uid, content): a glTF file a supplier, the odd ones binary."""
    key, nation, name = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.col("s_name")
    scene = _cat(
        '{"asset":{"version":"2.0","generator":"nation ', nation, '","copyright":5},"nodes":[{"name":"', name, '","children":[1],"extras":{"note":"note ', nation, '","size":3}},{"name":"', name,
        '","mesh":0},{"mesh":0}],"meshes":[{"name":"mesh ', key, '"}]}',
    )
    size = F.lpad(F.hex(F.octet_length(scene)), 8, "0")
    little = F.unhex(F.concat(*(F.substring(size, at, 2) for at in (7, 5, 3, 1))))
    binary = F.concat(F.lit(b"glTF\x02\0\0\0\0\0\0\0"), little, F.lit(b"JSON"), _bytes(scene), F.lit(b"\x04\0\0\0BIN\0\0\0\0\0"))
    return read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_uid"), F.when(F.col("s_suppkey") % 2 == 1, binary).otherwise(_bytes(scene)).alias("content"))


@query("""
    select s_suppkey as file_uid, '# glTF model' || chr(10) || 'Generator: nation ' || s_nationkey || chr(10) || chr(10) || '## Names' || chr(10) || '- ' || s_name || chr(10) || '- note ' || s_nationkey || chr(10) || '- mesh ' || s_suppkey as text from supplier""")
def gltf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir).select("file_uid", models.gltf_text(F.col("content")).alias("text"))


@query("""
    select s_suppkey as file_uid, 0 as position, s_name as id, 'Node' as type, s_name as name, null as parent from supplier
    union all select s_suppkey, 1, s_name || '-1', 'Mesh', s_name, s_name from supplier
    union all select s_suppkey, 2, 'node-2', 'Mesh', 'node-2', null from supplier""")
def gltf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.gltf_nodes(_scenes(spark, sf_dir))


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (file_uid, content): a CityJSON file a customer, a building and its part."""
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    file = _cat(
        '{"type":"CityJSON","metadata":{"title":"', F.col("c_mktsegment"), '","referenceSystem":7},"CityObjects":{"c', key, '":{"type":"Building","attributes":{"name":"', name, '","floors":3}},"p', key,
        '":{"type":"BuildingPart","parents":["c', key, '"]}}}',
    )
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_uid"), _bytes(file).alias("content"))


@query("""
    select c_custkey as file_uid, '# CityJSON model' || chr(10) || 'title: ' || c_mktsegment || chr(10) || chr(10) || '## City objects' || chr(10) || '- c' || c_custkey || ' — Building — name: ' || c_name || chr(10) || '- p' || c_custkey || ' — BuildingPart' as text from customer""")
def cityjson_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cities(spark, sf_dir).select("file_uid", models.cityjson_text(F.col("content")).alias("text"))


@query("""
    select c_custkey as file_uid, 'c' || c_custkey as id, 'Building' as type, c_name as name, null as parent from customer
    union all select c_custkey, 'p' || c_custkey, 'BuildingPart', 'p' || c_custkey, 'c' || c_custkey from customer""")
def city_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.city_nodes(_cities(spark, sf_dir))


@query("""
    select s_suppkey as file_uid, case when s_suppkey % 2 = 0 then '# IFC model (schema IFC4)' else '# STEP CAD model (schema AUTOMOTIVE_DESIGN)' end || chr(10) || chr(10) || '## Document' || chr(10) || '- file of ' || s_name ||
           chr(10) || chr(10) || '## IfcWall' || chr(10) || '- ' || s_name || '; its ''wall''' || chr(10) || '- second' || chr(10) || chr(10) || '## Advanced face' || chr(10) || '- Größe ' || s_nationkey as text from supplier""")
def part21_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with quotes, semicolons, comments and escapes; equal strings of one kind once."""
    schema = F.when(F.col("s_suppkey") % 2 == 0, "IFC4").otherwise("AUTOMOTIVE_DESIGN")
    name = F.col("s_name")
    file = _cat(
        "ISO-10303-21;\nHEADER;\nFILE_NAME('file of ", name, "','');\nFILE_SCHEMA(('", schema, "'));\nENDSEC;\nDATA;\n#1=IFCWALL('", name, "; its ''wall''',$);\n/* #9=IFCWALL('none'); */\n#2 = ADVANCED_FACE('Gr\\X\\F6\\X2\\00DF\\X0\\e ",
        F.col("s_nationkey").cast("string"), "',#1);\n#3=IFCWALL('second','", name, "; its ''wall''');\nENDSEC;\nEND-ISO-10303-21;\n",
    )
    files = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_uid"), _bytes(file).alias("content"))
    return models.part21_text(files)


@query("""
    select md5(string_agg(s_name || chr(10), '' order by s_suppkey)) as content_md5, sum(length(s_name) + 1)::bigint as length from supplier group by s_nationkey""")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a nation with its suppliers' names, scanned for contents and, apart from that, for lengths."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows = read_table(spark, sf_dir, "supplier").repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    rows.select("s_nationkey", "s_name").write.partitionBy("s_nationkey").text(path)
    whole, heads = read_files(spark, path, "part-*"), read_metadata(spark, path, "part-*")
    both = whole.join(heads, ["file_uid", "name", "version"])
    return both.select(F.md5("content").alias("content_md5"), "length")


@query(f"""
    select page_id as file_uid, case when page_id % 3 = 2 then 'unsupported' when {_BODY} <> '' then 'indexed' else 'converted' end as status,
           page_id % 3 <> 2 and {_BODY} <> '' as has_text from pages where page_id % 3 <> 0""")
def conversion_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as files: a third is there in its version, a third has an older one, a third is of a type that has no text."""
    pages = read_table(spark, sf_dir, "pages")
    k, uid = F.col("page_id") % 3, F.col("page_id").alias("file_uid")
    files = pages.select(uid, F.when(k == 2, "a.bin").otherwise("a.html").alias("name"), F.when(k == 2, F.lit(b"\x00\x01")).otherwise(_bytes(F.col("html"))).alias("content"), F.lit("v2").alias("version"), F.lit(False).alias("is_dir"))
    at = F.lit("2026-01-01").cast("timestamp")
    documents = pages.select(
        uid, F.when(k == 0, "v2").otherwise("v1").alias("source_version"), F.lit("text/html").alias("mime"), F.lit("a.html").alias("name"), F.lit("").alias("path"), F.lit("old").alias("content_md"),
        F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("error"), at.alias("created_at"), at.alias("updated_at"),
    )
    chunks = spark.createDataFrame([], "file_uid long, ordinal int, text string, embedding array<float>")
    return conversion.convert(files, documents, chunks, at, 16)[2].select("file_uid", "status", "has_text")
