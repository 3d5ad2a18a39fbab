"""Searchable text of model and drawing files.

Formats whose text fits one expression are columns over the file's bytes. Part-21 files (IFC, STEP), which hold very
many statements, are DataFrames of statements and strings that are grouped by entity type.

Fixed values throughout: titles and headings, offsets and lengths of header fields, words that lines begin with, and the
patterns of names and strings of each format.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import decode_utf8, dedupe, let, strip


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085  ]")


def _latin(content: Column, start: int, length: int) -> Column:
    return F.decode(F.substring(content, start, length), "ISO-8859-1")


def _section(title: str, items: Column) -> Column:
    """A blank line, a heading and the items as a list; nothing without items."""
    head = F.array(F.lit(""), F.lit(f"## {title}"))
    return let(items, lambda xs: F.when(F.size(xs) > 0, F.concat(head, F.transform(xs, lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>")))


def _page(title: Column | str, *sections: Column) -> Column:
    """The title line and the sections' lines; null if there are none."""
    head = F.lit(title) if isinstance(title, str) else title
    return let(F.concat(*sections), lambda rest: F.when(F.size(rest) > 0, F.array_join(F.concat(F.array(head), rest), "\n")))


def obj_text(content: Column) -> Column:
    """Comments, and names of objects, groups and materials, of a Wavefront OBJ file."""
    return let(F.transform(_lines(decode_utf8(content)), strip), _obj_page)


def _obj_page(lines: Column) -> Column:
    comments = dedupe(F.transform(F.filter(lines, lambda x: x.startswith("#")), lambda x: F.substring(x, F.lit(2), F.length(x))))
    named = F.filter(lines, lambda x: x.rlike(r"^(?:[og] |(?:usemtl|mtllib)\S*\s+\S)"))
    names = dedupe(F.transform(named, lambda x: F.regexp_replace(x, r"^(?:[og] |(?:usemtl|mtllib)\S*\s+)", "")))
    return _page("# OBJ mesh", _section("Comments", comments), _section("Names", names))


def vrml_text(content: Column) -> Column:
    """Defined names and quoted strings of a VRML world."""
    text = decode_utf8(content)
    names = dedupe(F.regexp_extract_all(text, F.lit(r"\bDEF\s+([A-Za-z0-9_]+)"), F.lit(1)))
    return _page("# VRML model", _section("Names", names), _section("Strings", dedupe(F.regexp_extract_all(text, F.lit(r'"([^"]*)"'), F.lit(1)))))


def iges_text(content: Column) -> Column:
    """Start section, and counted strings of the global section that are no numbers, of an IGES file."""
    return let(F.filter(_lines(F.decode(content, "ISO-8859-1")), lambda x: F.length(x) >= 73), _iges_page)


def _iges_page(lines: Column) -> Column:
    of = lambda letter: F.transform(F.filter(lines, lambda x: F.substring(x, 73, 1) == letter), lambda x: F.substring(x, 1, 72))
    words = let(F.array_join(of("G"), ""), lambda flat: let(F.regexp_extract_all(flat, F.lit(r"(\d+)H"), F.lit(1)), lambda counts: _counted(flat, counts)))
    return _page("# IGES CAD model", _section("Start section", dedupe(of("S"))), _section("Global", dedupe(words)))


def _counted(flat: Column, counts: Column) -> Column:
    """The counted strings that are no numbers."""
    # where each count ends: the signs up to and with the k-th of them
    ends = F.transform(F.sequence(F.lit(1), F.size(counts)), lambda k: F.length(F.regexp_substr(flat, F.concat(F.lit(r"(?s)^(?:.*?\d+H){"), k, F.lit("}")))))
    found = F.transform(F.arrays_zip(counts.alias("n"), ends.alias("at")), lambda z: F.substring(flat, z["at"] + 1, F.coalesce(z["n"].try_cast("int"), F.lit(0))))
    strings = F.when(F.size(counts) > 0, found).otherwise(F.array().cast("array<string>"))
    return F.filter(strings, lambda s: ~F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit("-"), F.lit("")).rlike(r"^\d+$"))


def las_text(content: Column) -> Column:
    """Version, system and software in a LAS header; null for less than a header."""
    cut = lambda start: strip(F.split(_latin(content, start, 32), "\\x00")[0])
    byte = lambda at: F.conv(F.hex(F.substring(content, at, 1)), 16, 10)
    line = lambda name, value: F.when(value != "", F.array(F.concat(F.lit(f"{name}: "), value))).otherwise(F.array().cast("array<string>"))
    title = F.concat(F.lit("# Point cloud (LAS "), byte(25), F.lit("."), byte(26), F.lit(")"))
    whole = (F.substring(content, 1, 4) == F.lit(b"LASF")) & (F.length(content) >= 96)
    return F.when(whole, _page(title, line("System", cut(27)), line("Software", cut(59))))


def stl_text(content: Column) -> Column:
    """Name of an ASCII STL solid, or what the 80 bytes before a binary one say."""
    head = _latin(content, 1, 512)
    first = strip(_lines(head)[0])
    name = strip(F.substring(first, F.lit(6), F.length(first)))
    other = strip(F.replace(_latin(content, 1, 80), F.lit("\0"), F.lit(" ")))
    said = F.when(F.lower(F.ltrim(head)).startswith("solid"), F.when(name != "", F.concat(F.lit("Name: "), name))).otherwise(F.nullif(other, F.lit("")))
    return F.concat(F.lit("# STL mesh\n"), said)


def ply_text(content: Column) -> Column:
    """Comment, obj_info and element lines of a PLY header."""
    head = _latin(content, 1, 8192)
    before = F.regexp_replace(head, r"(?ms)^[ \t]*end_header[ \t\r]*$.*", "")
    lines = dedupe(F.filter(F.transform(_lines(before), strip), lambda x: x.rlike("^(?:comment|obj_info|element)")))
    return F.when(F.lower(F.ltrim(head)).startswith("ply") & (F.size(lines) > 0), F.concat(F.lit("# PLY mesh\n"), F.array_join(lines, "\n")))


#: The collections of a glTF file whose items have names.
GLTF_COLLECTIONS = ("scenes", "nodes", "meshes", "materials", "cameras", "animations", "images", "skins", "textures")


def gltf_json(content: Column) -> Column:
    """The JSON of a glTF file, or of the first chunk of a binary one."""
    size = F.conv(F.concat(*(F.hex(F.substring(content, at, 1)) for at in (16, 15, 14, 13))), 16, 10).cast("int")
    chunk = F.when(F.substring(content, 17, 4) == F.lit(b"JSON"), F.substring(content, F.lit(21), size))
    return decode_utf8(F.when(F.substring(content, 1, 4) == F.lit(b"glTF"), chunk).otherwise(content))


def _text_of(value: Column) -> Column:
    """A variant that is a string as it is, null for other kinds."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def gltf_text(content: Column) -> Column:
    """Generator, copyright, and names and textual extras of a glTF file's parts."""
    item = "array<struct<name:variant,extras:map<string,variant>>>"
    doc = F.from_json(gltf_json(content), f"asset struct<generator:variant,copyright:variant>, {', '.join(f'{c} {item}' for c in GLTF_COLLECTIONS)}")
    return let(doc, _gltf_page)


def _gltf_page(doc: Column) -> Column:
    said = lambda name, value: let(value, lambda v: F.when(v.isNotNull(), F.array(F.concat(F.lit(f"{name}: "), v))).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    strings = lambda i: F.concat(F.array(_text_of(i["name"])), F.transform(F.map_values(F.coalesce(i["extras"], F.create_map().cast("map<string,variant>"))), _text_of))
    names = F.concat(*(F.coalesce(F.flatten(F.transform(F.filter(doc[c], lambda i: i.isNotNull()), strings)), none) for c in GLTF_COLLECTIONS))
    listed = dedupe(F.filter(names, lambda s: s.isNotNull()))
    return _page("# glTF model", said("Generator", _text_of(doc["asset"]["generator"])), said("Copyright", _text_of(doc["asset"]["copyright"])), _section("Names", listed))


def city_objects(content: Column) -> Column:
    """Map of the objects of a CityJSON file."""
    return F.from_json(decode_utf8(content), "CityObjects map<string,struct<type:string,attributes:map<string,variant>,parents:array<string>>>")["CityObjects"]


def cityjson_text(content: Column) -> Column:
    """Title, reference system, and each object with its type and textual attributes, of a CityJSON file."""
    meta = F.from_json(decode_utf8(content), "metadata struct<title:variant,referenceSystem:variant>")["metadata"]
    said = lambda name: let(_text_of(meta[name]), lambda v: F.when(v.isNotNull(), F.array(F.concat(F.lit(f"{name}: "), v))).otherwise(F.array().cast("array<string>")))
    pairs = lambda a: F.filter(F.transform(F.map_entries(a), lambda e: F.concat(e["key"], F.lit(": "), _text_of(e["value"]))), lambda s: s.isNotNull())
    row = lambda e: F.array_join(F.concat(F.array(e["key"]), F.filter(F.array(e["value"]["type"]), lambda t: t.isNotNull()), F.coalesce(pairs(e["value"]["attributes"]), F.array().cast("array<string>"))), " — ")
    rows = F.coalesce(F.transform(F.map_entries(city_objects(content)), row), F.array().cast("array<string>"))
    return _page("# CityJSON model", said("title"), said("referenceSystem"), _section("City objects", dedupe(rows)))


def gltf_nodes(df: DataFrame, uid: str = "file_uid", content: str = "content") -> DataFrame:
    """Rows (uid, position, id, type, name, parent) of a glTF file's scene nodes; a repeated name gets its number."""
    doc = F.from_json(gltf_json(F.col(content)), "nodes array<struct<name:string,mesh:int,children:array<int>>>")
    nodes = df.select(uid, F.posexplode(doc["nodes"]).alias("position", "node"))
    base = F.coalesce(F.nullif(strip(F.col("node.name")), F.lit("")), F.concat(F.lit("node-"), F.col("position")))
    from pyspark.sql.window import Window

    named = nodes.withColumn("base", base).withColumn("turn", F.row_number().over(Window.partitionBy(uid, "base").orderBy("position")))
    own = named.select(uid, "position", F.when(F.col("turn") > 1, F.concat_ws("-", "base", "position")).otherwise(F.col("base")).alias("id"), F.when(F.col("node.mesh").isNotNull(), "Mesh").otherwise("Node").alias("type"), "base", "node.name", "node.children")
    up = own.select(uid, F.explode("children").alias("child"), F.col("id").alias("parent"), F.col("position").alias("by"))
    parents = up.groupBy(uid, "child").agg(F.max_by("parent", "by").alias("parent"))
    joined = own.join(parents.withColumnRenamed("child", "position"), [uid, "position"], "left")
    return joined.select(uid, "position", "id", "type", F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.col("id")).alias("name"), "parent")


def city_nodes(df: DataFrame, uid: str = "file_uid", content: str = "content") -> DataFrame:
    """Rows (uid, id, type, name, parent) of a CityJSON file's objects."""
    rows = df.select(uid, F.explode(city_objects(F.col(content))).alias("id", "o"))
    return rows.select(uid, "id", F.coalesce("o.type", F.lit("CityObject")).alias("type"), F.coalesce(_text_of(F.try_element_at("o.attributes", F.lit("name"))), F.col("id")).alias("name"), F.try_element_at(F.col("o.parents"), F.lit(1)).alias("parent"))


def part21_statements(df: DataFrame, uid: str = "file_uid", content: str = "content") -> DataFrame:
    """Rows (uid, position, statement) of Part-21 files: cut at semicolons outside of quotes, without comments."""
    text = decode_utf8(F.col(content))
    bare = F.regexp_replace(text, r"(?s)('[^']*+(?:''[^']*+)*+(?:'|\z))|/\*.*?(?:\*/|\z)", "$1")
    cut = F.regexp_extract_all(bare, F.lit(r"(?s)((?:[^';]|'[^']*+(?:''[^']*+)*+(?:'|\z))++)"), F.lit(1))
    return df.filter(F.ltrim(text).startswith("ISO-10303-21")).select(uid, F.posexplode(cut).alias("position", "statement"))


#: An argument up to the comma behind it: quoted strings count as one sign, lists are cut further down.
_ARGUMENT = re.compile(r"'(?:[^']|'')*'|[(),]|[^'(),]+")


def split_arguments(text: str | None) -> list[str] | None:
    """The arguments of an entity at the top level, as they are written; null for a statement that does not close."""
    out, now, depth = [], [], 0
    for part in _ARGUMENT.findall(text or ""):
        if part == "," and not depth:
            out.append("".join(now).strip())
            now = []
            continue
        depth += (part == "(") - (part == ")")
        if depth < 0:
            return [*out, "".join(now).strip()]
        now.append(part)
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def arguments(texts: pd.Series) -> pd.Series:
    """split_arguments() of what stands behind an entity's opening bracket; quotes, nested lists and typed values stay whole."""
    return texts.map(split_arguments)


#: Entities that have an id of 22 signs but are no objects: relations, and definitions and templates of properties.
NO_OBJECTS = r"^IFC(?:REL.*|PROPERTYSET|ELEMENTQUANTITY|SERVICELIFEFACTOR|.*PROPERTIES|.*TEMPLATE)$"


def ifc_objects(df: DataFrame, uid: str = "file_uid", content: str = "content") -> DataFrame:
    """Rows (uid, position, id, type, name, parent) of the objects of IFC files.

    ``id`` is an object's global one, ``parent`` that of what contains it, or else of what it is a part of; of several, the
    last in the file counts. The name is the type's where there is none. Types are written with two capitals (IfcWall),
    as the file does not say where a name's other words begin. Part-21 files without such objects have no row, references
    to what is not there are no parents. Entities meet by file and number, so no task holds a whole model.
    """
    rows = part21_statements(df, uid, content)
    head = r"(?s)^\s*(#\d+)\s*=\s*([A-Za-z0-9_]+)\s*\((.*)$"
    wanted = rows.filter(F.col("statement").rlike(r"(?s)^\s*#\d+\s*=\s*(?i:IFC)[A-Za-z0-9_]+\s*\(\s*'[0-9A-Za-z_$]{22}'"))
    parts = wanted.select(uid, "position", F.regexp_extract("statement", head, 1).alias("ref"), F.upper(F.regexp_extract("statement", head, 2)).alias("entity"), arguments(F.regexp_extract("statement", head, 3)).alias("a")).filter("a is not null")
    arg = lambda k: F.get("a", F.lit(k))
    kind = F.concat(F.lit("Ifc"), F.initcap(F.lower(F.substring("entity", 4, 1000))))
    name = F.nullif(F.get(quoted_strings(arg(2)), F.lit(0)), F.lit(""))
    objects = parts.filter(~F.col("entity").rlike(NO_OBJECTS)).select(uid, "position", "ref", F.get(quoted_strings(arg(0)), F.lit(0)).alias("id"), kind.alias("type"), F.coalesce(name, kind).alias("name"))
    inside = F.col("entity") == "IFCRELCONTAINEDINSPATIALSTRUCTURE"
    links = parts.filter(F.col("entity").isin("IFCRELAGGREGATES", "IFCRELCONTAINEDINSPATIALSTRUCTURE"))
    refs = lambda x: F.regexp_extract_all(x, F.lit(r"(#\d+)"), F.lit(1))
    links = links.select(uid, F.struct(inside.alias("inside"), "position").alias("turn"), F.get(refs(F.when(inside, arg(5)).otherwise(arg(4))), F.lit(0)).alias("up"), F.explode(refs(F.when(inside, arg(4)).otherwise(arg(5)))).alias("ref"))
    known = links.join(objects.select(uid, F.col("ref").alias("up"), F.col("id").alias("parent")), [uid, "up"])
    parents = known.groupBy(uid, "ref").agg(F.max_by("parent", "turn").alias("parent"))
    return objects.join(parents, [uid, "ref"], "left").select(uid, "position", "id", "type", "name", "parent")


def quoted_strings(statement: Column) -> Column:
    """The quoted strings of a statement, doubled quotes and escapes decoded; a broken escape gives nothing."""
    raw = F.regexp_extract_all(statement, F.lit(r"(?s)'([^']*+(?:''[^']*+)*+)(?:'|\z)"), F.lit(1))

    def decoded(s: Column) -> Column:
        s = F.replace(s, F.lit("''"), F.lit("'"))
        for pattern, before, after, charset, digits in ((r"\\X2\\([0-9A-Fa-f]+)\\X0\\", "\\X2\\", "\\X0\\", "UTF-16BE", 4), (r"\\X\\([0-9A-Fa-f]{2})", "\\X\\", "", "ISO-8859-1", 2)):
            codes = F.array_distinct(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)))
            sign = lambda h: F.when(F.length(h) % digits == 0, F.decode(F.unhex(h), charset)).otherwise("")  # noqa: B023, E731
            s = F.aggregate(codes, s, lambda out, h: F.replace(out, F.concat(F.lit(before), h, F.lit(after)), sign(h)))  # noqa: B023
        return s

    return F.transform(raw, decoded)


def part21_strings(df: DataFrame, uid: str = "file_uid", content: str = "content") -> DataFrame:
    """Rows (uid, entity, position, value): strings of each entity type in order, repeated ones once; entity '' is the header."""
    rows = part21_statements(df, uid, content)
    entity = F.upper(F.regexp_extract("statement", r"^\s*#\d+\s*=\s*([A-Za-z0-9_]+)\s*\(", 1))
    header = F.upper(F.ltrim(F.regexp_replace("statement", r"^\s+", ""))).rlike("^(?:FILE_NAME|FILE_DESCRIPTION)")
    kept = rows.withColumn("entity", entity).filter((F.col("entity") != "") | header)
    values = kept.select(uid, "entity", "position", F.posexplode(quoted_strings(F.col("statement"))).alias("place", "value"))
    trimmed = values.withColumn("value", strip(F.col("value"))).filter("value <> ''")
    return trimmed.groupBy(uid, "entity", "value").agg(F.min(F.struct("position", "place")).alias("position"))


def part21_text(df: DataFrame, uid: str = "file_uid", content: str = "content", most: int = 20_000) -> DataFrame:
    """Rows (uid, text) for IFC and STEP files: the header's strings, then those of each entity type, as lists.

    Types are in the order in which they first appear. Files with neither strings nor a schema have no row.
    """
    heads = df.filter(F.ltrim(decode_utf8(F.col(content))).startswith("ISO-10303-21")).select(uid, F.regexp_extract(decode_utf8(F.col(content)), r"(?s)FILE_SCHEMA\s*\(\s*\(\s*'([^']*)'", 1).alias("schema"))
    groups = part21_strings(df, uid, content).groupBy(uid, "entity").agg(F.min("position").alias("first"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: F.concat(F.lit("- "), x["value"])), 1, most).alias("items"))
    lines = groups.groupBy(uid).agg(
        F.array_sort(F.collect_list(F.struct((F.col("entity") != "").alias("later"), "first", "entity", "items"))).alias("sections"), F.max(F.col("entity") != "").alias("any")
    )
    ifc = F.col("schema").startswith("IFC")
    kind = lambda e: F.when(e.startswith("IFC"), F.concat(F.lit("Ifc"), F.initcap(F.lower(F.substring(e, F.lit(4), F.length(e)))))).otherwise(F.concat(F.upper(F.substring(e, 1, 1)), F.substring(F.lower(F.replace(e, F.lit("_"), F.lit(" "))), F.lit(2), F.length(e))))
    section = lambda s: F.concat(F.array(F.lit(""), F.concat(F.lit("## "), F.when(s["later"], kind(s["entity"])).otherwise("Document"))), s["items"])
    title = F.concat(F.when(ifc, "# IFC model").otherwise("# STEP CAD model"), F.when(F.col("schema") != "", F.concat(F.lit(" (schema "), F.col("schema"), F.lit(")"))).otherwise(""))
    body = F.coalesce(F.flatten(F.transform("sections", section)), F.array().cast("array<string>"))
    return heads.join(lines, uid, "left").filter("any or schema <> ''").select(uid, F.array_join(F.concat(F.array(title), body), "\n").alias("text"))
