"""Text functions, as columns unless a regular expression cannot say it."""

from __future__ import annotations

import html
import ipaddress
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .languages import guess_language

#: Entities that html_to_text() decodes by itself; `&amp;` comes last, so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is in the expression, and evaluated, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def decode_utf8(content: Column) -> Column:
    """Text of bytes; what is not UTF-8 becomes U+FFFD. Null stays null, empty stays empty."""
    return F.make_valid_utf8(content.cast("string"))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All HTML entities decoded."""
    return texts.map(html.unescape, na_action="ignore")


def _common_entities(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


# Fixed values, here and in html_body_text(): what of a page is dropped, where its lines end, and how blanks are gathered.
def html_title(doc: Column, decode=_common_entities) -> Column:
    """The title element's text, empty if there is none."""
    inner = F.regexp_extract(doc, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    return strip(decode(F.regexp_replace(inner, r"<[^>]+>", "")))


def html_body_text(doc: Column, decode=_common_entities) -> Column:
    """Visible text with one line a block; runs of blank lines are one blank line. Empty if there is none."""
    text = F.regexp_replace(doc, r"(?is)<(script|style|head|noscript)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\s*/?>", "\n")
    text = decode(F.regexp_replace(text, r"<[^>]+>", ""))
    text = F.regexp_replace(text, r"[ \t\f\x0B]+", " ")
    return strip(F.regexp_replace(text, r"(?U)\n\s*\n\s*", "\n\n"))


def html_to_text(doc: Column, all_entities: bool = False) -> Column:
    """Title as a heading and the body's text; null without text. With all_entities, decoding takes a pandas UDF."""
    decode = unescape if all_entities else _common_entities
    both = F.struct(html_title(doc, decode).alias("title"), html_body_text(doc, decode).alias("body"))
    page = lambda p: F.when(p["title"] != "", F.concat(F.lit("# "), p["title"], F.lit("\n\n"), p["body"])).otherwise(p["body"])
    return let(both, lambda p: F.when(p["body"] != "", page(p)))


class _Reader(HTMLParser):
    """Collects the text outside of elements that are not shown."""

    HIDDEN = frozenset(("script", "style", "noscript", "template", "head", "svg"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.titled, self.title, self.parts = 0, False, [], []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        self.titled = self.titled or tag == "title" and tag not in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.depth = max(0, self.depth - 1)
        elif tag == "title":
            self.titled = False

    def handle_data(self, data):
        if self.titled:
            self.title.append(data)
        elif not self.depth and (text := data.strip()):
            self.parts.append(text)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def readable(pages: pd.Series) -> pd.DataFrame:
    """Title, and all shown text joined by single spaces, of web pages; empty for null."""
    rows = []
    for page in pages:
        reader = _Reader()
        reader.feed(page or "")
        reader.close()
        rows.append(("".join(reader.title).strip(), " ".join(reader.parts)))
    return pd.DataFrame(rows, columns=["title", "text"])


def ended_entities(doc: Column) -> Column:
    """A page in which only entities that end in a semicolon count as such: other ampersands stay as they are."""
    return F.regexp_replace(doc, r"&(?!#?\w+;)", "&amp;")


#: An edge of a word of A-Z, digits and underscores: what comes before or after an address may be any other letter.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: What counts as personal data, in the order of replacement.
PERSONAL = (
    (rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_EDGE}", "[redacted-email]"),
    (r"(?U)\b\d{3}-\d{2}-\d{4}\b", "[redacted-ssn]"),
    (r"(?U)\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b", "[redacted-card]"),
    (r"(?U)(?<!\w)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?!\w)", "[redacted-phone]"),
)


def redact_pii(text: Column) -> Column:
    """Email addresses, social security, card and phone numbers replaced by marks; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, mark in PERSONAL:
        out = F.regexp_replace(out, pattern, mark)
    return out


def table_to_markdown(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table; the first row is the header.

    Null rows are left out, null cells are empty, short rows are filled up, line ends become spaces and pipes are
    escaped. Empty without rows.
    """
    kept = F.filter(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: r.isNotNull())
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))
    cell = lambda c: F.replace(strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    lines = F.transform(kept, lambda r: line(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(kept) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n"))


def dedupe(strings: Column, most: int = 20_000) -> Column:
    """Trimmed strings without blank and repeated ones, the first of each in order, ``most`` at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(strings, strip), lambda s: s != "")), 1, most)


def safe_name(name: Column) -> Column:
    """A single file name: without separators, reserved and control signs, dots and spaces at the ends; 200 signs at most.

    Fixed values: the reserved signs.
    """
    bare = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]', "")
    return F.substring(F.regexp_replace(bare, r"^[. ]+|[. ]+$", ""), 1, 200)


def safe_path(path: Column) -> Column:
    """A path from the root of safe names."""
    parts = F.transform(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), safe_name)
    return F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda p: p != ""), "/"))


def report_name(name: Column) -> Column:
    """A safe name that ends in .docx; .html and .htm are replaced by it. Empty stays empty."""
    safe = safe_name(name)
    stem = F.regexp_replace(safe, r"(?i)\.html?$", "")
    return F.when((safe == "") | F.lower(safe).endswith(".docx"), safe).otherwise(F.concat(stem, F.lit(".docx")))


def report_location(path: Column, name: Column) -> Column:
    """Where a report goes: the path's parts as they are, and the report's name."""
    parts = F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: strip(p) != "")
    return F.concat(F.lit("/"), F.array_join(F.concat(parts, F.array(report_name(name))), "/"))


#: The marks of a report in a text.
_OPEN = r"\[\[\s*SAVE_REPORT\b([^\]]*?)\]\]"
_CLOSE = r"\[\[\s*/\s*SAVE_REPORT\s*\]\]"
_BLOCK = rf"(?is){_OPEN}(.*?)({_CLOSE}|\z)"


def report_markers(text: Column) -> Column:
    """Array of the reports marked in a text: path, filename, title, body, complete (false if not closed).

    Blocks without a body are left out.
    """
    text = F.coalesce(text, F.lit(""))
    part = lambda k: F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(k))

    def attribute(of: Column, *names: str) -> Column:
        found = (F.regexp_extract(of, rf'(?s).*\b{n}\s*=\s*"([^"]*)"', 1) for n in names)
        return F.coalesce(*(F.nullif(x, F.lit("")) for x in found), F.lit(""))

    blocks = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda z: F.struct(
        F.coalesce(F.nullif(attribute(z["a"], "path"), F.lit("")), F.lit("/")).alias("path"),
        attribute(z["a"], "file", "filename").alias("filename"),
        attribute(z["a"], "title").alias("title"),
        strip(z["b"]).alias("body"),
        (strip(z["c"]) != "").alias("complete"),
    ))
    return F.filter(blocks, lambda r: r["body"] != "")


def strip_report_markers(text: Column) -> Column:
    """The text without the marks, reports included."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?i){_OPEN}", ""), f"(?i){_CLOSE}", "")


def looks_like_html(text: Column) -> Column:
    """Whether a text begins with a tag of HTML's blocks. The tags."""
    return F.coalesce(text, F.lit("")).rlike(r"(?i)^\s*<(?:!doctype|html|h[1-6]|p|div|table|ul|ol|section|article|body|pre|blockquote)\b")


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def to_html(text: Column) -> Column:
    """Text that is HTML already as it is, other text as Markdown."""
    from .markdown import markdown_to_html

    text = F.coalesce(text, F.lit(""))
    return F.when(looks_like_html(text), text).otherwise(markdown_to_html(text))


def html_document(title: Column, body: Column) -> Column:
    """A whole document around a body; a body that is one already stays."""
    body = F.coalesce(body, F.lit(""))
    whole = body.rlike(r"(?i)^\s*<(?:!doctype|html)")
    head = F.concat(F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), escape_html(F.coalesce(F.nullif(title, F.lit("")), F.lit("Report"))), F.lit("</title></head><body>"))
    return F.when(whole, body).otherwise(F.concat(head, body, F.lit("</body></html>")))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def markdown_blocks(texts: pd.Series) -> pd.Series:
    """Blocks of a Markdown text: heading, list, quote, rule, table, code or paragraph, each with its lines."""
    import re

    kinds = (("heading", r"#{1,6}\s"), ("rule", r"(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$"), ("list", r"(?:[-*+]|\d+[.)])\s"), ("quote", r">"), ("table", r"\|"))

    def blocks(text: str | None) -> list[dict]:
        out: list[tuple[str, list[str]]] = []
        fence, fresh = None, True
        for line in (text or "").split("\n"):
            bare = line.strip()
            if fence:
                if bare.startswith(fence):
                    fence, fresh = None, True
                else:
                    out[-1][1].append(line)
                continue
            if bare.startswith(("```", "~~~")):
                fence = bare[:3]
                out.append(("code", []))
                continue
            if not bare:
                fresh = True
                continue
            kind = next((k for k, p in kinds if re.match(p, bare)), "paragraph")
            if fresh or kind in ("heading", "rule") or out[-1][0] != kind:
                out.append((kind, []))
            out[-1][1].append(bare)
            fresh = kind in ("heading", "rule")
        return [{"kind": k, "text": "\n".join(lines)} for k, lines in out]

    return texts.map(blocks)


def window(text: Column, offset: Column, length: Column, default: int = 4000, most: int = 20_000) -> Column:
    """A part of a text with its total length and where to go on (null at the end); bad numbers mean the defaults."""
    total = F.length(text)
    start = F.greatest(F.coalesce(F.try_to_number(offset.cast("string"), F.lit("S9999999999")).cast("long"), F.lit(0)), F.lit(0))
    size = F.least(F.greatest(F.coalesce(F.try_to_number(length.cast("string"), F.lit("S9999999999")).cast("long"), F.lit(default)), F.lit(1)), F.lit(most))
    part = F.substring(text, (start + 1).cast("int"), size.cast("int"))
    return F.struct(F.when(start < total, part).otherwise("").alias("text"), total.alias("total"), F.when(start + size < total, start + size).alias("next_offset"), (start >= total).alias("past_end"))


def cap_bytes(text: Column, most: int) -> Column:
    """The first ``most`` bytes of a text in UTF-8, without the rest of a sign cut in two, and whether it was cut."""
    raw = F.encode(text, "UTF-8")
    cut = F.substring(raw, 1, most)
    # a sign begun but not ended: a lead byte with too few bytes after it
    tail = F.upper(F.hex(F.substring(cut, -3, 3)))
    torn = F.regexp_extract(tail, r"^(?:..)*?((?:[CDEF].)|(?:[EF].[89AB].)|(?:F.[89AB].[89AB].))$", 1)
    kept = F.substring(cut, F.lit(1), (F.length(cut) - F.length(torn) / 2).cast("int"))
    return F.struct(F.when(F.length(raw) > most, F.decode(kept, "UTF-8")).otherwise(text).alias("text"), (F.length(raw) > most).alias("trimmed"))


def slug(name: Column) -> Column:
    """Lower-case letters and digits, other runs as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def conversation_title(message: Column) -> Column:
    """The first 60 signs of a message with single spaces, or a stand-in."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(strip(message), r"(?U)\s+", " "), 1, 60), F.lit("")), F.lit("New chat"))


def argument_summary(args: Column, value_chars: int = 80, total_chars: int = 300) -> Column:
    """A map of arguments on one line, long values and a long line cut with an ellipsis."""
    short = lambda text, n: F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)
    parts = F.transform(F.map_entries(args), lambda e: F.concat(e["key"], F.lit("="), short(F.coalesce(e["value"], F.lit("")), value_chars)))
    return short(F.array_join(parts, ", "), total_chars)


def schema_name(tenant: Column) -> Column:
    """Name of a tenant's namespace. Different tenants may share one: key tables by the tenant itself."""
    safe = F.regexp_replace(F.coalesce(tenant, F.lit("")), "[^A-Za-z0-9_]", "_")
    return F.concat(F.lit("tenant_"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("default")))


def tenant_of(header: Column, host: Column, default: str = "default") -> Column:
    """Tenant of a request: the header, else the first label of a host of three labels or more up to a dash."""
    labels = F.split(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r":\d+$", ""), r"\.")
    first = F.split(labels[0], "-")[0]
    named = (F.size(labels) >= 3) & ~first.isin("www", "api", "localhost", "")
    return F.coalesce(F.nullif(strip(header), F.lit("")), F.when(named, first), F.lit(default))


#: Languages of source files by file name ending.
LANGUAGES = {
    "python": ("py", "pyw", "pyi"),
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "typescript": ("ts", "tsx"),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp"),
    "csharp": ("cs",),
    "go": ("go",),
    "rust": ("rs",),
    "ruby": ("rb",),
    "php": ("php",),
    "shell": ("sh", "bash", "zsh"),
    "sql": ("sql",),
    "html": ("html", "htm"),
    "css": ("css",),
    "json": ("json",),
    "xml": ("xml", "xsd", "svg"),
    "yaml": ("yaml", "yml"),
    "toml": ("toml",),
    "markdown": ("md", "markdown"),
}


def source_language(name: Column, kind: Column, content: Column) -> Column:
    """Language of a source file: by its name's ending, else its MIME type, else a first line that names a shell, else marks
    of its syntax (languages.guess_language); else text.
    """
    ending = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]+)$", 1))
    by_name, by_kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    main = F.regexp_replace(F.lower(F.coalesce(kind, F.lit(""))), r"^[^/]*/(?:.*\+)?(?:x-)?", "")
    for language, endings in LANGUAGES.items():
        by_name = F.when(ending.isin(*endings), language).otherwise(by_name)
        by_kind = F.when(main.isin(language, *endings), language).otherwise(by_kind)
    first = F.regexp_extract(F.coalesce(content, F.lit("")), r"^#![^\n]*?\b(python|bash|zsh|sh|node|ruby|php)", 1)
    by_line = F.when(first.isin("bash", "zsh", "sh"), "shell").when(first == "node", "javascript").when(first != "", first)
    return F.coalesce(by_name, by_kind, by_line, guess_language(content), F.lit("text"))


#: Office families by file name ending.
EDITORS = {
    "word": ("docx", "doc", "odt", "rtf", "txt"),
    "cell": ("xlsx", "xls", "ods", "csv"),
    "slide": ("pptx", "ppt", "odp"),
}


def editor_type(name: Column) -> Column:
    """Family and ending of an editable office file, null for others."""
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = F.lit(None).cast("struct<family:string,ending:string>")
    for family, endings in EDITORS.items():
        out = F.when(ending.isin(*endings), F.struct(F.lit(family).alias("family"), ending.alias("ending"))).otherwise(out)
    return out


def document_key(file_uid: Column, version: Column) -> Column:
    """A key that changes with the version: the id's first signs and a digest of both."""
    prefix = F.substring(F.regexp_replace(file_uid, "[^A-Za-z0-9_-]", ""), 1, 20)
    return F.substring(F.concat(prefix, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", file_uid, version), 256), 1, 32)), 1, 128)


def should_save(status: Column) -> Column:
    return F.coalesce(status.isin(2, 6), F.lit(False))


def role_permitted(allowed: Column, roles: Column) -> Column:
    """Whether someone with ``roles`` may use something: an empty or null list allows everyone."""
    return (F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap(allowed, roles), F.lit(False))


def effective_roles(roles: Column, agent: bool = False) -> Column:
    """Roles with what administrators are besides; only an agent is a system administrator too."""
    more = F.array(F.lit("tenant_admin"), *([F.lit("system_admin")] if agent else []))
    return F.when(F.array_contains(roles, "administrators"), F.array_union(roles, more)).otherwise(roles)


def client_ip(peer: Column, forwarded: Column, trusted: list[str] | None = None) -> Column:
    """Address of the client: the right-most hop that is no trusted proxy; an untrusted peer is itself the client.

    Without a list of proxies it is the first hop.
    """
    networks = [ipaddress.ip_network(t, strict=False) for t in trusted or ()]

    def known(address: str) -> bool:
        try:
            return any(ipaddress.ip_address(address) in n for n in networks)
        except ValueError:
            return False

    @F.pandas_udf(T.StringType())
    def resolve(peers: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for own, hops in zip(peers, lists):
            hops = [h.strip() for h in (hops or "").split(",") if h.strip()]
            if not hops or networks and not known(own or ""):
                out.append(own)
            elif not networks:
                out.append(hops[0])
            else:
                out.append(next((h for h in reversed(hops) if not known(h)), hops[0]))
        return pd.Series(out, dtype=object)

    return resolve(peer, forwarded)


@F.pandas_udf(T.BooleanType())
def _all_public(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def public(address: str | None) -> bool:
        try:
            ip = ipaddress.ip_address((address or "").strip("[]"))
        except ValueError:
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return ip.is_global and not (ip.is_multicast or ip.is_reserved or ip.is_unspecified or ip.is_loopback or ip.is_link_local or ip.is_private)

    for batch in lists:
        yield batch.map(lambda addresses: addresses is not None and len(addresses) > 0 and all(map(public, addresses)))


def is_public_address(address: Column) -> Column:
    """Whether an address is a public one: not private, loopback, link-local, reserved, multicast or unspecified.

    False for what is no address. An IPv4 address in an IPv6 one counts as itself.
    """
    return _all_public(F.array(address))


def fetchable(url: Column, resolved: Column) -> Column:
    """Whether a URL may be fetched: HTTPS with a host all of whose ``resolved`` addresses are public, at least one."""
    ok = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
    return F.coalesce(ok & F.try_parse_url(url, F.lit("HOST")).isNotNull() & _all_public(resolved), F.lit(False))
