"""Markdown to HTML: blocks by a stack of containers, inline marks by stacks of openers, each in one pass."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Containers within containers; what is nested deeper is text.
DEEPEST = 24

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([\w+#.-]*)[^`]*$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_QUOTE = re.compile(r" {0,3}>[ ]?")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(?=\S)|[ \t]*$)")
_CELLS = re.compile(r"(?:[^|\\]|\\.)+|\|")
_PARTING = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_PIECE = re.compile(r"\\[!-/:-@\[-`{-~]|`+|\*+|_+|!?\[|\]|<(?:https?://|mailto:)[^\s<>]*>|[^\\`*_\[\]!<]+|.", re.DOTALL)
_TARGET = re.compile(r"\(\s*<?([^\s()<>]*(?:\([^\s()<>]*\)[^\s()<>]*)*)>?(?:\s+\"([^\"]*)\")?\s*\)")


def _safe(url: str) -> bool:
    """Whether a link may lead there: to the web, to a mail address, or to a place without a scheme."""
    scheme = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", url)
    return not scheme or scheme[1].lower() in ("http", "https", "mailto")


def inline(text: str) -> str:
    """One run of text with code, links, images and emphasis; everything else is escaped.

    A mark that closes looks for its opener on the stack of its own sign, so the work does not grow with unmatched marks.
    """
    pieces = _PIECE.findall(text)
    out: list[str] = []
    ticks: dict[int, list[int]] = {}
    for k in range(len(pieces) - 1, -1, -1):
        if pieces[k][0] == "`":
            ticks.setdefault(len(pieces[k]), []).append(k)
    open_marks: dict[str, list[list[int]]] = {"*": [], "_": []}  # place in out, signs left
    brackets: list[int] = []
    k = 0
    at = 0
    while k < len(pieces):
        piece = pieces[k]
        head = piece[0]
        after = at + len(piece)
        if head == "\\" and len(piece) == 2:
            out.append(html.escape(piece[1], False))
        elif head == "`":
            same = ticks[len(piece)]
            while same and same[-1] <= k:
                same.pop()
            if same:
                inside = "".join(pieces[k + 1 : same[-1]])
                after += len(inside) + len(piece)
                k = same[-1]
                out.append(f"<code>{html.escape(inside.strip() if inside.strip() else inside, False)}</code>")
            else:
                out.append(piece)
        elif head in "*_":
            before, behind = text[at - 1 : at], text[after : after + 1]
            blank_before, blank_behind = not before or before.isspace(), not behind or behind.isspace()
            opens, closes = not blank_behind, not blank_before
            if head == "_":  # not within words
                opens, closes = opens and not before.isalnum(), closes and not behind.isalnum()
            left = _closed(out, open_marks, head, len(piece)) if closes else len(piece)
            if left:
                out.append(head * left)
                if opens:
                    open_marks[head].append([len(out) - 1, left])
        elif piece in ("[", "!["):
            brackets.append(len(out))
            out.append(piece)
        elif head == "]" and brackets:
            place = brackets.pop()
            target = _TARGET.match(text, after) if text[after : after + 1] == "(" else None
            if target and _safe(target[1]):
                for marks in open_marks.values():  # what is open inside a link is text
                    while marks and marks[-1][0] > place:
                        marks.pop()
                title = f' title="{html.escape(target[2])}"' if target[2] else ""
                if out[place] == "![":
                    said = re.sub("<[^>]*>", "", "".join(out[place + 1 :]))
                    out[place:] = [f'<img alt="{said.replace(chr(34), "&quot;")}" src="{html.escape(target[1])}"{title} />']
                else:
                    out[place] = f'<a href="{html.escape(target[1])}"{title}>'
                    out.append("</a>")
                while after < target.end():  # the pieces of the target are done
                    k += 1
                    after += len(pieces[k])
                rest = after - target.end()
                if rest:
                    pieces[k] = pieces[k][-rest:]
                    after -= rest
                    k -= 1
            else:
                out.append("]")
        elif head == "<" and len(piece) > 1:
            out.append(f'<a href="{html.escape(piece[1:-1])}">{html.escape(piece[1:-1].removeprefix("mailto:"), False)}</a>')
        else:
            out.append(html.escape(re.sub(r" {2,}\n", "<br />\n", piece), False).replace("&lt;br /&gt;\n", "<br />\n") if "  \n" in piece else html.escape(piece, False))
        at = after
        k += 1
    return "".join(out)


def _closed(out: list[str], open_marks: dict[str, list[list[int]]], sign: str, signs: int) -> int:
    """Match a closing run with openers of its sign; returns how many of its signs are left."""
    mine, other = open_marks[sign], open_marks["_" if sign == "*" else "*"]
    while signs and mine:
        opener = mine[-1]
        use = 2 if signs >= 2 and opener[1] >= 2 else 1
        tag = "strong" if use == 2 else "em"
        while other and other[-1][0] > opener[0]:
            other.pop()
        opener[1] -= use
        signs -= use
        out[opener[0]] = sign * opener[1] + f"<{tag}>" + out[opener[0]][opener[1] + use :]
        out.append(f"</{tag}>")
        if not opener[1]:
            mine.pop()
    return signs


def _cells(line: str) -> list[str]:
    """Cells of a table's row; an escaped bar is none of its borders."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    out, cell = [], ""
    for part in _CELLS.findall(line):
        if part == "|":
            out.append(cell)
            cell = ""
        else:
            cell += part
    return [c.strip().replace("\\|", "|") for c in (out if not cell.strip() and out else [*out, cell])]


def _table(rows: list[str]) -> str:
    heads, sides = _cells(rows[0]), [(c.startswith(":"), c.endswith(":")) for c in _cells(rows[1])]
    names = {(True, True): "center", (True, False): "left", (False, True): "right"}
    style = [f' style="text-align: {names[s]};"' if s in names else "" for s in sides] + [""] * len(heads)

    def row(cells: list[str], tag: str) -> str:
        return "<tr>\n" + "".join(f"<{tag}{style[k]}>{inline(c)}</{tag}>\n" for k, c in enumerate((cells + [""] * len(heads))[: len(heads)])) + "</tr>\n"

    return "<table>\n<thead>\n" + row(heads, "th") + "</thead>\n<tbody>\n" + "".join(row(_cells(r), "td") for r in rows[2:]) + "</tbody>\n</table>"


def _starts_block(line: str) -> bool:
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line))


def blocks(lines: list[str], depth: int = 0) -> list[tuple[str, str]]:
    """Kind and HTML of each block of some lines; lists and quotes hold blocks of their own."""
    out: list[tuple[str, str]] = []
    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif fence := _FENCE.match(line):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(fence[1]) and not lines[j].strip().strip(fence[1][0])), len(lines))
            code = html.escape("".join(f"{x}\n" for x in lines[k + 1 : end]), False)
            kind = f' class="language-{html.escape(fence[2])}"' if fence[2] else ""
            out.append(("code", f"<pre><code{kind}>{code}</code></pre>"))
            k = end + 1
        elif heading := _HEADING.match(line):
            n = len(heading[1])
            out.append(("heading", f"<h{n}>{inline((heading[2] or '').strip())}</h{n}>"))
            k += 1
        elif _RULE.match(line):
            out.append(("rule", "<hr />"))
            k += 1
        elif _QUOTE.match(line) and depth < DEEPEST:
            end = k
            while end < len(lines) and lines[end].strip() and (_QUOTE.match(lines[end]) or not _starts_block(lines[end])):
                end += 1
            inner = blocks([_QUOTE.sub("", x, count=1) for x in lines[k:end]], depth + 1)
            out.append(("quote", "<blockquote>\n" + "".join(f"{h}\n" for _, h in inner) + "</blockquote>"))
            k = end
        elif (item := _ITEM.match(line)) and depth < DEEPEST:
            k, made = _list(lines, k, item, depth)
            out.append(("list", made))
        elif k + 1 < len(lines) and "|" in line and _PARTING.match(lines[k + 1]) and len(_cells(line)) == len(_cells(lines[k + 1])):
            end = k + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            out.append(("table", _table(lines[k:end])))
            k = end
        elif line.startswith(("    ", "\t")):
            end = k
            while end < len(lines) and (lines[end].startswith(("    ", "\t")) or not lines[end].strip()):
                end += 1
            code = [x[1:] if x.startswith("\t") else x[4:] for x in lines[k:end]]
            while not code[-1].strip():
                code.pop()
            out.append(("code", "<pre><code>" + html.escape("".join(f"{x}\n" for x in code), False) + "</code></pre>"))
            k = end
        else:
            end = k + 1
            while end < len(lines) and lines[end].strip() and not _starts_block(lines[end]) and not (depth and _ITEM.match(lines[end])):
                end += 1
            out.append(("paragraph", "<p>" + inline("\n".join(x.lstrip() for x in lines[k:end]).rstrip()) + "</p>"))
            k = end
    return out


def _list(lines: list[str], k: int, first: re.Match, depth: int) -> tuple[int, str]:
    """The list that begins at a line: where it ends, and its HTML. Items of another kind of mark begin another list."""
    ordered = first[2][0].isdigit()
    items: list[list[str]] = []
    loose = False
    while k < len(lines):
        item = _ITEM.match(lines[k])
        if not item or _RULE.match(lines[k]) or item[2][0].isdigit() != ordered or not ordered and item[2] != first[2]:
            break
        width = len(item[1]) + len(item[2]) + min(len(item[3] or " "), 4)
        own = [lines[k][item.end() :]]
        k += 1
        while k < len(lines):
            line = lines[k]
            indent = len(line) - len(line.lstrip(" "))
            if not line.strip():
                ahead = next((j for j in range(k, len(lines)) if lines[j].strip()), len(lines))
                if ahead == len(lines) or len(lines[ahead]) - len(lines[ahead].lstrip(" ")) < min(width, 2):
                    break
                own += [""] * (ahead - k)
                loose = True
                k = ahead
            elif indent >= min(width, 2):
                own.append(line[min(indent, width) :])
                k += 1
            elif _ITEM.match(line) or _starts_block(line) or not own[-1].strip():
                break
            else:  # a line that goes on without being indented
                own.append(line)
                k += 1
        items.append(own)
        ahead = next((j for j in range(k, len(lines)) if lines[j].strip()), len(lines))
        if ahead > k and ahead < len(lines) and (n := _ITEM.match(lines[ahead])) and n[2][0].isdigit() == ordered and (ordered or n[2] == first[2]):
            loose = True
            k = ahead
    made = []
    for own in items:
        inner = blocks(own, depth + 1)
        parts = [h[3:-4] if kind == "paragraph" and not loose else h for kind, h in inner]
        around = "\n" if loose and parts else ""
        made.append(f"<li>{around}" + "\n".join(parts) + ("\n" if around or len(parts) > 1 else "") + "</li>\n")
    tag = "ol" if ordered else "ul"
    start = f' start="{int(first[2][:-1])}"' if ordered and int(first[2][:-1]) != 1 else ""
    return k, f"<{tag}{start}>\n" + "".join(made) + f"</{tag}>"


def render(text: str | None) -> str:
    """HTML of a Markdown text; null is empty."""
    return "\n".join(h for _, h in blocks((text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")))


@F.pandas_udf(T.StringType())
def markdown_to_html(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML of Markdown: headings, rules, quotes, nested lists, tables, code, emphasis, links, images and line breaks.

    HTML in the text is escaped, and a link that leads to another scheme than http, https or mailto stays text. Null and
    empty texts give an empty text.
    """
    for batch in texts:
        yield batch.map(render, na_action=None) if batch.notna().all() else batch.map(lambda t: render(t if isinstance(t, str) else None))
