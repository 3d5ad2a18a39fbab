"""A guess of what language a source text is written in, from marks of its syntax; column expressions only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that must agree before a text counts as source.
AGREE = 3

#: Marks of each language; one that others lack counts twice (after the bar). Each has one unbounded part at most and no
#: repeated group, so that it takes linear time and no stack on long lines.
MARKS: dict[str, tuple[list[str], list[str]]] = {
    "python": (
        [r"(?m)^[ \t]*(?:elif|except|for|with|while|if|else|try)\b[^\n]{0,200}:[ \t]*$", r"(?m)^[ \t]*import [\w.]{1,80}[ \t]*$", r"\b(?:None|True|False)\b", r'"""', r"\b(?:not in|is not|lambda)\b"],
        [r"(?m)^[ \t]*(?:async )?def \w{1,80}\([^\n]{0,200}:[ \t]*$", r"(?m)^[ \t]*from [\w.]{1,80} import ", r"\bself\.\w", r"\b__\w{1,40}__\b"],
    ),
    "javascript": (
        [r"\b(?:const|let|var) [\w{\[]", r"=> ?[{(\w]", r"\bfunction\b ?\w{0,80}\(", r"\b(?:async function|await|typeof|undefined)\b", r"\bnew \w{1,80}\("],
        [r"===|!==", r"\b(?:console\.\w{1,20}|require)\(", r"\bmodule\.exports\b|['\"]use strict['\"]", r"(?m)^(?:import|export) [^\n;]{0,200} from ['\"]", r"\b(?:document|window)\.\w"],
    ),
    "typescript": (
        [r"\b(?:const|let) [\w{\[]", r"=> ?[{(\w]", r"===|!==", r"(?m)^(?:import|export) [^\n;]{0,200} from ['\"]", r"\b(?:private|public|readonly) \w"],
        [r"\w\??: ?(?:string|number|boolean|any|void|unknown|never)\b", r"(?m)^(?:export )?(?:interface|type|enum|declare) \w", r"\): ?(?:Promise<|void|string|number|boolean)", r"\bimport type\b|\bas (?:const|unknown|any)\b"],
    ),
    "java": (
        [r"\bnew \w{1,80}(?:<[^>\n]{0,80}>)?\(", r"\bthrows? \w", r"\b(?:extends|implements) \w", r"\b(?:private|protected|public) (?:static |final )?\w", r"\b(?:final|boolean|null)\b"],
        [r"(?m)^(?:package|import(?: static)?) [\w.]{1,200}(?:\.\*)?;", r"\bpublic (?:static |final |abstract )?(?:class|interface|enum|void) \w", r"\bSystem\.(?:out|err)\.", r"(?m)^[ \t]*@(?:Override|Test|Autowired|Nullable)\b", r"\bString\[\]|\b(?:List|Map|Optional)<"],
    ),
    "c": (
        [r"\b(?:int|void|char|unsigned|struct|static|size_t|double|long) \*{0,2}\w{1,80} ?[(;=\[,)]", r"\w->\w", r"\b(?:sizeof|NULL|const char)\b", r"(?m)^[ \t]*#[ \t]*(?:define|ifdef|ifndef|endif|if)\b", r"(?m)^[ \t]*return [^\n;]{0,200};", r"/\*"],
        [r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"][\w./-]{1,200}\.h[>\"]", r"\b(?:printf|malloc|free|strlen|memcpy|fprintf)\(", r"\btypedef (?:struct|enum|union|unsigned|int)\b", r"\bextern (?:int|void|char|const|\w{1,40}_t)\b"],
    ),
    "cpp": (
        [r"(?m)^[ \t]*#[ \t]*(?:include|define|ifdef|ifndef|endif|pragma)\b", r"\bconst \w{1,80} ?&", r"\bauto [&\w]", r"\w->\w|\w::\w", r"\b(?:virtual|override|nullptr|constexpr|noexcept|explicit|operator)\b"],
        [r"\bstd::\w", r"(?m)^[ \t]*template ?<", r"(?m)^[ \t]*(?:public|private|protected):[ \t]*$", r"(?m)^[ \t]*#[ \t]*include[ \t]*<\w{1,40}>", r"(?m)^[ \t]*(?:using )?namespace \w", r"\b(?:static|dynamic|reinterpret)_cast<"],
    ),
    "csharp": (
        [r"\bnew \w{1,80}(?:<[^>\n]{0,80}>)?\(", r"\b(?:public|private|internal|protected) (?:static |async |override |readonly |sealed )?\w", r"\b(?:string|bool|var|int) \w", r"\b(?:async|await|null|foreach)\b"],
        [r"(?m)^[ \t]*using (?:static )?[A-Z][\w.]{0,200};", r"(?m)^[ \t]*namespace [\w.]{1,200}", r"\bConsole\.(?:Write|Read)", r"\{ ?get; ?(?:private |init; ?)?(?:set; ?)?\}", r"\bforeach ?\(var "],
    ),
    "go": (
        [r" := ", r"\b(?:struct|interface) ?\{", r"\bnil\b", r"\brange \w", r"\[\](?:string|byte|int|\w)"],
        [r"(?m)^package \w{1,80}[ \t]*$", r"(?m)^func (?:\(\w{1,40} \*?\w{1,80}\) )?\w{1,80}\(", r"(?m)^import (?:\(|\")", r"\bif err != nil\b", r"\b(?:fmt|strings|errors)\.[A-Z]", r"\b(?:chan \w|defer \w|go func)"],
    ),
    "rust": (
        [r"\blet (?:mut )?\w", r"\bmatch \w", r"-> [\w&(<]", r"\bimpl\b", r"\w::\w", r"\b(?:Some|None|Ok|Err)\b"],
        [r"\bfn \w{1,80}(?:<[^>\n]{0,80}>)?\(", r"\blet mut \w", r"(?m)^[ \t]*(?:pub )?use \w{1,80}::", r"\bpub (?:fn|struct|enum|mod|trait|const)\b|\bpub\(crate\)", r"&(?:mut |'\w{1,20} )?(?:self|str)\b", r"(?m)^[ \t]*#!?\[\w", r"\b(?:println|vec|format|panic|assert_eq|assert)!"],
    ),
    "ruby": (
        [r"\b(?:nil|unless|elsif|yield)\b", r"\bdo \|\w", r"@\w{1,40} (?:\|\||)= ?", r"(?m)^[ \t]*(?:class|module) [A-Z]", r"\.(?:each|map|nil\?|empty\?)\b"],
        [r"(?m)^[ \t]*def [\w.]{1,80}[?!]?(?:\([^)\n]{0,200}\))?[ \t]*$", r"(?m)^[ \t]*end[ \t]*$", r"(?m)^[ \t]*require(?:_relative)? ['\"]", r"\battr_(?:reader|accessor|writer) :", r"(?m)^[ \t]*puts "],
    ),
    "php": ([r"\$\w{1,40} ?=", r"\$\w{1,40}->\w", r"\becho ", r"\bfunction \w{1,80}\((?:\w{1,40} )?\$"], [r"<\?php\b", r"\$this->", r"\bforeach ?\(\$", r"\barray\("]),
    "shell": (
        [r"\$\{\w", r"\$\(\w", r"(?m)^[ \t]*echo ", r"(?m)^[A-Z_]{2,40}=", r"\"\$\w", r"(?m)^[ \t]*(?:cd|mkdir|rm|cp|grep|set|sudo|exit) "],
        [r"(?m)^[ \t]*(?:fi|done|esac)[ \t]*$", r"(?m); ?(?:then|do)[ \t]*$", r"(?m)^[ \t]*export \w{1,40}=", r"(?m)^[ \t]*(?:el)?if \[\[? ", r"(?m)^\w{1,80} ?\(\) ?\{"],
    ),
    "sql": (
        [r"(?im)^[ \t]*(?:from|where|group by|order by|having|values|join|left join|inner join|on) ?[\w(]", r"(?i)\b(?:count|sum|min|max|coalesce)\(", r"(?i)\b(?:varchar|integer|bigint|timestamp|numeric|boolean|text)\b(?:\(|,| not null)", r"(?m);[ \t]*$"],
        [r"(?im)^[ \t(]*select [\w*\"(]", r"(?im)^[ \t]*create (?:or replace )?(?:temp )?(?:table|view|index|function) ", r"(?im)^[ \t]*(?:insert into|delete from|alter table|drop table|update \w{1,80} set) ?\w?", r"(?i)\b(?:primary key|foreign key|not null|references \w)"],
    ),
    "css": (
        [r"(?m)^[.#]?[\w-]{1,80}[^\n{};]{0,200}\{[ \t]*$", r"#[0-9a-fA-F]{3,6};", r"\b\d{1,5}(?:px|em|rem|vh|vw|%);", r"(?m)^\}[ \t]*$"],
        [r"(?m)^[ \t]*(?:margin|padding|color|display|font(?:-\w{1,20})?|background(?:-\w{1,20})?|border(?:-\w{1,20})?|width|height|position): ?[^\n;]{1,200};", r"(?m)^@(?:media|import|font-face|keyframes)\b", r"!important;|:hover\b"],
    ),
    "markdown": ([r"(?m)^[-*+] \S", r"(?m)^\d{1,4}\. \S", r"\*\*\w", r"`[^`\n]{1,100}`", r"(?m)^> \S"], [r"(?m)^#{1,6} \S", r"(?m)^```", r"\[[^\]\n]{1,200}\]\((?:https?:|[./#\w])[^)\n]{0,400}\)", r"(?m)^\|? ?:?-{3,40}:? ?\|"]),
}


def _every_line(content: Column, line: str, one: str) -> Column:
    """Whether all lines are of a form, and one of them of another."""
    lines = F.filter(F.split(content, r"\r?\n"), lambda x: F.trim(x) != "")
    return content.rlike(one) & (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(line))


def guess_language(content: Column) -> Column:
    """The language that most marks speak for, if AGREE do, ties to the earlier in MARKS; null for prose, null and empty texts.

    What forms tell alone comes first: documents of HTML, XML, PHP and JSON, and texts in which every line is one of TOML,
    or every line that is not indented one of YAML. A mark counts once, however often it occurs; whole texts are looked at.
    """
    found = F.array(*(F.struct(_score(content, *marks).alias("score"), F.lit(-n).alias("turn"), F.lit(name).alias("name")) for n, (name, marks) in enumerate(MARKS.items())))
    best = F.array_max(found)
    form = (
        F.when(content.rlike(r"(?i)^\s{0,100}<(?:!doctype html|html[\s>])"), "html").when(content.rlike(r"^\s{0,100}<\?xml\b"), "xml").when(content.rlike(r"^\s{0,100}<\?php\b"), "php")
        .when(content.rlike(r"^\s{0,100}[\[{]") & F.try_parse_json(content).isNotNull(), "json")
        .when(_every_line(content, r"^\s*(?:#|\[|[\w.\"-]+ *= ?\S|[\]})\"',\d])", r"(?m)^\[{1,2}[\w.\"-]{1,100}\]{1,2}[ \t]*$"), "toml")
        .when(_every_line(content, r"^(?:\s|#|- |-$|---|[\w.\"'/-]+:(?:\s|$)|[\]}])", r"(?m)^(?:- )?[\w.\"'/-]{1,100}:[ \t]*(?:$|\S[^\n]*$)[\s\S]*?^\s*(?:- )?[\w.\"'/-]{1,100}:(?:\s|$)"), "yaml")
    )
    return F.coalesce(form, F.when(best["score"] >= AGREE, best["name"]))


def _score(content: Column, shared: list[str], own: list[str]) -> Column:
    return reduce(add, [content.rlike(p).cast("int") for p in shared] + [content.rlike(p).cast("int") * 2 for p in own])
