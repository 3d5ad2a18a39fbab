"""What can be exchanged: embeddings, answers, web search. Chosen by name when a plan is built."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.chunking import hash_embed


def echo(questions: DataFrame, by: str = "question_id") -> DataFrame:
    """Answers that say what was asked and how much context there was; for tests without a network."""
    return questions.select(by, F.concat(F.lit("You asked: "), "message", F.lit(" ("), F.length("context"), F.lit(" signs of context)")).alias("answer"))


def no_web(questions: DataFrame, by: str = "question_id", k: int = 5) -> DataFrame:
    return questions.select(by, F.lit("").alias("title"), F.lit("").alias("url")).limit(0)


def fake_web(questions: DataFrame, by: str = "question_id", k: int = 5) -> DataFrame:
    """``k`` made-up results for each question."""
    n = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("n")
    return questions.select(by, "message", n).select(by, F.concat(F.lit("Result "), "n", F.lit(" for "), "message").alias("title"), F.concat(F.lit("https://example.com/"), "n").alias("url"))


EMBEDDING: dict[str, Callable] = {"hash": hash_embed}
CHAT: dict[str, Callable] = {"echo": echo}
WEB_SEARCH: dict[str, Callable] = {"none": no_web, "fake": fake_web}


def chosen(kind: dict[str, Callable], name: str, default: str) -> Callable:
    """The provider of that name (empty: the default); an error for an unknown one."""
    name = (name or default).strip().lower()
    if name not in kind:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(sorted(kind))}")
    return kind[name]


class Tool(NamedTuple):
    """Something that an answer may call: ``run`` takes calls (call_id, args, a map) and gives rows (call_id, text, sources)."""

    name: str
    description: str
    parameters: dict[str, str]
    run: Callable[[DataFrame], DataFrame]


SOURCES = "array<struct<title:string,url:string>>"


def web_search_tool(provider: str = "", k: int = 5) -> Tool:
    """Search of the web by a provider: the results as lines of text, and as sources."""
    def run(calls: DataFrame) -> DataFrame:
        asked = calls.select("call_id", F.coalesce(F.try_element_at("args", F.lit("query")), F.lit("")).alias("message"))
        found = chosen(WEB_SEARCH, provider, "none")(asked, "call_id", k).select("call_id", F.struct("title", "url").alias("s"))
        grouped = found.groupBy("call_id").agg(F.array_sort(F.collect_list("s")).alias("sources"))
        rows = calls.select("call_id").join(grouped, "call_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(SOURCES)))
        return rows.select("call_id", F.array_join(F.transform("sources", lambda s: F.concat(s["title"], F.lit(" "), s["url"])), "\n").alias("text"), "sources")

    return Tool("web_search", "Search the web.", {"query": "what to look for"}, run)


def run_tools(calls: DataFrame, tools: list[Tool]) -> DataFrame:
    """Rows (call_id, text, sources), one for each of ``calls`` (call_id, name, args); a name without a tool is said to have none."""
    known = F.col("name").isin(*(t.name for t in tools))
    unknown = calls.filter(~F.coalesce(known, F.lit(False))).select("call_id", F.concat(F.lit("there is no tool "), F.coalesce("name", F.lit(""))).alias("text"), F.array().cast(SOURCES).alias("sources"))
    return reduce(DataFrame.unionByName, (t.run(calls.filter(F.col("name") == t.name).select("call_id", "args")) for t in tools), unknown)
