"""Full-text and fuzzy search over an inverted index of stems."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from .access import allowed_top, cap, check_query, readable
from .trigram import near_texts, similar_names


def inverted_index(documents: DataFrame, uid: str = "file_uid", name: str = "name", text: str = "content_md", only: list[str] | None = None, lengths: bool = False) -> DataFrame:
    """Rows (uid, lexeme, positions): where each stem stands in name and text; stop words count as places only.

    A file is one row of ``documents``, so its words are gathered where it is and nothing is shuffled. With ``only``, it
    has these lexemes alone; with ``lengths``, a column ``length`` as well: the number of the file's words.
    """
    if only is not None:  # other files are not cut into words
        documents = documents.filter(may_have(only, name, text))
    rows = documents.select(F.col(uid).alias("u"), _words(name, text).alias("w"))
    stop, wanted = frozenset(T.STOP_WORDS), None if only is None else frozenset(only)
    heads = frozenset(w[:1] for w in only or ())  # a word and its stem begin with the same letter

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}

        def lexeme(word: str) -> str | None:
            if word not in known:
                if len(known) > REMEMBERED:
                    known.clear()
                stem = None if word in stop or heads and word[:1] not in heads else T.stem(word)
                known[word] = stem if wanted is None or stem in wanted else None
            return known[word]

        for batch in batches:
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False)))
            first = 0
            while first < batch.num_rows:  # some files at a time, by their words
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS, "right")) - 1)
                yield _postings(batch.slice(first, last - first), lexeme)
                first = last

    found = rows.mapInArrow(gather, f"u {rows.schema['u'].dataType.simpleString()}, lexeme string, positions array<int>, length int")
    return found.select(F.col("u").alias(uid), "lexeme", "positions", *(["length"] if lengths else []))


def _both(name: str, text: str) -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(text), F.lit("")))


def _words(name: str, text: str) -> Column:
    return T.words(_both(name, text))


def may_have(lexemes: list[str], name: str = "name", text: str = "content_md") -> Column:
    """Whether name or text hold the letters that the words of a lexeme begin with; true for all files with a lexeme."""
    heads = sorted({T.stem_head(w) for w in lexemes})
    return F.exists(F.array(F.lower(_both(name, text))), lambda t: reduce(or_, (F.contains(t, F.lit(h)) for h in heads), F.lit(False)))  # letters are made small once


def lengths(documents: DataFrame, uid: str = "file_uid", name: str = "name", text: str = "content_md") -> DataFrame:
    """Rows (uid, length): how many words the name and text of each file have."""
    return documents.select(uid, F.size(_words(name, text)).alias("length"))


#: Words of files that a task gathers at a time, and words whose stem it remembers; when there are more, it starts anew.
WORDS, REMEMBERED = 200_000, 400_000


def _postings(files: pa.RecordBatch, lexeme: Callable[[str], str | None]) -> pa.RecordBatch:
    """Rows (u, lexeme, positions, length) of files (u, w), w being a file's words in order."""
    words = files.column("w")
    many = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(words.flatten())
    stems = pa.array([lexeme(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    of = pc.fill_null(stems.indices, -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    file = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + 1
    kept = np.flatnonzero(of >= 0)
    key = file[kept] * max(1, len(stems.dictionary)) + of[kept]
    order = np.argsort(key, kind="stable")  # places stay in order
    kept, key = kept[order], key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(place[kept].astype(np.int32)))
    at = kept[starts]
    return pa.RecordBatch.from_arrays([files.column("u").take(pa.array(file[at])), stems.dictionary.take(pa.array(of[at])), positions, pa.array(many[file[at]].astype(np.int32))], ["u", "lexeme", "positions", "length"])


#: Parts that a stored index is dealt out to by lexeme, of which a query reads those of its own lexemes; and rows of a
#: lexeme that one file of it holds.
INDEX_PARTS, INDEX_ROWS = 256, 100_000
#: The lexeme under which a stored index has every file, for queries of negations.
EVERY = ""


def store_index(index: DataFrame, path: str, every: DataFrame | None = None) -> None:
    """Write an inverted index dealt out and sorted by lexeme, so that a query reads a few row groups of a few parts.

    A part is spread over as many tasks as its most frequent lexeme can need. ``every`` has the ids of all files, also of
    those without a lexeme; if it is not given, the index's own files are all. The index is shuffled once.
    """
    uid = index.columns[0]
    all_ = (index if every is None else every).select(uid).distinct()
    index = index.select(uid, "lexeme", "positions")
    whole = index.unionByName(all_.select(uid, F.lit(EVERY).alias("lexeme"), F.array().cast("array<int>").alias("positions")))
    dealt = whole.withColumns({"part": lexeme_part(F.col("lexeme")), "salt": F.pmod(F.xxhash64(uid), F.lit(spread(all_.count())))})
    dealt.repartition("part", "salt").drop("salt").sortWithinPartitions("part", "lexeme").write.mode("overwrite").partitionBy("part").parquet(path)


def spread(files: int) -> int:
    """Tasks that a part of an index of so many files is spread over: no lexeme has more rows than there are files."""
    return max(1, -(-files // INDEX_ROWS))


def lexeme_part(lexeme: Column) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(INDEX_PARTS)).cast("int")


def stored_index(spark: SparkSession, path: str, query: Query) -> DataFrame:
    """The rows of a stored index that a query needs: partitions by its lexemes' parts, then row groups by lexeme.

    For a query with an alternative of negations only, that is every file's row as well.
    """
    wanted = query.lexemes + [EVERY] * query.negative
    parts = spark.createDataFrame([(w,) for w in wanted], "w string").select(lexeme_part(F.col("w")).alias("p")).collect()
    rows = spark.read.parquet(path)
    return rows.filter(F.col("part").isin([r["p"] for r in parts]) & F.col("lexeme").isin(wanted)).drop("part")


class Query:
    """A web-style query: words are all wanted, "..." is a phrase, or separates alternatives, - negates."""

    def __init__(self, text: str) -> None:
        self.groups: list[list[tuple[bool, list[tuple[int, str]]]]] = [[]]
        for negated, phrase, word in re.findall(r'(-?)"([^"]*)"?|(\S+)', text):
            negated = bool(negated)
            if word:
                if word.lower() == "or":
                    if self.groups[-1]:
                        self.groups.append([])
                    continue
                negated, phrase = word.startswith("-"), word.lstrip("-")
            found = [(k, T.stem(w)) for k, w in enumerate(re.findall(r"\w+", phrase.lower())) if w not in T.STOP_WORDS]
            if found:
                self.groups[-1].append((negated, found))
        self.groups = [g for g in self.groups if g]

    @property
    def lexemes(self) -> list[str]:
        return sorted({w for g in self.groups for _, item in g for _, w in item})

    @property
    def wanted(self) -> list[str]:
        return sorted({w for g in self.groups for negated, item in g if not negated for _, w in item})

    @property
    def negative(self) -> bool:
        """Whether some alternative has negations only, so that files without any of the lexemes match."""
        return any(all(negated for negated, _ in g) for g in self.groups)

    def matches(self, at: Column) -> Column:
        """Condition over a map of lexeme to positions."""
        places = lambda w: F.coalesce(F.try_element_at(at, F.lit(w)), F.array().cast("array<int>"))

        def item(words: list[tuple[int, str]]) -> Column:
            (first, head), *rest = words
            if not rest:
                return F.size(places(head)) > 0
            return F.exists(places(head), lambda p: reduce(and_, (F.array_contains(places(w), p + (k - first)) for k, w in rest)))

        one = lambda negated, words: ~item(words) if negated else item(words)
        return reduce(or_, (reduce(and_, (one(*i) for i in g)) for g in self.groups)) if self.groups else F.lit(False)

    def rank(self, at: Column) -> Column:
        """Rank by the terms' places: weight 0.1 a place, near pairs for queries of which all is wanted."""
        places = lambda w: F.coalesce(F.try_element_at(at, F.lit(w)), F.array().cast("array<int>"))
        wanted = self.wanted
        if not wanted:
            return F.lit(0.0)
        if len(self.groups) > 1 or len(wanted) == 1:
            series = lambda w: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(places(w)), F.lit(1))), F.lit(0.0), lambda s, k: s + F.when(k <= F.size(places(w)), 0.1 / (k * k)).otherwise(0.0))
            return reduce(lambda a, b: a + b, (series(w) for w in wanted)) / 1.64493406685 / len(wanted)
        decay = lambda d: F.when(d > 100, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
        miss = F.lit(1.0)
        for i, a in enumerate(wanted):
            for b in wanted[i + 1 :]:
                miss = F.aggregate(places(a), miss, lambda s, p: F.aggregate(places(b), s, lambda t, q: t * (1 - F.sqrt(0.01 * decay(F.greatest(F.abs(p - q), F.lit(1)).cast("double"))))))  # noqa: B023
        return F.when(miss == 1.0, 1e-20).otherwise(1 - miss)


def matching(index: DataFrame, query: Query, uid: str = "file_uid", every: DataFrame | None = None) -> DataFrame:
    """Rows (uid, rank) of the files that match. Only the query's stems are read of the index.

    An alternative of negations only matches all files without its stems: those of ``every`` (column uid), or, if it is
    not given, those that the index has; a stored one has them all.
    """
    if not query.lexemes:
        return index.select(uid, F.lit(0.0).alias("rank")).limit(0)
    some = index.filter(F.col("lexeme").isin(query.lexemes))
    if query.negative:
        all_ = (index if every is None else every).select(uid).distinct()
        some = some.unionByName(all_.select(uid, F.lit("").alias("lexeme"), F.array().cast("array<int>").alias("positions")))
    maps = some.groupBy(uid).agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("at"))
    return maps.filter(query.matches(F.col("at"))).select(uid, query.rank(F.col("at")).alias("rank"))


def search(documents: DataFrame, index: DataFrame | None, grants: DataFrame, text: str, limit: int = 20, fuzzy: bool = True, name_least: float = 0.3, text_least: float = 0.6, mode: str = "exact", postings: DataFrame | None = None) -> DataFrame:
    """Rows (file_uid, name, snippet, score) of the best files that a user may read.

    A file counts if it is converted or indexed and matches the query, or, with ``fuzzy``, if its name or some part of
    its text is similar enough. The score is the rank plus the greater similarity. Ties go to the smaller id. ``index`` is
    an inverted index; without one, the query's own stems are looked for in the texts. ``postings`` are those of the
    query's trigrams (trigram.stored_trigrams); without them, every name and text is looked through. With both, only the
    texts of files that the lists name are touched.

    Only texts that can reach the threshold by the trigrams they share with the query, and those that match, are looked
    at by Python for the run that is most similar. Texts stay out of the ranking; snippets are made of the rows returned.
    """
    wanted = Query(check_query(text))
    live = documents.filter(F.col("status").isin("converted", "indexed"))
    grams = len(set(T.trigram_list(text)))
    matched = matching(inverted_index(live, only=wanted.lexemes) if index is None else index, wanted, every=live)
    by_name = T.similarity(F.lit(text), F.coalesce("name", F.lit("")))
    near = T.shared_trigrams(text, F.col("content_md")) >= text_least * grams - 1e-9
    if index is None and not wanted.negative:  # texts that cannot count are neither joined nor looked at by word
        may = may_have(wanted.wanted)
        if fuzzy and grams:
            named = (T.may_share(text, F.col("name")) >= name_least * grams - 1e-9) & (by_name >= name_least)
            may = may | named | (T.may_share(text, F.col("content_md")) >= text_least * grams - 1e-9) & near
        live = live.filter(may)
    if postings is not None:
        ids = matched.select("file_uid")
        if fuzzy and grams:
            ids = ids.union(similar_names(postings, text, name_least).select("file_uid")).union(near_texts(postings, text, text_least).select("file_uid"))
        live = live.join(ids, "file_uid", "left_semi")
    rows = live.join(matched, "file_uid", "left").withColumn("by_name", by_name)
    if fuzzy and grams:
        rows = rows.filter(F.col("rank").isNotNull() | (F.col("by_name") >= name_least) | near)
    else:
        rows = rows.filter("rank is not null")
    if mode == "exact":  # rights before Python sees a text
        rows = readable(rows, grants)
    # as if it could differ between calls: else it is called twice, and before the other conditions and the rights
    rows = rows.withColumn("by_text", T.word_similarity.asNondeterministic()(F.lit(text), F.col("content_md")))
    if fuzzy:
        rows = rows.filter(F.col("rank").isNotNull() | (F.col("by_name") >= name_least) | (F.col("by_text") >= text_least))
    scored = rows.select("file_uid", (F.coalesce("rank", F.lit(0.0)) + F.greatest("by_name", "by_text")).alias("score"))
    order, limit = [F.desc("score"), F.col("file_uid")], cap(limit, 100)
    top = scored.orderBy(*order).limit(limit) if mode == "exact" else allowed_top(scored, grants, limit, order, mode)
    found = documents.join(F.broadcast(top), "file_uid")  # at most 100 rows
    return found.select("file_uid", "name", T.headline(wanted.wanted)(F.col("content_md")).alias("snippet"), "score").orderBy(F.desc("score"), "file_uid")
