"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to 3 with counts of the bytes that followed. A byte's probability
comes from the longest kept context: seen bytes by their counts, and an escape, as probable as the number of different
bytes seen is large, to the next shorter context without the bytes already excluded; below order 0 all bytes are alike.
The statistics are frozen after training, so a text's code length in each language is a sum over its bytes, and the
language of the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bytelevel import LETTER, byte_classes
from .shared import give_back, slices, spread, stored, texts_of

ORDER = 3
#: What stands before a text's first byte.
BEFORE = 10
#: Text that is scored with one table before the next is made, where there are several.
HELD_BYTES = 64 << 20


def held_out(key: str = "doc_id") -> Column:
    """Rows never learned from: those whose id as text has a CRC-32 of 1 modulo 3. A null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def _windows(raw: np.ndarray, bounds: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each with ORDER times ``fill`` before it, and the positions of the texts' own bytes."""
    lengths = np.diff(bounds)
    at = spread(bounds[:-1] + ORDER * np.arange(1, len(lengths) + 1), lengths)
    out = np.full(len(raw) + ORDER * len(lengths), fill, raw.dtype)
    out[at] = raw
    return out, at


class ContextModel:
    """Code lengths in bits of each byte after each context, in every language, from counts of 1 to 4 bytes.

    ``counts`` has arrays lang, size, code and n: in language number ``lang``, the ``size`` bytes packed in ``code`` (the
    last one lowest) occurred n times.
    """

    def __init__(self, languages: list[str], counts: dict[str, np.ndarray]) -> None:
        self.languages = languages
        lang, size, code, n = (counts[k] for k in ("lang", "size", "code", "n"))
        used = np.union1d(code[size == 1] & 255, [BEFORE])
        self.symbol = np.full(256, len(used), np.uint8 if len(used) < 256 else np.int32)
        self.symbol[used] = np.arange(len(used))
        width, langs = len(used) + 1, len(languages)
        self.width = width

        def compact(codes: np.ndarray, length: int) -> np.ndarray:
            out = np.zeros(len(codes), np.int64)
            for k in reversed(range(length)):
                out = out * width + self.symbol[codes >> 8 * k & 255]
            return out

        # the contexts of all languages; one that a language does not have stands for the next shorter one there
        self.deepest = np.zeros(1, np.int32)  # number of the longest kept context, by the symbols before a byte
        orders, total = [], 0
        for order in range(ORDER + 1):
            mine = size == order + 1
            grams = compact(code[mine].astype(np.int64), order + 1)
            contexts, number = np.unique(grams // width, return_inverse=True)
            by = np.argsort(number, kind="stable")
            parents = np.zeros(len(contexts), np.int32)
            if order:
                parents = self.deepest[contexts % width ** (order - 1)]
                longer = np.tile(self.deepest, width) if order > 1 else np.zeros(width, np.int32)
                longer[contexts] = total + np.arange(len(contexts))
                self.deepest = longer
            orders.append((total, parents, *(x[by] for x in (number, grams % width, lang[mine], n[mine]))))
            total += len(contexts)
        # probabilities a block of contexts at a time, in the table itself
        table = np.empty((total, width, langs), np.float32)
        for order, (start, parents, number, sign, label, times) in enumerate(orders):
            for first in range(0, len(parents), 512):
                last = min(first + 512, len(parents))
                a, b = np.searchsorted(number, (first, last))
                seen = np.zeros((last - first, width, langs))
                seen[number[a:b] - first, sign[a:b], label[a:b].astype(np.int64)] = times[a:b]
                below = table[parents[first:last]] if order else np.full((1, width, langs), 1 / 256)
                mass, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
                free = np.maximum(1 - np.where(seen > 0, below, 0).sum(1, keepdims=True), 1e-12)
                with np.errstate(divide="ignore", invalid="ignore"):
                    here = np.where(seen > 0, seen / (mass + kinds), kinds / (mass + kinds) * np.minimum(below / free, 1))
                table[start + first : start + last] = np.where(mass > 0, here, below)
        np.log2(np.maximum(table, 1e-30, out=table), out=table)
        self.bits = np.negative(table, out=table).reshape(-1, langs)

    def plain_lengths(self, raw: np.ndarray, bounds: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Bits of each text in its ``language`` if every byte stood alone, that is, without any context."""
        own = self.bits[: self.width][self.symbol[raw], np.repeat(language, np.diff(bounds))]
        ends = np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)])
        return ends[bounds[1:] - bounds[0]] - ends[bounds[:-1] - bounds[0]]

    def code_lengths(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        real = np.flatnonzero(np.diff(bounds))
        if not real.size:
            return out
        ends = np.append(bounds[:-1][real], bounds[-1])
        signs, at = _windows(self.symbol[raw], ends, self.symbol[BEFORE])
        width = np.int32(self.width)
        step = max(1, (8 << 20) // len(self.languages))
        for first in range(0, len(at), step):
            here = at[first : first + step]
            context = np.zeros(len(here), np.int32)
            for k in range(ORDER, 0, -1):
                context = context * width + signs[here - k]
            rows = self.bits[self.deepest[context] * width + signs[here]]
            one, after = np.searchsorted(ends, first, "right") - 1, np.searchsorted(ends, first + len(here), "left")
            out[real[one:after]] += np.add.reduceat(rows, np.maximum(ends[one:after] - first, 0), axis=0, dtype=np.float64)
        return out


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of all runs of 1 to 4 bytes in the batches, by language."""
    number = {name: k for k, name in enumerate(languages)}
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return codes, np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

    for batch in slices(batches, "__text"):
        labels = np.array([number.get(x, -1) for x in batch.column("__lang").to_pylist()])
        raw, bounds = texts_of(batch.column("__text"))
        signs, at = _windows(raw, bounds, BEFORE)
        of = np.repeat(labels, np.diff(bounds))
        code = np.zeros(len(at), np.uint32)
        for k in range(ORDER, -1, -1):
            code = code << np.uint32(8) | signs[at - k]
        for label in np.unique(labels[labels >= 0]).tolist():
            parts = found.setdefault(label, [])
            parts.append(np.unique(code[of == label], return_counts=True))
            if len(parts) > 8:
                found[label] = [merged(parts)]
    for label, parts in found.items():
        codes, n = merged(parts)
        for size in range(1, ORDER + 2):
            short, n_short = merged([(codes & np.uint32((1 << 8 * size) - 1 & 0xFFFFFFFF), n)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(short), label)), pa.array(np.full(len(short), size)), pa.array(short.astype(np.int64)), pa.array(n_short)], ["lang", "size", "code", "n"])


def _kept(counts: dict[str, np.ndarray], least: int, contexts: int) -> dict[str, np.ndarray]:
    """One language's counts in the contexts that it keeps: those seen ``least`` times, shorter ones first, ``contexts`` at most.

    Of one length the most frequent are kept, of equals the least. Nothing here depends on other languages.
    """
    size, code, n = counts["size"], counts["code"].astype(np.int64), counts["n"]
    keep, room = size == 1, contexts
    for order in range(1, ORDER + 1):
        mine = np.flatnonzero(size == order + 1)
        before, of = np.unique(code[mine] >> 8, return_inverse=True)
        weight = np.bincount(of, n[mine], len(before))
        chosen = np.zeros(len(before), bool)
        chosen[np.argsort(-weight, kind="stable")[: max(room, 0)]] = True
        chosen &= weight >= least
        room -= int(chosen.sum())
        keep[mine[chosen[of]]] = True
    return {c: v[keep] for c, v in counts.items()}


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_a_language: int = 2500, languages_a_table: int = 4, least: int = 2, contexts: int = 4000, max_counts: int = 250_000) -> _Frozen | None:
    """Learn all labels from the text and label of the rows that are not held out; None if there are none with both.

    It learns from a bounded sample: of each language, about ``docs_a_language`` documents (all, if there are fewer),
    those of the least hash of their id. Counting runs where the documents are. Of a language's counts the ``max_counts``
    most frequent ones come to the driver, and of these the ones in its ``contexts`` most frequent contexts that were seen
    ``least`` times are sent on; a longer one that is left out is read as the next shorter one. All these bounds are a
    language's own, so a text's code length in a language is the same whatever the other languages are. Scoring has a
    table for each ``languages_a_table`` languages, one at a time.
    """
    spark = df.sparkSession
    usable = df.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = usable.groupBy(F.col(lang).alias("lang")).count().collect()
    if not found:
        return None
    languages = sorted(r["lang"] for r in found)
    below = spark.createDataFrame([(r["lang"], int((1 << 30) * min(1.0, docs_a_language / r["count"]))) for r in found], "__lang string, __below long")
    rows = usable.select(F.col(text).alias("__text"), F.col(lang).alias("__lang"), F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)).alias("__place"))
    sample = rows.join(F.broadcast(below), "__lang").filter("__place < __below").select("__text", "__lang")
    counts = stored(
        sample.mapInArrow(lambda batches: _count(batches, languages), "lang long, size long, code long, n long")
        .groupBy("lang", "size", "code").agg(F.sum("n").alias("n")), "language_counts",
    )
    sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
    tables = []
    for first in range(0, len(languages), languages_a_table):
        block = [k for k in range(first, min(first + languages_a_table, len(languages)))]
        small = [k for k in block if 0 < sizes.get(k, 0) <= max_counts]
        chosen = [counts.filter(F.col("lang").isin(small))] if small else []
        chosen += [counts.filter(F.col("lang") == k).orderBy(F.col("size") > 2, F.desc("n"), "size", "code").limit(max_counts) for k in block if sizes.get(k, 0) > max_counts]
        if not chosen:
            continue
        got = [c.toArrow() for c in chosen]
        arrays = {c: np.concatenate([g.column(c).to_numpy() for g in got]) for c in ("lang", "size", "code", "n")}
        order = np.lexsort((arrays["code"], arrays["size"], arrays["lang"]))
        arrays = {c: v[order] for c, v in arrays.items()}
        own = [_kept({c: v[arrays["lang"] == k] for c, v in arrays.items()}, least, contexts) for k in block]
        arrays = {c: np.concatenate([x[c] for x in own]) for c in arrays}
        arrays["lang"] = arrays["lang"] - first
        tables.append(_Frozen(languages[first : block[-1] + 1], arrays))
    if not tables:
        return None
    tables[0].others = tables[1:]
    return tables[0]


class _Frozen:
    """What a model is made from; each Python worker makes its own, so that only the counts are sent.

    ``others`` are those of the languages that are in tables of their own.
    """

    made: dict[str, ContextModel] = {}

    def __init__(self, languages: list[str], counts: dict[str, np.ndarray]) -> None:
        import hashlib

        kinds = {"lang": np.uint16, "size": np.uint8, "code": np.uint32, "n": np.int64}
        self.others: list[_Frozen] = []
        self.parts = (languages, {c: counts[c].astype(kind) for c, kind in kinds.items()})
        self.name = hashlib.sha256(repr(languages).encode() + b"".join(v.tobytes() for v in self.parts[1].values())).hexdigest()

    def model(self) -> ContextModel:
        if self.name not in self.made:
            self.made.clear()
            self.made[self.name] = ContextModel(*self.parts)
        return self.made[self.name]


def _held(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in order, in lists of about ``limit`` bytes of text; one by one if that is 0."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += len(texts_of(batch.column("__text"))[0])
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def predict(df: DataFrame, frozen: _Frozen | None, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Rows (key, lang_pred, score, gain) for every row of ``df``, in its order and number.

    ``lang_pred`` is the language of the shortest code (of equals the first by code point), ``score`` its share if each
    language were as likely as its code length says, from 0 to 1. A text that is null or has no letter is ``und`` with
    score 0, and so is every text without a model. ``gain`` is how many bits a byte the contexts save in that language
    against its bytes alone: the share only compares the languages with each other, while text in none of them, or letters
    in no order, gain nothing or lose. It is 0 for ``und``. Only the text is looked at. With ``carry`` the first column is
    instead ``row``, a struct of all columns of ``df``, so that a filter needs no join.
    """
    name = "row" if carry else key
    rows = df.select((F.struct(*df.columns) if carry else F.col(key)).alias("__key"), F.col(text).alias("__text"))
    if frozen is None:
        return rows.select(F.col("__key").alias(name), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("gain"))
    sent = df.sparkSession.sparkContext.broadcast(frozen)  # the counts of ``contexts`` contexts a language at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [sent.value, *sent.value.others]
        names = np.array([name for t in tables for name in t.parts[0]] + ["und"], object)
        for held in _held(slices(batches, "__text", 4 << 20), HELD_BYTES if len(tables) > 1 else 0):
            state = [(np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)) for batch in held]
            first = 0
            for t in tables:  # one table in memory at a time
                model = t.model()
                for k, batch in enumerate(held):
                    low, best, mass, plain = state[k]
                    raw, bounds = texts_of(batch.column("__text"))
                    bits = model.code_lengths(raw, bounds)
                    least, own = bits.min(1), bits.argmin(1)
                    best = np.where(least < low, first + own, best)
                    plain = np.where(least < low, model.plain_lengths(raw, bounds, own), plain)
                    now = np.minimum(low, least)
                    mass = mass * np.exp2(np.maximum(now - low, -1000)) + np.exp2(np.maximum(now[:, None] - bits, -1000)).sum(1)
                    state[k] = now, best, mass, plain
                first += len(t.parts[0])
            for batch, (low, best, mass, plain) in zip(held, state):
                raw, bounds = texts_of(batch.column("__text"))
                letters = np.concatenate([[0], np.cumsum(byte_classes(raw) == LETTER)])[bounds]
                none = letters[1:] == letters[:-1]
                yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(names[np.where(none, len(names) - 1, best)], pa.string()), pa.array(np.where(none, 0.0, 1 / mass)), pa.array(np.where(none, 0.0, (plain - low) / np.maximum(np.diff(bounds), 1)))], ["__key", "__lang", "__score", "__gain"])
        give_back()

    schema = StructType([StructField("__key", rows.schema["__key"].dataType), StructField("__lang", StringType()), StructField("__score", DoubleType()), StructField("__gain", DoubleType())])
    return rows.mapInArrow(score, schema).toDF(name, "lang_pred", "score", "gain")
