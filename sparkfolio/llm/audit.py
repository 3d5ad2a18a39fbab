"""How quality filters interact: what each removes, alone and after others, in every order.

One pass over a text's bytes by a finite-state transducer measures it. Two fixed tables drive it: the class of each byte,
and what entering a class from a state puts out. The state after a byte is the one its class names, whatever the state
before, so a block of bytes is a few array look-ups, and the state at its end is carried into the next block. The spans
of the words go into a hash table with open addresses; a word counts as seen only if its bytes equal those in the slot.

What comes of the texts are bits, one for each filter that a document fails. All orders follow from their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, slices, spread, stored, texts_of

FILTERS = "ABCDE"
#: The signs of filter D.
SYMBOLS = b"#$%&*|"
#: A document fails A under so many words, B under so many hundredths of distinct words, C over so many of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Bytes of a text that go through the tables at a time, and bytes of words that are compared at a time.
WINDOW = 4 << 20

BLANK, PLAIN, CAPITAL, SYMBOL, INNER = range(5)
BETWEEN, WITHIN = 0, 1
#: What a byte puts out.
STARTS, ENDS, POINT, UPPER, SIGN = (np.uint8(1 << k) for k in range(5))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte, state after each class, and output by state before and class."""
    kind = np.full(256, PLAIN, np.uint8)
    kind[[32, *range(9, 14)]] = BLANK
    kind[ord("A") : ord("Z") + 1] = CAPITAL
    kind[list(SYMBOLS)] = SYMBOL
    kind[0x80:0xC0] = INNER  # further bytes of a character
    state = np.array([WITHIN if k != BLANK else BETWEEN for k in range(5)], np.uint8)
    put = np.zeros((2, 5), np.uint8)
    for before in (BETWEEN, WITHIN):
        for k in range(5):
            put[before, k] |= STARTS * (before == BETWEEN and k != BLANK) | ENDS * (before == WITHIN and k == BLANK)
            put[before, k] |= POINT * (k != INNER) | UPPER * (k == CAPITAL) | SIGN * (k == SYMBOL)
    return kind, state, put


KIND, STATE, PUT = _tables()


def transduce(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts raw[bounds[i]:bounds[i + 1]], and code points, capitals and signs of each text.

    A text begins and ends between words, so a word never goes on in the next text.
    """
    n = len(bounds) - 1
    totals = np.zeros((3, n), np.int64)
    starts, ends = [], []
    for first in range(0, len(raw), WINDOW):
        kind = KIND[raw[first : first + WINDOW]]
        after = STATE[kind]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[0] = STATE[KIND[raw[first - 1]]] if first else BETWEEN
        here = bounds[(bounds >= first) & (bounds < first + len(kind))] - first
        cut = here[(here + first > 0) & (before[here] == WITHIN)]
        before[here] = BETWEEN
        put = PUT[before, kind]
        starts.append(np.flatnonzero(put & STARTS) + first)
        ends.append(np.union1d(np.flatnonzero(put & ENDS), cut) + first)
        text = np.searchsorted(bounds, [first, first + len(kind)], "right") - 1
        some = np.arange(text[0], min(text[1] + 1, n))
        edges = np.clip(np.append(bounds[some], bounds[some[-1] + 1]) - first, 0, len(kind))
        for row, flag in zip(totals, (POINT, UPPER, SIGN)):
            so_far = np.concatenate([[0], np.cumsum((put & flag) != 0, dtype=np.int64)])
            row[some] += so_far[edges[1:]] - so_far[edges[:-1]]
    if len(raw) and STATE[KIND[raw[-1]]] == WITHIN:
        ends.append(np.array([len(raw)]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends]), *totals


def _hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, length and owner; bytes are weighed by powers of an odd number."""
    out = np.zeros(len(starts), np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(np.full(256, 0x100000001B3, np.uint64))
    for a, b in _groups(lengths):
        at = spread(starts[a:b], lengths[a:b])
        place = spread(np.zeros(b - a, np.int64), lengths[a:b])
        value = (raw[at].astype(np.uint64) + np.uint64(1)) * power[place & 255] ^ (place >> 8).astype(np.uint64)
        edges = np.concatenate([[0], np.cumsum(lengths[a:b])])
        out[a:b] = np.add.reduceat(value, edges[:-1])
    out = (out ^ owner.astype(np.uint64) * factor ^ lengths.astype(np.uint64)) * factor
    return out ^ out >> np.uint64(29)


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of spans that have about WINDOW / 8 bytes together; a longer span is one by itself."""
    part = np.cumsum(lengths) // (WINDOW >> 3)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(lengths)] if len(lengths) else []
    return zip(cuts, cuts[1:])


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b on are the same over each length."""
    out = np.ones(len(a), bool)
    for first, last in _groups(lengths):
        n = lengths[first:last]
        other = raw[spread(a[first:last], n)] != raw[spread(b[first:last], n)]
        out[first:last] = ~np.logical_or.reduceat(other, np.concatenate([[0], np.cumsum(n)])[:-1])
    return out


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of different words of each of ``n`` texts, of which word k lies in text ``owner[k]``.

    All words that are not settled try their slot at once. Of those that find it empty one takes it and is new; the
    others are compared with its owner, and those of another text or other bytes go on to the next slot.
    """
    lengths = ends - starts
    size = 1 << max(4, int(2 * len(starts)).bit_length())
    slots = np.full(size, -1, np.int64)
    fresh = np.zeros(len(starts), bool)
    waiting = np.arange(len(starts))
    slot = (_hashes(raw, starts, lengths, owner) & np.uint64(size - 1)).astype(np.int64)
    while len(waiting):
        at = slot[waiting]
        empty = slots[at] < 0
        slots[at[empty][::-1]] = waiting[empty][::-1]  # the first word of a slot takes it
        holder = slots[at]
        mine = holder == waiting
        fresh[waiting[mine]] = True
        waiting, holder = waiting[~mine], holder[~mine]
        seen = (owner[waiting] == owner[holder]) & (lengths[waiting] == lengths[holder])
        some = np.flatnonzero(seen)
        seen[some] = _equal(raw, starts[waiting[some]], starts[holder[some]], lengths[waiting[some]])
        waiting = waiting[~seen]
        slot[waiting] = slot[waiting] + 1 & size - 1
    return np.bincount(owner[fresh], minlength=n)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, code points, capitals and signs of each text; null counts as empty."""
    raw, bounds = texts_of(column)
    n = len(bounds) - 1
    starts, ends, points, capitals, signs = transduce(raw, bounds)
    owner = np.searchsorted(bounds, starts, "right") - 1
    return {
        "words": np.bincount(owner, minlength=n), "distinct_words": distinct_words(raw, starts, ends, owner, n),
        "code_points": points, "capitals": capitals, "signs": signs,
    }


def text_measures(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, *carry, words, distinct_words, code_points, capitals, signs, digest), one for each row of ``df``.

    Words are runs of signs other than white space (0x20, 0x09 to 0x0D), case counts. ``digest`` is the SHA-256 of the
    text in UTF-8. A null text is an empty one. Texts of any length are read whole; 4 MB of bytes go through the tables at
    a time.
    """
    names = [key, *carry]
    kinds = {"words": "long", "distinct_words": "long", "code_points": "long", "capitals": "long", "signs": "long", "digest": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", WINDOW):
            found = measure(batch.column("__text"))
            raw, bounds = texts_of(batch.column("__text"))
            view = memoryview(np.ascontiguousarray(raw))
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            columns = [pa.array(found[c]) if c != "digest" else pa.array(digests, pa.binary()) for c in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *kinds])
        give_back()

    given = df.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(names)), F.col(text).alias("__text"))
    shape = ", ".join([*(f"__{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), *(f"{c} {t}" for c, t in kinds.items())])
    return given.mapInArrow(run, shape).select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names)), *kinds)


def failures(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (key, part, digest, bits, n): how many rows of ``df`` have that key, part and text, and the bits of the filters
    A to D that they fail, 1 for A."""
    found = text_measures(df.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("body")), "key", "body", ("part",))
    fails = [
        F.col("words") < LEAST_WORDS, 100 * F.col("distinct_words") < LEAST_DISTINCT * F.col("words"),
        100 * F.col("capitals") > MOST_CAPITALS * F.col("code_points"), F.col("signs") > 0,
    ]
    bits = sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return found.withColumn("bits", bits).groupBy("key", "part", "digest", "bits").agg(F.count("*").alias("n"))


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part (value of ``part``, null as the empty string), order of the five filters and step in it. Of the
    part's documents: ``kept`` pass the filters up to this step, ``removed`` fail this one first, ``redundant`` fail it
    but were removed before, ``unique_fails`` fail it and no other; ``good_lost`` and ``toxic_lost`` are removed here and
    have a row of ``labels`` with quality 1, or toxic 1; ``shapley`` is what the filter removes, summed over all orders.

    E fails a document of whose text a smaller key has the same; texts are the same if their SHA-256 is. Rows of the same
    key and text do not fail each other, and rows with a null key neither fail E nor make another fail it. A null text is
    empty and fails A. Each row counts; several labels of a key count as one. An empty table gives no rows.

    Only rows of counts are shuffled: by key to meet their labels, then by text to find its smallest key. Rows that repeat
    in key and text are one before that, and a text that many rows share is one row a task, part and label after it. Rows
    without a key meet no label.
    """
    flags = labels.select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    flags = flags.filter("key is not null").groupBy("key").agg(F.coalesce(F.max("q"), F.lit(False)).alias("good"), F.coalesce(F.max("t"), F.lit(False)).alias("toxic"))
    rows = stored(failures(df, key, text, part), "failures")
    known = rows.filter("key is not null").join(flags, "key", "left").select("key", "part", "digest", "bits", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    group = ["digest", "part", "bits", "good", "toxic"]
    groups = stored(known.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.struct("key", "n")).alias("first")), "groups")
    least = groups.groupBy("digest").agg(F.min("first.key").alias("least"))
    joined = groups.join(least, "digest")
    spared = F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(0)
    cell = ["part", "bits", "good", "toxic"]
    passing = joined.select(*cell, spared.alias("n"))
    failing = joined.select("part", F.col("bits").bitwiseOR(16).alias("bits"), "good", "toxic", (F.col("n") - spared).alias("n"))
    nameless = rows.filter("key is null").select("part", "bits", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    cells = passing.union(failing).union(nameless).groupBy(*cell).agg(F.sum("n").alias("n")).filter("n > 0")
    size = 1 << len(FILTERS)

    def counts(name: str, which) -> list:
        return [F.sum(F.when((F.col("bits") == m) & which, F.col("n")).otherwise(0)).alias(f"{name}{m}") for m in range(size)]

    wide = cells.groupBy("part").agg(*counts("n", F.lit(True)), *counts("g", F.col("good")), *counts("t", F.col("toxic")))
    wide = wide.select("part", *(F.array(*(f"{c}{m}" for m in range(size))).alias(name) for c, name in (("n", "all"), ("g", "good"), ("t", "toxic"))))
    return wide.mapInArrow(_orders, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every order and step of each part, from its counts by failed bits."""
    mask = np.arange(1 << len(FILTERS))
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = np.array([[1 << FILTERS.index(f) for f in order] for order in orders])
    upto = np.cumsum(bit, 1)
    fails = (mask & bit[..., None]) > 0  # order, step, bits of a document
    earlier = (mask & (upto - bit)[..., None]) > 0
    weights = [(mask & upto[..., None]) == 0, fails & ~earlier, fails & earlier, mask == bit[..., None]]
    share = np.array([len(orders) // max(1, int(m).bit_count()) for m in mask])  # orders in which a document's filter comes first of those it fails
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    steps = bit.shape[1]
    for batch in batches:
        for part, every, good, toxic in zip(*(batch.column(c).to_pylist() for c in ("part", "all", "good", "toxic"))):
            every, good, toxic = np.array(every), np.array(good), np.array(toxic)
            found = [w @ every for w in weights] + [weights[1] @ good, weights[1] @ toxic, (fails * share) @ every]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * bit.size), pa.array(np.repeat(orders, steps)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders))), *(pa.array(f.ravel()) for f in found)],
                names,
            )
