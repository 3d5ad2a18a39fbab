"""Token ids in flat binary files with 64-bit document offsets, read back through memory maps.

Format, in one folder: for each partition k in ascending order of document id

- ``ids-k.bin``: the ids of its documents one after the other, little-endian unsigned integers of 16 bits if the
  vocabulary has at most 65,536 ids, else of 32 bits;
- ``offsets-k.bin``: n + 1 little-endian unsigned 64-bit integers, the positions of the documents' first ids counted
  over all partitions, and the end. They begin at the partition's base, the prefix sum of the earlier totals;
- ``docs-k.bin``: n signed 64-bit document ids and then n bytes, 1 where the document id is null;

and ``manifest.json`` with the width and, for each partition, documents, ids and base.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bytelevel import LETTER, NUMBER, OTHER, SPACE, byte_classes, character_classes, distinct_pieces
from .shared import file_store, integer_key, slices, spread, texts_of

#: Encodings that a Python worker remembers; when there are more, it starts anew.
REMEMBERED = 400_000


class WordEncoder:
    """Encodes texts with a word-level tokenizers file that drops white space, a distinct piece at a time.

    The library itself encodes every piece. A text is cut where the library's result is that of the parts: at ASCII
    white space, and between a letter, number or other sign and one of another class, if both are plain, that is, if the
    normaliser maps the sign to one sign of the same class. Pieces with an apostrophe, the first two signs of an added
    token or a sign that is not plain are cut at white space only. Whether the file's normaliser lower-cases is asked of
    it. A file of another kind, for which parts do not add up on probes, is refused.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        kinds = character_classes()
        self.plain = np.zeros(0x110000, bool)
        for point in range(0x250):
            to = self.library.normalizer.normalize_str(chr(point)) if self.library.normalizer else chr(point)
            self.plain[point] = len(to) == 1 and kinds[ord(to)] == kinds[point] or chr(point) in " \t\n\v\f\r"
        self.seen: dict[bytes, bytes] = {}
        normal = self.library.normalizer.normalize_str if self.library.normalizer else str
        self.lowers = all(normal(chr(c)) == chr(c + 32) for c in range(65, 91))
        self.added = [a.content.encode() for a in self.library.get_added_tokens_decoder().values()]
        self._probe()

    def _probe(self) -> None:
        """Refuse a file for which cutting as starts() does changes the ids."""
        parts = ["ab", "Ab", "the", "12", "3", "!", "?!", "-", "é", "'s", "'", " ", "\n", "  ", "\t", "naïve", "ÀB", "_", "½", *(a.decode() for a in self.added)]
        texts = [a + b + c for a in parts for b in parts for c in ("", "x", " x", "1", "!")]
        raw, bounds = texts_of(pa.array(texts))
        ids, ends = self.encode(raw, bounds)
        whole = self.library.encode_batch(texts, add_special_tokens=False)
        if any(any(x.isspace() for x in a.decode()) for a in self.added) or any(w.ids != ids[a:b].tolist() for w, a, b in zip(whole, ends, ends[1:])):
            raise ValueError("this tokenizers file does not encode words one by one")

    def starts(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(raw)
        if not n:
            return np.zeros(1, np.int64)
        kind = byte_classes(raw)
        blank = (raw == 32) | (raw >= 9) & (raw <= 13)
        plain = self.plain[:128][np.minimum(raw, 127)] & (raw < 128)
        lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xC9))  # two bytes, under U+0250
        lead = lead[lead + 1 < n]
        point = (raw[lead].astype(np.int64) & 0x1F) << 6 | raw[lead + 1] & 0x3F
        good = self.plain[point]
        plain[lead[good]] = plain[lead[good] + 1] = True
        plain &= raw != 39
        for token in self.added:
            two = np.flatnonzero((raw[:-1] == token[0]) & (raw[1:] == token[1])) if len(token) > 1 else np.flatnonzero(raw == token[0])
            plain[two] = False
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        word = edge.copy()
        word[1:n] |= blank[1:] != blank[:-1]
        begin = np.flatnonzero(word)
        rough = np.add.reduceat(~plain, begin[:-1]) > 0
        free = np.repeat(~rough, np.diff(begin))
        cut = word
        cut[1:n] |= (kind[1:] != kind[:-1]) & free[1:] & free[:-1]
        return np.flatnonzero(cut)

    def learn(self, pieces: list[bytes]) -> None:
        """Have the library encode the pieces not seen yet; plain words go many at a time."""
        new = [p for p in pieces if p not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = pieces
        words, rest = [], []
        for p in new:
            text = p.decode("utf-8", "replace")
            (words if text.isalpha() and len(text) < 200 and all(map(self.plain.__getitem__, map(ord, text))) else rest).append((p, text))
        for k in range(0, len(words), 128):
            group = words[k : k + 128]
            found = self.library.encode(" ".join(t for _, t in group), add_special_tokens=False)
            of = found.word_ids
            ids = np.array(found.ids, np.uint32)
            where = np.flatnonzero(np.diff(of, prepend=-1, append=-2))
            if len(where) != len(group) + 1:
                rest += group
                continue
            for (p, _), a, b in zip(group, where.tolist(), where[1:].tolist()):
                self.seen[p] = ids[a:b].tobytes()
        for k in range(0, len(rest), 256):
            group = rest[k : k + 256]
            for (p, _), found in zip(group, self.library.encode_batch([t for _, t in group], add_special_tokens=False)):
                self.seen[p] = np.array(found.ids, np.uint32).tobytes()

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 offsets."""
        starts = self.starts(raw, bounds)
        if self.lowers and not any(t[:2] in raw.tobytes() for t in self.added):  # added tokens are looked for before that
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        at, pieces = distinct_pieces(raw, starts)
        self.learn(pieces)
        packed = [self.seen[p] for p in pieces]
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        flat = np.frombuffer(b"".join(packed), np.uint32)
        per_piece = lengths[at]
        return flat[spread((np.cumsum(lengths) - lengths)[at], per_piece)], np.concatenate([[0], np.cumsum(per_piece)])[np.searchsorted(starts, bounds)]


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _put(folder: str, name: str, parts) -> None:
    """Write one file whole: under another name first, so that a task that is lost leaves no half file."""
    store, path = file_store(folder)
    context = TaskContext.get()
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{context.taskAttemptId() if context else 'driver'}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, f"{path}/{name}")


def _spans(folder: str, name: str):
    """A function for bytes [a, b) of a file: from a memory map where the folder is a mounted one, else read as they are asked for."""
    store, path = file_store(folder)
    if isinstance(store, pafs.LocalFileSystem):
        whole = _map(folder, name)
        return lambda a, b: whole[a:b]
    file = store.open_input_file(f"{path}/{name}")
    return lambda a, b: np.frombuffer(file.read_at(b - a, a), np.uint8)


def _map(folder: str, name: str) -> np.ndarray:
    """Bytes of a file: a memory map where the folder is a mounted one, else read whole."""
    store, path = file_store(folder)
    if isinstance(store, pafs.LocalFileSystem):
        size = store.get_file_info(f"{path}/{name}").size
        return np.memmap(f"{path}/{name}", np.uint8, "r") if size else np.zeros(0, np.uint8)
    with store.open_input_file(f"{path}/{name}") as file:
        return np.frombuffer(file.read(), np.uint8)


def write_token_files(df: DataFrame, path: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> str:
    """Encode the texts of ``df`` with the tokenizers file at ``path`` and write them to ``folder``; returns the folder.

    Documents lie in ascending order of ``key``, null first, repeated ids in order of their text; each ends with
    ``end_id``. A null or empty text is just that. An empty table gives a manifest without partitions. Rows are dealt by
    ranges of (key, text), so a key that is repeated does not gather in one task. The key has to be of an integer type,
    as the files hold 64-bit ones. Each task streams its texts to its own file. Only one row of counts a partition comes to the driver.
    """
    spark = df.sparkSession
    vocabulary_size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    kind = "<u2" if max(vocabulary_size - 1, end_id) < 1 << 16 else "<u4"
    rows = df.select(integer_key(df, key).alias("__key"), F.col(text).alias("__text"))
    ranged = rows.repartitionByRange("__key", F.xxhash64("__text")).sortWithinPartitions("__key", "__text")

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = encoder(path), TaskContext.get().partitionId()
        keys, nulls, counts = [], [], []

        def stream():
            for batch in slices(batches, "__text"):
                ids, bounds = model.encode(*texts_of(batch.column("__text")))
                n = np.diff(bounds)
                out = np.full(len(ids) + len(n), end_id, kind)
                out[spread(bounds[:-1] + np.arange(len(n)), n)] = ids
                keys.append(batch.column("__key").fill_null(0).to_numpy())
                nulls.append(batch.column("__key").is_null().to_numpy(zero_copy_only=False))
                counts.append(n + 1)
                yield out.tobytes()

        name = f"{part:06d}"
        _put(folder, f"ids-{name}.bin", stream())
        if not keys:
            return
        n = np.concatenate(counts)
        _put(folder, f"docs-{name}.bin", [np.concatenate(keys).astype("<i8").tobytes(), np.concatenate(nulls).astype("u1").tobytes()])
        _put(folder, f"lengths-{name}.bin", [n.astype("<u8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(n)]), pa.array([int(n.sum())])], ["part", "docs", "ids"])

    totals = sorted(tuple(r) for r in ranged.mapInArrow(write_part, "part long, docs long, ids long").collect())
    bases = np.concatenate([[0], np.cumsum([t[2] for t in totals])]).astype(int).tolist()
    parts = [{"part": p, "docs": d, "ids": i, "base": b} for (p, d, i), b in zip(totals, bases)]

    def write_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                lengths = _map(folder, f"lengths-{p:06d}.bin").view("<u8")
                _put(folder, f"offsets-{p:06d}.bin", [(np.uint64(base) + np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")).tobytes()])
        return iter(())

    if parts:
        spread_out = spark.createDataFrame([(p["part"], p["base"]) for p in parts], "part long, base long").repartition(min(len(parts), 512))
        spread_out.mapInArrow(write_offsets, "part long").collect()
    _put(folder, "manifest.json", [json.dumps({"dtype": kind, "end_id": end_id, "parts": parts}).encode()])
    return folder


def manifest(folder: str) -> dict:
    return json.loads(bytes(_map(folder, "manifest.json")))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, ids) of the files in ``folder``: one a document, ids an array; start counts over all files."""
    return _read(spark, folder, "doc_id long, start long, ids array<long>", lambda start, ids, ends: [pa.array(start), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int64)))])


def read_token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the files, the check sum over ids as 32-bit integers."""
    import zlib

    def digests(start, ids, ends):
        raw = memoryview(ids.astype("<u4").tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return [pa.array(start), pa.array(np.diff(ends)), pa.array(sums, pa.int64())]

    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", digests)


def _read(spark: SparkSession, folder: str, schema: str, columns) -> DataFrame:
    spec = manifest(folder)
    names = [c.split()[0] for c in schema.split(", ")]

    def read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("part").to_pylist():
                name = f"{p:06d}.bin"
                offsets = _map(folder, f"offsets-{name}").view("<u8").astype(np.int64)
                ids, docs, wide = _spans(folder, f"ids-{name}"), _map(folder, f"docs-{name}"), np.dtype(spec["dtype"]).itemsize
                n = len(offsets) - 1
                keys, null = docs[: 8 * n].view("<i8"), docs[8 * n :].astype(bool)
                group = (offsets[:-1] - offsets[0]) >> 20  # about a million ids at a time
                for a, b in _runs(group):
                    ends = offsets[a : b + 1] - offsets[0]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], mask=null[a:b]), *columns(offsets[a:b], ids(wide * int(ends[0]), wide * int(ends[-1])).view(spec["dtype"]), ends - ends[0])], names)

    parts = [(p["part"],) for p in spec["parts"]]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(parts, "part long").repartition(min(len(parts), 512)).mapInArrow(read_parts, schema)


def _runs(group: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
    return zip(cuts, cuts[1:])
