"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfolio.llm import bpe, bytelevel, lang_id, mixing, quality, shared, simhash, token_counts, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "1", "22", "!", "é", "É", " ", "　", "漢", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "the", "THE", "́", "ß", "\x1c", "\x85", "½", "_", " 's", "\r\n", "aaaa", "=====", "İ", "=", "̸", "ŉ", "Å", "%%%", "Ǆ", "՘"]


def odd_texts(n=1500, seed=3):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*texts, None, "", "a" * 20_000, "abc" * 9_000, " " * 5_000, "ab'c " * 3_000, "same", "same"]


def documents(spark, texts, **more):
    rows = [(k, t, "en", "s", *more.values()) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *(f"{c} string" for c in more)]))


def test_character_classes_are_the_librarys():
    split = Tokenizer.from_file(BYTE).pre_tokenizer.pre_tokenize_str
    found = bytelevel.character_classes()
    for point in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000, 3), *range(0x2FA00, 0x32400, 7), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= point < 0xE000:
            continue
        kind = next((k for k, of in ((1, "a"), (2, "1"), (0, "!")) if len(split(of + chr(point))) == 1), 3)
        assert found[point] == kind, hex(point)


def test_bpe_and_counts_equal_the_library(spark):
    texts = odd_texts()
    library = Tokenizer.from_file(BYTE)
    docs = documents(spark, texts, ids="x", decoded="x", n_tokens="x", over_limit="y")
    coded = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    counts = token_counts.token_counts(docs, BYTE, limit=20)
    assert counts.columns == ["doc_id", "lang", "source", "ids", "decoded", "n_bytes", "n_tokens", "over_limit"]
    ids = {r["doc_id"]: r for r in coded.collect()}
    numbers = {r["doc_id"]: r for r in counts.collect()}
    assert len(ids) == len(numbers) == len(texts)
    for k, t in enumerate(texts):
        wanted = library.encode(t or "", add_special_tokens=False).ids
        assert ids[k]["ids"] == wanted, repr(t)
        assert ids[k]["decoded"] == library.decode(wanted, skip_special_tokens=False)
        assert (numbers[k]["n_bytes"], numbers[k]["n_tokens"], numbers[k]["over_limit"]) == (len((t or "").encode()), len(wanted), len(wanted) > 20)


def test_decode_survives_any_ids(spark):
    library = Tokenizer.from_file(BYTE)
    rows = [(0, [160, 50256, 15]), (1, None), (2, []), (3, [99999, -1]), (4, [None, 15]), (5, list(range(0, 50257, 97)))]
    out = {r["k"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), BYTE).collect()}
    assert [out[k] for k in (1, 2, 3)] == ["", "", ""] and out[4] == library.decode([15])
    assert out[0] == library.decode([160, 50256, 15], skip_special_tokens=False)
    assert out[5] == library.decode(rows[5][1], skip_special_tokens=False)


def test_whole_tokens_are_proved():
    words = bytelevel.vocabulary(BYTE)
    model = bpe.encoder(BYTE)
    assert set(token_counts.whole_token_ids(BYTE)) == set(model.whole.values())
    rng = random.Random(5)
    for _ in range(3000):
        a, b = rng.choice(list(model.whole.items())), rng.choice(list(model.whole.items()))
        assert model.compatible(a[1], b[1]) == (words.merged(a[0] + b[0]) == [a[1], b[1]])


def test_token_files_round_trip(spark):
    texts = odd_texts(700, 4)
    rows = [(k * 7 % 709 - 5, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(5)
    folder = token_files.write_token_files(df, WORD, shared.new_folder(spark, "tokens"))
    library = Tokenizer.from_file(WORD)
    found = sorted(token_files.read_token_digests(spark, folder).collect(), key=lambda r: r["start"])
    arrays = {r["start"]: r["ids"] for r in token_files.read_token_files(spark, folder).collect()}
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r["doc_id"] for r in found] == [r[0] for r in wanted]
    start = 0
    for r, (_, text) in zip(found, wanted):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(text)
        assert arrays[start] == ids
        start += len(ids)
    assert token_files.manifest(folder)["dtype"] == "<u2"


def test_token_files_of_an_empty_table(spark):
    folder = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), WORD, shared.new_folder(spark, "tokens"))
    assert token_files.read_token_digests(spark, folder).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(25)]
    texts = [None, "", "One", "one", "one two", " ", "x " * 4000]
    for b in base:
        texts.append(b)
        for _ in range(rng.randint(0, 8)):
            w = b.split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    df = documents(spark, texts, fingerprint="x", component_id="y").union(documents(spark, texts[-3:], fingerprint="x", component_id="y"))
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(texts) + 3
    prints = defaultdict(set)
    for k, t in [*enumerate(texts), *enumerate(texts[-3:])]:
        prints[k].add(brute_fingerprint(t))
    assert all(int(r["fingerprint"], 16) in prints[r["doc_id"]] for r in found)
    pairs = [(a, b) for a in prints for b in prints if a < b and any((x ^ y).bit_count() <= 2 for x in prints[a] for y in prints[b])]
    wanted = components(prints, pairs)
    single = {k for k in prints if len(prints[k]) == 1}
    touched = {wanted[k] for k in prints if k not in single}
    for r in found:
        if wanted[r["doc_id"]] not in touched:
            assert r["component_id"] == wanted[r["doc_id"]]
    assert any(r["component_id"] != r["doc_id"] for r in found)


@pytest.mark.parametrize("n,spread", [(3, 3), (9, 3), (600, 4), (6000, 14)])
def test_gray_index_finds_all_links(n, spread):
    rng = np.random.default_rng(n)
    centre = rng.integers(1 << 63, dtype=np.uint64)
    codes = {int(centre)}
    while len(codes) < n:
        code = int(rng.choice(list(codes)[-20:]))
        for b in rng.integers(64, size=rng.integers(1, spread)):
            code ^= 1 << int(b)
        codes.add(code)
    codes = np.array(sorted(codes), np.uint64)
    values, roots = simhash.group_roots(codes)
    parent = components(range(n), [(i, int(j)) for i in range(n) for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= 2) + i + 1])
    assert (roots == codes[[parent[i] for i in range(n)]]).all()


def test_index_searches_all_shards(spark):
    """Random fingerprints with planted neighbours, in many shards: the links' components are those of brute force."""
    rng = np.random.default_rng(11)
    base = rng.integers(1 << 63, size=60_000, dtype=np.uint64) * np.uint64(2) + rng.integers(2, size=60_000, dtype=np.uint64)
    flips = rng.integers(64, size=(8_000, 2)).astype(np.uint64)
    planted = base[:8_000] ^ (np.uint64(1) << flips[:, 0]) ^ (np.uint64(1) << flips[:, 1])
    codes = np.unique(np.concatenate([base, planted, planted[:3_000] ^ np.uint64(1 << 40), np.array([0, 1, 1 << 63, 3 << 62], np.uint64)]))
    singles = [1 << k for k in range(64)]
    where = {int(c): k for k, c in enumerate(codes)}
    links = []
    for c, k in where.items():
        for i, x in enumerate(singles):
            links += [(k, where[c ^ m]) for m in (x, *(x | y for y in singles[i + 1 :])) if (c ^ m) in where]
    wanted = components(range(len(codes)), links)
    df = spark.createDataFrame([(c,) for c in codes.view(np.int64).tolist()], "__fp long").repartition(6)
    edges = simhash.links(df)
    found = {r["node"]: r["component"] for r in shared.connected_components(edges).collect()}
    signed = codes.view(np.int64).tolist()
    least = {}
    for k, c in enumerate(signed):
        least[wanted[k]] = min(least.get(wanted[k], c), c)
    assert all(found.get(c, c) == least[wanted[k]] for k, c in enumerate(signed))
    assert len(found) > 15_000
    # the index reads a small part of what comparing all with all would
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    index = simhash.GrayIndex.of_codes(ordered)
    hits = sum(len(node) for _, node in index.within(ordered[::50]))
    assert hits >= len(ordered[::50]) and 0 < index.visits < 0.1 * len(ordered) * len(ordered[::50])


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    found = simhash.near_duplicates(spark.createDataFrame([(None, "a"), (None, None), (5, None)], schema)).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in found if r["fingerprint"] == "0" * 16) == [(False, 5), (True, 5)]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1001 + k) for k in range(500)]
    out = {r["node"]: r["component"] for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(61)) and all(out[1001 + k] == 1000 for k in range(500)) and out[1000] == 1000


def brute_bits(model, text):
    """Code length by walking the contexts of the model's counts one byte at a time."""
    languages, counts = model.parts
    table = {}
    for lang, size, code, n in zip(*(counts[c].tolist() for c in ("lang", "size", "code", "n"))):
        raw = code.to_bytes(size, "big")
        table.setdefault((lang, raw[:-1]), {})[raw[-1]] = n

    def chance(lang, context, byte):
        below = (lambda b: chance(lang, context[1:], b)) if context else (lambda b: 1 / 256)
        seen = table.get((lang, context))
        if not seen:
            return below(byte)
        mass, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (mass + kinds)
        free = 1 - sum(below(b) for b in seen)
        return kinds / (mass + kinds) * min(below(byte) / max(free, 1e-12), 1)

    raw = b"\n\n\n" + text.encode()
    return [sum(-math.log2(chance(k, raw[i - 3 : i], raw[i])) for i in range(3, len(raw))) for k in range(len(languages))]


def brute_plain(model, text):
    """Code length in each language without contexts: seen bytes by their counts, the others share what escapes."""
    languages, counts = model.parts
    seen = [{} for _ in languages]
    for lang, size, code, n in zip(*(counts[c].tolist() for c in ("lang", "size", "code", "n"))):
        if size == 1:
            seen[lang][code] = n
    chance = lambda own, b: own.get(b, len(own) / (256 - len(own))) / (sum(own.values()) + len(own))
    return [-sum(math.log2(chance(own, b)) for b in text.encode()) for own in seen]


def test_language_id_code_lengths_and_rules(spark):
    rng = random.Random(2)
    words = {"en": ["the", "and", "thing", "with"], "fr": ["été", "le", "dans", "que"], "de": ["über", "und", "nicht", "ein"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "s") for k, lang in enumerate(["en", "fr", "de"] * 60)]
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, "123 !?", "fr", "s"), (503, "été été", None, "s"), (504, "the " * 60_000, None, None), (None, "und nicht", "de", "s"), (505, "漢字", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9))
    model = lang_id.train(docs)
    sample = ["the été und", "nicht with que", "zzz"]
    bits = model.model().code_lengths(*shared.texts_of(pa.array(sample)))
    for text, mine in zip(sample, bits):
        assert mine == pytest.approx(brute_bits(model, text), rel=1e-5)
    found = lang_id.predict(docs, model).collect()
    assert len(found) == len(rows)
    out = {r["doc_id"]: r for r in found}
    assert all(out[k]["lang_pred"] == lang for k, _, lang, _ in rows[:180])
    assert [out[k]["lang_pred"] for k in (500, 501, 502, 503, 504, None)] == ["und", "und", "und", "fr", "en", "de"]
    assert out[500]["score"] == 0 and all(0 <= r["score"] <= 1 for r in found) and out[505]["lang_pred"] in words
    for k, text in [(503, "été été"), (505, "漢字"), *((k, text) for k, text, _, _ in rows[:6])]:
        bits = brute_bits(model, text)
        best = bits.index(min(bits))
        assert out[k]["gain"] == pytest.approx((brute_plain(model, text)[best] - bits[best]) / len(text.encode()), abs=1e-4)
    assert [out[k]["gain"] for k in (500, 501, 502)] == [0, 0, 0]


def test_language_id_learns_all_languages(spark):
    rng = random.Random(5)
    free = iter(k for k in range(100_000) if zlib.crc32(str(k).encode()) % 3 != 1)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñø") for _ in range(6)) for _ in range(8)] for k in range(70)}
    rows = [(next(free), " ".join(rng.choice(words[lang]) for _ in range(60)), lang, "s") for k, lang in enumerate(words) for _ in range(3 if k % 10 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    model = lang_id.train(docs)
    tables = [model, *model.others]
    assert [x for t in tables for x in t.parts[0]] == sorted(words)
    found = {r["doc_id"]: r for r in lang_id.predict(docs, model).collect()}
    assert [found[k]["lang_pred"] for k, _, _, _ in rows] == [lang for _, _, lang, _ in rows]
    assert all(0.99 < r["score"] <= 1 for r in found.values())
    bits = np.concatenate([t.model().code_lengths(*shared.texts_of(pa.array([rows[0][1]])))[0] for t in tables])
    assert found[rows[0][0]]["score"] == pytest.approx(1 / np.exp2(bits.min() - bits).sum())


def test_language_id_bounds_counts_by_language(spark):
    rng = random.Random(6)
    free = iter(k for k in range(100_000) if zlib.crc32(str(k).encode()) % 3 != 1)
    texts = [("many", "".join(rng.choice("abcdefghij ") for _ in range(2000))) for _ in range(60)] + [("rare", "tuvw xyz tuv wxyz")]
    docs = spark.createDataFrame([(next(free), t, lang) for lang, t in texts], "doc_id long, text string, lang string")
    whole, cut = lang_id.train(docs), lang_id.train(docs, max_counts=1000)
    rare = lambda m: int((m.parts[1]["lang"] == 1).sum())
    assert rare(cut) == rare(whole) > 10
    many = lambda m: int((m.parts[1]["lang"] == 0).sum())
    assert many(cut) <= 1000 < many(whole)


def test_a_language_does_not_depend_on_the_others(spark):
    """The same code lengths with 3, 4, 5 and 20 languages, and with small bounds."""
    rng = random.Random(8)
    free = iter(k for k in range(1_000_000) if zlib.crc32(str(k).encode()) % 3 != 1)
    signs = [rng.sample("abcdefghijklmnopqrstuvwxyzéüñ ", 20) for _ in range(20)]
    rows = [(next(free), "".join(rng.choice(signs[k]) for _ in range(400)), f"l{k:02}") for k in range(20) for _ in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").persist()
    raw, bounds = shared.texts_of(pa.array([r[1] for r in rows[:30]]))
    for bounds_of in ({}, {"contexts": 30, "max_counts": 200}):
        seen = []
        for n in (3, 4, 5, 20):
            frozen = lang_id.train(docs.filter(F.col("lang") < f"l{n:02}"), **bounds_of)
            assert sum(len(t.parts[0]) for t in (frozen, *frozen.others)) == n
            seen.append(lang_id.ContextModel(*frozen.parts).code_lengths(raw, bounds)[:, :3])
        for other in seen[1:]:
            assert np.allclose(seen[0], other, rtol=1e-6)


def test_language_id_learns_from_nothing_held_out(spark):
    held = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 3 == 1][:50]
    docs = spark.createDataFrame([(k, "the thing", "en") for k in held], "doc_id long, text string, lang string")
    assert docs.filter(lang_id.held_out()).count() == 50
    assert lang_id.train(docs) is None
    assert {r["lang_pred"] for r in lang_id.predict(docs, None).collect()} == {"und"}
    assert lang_id.predict(docs.limit(0), None).count() == 0


def rated(n=900, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        grade = rng.choice([0, 1, 2, 2, 2, 2])
        if grade == 1:
            w = [x + rng.choice(["%%%", "$$$"]) for x in w]
        if grade == 0:
            w[3] = rng.choice(["vile", "nasty"])
        rows.append((k, " ".join(w), grade))
    return rows


def test_quality_on_texts_not_learned_from(spark):
    rows = rated()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(9000, None), (9001, ""), (9002, "word " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(g == 2), int(g == 0)) for k, _, g in rows if k < 600] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.graded(labels))
    assert list(model.thresholds) == sorted(model.thresholds)
    found = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(found) == len(rows) + 3
    fresh = [(found[k], g) for k, _, g in rows if k >= 600]
    assert np.mean([r["selected"] for r, g in fresh if g == 2]) > 0.95
    assert np.mean([not r["selected"] for r, g in fresh if g < 2]) > 0.95
    grades = [np.mean([r["expected_grade"] for r, g in fresh if g == k]) for k in range(3)]
    assert grades == sorted(grades)
    assert quality.train(docs, quality.graded(labels).limit(0)) is None
    assert quality.score(docs, None).filter("selected").count() == len(rows) + 3


def brute_tails(model, text):
    """Probabilities of the grades from 1 on, piece by piece."""
    import regex

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    runs = regex.findall(r"\p{L}+|\p{N}+|\s+|[^\p{L}\p{N}\s]+", lower)
    dim = lambda raw: zlib.crc32(raw) & (1 << quality.BITS) - 1
    score = sum(model.weights[dim(piece.encode())] for piece in {r for r in runs if not r.isspace()})
    words = [r for r in runs if regex.match(r"\p{L}", r)]
    signs = sum(len(r.encode()) for r in runs if regex.match(r"[^\p{L}\p{N}\s]", r))
    shape = {
        "different": math.floor(10 * len(set(words)) / max(len(words), 1)),
        "signs": min(math.floor(20 * signs / max(len(lower.encode()), 1)), 10),
        "line": math.floor(math.log2(1 + len(words) / (1 + text.count("\n")))),
        "words": min(math.floor(math.log2(1 + len(words))), 6),
    }
    score += sum(model.weights[dim(b"\0%s %d" % (name.encode(), k))] for name, k in shape.items())
    return [1 / (1 + math.exp(t - score)) for t in model.thresholds]


def test_quality_equals_brute_force(spark):
    from sparkfolio.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert np.count_nonzero(model.weights) > 0
    found = queries.op8_quality(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        tails = brute_tails(model, texts[r["doc_id"]] or "")
        assert (r["expected_grade"], r["tail_probability"]) == pytest.approx((sum(tails), tails[1]), rel=1e-9)
        assert r["selected"] == (r["tail_probability"] >= 0.5)


def test_ordinal_gradient_is_right():
    """The fit reaches a point where no small step makes the data more likely."""
    rng = np.random.default_rng(0)
    docs = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(400)]
    slopes = np.array([2.0, -1.5, 1.0, 0, 0, 0.5])
    score = np.array([slopes[d].sum() for d in docs]) + rng.logistic(size=400)
    grades = np.digitize(score, [-0.5, 1.5])
    model = quality.fit(docs, grades, rounds=3000, rate=0.02, ridge=1e-4, least=-1, evenly=0)

    def likelihood(w, t):
        s = np.array([w[d].sum() for d in docs])
        cuts = np.concatenate([[-np.inf], t, [np.inf]])
        f = lambda x: 1 / (1 + np.exp(-x))
        with np.errstate(over="ignore"):
            return np.log(f(cuts[grades + 1] - s) - f(cuts[grades] - s)).mean() - 1e-4 / 2 * (w**2).sum()

    best = likelihood(model.weights, model.thresholds)
    for k in range(6):
        for step in (-0.1, 0.1):
            w = model.weights.copy()
            w[k] += step
            assert likelihood(w, model.thresholds) < best
    for k in range(2):
        for step in (-0.1, 0.1):
            t = model.thresholds.copy()
            t[k] += step
            assert likelihood(model.weights, t) < best


def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(300):
        unit = (low + high) / 2
        if sum(min(2 * sizes[s], weight[s] * unit) for s in names) < 1.5 * sum(sizes.values()):
            low = unit
        else:
            high = unit
    return {s: min(2 * sizes[s], weight[s] * low) for s in names}


def test_mixing(spark):
    rng = random.Random(6)
    rows = []
    for k in range(4000):
        source = rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])
        n = 40 if source == "a" and rng.random() < 0.6 else rng.choice([0, 1, 3, 30, 200, 1500])
        rows.append((k, None if n == 0 and rng.random() < 0.5 else "x\t" * n, source))
    rows += [(4001, "y z", "a"), (4001, "y z", "a"), (None, "null id", "b"), (4002, "", "only empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash")).withColumn("copies", F.lit(0))
    out = mixing.mix(docs)
    found = out.collect()
    assert len(found) == len(rows)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    source = {k: s for k, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    wanted = brute_targets(sizes)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(wanted[s])
        assert 0 <= r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= max(2, 0.002 * wanted[s]), s
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_counts_equal_rows(spark):
    """Rows equal in id and text, null ones too, are dealt out in pieces, and all come back."""
    same = spark.range(25_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("a").alias("source"))
    null = spark.range(11_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("a").alias("source"))
    rest = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("b").alias("source"))
    docs = same.union(null).union(rest)
    found = {tuple(r[:-1]): r["n"] for r in mixing.mix(docs).groupBy("doc_id", "size", "copies", "source_size").agg(F.count("*").alias("n")).collect()}
    assert found.pop((None, 0, 1, 75_000)) == 11_000
    by = lambda test: sum(n for k, n in found.items() if test(k))
    wanted = brute_targets({"a": 75_000, "b": 18_000})
    assert by(lambda k: k[1] == 3) == 25_000 and by(lambda k: k[1] == 2) == 9_000
    assert abs(sum(k[1] * k[2] * n for k, n in found.items() if k[1] == 3) - wanted["a"]) <= 3
    assert abs(sum(k[1] * k[2] * n for k, n in found.items() if k[1] == 2) - wanted["b"]) <= 2


def test_mixing_rates_solve_the_dual(spark):
    """Rates are tilted by size: logit(rate / 2) is a line through 0 in each source."""
    cells = spark.createDataFrame([(0, s, n) for s, n in ((1, 50), (10, 30), (100, 9), (400, 2))], "place int, size long, n long")
    total = 50 + 300 + 900 + 800
    for share in (0.3, 1.0, 1.7):
        tilt = mixing.solve_tilts(cells, {"a": share * total}, {"a": total}, {"a": 91})[0]
        rate = lambda s: 2 / (1 + math.exp(-tilt * s / (total / 91)))  # noqa: B023, E731
        assert sum(n * s * rate(s) for s, n in ((1, 50), (10, 30), (100, 9), (400, 2))) == pytest.approx(share * total, rel=1e-5)


def test_digest_columns(spark):
    from sparkfolio.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(BYTE)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op7_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
