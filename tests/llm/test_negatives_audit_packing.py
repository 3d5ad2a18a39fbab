"""Hard negatives, the filter audit and packing against brute force."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfolio.llm import audit, negatives, packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def brute_negatives(rows, is_anchor, positives=5, count=10):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int), label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, label in good:
        if not is_anchor(i):
            continue
        scored = sorted((-int(v @ w), j, m) for j, w, m in good if j != i and len(w) == len(v))
        for s, j in [(-s, j) for s, j, m in scored if m == label][:positives]:
            hard = [(-n, k) for n, k, m in scored if m != label and 30 * s <= -100 * n <= 90 * s][:count]
            out += [(i, j, r + 1, k, s, n) for r, (n, k) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("block", [negatives.BLOCK, 40])
def test_hard_negatives_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)  # so that leaves are split
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + 0.6 * rng.normal(size=8)).astype(np.float32).astype(float).tolist(), int(rng.integers(3))) for k in range(900)]
    rows += [(1000 + k, rows[5][1], k % 3) for k in range(300)]  # a large group of copies
    rows += [(7, rows[8][1], 1), (100, rows[9][1], 0), (100, rows[9][1], 0), (2000, [0.0] * 8, 1), (2100, [float(x) for x in range(4)], 0)]
    rows += [(2200 + k, rng.normal(size=4).tolist(), k % 2) for k in range(30)]
    rows += [(None, rows[1][1], 0), (3000, None, 0), (3001, rows[1][1], None), (3002, [None] * 8, 0), (3003, [float("inf")] * 8, 0), (3004, [], 0), (3100, [float("nan")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5).withColumn("number", F.lit("x")).withColumn("leaf", F.lit("y")).withColumn("v", F.lit(1))
    found = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, lambda i: i % 100 == 0)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_very_long_vectors(spark):
    """Products beyond 2^53 are exact; vectors whose scores might not fit into a long take no part."""
    rows = [(k, [2.0**19 - k, 3.0 + k / 256], k % 2) for k in range(9)] + [(50, [1e300, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = negatives.hard_negatives(df, F.col("vec_id") == 0, window=(30, 100)).collect()
    step = lambda k: [int(256 * (2**19 - k)), 768 + k]
    product = lambda a, b: sum(x * y for x, y in zip(step(a), step(b)))
    assert {r["positive_id"]: r["positive_score"] for r in found} == {k: product(0, k) for k in (2, 4, 6)}
    assert {r["negative_id"]: r["negative_score"] for r in found if r["positive_id"] == 2} == {k: product(0, k) for k in (3, 5, 7)}


def test_ranges_leave_most_of_clustered_vectors_out():
    rng = np.random.default_rng(6)
    centres = 4 * rng.normal(size=(200, 12))
    rows = np.floor(256 * (centres[rng.integers(200, size=20_000)] + 0.3 * rng.normal(size=(20_000, 12))))
    ids, labels = np.arange(20_000), rng.integers(5, size=20_000)
    longest = float((rows**2).sum(1).max())
    block = negatives.Block(ids, labels, rows, longest)
    asked = np.arange(0, 20_000, 400)
    scores = (rows[asked] @ rows.T).astype(np.int64)
    low, high = np.full(len(asked), -(1 << 60)), np.full(len(asked), 1 << 60)
    query, score, number = block.search(ids[asked], labels[asked], rows[asked], low, high, 5, True)
    for q, a in enumerate(asked):
        best = sorted((-scores[q, j], j) for j in np.flatnonzero((labels == labels[a]) & (ids != a)))[:5]
        assert list(zip((-score[query == q]).tolist(), number[query == q].tolist())) == best
    assert block.compared < 0.5 * len(asked) * len(rows)
    index = negatives.Index(ids[:4000], labels[:4000], rows[:4000], 20_000, int(longest))
    index.tree.place(negatives.lifted(rows, index.longest), True)
    bound = index.bounds(ids[asked], labels[asked], rows[asked], low, high, 5, True)
    assert (bound <= np.sort(np.where((labels == labels[asked, None]) & (ids != asked[:, None]), scores, -(1 << 60)), 1)[:, -5]).all()
    inner, outer = negatives.annulus((rows[asked] ** 2).sum(1), index.longest, bound, high)
    sent = sum(len(who) for _, who in index.tree.visits(np.pad(rows[asked], ((0, 0), (0, 1))), inner, outer, negatives.SLACK * longest**0.5))
    assert sent < 0.8 * len(asked) * len(index.tree.leaves)


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("window,same_hash", [(audit.WINDOW, False), (64, False), (64, True)])
def test_transducer(monkeypatch, window, same_hash):
    monkeypatch.setattr(audit, "WINDOW", window)
    if same_hash:  # words are told apart by their bytes alone
        monkeypatch.setattr(audit, "_hashes", lambda raw, starts, lengths, owner: np.full(len(starts), 7, np.uint64))
    rng = random.Random(window)
    signs = "aAbZé漢😀#$|&. \t\n\x0b\x1c\x85\xa0 \0"
    texts = [None, "", "  ", "a", " a", "a " * 90, "x" * 500, " ", "same same Same"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    found = audit.measure(pa.array(texts))
    for k, text in enumerate(t or "" for t in texts):
        words = WORDS.findall(text)
        wanted = (len(words), len(set(words)), len(text), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text)))
        assert tuple(int(found[c][k]) for c in ("words", "distinct_words", "code_points", "capitals", "signs")) == wanted


def brute_audit(rows, labels):
    fails = []
    for key, text, part in rows:
        text = text or ""
        words = WORDS.findall(text)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        f += "E" * any(k is not None and key is not None and k < key and (t or "") == text for k, t, _ in rows)
        fails.append((part or "", f, any(k == key and key is not None and q == 1 for k, q, _ in labels), any(k == key and key is not None and t == 1 for k, _, t in labels)))
    out = []
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        removed = {}
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order):
                gone = lambda x: any(e in x for e in order[:s])  # noqa: E731, B023
                here = [x for x in mine if f in x[0] and not gone(x[0])]
                removed[f] = removed.get(f, 0) + len(here)
                kept = sum(not any(e in x[0] for e in order[: s + 1]) for x in mine)
                lines.append((part, order, s + 1, kept, len(here), sum(f in x[0] and gone(x[0]) for x in mine), sum(x[0] == f for x in mine), sum(x[1] for x in here), sum(x[2] for x in here)))
        out += [(*line, removed[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(2)
    long = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, n)) for _ in range(210))
    texts = [long(5), long(900), long(900) + " $", "UPPER CASE", "", None, long(900).upper(), "short #"]
    rows = [(k, texts[rng.randrange(len(texts))], rng.choice(["a", "b", "", None])) for k in range(60)]
    rows += [(None, texts[0], "a"), (None, None, None), (5, texts[1], "a"), (5, texts[1], "a"), (5, texts[1], "b"), (-1, texts[2], "c")]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(0, 60, 2)] + [(None, 1, 1), (4, 1, None), (4, None, 1), (5, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumn("bits", F.lit("x")).withColumn("good", F.lit("y"))
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("key", F.lit("z"))
    assert sorted(tuple(r) for r in audit.audit(df, flags).collect()) == brute_audit(rows, labels)
    assert audit.audit(df.limit(0), flags).count() == 0
    assert audit.audit(df, flags.limit(0)).count() == len({p or "" for *_, p in rows}) * 600


def checked(pieces, examples, tokens, segments, loss):
    """Every id lies in one piece, no sequence is over a limit, and each is full or a power of two long."""
    by_sequence, by_key = {}, {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_key.setdefault(r[0], []).append(r)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1]]
        total = sum(r["length"] for r in rows)
        assert total <= tokens and (total == tokens or total & total - 1 == 0)
        assert len(rows) <= segments and sum(r["loss_tokens"] for r in rows) <= (loss or tokens)
    assert set(by_key) == {k for k, ids, _ in examples if len(ids)}
    for key, ids, flags in examples:
        rows = sorted(by_key.get(key, []), key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1].tolist()][: len(rows)]
        assert sum(r["length"] for r in rows) == len(ids)
        for r in rows:
            part = slice(r["start"], r["start"] + r["length"])
            assert r["length"] > 0 and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[part], "<u4").tobytes())
            assert r["loss_tokens"] == (r["length"] if flags is None else sum(map(bool, flags[part])))
    return by_sequence


def test_pack_texts(spark):
    rng = random.Random(3)
    texts = ["word number " * rng.randint(0, 300) for _ in range(200)] + [None, "", "a long text goes on and on " * 4000, "é 漢字 <|endoftext|>"] + ["a"] * 700
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).withColumn("start", F.lit("x")).withColumn("key", F.lit("y"))
    library = Tokenizer.from_file(WORD)
    examples = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 2], None) for k, t in enumerate(texts)]
    for tokens, segments, loss in ((4096, 256, None), (512, 8, None), (100, 3, 40), (1, 1, 1)):
        some = df.filter("doc_id % 9 = 0") if tokens == 1 else df
        found = packing.pack_texts(some, WORD, tokens=tokens, segments=segments, loss=loss).collect()
        checked(found, [e for e in examples if tokens > 1 or e[0] % 9 == 0], tokens, segments, loss)
    assert packing.pack_texts(df.limit(0), WORD).count() == 0
    with pytest.raises(Exception, match="positive"):
        packing.pack_texts(df, WORD, tokens=0).count()


def test_pack_examples_under_three_limits(spark):
    """Instruction data: short answers after long questions, so that each of the limits binds somewhere."""
    rng = random.Random(5)
    examples = []
    for k in range(600):
        asked, said = rng.choice([(5, 3), (200, 20), (10, 150), (0, 1), (900, 0)])
        examples.append((f"e{k}", [rng.randrange(50_000) for _ in range(asked + said)], [False] * asked + [True] * said))
    examples += [("none", [], []), ("all", [7] * 40, None)]
    df = spark.createDataFrame(examples, "example_id string, ids array<int>, loss_mask array<boolean>").repartition(2)
    found = packing.pack_examples(df, tokens=1024, segments=12, loss=200).collect()
    sequences = checked(found, examples, 1024, 12, 200)
    full = [rows for rows in sequences.values() if sum(r["length"] for r in rows) == 1024]
    assert len(full) > 0.3 * len(sequences)
    bound = [rows for rows in sequences.values() if sum(r["loss_tokens"] for r in rows) == 200]
    assert bound and any(len(rows) == 12 for rows in sequences.values())


def test_the_dot_product_chooses():
    """With much room for loss left and little for tokens, the answer-heavy example goes first."""
    out = []
    packer = packing.Packer(lambda *x: out.append(x), tokens=100, segments=10, loss=50)
    for key, n, bears in (("plain", 60, 0), ("heavy", 58, 50), ("small", 40, 0)):
        packer.add(packing.Example(key, np.zeros(n, np.uint32), np.arange(n) < bears))
    packer.finish()
    assert [x[2].key for x in out[:2]] == ["heavy", "small"] and out[1][4] == 40
