"""Each operator against brute force on awkward rows: nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

from evidgraph.llm import decontam, html_extract, line_dedup, mixing, near_dup, pii, quality, sharding, suffix_dedup, warc
from evidgraph.llm.byte_windows import Windows, anchors
from evidgraph.llm.components import components
from evidgraph.llm.html_blocks import read_blocks

DOC = "doc_id long, text string, source string, size long, kept string, h string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [sentence(rng, 60) for _ in range(12)]
    near = [base[0].replace(base[0].split()[5], "changed", 1), base[0] + " tail", base[1].upper()]
    passage = sentence(rng, 70)
    out = [*base, *near, base[2], base[2], "", "   \n\t ", None, "one", "one two", "x" * 5000, sentence(rng, 9000)]
    out += [sentence(rng, 5) + "\n" + passage + "\n" + sentence(rng, 5) for _ in range(4)]
    out += [f"Menu \n{sentence(rng, 8)}\nmenu\t" for _ in range(11)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["a", "b", None, "c"][i % 4], 1, "k", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Null and repeated ids, whole rows twice."""
    return spark.createDataFrame([(None, texts[0], "a", 1, "k", "h"), (7, texts[0], None, 1, "k", "h"), (7, texts[0], None, 1, "k", "h"), (7, texts[1], "a", 1, "k", "h"), (None, None, None, None, None, None)], DOC)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, texts, width):
    want = brute.near_groups(list(enumerate(texts)), width)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, width=width).collect()}
    assert got == {d: (len(brute.shingles(texts[d], width)), c, c == d) for d, c in want.items()}


def test_near_duplicates_family(spark):
    """Variants near one original and far from each other; the original comes last."""
    rng = random.Random(12)
    first = [f"w{i}" for i in range(240)]
    texts = []
    for v in range(60):
        words = list(first)
        for k, at in enumerate(rng.sample(range(0, 238, 2), 10)):
            words[at] = f"v{v}x{k}"
        texts.append(" ".join(words))
    texts.append(" ".join(first))
    want = brute.near_groups(list(enumerate(texts)), 2)
    apart = brute.near_groups(list(enumerate(texts[:-1])), 2)
    assert set(want.values()) == {0} and len(set(apart.values())) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, width=2).collect()}
    assert got == want


def test_near_duplicates_blocks(spark, monkeypatch):
    """A bucket of many blocks links what one block links; chains of variants too."""
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for v in range(90):
        at = rng.randrange(0, 118)
        words = words[:at] + [f"v{v}"] + words[at + 1 :] if v % 9 else [f"x{v}"] * 3 + words[:100]
        texts.append(" ".join(words))
    want = brute.near_groups(list(enumerate(texts)), 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, width=2).collect()} == want


def test_near_duplicates_rows_of_a_large_group(spark, monkeypatch):
    """What is compared through has a row for each class, not for each bucket a
    class is in, and finds the links that no representative has."""
    rng, made, settle = random.Random(7), {}, near_dup.settle
    first = [f"w{i}" for i in range(200)]
    texts = []
    for v in range(120):
        words = list(first)
        for k in range(0, 8 if v < 100 else 16):
            words[rng.randrange(0, 200)] = f"v{v}x{k}"
        texts.append(" ".join(words))
    want = brute.near_groups(list(enumerate(texts)), 2)

    def counted(df, name):
        out = settle(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "settle", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, width=2).collect()} == want
    assert 0 < made["members"] <= len(texts) and 0 < made["through"]


def test_pipeline_rows_of_a_large_group(spark, monkeypatch):
    """The pipeline's stage compares five-word sets with a row for each class too."""
    import corpus_pipeline

    rng, made, settle = random.Random(9), {}, near_dup.settle
    texts = []
    for v in range(90):
        words = [f"w{i}" for i in range(200)]
        for k in range(2 + v % 3):
            words[rng.randrange(0, 200)] = f"v{v}x{k}"
        texts.append(" ".join(words))
    want = brute.near_groups(list(enumerate(texts)), 5)

    def counted(df, name):
        out = settle(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "settle", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got == {d for d, c in want.items() if d == c}
    assert 0 < made["members"] <= len(texts)


def test_least_hashes_of_long_sets():
    """Long sets: no pair at the threshold is lost, distant ones are not confirmed."""
    rng = np.random.default_rng(2)
    for share, may in ((0.9, True), (0.62, False)):
        pool = np.unique(rng.integers(0, 2**64, 9000, dtype=np.uint64))
        step = int(6000 * (1 - share) / (1 + share))
        x, y = pool[rng.permutation(len(pool))[:6000]], None
        y = np.concatenate([x[step:], np.setdiff1d(pool, x)[:step]])
        x, y = np.sort(x), np.sort(y)
        n, m = len(x), len(y)
        cut = [s[: near_dup.SKETCH].view(np.int64) for s in (x, y)]
        assert near_dup._alike(*cut, n, m, 80) == (False, may)
        assert near_dup._alike(x[:300].view(np.int64), x[:300].view(np.int64), 300, 300, 80) == (True, True)


def test_near_duplicates_odd(empty, odd):
    assert near_dup.near_duplicates(empty).count() == 0
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == 5 and all(r.kept for r in rows)
    assert {r.component_id for r in rows if r.doc_id is None} == {None}


def test_collision_rate():
    """Tensored keys meet as often as the formula says."""
    make, rng, met, n = near_dup.Sketcher(12, 4), np.random.default_rng(1), 0, 200
    for _ in range(n):
        pool = rng.integers(0, 2**63, 1000).astype(np.uint64)
        a, b = np.unique(pool[:900]), np.unique(pool[100:])  # similarity 0.8
        x, y = make.halves(a), make.halves(b)
        met += (x[:12] == y[:12]).any() and (x[12:] == y[12:]).any()
    assert met / n > 0.97


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 44


def test_repeats(docs, texts):
    want = brute.repeats(texts, 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(want))


def test_repeats_odd(empty, odd, texts):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    got = suffix_dedup.remove_repeats(odd).collect()
    assert sorted(r.n_bytes - r.n_removed for r in got) == sorted(a - b for a, b, _, _ in brute.repeats([texts[0]] * 3 + [texts[1], None], 200))


def test_repeats_random(spark):
    """Few letters and many shared pieces: windows that repeat by different partners."""
    rng = random.Random(8)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 320))) for _ in range(12)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute.repeats(texts, 200)))


def test_repeats_in_small_batches():
    """What a Python task gathers does not grow with its input batch."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef ") for _ in range(400_000)) for _ in range(40)]
    none = pa.array([None] * 40, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts), none, none], ["doc_id", "text", "s", "e"])
    cut = list(suffix_dedup._cut(200, 100)(iter([batch])))
    assert max(b.nbytes for b in cut) < 8_000_000
    assert [x for b in cut for x in b.column(5).to_pylist()] == [t.encode() for t in texts]
    found = list(suffix_dedup._find_anchors(200, 100)(iter([batch])))
    assert max(b.num_rows for b in found) < 200_000
    assert {x for b in found for x in b.column(0).to_pylist()} == set(range(40))


def test_anchor_kernel():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 6, 400).astype(np.uint64)
    want = sorted({p for s in range(400 - 20 + 1) for p in range(s, s + 20) if g[p] == g[s : s + 20].min()})
    assert anchors(g, 20).tolist() == want
    w = Windows(b"abcabcabc")
    h = w.hash(np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]


def test_lines(docs, texts, empty, odd):
    assert table(line_dedup.line_digests(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.lines(list(enumerate(texts)), 10), key=repr)
    assert line_dedup.line_digests(empty).count() == 0
    assert line_dedup.line_digests(odd, min_docs=2).count() == 5
    maps = line_dedup.line_keep_bitmaps(docs)
    assert {r.n_dropped for r in maps.collect()} == {2}
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs, maps).collect()}
    assert "\n" not in kept[len(texts) - 1] and kept[17 if texts[17] is None else texts.index(None)] is None


def test_line_runs_over_partitions(spark):
    """One very common line over many partitions, with edges between them."""
    df = spark.createDataFrame([(i, f"common\nrare {i % 30}\nown {i}") for i in range(300)], "doc_id long, text string").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.line_digests(df, 10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.n_dropped for r in got} == {2}


def test_shards(docs, texts, empty, odd):
    rows = sharding.shard(docs.select("doc_id", "text", "size", "kept"), 40).collect()
    for r in rows:
        assert (r.shard, r.grown_shard) == (brute.jump(r.doc_id, 40), brute.jump(r.doc_id, 41))
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == brute.crc(texts[r.doc_id])
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(empty).count() == 0
    assert sorted(r.slot for r in sharding.shard(odd, 1).collect()) == [0, 1, 2, 3, 4]


def test_jump_large_keys(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 1000):
        got = [r.j for r in df.select(sharding.jump_hash("k", n).alias("j"), "k").collect()]
        assert [(g.s, g.b) for g in got] == [(brute.jump(k, n), brute.jump(k, n + 1)) for k in keys]


def test_mix(docs, empty, odd, spark):
    plan = mixing.mix_plan(docs).collect()
    size, target, taken = {}, {}, {}
    for r in plan:
        size[r.source] = r.source_size
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    assert table(mixing.mix_plan(docs), "doc_id", "taken") == table(mixing.mix_plan(docs.repartition(5)), "doc_id", "taken")
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_plan(odd).count() == 5
    whole = mixing.mix(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.taken // r.size for r in plan if r.size)
    many = spark.createDataFrame([(i, sentence(random.Random(i), 20), "abc"[i % 3 if i % 5 else 0]) for i in range(600)], "doc_id long, text string, source string")
    got = {}
    for r in mixing.mix_plan(many).collect():
        got.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - b) <= 21 for a, b in got.values())


def test_source_targets(spark):
    df = spark.createDataFrame([("a", 100), ("b", 10), (None, 40), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got["c"] == 0 and abs(sum(got.values()) - 225) < 1e-9 and got["b"] <= 20 and got[None] <= 80
    rng = random.Random(4)
    for n in (1, 2, 5, 9):
        sizes = {**{chr(97 + i): rng.choice([0, 1, 10, 500, 9000]) for i in range(n - 1)}, None: rng.randint(1, 300)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(brute.targets(sizes))


@pytest.fixture(scope="module")
def items(spark, texts):
    rows = [(1, texts[3][20:150], "x"), (2, "one two", "x"), (3, texts[3][20:150], "x"), (None, texts[4], "x"), (5, None, "x"), (6, "", "x"), (2, "one two", "x"), (9, "x y " * 9, "x")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def test_decontaminate(docs, texts, items, empty, odd):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contaminated(list(enumerate(texts)), [(r.item_id, r.text) for r in items.collect()])
    assert table(decontam.contamination(docs, items), *cols) == sorted(want, key=repr)
    assert decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(odd, items).count() == 5
    assert not any(r.contaminated for r in decontam.contamination(docs, items.limit(0)).collect())


def test_decontaminate_long_repeats(spark):
    """200,000 equal words against an item of ten of them."""
    texts = ["a " * 200_000, "b " + "a " * 9 + "b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([("x", "a " * 10), ("y", "")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, items).collect()}
    assert got == {0: (200_000, 200_000, 1), 1: (11, 0, 0), 2: (0, 0, 0)}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "far " * 20 + "red x x green y blue"), (2, "red " + "x " * 60 + "green blue"), (3, None)], "doc_id long, text string")
    item = spark.createDataFrame([(1, "blue red green")], "item_id long, text string")
    assert {r.doc_id for r in decontam.proximity_matches(docs, item, slop=10).collect()} == {1}


def test_personal_data(spark, empty):
    rng = random.Random(5)
    card = next(c for c in (f"4{rng.randrange(10**15):015d}" for _ in range(99)) if brute.luhn(c))
    texts = [f"mail é a.b+c@ex-1.example.com_x@y.org, ip 1.2.3.4 and 999.1.1.1.1 {card[:4]} {card[4:8]}-{card[8:]}", "+1 (743) 555-3824 and +12 34", None, "", "a@b 1.2.3", "1" * 40, "@" * 50, "9" * 3000 + " x@y.zz",
             " ".join("".join(rng.choice("0123456789.+- @ab") for _ in range(30)) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        assert [f"{x.kind}:{x.s}:{x.e}" for x in r.base] == brute.personal(texts[r.doc_id])
    assert pii.personal_data(empty).count() == 0


def test_patterns_find_unknown_identifiers(spark):
    """Contexts of many valid cards also find one that fails its checksum."""
    rng = random.Random(6)
    good = [c for c in (f"4{rng.randrange(10**15):015d}" for _ in range(400)) if brute.luhn(c)][:30]
    bad = next(c for c in (f"4{rng.randrange(10**15):015d}" for _ in range(99)) if not brute.luhn(c))
    rows = [(i, f"please charge card {c} today thanks") for i, c in enumerate(good)] + [(99, f"please charge card {bad} today thanks"), (100, "version 2.0 of the year 1999 came out")]
    got = {r.doc_id: [(x.kind, x.v) for x in r.added] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == [("card", bad)] and got[100] == [] and got[0] == []


def test_patterns_find_forms_that_no_base_pattern_has(spark):
    """Numbers without a plus, words without digits and short passwords, by their contexts alone."""
    rng = random.Random(7)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [f"reach us, phone: +49 30 {digits(7)} or come by" for _ in range(12)]
    rows += [f"write, mail: {x}{x}@ex.org soon" for x in "abcdefghijkl"]
    rows += [f"set password={rng.randrange(16**18, 16**19):x}a1 now" for _ in range(12)]
    rows += ["phone: 030-1234567 it said", "mail: jane(at)ex please", "set password=hunter2 now", "the phone rang and a mail came", "set a = 5", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows + rows[:1])], "doc_id long, text string, th string")
    got = {r.doc_id: [(x.kind, x.v) for x in r.added] for r in pii.personal_data(docs).collect()}
    assert [got[i] for i in range(36, 42)] == [[("phone", "030-1234567")], [("email", "jane")], [("secret", "hunter2")], [], [], []]
    assert all(got[i] == [] for i in range(24)) and len(got) == 43


def test_personal_data_long_text(spark):
    """100,000 tokens with digits, in time that grows with the text."""
    text = " ".join(f"n{i}" for i in range(100_000)) + " a@b.cc"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = pii.personal_data(df).collect()
    assert [(x.kind, x.s) for x in row.base] == [("email", len(text) - 6)]


def test_statistics():
    t = "a b c d e f a b c d e g\n\na b\n#x|\na b\n"
    words = t.split()
    seen = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(seen) if seen.count(w) > 1 for j in range(i, i + 5)}
    s = quality.text_statistics(t)
    assert s[:5] == (len(words), sum(map(len, words)), 2, 1, len(hit))
    assert quality.text_statistics(None) == quality.text_statistics(" \n") == (0,) * len(quality.COUNTS + quality.EXTRA)


def test_quality_counts(spark, docs, texts, odd):
    """Base counts and verdicts, awkward rows and long texts among them."""
    labels = spark.createDataFrame([], "doc_id long, quality int")
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    long = ["a b " * 50_000, "line #\n" * 50_000, "\u00a0 \u2003 é|ü\x1c\x0b\x0c\r ", "a b c d e", "w" * 1_000_000]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(long)], "doc_id long, text string")
    got = table(quality.quality_verdicts(docs.select("doc_id", "text").union(more), labels), *cols)
    assert got == sorted(((i, *brute.rule_counts(t)) for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(long))]), key=repr)
    want = [(r.doc_id, *brute.rule_counts(r.text)) for r in odd.collect()]
    assert table(quality.quality_verdicts(odd, labels), *cols) == sorted(want, key=repr)


def test_quality(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words = sentence(rng, 60).split()
        if i % 8 == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words] if i % 16 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), None))
        labels.append((i, int(i % 8 > 0), 0))
    rows += [(1000, None, "x"), (1001, "short text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    known = spark.createDataFrame([*labels[:300], (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs, known).collect()}
    held = range(300, 400)
    assert np.mean([got[i].kept == (i % 8 > 0) for i in held]) > 0.95
    assert np.mean([got[i].kept for i in held if i % 8]) > 0.97
    assert got[1000].base_failed and got[1001].base_failed and not got[1001].kept
    kept = {r.doc_id for r in quality.quality_filter(docs, known).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    assert quality.quality_verdicts(empty, known).count() == 0
    assert all(r.kept != r.base_failed for r in quality.quality_verdicts(docs, known.limit(0)).collect())


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/ b\r\n", big, 3), (2, "http://b", big, 3), (3, None, big, 3), (4, "u", None, 3), (5, "u", "", 3), (6, "u", "small", 3), (7, "u", "small", 3), (None, "u", big, 3), (8, "u", "WARC/1.0\r\n\r\nx", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    m = warc.write_warc(pages, f"file://{tmp_path}/w", roll_bytes=500)
    assert m.count() > 1 and not [f for f in os.listdir(f"{tmp_path}/w/data") if f.endswith(".tmp")]
    back = {r.page_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert len(back) == 9
    for p, _, html, _ in rows:
        b = (html or "").encode()
        assert (back[p].payload_bytes, back[p].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        assert back[p].refers_to == (3 if html == big and p != 3 else None)
        assert back[p].payload == ("" if back[p].record_type == "revisit" else (html or ""))
    first = {f: hashlib.sha256(open(f"{tmp_path}/w/data/{f}", "rb").read()).hexdigest() for f in os.listdir(f"{tmp_path}/w/data") if f.endswith(".gz")}
    warc.write_warc(pages, f"file://{tmp_path}/v", roll_bytes=500)
    assert first == {f: hashlib.sha256(open(f"{tmp_path}/v/data/{f}", "rb").read()).hexdigest() for f in os.listdir(f"{tmp_path}/v/data") if f.endswith(".gz")}
    none = warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")
    assert none.count() == 0 and warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_blocks():
    page = '<p>a &amp; b<script>var t="</p>";</script> c<p>d<br>e <b>f</b>&am<!-- x --><div class="Ad x" title="a>b">g</div><p'
    assert [b.text for b in read_blocks(page)] == ["a & b c", "d", "e f&am", "g"]
    assert "c.ad" in read_blocks(page)[-1].path
    assert read_blocks("") == [] and [b.text for b in read_blocks("1 < 2")] == ["1 < 2"]


def test_extract(spark):
    model = html_extract.trained(300, 4)
    xs, ys = html_extract.template_set(60, 99)
    right = sum(((s > 0.5) == (y > 0.5)).sum() for s, y in zip(model.scores(xs), ys, strict=True))
    assert right / sum(map(len, ys)) > 0.97
    html = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title of it</h1><p>First  one.</p><p>Second one is longer.</p></article><footer>&copy; me</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", html, "x"), (2, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_pages(pages, 300, 4).collect()}
    assert got[1].text == "Title of it\nFirst one.\nSecond one is longer." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[None].n_chars == 0


def test_deep_and_stray_pages_in_linear_time():
    """100,000 open tags, and as many stray quotes and unclosed list items."""
    deep = read_blocks("<div class='a b'>" * 100_000 + "<p>text</p><p>more</p>")
    assert [b.text for b in deep] == ["text", "more"] and len(deep[0].path) == 3 * 100_000 + 1
    assert html_extract.block_features(deep).shape == (2, html_extract.DIM)
    assert len(read_blocks("<a href=\"x>y</a> <p t='z>w" * 50_000)) >= 0
    assert len(read_blocks("<span>" * 100_000 + "<li>x</span></i>" * 20_000)) == 20_000


def test_labeller_reads_whole_blocks():
    """Ancestors behind many class words and words behind 400 characters are seen."""
    many = " ".join("abcdefghijklmnopqrstuvwxyz")
    a, b = (read_blocks(f'<{x}><div class="{many}"><p>text</p></div></{x}>') for x in ("nav", "article"))
    assert (html_extract.block_features(a) != html_extract.block_features(b)).any()
    a, b = (read_blocks(f"<p>{'word ' * 100}{x}</p>") for x in ("login", "songs"))
    assert (html_extract.block_features(a) != html_extract.block_features(b)).any()


def test_extract_deep_pages():
    model = html_extract.trained(300, 4)
    xs, ys = html_extract.template_set(60, 99, True)
    right = sum(((s > 0.5) == (y > 0.5)).sum() for s, y in zip(model.scores(xs), ys, strict=True))
    assert right / sum(map(len, ys)) > 0.96
