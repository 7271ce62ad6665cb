"""The corpus operators against brute-force versions, with odd rows in every table."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import decontam, hashing, html, jaccard, language, linededup, mixing, quality, repeats, runindex, sharding, warc
from thalweg.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(7)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "x", "the", "of", "and", "river", "stone", "Cloud", "über"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + str(r.randrange(40)) for _ in range(n))


def odd_rows():
    base = prose(120, 1)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, None), (5, "", "b"), (6, " \t\n ", "a"), (None, base + " more", "c"), (None, None, "c"), (7, "one two", "b"),
        (8, "One\tTWO", "b"), (9, prose(300, 2) + "\n" + prose(60, 3) + ".", "a"), (10, prose(60, 3) + ".\n" + prose(200, 4), "a"), (11, "x " * 400, "b"), (12, "a | b | c\n" + prose(60, 5) + ".", None),
        (13, "# $ % &\n" * 30, "c"), (14, prose(5000, 6), "a"), (15, base.upper(), "d"),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "clash", 0) for i, t, s in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, label string, size int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def words(text):
    return WORD.findall(text or "")


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_word_hashes_cut_like_the_pattern():
    import pyarrow as pa

    texts = ["a b", None, "", "\tA\x0bb\n", "über  x", "w" * 3000, "z"]
    for chunk in (4, 1 << 20):
        got = []
        for _, data, offsets in hashing.chunks(pa.array(texts), chunk):
            h, s, e, rows = hashing.word_hashes(data, offsets)
            got += [[bytes(data[a:b]).decode().lower() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(rows[:-1], rows[1:])]
        assert got == [[w.lower() for w in words(t)] for t in texts]


def test_quality(docs, none):
    for r in quality.judge(docs).collect():
        text = r["text"] or ""
        w = words(text)
        tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(repeated))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert kept[1] and kept[9] and kept[12] and not kept[13] and not kept[11] and not kept[4]
    clean = {r["doc_id"]: r["text"] for r in quality.filter_quality(docs).collect()}
    assert clean[12] == prose(60, 5) + "." and clean[1] == prose(120, 1)
    assert quality.judge(none).count() == 0


def test_long_texts_sort_pairs(spark, monkeypatch):
    monkeypatch.setattr(quality, "_N_REPEAT", quality._N_REPEAT.replace("1048576", "3"))
    text = "a b c d a b c e"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.judge(df).first()["n_repeat_words"] == 6


def test_sharding(docs, none):
    rows = sharding.assign_shards(docs, 5).orderBy("shard", "slot").collect()
    want = sorted(len((t or "").encode()) + 8 for _, t, _ in odd_rows())
    assert sorted(r["size"] for r in rows) == want
    assert sorted(r["text_crc32"] for r in rows) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in odd_rows())
    assert all([r["slot"] for r in rows if r["shard"] == s] == list(range(sum(r["shard"] == s for r in rows))) for s in range(5))
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(5)]
    assert max(abs(x - sum(want) / 5) for x in loads) <= max(want)
    assert sharding.assign_shards(none).count() == 0


def test_mixing(docs, none):
    rows, _ = mixing.plan_mix(docs)
    rows = rows.collect()
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += r["size"]
    assert sorted(r["size"] for r in rows) == sorted(len(words(t)) for _, t, _ in odd_rows())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    for s in names:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] and 0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 2
    again, _ = mixing.plan_mix(docs.repartition(5))
    key = lambda r: (str(r["doc_id"]), r["source"] or "", r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))
    mixed = collections.Counter()
    for r in mixing.mix_documents(docs).collect():
        mixed[r["source"]] += len(words(r["text"]))
    assert all(abs(mixed[s] - target[s]) <= 2 + max((len(words(t)) for i, t, x in odd_rows() if x == s and i == 2), default=0) for s in names)
    assert mixing.plan_mix(none)[0].count() == 0 and mixing.mix_documents(none).count() == 0


def test_sainte_lague(spark):
    sources = spark.createDataFrame([(f"s{i}", 100, i, 1, float(t)) for i, t in enumerate((53, 24, 23))], "source string, source_size long, source_row long, weight long, target double")
    got = mixing.quotas(sources, blocks=10, shards=2).collect()
    seats = sorted(((t / (2 * k - 1), -i) for i, t in enumerate((53, 24, 23)) for k in range(1, 20)), reverse=True)[:10]
    assert {r["source_row"]: r["upto"] for r in got if r["shard"] == 1} == dict(collections.Counter(-i for _, i in seats))
    assert sum(r["quota"] for r in got) == 10 and sum(r["quota"] for r in got if r["shard"] == 0) == 5


def test_mixing_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 64)
    sizes = {"a": 1_000_000, "b": 100, "c": 17, "d": 1, "e": 24_000}
    rows = [(100 * i + j, "w " * (n // 10 + (j < n % 10)), s) for i, (s, n) in enumerate(sizes.items()) for j in range(10)]
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0]
    got = {r["source"]: r for r in got.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()}
    assert {s: r["size"] for s, r in got.items()} == sizes
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in got.values())
    monkeypatch.setattr(mixing, "SOURCE_BLOCKS", 50)
    sizes = [70_000] + [1_000 + 7 * i for i in range(12)]
    rows = [(i, "w " * n, f"s{i:02}") for i, n in enumerate(sizes)]
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].collect()
    assert len(got) == 13 and all(abs(r["taken"] - r["target"]) <= 0.05 * r["target"] for r in got)


def brute_groups(rows, k, percent):
    sets = []
    for _, t, _ in rows:
        w = words(folded(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (doc, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("frequent", [6, 0])
@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, none, monkeypatch, frequent, k, percent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = odd_rows()
    for g in range(3):  # groups of near copies around texts of several lengths
        text = prose(60 * (g + 1), 100 + g).split()
        for c in range(12):
            r, copy = random.Random(1000 * g + c), list(text)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(99)}"
            rows.append((100 + 20 * g + c, " ".join(copy), "n"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df, k, percent).collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(brute_groups(rows, k, percent), key=order)
    if frequent and k == 3:
        kept = jaccard.keep_one(df, k, percent).collect()
        blank = sum(not words(t) for _, t, _ in rows)
        groups = {c for (d, n, c) in got if n}
        assert len(kept) == blank + len(groups) and len({r["doc_id"] for r in kept if words(r["text"])}) == len(groups)
        assert jaccard.similar_groups(none, k, percent).count() == 0


@pytest.mark.parametrize(("crowd", "splits"), [(8, 8), (8, 1)])
def test_jaccard_of_crowds(spark, monkeypatch, crowd, splits):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "SPLIT_CROWD", crowd)
    monkeypatch.setattr(jaccard, "SPLITS", splits)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rows = []
    for g, n in enumerate((110, 130, 150)):  # copies around a text that is not among them, each with up to four words of its own
        text = prose(n, 500 + g).split()
        for c in range(60):
            r, copy = random.Random(7000 * g + c), list(text)
            for _ in range(r.randrange(1, 5)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(9999)}"
            if c % 3 == 0:  # a variant within the group, with a beginning of its own
                copy[:20] = prose(20, 600 + g).split()
            rows.append((100 * g + c, " ".join(copy), "n"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df, 5, 80).collect()]
    assert sorted(got) == sorted(brute_groups(rows, 5, 80))
    assert 5 < len({x for _, _, x in got}) < 180


def test_difference_entries_miss_no_link():
    r, common = random.Random(11), np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    for percent in (80, 90):
        for _ in range(150):
            pool = np.unique(np.array([r.getrandbits(64) for _ in range(160)], np.uint64))
            base = pool[: r.randrange(20, 100)]
            sets = []
            for _ in range(12):
                x = np.array(sorted(set(base.tolist()) ^ set(r.sample(pool.tolist(), r.randrange(0, 14)))), np.uint64)
                sets.append(x.view(np.int64))
            pivot = sets[0]
            found = [jaccard.difference_entries(x, pivot, common, percent) for x in sets if len(np.setxor1d(x, pivot))]
            others = [x for x in sets if len(np.setxor1d(x, pivot))]
            for i, j in itertools.combinations(range(len(others)), 2):
                same, both = len(np.intersect1d(others[i], others[j])), len(np.union1d(others[i], others[j]))
                if 0 < both - same and 100 * same >= percent * both and not (found[i][0] and found[j][0]):
                    (_, m, a), (_, n, b) = found[i], found[j]
                    share = max(1, -(-(m + n - (len(others[i]) + len(others[j])) * (100 - percent) // (100 + percent)) // 2))
                    assert set(a[: m - share + 1].tolist()) & set(b[: n - share + 1].tolist())


def test_wide_bitmaps_part_no_link(spark):
    import pyarrow as pa

    r, rows = random.Random(17), []
    for _ in range(60):  # pairs that link, of sets so large that they have wide bitmaps
        x = np.array([r.getrandbits(64) for _ in range(r.choice((1500, 2200, 2500)))], np.uint64)
        y = np.concatenate([x[: len(x) - len(x) // 20], np.array([r.getrandbits(64) for _ in range(len(x) // 20)], np.uint64)])
        rows.append((jaccard._parity(x, jaccard._wide_words(len(x))), jaccard._parity(y, jaccard._wide_words(len(y))), len(x) + len(y)))
    batch = {"a": list(range(60)), "b": list(range(60, 120)), "wa": [x.tolist() for x, _, _ in rows], "wb": [y.tolist() for _, y, _ in rows], "n": [n for _, _, n in rows]}
    assert sum(len(b) for b in jaccard._wide_apart([pa.RecordBatch.from_pydict(batch)], 90)) == 60
    text = prose(2600, 77).split()
    docs = []
    for c in range(12):
        copy = list(text)
        for _ in range(40):
            copy[r.randrange(len(copy))] = f"w{r.randrange(9999)}"
        docs.append((c, " ".join(copy), "n"))
    got = jaccard.similar_groups(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted(brute_groups(docs, 3, 90))


def test_word_hashes_do_not_meet_by_arithmetic():
    import pyarrow as pa

    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word[:250], word[250:500], "abcdefgh", "abcdefg", "abcdefghi"]
    hashes = [hashing.word_hashes(*hashing.as_bytes(pa.array([t])))[0][0] for t in texts]
    assert len(set(hashes)) == len(texts)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    got = {x["v"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_decontamination(spark, docs, none):
    items = [(1, prose(40, 50)), (2, prose(12, 51)), (3, None), (4, ""), (5, "too short"), (None, prose(20, 52)), (6, prose(40, 50))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = prose(40, 50).split()
    for i in (3, 11, 20, 29):
        w[i] = "substituted"
    rows = [(1, prose(80, 60) + " " + " ".join(w) + " " + prose(30, 61)), (2, prose(200, 62)), (3, prose(12, 51).upper()), (4, prose(20, 52)), (5, None), (6, " ".join(prose(40, 50).split()[:18]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.mark_contaminated(df, bench).collect()}
    assert got == {1: [1, 6], 2: [], 3: [2], 4: [None], 5: [], 6: [1, 6]}
    old, decontam.SLICE_WORDS = decontam.SLICE_WORDS, 30
    try:
        sliced = {r["doc_id"]: r["item_ids"] for r in decontam.mark_contaminated(df, bench).collect()}
    finally:
        decontam.SLICE_WORDS = old
    assert sliced == got
    assert [r["doc_id"] for r in decontam.drop_contaminated(df, bench).orderBy("doc_id").collect()] == [2, 5]
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == len(odd_rows()) and decontam.drop_contaminated(none, bench).count() == 0


def fits(mask, n, ignored):
    ones = [i for i, x in enumerate(mask) if x == "1"]
    return any(not any(o + i in ignored for i in ones) for o in range(n - len(mask) + 1))


def test_masks_hit_all_substitutions():
    for n in range(decontam.MIN_ITEM, decontam.WINDOW + 1):
        masks = decontam.MASKS if n == decontam.WINDOW else decontam.SHORT_MASKS
        for ignored in itertools.combinations(range(n), n * (100 - decontam.PERCENT) // 100):
            assert any(fits(m, n, ignored) for m in masks), (n, ignored)


def brute_contained(doc, item):
    """Most equal words of the item along the document, of places where a window of it agrees well enough."""
    d, w = folded(doc), folded(item)
    d, w, best = words(d), words(w), 0
    if len(w) < decontam.MIN_ITEM:
        return 0
    width = min(decontam.WINDOW, len(w))
    for at in range(-len(w), len(d)):
        equal = [0 <= at + i < len(d) and d[at + i] == x for i, x in enumerate(w)]
        if max(sum(equal[i : i + width]) for i in range(len(w) - width + 1)) * 100 >= decontam.PERCENT * width:
            best = max(best, sum(equal))
    return best


@pytest.mark.parametrize(("together", "slice_words"), [(1 << 20, 4_000_000), (64, 60)])
def test_decontamination_against_brute_force(spark, monkeypatch, together, slice_words):
    monkeypatch.setattr(decontam, "TOGETHER", together)
    monkeypatch.setattr(decontam, "SLICE_WORDS", slice_words)
    r = random.Random(23)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice((3, 6, 7, 9, 11, 14, 15, 20, 33))))) for i in range(40)]
    items += [(100, items[5][1].upper()), (None, items[5][1]), (101, "same " * 30), (102, "one two " * 12), (103, None), (104, items[7][1])]
    docs = []
    for k in range(60):
        own = [r.choice(vocabulary) for _ in range(r.randrange(0, 40))]
        for _ in range(r.randrange(0, 3)):
            piece = words(r.choice(items)[1])
            for _ in range(r.randrange(0, 5)):
                if piece:
                    piece[r.randrange(len(piece))] = r.choice((*vocabulary, "new"))
            at = r.randrange(len(own) + 1)
            own[at:at] = piece[: r.choice((7, 16, 99))]
        docs.append((k, " ".join(own)))
    docs += [(200, "same " * 700), (201, "one two " * 90), (202, None), (203, ""), (203, ""), (204, "x" * 300_000 + " " + items[8][1])]
    got = decontam.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    order = lambda x: (x is None, x)
    want = sorted((k, tuple(sorted((i for i, t in items if brute_contained(d, t)), key=order)), sum(brute_contained(d, t) for _, t in items), len(words(d))) for k, d in docs)
    assert sorted((r["doc_id"], tuple(r["item_ids"]), r["equal_words"], r["n_words"]) for r in got) == want
    assert any(x[1] for x in want)


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        n = int(sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)))
        yield len(d), int(gone.sum()), n, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()


def brute_statistics(texts):
    places = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]))]
    common = lambda a, b: sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b)))  # noqa: B905, E731
    return [max((common(texts[t][i:], texts[u][j:]) for u, j in places if (u, j) != (t, i)), default=0) for t, i in places]


def test_run_index():
    rng = np.random.default_rng(3)
    for trial in range(60):
        texts = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 25)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        texts += texts[: trial % 3]
        index = runindex.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        assert index.lengths.sum() == sum(map(len, texts)) + len(texts)
        assert index.matching_statistics().tolist() == brute_statistics(texts)
    copies = [b"the same line of text over and over " * 5] * 8
    assert len(runindex.RunIndex(np.frombuffer(b"".join(copies), np.uint8), np.cumsum([0, *map(len, copies)])).lengths) < 100


@pytest.mark.parametrize(("filtered", "cells"), [(True, 2048), (False, 2048), (True, 2), (True, 40), (False, 40)])
def test_repeats(spark, docs, none, monkeypatch, filtered, cells):
    monkeypatch.setattr(repeats, "BLOCK_CELLS", cells)
    if not filtered:
        monkeypatch.setattr(repeats, "FILTER_KEYS", -1)
        monkeypatch.setattr(repeats, "MARKED_TEXTS", -1)
    shared = prose(150, 70)
    texts = [t for _, t, _ in odd_rows()] + [prose(30 + i, 80 + i) + shared[i * 7 : 700 + i * 11] + prose(20, 90 + i) for i in range(12)] + ["ab" * 700]
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in enumerate(texts)], "doc_id long, text string, spans int, th string, n_bytes double")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))
    assert repeats.remove_repeats(none).count() == 0


def test_line_dedup(spark, docs, none):
    a = ["first line of the text here", "second line of the text here", "third line of the text here", "short"]
    b = ["an opening line of its own kind", *a[:2], "another line that nobody else has"]
    rows = [(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(a)), (4, None), (5, "short"), (None, "\n".join(a[1:3]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in linededup.dedup_lines(df).collect()}
    assert got == {1: (4, 0, "\n".join(a)), 2: (4, 2, b[0] + "\n" + b[3]), 3: (4, 4, ""), 4: (0, 0, ""), 5: (1, 0, "short"), None: (2, 2, "")}
    assert linededup.dedup_lines(none).count() == 0 and linededup.dedup_lines(docs).count() == len(odd_rows())


@pytest.mark.parametrize("part", [512, 3])
def test_line_dedup_of_frequent_lines(spark, monkeypatch, part):
    monkeypatch.setattr(linededup, "PART", part)
    common, rare = "a passage that a hundred texts hold", "a line that only three texts hold"
    rows = [(0, f"{rare}\nown 0")] + [(i, f"own {i}\n{common}" + (f"\n{rare}" if i in (51, 52) else "")) for i in range(1, 101)]
    got = {r["doc_id"]: r["kept_text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: f"{rare}\nown 0", 1: f"own 1\n{common}"} | {i: f"own {i}" for i in range(2, 101)}


def brute_line_dedup(rows):
    """(doc_id, n_lines, n_removed, kept) of each row, by plain loops over all texts and lines."""
    key = lambda t: hashlib.md5((t or "").encode()).digest()
    first, lines = {}, {}
    for i, t in rows:
        k = key(t)
        order = (i is None, i or 0)
        first[k], lines[k] = min(first.get(k, order), order), (t or "").split("\n")
    order = sorted(first, key=lambda k: (first[k], k))
    held = {}
    for k in order:
        for x in {x.strip() for x in lines[k]}:
            if len(x) >= linededup.MIN_CHARS:
                held.setdefault(x, k)
    gone = {}
    for k in order:
        own = [x.strip() for x in lines[k]]
        gone[k] = set()
        for early in {held[x] for x in own if x in held} - {k}:
            for a, b in linededup.blocks(linededup.align([linededup.line_hash(x) for x in lines[early]], [linededup.line_hash(x) for x in lines[k]])):
                if any(len(x) >= linededup.MIN_CHARS for x in own[a:b]):
                    gone[k] |= set(range(a, b))
    for i, t in rows:
        k = key(t)
        whole = first[k] != (i is None, i or 0)
        own = (t or "").split("\n") if t else []
        kept = [x for j, x in enumerate(own) if not whole and j not in gone[k]]
        yield i, len(own), len(own) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("frequent", [4096, 3])
def test_line_dedup_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(linededup, "FREQUENT", frequent)
    r = random.Random(77)
    pool = [prose(r.randrange(1, 9), 40 + k) for k in range(40)] + ["", "  ", "one and the same line of thirty"]
    rows = [(i if i % 17 else None, "\n".join(r.choice(pool) + r.choice(("", "", " ")) for _ in range(r.randrange(0, 12)))) for i in range(150)]
    rows += [(3, rows[3][1]), (900, rows[4][1]), (901, None), (902, ""), (903, "\n".join(prose(5, 2000 + k) for k in range(5000)))]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, line int")
    order = lambda x: tuple((v is None, v) for v in x)
    got = [(x["doc_id"], x["n_lines"], x["n_removed"], x["kept_text"]) for x in linededup.dedup_lines(df).collect()]
    assert sorted(got, key=order) == sorted(brute_line_dedup(rows), key=order)


def test_patience_alignment():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.randrange(12) for _ in range(r.randrange(14))] for _ in range(2))
        pairs = linededup.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert linededup.align(a, a) == [(i, i) for i in range(len(a))]


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice"><p>We use cookies</p></div><!-- <p>no</p> -->
%s<aside>See also</aside><form><label>Mail</label><input></form><div id="comments"><p>Nice!</p></div><footer>&copy; 2020</footer></body></html>"""


def test_html(spark, none):
    article = "<article><header><h1>A &amp; B</h1></header><p>First\n  paragraph<br>goes <b>on</b>.<p>Second &eacute;&#33;<div class='ad'><p>Buy</p></div><ul><li>x<li>y</ul></article>"
    want = "A & B\nFirst paragraph goes on.\nSecond é!\nx\ny"
    long = "".join(f"<div><p>{prose(40, 300 + i)}.</p></div>" for i in range(4))
    plain = "\n".join(f"{prose(40, 300 + i)}." for i in range(4))
    cases = [(PAGE % article, want), (PAGE % long, plain), (None, ""), ("", ""), ("<article><p>cut off", "cut off"), (PAGE % "", "")]
    df = spark.createDataFrame([(i, p, "u") for i, (p, _) in enumerate(cases)], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract_pages(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}
    assert html.extract_pages(df.limit(0)).count() == 0


def test_html_distribution():
    paragraphs = [prose(60, 400 + i) + "." for i in range(4)] + ["A short end.", "And the last line."]
    drops = ["<aside>See also</aside>", "<div class='ad'><p>Buy</p></div>", "<form><input>Mail</form>", "<div style='display:none'>no</div>", "<div class=newsletter>Mail</div>"]
    inline = "".join(f"<p>{x}</p>{y}" for x, y in itertools.zip_longest(paragraphs, drops, fillvalue=""))
    assert html.extract(PAGE % f"<div>{inline}</div>") == "\n".join(paragraphs)
    # A short run between two long ones stays, one before or behind the menus of the page goes.
    menu = "<nav><a href=/>Home</a></nav>"
    page = f"<body><div>Site</div>{menu}<p>{paragraphs[0]}</p>{menu}<p>Between.</p>{menu}<p>{paragraphs[1]}</p>{menu}<div>Imprint</div></body>"
    assert html.extract(page) == "\n".join([paragraphs[0], "Between.", paragraphs[1]])
    # A declared teaser does not hide the text beside it; a declared text stands against short lines.
    text = "".join(f"<p>{x}</p>" for x in paragraphs)
    assert html.extract(f"<article>Teaser</article><div>{text}</div>") == "\n".join(["Teaser", *paragraphs])
    assert html.extract(f"<div>Site</div><article>{text}</article><div>{prose(12, 7)}</div>") == "\n".join(paragraphs)


def test_html_cases():
    long = prose(60, 900) + "."
    assert html.extract("<article><p class=don't>Hello one</p><p>Second it's here</p><p>Third</p></article>") == "Hello one\nSecond it's here\nThird"
    assert html.extract("<p title=\"a>b\" data-x='c>d'>x<p class=\"unclosed>y</p>") == "x\ny"
    # The page's heading stays, though menus divide it from the text; short ends and middles stay too.
    assert html.extract(f"<body><h1>A title</h1><nav><a href=/>Home</a></nav><p>{long}</p><div class=ad>Buy</div><p>The end.</p></body>") == f"A title\n{long}\nThe end."
    assert html.extract(f"<body><p>{long}</p><aside>x</aside><p>Short middle.</p><aside>y</aside><p>{long}</p></body>") == f"{long}\nShort middle.\n{long}"
    inside = {"share-price": True, "search-results": True, "no-sidebar": True, "market-share": True, "cookie-notice": False, "site-footer": False, "comment-list": False, "ad-slot-3": False, "related-posts": False}
    for name, kept in inside.items():
        assert html.extract(f"<article><p>{long}</p><div class='{name}'><p>More</p></div></article>") == long + ("\nMore" if kept else ""), name
    assert html.extract(f"<article><p>{long}</p><div id='comments-policy-history'>More</div></article>") == f"{long}\nMore"
    # Teasers below the main text go; articles of about one size stay.
    assert html.extract(f"<main><p>{long}</p></main><article>Teaser one two three</article><article>Teaser four</article>") == long
    assert html.extract(f"<article>{long}</article><article>{long} Two</article>") == f"{long}\n{long} Two"


def test_html_pages_with_known_text(spark):
    """Pages put together at random around known text, in and without article elements."""
    r, pages = random.Random(41), []
    noise = ["<div class='ad'>Buy now</div>", "<aside>See also</aside>", "<form><input>Mail</form>", "<!-- no -->", "<script>if (a<b) {'</p>'}</script>", "<div class='related-posts'><p>Other</p></div>", "<style>p{}</style>"]
    frame = ["<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>", "<header><p>Site name</p></header>", "<div id='sidebar'><p>Aside</p></div>", "<div class='cookie-notice'>We use cookies</div>"]
    for i in range(150):
        blocks = [prose(r.randrange(30, 90), 5000 + 31 * i + k) + "." for k in range(r.randrange(2, 6))]
        if r.random() < 0.4:
            blocks.append(prose(r.randrange(1, 4), 9000 + i))
        body = ""
        for block in blocks:
            shown = block.replace(" ", r.choice((" ", "\n  ", "&#32;"))).replace("ü", r.choice(("ü", "&uuml;", "&#xFC;")))
            body += r.choice(("<p>%s</p>", "<p>%s", "<div>%s</div>", "<section><p><b>%s</b></p></section>")) % shown + (r.choice(noise) if r.random() < 0.5 else "")
        title = "" if r.random() < 0.5 else f"<h1>Heading {i}</h1>"
        body = f"<article>{title}{body}</article>" if r.random() < 0.5 else f"{title}<div id=content>{body}</div>"
        page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(r.sample(frame, r.randrange(4)))}{body}<div id='comments'><p>{prose(40, i)}</p></div><footer>&copy; 2020</footer></body></html>"
        pages.append((i, page, "\n".join([f"Heading {i}"] * bool(title) + blocks)))
    got = {x["page_id"]: x["text"] for x in html.extract_pages(spark.createDataFrame([p[:2] for p in pages + pages[:3]], "page_id long, html string")).collect()}
    wrong = [i for i, _, want in pages if got[i] != want]
    assert not wrong, (wrong, got[wrong[0]][:200], pages[wrong[0]][2][:200])
    assert html.extract("<article><p>" + "long words " * 200_000 + "</article>") == ("long words " * 200_000).strip()


def test_warc_round_trip(spark):
    pages = [(1, "http://www.Example.com/b?x=1", "same"), (2, "https://a.example.com/", "same"), (5, "http://a.example.com:8080/ü\r\nx", "same"), (3, None, None), (4, "not a url", ""), (None, "http://e.org/", "same"), (6, "http://e.org/q", "é" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    directory = warc.write_archives(df)
    got = {r["page_id"]: r for r in warc.read_archives(directory).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        data = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    kinds = {i: (r["record_type"], r["refers_to"]) for i, r in got.items()}
    assert kinds == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), None: ("revisit", 5), 3: ("revisit", 4), 4: ("response", None), 6: ("response", None)}
    urls = spark.createDataFrame([("http://example.com/b?x=1",), ("http://nowhere.net/",), ("https://e.org/q",)], "url string")
    assert sorted(r["page_id"] for r in warc.lookup(directory, urls).collect()) == [1, 6]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


@pytest.mark.parametrize("limits", [(256, 500_000, 500_000), (2, 3, 0)])
def test_warc_against_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("BLOCK_LINES", "DIRECTORY_SLICE", "BROADCAST_PAYLOADS"), limits):
        monkeypatch.setattr(warc, name, value)
    r = random.Random(31)
    pages = [(i, r.choice(("http://a.example/x", f"https://h{r.randrange(9)}.example/{r.randrange(20)}", None, "", "no url", f"http://e.org/{i}?q=ü")), r.choice((None, "", "one", "two", f"<p>{i}</p>"))) for i in range(120)]
    pages += [(7, pages[7][1], pages[7][2]), (None, "http://e.org/n", "one"), (500, "http://long.example/", "é" * 400_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    latest = {}
    for i, _, h in pages:
        latest[h or ""] = max(latest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        data, revisit = (h or "").encode(), latest[h or ""] != (-1 if i is None else i)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", latest[h or ""] if revisit else None))
    order = lambda x: tuple((v is None, v) for v in x)
    directory = warc.write_archives(df)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    for out in (warc.read_archives(directory), warc.lookup(directory, df)):
        assert sorted((tuple(x[c] for c in columns) for x in out.collect()), key=order) == sorted(want, key=order)
    some = df.where("page_id % 3 = 0")
    keys = {warc.url_key(u) for i, u, _ in pages if i is not None and i % 3 == 0}
    got = collections.Counter(x["page_id"] for x in warc.lookup(directory, some).collect())
    assert got == collections.Counter(i for i, u, _ in pages if warc.url_key(u) in keys)
    assert warc.lookup(directory, some.limit(0)).count() == 0 and warc.lookup(warc.write_archives(df.limit(0)), some).count() == 0


def test_language(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = texts.where("doc_id % 5 != 0"), texts.where("doc_id % 5 = 0 AND n_chars > 200")
    pages = held.select(F.col("doc_id").alias("page_id"), F.lit("http://h.example.com/x").alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"), F.col("lang").alias("truth"))
    got = language.identify(pages, train).join(pages.select("page_id", "truth"), "page_id")
    assert got.where("lang = truth").count() >= 0.95 * got.count()
    odd = spark.createDataFrame([(1, None, None), (2, "http://h.example.com/de/1", ""), (2, "http://h.example.com/de/1", "")], "page_id long, url string, html string")
    assert language.identify(odd, train).count() == 3 and language.identify(odd.limit(0), train).count() == 0
    assert [r["lang"] for r in language.identify(odd, train.limit(0)).collect()] == [None] * 3


def brute_language(pages, labelled):
    """lang and posterior of each page by the formulas, with plain counts."""
    names = sorted({x for x, _ in labelled})
    model = np.full((len(names), 1 << language.CELL_BITS), language.ALPHA_GRAM)
    for lang, text in labelled:
        np.add.at(model[names.index(lang)], language.cells(text), 1)
    model = np.log(model / model.sum(axis=1, keepdims=True)).astype(np.float32)
    n, rows = len(names), []
    for _, url, page in pages:
        host, domain, suffix = language.address(url)
        declared = re.search(r'<html lang="(\w+)"', page or "")
        text = html.extract(page)
        own = language.cells(text) if text else []
        score = model[:, own].mean(axis=1).astype(float) * min(language.TEXT_MOST, language.TEXT_SHARE * len(own)) if len(own) else np.zeros(n)
        rows.append((host, domain, suffix, declared[1] if declared else "", score, int(np.argmax(score))))
    total = np.bincount([x[5] for x in rows], minlength=n).astype(float)
    base = (total + 1) / (len(rows) + n)
    tally = lambda k, v: np.bincount([x[5] for x in rows if x[k] == v], minlength=n).astype(float)
    smooth = lambda c, prior, alpha: (c + alpha * prior) / (c.sum() + alpha)
    for host, domain, suffix, declared, score, _ in rows:
        prior = smooth(tally(0, host), smooth(tally(1, domain), base, language.ALPHA_DOMAIN), language.ALPHA_HOST)
        likely = [(tally(k, v) + language.ALPHA_VALUE) / (total + 2 * n * language.ALPHA_VALUE) for k, v in ((3, declared), (2, suffix))]
        fused = score + np.log(prior) + np.log(likely[0]) + np.log(likely[1])
        yield names[int(np.argmax(fused))], 1 / np.exp(fused - fused.max()).sum()


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_language_fuses_evidence(spark, monkeypatch, broadcast):
    monkeypatch.setattr(language, "BROADCAST_VALUES", broadcast)
    r, speech = random.Random(3), {"de": "der die das und nicht ist ein", "en": "the of and that is not one", "fr": "le la les et pas est une"}
    say = lambda lang, k: " ".join(r.choice(speech[lang].split()) for _ in range(k))
    labelled = [(lang, say(lang, 30)) for lang in speech for _ in range(6)]
    pages = []
    for i in range(90):
        lang = r.choice(list(speech))
        told = lang if r.random() < 0.8 else r.choice(list(speech))
        host = f"h{r.randrange(6)}.{lang}.example" if r.random() < 0.8 else "shared.example"
        body = "" if i % 9 == 0 else f"<article><p>{say(lang, r.randrange(1, 40))}</p></article>"
        pages.append((i, None if i == 50 else f"http://{host}/{r.choice(('', told + '/'))}x", None if i == 40 else f'<html lang="{told}"><body>{body}</body></html>' if i % 4 else body))
    pages += [pages[1], (200, "http://h0.de.example/", "<article>" + say("fr", 60_000) + "</article>")]
    df = spark.createDataFrame([(*p, "x", 1.0) for p in pages], "page_id long, url string, html string, prior string, score double")
    got = {}
    for x in language.identify(df, spark.createDataFrame(labelled, "lang string, text string")).collect():
        got.setdefault(x["page_id"], (x["lang"], x["posterior"]))
    for (i, _, _), (lang, posterior) in zip(pages, brute_language(pages, labelled)):
        assert got[i][0] == lang and abs(got[i][1] - posterior) < 1e-9, i
    # Without any text all scores are equal, and ties go to the first language by name.
    same = spark.createDataFrame([(1, None, ""), (2, None, "")], "page_id long, url string, html string")
    tied = language.identify(same, spark.createDataFrame([("b", "xyz"), ("a", "xyz")], "lang string, text string")).collect()
    assert [x["lang"] for x in tied] == ["a", "a"]


def test_many_languages_share_the_model(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    labelled = [(f"l{k}", f"{chr(97 + k)}{chr(98 + k)}{chr(99 + k)} " * 30) for k in range(7)]
    names, model = language.train(spark.createDataFrame(labelled, "lang string, text string"))
    assert names == [f"l{k}" for k in range(7)] and model.shape == (7, 1 << language.CELL_BITS - 2)
    pages = spark.createDataFrame([(k, "http://h.example/", f"<article>{t}</article>") for k, (_, t) in enumerate(labelled)], "page_id long, url string, html string")
    assert all(r["text_lang"] == f"l{r['page_id']}" for r in language.identify(pages, spark.createDataFrame(labelled, "lang string, text string")).collect())


def brute_verdict(text):
    """kept and the clean text by the rules, line by line."""
    def fails(line):
        low = line.lower()
        symbols = sum(c in quality.SYMBOLS for c in line)
        if 100 * symbols > quality.MAX_SYMBOL_PERCENT * len(line):
            return True
        # The punctuation rule: ten to 59 words that do not end like a sentence.
        if 9 <= line.count(" ") <= 58 and line.strip(" \t\x0b\x0c\r")[-1:] not in ('.', '!', '?', '…', ':', ';', '"', ')', ']', '”', '“', '’', '»', '›'):
            return True
        if len(line) <= quality.SHORT_LINE:
            ended = line.rstrip(" ")[-1:] in (".", "!", "?", "\u2026", '"', ")")
            if any(x in low for x in quality.BOILERPLATE) or (not ended and re.match(quality.NAVIGATION, line)):
                return True
        small = any(c.islower() and c.isalpha() for c in line)
        return len(line) >= quality.SHOUT_CHARS and not small and 2 * sum(c.isupper() for c in line) > len(line)

    lines = (text or "").split("\n")
    full = [x for x in lines if words(x)]
    good = [x for x in full if not fails(x)]
    w = words(text)
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return not base and 100 * sum(map(len, good)) >= (100 - quality.MAX_LOSS_PERCENT) * sum(map(len, full)), "\n".join(x for x in lines if not words(x) or not fails(x))


def test_quality_verdict_against_brute_force(spark):
    r = random.Random(19)
    odd = ["Home | News | About", "a · b · c", "All Rights Reserved 2020", "ABOVE ALL THIS IS SHOUTED LOUD", "# $ % & < >", "click here to go", "Read more ...", "", "  \t", "News > Sport > Ball.", "ÜBER ALLES WIRD GERUFEN HIER", "x | y", "a/b/c"]
    rows = [(i, "\n".join(prose(r.randrange(3, 40), 100 * i + k) + r.choice((".", "", " #")) if r.random() < 0.6 else r.choice(odd) for k in range(r.randrange(1, 12)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "word " * 60_000), (903, rows[5][1]), (904, "\n".join(prose(12, k) for k in range(4000)))]
    got = {x["doc_id"]: (x["kept"], x["clean_text"]) for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == brute_verdict(t), (i, t[:200])
    assert 20 < sum(k for k, _ in got.values()) < 190


def test_sharding_against_brute_force(spark):
    r = random.Random(29)
    rows = [(r.choice((None, r.randrange(60))), r.choice((None, "", prose(r.randrange(1, 60), k), "é" * r.randrange(300)))) for k in range(200)]
    got = [(x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"]) for x in sharding.assign_shards(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, shard int"), 7).collect()]
    line = sorted(((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), i) for i, t in rows), key=lambda x: x[:4])
    total, before, want, slots = sum(x[2] for x in line), 0, [], collections.Counter()
    for _, _, size, crc, i in line:
        shard = (2 * before + size) * 7 // (2 * total)  # the middle of the row's bytes, on a line cut into equal parts
        want.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    assert sorted(got, key=lambda x: x[3:]) == sorted(want, key=lambda x: x[3:])


def test_clashing_columns_pass_through(spark):
    names = ("kept", "n_words", "clean_text", "item_ids", "passes", "end_key", "__x", "size", "row", "w")
    df = spark.createDataFrame([(1, prose(80, 1), "a", *range(10)), (2, prose(90, 2), "a", *range(10))], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    bench = spark.createDataFrame([(1, prose(40, 99))], "item_id long, text string")
    for out in (quality.filter_quality(df), decontam.drop_contaminated(df, bench), jaccard.keep_one(df), mixing.mix_documents(df)):
        assert out.columns == df.columns and all(tuple(r)[3:] == tuple(range(10)) for r in out.collect()) and out.count() >= 2


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.saved(stage(spark, docs, d), name)
        assert out.count() > 0
        if name != "sharding":
            assert out.dtypes == docs.dtypes, name
        docs = out


def test_anchors_are_the_first_smallest_hash_at_any_place():
    r = np.random.default_rng(3)
    for n, k in ((400, 3), (753, 256), (5000, 2), (40_000, 5)):
        text = runindex.Text(r.integers(0, k, n).astype(np.uint8))
        first, count, anchor, _, at = repeats._text_runs(text, 400, 48)
        hashes = text.grams(48)
        low = np.uint64((2 * 353).bit_length())
        want = [i + int((hashes[i : i + 353] >> low).argmin()) for i in range(n - 399)]
        assert np.repeat(at, count).tolist() == want and (anchor == hashes[at]).all() and (first == np.cumsum(count) - count).all()


def test_anchors_of_a_passage_do_not_depend_on_where_it_stands():
    """Places are kept within two blocks, so that no length of text is too long for them: here, behind five megabytes."""
    passage = np.frombuffer(prose(150, 70).encode(), np.uint8)[:900]
    far = np.concatenate([np.tile(np.arange(97, 105, dtype=np.uint8), (5 << 20) // 8), passage])
    one, two = (set(repeats._text_runs(runindex.Text(t), 400, 48)[2].tolist()) for t in (passage, far))
    assert len(one) > 1 and one <= two


@pytest.mark.parametrize("frequent", [4096, 2])
def test_line_dedup_of_one_long_document_and_its_many_holders(spark, monkeypatch, frequent):
    """A document of 600 lines with as many first holders, one that holds lines for as many others, and many copies: what is
    moved for the pairs grows with the short sides."""
    monkeypatch.setattr(linededup, "FREQUENT", frequent)
    lines = [f"line number {k} of thirty characters" for k in range(600)]
    rows = [(k, f"own text {k}\n{x}\nand an end of its own {k}") for k, x in enumerate(lines)] + [(1000, "\n".join(lines))]
    rows += [(2000, "\n".join(f"first held here, the line {k}" for k in range(600)))] + [(2001 + k, f"first held here, the line {k}\nsomething else {k}") for k in range(600)]
    rows += [(5000 + k, rows[7][1]) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in linededup.dedup_lines(df).collect()}
    assert got == {x[0]: tuple(x[1:]) for x in brute_line_dedup(rows)}
    assert got[1000] == (600, 600, "") and got[2001][2] == "something else 0" and got[5003] == (3, 3, "")
