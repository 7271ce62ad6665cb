"""Every stage of the pipeline against plain Python, from a small corpus with copies, near copies, junk and leaks."""

import collections
import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from thalweg.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n):
    return " ".join(r.choice("river stone cloud valley amber quiet lantern meadow".split()) + str(r.randrange(300)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(12)
    items = [" ".join(f"item{k}w{j}" for j in range(24)) for k in range(4)] + ["tiny one"]
    texts = []
    for i in range(40):
        texts.append("\n".join(sentence(r, 30) for _ in range(r.randrange(2, 5))))
    for i in range(0, 12, 3):
        texts.append(texts[i])
        near = texts[i].split(" ")
        near[11] = "changed"
        texts.append(" ".join(near))
    for i in (20, 21):
        texts.append(texts[i] + "\nAnd " + items[i % 4] + ".")
    texts.append("Intro.\n" + texts[30] + "\nAll rights reserved by us\nHome | News | About | Contact\n" + "word " * 12)
    texts += [None, "", " \t", "too short.", "x y z " * 60, "\n".join(["no end of a sentence in this line of twelve words or"] * 9), "$$$ " * 80]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "b", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[6] + "\n" + sentence(r, 40), None, "c", 0)], [(k, t) for k, t in enumerate(items)]


def words(text):
    return WORD.findall(text or "")


def line_fails(line):
    symbols = sum(c in quality.SYMBOLS for c in line)
    bare = line.strip(" \t\x0b\x0c\r")
    low = line.lower()
    ended = line.rstrip(" ")[-1:] in (".", "!", "?", "…", '"', ")")
    capitals = sum(c.isupper() for c in line)
    return (
        (quality.PROSE_WORDS - 1 <= line.count(" ") <= quality.PARAGRAPH_WORDS - 2 and bare[-1:] not in quality.ENDS)
        or 100 * symbols > quality.MAX_SYMBOL_PERCENT * len(line)
        or (len(line) <= quality.SHORT_LINE and (any(p in low for p in quality.BOILERPLATE) or (not ended and re.match(quality.NAVIGATION, line) is not None)))
        or (len(line) >= quality.SHOUT_CHARS and not any(c.islower() for c in line) and 2 * capitals > len(line))
    )


def plain_quality(rows):
    out = []
    for i, t, lang, source, _ in rows:
        w = words(t)
        tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
            continue
        lines = t.split("\n")
        good = [x for x in lines if not x.strip(" \t\x0b\x0c\r") or not line_fails(x)]
        count = lambda ls: sum(len(x) for x in ls if x.strip(" \t\x0b\x0c\r"))
        if 100 * count(good) >= count(lines) * (100 - quality.MAX_LOSS_PERCENT):
            text = "\n".join(good)
            out.append((i, text, lang, source, len(text)))
    return out


def plain_near_duplicates(rows):
    sets = []
    for r in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, r in zip(group, rows):
        key = (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())
        best[g] = min(best.get(g, (key, r)), (key, r), key=lambda x: x[0])
    return [r for _, r in best.values()]


def plain_decontamination(rows, items):
    """Whole items here stand as they are, or not at all: contained in order is enough."""
    low = lambda t: [w.lower().strip(".") for w in words(t)]
    inside = lambda a, b: any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))
    return [r for r in rows if not any(len(low(t)) >= 6 and inside(low(t), low(r[1])) for _, t in items)]


def ordered(rows):
    return sorted((tuple(x) for x in rows), key=repr)


def test_stages_against_plain_python(spark, tmp_path, corpus):
    rows, items = corpus
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    good = stage["quality"](spark, docs, str(tmp_path))
    want = plain_quality(rows)
    assert good.dtypes == docs.dtypes and ordered(good.collect()) == ordered(want) and 40 < len(want) < len(rows) - 6
    single = stage["near_duplicates"](spark, good, str(tmp_path))
    want = plain_near_duplicates(want)
    assert single.dtypes == docs.dtypes and ordered(single.collect()) == ordered(want)
    clean = stage["decontamination"](spark, single, str(tmp_path))
    left = plain_decontamination(want, items)
    assert clean.dtypes == docs.dtypes and ordered(clean.collect()) == ordered(left) and len(left) == len(want) - 2
    mixed = stage["mixing"](spark, clean, str(tmp_path))
    assert mixed.dtypes == docs.dtypes
    plan, _ = mixing.plan_mix(clean)
    taken = {r["doc_id"]: (r["size"], r["taken"], r["mix_shards"]) for r in plan.collect()}
    copies = collections.defaultdict(list)
    for r in mixed.collect():
        copies[r["doc_id"]].append(r)
    text = {r[0]: r for r in left}
    for doc, (size, n, shards) in taken.items():
        own = sorted((r["text"] for r in copies[doc]), key=len, reverse=True)
        assert sum(len(words(t)) for t in own) == n and all(t == text[doc][1] for t in own[: n // size]) and len(own) == -(-n // size)
        assert all(text[doc][1].startswith(t) for t in own) and bool(shards) == (n > 0) and shards == sorted(set(shards))
        assert all((r["lang"], r["source"], r["n_chars"]) == (text[doc][2], text[doc][3], len(r["text"])) for r in copies[doc])
    total = sum(n for n, _, _ in taken.values())
    assert abs(sum(n for _, n, _ in taken.values()) - 1.5 * total) <= 5
    mix = [tuple(r) for r in mixed.collect()]
    shards = stage["sharding"](spark, mixed, str(tmp_path)).collect()
    assert ordered((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in shards) == ordered(mix)
    line = sorted(shards, key=lambda r: (r["shard"], r["slot"]))
    sizes = [len((r["text"] or "").encode()) + 8 for r in line]
    assert [r["size"] for r in line] == sizes and all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in line)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"])
    assert [key(r) for r in line] == sorted(map(key, line))
    before = 0
    for r, n in zip(line, sizes):
        assert r["shard"] == (2 * before + n) * 24 // (2 * sum(sizes))
        before += n


def test_whole_run(spark, tmp_path, corpus):
    rows, items = corpus
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = plain_decontamination(plain_near_duplicates(plain_quality(rows)), items)
    assert {r["doc_id"] for r in out} <= {r[0] for r in kept} and {r["law"] for r in out} == {"bytes"}
    assert abs(sum(len(words(r["text"])) for r in out) - 1.5 * sum(len(words(r[1])) for r in kept)) <= 8


def test_line_rules(spark):
    prose = "This line is prose and it ends as sentences end, with a stop."
    fails = [
        "a line of more than ten words which simply breaks off and", "Alle Rechte vorbehalten. Impressum", "Tous droits réservés.", "Todos los derechos reservados.", "Click here", "Conditions d'utilisation", "Home | News | About | Contact",
        "### $$$ ***", "WE SHOUT THIS LINE AT EVERY READER!",
    ]
    keeps = [prose, " ".join(["paragraph"] * 60), "A short heading", "He said: “this line is a quotation of more than ten words, you see”", "ends with a bracket (as lines of ten words or more may do)", "one two three four five six seven eight nine"]
    df = spark.createDataFrame([(k, x + "\n" + "\n".join([prose] * 9)) for k, x in enumerate(fails + keeps)], "doc_id long, text string")
    got = {r["doc_id"]: r["clean_text"] for r in quality.judge(df).collect()}
    for k, x in enumerate(fails + keeps):
        assert got[k].startswith(x) == (x in keeps), x
        assert line_fails(x) == (x in fails), x


def test_mix_shards_fill_their_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 64)
    monkeypatch.setattr(mixing, "SOURCE_BLOCKS", 8)
    r = random.Random(4)
    rows = [(i, "w " * r.randrange(0, 60), r.choice("abbbbbcc")) for i in range(200)]
    plan, _ = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = plan.collect()
    assert {s for x in got for s in x["mix_shards"]} == set(range(mixing.MIX_SHARDS))
    for source in "abc":
        own = sorted((x for x in got if x["source"] == source and x["size"]), key=lambda x: x["key"])
        # In seeded order a source is taken from the front: shards follow one another along it, pass by pass.
        first = [x["mix_shards"][0] for x in own if x["mix_shards"]]
        assert first == sorted(first) and all(len(x["mix_shards"]) <= x["taken"] for x in own)
