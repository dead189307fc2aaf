import hashlib
import re
from collections import Counter

from chainframe.llm import near_dup, substring_dedup
from chainframe.llm.text import Words, grams, slide

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def brute_components(rows):
    sets = []
    for i, text, *_ in rows:
        w = SPLIT.findall(lower(text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i, *_ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [(r[0], len(s), None if r[0] is None else top(r[0]), r[0] is None or top(r[0]) == r[0]) for r, s in zip(rows, sets)]


def key(x):
    return tuple((v is None, v) for v in x)


def test_near_duplicates_equal_brute_force(docs, rows):
    found = [tuple(r) for r in near_dup.near_duplicates(docs).collect()]
    assert sorted(found, key=key) == sorted(brute_components(rows), key=key)


def test_open_buckets_are_settled(spark):
    """A chain of texts, each like the next only, and texts that share most, but too little: what a star from one lead can't settle."""
    words = [f"w{k}" for k in range(400)]
    rows = [(100 - k, " ".join(words[6 * k : 6 * k + 60]), *[None] * 7) for k in range(30)]
    rows += [(200 + k, " ".join(words[:40] + [f"u{k}x{n}" for n in range(25)]), *[None] * 7) for k in range(20)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, a int, b int, c int, d int, e int, f int, g int"))
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute_components(rows), key=key)


def test_large_groups_are_split(spark, docs, rows, monkeypatch):
    for name, value in (("PER_SALT", 5), ("PER_STAR", 5), ("PER_BLOCK", 4), ("PER_KEY", 3), ("BROADCAST_IDS", 2)):
        monkeypatch.setattr(near_dup, name, value)
    found = [tuple(r) for r in near_dup.near_duplicates(docs).collect()]
    assert sorted(found, key=key) == sorted(brute_components(rows), key=key)
    test_open_buckets_are_settled(spark)


def test_one_id_on_several_texts(spark):
    """Ids joined by texts of one id; each text's links count, also where another text of the id has none."""
    words = [f"w{k}" for k in range(400)]
    rows = [(50 + k, " ".join(words[6 * k : 6 * k + 60])) for k in range(20)]
    rows += [(50 + k, " ".join(f"v{k}_{n}" for n in range(70))) for k in range(0, 20, 3)] + [(52, rows[9][1]), (70, rows[3][1]), (70, "a b c d e f"), (71, "a b c d e f g")]
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {r[0]: r[2] for r in brute_components(rows)}


def test_near_duplicates_of_nothing(empty):
    assert near_dup.near_duplicates(empty).count() == 0


def brute_removed(rows, window=35):
    words = [SPLIT.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup_equals_brute_force(docs, rows):
    found = [tuple(r) for r in substring_dedup.substring_dedup(docs, log_cells=16).collect()]
    assert sorted(found, key=key) == sorted(brute_removed(rows), key=key)


def test_a_full_sketch_loses_nothing(docs, rows):
    found = [tuple(r) for r in substring_dedup.substring_dedup(docs, log_cells=6).collect()]
    assert sorted(found, key=key) == sorted(brute_removed(rows), key=key)


def test_frequent_runs_are_spread(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    monkeypatch.setattr(substring_dedup, "PER_SALT", 1)
    monkeypatch.setattr(substring_dedup, "SHARD_RUNS", 20)
    assert len(substring_dedup.repeated_runs(docs, 35, 20).hot)
    found = [tuple(r) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(found, key=key) == sorted(brute_removed(rows), key=key)


def test_equal_rows_are_marked_once(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text)] * 40 + [(None, text)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    marks = substring_dedup.repeated_windows(docs)
    assert substring_dedup._marked(docs, marks).selectExpr("max(size(marks))").first()[0] <= 16
    assert {r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == {50}


def test_remove_repeats_keeps_columns_and_clean_texts(docs, rows):
    found = substring_dedup.remove_repeats(docs, log_cells=16)
    assert found.columns == docs.columns and found.count() == len(rows)
    removed = {r[0]: r[2] for r in brute_removed(rows)}
    before = {r[0]: r[1] for r in rows}
    for r in found.collect():
        if not removed[r["doc_id"]]:
            assert r["text"] == before[r["doc_id"]]
        elif r["doc_id"] is not None:
            assert len(SPLIT.findall(r["text"])) == len(SPLIT.findall(before[r["doc_id"]])) - removed[r["doc_id"]]


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.substring_dedup(empty, log_cells=10).count() == 0
    assert substring_dedup.remove_repeats(empty, log_cells=10).count() == 0


def test_grams_and_slides():
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 3, 5, 7, 20, 35):
        g = grams(h, n)
        assert len(g) == len(h) - n + 1 and len(set(g.tolist())) == len(g)
        assert grams(h[3 : 3 + n], n)[0] == g[3]
        assert slide(h, n).tolist() == [min(h[k : k + n].tolist()) for k in range(len(h) - n + 1)]


def test_words_do_not_cross_rows():
    words = Words(pa.array(["a b", None, "", "c", "d e "]))
    assert words.per_row.tolist() == [2, 0, 0, 1, 2]
    codes, distinct = words.codes()
    assert [distinct[c] for c in codes] == [b"a", b"b", b"c", b"d", b"e"]
