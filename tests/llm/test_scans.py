import hashlib
import random
import re

from chainframe.llm import decontaminate, licenses
from chainframe.llm.licenses import TEMPLATES

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(x):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


@pytest.fixture(scope="module")
def items(rows):
    base = words_of(rows[6][1])
    return [(1, " ".join(base[10:30])), (1, "unseen words only"), (2, "x"), (11, " ".join(base[50:62]).upper()), (3, None), (4, "..."), (None, " ".join(base[60:75])), (5, "ONE-two")]


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for r in rows:
        w = words_of(r[1])
        hit, seen = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    seen |= own
        listed = sorted(str(x) for x in seen if x is not None)
        out.append((r[0], len(w), sum(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), any(hit)))
    return out


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_contamination_equals_brute_force(spark, docs, rows, items, block):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark, block_words=block)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(brute(rows, items), key=str)


def test_decontaminate_removes_spans_or_documents(spark, docs, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hits = brute(rows, items)
    cut = decontaminate.decontaminate(docs, benchmark)
    assert cut.columns == docs.columns
    assert cut.count() == sum(not h[5] or h[2] < h[1] for h in hits)
    before = {r[0]: r[1] for r in rows}
    clean = {h[0] for h in hits if not h[5]}
    assert all(r["text"] == before[r["doc_id"]] for r in cut.collect() if r["doc_id"] in clean)
    assert decontaminate.decontaminate(docs, benchmark, "documents").count() == sum(not h[5] for h in hits)


def test_scans_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty, none).count() == 0
    assert licenses.license_report(empty).count() == 0


def brute_licenses(text, templates):
    """Names of templates of which some run of its class' size plus one shingles holds 75 %, by sets of word tuples."""
    w, found = words_of(text), []
    shingles = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    for name, template in templates:
        t = words_of(template)
        own = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
        size = 4
        while size < len(t) - 4:
            size *= 4
        places = [k for k, x in enumerate(shingles) if x in own]
        if any(100 * len({shingles[p] for p in places if a <= p <= a + size}) >= 75 * len(own) for a in places):
            found.append(name)
    return found


def test_licenses_equal_brute_force(docs, rows, spark):
    rng = random.Random(8)
    more = [(900 + k, "before it all " + text.replace(",", "") + " and after it all", *[None] * 7) for k, (_, text) in enumerate(TEMPLATES)]
    for k, (_, text) in enumerate(TEMPLATES):  # parts, and texts with words changed: around the threshold
        w = text.split()
        more.append((1000 + k, " ".join(w[: rng.randint(len(w) // 2, len(w))]), *[None] * 7))
        more.append((1100 + k, " ".join(x if rng.random() > 0.04 else "changed" for x in w), *[None] * 7))
    both = rows + more
    expected = [(r[0], ",".join(sorted(brute_licenses(r[1], TEMPLATES)))) for r in both]
    found = licenses.license_report(docs.unionByName(spark.createDataFrame(more, docs.schema))).select("doc_id", "licenses").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert all(TEMPLATES[k][0] in dict(expected)[900 + k].split(",") for k in range(len(TEMPLATES)))


def test_templates_from_a_table(docs, spark):
    table = spark.createDataFrame([("one", "a b c d e f"), ("two", "these words are nowhere at all")], "name string, text string")
    texts = spark.createDataFrame([(1, "x A, b c d e f y"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in licenses.license_report(texts, table).select("doc_id", "licenses").orderBy("doc_id").collect()] == [(1, "one"), (2, "")]
