import re
from collections import Counter

from chainframe.llm import phrases
from chainframe.llm.phrases import collocations


def brute(rows, longest, least, top, share):
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    found = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in found.items():
        for n in range(2, len(w)):
            for k in range(len(w) - n + 1):
                longer[lang, w[k : k + n]] = max(longer[lang, w[k : k + n]], a)
    out = []
    for (lang, w), a in found.items():
        if 100 * longer[lang, w] >= share * a and longer[lang, w]:
            continue
        cuts = [(10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], words[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, n + 1, *x[1:]) for n, x in enumerate(mine)]
    return sorted(ranked)


def test_collocations_equal_brute_force(spark, docs, rows):
    extra = [("New  york\tcity, NEW YORK. new\nyork", None)] * 6 + [("das ist gut das ist gut das ist", "de"), ("x" * 70_000 + " a b a b", "en"), ("é日 ü é日 ü é日 ü;é日 ü", "é")] * 3
    more = spark.createDataFrame([(None, t, lang, None, None, None, None, None, None) for t, lang in extra], docs.schema)
    whole = [(r[1], r[2]) for r in rows] + extra
    for longest, least, top, share in ((3, 3, 2_000, 50), (4, 2, 40, 80), (2, 4, 10, 50)):
        found = collocations(docs.unionByName(more), longest, least, top, share)
        want = brute(whole, longest, least, top, share)
        assert want and sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == want


def test_buckets_slices_and_a_full_table_change_nothing(spark, docs, monkeypatch):
    want = sorted(map(tuple, collocations(docs, least=3).collect()))
    monkeypatch.setattr(phrases, "SLICE", 1 << 10)
    monkeypatch.setattr(phrases, "MEMORY", "64MB")
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 1 << 9)
    monkeypatch.setattr(phrases, "MOST_LOG_BITS", 9)  # nearly all bits are set
    assert sorted(map(tuple, collocations(docs, least=3).collect())) == want


def test_no_rows_and_exact_scores(spark, empty):
    assert not collocations(empty).collect()
    a, l, r = 3_037_000_500, 3_037_000_501, 3_100_000_007  # noqa: E741  products of 64 bits and more
    row = spark.sql(f"SELECT (CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) DIV (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0))) AS score").first()
    assert row["score"] == 10**6 * a * a // (l * r)
