import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chainframe.llm.bpe import CountTransducer, Pretokens, Remembered, compiled, token_ids
from chainframe.llm.packing import pack, plan_bins
from chainframe.llm.token_count import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pretokens_equal_the_library(library):
    scanner, transducer, _ = compiled(PATH)
    rng = random.Random(1)
    alphabet = " '\n\tstrevlmdabZ19.,!é日 　\x1c²"
    every = "".join("a" + chr(c) + "a1" + chr(c) + "1 " for c in range(0x33000) if not 0xD800 <= c < 0xE000)
    for text in [every, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(2000))]:
        pre = Pretokens(scanner, pa.array([text]), transducer.special)
        assert [pre.distinct[c] for c in pre.codes] == [text[a:b].encode() for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_counts_equal_the_library(library):
    scanner, transducer, _ = compiled(PATH)
    rng = random.Random(2)
    parts = ["the", "<|endoftext|>", "<|endo", "ing", " ", "re", "'", "anon", "on", "ion", "\n", "é", "12", "!!!", "日本", "😀", "ÃÂÃÂ", "     "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["a" * 5000, " " * 3000, "ab" * 2000]
    pre = Pretokens(scanner, pa.array(texts), transducer.special)
    count = np.append(transducer.counts(pre.distinct), 1)
    upto = np.concatenate([[0], np.cumsum(count[pre.codes])])
    assert np.diff(upto[pre.first]).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_pretokens_are_composed_of_chunks(library, monkeypatch):
    transducer = compiled(PATH)[1]
    monkeypatch.setattr(CountTransducer, "CHUNK", 24)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé日") for _ in range(n)) for n in (*range(20, 60), 300, 4000)] + ["a" * 5000, "the" * 900, "ab" * 700]
    assert transducer.counts([w.encode() for w in words]).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    small = CountTransducer(PATH)
    small.most = 60  # begun anew again and again
    assert small.counts([w.encode() for w in words[:30]]).tolist() == transducer.counts([w.encode() for w in words[:30]]).tolist()


def test_ids_equal_the_library(library):
    rng = random.Random(9)
    alphabet = " '\n\t<|>endoftxab19.,é日😀\x1c"
    texts = ["<|endoftext|>", "<|endoftext|", "a<|<|endoftext|>|>", "", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    ids, at = token_ids(pa.array(texts), PATH)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_values_are_bounded():
    known = Remembered(2_000)
    for k in range(50):
        keys = [b"%d" % n for n in range(k, k + 7)]
        assert known.of(keys, lambda new: [int(x) for x in new]) == list(range(k, k + 7))
        assert len(known.new) + len(known.old) < 40


def test_token_counts_of_documents(docs, rows, empty, library):
    found = sorted((tuple(r) for r in token_counts(docs, PATH).collect()), key=str)
    texts = [r[1] or "" for r in rows]
    sizes = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert found == sorted(((r[0], len(t.encode()), n, n > 512) for r, t, n in zip(rows, texts, sizes)), key=str)
    assert token_counts(empty, PATH).count() == 0


def test_packing(docs, rows, empty, library):
    found = pack(docs, PATH).toPandas()
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    for r in found.itertuples():
        if r.doc_id == r.doc_id:
            own = ids[int(r.doc_id)]
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
            assert r.piece == 0 or r.length == 1024
    assert found["length"].sum() == sum(len(ids[r[0]]) for r in rows)
    found = found.sort_values(["sequence_id", "offset"])
    sizes = found.groupby("sequence_id")["length"]
    assert (sizes.cumsum() - found["length"] == found["offset"]).all() and sizes.sum().max() <= 1024
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 1024) + 1
    assert pack(empty, PATH).count() == 0


def test_plans_fill_bins():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([10, 30, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 14))}
        bins, seen = {}, dict.fromkeys(counts, 0)
        plan = plan_bins(counts, capacity)
        for k, (n, rank, copies, first, offset) in enumerate(plan):
            end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == n else counts[n]
            assert rank == seen[n]
            for r in range(end - rank):
                bins.setdefault(first + r // copies, []).append((offset + r % copies * n, n))
            seen[n] = end
        assert seen == counts
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity
