import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glosspark.llm import packing
from glosspark.llm.token_counts import model_path


def test_pieces_against_the_library(docs):
    tk = Tokenizer.from_file(model_path(packing.MODEL))
    texts = ["Hello, World! it's 42", "", None, "a\tb\x0b c\r\nd", "naïve ÀÖ×ß ²¼ µ", "é Σς 数🙂", "<|endoftext|> x <|startoftext|>", "word, " * 6000, "word, " * 6000, "x" * 5000, "'RE 'll don't"]
    rows = list(enumerate(texts)) + [(None, "no id")]
    got = packing.pack(docs(rows, extra=True)).collect()
    by_doc = defaultdict(list)
    seqs = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
    full = [sum(r.length for r in p) for p in seqs.values()]
    assert all(n == 4096 or n & (n - 1) == 0 for n in full)


def test_other_vocabularies_and_bytes_that_are_no_text(spark, docs):
    assert packing.chunk_ids(packing.MODEL).apart and not packing.chunk_ids("byte_bpe_50k.json").apart
    tk = Tokenizer.from_file(model_path("byte_bpe_50k.json"))
    rows = [(1, "two  words\n and more "), (2, " x" * 900), (3, "")]
    got = defaultdict(int)
    for r in packing.pack(docs(rows), model="byte_bpe_50k.json", window=64, end_id=None).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(tk.encode(t, add_special_tokens=False).ids) for i, t in rows if t}
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF2062' AS STRING) AS text")
    want = Tokenizer.from_file(model_path(packing.MODEL)).encode("a\ufffd b", add_special_tokens=False).ids + [2]
    assert sum(r.length for r in packing.pack(odd).collect()) == len(want)


def test_long_chunks_stay_out_of_the_cache():
    ids = packing.ChunkIds(Tokenizer.from_file(model_path(packing.MODEL)), by_word=True)
    ids.ids(b"short " + b"x" * 500 + b" " + "数".encode() * 300)
    assert set(ids) == {b"short"} and max(map(len, ids.words)) <= 64


def test_empty_table(docs):
    assert packing.pack(docs([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.sampled_from([8, 16]))
def test_packer_keeps_every_id(sizes, window):
    packer = packing.Packer(window)
    docs = [np.arange(n, dtype="<u4").tobytes() for n in sizes]
    for k, ids in enumerate(docs):
        packer.add(k, ids)
        assert (packer.counts[1:window] == [len(packer.open[h]) for h in range(1, window)]).all()
    packer.finish()
    got = defaultdict(dict)
    for pieces in packer.closed:
        total = sum(len(p[2]) // 4 for p in pieces)
        assert total == window or total & (total - 1) == 0
        for row, start, ids in pieces:
            got[row][start] = ids
    for k, ids in enumerate(docs):
        assert b"".join(got[k][s] for s in sorted(got[k])) == ids


def test_level_grows_the_sum_of_squares_least():
    rng = np.random.default_rng(0)
    for _ in range(300):
        packer = packing.Packer(12)
        packer.counts[1:12] = rng.integers(0, 4, 11)
        size = int(rng.integers(1, 12))
        h = packer.level(size)

        def cost(h):
            c = packer.counts.copy()
            if h:
                c[h] -= 1
            if h + size < 12:
                c[h + size] += 1
            return (c[1:12] ** 2).sum()

        allowed = [0] + [x for x in range(1, 13 - size) if packer.counts[x]]
        assert h in allowed and cost(h) == min(map(cost, allowed))
