import random

import numpy as np
import pytest
import xxhash

from glosspark.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min(x for x in (least.get(c), i) if x is not None) if i is not None or c in least else None
    return fps, [least[c] for c in label]


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 200))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append((i * 3 % n, " ".join(own)))
    return out


def test_against_brute_force(docs):
    rows = texts(150) + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a"), (1004, "A"), (1005, "a b c d"), (7, texts(150)[3][1])]
    fps, comps = brute_components(rows)
    got = simhash.near_duplicates(docs(rows, extra=True)).collect()
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == sorted((i, f, c) for (i, _), f, c in zip(rows, fps, comps))
    assert len({c for c in comps}) < len(rows)


def test_null_ids_and_empty_table(docs):
    got = simhash.near_duplicates(docs([(None, "one two three four five"), (None, None), (4, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.near_duplicates(docs([])).collect() == []


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_masks_share_a_node(n):
    rng = random.Random(n)
    masks = simhash.masks(n, 4)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_tiles_give_the_same(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 62, 5)
    fps = sorted({int(c ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False))) for c in centre for _ in range(80)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")

    def parts(node_rows):
        found = {r.node: r.root for r in simhash.components(simhash.links(df, len(fps), node_rows=node_rows)).collect()}
        return sorted((f, found.get(f, f)) for f in fps)

    assert parts(10**6) == parts(20)
    assert len({r for _, r in parts(20)}) < len(fps)


def test_long_text_in_blocks(docs):
    long = " ".join(f"w{i % 977}" for i in range(230_000))
    assert simhash.fingerprints_of([long.encode(), None, b"x"]).tolist() == [brute_fingerprint(long), 0, brute_fingerprint("x")]


def test_index_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 4), dtype=np.uint64), axis=1) for b in base[:20]]))
    group = (x >> np.uint64(62)).astype(np.int64)
    label = simhash.GrayIndex(x, group, 4, chunk=64).self_join()
    near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 4) & (group[:, None] == group[None, :])
    reach = near.copy()
    for _ in range(8):
        reach = (reach.astype(np.uint8) @ reach.astype(np.uint8)) > 0
    assert ((label[:, None] == label[None, :]) == reach).all()
