import random

import numpy as np
import pytest
import xxhash

from rillframe.llm.simhash import BLOCK, Tiling, fingerprint, shingle_hashes, simhash_components, words_of


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius, width):
    fps = [plain_fingerprint(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted([(d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)], key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice((1, 2, 3, 4, 30, 300)))]
        if rows and rng.random() < 0.5:
            base = rng.choice(rows)[1].split()
            if base and rng.random() < 0.8:
                base[rng.randrange(len(base))] = rng.choice(vocab)
        rows.append((i, " ".join(base)))
    return rows


@pytest.mark.parametrize("radius", [0, 2, 6])
def test_components_equal_brute_force(spark, radius):
    rows = corpus(260, radius) + [(900, None), (901, ""), (902, " \t\n"), (None, "w1"), (5, "w1 w2"), (903, "É É x\u000by")]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string").repartition(4)
    got = sorted(map(tuple, simhash_components(df, radius, 3).collect()), key=repr)
    assert got == plain_components(rows, radius, 3)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text():
    text = " ".join(f"x{i % 977}" for i in range(40_000))
    assert fingerprint(shingle_hashes(words_of(text.encode()), 3)) == plain_fingerprint(text, 3)


@pytest.mark.parametrize("tiling", [Tiling(2, 4), Tiling(3, 2), Tiling(12, 1, 6), Tiling(2, 8)])
def test_tiles_skip_no_near_pair(tiling):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.integers(0, 64, rng.integers(0, tiling.radius + 1)):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    size = np.ones(300, np.int64)
    gap = tiling.tiles(b, size) - tiling.tiles(a, size)
    assert set(gap.tolist()) <= set(tiling.neighbours())
    assert BLOCK > 0
