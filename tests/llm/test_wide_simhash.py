"""The wide, bit-sliced near-duplicate stage against brute force."""

import numpy as np
import pytest

from ledgerweave.llm import simhash, wide_simhash


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 7, 8, 46])
def test_bit_sliced_distances_match_brute_force(radius):
    rng = np.random.default_rng(radius)
    lanes = 4 if radius > 3 else 1
    values = rng.integers(0, 1 << 63, (60, lanes), dtype=np.uint64)
    for i in range(1, 60, 2):  # near pairs, about at the radius
        values[i] = values[i - 1]
        for bit in rng.choice(64 * lanes, min(radius + int(rng.integers(-1, 3)), 64 * lanes) if radius else int(rng.integers(0, 2)), replace=False):
            values[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    apart = lambda a, b: sum(int(x).bit_count() for x in values[a] ^ values[b])
    groups = np.arange(60) // 20
    a, b = simhash.bit_sliced_links(values, groups, radius)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if groups[i] == groups[j] and apart(i, j) <= radius}
    got = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got <= want
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in got:
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i, j in want)


@pytest.mark.parametrize("hot", [4, 4096])
def test_near_copies_go_and_clean_documents_stay(spark, hot, monkeypatch):
    monkeypatch.setattr(wide_simhash.wide_links, "__defaults__", (wide_simhash.RADIUS, hot))
    rng = np.random.default_rng(3)
    words = lambda n: ["w" + str(x) for x in rng.integers(0, 10**6, n)]
    rows, first = [], set()
    for g in range(20):
        base = words(200)
        first.add(g * 100)
        rows.append((g * 100, " ".join(base)))
        for c in range(1, 8):
            copy = base.copy()
            for at in rng.choice(200, 3, replace=False):  # a similarity of about 0.86
                copy[at] = "edit" + str(c)
            rows.append((g * 100 + c, " \n".join(copy).upper()))
    clean = {5000 + i for i in range(100)}
    shared = words(60)
    rows += [(i, " ".join(shared + words(140))) for i in clean]  # a similarity of about 0.2
    rows += [(9000, None), (9001, ""), (9002, "one"), (9003, "One"), (9004, "two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in wide_simhash.keep_first(frame).collect()}
    assert got == first | clean | {9000, 9002, 9004}


def test_similarity_of_the_contract_decides_exactly(spark):
    rng = np.random.default_rng(8)
    words = lambda n: ["w" + str(x) for x in rng.integers(0, 10**6, n)]
    rows, want = [], set()
    for g in range(80):
        base = words(184)  # 180 shingles; k changed words at the end leave 180 - k of 180 + k in common
        rows.append((3 * g, " ".join(base)))
        rows.append((3 * g + 1, " ".join(base[:164] + words(20))))  # 160 of 200: 0.8
        rows.append((3 * g + 2, " ".join(words(26) + base[26:])))  # 154 of 206: 0.748
        want |= {3 * g, 3 * g + 2}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in wide_simhash.keep_first(frame).collect()} == want
