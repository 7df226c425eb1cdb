"""The Merkle manifest, the packed products with hard negatives, and the circulant MinHash against brute force."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vendorlens.llm import kronecker, merkle, minhash, negatives
from vendorlens.llm.tables import small


def h(*digests):
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][j:j + 2]) for j in range(0, len(out[-1]), 2)])
    return out


def completed(tree):
    """(level, index) in postorder."""
    def visit(level, i):
        if level:
            for child in (2 * i, 2 * i + 1):
                if child < len(tree[level - 1]):
                    yield from visit(level - 1, child)
        yield level, i
    return list(visit(len(tree) - 1, 0))


def test_positions_and_builders():
    for n in range(1, 70):
        tree = levels([hashlib.sha256(bytes([i])).digest() for i in range(n)])
        order = completed(tree)
        assert [merkle.position(level, i, n) for level, i in order] == list(range(len(order)))
        log = merkle.append_log(tree[0], merkle.height_of(n))
        assert log == b"".join(tree[level][i] for level, i in order)
        for leaf, path in zip(tree[0], merkle.leaf_paths(log, n, b"")):
            assert merkle.fold(leaf, path) == tree[-1][0]
        taller = merkle.append_log(tree[0], merkle.height_of(n) + 3)  # a last block within a larger tree
        assert all(merkle.fold(leaf, path) == taller[-32:] for leaf, path in zip(tree[0], merkle.leaf_paths(taller, n, b"")))


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, bits, tmp_path):
    rnd = random.Random(bits)
    rows = [(i if i % 13 else None, rnd.choice(["b", "a", "b", "b", None, "é", "a,b"]), rnd.choice([None, "", "text é", "x" * 50])) for i in range(90)]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "id long, tree string, text string")
    made = merkle.build(df, F.col("tree"), F.col("id"), merkle.digest(F.col("id"), F.col("text")), ["id", "tree", "text"],
                        F.when(F.col("id") % 5 == 0, merkle.digest(F.col("id"), F.lit("other"))), bits)

    def leaf(i, t):
        return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, t)).encode()).digest()
    by = {}
    for i, t, x in rows:
        by.setdefault(t, []).append(((i is not None, i or 0), leaf(i, x)))
    trees = {t: levels([d for _, d in sorted(v)]) for t, v in by.items()}
    keys = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    top = levels([trees[t][-1][0] for t in keys])
    assert made.root == top[-1][0]
    got = merkle.prove(made).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.leaf) == leaf(r.doc.id, r.doc.text) and bytes(r.subroot) == trees[r.doc.tree][-1][0]
        assert merkle.fold(bytes(r.leaf), bytes(r.path)) == made.root
        assert (bytes(r.folded) == made.root) == (r.doc.id is None or r.doc.id % 5 != 0)
        siblings = [s for side, s in merkle.steps(bytes(r.path)) if side != "-"]
        assert bytes(r.proof) == hashlib.sha256("".join(s.hex() for s in siblings).encode()).digest()
    merkle.write_log(made, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    for t in trees:
        name = "" if t is None else "=" + t
        mine = sorted((r.position, bytes(r.digest)) for r in log if r.tree == name)
        assert mine == [(p, trees[t][level][i]) for p, (level, i) in enumerate(completed(trees[t]))]


@pytest.mark.parametrize("low,high,dim", [(-3, 3, 5), (-256, 255, 64), (0, 0, 4), (-(1 << 27), 1 << 27, 64), (-(1 << 20), 7, 33)])
def test_packed_scores(low, high, dim):
    rnd = np.random.default_rng(dim)
    rows, anchors = (rnd.integers(low, high, (n, dim), endpoint=True) for n in (131, 7))
    rows[0], anchors[0] = low, low
    rows[1], anchors[1] = high, high
    packed = kronecker.Packed(rows, low, high)
    assert (packed.fields >= 2) == (high - low < 1000 * 10)
    want = [[sum(int(x) * int(y) for x, y in zip(a, r)) for r in rows] for a in anchors]
    assert packed.scores(anchors).tolist() == want


@pytest.mark.parametrize("block", [3, 8192])
@pytest.mark.parametrize("spread", [2, 300, 1 << 26])
def test_hard_negatives(spark, block, spread):
    rnd = random.Random(spread)
    rows = [(i, rnd.randrange(3), [rnd.randint(-spread, spread) for _ in range(rnd.choice([4, 4, 3]))]) for i in range(160)]
    rows += rnd.sample(rows, 20)
    band = negatives.Band(3, 4, 50, 100)
    got = {tuple(r) for r in negatives.mine(spark.createDataFrame(rows, "id long, label long, v array<long>"), F.col("id") % 10 == 0, band, block).collect()}
    want, unique = set(), sorted({(i, y, tuple(v)) for i, y, v in rows})
    for a, ya, va in unique:
        if a % 10:
            continue
        score = {(i, y): sum(p * q for p, q in zip(va, v)) for i, y, v in unique if i != a}
        order = sorted(score, key=lambda k: (-score[k], k[0]))
        for p in [k for k in order if k[1] == ya][:3]:
            good = [k for k in order if k[1] != ya and 50 * score[p] <= 100 * score[k] <= 100 * score[p]][:4]
            want |= {(a, p[0], rank + 1, k[0], score[p], score[k]) for rank, k in enumerate(good)}
    assert got == want and want


def families(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(8):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([1, 2, 14, 40, 150]))]
        for _ in range(25):
            t = list(base)
            for _ in range(rnd.randint(0, 1 + len(t) // 12)):
                t[rnd.randrange(len(t))] = f"w{rnd.randrange(300)}"
            rows.append((len(rows), " ".join(t)))
    return rows + [(len(rows) + n, rows[n][1]) for n in range(0, 60, 3)]


@pytest.mark.parametrize("k,num,den", [(2, 80, 100), (5, 80, 100), (3, 95, 100)])
def test_minhash_groups(spark, k, num, den):
    rows = families(k)
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_rows_of_one_id_are_one_document(spark):
    a, b = ("alpha beta gamma delta", "one two three four five")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "alone here"), (None, a), (5, None)]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in
           minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {(1, 3): (1, True), (2, 3): (1, False), (2, 4): (1, False), (3, 4): (1, False), (4, 1): (4, True),
                   (None, 3): (None, True), (5, 0): (5, True)}


def test_one_permutation_is_shifted():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64)) for n in (5, 2000, 3000)]
    sets.append(np.unique(np.r_[sets[1][:1800], sets[2][:200]]))
    hashes, row = np.concatenate(sets), np.repeat(np.arange(4), [len(s) for s in sets])
    got = minhash.signatures(hashes, row, 5, 512)
    assert (got[4] == 0xFFFFFFFF).all()
    place = (minhash.mix64(hashes + np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)).astype(np.uint32)
    for k in (0, 1, 511):  # coordinate k is the one permutation, looked up k places further
        x = place + np.uint32(k)
        minhash._pi(x, np.empty_like(x))
        assert [x[row == r].min() for r in range(4)] == got[:4, k].tolist()
    for a, b in ((1, 2), (1, 3), (2, 3)):
        i = len(np.intersect1d(sets[a], sets[b]))
        true = i / (len(sets[a]) + len(sets[b]) - i)
        assert abs((got[a] == got[b]).mean() - true) < 5 * (true * (1 - true) / 512) ** 0.5 + 1e-9
    bands, rows = minhash.banding(80, 100)
    assert (1 - 0.8 ** rows) ** bands < minhash.MISS and bands * 0.16 ** rows < minhash.STRANGE


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_shared_cells_are_dealt_whole(spark, monkeypatch, limit):
    from vendorlens.llm import jaccard
    monkeypatch.setattr(jaccard, "is_small", lambda df: limit > 0)
    rnd = random.Random(9)
    pool = [rnd.getrandbits(64) - (1 << 63) for _ in range(500)]
    rows = [(i, rnd.sample(pool, rnd.randint(0, 12)) + [rnd.getrandbits(63) for _ in range(20)]) for i in range(200)] + [(200, None), (201, [])]
    df = spark.createDataFrame(rows, "cls long, cells array<long>").repartition(3)
    count = {}
    for _, cells in rows:
        for c in cells or []:
            count[c] = count.get(c, 0) + 1
    shared = spark.createDataFrame([(c, n) for c, n in count.items() if n > 1], "cell long, size long")
    got, held = jaccard.deal_shared(df, shared)
    assert (held is None) == (limit > 0)
    assert sorted(map(tuple, got.select("cls", "cell", "size").collect())) == sorted(
        (i, c, count[c]) for i, cells in rows for c in cells or [] if count[c] > 1)


def test_broadcasts_are_measured_in_bytes(spark):
    rows = spark.range(1000).select("id", F.lit("x" * 500).alias("text"))
    assert "broadcast" in small(rows)._jdf.queryExecution().toString() and "broadcast" not in small(rows, 1 << 18)._jdf.queryExecution().toString()
