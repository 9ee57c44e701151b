import numpy as np
import xxhash

from tessella.llm import simhash


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def brute(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(fps):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i, f"{f:016x}", least[find(n)]) for n, (i, f) in enumerate(fps))


def got(df):
    return sorted(tuple(r) for r in simhash.digest(df).select("doc_id", "fingerprint", "component_id").collect())


def test_equals_brute_force_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def _noisy(rng, n, families):
    base = rng.integers(0, 2**64, families, dtype=np.uint64)
    out = base[rng.integers(0, families, n)]
    for _ in range(4):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) * rng.integers(0, 2, n, dtype=np.uint64)
    return np.unique(out)


def _classes(values, pairs):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, groups.values()))


def _want(values):
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    return _classes(values, [(values[a], values[b]) for a, b in zip(*np.nonzero(near)) if a < b])


def test_trees_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = np.unique(np.r_[_noisy(rng, 3000, 300), _noisy(rng, 1500, 1)])
    monkeypatch.setattr(simhash, "SHARD", 64)
    fps = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    edges = simhash.linked(fps, len(values))
    tree = {r.node: r.root for r in simhash.components(edges).collect()}
    own = values.view(np.int64).tolist()
    found = _classes(own, [(v, tree.get(v, v)) for v in own])
    u = values.tolist()
    want = sorted(sorted(int(np.uint64(x).view(np.int64)) for x in g) for g in _want(u))
    assert found == want


def test_long_chain_is_one_component(spark):
    chain = [0]
    for i in range(21):
        chain.append(chain[-1] ^ (7 << (3 * i)) if 3 * i + 3 <= 63 else chain[-1] ^ 1 << 63)
    edges = spark.createDataFrame([(a - 2**63, b - 2**63) for a, b in zip(chain, chain[1:])], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {min(c - 2**63 for c in chain)}


def test_odd_rows(odd):
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(odd).collect()}
    assert out[5] == out[3] == out[9] == ("0" * 16, 3)
    assert out[1][1] == out[2][1] == 1 and out[8][1] == 4
    assert out[None][1] is None
    assert simhash.digest(odd).count() == odd.count()


def test_empty_table(make):
    assert got(make([])) == []
