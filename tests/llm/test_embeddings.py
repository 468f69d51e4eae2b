import numpy as np
import pytest

from tidewell.llm import embeddings

NAN, INF = float("nan"), float("inf")


def rows(seed=0, n=150):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    out = []
    for i in range(n):
        c = centres[i % 12] + r.normal(size=16) * r.choice([0.01, 0.04, 0.1, 1.0])
        out.append((i, [float(np.float32(x)) for x in c * r.choice([1.0, 3.0])], int(i % 12) % 3))
    first = out[5]
    out += [(1000, first[1], first[2]), (1000, first[1], first[2]), (None, first[1], first[2]), (1001, first[1], None), (1002, first[1], 2 if first[2] != 2 else 1)]
    out += [(1003, None, 1), (1004, [], 1), (1005, [0.0] * 16, 1), (1006, [0.0] * 16, 1), (1007, [NAN] + [1.0] * 15, 1), (1008, [INF] + [1.0] * 15, 1), (1009, [None] + [1.0] * 15, 1), (1010, [1.0, 2.0], 1), (1011, [2.0, 4.0], 1)]
    return out


def plain(rows, threshold):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    link = [[False] * n for _ in range(n)]
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(n):
        for b in range(a):
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if p is not None and p == q and fine(x) and fine(y) and len(x) == len(y):
                x, y = np.array(x), np.array(y)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    link[a][b] = link[b][a] = True
                    parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(r[0], least.get(root(k), r[0]))
    return sorted(((r[0], sum(link[k]), least.get(root(k)), r[0] == least.get(root(k))) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile", [16, 1024])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "TILE_SHARE", 0)
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "vec_id long, embedding array<float>, label int, rid string, weight int")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    want = plain(data, 0.98)
    assert got == want
    assert sum(w[1] for w in want) > 100
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 64)) * r.lognormal(0, 2, size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, step, norm, err = embeddings.quantise(x)
    near = (q @ q.T).astype(float) * np.outer(step, step)
    bound = np.outer(norm, err) + err[:, None] + 1e-9
    assert (np.abs(near - x @ x.T) <= bound).all()
    assert (np.abs(q) <= 127).all() and (q == np.rint(q)).all()
