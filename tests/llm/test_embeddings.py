import math

import numpy as np

from attestor.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, class string, tile int, id long"


def brute(rows, threshold=E.THRESHOLD):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, parent = len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float64(np.float32(rows[i][1])), np.float64(np.float32(rows[j][1]))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    x, y = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                    parent[y] = x
    return {(rows[i][0], links[i], rows[find(i)][0]) for i in range(n)}


def data(seed, n=120, d=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d))
    rows = [(i, (centres[i % 6] * r.uniform(0.01, 100) + r.normal(size=d) * r.choice([0, 0.1, 0.3])).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * d), (n + 3, [1.0, None] * (d // 2)), (n + 4, [float("nan")] * d), (n + 5, [float("inf")] + [1.0] * (d - 1)), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, rows[0][1])]
    return rows


def test_matches_brute_force(spark):
    for seed, tile in ((1, 16), (2, 1000)):
        rows = data(seed)
        df = spark.createDataFrame([(i, v, 0, "c", 1, 2) for i, v in rows], SCHEMA)
        got = E.near_duplicates(df, tile=tile).collect()
        assert {(r.vec_id, r.n_links, r.component_id) for r in got} == brute(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_error_bound_holds():
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 32)) ** 3
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    q, scale, error = E.quantise(unit)
    approx = (q.astype(float) @ q.astype(float).T) * scale[:, None] * scale[None]
    bound = error[:, None] + error[None] + error[:, None] * error[None]
    assert (np.abs(unit @ unit.T - approx) <= bound).all()


def test_empty_and_repeated_rows(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0]), (None, None)]
    got = E.near_duplicates(spark.createDataFrame([(i, v, 0, "c", 1, 2) for i, v in rows], SCHEMA)).collect()
    assert sorted((r.n_links, r.component_id or 0) for r in got) == [(0, 0), (2, 1), (2, 1), (2, 1)]


def test_one_class_of_a_third_of_all_rows(spark, monkeypatch):
    r = np.random.default_rng(9)
    centre = r.normal(size=8)
    rows = [(i, centre.tolist()) for i in range(150)] + [(150 + i, (centre + r.normal(size=8) * 0.05).tolist()) for i in range(60)] + [(300 + i, r.normal(size=8).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for size, strip in ((8, 32 << 20), (8, 2000), (1000, 1)):
        monkeypatch.setattr(E, "STRIP_BYTES", strip)
        got = {(x.vec_id, x.n_links, x.component_id) for x in E.near_duplicates(df, tile=size).collect()}
        assert got == brute(rows)
