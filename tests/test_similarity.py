import numpy as np

from specsift.operators import similarity


def test_ties_beyond_k_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(900, 7)).astype(np.float32)
    m[200:700] = m[0] * 2
    rows = [(int(i), [float(x) for x in m[i]]) for i in rng.permutation(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = {}
    for r in similarity.nearest(df, 15, 150).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == {0, 150, 300, 450, 600, 750}
    for q, by_rank in got.items():
        s = np.zeros(900)
        for d in range(7):
            s += m[:, d].astype(np.float64) * float(m[q, d])
        assert [by_rank[k] for k in range(1, 16)] == [i for i in np.lexsort((np.arange(900), -s)) if i != q][:15]
    assert [got[0][k] for k in range(1, 16)] == list(range(200, 215))
