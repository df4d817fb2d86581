import numpy as np

from kairograph.llm import embeddings


def test_vectors_of_every_length_are_compared(spark):
    rng, rows = np.random.default_rng(2), []
    for first, size, number in ((0, 8, 6), (100, 12, 4)):
        for i in range(number):
            v = rng.normal(size=size).tolist()
            rows += [(first + 2 * i, v), (first + 2 * i + 1, [x * 1.0001 for x in v] if i else v)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {i: (1, i - i % 2, i % 2 == 0) for i, _ in rows}
