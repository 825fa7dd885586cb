import numpy as np

from ratingloom.llm import near_dedup


def test_an_id_with_two_texts_of_equal_size_is_not_pruned(spark):
    """Node 1 has two sets; its second one is node 2's but for one shingle, and neither is the middle."""
    packed = lambda numbers: np.array(numbers, np.uint64).tobytes()
    sets = spark.createDataFrame([(1, packed(range(100, 120))), (1, packed(range(200, 220))),
                                  (2, packed([*range(200, 219), 300]))], "node long, elements binary")
    rows = spark.createDataFrame([(0, 7, 1, 1), (0, 7, 2, 2)], "band int, key long, node long, component long")
    pairs = near_dedup._left_over_pairs(rows, sets, (80, 100))
    assert [(r.a, r.b) for r in near_dedup.confirmed(pairs, sets, (80, 100)).distinct().collect()] == [(1, 2)]
