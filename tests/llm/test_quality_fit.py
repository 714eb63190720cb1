import numpy as np

from quillmesh.llm import quality


def test_threshold_of_a_table_is_that_of_all_scores(spark):
    rng = np.random.default_rng(4)
    for n in (1, 7, 25_000):
        good = np.round(rng.normal(0.4, 0.6, n), 4)
        poor = np.round(rng.normal(-0.9, 0.7, n), 4)
        rows = [(float(x), True) for x in good] + [(float(x), False) for x in poor]
        df = spark.createDataFrame(rows, "score double, good boolean").repartition(3)
        assert quality.fit_threshold_to(df) == quality.fit_threshold(good, poor)
    assert quality.fit_threshold_to(df.filter("good")) == quality.DEFAULT_THRESHOLD
