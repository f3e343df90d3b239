"""Features that fits read many times are written once."""

from touchline.plans.fitted import featured
from touchline.sources.synthetic import table


def test_features_are_a_written_table(spark):
    got = featured(table(spark, "/root/testdata/sf0.001", "syn_snapshots"))
    assert got.inputFiles() and all("/features-" in f for f in got.inputFiles())
    assert got.count() == table(spark, "/root/testdata/sf0.001", "syn_snapshots").count()
