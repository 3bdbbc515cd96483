"""The topic queries fit the published sizes."""

from __future__ import annotations

from motorspark import catalog


def test_topic_queries_have_the_published_sizes(spark):
    factors = catalog.topic_parts(spark, "/root/testdata/sf0.01")[2]
    assert factors.topics.shape == (8, 2000)
