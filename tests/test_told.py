"""Mentions read from a model's answers."""

from evigraph.operators import told


def test_mentions(spark):
    rows = [
        (1, "Who wrote Dune Messiah?", 'Sure:\n```json\n[{"text": "Dune Messiah", "start": 10, "end": 22, "type": "work", "confidence": 0.95}]\n``` done'),
        (2, "is dune good", '[{"text": " Dune ", "start": "8", "confidence": "0.5"}, 7, "x", {"text": null}, {"text": "  "}, {"start": 1}, {"text": "absent"}, {"text": "good", "type": "", "confidence": "high"}]'),
        (3, "a [b] c", "[broken"), (4, "a", "[1] and [2]"), (5, "a", None), (6, None, '[{"text": "Dune"}]'), (7, "Dune", '{"text": "Dune"}'),
        (8, "Dune", '[{"text": "Dune", "start": 3, "end": 3}, {"text": "Du\\"ne]", "start": 0, "end": 4}, {"text": "Dune", "start": -1, "end": 4}]'), (9, "Dune", "[]"), (10, "Dune", '[{"text": "Dune"}] or [more]'), (11, "Dune", '[{"text": "Dune"}], [{"text": "Dune"}]'), (None, "Dune", '[{"text": "Dune"}]'),
    ]
    got = [tuple(r) for r in told.mentions(spark.createDataFrame(rows, "query_id long, query string, output string")).orderBy("query_id", "ord").collect()]
    assert got == [
        (None, 0, "Dune", 0, 4, "unknown", 0.8), (1, 0, "Dune Messiah", 10, 22, "work", 0.95), (2, 0, "Dune", 3, 7, "unknown", 0.5), (2, 7, "good", 8, 12, "unknown", 0.8), (8, 1, 'Du"ne', 0, 4, "unknown", 0.8),
    ]
    assert told.mentions(spark.createDataFrame([], "query_id long, query string, output string")).isEmpty()
