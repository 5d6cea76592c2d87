"""What SQL prints and decodes, at the values where libraries differ."""

from pyspark.sql import functions as F

from chunkgraph.functions import text
from chunkgraph.operators import prompts


def test_scores_print_as_in_c(spark):
    ties = [k / 1e3 + 0.0005 for k in range(1100)]
    values = [*(round(x, 6) for x in ties), 0.0, 1.0, 0.999999, 0.000499, 0.000501, 12.3455, *(round(i * 0.000377, 6) for i in range(300))]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", prompts.three_places(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == ["%.3f" % r.x for r in rows]


def test_references_without_a_semicolon():
    page = "<p>a&amp</p><p>b &lt; &#39;&am &ampx; &</p>"
    assert text.html_text(page) == "a&b < '&am &x; &"
    assert text.html_text(page, closed=True) == "a&ampb < '&am &ampx; &"
