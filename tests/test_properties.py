from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from talaan.functions import html, phones, robots
from talaan.operators.regions import triangulate


@given(st.lists(st.lists(st.text("0123456789+-()/,; loc.", max_size=30), max_size=4), min_size=1, max_size=200))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_normal_phones_stay_as_they_are(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v array<string>").select(phones.normalize(F.col("v")).alias("once"))
    for r in df.select("once", phones.normalize(F.col("once")).alias("twice")).collect():
        assert r.twice == r.once and len(set(r.once)) == len(r.once)
        assert all(p.startswith("+") and p[1:].isdigit() for p in r.once)


@given(st.text(max_size=300))
@settings(max_examples=200)
def test_any_markup_is_read(text):
    links, visible, mails, tels, pages, protected = html.page_parts(text, "https://a.ph/")
    assert isinstance(visible, str) and protected >= 0 and all(len(x) == 2 for x in links)


@given(st.text("/abc*$", max_size=12), st.text("/abc", min_size=1, max_size=12))
def test_allowing_everything_longer_wins(pattern, path):
    assert robots.allows([], path)
    assert robots.allows([(False, pattern or "/"), (True, "/" + "*" * 20)], "/" + path)


@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=3, max_size=9))
def test_triangles_never_exceed_the_ring(points):
    tri, exact = triangulate([[list(map(float, p)) for p in [*points, points[0]]]])
    assert tri.shape[1:] == (3, 2)
    if exact and len(tri):
        assert all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0 for a, b, c in tri)
