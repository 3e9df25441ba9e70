import pytest
from pyspark.sql import functions as F

from webloom.functions import urls

CANONICAL = [
    # Ports: only 80 is left out, whatever the scheme.
    ("https://mail.garden.example:443/inbox/new", "https://mail.garden.example:443/inbox/new"),
    ("http://rivers.example:80", "http://rivers.example"),
    ("https://rivers.example:80/delta/", "https://rivers.example/delta"),
    ("https://e.com:8080/p?utm_source=a&PHPsessionid=1", "https://e.com:8080/p"),
    ("http://rivers.example:/map", "http://rivers.example/map"),
    ("http://e.com:port/x", None),
    # www goes as the first label only, and once.
    ("http://old.www.rivers.example/x", "http://old.www.rivers.example/x"),
    ("http://wwwrivers.example/x", "http://wwwrivers.example/x"),
    # Scheme and host are lower-cased, user-info goes, the path stays as it is.
    ("HTTP://User:pw@EXAMPLE.com:443/A/", "http://example.com:443/A"),
    # One slash at the end of the path goes, also before a query; slashes within stay.
    ("http://rivers.example/a//b/", "http://rivers.example/a//b"),
    ("http://rivers.example/list/?q=/", "http://rivers.example/list?q=%2F"),
    # Everything from the first number sign on goes.
    ("http://rivers.example/p#one#two?three=3", "http://rivers.example/p"),
    ("http://rivers.example?z=26#a?b=1", "http://rivers.example?z=26"),
    # Parameters: sorted, the last of a key wins, empty ones go, values keep later equals signs.
    ("http://rivers.example/s?b=2&&a=1&", "http://rivers.example/s?a=1&b=2"),
    ("http://e.com/?k&=v&k=2&k=a=b+c*~", "http://e.com?=v&k=a%3Db%20c%2A~"),
    ("http://e.com/?a=%7E%20%C3%A9&&b", "http://e.com?a=~%20%C3%A9&b="),
    ("http://rivers.example/s?mysession=1&utm_x=2&utmost=3", "http://rivers.example/s?utmost=3"),
    ("http://e.com/?a=%zz", None),
    # No host, no scheme or another one.
    ("http:///x", None),
    ("ftp://e.com/x", None),
    ("e.com/x", None),
    ("http://e.com/a b|c{d}", "http://e.com/a b|c{d}"),
    ("http://[::1]:8080/x", "http://[::1]:8080/x"),
]
DOMAINS = [
    ("https://Deep.Down.In.Rivers.EXAMPLE:81/x?y=a.b", "rivers.example"),
    ("http://rivers.example", "rivers.example"),
    ("http://reader@lake.rivers.example#x.y", "rivers.example"),
    ("http://10.0.0.7/x", "0.7"),
    ("http://rivers.example.", None),
    ("http://localhost/x", None),
    ("nonsense", None),
]
RESOLVED = [
    ("http://e.com/d/p", "a", "http://e.com/d/a"),
    ("http://e.com/d/p", "/b?q#f", "http://e.com/b?q#f"),
    ("http://e.com/d/p", "../c", "http://e.com/c"),
    ("http://e.com/d/p", "../../../c", "http://e.com/c"),
    ("http://e.com/d/p", "./x/./y/", "http://e.com/d/x/y/"),
    ("http://e.com/d/p?z=1", "?q=1", "http://e.com/d/p?q=1"),
    ("http://e.com/d/p", "#f", "http://e.com/d/p"),
    ("http://e.com/d/p", "", "http://e.com/d/p"),
    ("https://e.com/d/p", "//h.org/z", "https://h.org/z"),
    ("http://e.com/d/p", "mailto:a@b.org", "mailto:a@b.org"),
    ("http://e.com/d/p", " http://h.org/a/../b ", "http://h.org/b"),
    ("http://e.com", "a", "http://e.com/a"),
    ("http://e.com/q", "b/.", "http://e.com/b/"),
    ("http://e.com/q", "x?u=/../y", "http://e.com/x?u=/../y"),
]


def column(spark, rows, schema, build):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.select("i", build.alias("out")).orderBy("i").select("out").collect()]


def test_canonical_url(spark):
    out = column(spark, [(u,) for u, _ in CANONICAL], "u string", urls.canonical_url(F.col("u")))
    assert out == [want for _, want in CANONICAL]


def test_canonical_is_stable(spark):
    once = [(want,) for _, want in CANONICAL if want]
    assert column(spark, once, "u string", urls.canonical_url(F.col("u"))) == [u for (u,) in once]


def test_www_and_the_last_slash_go_once(spark):
    twice = [("http://www.www.rivers.example/",), ("http://rivers.example/a//",)]
    assert column(spark, twice, "u string", urls.canonical_url(F.col("u"))) == ["http://www.rivers.example", "http://rivers.example/a/"]


def test_canonical_inside_lambda(spark):
    df = spark.createDataFrame([([u for u, _ in CANONICAL],)], "us array<string>")
    out = df.select(F.transform("us", urls.canonical_url).alias("o")).first().o
    assert out == [want for _, want in CANONICAL]


def test_default_scheme(spark):
    out = column(spark, [("e.com/x",), ("https://e.com",)], "u string", urls.with_default_scheme(F.col("u")))
    assert out == ["http://e.com/x", "https://e.com"]


def test_domain(spark):
    out = column(spark, [(u,) for u, _ in DOMAINS], "u string", urls.domain_of(F.col("u")))
    assert out == [want for _, want in DOMAINS]


def test_resolve(spark):
    build = urls.resolve_link(F.col("b"), F.col("h"))
    assert column(spark, [r[:2] for r in RESOLVED], "b string, h string", build) == [r[2] for r in RESOLVED]


@pytest.mark.parametrize(
    ("build", "want"),
    [
        (urls.site_key, "www.e.com/http://x"),
        (urls.anchor_key, "e.com/http://x"),
    ],
)
def test_keys(spark, build, want):
    assert column(spark, [("https://www.e.com/http://x",)], "u string", build(F.col("u"))) == [want]
