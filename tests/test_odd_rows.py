"""Queries against their DuckDB equivalents on rows that the smallest tables lack."""

import duckdb
import pytest

from newsloom.plans import catalog


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query and of its SQL over one given table."""

    def run(query: str, name: str, rows: list[tuple], schema: str) -> tuple[list[tuple], list[tuple]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        got = catalog.queries()[query](spark, str(tmp_path))
        want = con.execute(catalog.oracle_sql()[query]).df()[got.columns].astype(object)
        return sorted(map(tuple, got.collect())), sorted(map(tuple, want.where(want.notna(), None).itertuples(index=False)))

    return run


def test_mentions_share_no_separator(both):
    texts = ["the\nthe", "the the", "The-the the\n\nthe", "other theme", "", None, "thé_the the.", "the"]
    got, want = both("mention_counts", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want and [n for _, n in got] == [1, 2, 3, 0, 0, None, 1, 1]


def test_titles_are_unescaped_once(both):
    titles = ["and&amp", "a &amp;amp; b", "&lt;b&gt; &quot;x&#x27; &copy;", " a \n\t b ", "", "A&amp;&amp;B", "one</title><title>two"]
    rows = [(i, "http://e.com/", f"<html><title>{t}</title><p>x</p>") for i, t in enumerate(titles)]
    got, want = both("page_titles", "pages", [*rows, (97, "", "<p>none</p>"), (98, None, None), (99, "", "")], "page_id long, url string, html string")
    assert got == want and [t for _, t in got] == ["and&amp", "a &amp; b", "<b> \"x' &copy;", "a b", "", "A&&B", "one", "", None, ""]


def test_pages_are_parsed_one_by_one(spark):
    """Trees of pages go as soon as they are read, without the collector of cycles; parts and keys stay together over many hand-overs."""
    import gc

    from newsloom.functions import html
    from newsloom.operators import ingest

    gc.collect()
    gc.disable()
    try:
        root = html.parse("<div><p>a<b>c</b></p></div>" * 50)
        html.dismantled(root)
        del root
        assert not [x for x in gc.get_objects() if isinstance(x, html.Node)]
    finally:
        gc.enable()
    filler = "x" * (ingest.HELD // 3)
    rows = [(i, "http://e.com/", None if i == 3 else f'<title>{i}</title><p>{filler}</p><a href="/{i}">t</a><img src="/{i}.jpg" alt="a">') for i in range(10)]
    got = ingest.pages(spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(1), parts=("title", "links", "images")).collect()
    assert [(r.page_id, r.page.title) for r in got] == [(i, "" if i == 3 else str(i)) for i in range(10)]
    assert all([x.url for x in r.page.links] == [f"http://e.com/{r.page_id}"] and [tuple(x) for x in r.page.images] == [(0, f"http://e.com/{r.page_id}.jpg", "a", "")] for r in got if r.page_id != 3)


def test_folding_takes_the_short_way_for_ascii_only(spark):
    """Texts of one byte a letter and others give the same tokens and folded texts as word by word."""
    import re

    from pyspark.sql import functions as F

    from newsloom.functions import text as T

    texts = ["", "A", "AB-C ab aB AB99 99 -- X1 ABCDEFGH ABCDEFGHI TP.HCM VN-INDEX", "ÑU Ñandú ÉÉ-9 éA ĐĐ Đđ ß ABC", "AB’CD TP.HCM", None]

    def wanted(t: str) -> list[str]:
        words = re.findall("[A-Za-z0-9À-ỹĐđ-]+", t or "")
        bare = lambda w: w.lower().translate(str.maketrans("ñéúđ", "neud"))
        return sorted([bare(w) for w in words if len(w) >= 2] + [w for w in words if w == w.upper() != w.lower() and 2 <= len(w) <= 8])

    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.tokens(F.col("text")).alias("tokens"), T.ascii_only(F.col("text")).alias("plain")).collect()
    assert [sorted(r.tokens) for r in got] == [wanted(r.text) for r in got] and [r.plain for r in got] == [True, True, True, False, False, None]
