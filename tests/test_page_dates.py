"""When pages say that they were published."""

import datetime

import pytest

from newsloom.functions import dates
from newsloom.functions import html as H
from newsloom.plans import catalog

BODY = "<article><p>" + "word " * 60 + "</p></article>"
#: What stands in a page, its source, and the date.
PAGES = [
    ('<meta property="article:published_time" content="2026-06-03T14:30:00+07:00">', "", "2026-06-03 07:30:00"),
    ('<meta name="article:published_time" content="5/27/2026 2:51:01 PM"><meta name="datetimenow" content="01/06/2026 17:53:32">', "", "2026-05-27 14:51:01"),
    ('<meta name="date" content=" "><meta itemprop="dateModified" content="Wed, 03 Jun 2026 14:30:00 +0700">', "", "2026-06-03 07:30:00"),
    ('<time datetime=" ">x</time><time content="2026-06-03">y</time>', "", "2026-06-03 00:00:00"),
    ('<span class="big date">Thứ năm, 4/6/2026, 09:05 (GMT+7)</span>', "", "2026-06-04 02:05:00"),
    ('<span class="date" content="2026-06-03T01:00:00Z">4/6/2026</span>', "", "2026-06-03 01:00:00"),
    ('<i class="date">04/06/2026 10:00</i><i class="knc-date">03/06/2026 09:00</i>', "genk", "2026-06-03 09:00:00"),
    ('<span class="sc-longform-header-date block-sc-publish-time">28/05/2026 09:00</span>', "diendandoanhnghiep", "2026-05-28 09:00:00"),
    ("<div>Cập nhật: 04/06/2026 | 10:30 GMT+7</div>", "", "2026-06-04 03:30:00"),
    ("<div>lúc 14:30 - 03/06/2026 (GMT+7)</div>", "", "2026-06-03 07:30:00"),
    ("<script>1/1/2020 10:00</script><div>4/6/2026</div>", "", "2026-06-04 00:00:00"),
    ("<div>99/99/2026, 1 Jan 99999999999999999999</div>", "", None),
    ("", "", None),
]


def test_dates_of_pages(spark, tmp_path):
    """page_articles has every accepted page's date."""
    rows = [(i, f"http://e.com/{i}", f"<html><title>t</title>{head}{BODY}</html>") for i, (head, source, _) in enumerate(PAGES) if not source]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.published_at and str(r.published_at) for r in catalog.queries()["page_articles"](spark, str(tmp_path)).collect()}
    assert got == {i: at for i, (_, source, at) in enumerate(PAGES) if not source}


@pytest.mark.parametrize("page, source, at", PAGES)
def test_dates_by_source(page, source, at):
    assert dates.moment(H.published(H.parse(page + BODY), source)) == (at and datetime.datetime.fromisoformat(at))


@pytest.mark.parametrize("text, at", [("03/06/2026 14:30", "2026-06-03 14:30:00"), ("04-06-2026 - 9:15 PM", "2026-06-04 21:15:00"), ("12:05 SA, 4/6/2026", "2026-06-04 00:05:00"), ("<b>4/6/2026</b>", "2026-06-04 00:00:00"), ("0001-01-01T00:00:00+07:00", None), ("1 Jan 99999999999999999999 10:00:00", None), ("4/6/2026 10:00 GMT+99", None), (None, None)])
def test_moments(text, at):
    assert dates.moment(text) == (at and datetime.datetime.fromisoformat(at))
