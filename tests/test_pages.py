"""Rows, cells and events of HTML pages."""

from pathweave.sources import event_pages as ep
from pathweave.sources import markup


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page long, html string")


def rows(spark, *html, **kw):
    found = markup.table_rows(pages(spark, *html), ["page"], **kw).orderBy("page", "nth").collect()
    return [(r.page, r.nth, r.n_rows, [(list(c.strings), list(c.links)) for c in r.cells]) for r in found]


def test_cells_belong_to_the_row_around_them(spark):
    inner = "<table><tr><td>in 1</td><td>in 2</td></tr></table>"
    html = f"<TABLE><tr class='x'><td>a<b> b</b></td>\n<td>before {inner} after</td><TD>last</TD></tr><tr><td></td></tr></TABLE>"
    assert rows(spark, html) == [
        (0, 0, 3, [(["a", "b"], []), (["before", "after"], []), (["last"], [])]), (0, 1, 3, [(["in 1"], []), (["in 2"], [])]), (0, 2, 3, [([], [])])
    ]


def test_what_is_not_closed_costs_only_what_is_around_it(spark):
    html = "<tr><td>1</td></tr><tr><td>2<td>3</tr><tr><td>4</td></tr></td></tr><tr><td>5</td></tr>"
    found = rows(spark, html)
    assert [r[3] for r in found if r[1] in (0, 2)] == [[(["1"], [])], [(["4"], [])]] and all(r[2] == 4 for r in found)
    assert rows(spark, "</td></tr><tr><td>1</td></tr>", "<tr><td>never closed", "</tr>", "", None, "no tags") == [(0, 0, 1, [(["1"], [])])]


def test_texts_links_and_tokens_that_are_no_tags(spark):
    html = """<script>x = "<tr><td>";</script><!-- <tr> --><style>td > a {}</style><tr><td>&lt;a&gt; &amp;amp;  b\n c&nbsp;d <a class="k" HREF='/x?a=1&amp;b=2'>go</a><a name=n></a><br/>e</td><td/><td>2 &gt; 1</td></tr>"""
    assert rows(spark, html) == [(0, 0, 1, [(["<a> &amp; b c d", "go", "e"], ["/x?a=1&b=2"]), (["2 > 1"], [])])]
    assert rows(spark, "<ul><li>1</li><li>2<ul><li>3</li></ul></li></ul>", row="ul", cell="li")[0] == (0, 0, 2, [(["1"], []), (["2"], [])])


def test_pages_are_told_apart_and_long_ones_read(spark):
    many = "".join(f"<tr><td>{i}</td></tr>" for i in range(3000))
    found = rows(spark, many, "<tr><td>x</td></tr>")
    assert len(found) == 3001 and found[2999] == (0, 2999, 3000, [(["2999"], [])]) and found[3000] == (1, 0, 1, [(["x"], [])])
    assert [r.details for r in markup.all_cells(pages(spark, "<td>1<td>2</td></td><td>3 <i>4</i></td>"), ["page"]).collect()] == [[["1"], ["2"], ["3", "4"]]]


def _event(kind, as_info, start, end, url):
    return f"<tr>\n<td>{kind}</td>\n<td></td>\n<td>{as_info}</td>\n<td>{start}</td>\n<td>{end}</td>\n<td><a href='{url}'>More</a></td>\n</tr>"


def test_events_of_a_page(spark):
    listed = [
        _event("Possible Hijack", "<i>Expected Origin AS:</i> A (AS 1)<br/><i>Detected Origin AS:</i> B, US (AS 2)", "2019-08-01 10:00:00", "", "/event/11"),
        _event("Outage ", "N/A", "2019-08-01 11:00:00", "2019-08-02 11:00:00", "/event/12"),
        _event("BGP Leak ", "<i>Origin AS:</i> A (AS 1)<br/><i>Leaker AS:</i> 5 (FIVE)", "2019-08-01 12:00:00", "", "/event/13"),
        _event("Outage ", "A (AS 1)", "no time", "", "/event/14"), "<tr><td>Outage</td></tr>", _event("Outage ", "A (AS 1)", "2019-08-01 11:00:00", "", "/event/none"),
        _event("Outage ", "A (AS 1)", "2019-08-01 11:00:00", "", "/event/15"),
    ]
    page = spark.createDataFrame([("".join(listed) + "<tr><td>x</td></tr>" * 10,), (None,)], "html string").selectExpr("uuid() as page", "html")
    events = ep.listed_events(page, ["page"])
    assert sorted(r.event_number for r in events.collect()) == [11, 12, 13, 15]
    assert ep.listed_events(page, ["page"], drop_last=11).count() == 3
    end = "<td>Path 3 2\n1</td><td>By 7 peers</td>"
    details = [
        ("/event/11", f"<td>Start</td><td>Expected prefix: 2001:db8::/32</td><td>-</td><td>Detected prefix: 2001:db8:1::/48</td><td>-</td>{end}"),
        ("/event/12", "<td>Start</td><td>End</td><td>Number of Prefixes: 30 (4%)</td>"),
        ("/event/13", f"<td>Leaked prefix: 10.0.0.0/8 (AS1 A)</td><td>-</td><td>Leaked To: <li>3 (THREE)</li><li>FOUR (AS 4)</li></td>{end}"), ("/event/15", "no cells"),
    ]
    whole = ep.with_details(events, spark.createDataFrame(details, "url string, html string"))
    (hijack,) = ep.hijacks(whole).collect()
    assert (hijack.expected_origin_name, hijack.expected_origin_number, hijack.detected_origin_name, hijack.detected_origin_number) == ("A", 1, "B, US", 2)
    assert (hijack.expected_prefix.len, hijack.more_specific_prefix.len, hijack.detected_as_path, hijack.detected_by_bgpmon_peers, hijack.end_time) == (32, 48, [3, 2, 1], 7, None)
    (leak,) = ep.leaks(whole).collect()
    assert (leak.leaker_as_name, leak.leaker_as_number, leak.leaked_to_name, leak.leaked_to_number, leak.leaked_prefix.len) == ("FIVE", 5, ["THREE", "FOUR"], [3, 4], 8)
    (outage,) = ep.outages(whole).collect()
    assert (outage.as_name, outage.as_number, outage.number_prefixes_affected, outage.percent_prefixes_affected, outage.end_time is not None) == (None, None, 30, 4, True)
