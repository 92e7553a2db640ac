import json

import random
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from marketsense.operators import mentions as m
from marketsense.sources import ndjson, pages

TS = 1600000000
RANGE = ("2020-01-01", "2023-12-31")


def lines(spark, *values):
    texts = [v if isinstance(v, str) else json.dumps(v) for v in values]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string")


def outcomes(spark, *values, ticker="msft"):
    parsed = ndjson.parse_lines(lines(spark, *values))
    return [r.outcome for r in m.classified(parsed, ticker, *RANGE).orderBy("n").collect()]


def line(**changes):
    made = {"id": "a", "created_utc": TS, "body": "buy xMSFTx", "score": 1} | changes
    return {k: v for k, v in made.items() if v != "drop"}


def test_outcomes_in_order(spark):
    got = outcomes(
        spark, line(), "{broken", "[1]", "", line(created_utc="nope"), line(created_utc=None), line(created_utc="drop"),
        line(created_utc=1), line(body=None), line(body="nothing"), line(id="drop"), line(id=None), line(score="drop"),
        line(score="12.7"), line(score="many"), line(id="drop", score="drop"),
    )
    assert got == [
        "ok", "malformed", "malformed", "malformed", "malformed", "malformed", "out of range", "out of range", "malformed",
        "no match", "no id", "no id", "no score", "bad score", "bad score", "no id",
    ]


def test_extracted_values(spark):
    rows = [
        line(score=12.7, author="drop", created_utc=str(TS)),
        line(score="12", author=None),
        line(body="drop", title="  MSFT\n", selftext=" up\t"),
        line(body="drop", title="m", selftext="sft"),
        line(score="12.7"),
    ]
    got = m.extract_mentions(lines(spark, *rows), "msft", *RANGE).collect()
    assert [(r.score, r.author, r.body) for r in got] == [
        (12, "[deleted]", "buy xMSFTx"), (12, None, "buy xMSFTx"), (1, "[deleted]", "MSFT up"),
    ]
    assert str(got[0].created_date) == "2020-09-13 12:26:40"
    assert got[0].ticker == "msft"


def test_escaped_text_is_found(spark):
    raw = '{"id":"a","created_utc":%d,"body":"\\u004dSFT","score":1}' % TS
    assert m.extract_mentions(lines(spark, raw), "MSFT", *RANGE).count() == 1


def test_extraction_agrees_with_the_outcomes(spark):
    rows = [line(score=s, id=i, body=b) for s in (1, "2", "2.5", 2.5, None) for i in ("a", None) for b in ("MSFT", "x", None)]
    frame = lines(spark, *rows)
    ok = m.classified(ndjson.parse_lines(frame), "MSFT", *RANGE).where("outcome = 'ok'").count()
    assert m.extract_mentions(frame, "MSFT", *RANGE).count() == ok == 3


def test_range_bounds_are_inclusive_midnights(spark):
    rows = [line(created_utc=t) for t in (1577836799, 1577836800, 1703980800, 1703980801)]
    assert outcomes(spark, *rows) == ["out of range", "ok", "ok", "out of range"]


@pytest.mark.parametrize("more", [0, 1000])
def test_many_tickers_in_one_pass(spark, more):
    df = spark.createDataFrame([(1, "abmsftxaapl msft"), (2, "Aapl"), (3, ""), (4, None), (5, "f")], "n int, body string")
    tickers = ["MSFT", "AAPL", "F", "aapl", "AA", "."] + [f"Q{n}" for n in range(more)]
    got = m.match_tickers(df, tickers).select("n", "ticker").collect()
    apple = ["AA", "AAPL", "aapl"]
    assert sorted((r.n, r.ticker) for r in got) == sorted([(1, "F"), (1, "MSFT"), (5, "F")] + [(n, t) for n in (1, 2) for t in apple])


def test_extraction_of_many_tickers_reads_once(spark):
    frame = lines(spark, line(body="msft and aapl"), line(body="aaplx", id="b"), line(body="none", id="c"))
    tickers = ["MSFT", "AAPL", *[f"Q{n}" for n in range(1000)]]
    found = m.extract_mentions(frame, tickers, *RANGE)
    assert sorted((r.id, r.ticker) for r in found.collect()) == sorted([("a", "AAPL"), ("a", "MSFT"), ("b", "AAPL")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("raw", ["{'id':'1','created_utc':1,'body':'x','score':3}", '{"id":"1"} more', '{"id":"1"},{"id":"2"}', '{"id":"1","score":NaN}', "[1]", "", '{"id":"1"}]', '{"id":"1"} ]', '{"id":"1"}],[{"id":"2"}', '{"id":"}]"}}', '{"id":[{}]},"x":1'])
def test_only_one_whole_object_is_a_line(spark, raw):
    assert ndjson.parse_lines(lines(spark, raw)).first().fields is None


@pytest.mark.parametrize("raw", ['{"id":[{"a":1}]}', '{"id":"}]"}', ' {"id":[{}] } '])
def test_brackets_inside_an_object_are_fine(spark, raw):
    assert list(ndjson.parse_lines(lines(spark, raw)).first().fields) == ["id"]


def test_last_of_repeated_keys_counts(spark):
    assert ndjson.parse_lines(lines(spark, '{"id":"1","x":null,"id":"2"}')).first().fields == {"id": "2", "x": None}


def test_word_counts_respect_boundaries_and_case(spark):
    df = spark.createDataFrame([("AAPL aapl AAPLs Apple apple pineapple éAAPL",)], "body string")
    row = m.word_counts(df, "AAPL", "apple").first()
    assert (row.ticker_count, row.name_count) == (1, 2)


def threads(spark):
    rows = [("w", i, 0, "submission", f"post {i}", f"2024-01-0{1 + i % 3} 0{i % 10}:00:00", i) for i in range(9)]
    rows += [("w", i, k, "comment", "apple", f"2024-01-0{1 + i % 3} 1{k}:00:00", k - 2) for i in range(9) for k in (1, 2, 3)]
    schema = "subreddit string, post_id int, turn int, type string, body string, created string, score int"
    return spark.createDataFrame(rows, schema).withColumn("created_date", F.col("created").cast("timestamp")).drop("created")


def test_latest_posts_and_their_comments(spark):
    posts = m.latest_posts(threads(spark), {"w": 2})
    assert sorted(r.post_id for r in posts.collect()) == [5, 8]
    comments = m.latest_comments(threads(spark), {"w": 2})
    assert sorted((r.post_id, r.score) for r in comments.collect()) == [(5, 0), (5, 1), (8, 0), (8, 1)]
    assert m.latest_posts(threads(spark), {"w": 9}, after="2024-01-03 05:00:00").count() == 1
    assert m.latest_posts(threads(spark), {"other": 5}).count() == 0


def test_current_mentions_of_yesterday(spark):
    got = m.current_mentions(threads(spark), "AAPL", "2024-01-04", {"w": 9})
    assert {str(r.created_date)[:10] for r in got.collect()} == {"2024-01-03"}
    assert got.count() == 6


def test_many_words_are_counted_as_each_alone(spark):
    names = {
        "AA": "alpha", "AAPL": "apple", "BRK": "berkshire", "BRK.B": "berkshire hathaway", "A": "a", "la": "la la", "T": "Alpha", "$X": "x.y", "É": "été",
        "C++": "c+", "a.a": "a.a",
    }
    texts = [
        "AA AAPL AAPLs aapl AA. BRK.B BRK BRK.BX brk.b", "Apple apple pineapple éAAPL AAPLé", "la la la la LA LA", "Berkshire Hathaway BERKSHIRE hathaways",
        "A a A.a a.a.a.a", "pay $X or US$X x.y X.Y.x.y", "É été ÉTÉ Été", "C++ C+ c+x xC++ C++x", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
    got = sorted(map(tuple, m.named_tickers(df, names).select("n", "ticker", "ticker_count", "name_count").collect()))
    want = []
    for ticker, name in names.items():
        alone = m.mentioned(m.word_counts(df, ticker, name))
        want += [(r.n, ticker, r.ticker_count, r.name_count) for r in alone.collect()]
    assert got == sorted(want) and len(got) > 10


def test_one_plan_for_any_number_of_tickers(spark):
    def plan(n):
        names = {f"T{i:04d}": f"company {i}" for i in range(n)}
        found = m.current_mentions(threads(spark), list(names), "2024-01-04", {"w": 9}, names)
        text = found._jdf.queryExecution().executedPlan().toString()
        counted = m.count_outcomes(ndjson.parse_lines(lines(spark, "{}")), list(names), *RANGE)
        return [text.count(word) for word in ("Scan", "Exchange", "Generate", "Project", "Window [")], counted._jdf.queryExecution().optimizedPlan().toString().count("Generate")

    assert plan(2) == plan(1000)


def test_outcomes_of_many_tickers_equal_those_of_each(spark):
    values = ['{"id":"1","created_utc":1600000000,"body":"aa bb","score":1}', '{"id":"2","created_utc":1600000000,"body":"aa","score":"x"}', '{"created_utc":1600000000,"body":"AA","score":1}']
    values += ['{"id":"4","created_utc":9,"body":"aa","score":1}', "{", '{"id":"5","created_utc":1600000000,"body":"none"}', '{"id":"6","created_utc":1600000000,"body":"bb"}']
    parsed = ndjson.parse_lines(lines(spark, *values))
    together = sorted(map(tuple, m.count_outcomes(parsed, ["aa", "bb", "cc"], *RANGE).collect()))
    assert together == sorted(tuple(r) for t in ("aa", "bb", "cc") for r in m.count_outcomes(parsed, t, *RANGE).collect())
    assert dict((r[1], r[2]) for r in together if r[0] == "aa") == {"ok": 1, "bad score": 1, "no id": 1, "out of range": 1, "malformed": 1, "no match": 2}
    assert dict((r[1], r[2]) for r in together if r[0] == "cc") == {"out of range": 1, "malformed": 1, "no match": 5}


def test_newest_threads_equal_posts_and_comments_apart(spark):
    rows = threads(spark)
    posts = m.with_reply_count(m.latest_posts(rows, {"w": 4}), rows)
    want = m.union_posts_comments(posts, m.latest_comments(rows, {"w": 4}))
    got = m.newest_threads(rows, {"w": 4})
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_unknown_company_is_an_error():
    assert m.company_names(["MSFT"]) == {"MSFT": "microsoft"}
    with pytest.raises(ValueError):
        m.company_names(["MSFT", "XXXX"])


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="created_date"):
        m.current_mentions(threads(spark).drop("created_date"), "AAPL", "2024-01-04", {"w": 9})


def test_headlines_prefer_the_inner_element(spark):
    html = '<div class="c">one <b>two</b></div><div class="c"> three<i>!</i> </div><div class="d">no</div>' + '<div class="c">x</div>' * 5
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    got = pages.page_headlines(df, F.lit("s"), pages.element(css_class="c"), pages.element(tag="b")).orderBy("place")
    assert [r.headline for r in got.collect()] == ["two", "three!", "x", "x", "x"]


class _Elements(HTMLParser):
    """Elements of a page with their text, by Python's own parser and a plain stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.all = [], []

    def handle_starttag(self, tag, attrs):
        one = {"tag": tag, "classes": (dict(attrs).get("class") or "").split(), "text": "", "inside": [x["n"] for x in self.open], "n": len(self.all)}
        self.all.append(one)
        if tag not in pages.VOID:
            self.open.append(one)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in pages.VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(x["tag"] == tag for x in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if not self.open or self.open[-1]["tag"] not in ("script", "style"):
            for x in self.open:
                x["text"] += data


def test_headlines_equal_a_parser_with_a_stack(spark):
    rng = random.Random(3)
    stock = ["<div class='hl'>", '<div class="x hl y">', "<div>", "</div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<B class=c>", "<br>", "<br/>", "<div class=hl />", "</section>", "<section>"]
    stock += ["text ", "é", "&eacute;", "&#8217;", "&#x27;", "&amp;lt;", "&unknown;", " & ", "&hellip;", "&#0;", "&#150;", "<!-- <div class='hl'> -->", "<script>if (a<b) '</div>'</script>", "<style>p{}</style>", "1 < 2", "\n"]
    rows = [(i, "".join(rng.choice(stock) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(1000, "<div class=hl>a<div>in</div>tail</div>"), (1001, "<div class=hl>never closed <b>x"), (1002, None), (1003, "<p>a<div class='hl'>b</p>c</div>")]
    df = spark.createDataFrame(rows, "page_id int, html string")
    got = pages.page_headlines(df, F.lit("s"), pages.element(tag="div", css_class="hl"), pages.element(tag="b"))
    want = []
    for page_id, html in rows:
        parser = _Elements()
        parser.feed(html or "")
        parser.close()
        found = [x for x in parser.all if x["tag"] == "div" and "hl" in x["classes"]][:5]
        for place, x in enumerate(found):
            inner = next((y for y in parser.all if y["tag"] == "b" and x["n"] in y["inside"]), x)
            want.append((page_id, place, inner["text"].strip()))
    assert sorted((r.page_id, r.place, r.headline) for r in got.collect()) == sorted(want)
    assert "aintail" in {w[2] for w in want} and len(want) > 200


def test_all_named_references(spark):
    # Python leaves out control signs that are no characters of a page.
    odd = {0xB, *range(1, 9), *range(0xE, 0x20), *range(0x7F, 0xA0), *range(0xFDD0, 0xFDF0)}
    names = [(n, name) for n, name in enumerate(html5, 1) if name.endswith(";") and n not in odd]
    text = [f"a&{name}b&;&#{n};&#x{n:x};" for n, name in names]
    df = spark.createDataFrame(list(enumerate(text)), "n int, t string")
    got = [r.d for r in df.select("n", pages.decode_references(F.col("t")).alias("d")).orderBy("n").collect()]
    assert got == [unescape(t) for t in text] and len(got) > 1900


def test_symbols_of_the_first_table(spark):
    html = "<table><tr><th>Symbol</th></tr><tr><td> BRK.B </td><td>x</td></tr><tr><td>AA</td></tr></table><table><tr><td>no</td></tr></table>"
    df = spark.createDataFrame([(html,)], "html string")
    assert sorted(r.symbol for r in pages.symbols_of_tables(df).collect()) == ["AA", "BRK-B"]


@pytest.mark.parametrize("html", ['<div class="hl big">x &amp;lt; y</div>', "<DIV id=1 CLASS='hl'>x &amp;lt; y</DIV >", "<p class=hl>x &amp;lt; y</p>", '<p class="a hl">x &amp;lt; y</p>'])
def test_elements_by_any_of_their_classes(spark, html):
    df = spark.createDataFrame([(1, f'<p class="hlx">no</p><i data-class="hl">no</i>{html}')], "page_id int, html string")
    got = pages.page_headlines(df, F.lit("s"), pages.element(css_class="hl"), pages.element(tag="b")).collect()
    assert [r.headline for r in got] == ["x &lt; y"]
