"""Forum lines, mentions, live threads, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketsense import fixtures
from marketsense.operators import mentions as m
from marketsense.sources import ndjson, pages

START, END = "2020-01-01", "2023-12-31"
LIMITS = {"sub0": 100, "sub1": 50, "sub2": 25}
AS_OF = "2024-01-02"
NAME = "la"
TICKERS = ["that", "the", "for", "und"]
# Tickers with company names; one name stands for two tickers, one ticker starts another.
NAMES = {"La": "la", "The": "el", "Un": "the", "Un la": "la", "los": "y el"}


def _parsed(spark, sf):
    return ndjson.parse_lines(fixtures.table(spark, sf, "raw_lines"))


def _threads(spark, sf):
    return fixtures.table(spark, sf, "threads")


def _scan(spark, sf):
    """A dump of many small frames, cut inside lines, read back by ranges that hold a few frames each."""
    folder = ndjson.rewrite_dump(fixtures.table(spark, sf, "raw_lines").select("value"), "lines", frame_bytes=1 << 16)
    return ndjson.scan_ndjson(spark, folder, split_bytes=1 << 17).select("value")


def _parse_raw(spark, sf):
    fields = F.col("fields")
    return _parsed(spark, sf).select(
        "doc_id",
        fields.isNotNull().alias("parsed"),
        F.try_element_at(fields, F.lit("id")).alias("id"),
        F.try_element_at(fields, F.lit("created_utc")).alias("created_utc"),
        F.try_element_at(fields, F.lit("author")).alias("author"),
        F.try_element_at(fields, F.lit("score")).alias("score"),
    )


def _in_range(spark, sf):
    rows = _parsed(spark, sf).withColumn("seconds", m.epoch_seconds(F.col("fields")))
    return rows.where(m.in_range(F.col("seconds"), START, END)).select("doc_id", "seconds")


def _text(spark, sf):
    rows = _parsed(spark, sf).select("doc_id", m.mention_text(F.col("fields")).alias("body"))
    return rows.where(F.col("body").isNotNull())


def _scores(spark, sf):
    rows = m.read_fields(_parsed(spark, sf))
    return rows.select("doc_id", m.tx.json_integer(F.col("fields"), F.col("value"), "score").cast("string").alias("score"))


def _coerced(spark, sf):
    rows = m.coerce_dates(fixtures.table(spark, sf, "dirty_mentions"))
    return rows.select("ticker", "id", "author", F.col("created_date").cast("timestamp_ntz").alias("created_date"))


def _naive(df):
    return df.withColumn("created_date", F.col("created_date").cast("timestamp_ntz"))


def _union(spark, sf):
    rows = m.newest_threads(_threads(spark, sf), LIMITS)
    return _naive(rows.withColumn("comments", F.col("comments").cast("double")))


def _headlines(spark, sf, table="pages", **outer):
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    found = pages.page_headlines(fixtures.table(spark, sf, table), host, pages.element(**outer), pages.element(tag="b"))
    return found.withColumn("place", F.col("place").cast("bigint"))


def _news(spark, sf):
    rows = fixtures.table(spark, sf, "pages").select(
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        (F.lit(1704067200) + F.col("page_id") * 60).alias("publish_time"),
    )
    frame = pages.news_frame(rows)
    return frame.withColumn("date", F.col("date").cast("timestamp_ntz"))


QUERIES = {
    "scan_ndjson": _scan,
    "parse_raw_lines": _parse_raw,
    "extract_mentions": lambda s, d: _naive(m.extract_mentions(fixtures.table(s, d, "raw_lines"), TICKERS, START, END)),
    "mentions_in_range": _in_range,
    "mention_text": _text,
    "mentions_substring": lambda s, d: m.match_tickers(
        fixtures.table(s, d, "documents").select("doc_id", F.col("text").alias("body")), TICKERS
    ).select("doc_id", "ticker"),
    "mention_rejects": lambda s, d: m.count_outcomes(_parsed(s, d), TICKERS, START, END),
    "mention_score_cast": _scores,
    "coerce_dates": _coerced,
    "yesterday_mentions": lambda s, d: _naive(m.yesterday(_threads(s, d), AS_OF)),
    "mention_word_counts": lambda s, d: m.word_counts(_threads(s, d), "La", NAME).select(
        "post_id", "turn", "ticker_count", "name_count"
    ),
    "current_mentions": lambda s, d: _naive(m.current_mentions(_threads(s, d), list(NAMES), AS_OF, LIMITS, NAMES)),
    "latest_posts": lambda s, d: _naive(m.latest_posts(_threads(s, d), LIMITS)),
    "latest_comments": lambda s, d: _naive(m.latest_comments(_threads(s, d), LIMITS)),
    "union_posts_comments": _union,
    "mentions_preview": lambda s, d: _naive(m.preview(fixtures.table(s, d, "mentions"))),
    "ticker_universe": lambda s, d: pages.ticker_universe(fixtures.table(s, d, "symbols")),
    "page_headlines": lambda s, d: _headlines(s, d, tag="p"),
    "class_headlines": lambda s, d: _headlines(s, d, "classes", tag="div", css_class="ad"),
    "nested_headlines": lambda s, d: _headlines(s, d, "nested", tag="div", css_class="ad"),
    "news_frame": _news,
}

_SPACE = fixtures.SPACE


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


# One row per line with the JSON members; invalid lines and non-objects give null.  Of a repeated id
# the last one counts, and NaN, which DuckDB lets pass, is no JSON.
_FIELDS = f"""{fixtures.ctes("raw_lines")},
single as (select doc_id, replace(value, '"id":"first",', '') as value from raw_lines),
objects as (select doc_id, case when json_valid(value) and json_type(value) = 'OBJECT' and not contains(value, '"score":NaN') then value::json end as j from single),
fields as (
  select doc_id, j, j is not null as parsed, j->>'id' as id, j->>'created_utc' as created_utc, j->>'author' as author, j->>'score' as score,
         case when j is null then null when json_exists(j, '$.created_utc') then try_cast(j->>'created_utc' as double) else 0.0::double end as seconds,
         case when json_exists(j, '$.body') then {_strip("(j->>'body')")}
              when not json_exists(j, '$.body') then {_strip(
                  "concat(" + _strip("case when json_exists(j, '$.title') then j->>'title' else '' end") + ", ' ', "
                  + _strip("case when json_exists(j, '$.selftext') then j->>'selftext' else '' end") + ")")} end as body,
         case when json_type(j->'score') = 'VARCHAR' then case when regexp_full_match(j->>'score', '[+-]?[0-9]+') then cast(j->>'score' as bigint) end
              else cast(trunc(try_cast(j->>'score' as double)) as bigint) end as score_int
  from objects),
outcomes as (
  select *, case when seconds is null then 'malformed'
       when not seconds between epoch(timestamp '{START}') and epoch(timestamp '{END}') then 'out of range'
       when body is null then 'malformed' when not contains(upper(body), upper(ticker)) then 'no match'
       when id is null then 'no id' when score is null then 'no score' when score_int is null then 'bad score' else 'ok' end as outcome
  from fields, (values {', '.join(f"('{t}')" for t in TICKERS)}) w(ticker))"""

_LIMITED = f"""{fixtures.ctes("threads")},
limits(subreddit, n) as (values {', '.join(f"('{k}', {v})" for k, v in LIMITS.items())}),
posts as (
  select t.* exclude (rn) from (select *, row_number() over (partition by subreddit order by created_date desc, post_id desc) as rn
                                from threads where type = 'submission') t join limits using (subreddit) where rn <= n),
comments as (select t.* from threads t semi join posts p on p.post_id = t.post_id and p.subreddit = t.subreddit where t.type = 'comment' and t.score >= 0),
latest as (select * from posts union all select * from comments)"""

# DuckDB's word boundary is ASCII only: write other letters as an ASCII one first.
_ASCII = "regexp_replace(body, '[\\x{C0}-\\x{24F}]', 'z', 'g')"
_COUNTS = f"""len(regexp_extract_all({_ASCII}, '\\bLa\\b')) as ticker_count, len(regexp_extract_all({_ASCII}, '(?i)\\b{NAME}\\b')) as name_count"""
_YESTERDAY = f"created_date >= date '{AS_OF}' - interval 1 day and created_date < date '{AS_OF}'"

# The references that the test pages use; the ampersand last.
_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00a0", "&copy;": "©", "&middot;": "·", "&eacute;": "é", "&#8217;": "’", "&#x27;": "'", "&amp;": "&"}
_CLASS_AD = """(?is)<div\\s(?:[^>]*\\s)?class\\s*=\\s*(?:"(?:[^"]*\\s)?ad(?:\\s[^"]*)?"|''(?:[^'']*\\s)?ad(?:\\s[^'']*)?'')[^>]*>"""


def _decoded(text: str) -> str:
    for reference, char in _REFERENCES.items():
        text = "replace({}, '{}', '{}')".format(text, reference, char.replace("'", 2 * "'"))
    return text


def _headline_sql(outer: str, source: str) -> str:
    """The tags of a page one after the other, with the stack of open elements."""
    void = ", ".join(f"'{name}'" for name in pages.VOID)
    content = "list_filter(toks[(spot + 2):(till)], lambda x: not starts_with(x, '<') or x = '<')"
    return f"""tokens as (
  select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as source, regexp_extract_all(html, '{pages.TOKEN}') as toks from {source}),
places as (select page_id, unnest(toks) as tok, generate_subscripts(toks, 1) - 1 as place from tokens),
tags as (
  select page_id, list(struct_pack(name := lower(regexp_extract(tok, '{pages.TAG}', 1)), place := place,
           kind := case when starts_with(tok, '</') then -1 when ends_with(tok, '/>') or lower(regexp_extract(tok, '{pages.TAG}', 1)) in ({void}) then 0 else 1 end)
           order by place) as tags
  from places where regexp_matches(tok, '{pages.TAG}') and not regexp_matches(tok, '{pages.RAW}') group by page_id),
fold as (
  select page_id, 1 as i, cast([] as struct(name varchar, spot bigint)[]) as stack, cast([] as struct(spot bigint, till bigint)[]) as done from tags
  union all
  select page_id, i + 1,
         case when kind = 1 then list_append(stack, struct_pack(name := name, spot := place)) when kind = -1 and above > 0 then stack[:len(stack) - above] else stack end,
         case when kind = -1 and above > 0 then list_concat(done, list_transform(stack[len(stack) - above + 1:], lambda x: struct_pack(spot := x.spot, till := place))) else done end
  from (select f.*, t.tags[i].name as name, t.tags[i].place as place, t.tags[i].kind as kind,
               coalesce(list_position(list_reverse(list_transform(stack, lambda x: x.name)), t.tags[i].name), 0) as above
        from fold f join tags t using (page_id) where i <= len(t.tags)) s),
spans as (
  select page_id, unnest(list_concat(done, list_transform(stack, lambda x: struct_pack(spot := x.spot, till := cast(len(toks) as bigint))))) as span
  from fold join tags using (page_id) join tokens using (page_id) where i = len(tags) + 1),
elements as (select s.page_id, span.spot as spot, span.till as till, tok from spans s join places p on p.page_id = s.page_id and p.place = s.span.spot),
outers as (
  select * from (select page_id, spot, till, row_number() over (partition by page_id order by spot) - 1 as nth from elements where regexp_full_match(tok, '{outer}')) o where nth < 5),
inners as (select page_id, spot, till from elements where regexp_full_match(tok, '(?is)<b(?:[\\s/][^>]*)?>')),
firsts as (select o.page_id, o.nth, min_by(struct_pack(spot := n.spot, till := n.till), n.spot) as span from outers o join inners n on n.page_id = o.page_id and n.spot > o.spot and n.spot < o.till group by all),
chosen as (select o.page_id, o.nth, coalesce(f.span.spot, o.spot) as spot, coalesce(f.span.till, o.till) as till from outers o left join firsts f on f.page_id = o.page_id and f.nth = o.nth)
select page_id, source, nth as place, {_strip(_decoded(f"array_to_string({content}, '')"))} as headline from chosen join tokens using (page_id)"""


_WANTED = ", ".join(f"('{t}')" for t in TICKERS)

ORACLES = {
    "scan_ndjson": f"{fixtures.ctes('raw_lines')} select value from raw_lines",
    "parse_raw_lines": f"{_FIELDS} select doc_id, parsed, id, created_utc, author, score from fields",
    "extract_mentions": f"""{_FIELDS} select ticker, make_timestamp(cast(seconds * 1000000 as bigint)) as created_date,
case when json_exists(j, '$.author') then author else '[deleted]' end as author, body, score_int as score, id from fields join (values {_WANTED}) w(ticker) on contains(upper(body), upper(ticker))
where seconds between epoch(timestamp '{START}') and epoch(timestamp '{END}') and id is not null and score_int is not null""",
    "mentions_in_range": f"""{_FIELDS} select doc_id, seconds from fields
where seconds between epoch(timestamp '{START}') and epoch(timestamp '{END}')""",
    "mention_text": f"{_FIELDS} select doc_id, body from fields where parsed and body is not null",
    "mentions_substring": f"""select doc_id, ticker from documents
join (values {_WANTED}) w(ticker) on contains(upper(text), upper(ticker))""",
    "mention_rejects": f"{_FIELDS} select ticker, outcome, count(*) as n_lines from outcomes group by all",
    "mention_score_cast": f"{_FIELDS} select doc_id, cast(score_int as varchar) as score from fields",
    "coerce_dates": f"""{fixtures.ctes('dirty_mentions')} select ticker, id, author, try_cast(created_date as timestamp) as created_date
from dirty_mentions where try_cast(created_date as timestamp) is not null""",
    "yesterday_mentions": f"{fixtures.ctes('threads')} select * from threads where {_YESTERDAY}",
    "mention_word_counts": f"{fixtures.ctes('threads')} select post_id, turn, {_COUNTS} from threads",
    "current_mentions": f"""{_LIMITED} select * from (
  select l.*, ticker, len(regexp_extract_all({_ASCII}, '\\b' || ticker || '\\b')) as ticker_count,
         len(regexp_extract_all({_ASCII}, '(?i)\\b' || name || '\\b')) as name_count
  from latest l, (values {', '.join(f"('{t}', '{n}')" for t, n in NAMES.items())}) w(ticker, name) where {_YESTERDAY}) c
where ticker_count > 0 or name_count > 0""",
    "latest_posts": f"{_LIMITED} select * from posts",
    "latest_comments": f"{_LIMITED} select * from comments",
    "union_posts_comments": f"""{_LIMITED} select p.*, (select cast(count(*) as double) from threads t where t.post_id = p.post_id and t.type = 'comment') as comments from posts p
union all select c.*, null from comments c""",
    "mentions_preview": f"""{fixtures.ctes('mentions')} select * from (select 'head' as part, created_date, body, score, id from mentions order by created_date, id limit 5) h
union all select * from (select 'tail' as part, created_date, body, score, id from mentions order by created_date desc, id desc limit 5) t""",
    "ticker_universe": f"{fixtures.ctes('symbols')} select distinct replace(symbol, '.', '-') as symbol from symbols",
    "page_headlines": f"{fixtures.ctes('pages').replace('pages as', 'html_pages as', 1)}, {_headline_sql('(?is)<p(?:[\\s/][^>]*)?>', 'html_pages')}",
    "class_headlines": f"{fixtures.ctes('classes')}, {_headline_sql(_CLASS_AD, 'classes')}",
    "nested_headlines": f"{fixtures.ctes('nested')}, {_headline_sql(_CLASS_AD, 'nested')}",
    "news_frame": "select regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, make_timestamp((1704067200 + page_id * 60) * 1000000) as date from pages",
}
