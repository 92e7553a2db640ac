"""Test inputs derived from the driver tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketsense.sources.tables import read_texts

BARS = """
select o_orderpriority as ticker, cast(o_orderdate as date) as date,
       min_by(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
       min(o_totalprice) as low, max_by(o_totalprice, o_orderkey) as close,
       cast(sum(o_custkey % 1000 + 1) as double) as volume
from orders group by o_orderpriority, cast(o_orderdate as date)"""

BARS_GAPS = f"""
select ticker, date, open, high, low, case when rn % 11 in (1, 2) then null else close end as close, volume
from (select b.*, row_number() over (partition by ticker order by date) as rn from ({BARS}) b) t"""

MENTIONS = """
select o.o_orderpriority as ticker, cast(d.doc_id as varchar(20)) as id,
       o.o_orderdate + ((d.doc_id * 7919) % 86400) * interval '1' second as created_date,
       concat('u', cast(o.o_custkey as varchar(20))) as author,
       d.text as body, cast(d.doc_id % 201 - 50 as int) as score
from documents d join orders o on o.o_orderkey = d.doc_id"""

RAW_LINES = """
select doc_id, source, case doc_id % 20
  when 0 then '{broken'
  when 1 then concat('{"created_utc":', ts, ',"body":"', txt, '","score":3}')
  when 2 then concat('{"id":"', k, '","created_utc":', ts, ',"body":"', txt, '"}')
  when 3 then concat('{"id":"', k, '","created_utc":', ts, ',"body":"', txt, '","score":"12"}')
  when 4 then concat('{"id":"', k, '","created_utc":', ts, ',"body":"', txt, '","score":"12.7"}')
  when 5 then concat('{"id":"', k, '","created_utc":', ts, ',"body":"', txt, '","score":12.7}')
  when 6 then concat('{"id":"', k, '","created_utc":', ts, ',"body":null,"title":"', txt, '","score":3}')
  when 7 then concat('{"id":"', k, '","created_utc":"', ts, '","title":" ', txt, ' ","selftext":"","score":3,"author":null}')
  when 8 then concat('{"id":"', k, '","body":"', txt, '","score":3}')
  when 9 then concat('{"id":"', k, '","created_utc":"nope","body":"', txt, '","score":3}')
  when 10 then '[1]'
  when 11 then ''
  when 12 then concat('{''id'':''', k, ''',''created_utc'':', ts, ',''body'':''that'',''score'':3}')
  when 13 then concat('{"id":"', k, '","created_utc":', ts, ',"body":"', txt, '","score":3} that garbage')
  when 14 then concat('{"id":"', k, '","created_utc":', ts, ',"body":"', txt, '","score":3},{"id":"', k, '","body":"that"}')
  when 15 then concat('{"id":"', k, '","created_utc":', ts, ',"body":"', txt, '","score":NaN}')
  when 17 then concat('{"id":"', k, '","created_utc":', ts, ',"body":"', txt, '","score":3} ]')
  when 18 then concat('{"id":"', k, '","created_utc":', ts, ',"body":"', txt, '","score":3}],[{"id":"', k, '","body":"that"}')
  when 16 then concat('{"id":"first","created_utc":', ts, ',"body":"', txt, '","score":3,"id":"', k, '"}')
  else concat('{"id":"', k, '","author":"a', k, '","created_utc":', ts, ',"body":"', txt, '","score":', cast(doc_id % 50 - 5 as varchar(20)), '}')
  end as value
from (select doc_id, source, cast(doc_id as varchar(20)) as k,
             cast(1577836800 + (doc_id * 104729) % 130000000 as varchar(20)) as ts,
             replace(replace(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), chr(9), ' '), chr(92), ' '), '"', ' ') as txt
      from documents) t"""

THREADS = """
select concat('sub', cast(conv_id % 3 as varchar(20))) as subreddit, conv_id as post_id, turn,
       case when turn = 0 then 'submission' else 'comment' end as type, text as body,
       timestamp '2024-01-01 00:00:00' + (conv_id * 977 + turn * 60) * interval '1' second as created_date,
       cast((conv_id * 13 + turn * 7) % 40 - 8 as int) as score
from conversations"""

SCORED = """
select doc_id as id, quality as label, cast((doc_id * 7919) % 97 as double) / 97 as score,
       case when ((doc_id * 7919) % 97) >= 40 then 1 else 0 end as prediction
from labels"""

SYMBOLS = """
select concat('T', cast(n_nationkey as varchar(20)), case when n_nationkey % 4 = 0 then '.B' else '' end) as symbol from nation"""

# Mentions with every defect the validator looks for, on the mention columns as text.
DIRTY_MENTIONS = f"""
select ticker,
       case when n % 13 = 0 then 'not a date' when n % 29 = 0 then null
            else concat(substr(cast(created_date as varchar(40)), 1, 10), ' 12:00:00') end as created_date,
       author, case when n % 17 = 0 then null else body end as body,
       case when n % 19 = 0 then 'many' when n % 23 = 0 then null else cast(score as varchar(20)) end as score,
       case when n % 31 = 0 then null when n % 37 = 0 then 'dup' else id end as id, 'x' as flair
from (select m.*, cast(id as bigint) as n from ({MENTIONS}) m) t"""

# Texts whose blanks are no-break spaces in every fifth document.
BLANKS = """
select doc_id, case when doc_id % 5 = 0 then replace(text, ' ', chr(160)) else text end as text from documents"""

# Mentions, and some of them again for a ticker without any bar.
MENTIONS_MORE = f"""
select ticker, id, created_date, author, body, score from ({MENTIONS}) m
union all select 'NO BARS' as ticker, id, created_date, author, body, score from ({MENTIONS}) n where score % 7 = 0"""

# Pages whose advertisements have several classes, in either kind of quotes.
CLASSES = """
select page_id, url, case page_id % 3 when 0 then replace(html, 'class="ad"', 'id="x" class="wide ad"')
                                      when 1 then replace(html, '<div class="ad"', '<DIV CLASS = ''ad left''') else replace(html, 'class="ad"', 'class="ads"') end as html
from pages"""

# Elements inside elements of the same name, closed and not, with text around them and several kinds of character references.
NESTED = """
select page_id, url, case page_id % 3
  when 0 then replace(html, '<div class="ad">', '<div class="ad">one &eacute;<div>two &#8217;</div><i>three<br/></i> &#x27;')
  when 1 then replace(html, '<div class="ad">', '<section><div class="ad">open <b>bold <div class="x">deep</div> end</section><div class="ad">')
  else replace(html, '<div class="ad">', '<div class="ad"><div class="ad">inner</div></p>outer ') end as html
from pages"""

# White space beyond ASCII, for patterns of DuckDB.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x0B]"

TABLES = {
    "blanks": (BLANKS, ["documents"]),
    "mentions_more": (MENTIONS_MORE, ["documents", "orders"]),
    "bars": (BARS, ["orders"]),
    "bars_gaps": (BARS_GAPS, ["orders"]),
    "mentions": (MENTIONS, ["documents", "orders"]),
    "raw_lines": (RAW_LINES, ["documents"]),
    "threads": (THREADS, ["conversations"]),
    "scored": (SCORED, ["labels"]),
    "symbols": (SYMBOLS, ["nation"]),
    "dirty_mentions": (DIRTY_MENTIONS, ["documents", "orders"]),
    "classes": (CLASSES, ["pages"]),
    "nested": (NESTED, ["pages"]),
    "pages": ("select page_id, url, html from pages", ["pages"]),
    "documents": ("select doc_id, text, source from documents", ["documents"]),
}

# Tables with long texts, and their keys.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived inputs as a DataFrame."""
    sql, sources = TABLES[name]
    for source in sources:
        path = f"{sf_dir}/{source}.parquet"
        df = read_texts(spark, path, TEXTS[source]) if source in TEXTS else spark.read.parquet(path)
        df.createOrReplaceTempView(source)
    return spark.sql(sql)


def ctes(*names: str) -> str:
    """``with`` clause defining the inputs for an oracle query."""
    return "with recursive " + ",\n".join(f"{name} as ({TABLES[name][0]})" for name in names)
