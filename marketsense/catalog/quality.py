"""Source profiles and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketsense import fixtures
from marketsense.catalog.mentions import END, START, _FIELDS
from marketsense.operators import quality

TICKERS = ["2-HIGH", "NO FILE"]
BOUNDS = ("1995-01-01", "2001-12-31")


def _profiles(spark, sf):
    return quality.profile_source(fixtures.table(spark, sf, "raw_lines"), "source")


def _validated(spark, sf):
    df = quality.validate_mentions(fixtures.table(spark, sf, "dirty_mentions"), *BOUNDS)
    df = quality.with_missing_files(df, TICKERS)
    return df.withColumn("value", F.round("value", 6))


QUERIES = {
    "profile_source": _profiles,
    "coverage_check": lambda s, d: quality.coverage_check(_profiles(s, d), START, END),
    "dq_mentions": _validated,
    "dq_bad_dates": lambda s, d: quality.bad_date_samples(fixtures.table(s, d, "dirty_mentions")),
}

_PROFILE = f"""{_FIELDS},
profiles as (
  select r.source, min(case when seconds <> 0 then seconds end) as earliest, max(case when seconds <> 0 then seconds end) as latest,
         count(*) as total_lines, count(*) filter (where trim(value) <> '' and seconds <> 0) as processed_lines,
         count(*) filter (where trim(value) <> '' and seconds is null) as error_lines
  from raw_lines r join fields f on f.doc_id = r.doc_id group by r.source)"""

_CHECKS = f"""{fixtures.ctes("dirty_mentions")},
typed as (select ticker, id, body, try_cast(created_date as timestamp) as stamp, try_cast(score as double) as number from dirty_mentions),
found as (
  select ticker, count(*) as records, count(*) filter (where stamp is null) as invalid_dates, count(*) filter (where stamp is not null) as dated,
         count(*) filter (where stamp is not null and number is null) as invalid_scores,
         count(*) filter (where stamp is not null and number <> floor(number)) as fractional_scores,
         count(*) filter (where stamp is not null and body is null) as null_body,
         count(*) filter (where stamp is not null and id is null) as null_id,
         count(distinct id) filter (where stamp is not null) as ids,
         count(*) filter (where stamp is not null and number < 0) as negative_scores,
         count(*) filter (where stamp is not null and length(body) > 1000) as long_bodies,
         min(stamp) > timestamp '{BOUNDS[0]}' as late, max(stamp) < timestamp '{BOUNDS[1]}' as early
  from typed group by ticker),
long_ as (
  {' union all '.join(f"select ticker, '{name}' as check_name, ({value})::double as value, '{severity}' as bad from found" for name, value, severity in [
      ("records", "records", "info"), ("invalid_dates", "invalid_dates", "warn"), ("invalid_date_percent", "invalid_dates * 100.0 / records", "warn"),
      ("missing_columns", "0", "fail"), ("extra_columns", "1", "warn"), ("invalid_scores", "invalid_scores", "warn"),
      ("fractional_scores", "fractional_scores", "fail"), ("null_created_date", "0", "warn"), ("null_body", "null_body", "warn"),
      ("null_score", "invalid_scores", "warn"), ("null_id", "null_id", "warn"),
      ("duplicate_ids", "dated - ids - case when null_id > 0 then 1 else 0 end", "warn"), ("bad_bounds", "0", "fail"),
      ("starts_late", "late::int", "warn"), ("ends_early", "early::int", "warn"), ("negative_scores", "negative_scores", "warn"),
      ("long_bodies", "long_bodies", "warn"), ("failed", "(fractional_scores > 0)::int", "fail")])})"""

ORACLES = {
    "profile_source": f"{_PROFILE} select * from profiles",
    "coverage_check": f"""{_PROFILE} select min(earliest) as earliest, max(latest) as latest,
case when min(earliest) is null then 'undetermined' when min(earliest) <= epoch(timestamp '{START}') and max(latest) >= epoch(timestamp '{END}')
     then 'covered' else 'not covered' end as coverage from profiles""",
    "dq_mentions": f"""{_CHECKS} select ticker, check_name, round(value, 6) as value, case when value > 0 then bad else 'info' end as severity from long_
union all select 'NO FILE', unnest(['missing_file', 'failed']), 1.0, 'fail'""",
    "dq_bad_dates": f"""{fixtures.ctes("dirty_mentions")} select ticker, id, created_date
from (select ticker, id, created_date, row_number() over (partition by ticker order by created_date nulls first, id nulls first) as n
      from dirty_mentions where try_cast(created_date as timestamp) is null) t where n <= 5""",
}
