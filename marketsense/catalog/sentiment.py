"""Scores, daily rollups, alignment, the merged table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketsense import fixtures
from marketsense.catalog.prices import TECHNICAL_CTES, TECHNICAL_LEAK_FREE, TRAIN_UNTIL, rounded
from marketsense.functions import lexicon as lx
from marketsense.functions.sentiment import sentiment
from marketsense.operators import align, daily, mentions as m
from marketsense.plans.merged import merged_features
from marketsense.plans.sentiment import current_features, sentiment_features
from marketsense.schemas import LAGS, SENTIMENT, TECHNICAL

WORD, NAME = "La", "la"


def _scored(spark, sf):
    return daily.score_mentions(fixtures.table(spark, sf, "mentions"))


def _daily(spark, sf):
    return daily.daily_sentiment(_scored(spark, sf))


def _more_daily(spark, sf):
    """Days of all mentions, those of a ticker without bars included."""
    return daily.daily_sentiment(daily.score_mentions(fixtures.table(spark, sf, "mentions_more")))


def _asof(spark, sf):
    days = _daily(spark, sf).withColumn(
        "average_sentiment", F.when(F.dayofmonth("date") % 5 != 0, F.col("average_sentiment"))
    )
    found = align.asof_backward(fixtures.table(spark, sf, "bars").select("ticker", "date"), days)
    found = found.withColumns({n: F.col(n).cast("double") for n in ("mention_count", "total_score")})
    return rounded(found.drop("pos"), 10, "average_sentiment")


def _current(spark, sf):
    threads = fixtures.table(spark, sf, "threads").withColumnRenamed("subreddit", "ticker")
    return daily.score_mentions(m.mentioned(m.word_counts(threads, WORD, NAME)))


def _merged(spark, sf, **options):
    df = merged_features(fixtures.table(spark, sf, "bars"), fixtures.table(spark, sf, "mentions"), **options)
    return rounded(df, 8, *TECHNICAL, *LAGS, *SENTIMENT)


QUERIES = {
    "sentiment_scores": lambda s, d: fixtures.table(s, d, "blanks").select("doc_id", sentiment("text").alias("sentiment")),
    "daily_sentiment": lambda s, d: rounded(_daily(s, d), 10, "average_sentiment"),
    "daily_current_sentiment": lambda s, d: rounded(
        daily.daily_current_sentiment(_current(s, d)), 10, "average_sentiment"
    ),
    "sentiment_decision": lambda s, d: rounded(
        daily.sentiment_decision(_scored(s, d)), 9, "mean_sentiment", "std_sentiment", "threshold"
    ),
    "trading_calendar": lambda s, d: align.trading_calendar(fixtures.table(s, d, "bars"), _more_daily(s, d)),
    "asof_sentiment": _asof,
    "sentiment_ma": lambda s, d: rounded(
        daily.moving_average(_daily(s, d).select("ticker", "date", "average_sentiment")),
        10, "average_sentiment", "sentiment_moving_average_3d",
    ),
    "sentiment_features": lambda s, d: rounded(
        sentiment_features(fixtures.table(s, d, "mentions_more"), fixtures.table(s, d, "bars")), 9, *SENTIMENT
    ),
    "current_features": lambda s, d: rounded(current_features(_current(s, d)), 9, *SENTIMENT),
    "merge_price_sentiment": _merged,
    "merge_leak_free": lambda s, d: _merged(s, d, leak_free=True, train_until=TRAIN_UNTIL),
}


def _values(entries: dict[str, float]) -> str:
    return ", ".join("('{}', {})".format(w.replace("'", "''"), v) for w, v in entries.items())


def _list(words: list[str]) -> str:
    return ", ".join("'{}'".format(w.replace("'", "''")) for w in words)


_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def scorer_ctes(source: str, key: str, text: str) -> str:
    """CTEs ending in ``scores(key, sentiment)`` for the texts of a table."""
    boosters = _list(lx.STRONGER + lx.WEAKER)

    def before(k: int) -> str:
        return f"lag(token, {k}) over w as p{k}, lag(base, {k}) over w as v{k}"

    def negated(k: int) -> str:
        return f"(lower(p{k}) in ({_list(lx.NEGATIONS)}) or contains(lower(p{k}), 'n''t'))"

    def strength(k: int) -> str:
        loud = f"case when caps and upper(p{k}) = p{k} and lower(p{k}) <> p{k} then {lx.CAPS} else 0 end"
        return (
            f"case when lower(p{k}) in ({_list(lx.STRONGER)}) then ({lx.BOOST} + {loud}) * {lx.DISTANCE_DAMPING[k - 1]}"
            f" when lower(p{k}) in ({_list(lx.WEAKER)}) then (-{lx.BOOST} + {loud}) * {lx.DISTANCE_DAMPING[k - 1]} else 0 end"
        )

    def step(k: int, previous: str) -> str:
        boosted = f"({previous} + case when {previous} < 0 then -1 else 1 end * ({strength(k)}))"
        turned = f"case when {negated(k)} then {boosted} * {lx.NEGATION} else {boosted} end"
        if k > 1:
            nearer = " or ".join(f"lower(p{j}) in ('so', 'this')" for j in range(1, k))
            turned = f"case when lower(p{k}) = 'never' and ({nearer}) then {boosted} * {lx.NEVER_SO[k - 2]} else {turned} end"
        if k == 3:
            near = {(0, 2): "token || ' ' || n1", (0, 3): "token || ' ' || n1 || ' ' || n2", (-1, 2): "p1 || ' ' || token",
                    (-2, 3): "p2 || ' ' || p1 || ' ' || token", (-2, 2): "p2 || ' ' || p1", (-3, 3): "p3 || ' ' || p2 || ' ' || p1",
                    (-3, 2): "p3 || ' ' || p2"}
            order = [(0, 3), (0, 2), (-1, 2), (-2, 3), (-2, 2), (-3, 3), (-3, 2)]
            whens = "".join(
                f" when lower({near[place]}) = '{phrase}' then {number}"
                for place in order for phrase, number in lx.IDIOMS.items() if len(phrase.split()) == place[1]
            )
            weak = f"case when lower(p3 || ' ' || p2) in ({_list(lx.WEAKER_PHRASES)}) or lower(p2 || ' ' || p1) in ({_list(lx.WEAKER_PHRASES)}) then -{lx.BOOST} else 0 end"
            turned = f"(case{whens} else {turned} end) + {weak}"
        return f"case when p{k} is null or v{k} is not null then {previous} else {turned} end"

    return f"""lexicon(word, valence) as (values {_values(lx.STARTER)}),
split_ as (select {key} as doc, {text} as body, unnest(string_split_regex({text}, '{fixtures.SPACE}+')) as raw, generate_subscripts(string_split_regex({text}, '{fixtures.SPACE}+'), 1) as n from {source} where {text} is not null),
trimmed as (select doc, n, raw, trim(raw, '{_PUNCT}') as bare from split_),
cleaned as (select doc, n, case when length(bare) <= 2 and l.word is not null then raw else bare end as token
            from trimmed t left join lexicon l on l.word = lower(t.raw)),
words as (select doc, row_number() over (partition by doc order by n) as n, token from cleaned where length(token) > 1),
based as (select w.doc, w.n, w.token, l.valence as base, upper(token) = token and lower(token) <> token as is_caps
          from words w left join lexicon l on l.word = lower(w.token)),
context as (select *, bool_or(is_caps) over d and bool_or(not is_caps) over d as caps, min(case when lower(token) = 'but' then n end) over d as but_at,
                   lead(token, 1) over w as n1, lead(token, 2) over w as n2, {before(1)}, {before(2)}, {before(3)}
            from based window w as (partition by doc order by n), d as (partition by doc)),
hits as (select *, case when caps and is_caps then base + case when base > 0 then {lx.CAPS} else -{lx.CAPS} end else base end as s0
         from context where base is not null and lower(token) not in ({boosters}) and not coalesce(lower(token) = 'kind' and lower(n1) = 'of', false)),
one as (select *, {step(1, 's0')} as s1 from hits),
two as (select *, {step(2, 's1')} as s2 from one),
three as (select *, {step(3, 's2')} as s3 from two),
last_ as (select doc, s3 * case when lower(p1) = 'least' and v1 is null and not coalesce(lower(p2) in ('at', 'very'), false) then {lx.NEGATION} else 1 end
            * case when but_at is null or n = but_at then 1 when n < but_at then {lx.BEFORE_BUT} else {lx.AFTER_BUT} end as s from three),
sums as (select doc, sum(s) as s from last_ group by doc),
marks as (select {key} as doc, coalesce({text}, '') as body from {source}),
emphasis as (select doc, least(length(body) - length(replace(body, '!', '')), {lx.MAX_EXCLAMATIONS}) * {lx.EXCLAMATION}
               + case when q > 3 then {lx.MANY_QUESTIONS} when q > 1 then q * {lx.QUESTION} else 0 end as e
             from (select *, length(body) - length(replace(body, '?', '')) as q from marks) m),
totals as (select e.doc, coalesce(s.s, 0.0)::double as raw, e.e from emphasis e left join sums s on s.doc = e.doc),
scores as (select doc, round(t / sqrt(t * t + {lx.NORMALISATION}), 4) as sentiment
           from (select doc, (raw + case when raw > 0 then e when raw < 0 then -e else 0 end)::double as t from totals) x)"""


_DOC_SCORES = scorer_ctes("documents", "doc_id", "text")


def _scored_ctes(source: str) -> str:
    """CTEs ending in ``daily`` for one of the mention inputs."""
    return f"""{fixtures.ctes("bars", source)}, {_DOC_SCORES},
scored as (select m.*, s.sentiment from {source} m join scores s on s.doc = cast(m.id as bigint)),
daily as (select ticker, cast(created_date as date) as date, avg(sentiment) as average_sentiment, count(sentiment) as mention_count,
                 cast(coalesce(sum(score), 0) as bigint) as total_score from scored group by all)"""


_SCORED, _SCORED_MORE = _scored_ctes("mentions"), _scored_ctes("mentions_more")

_ASCII = "regexp_replace(body, '[\\x{C0}-\\x{24F}]', 'z', 'g')"
_CURRENT = f"""{fixtures.ctes("threads")}, numbered as (select *, post_id * 100000 + turn as doc_key from threads),
{scorer_ctes("numbered", "doc_key", "body")},
current_daily as (
  select subreddit as ticker, cast(created_date as date) as date, avg(sentiment) as average_sentiment,
         cast(sum(score) as bigint) as total_score, cast(sum(tc + nc) as bigint) as mention_count
  from (select *, len(regexp_extract_all({_ASCII}, '\\b{WORD}\\b')) as tc, len(regexp_extract_all({_ASCII}, '(?i)\\b{NAME}\\b')) as nc from numbered) t
  join scores on doc = doc_key where tc > 0 or nc > 0 group by all)"""


def _features(calendar: str, days: str, train_until: str | None = None) -> str:
    """CTEs ending in ``features`` from calendar and daily tables; with a date the leak-free ones."""
    scale = "case when {c} is not null then coalesce(({c} - min({c}) over t) / nullif(max({c}) over t - min({c}) over t, 0), 0) end as {c}"
    moving = "coalesce(last_value(ma ignore nulls) over f, first_value(ma ignore nulls) over b)"
    if train_until is not None:
        scale = scale.replace(") over t", f") filter (where date < date '{train_until}') over t")
        moving = "last_value(ma ignore nulls) over f"
    numbers = ", ".join(scale.format(c=c) for c in ("average_sentiment", "mention_count", "total_score"))
    return f"""aligned as (select c.ticker, c.date, d.average_sentiment, d.mention_count::double as mention_count, d.total_score::double as total_score
  from {calendar} c asof left join {days} d on d.ticker = c.ticker and d.date <= c.date),
normal as (select ticker, date, {numbers} from aligned window t as (partition by ticker)),
smooth as (select *, case when count(average_sentiment) over w = 3 then avg(average_sentiment) over w end as ma,
             average_sentiment * mention_count as interaction from normal window w as (partition by ticker order by date rows 2 preceding)),
features as (select ticker, date, last_value(average_sentiment ignore nulls) over f as average_sentiment, coalesce(mention_count, 0) as mention_count,
   coalesce(total_score, 0) as total_score,
   {moving} as sentiment_moving_average_3d,
   interaction as sentiment_mentions_interaction
  from smooth window f as (partition by ticker order by date rows unbounded preceding),
                     b as (partition by ticker order by date rows between current row and unbounded following))"""


def _round(digits: int, names: list[str]) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


def _merged_sql(technical: str, train_until: str | None = None) -> str:
    return f"""{technical}, {fixtures.ctes("mentions").removeprefix("with recursive ")}, {_DOC_SCORES},
scored as (select m.*, s.sentiment from mentions m join scores s on s.doc = cast(m.id as bigint)),
daily as (select ticker, cast(created_date as date) as date, avg(sentiment) as average_sentiment, count(sentiment) as mention_count,
                 cast(coalesce(sum(score), 0) as bigint) as total_score from scored group by all),
{_features('technical', 'daily', train_until)}
select t.*, {_round(8, SENTIMENT)} from technical t join features f on f.ticker = t.ticker and f.date = t.date"""


_CALENDAR = """calendar as (select ticker, date from bars
  union all select ticker, date from daily where ticker not in (select ticker from bars))"""

ORACLES = {
    "sentiment_scores": f"{fixtures.ctes('blanks')}, {scorer_ctes('blanks', 'doc_id', 'text')} select doc as doc_id, sentiment from scores",
    "daily_sentiment": f"{_SCORED} select ticker, date, round(average_sentiment, 10) as average_sentiment, mention_count, total_score from daily",
    "daily_current_sentiment": f"{_CURRENT} select ticker, date, round(average_sentiment, 10) as average_sentiment, mention_count, total_score from current_daily",
    "sentiment_decision": f"""{_SCORED},
days as (select ticker, cast(created_date as date) as date, avg(sentiment) as a, avg(score) as s from scored group by all),
stats as (select ticker, avg(a) as m, stddev_samp(a) as d from days group by ticker)
select ticker, case when good_days > 0 then 'yes' else 'no' end as decision, good_days, round(m, 9) as mean_sentiment, round(d, 9) as std_sentiment,
       round(m * 1.5, 9) as threshold
from (select ticker, count(*) filter (where a > m and s >= 0) as good_days, any_value(m) as m, any_value(d) as d from days join stats using (ticker) group by ticker) x""",
    "trading_calendar": f"{_SCORED_MORE}, {_CALENDAR} select * from calendar",
    "asof_sentiment": f"""{_SCORED}, holes as (select ticker, date, case when day(date) % 5 <> 0 then average_sentiment end as average_sentiment, mention_count, total_score from daily)
select b.ticker, b.date, round(h.average_sentiment, 10) as average_sentiment, h.mention_count::double as mention_count, h.total_score::double as total_score
from bars b asof left join holes h on h.ticker = b.ticker and h.date <= b.date""",
    "sentiment_ma": f"""{_SCORED} select ticker, date, round(average_sentiment, 10) as average_sentiment,
round(case when count(average_sentiment) over w = 3 then avg(average_sentiment) over w end, 10) as sentiment_moving_average_3d
from daily window w as (partition by ticker order by date rows 2 preceding)""",
    "sentiment_features": f"{_SCORED_MORE}, {_CALENDAR}, {_features('calendar', 'daily')} select ticker, date, {_round(9, SENTIMENT)} from features",
    "current_features": f"""{_CURRENT}, ma as (select *, case when count(average_sentiment) over w = 3 then avg(average_sentiment) over w end as m
  from current_daily window w as (partition by ticker order by date rows 2 preceding))
select ticker, date, round(average_sentiment, 9) as average_sentiment, mention_count::double as mention_count, total_score::double as total_score,
round(coalesce(m, 0), 9) as sentiment_moving_average_3d, round(average_sentiment * mention_count, 9) as sentiment_mentions_interaction from ma""",
    "merge_price_sentiment": _merged_sql(TECHNICAL_CTES),
    "merge_leak_free": _merged_sql(TECHNICAL_LEAK_FREE, TRAIN_UNTIL),
}
