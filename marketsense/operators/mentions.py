"""Extraction of ticker mentions from forum lines and live threads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketsense.functions import text as tx
from marketsense.functions.sentiment import LookupTable
from marketsense.schemas import require_columns

# Outcomes of extraction, in the order the checks apply.
OK = "ok"

# Company names searched beside the ticker.
COMPANY_NAMES = {"AAPL": "apple", "MSFT": "microsoft", "GOOGL": "google", "AMZN": "amazon"}

# Newest posts read per forum.
FORUM_LIMITS = {"wallstreetbets": 100, "stocks": 50, "StockMarket": 25}

# Rows that a side may have to be broadcast by hint.
SMALL_SIDE = 100_000


def epoch_seconds(fields: Column) -> Column:
    """``created_utc`` as a number; a missing key counts as 0, an unusable value is null."""
    return tx.field_or(fields, "created_utc", "0").try_cast("double")


def mention_text(fields: Column) -> Column:
    """Body of a comment, or title and text of a submission; null if a used field is null."""
    title = tx.strip(tx.field_or(fields, "title", ""))
    selftext = tx.strip(tx.field_or(fields, "selftext", ""))
    submission = tx.strip(F.concat(title, F.lit(" "), selftext))
    return F.when(tx.has_key(fields, "body"), tx.strip(F.try_element_at(fields, F.lit("body")))).when(
        ~tx.has_key(fields, "body"), submission
    )


def in_range(seconds: Column, start: str, end: str) -> Column:
    """start <= seconds <= end, both bounds being UTC midnights."""
    bounds = [F.unix_timestamp(F.lit(f"{day} 00:00:00")).cast("double") for day in (start, end)]
    return seconds.between(*bounds)


def read_fields(parsed: DataFrame) -> DataFrame:
    """Typed columns of parsed lines (``fields``, ``value``)."""
    fields = F.col("fields")
    return parsed.withColumns(
        {
            "seconds": epoch_seconds(fields),
            "body": mention_text(fields),
            "id": F.try_element_at(fields, F.lit("id")),
            "author": tx.field_or(fields, "author", "[deleted]"),
        }
    )


def classified(parsed: DataFrame, tickers: str | list[str], start: str, end: str) -> DataFrame:
    """Every line with ``outcome`` and ``found``; checks run in order, text work last.

    Lines that fail before their text is searched have that outcome for every ticker; of
    the others ``found`` lists the tickers in the text, and ``outcome`` is that of these tickers ("no match" without any).
    """
    wanted = TickerList([tickers] if isinstance(tickers, str) else tickers)
    rows = read_fields(parsed)
    raw_score = F.try_element_at("fields", F.lit("score"))
    early = F.when(F.col("seconds").isNull(), "malformed").when(~in_range(F.col("seconds"), start, end), "out of range").when(F.col("body").isNull(), "malformed")
    late = F.when(F.col("id").isNull(), "no id").when(raw_score.isNull(), "no score").when(F.col("score").isNull(), "bad score").otherwise(OK)
    rows = rows.withColumns({"score": tx.json_integer(F.col("fields"), F.col("value"), "score"), "early": early})
    rows = rows.withColumn("found", F.when(F.col("early").isNull(), wanted.found(F.col("body"))))
    return rows.withColumn("outcome", F.coalesce("early", F.when(F.size("found") > 0, late).otherwise("no match"))).drop("early")


def _alternatives(words: list[str]) -> str:
    """Pattern of a prefix tree of the words, longest match first."""
    starts: dict[str, list[str]] = {}
    for word in words:
        starts.setdefault(word[:1], []).append(word[1:])
    end = starts.pop("", None) is not None
    branches = [(f"\\x{{{ord(first):x}}}" + _alternatives(rest)) for first, rest in sorted(starts.items())]
    if not branches:
        return ""
    joined = branches[0] if len(branches) == 1 and not end else f"(?:{'|'.join(branches)})"
    return f"{joined}?" if end else joined


class TickerList:
    """Finds all tickers of a list in a text, inside the row and in one pass over it.

    The list becomes one pattern, a prefix tree, tried at every place; a match is the
    longest ticker that starts there, and shorter ones that start it follow from a
    constant table.  The plan is the same for one ticker and for thousands.
    """

    def __init__(self, tickers: list[str]):
        if not tickers or not all(tickers):
            raise ValueError("tickers must not be empty")
        self.tickers = list(dict.fromkeys(tickers))
        self.spaced = any(ticker != "".join(ticker.split()) for ticker in self.tickers)
        uppers: dict[str, list[str]] = {}
        for ticker in self.tickers:
            uppers.setdefault(ticker.upper(), []).append(ticker)
        self.pattern = _alternatives(list(uppers))
        # For every upper-case ticker, the tickers it starts with, itself included.
        starts = [[name for size in range(1, len(upper) + 1) for name in uppers.get(upper[:size], [])] for upper in uppers]
        self.places = LookupTable({upper: float(place) for place, upper in enumerate(uppers)})
        self.starts = F.from_json(F.lit(json.dumps(starts)), "array<array<string>>")

    def found(self, text: Column) -> Column:
        """The distinct tickers contained in a text, ignoring case; empty for null."""
        hits = F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(f"(?=({self.pattern}))"), F.lit(1)))
        table = self.places.bind()
        named = F.transform(hits, lambda hit: F.get(self.starts, self.places.get(table, hit).cast("int")))
        return F.coalesce(F.array_distinct(F.flatten(named)), F.array().cast("array<string>"))

    def may_be_in(self, line: Column) -> Column:
        """False only for lines that cannot mention a ticker, judged before parsing.

        A body holds a ticker as it stands in the line unless the line has escape
        sequences; a ticker with white space could span title and text.
        """
        return F.lit(True) if self.spaced else F.upper(line).rlike(self.pattern) | line.contains("\\")


def extract_mentions(lines: DataFrame, tickers: str | list[str], start: str, end: str, column: str = "value") -> DataFrame:
    """Mentions of all tickers in raw JSON lines, in one pass: narrow work only, no shuffle.

    Lines that cannot match are dropped before parsing.  The rest goes through
    one generator that parses each line once and yields a row per ticker; a
    filter behind the parser would make Spark repeat the parsing inside it.
    """
    wanted = TickerList([tickers] if isinstance(tickers, str) else tickers)

    def mention(fields: Column) -> Column:
        seconds = epoch_seconds(fields)
        return F.when(in_range(seconds, start, end), tx.let(mention_text(fields), lambda body: matched(fields, seconds, body)))

    def matched(fields: Column, seconds: Column, body: Column) -> Column:
        def scored(found: Column) -> Column:
            hit = (F.size(found) > 0) & F.try_element_at(fields, F.lit("id")).isNotNull()
            return F.when(hit, tx.let(tx.json_integer(fields, F.col(column), "score"), lambda score: rows(fields, seconds, body, score, found)))

        return tx.let(wanted.found(body), scored)

    def rows(fields: Column, seconds: Column, body: Column, score: Column, found: Column) -> Column:
        def row(ticker: Column) -> Column:
            return F.struct(
                ticker.alias("ticker"),
                F.timestamp_seconds(seconds).alias("created_date"),
                tx.field_or(fields, "author", "[deleted]").alias("author"),
                body.alias("body"),
                score.alias("score"),
                F.try_element_at(fields, F.lit("id")).alias("id"),
            )

        return F.when(score.isNotNull(), F.transform(found, row))

    return lines.where(wanted.may_be_in(F.col(column))).select(F.inline(tx.let(tx.json_object(F.col(column)), mention)))


def count_outcomes(parsed: DataFrame, tickers: str | list[str], start: str, end: str) -> DataFrame:
    """Lines per (ticker, outcome), for any number of tickers in one pass.

    A line counts once for all tickers that it does not hold: what is counted per
    ticker are the lines that do, and "no match" is the rest of the searched lines.
    """
    names = list(dict.fromkeys([tickers] if isinstance(tickers, str) else tickers))
    rows = classified(parsed, names, start, end)
    # One entry for the line itself (no ticker), one per ticker found in it, and one of no line for every ticker asked for.
    own = F.array(F.struct(F.lit(None).cast("string").alias("ticker"), F.when(F.col("found").isNull(), F.col("outcome")).alias("outcome")))
    each = F.transform("found", lambda ticker: F.struct(ticker.alias("ticker"), F.col("outcome").alias("outcome")))
    entries = rows.select(F.inline(F.concat(own, F.coalesce(each, F.array().cast("array<struct<ticker:string,outcome:string>>")))), F.lit(1).alias("n"))
    asked = parsed.sparkSession.createDataFrame([(name, "no match", 0) for name in names], "ticker string, outcome string, n int")
    counts = entries.unionByName(asked).groupBy("ticker", "outcome").agg(F.sum("n").alias("n"))
    # The rest works on a row per ticker and outcome.
    whole, line = Window.partitionBy(F.lit(0)), F.col("ticker").isNull()
    searched = F.coalesce(F.sum(F.when(line & F.col("outcome").isNull(), F.col("n"))).over(whole), F.lit(0))
    early = F.collect_list(F.when(line & F.col("outcome").isNotNull(), F.struct("outcome", "n"))).over(whole)
    counts = counts.select("*", searched.alias("searched"), early.alias("early"), F.sum("n").over(Window.partitionBy("ticker")).alias("holding"))
    missed = F.array(F.struct("outcome", (F.col("searched") - F.col("holding")).alias("n")))
    listed = F.when(F.col("outcome") == "no match", F.concat(missed, "early")).otherwise(F.array(F.struct("outcome", "n")))
    total = counts.where(F.col("ticker").isNotNull()).select("ticker", F.inline(listed))
    return total.where(F.col("n") > 0).select("ticker", "outcome", F.col("n").alias("n_lines"))


def match_tickers(df: DataFrame, tickers: list[str], column: str = "body") -> DataFrame:
    """One output row per (row, ticker contained in its text)."""
    return df.withColumn("ticker", F.explode(TickerList(tickers).found(F.col(column))))


def coerce_dates(df: DataFrame, column: str = "created_date") -> DataFrame:
    """Parse a text date, dropping rows that do not parse."""
    return df.withColumn(column, F.try_to_timestamp(column)).where(F.col(column).isNotNull())


def yesterday(df: DataFrame, as_of: str, column: str = "created_date") -> DataFrame:
    """Rows of the day before ``as_of``."""
    day = F.date_sub(F.lit(as_of).cast("date"), 1)
    return df.where((F.col(column) >= day.cast("timestamp")) & (F.col(column) < F.lit(as_of).cast("timestamp")))


def word_counts(df: DataFrame, ticker: str, name: str) -> DataFrame:
    """Whole-word hits of the ticker (exact case) and of the name (any case)."""
    body = F.col("body")
    return df.withColumns(
        {
            "ticker_count": tx.word_count(body, ticker).cast("bigint"),
            "name_count": tx.word_count(body, name, ignore_case=True).cast("bigint"),
        }
    )


def mentioned(df: DataFrame) -> DataFrame:
    return df.where((F.col("ticker_count") > 0) | (F.col("name_count") > 0))


class WordList:
    """Counts whole words of many tickers (exact case) and company names (any ASCII case) in one pass over a text each.

    Each list is one pattern, a prefix tree tried at every word border; a match is the
    longest word there, and the shorter ones that start it and end at a border
    inside it follow from a constant table.  So every word is counted as if it
    were alone, with the same plan for one word and for thousands.
    """

    def __init__(self, names: dict[str, str]):
        """``names``: ticker -> company name."""
        if not names or not all(names) or not all(names.values()):
            raise ValueError("tickers and names must not be empty")
        lowered: dict[str, list[str]] = {}
        for ticker, name in names.items():
            lowered.setdefault(_ascii_lower(name), []).append(ticker)
        self.tickers = _Words({ticker: [ticker] for ticker in names}, "")
        self.companies = _Words(lowered, "(?i)")

    def counts(self, text: Column) -> Column:
        """array<struct<ticker, ticker_count, name_count>> of the tickers that a text names; empty for null."""

        def counted(hits: Column) -> Column:
            def one(ticker: Column) -> Column:
                sizes = [F.size(F.filter(F.get(hits, F.lit(side)), lambda hit: hit == ticker)).cast("bigint") for side in (0, 1)]
                return F.struct(ticker.alias("ticker"), sizes[0].alias("ticker_count"), sizes[1].alias("name_count"))

            return F.transform(F.array_distinct(F.flatten(hits)), one)

        return tx.let(F.array(self.tickers.found(text), self.companies.found(_ascii_lower_column(text))), counted)


def _ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _ascii_lower_column(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _border(text: str, place: int) -> bool:
    """Whether a word border lies inside a text; letters outside ASCII count as letters."""
    return (text[place - 1].isalnum() or text[place - 1] == "_") != (text[place].isalnum() or text[place] == "_")


class _Words:
    """All occurrences of whole words, each standing for some tickers."""

    def __init__(self, words: dict[str, list[str]], flags: str):
        # A word that can overlap itself ("la la") is counted alone, without overlaps.
        self.alone = {w: t for w, t in words.items() if any(w[d:] == w[: len(w) - d] and _border(w, d) for d in range(1, len(w)))}
        listed = [w for w in words if w not in self.alone]
        self.pattern = rf"{flags}\b(?=({_alternatives(listed)})\b)" if listed else None
        self.flags = flags
        starts = [[t for n in range(1, len(w) + 1) if w[:n] in words and w[:n] not in self.alone and (n == len(w) or _border(w, n)) for t in words[w[:n]]] for w in listed]
        self.places = LookupTable({w: float(place) for place, w in enumerate(listed)})
        self.starts = F.from_json(F.lit(json.dumps(starts)), "array<array<string>>")

    def found(self, text: Column) -> Column:
        """The tickers of all occurrences, repeats included."""
        parts = []
        if self.pattern:
            table = self.places.bind()
            hits = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(1))
            parts.append(F.flatten(F.transform(hits, lambda hit: F.get(self.starts, self.places.get(table, hit).cast("int")))))
        for word, tickers in self.alone.items():
            times = F.regexp_count(text, F.lit(rf"{self.flags}\b\Q{word}\E\b"))
            parts += [F.array_repeat(F.lit(ticker), times) for ticker in tickers]
        return F.coalesce(F.concat(*parts), F.array().cast("array<string>"))


def named_tickers(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per (row, ticker whose word or company name is in ``body``), with both counts."""
    return df.select("*", F.inline(WordList(names).counts(F.col("body"))))


def company_names(tickers: list[str], names: dict[str, str] | None = None) -> dict[str, str]:
    """Company name of each ticker; a ticker without one is an error."""
    names = COMPANY_NAMES if names is None else names
    unknown = [ticker for ticker in tickers if ticker not in names]
    if unknown:
        raise ValueError(f"no company name known for {', '.join(map(repr, unknown))}")
    return {ticker: names[ticker] for ticker in tickers}


def latest_posts(threads: DataFrame, limits: dict[str, int], after: str | None = None) -> DataFrame:
    """Newest posts of each forum, at most ``limits[forum]`` of them."""
    posts = threads.where((F.col("type") == "submission") & F.col("subreddit").isin(list(limits)))
    if after is not None:
        posts = posts.where(F.col("created_date") > F.lit(after).cast("timestamp"))
    newest = Window.partitionBy("subreddit").orderBy(F.desc("created_date"), F.desc("post_id"))
    limit = F.create_map(*[F.lit(v) for pair in limits.items() for v in pair])
    # The constant bound lets every task drop all but its newest rows before the
    # shuffle, so a busy forum sends a few rows per task.
    ranked = posts.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= max(limits.values()))
    return ranked.where(F.col("_rank") <= limit[F.col("subreddit")]).drop("_rank")


def latest_comments(threads: DataFrame, limits: dict[str, int], min_score: int = 0) -> DataFrame:
    """Comments of the newest posts with at least ``min_score``.

    At most sum(limits) posts are selected; while that is a small number they are
    broadcast, beyond it Spark joins as it sees fit.
    """
    posts = latest_posts(threads, limits).select("subreddit", "post_id")
    posts = F.broadcast(posts) if sum(limits.values()) <= SMALL_SIDE else posts
    comments = threads.where((F.col("type") == "comment") & (F.col("score") >= min_score))
    return comments.join(posts, ["subreddit", "post_id"], "left_semi")


def union_posts_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Bag union; columns only posts have are null on comments."""
    return posts.unionByName(comments, allowMissingColumns=True)


def with_reply_count(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """Number of comments of each of ``posts``; comments of other posts are dropped before they are counted."""
    comments = threads.where(F.col("type") == "comment").select("post_id")
    replies = comments.join(posts.select("post_id"), "post_id", "left_semi").groupBy("post_id").agg(F.count(F.lit(1)).alias("comments"))
    return posts.join(replies, "post_id", "left").withColumn("comments", F.coalesce("comments", F.lit(0)))


def newest_threads(threads: DataFrame, limits: dict[str, int], min_score: int = 0) -> DataFrame:
    """The newest posts of each forum with their number of ``comments``, and their comments of at least ``min_score``.

    The posts are found once: sum(limits) rows at most, which go to the threads they belong
    to; one exchange by post then counts the replies and gives out both kinds of rows.
    (subreddit, post_id) names one submission.
    """
    keys = ["subreddit", "post_id"]
    chosen = latest_posts(threads, limits).select(*keys).distinct()
    chosen = F.broadcast(chosen) if sum(limits.values()) <= SMALL_SIDE else chosen
    rows = threads.where(F.col("type").isin("submission", "comment")).join(chosen, keys, "left_semi")
    is_post = F.col("type") == "submission"
    replies = F.count_if(~is_post).over(Window.partitionBy(*keys))
    rows = rows.withColumn("comments", F.when(is_post, replies))
    return rows.where(is_post | (F.col("score") >= min_score))


def current_mentions(
    threads: DataFrame, tickers: str | list[str], as_of: str, limits: dict[str, int] | None = None, names: dict[str, str] | None = None
) -> DataFrame:
    """Yesterday's newest posts and comments, a row for each ticker that they name by its word or its company's name.

    Company names are looked up in ``names`` (ticker -> name); an unknown ticker is an error.
    """
    require_columns(threads, "body", "created_date")
    wanted = company_names([tickers] if isinstance(tickers, str) else tickers, names)
    rows = newest_threads(threads, FORUM_LIMITS if limits is None else limits).drop("comments")
    return named_tickers(yesterday(rows, as_of), wanted)


def preview(mentions: DataFrame, rows: int = 5) -> DataFrame:
    """First and last rows by time, tagged ``part``."""
    columns = ["created_date", "body", "score", "id"]
    first = mentions.orderBy("created_date", "id").limit(rows).select(F.lit("head").alias("part"), *columns)
    last = mentions.orderBy(F.desc("created_date"), F.desc("id")).limit(rows).select(F.lit("tail").alias("part"), *columns)
    return first.unionByName(last)
