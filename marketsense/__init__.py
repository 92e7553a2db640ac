"""Market data and public discussion, analysed with Spark DataFrames.

Every public function takes and returns DataFrames (or Columns); nothing runs
until the caller acts on the result.  Series are keyed by ``ticker`` and
ordered by ``date``; all tickers go through one plan.
"""

__version__ = "0.1.0"
