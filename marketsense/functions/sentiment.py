"""Lexicon sentiment of a text as one Column expression.

The score of a text depends on that text alone, so it is computed inside the
row: no Python, no shuffle, no key needed, and the same expression serves batch
and streaming plans.  Work is spent where it matters: a text that holds no word of the list is
done with; of the others all tokens get one look-up, only the few that carry a valence
get the context rules.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from marketsense.functions import lexicon as lx
from marketsense.functions.lexicon import Lexicon, starter_lexicon
from marketsense.functions.text import let

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CONTEXT = 3


def _texts(words: list[str]) -> Column:
    return F.split(F.lit("|".join(words)), r"\|")


class LookupTable:
    """Constant word -> number table with one short map per hash bucket.

    Spark searches a map from the front, so a single map of thousands of words
    would be slow; a bucket holds a handful.
    """

    def __init__(self, entries: dict[str, float]):
        self.entries = entries
        self.buckets = max(16, 1 << (len(entries) // 2).bit_length())

    def bind(self) -> Column:
        """The table as one constant array of maps (Spark folds it while planning)."""
        slots: list[dict[str, float]] = [{} for _ in range(self.buckets)]
        for word, number in self.entries.items():
            slots[zlib.crc32(word.encode()) % self.buckets][word] = float(number)
        return F.from_json(F.lit(json.dumps(slots)), "array<map<string,double>>")

    def get(self, table: Column, word: Column) -> Column:
        slot = F.pmod(F.crc32(word.cast("binary")), F.lit(self.buckets)).cast("int")
        return F.try_element_at(F.get(table, slot), word)


def _listed(words: list[str]) -> Column:
    """Constant words of any characters (Spark folds them while planning)."""
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def _split(text: Column) -> Column:
    return F.split(text, r"(?U)\s+")


def may_score(text: Column, words: list[str]) -> Column:
    """Whether a token of a text can be one of the (lower-case) words; false only where none is.

    A word of letters stands between other signs in the lower-case text, so it is a run of
    letters there; of a word with other signs its first run is. Words without letters are sought as they are.
    """
    runs = [re.search("[a-z]+", word) for word in words]
    bare = sorted(word for word, run in zip(words, runs) if not run)
    low = F.lower(text)
    found = F.arrays_overlap(F.split(low, "[^a-z]+"), _listed(sorted({run[0] for run in runs if run})))
    if not bare:
        return found
    firsts, quoted = "".join(sorted({f"\\x{{{ord(word[0]):X}}}" for word in bare})), "|".join("".join(f"\\x{{{ord(c):X}}}" for c in word) for word in bare)
    return found | low.rlike(f"(?=[{firsts}])(?:{quoted})")


def quick_tokens(text: Column, words: list[str], known: Callable[[Column], Column]) -> Column:
    """``tokens``, with less work where no token stays whole because it is a word with punctuation around it."""
    edged = [word for word in words if word.strip(PUNCTUATION) != word]
    plain = F.filter(F.transform(_split(text), lambda token: F.btrim(token, F.lit(PUNCTUATION))), lambda token: F.length(token) > 1)
    return F.when(F.arrays_overlap(_split(F.lower(text)), _listed(edged)), tokens(text, known)).otherwise(plain) if edged else plain


def tokens(text: Column, known: Callable[[Column], Column]) -> Column:
    """White-space tokens without surrounding punctuation, longer than one character.

    Short tokens the lexicon knows as they are (emoticons) stay whole.
    """

    def clean(token: Column) -> Column:
        bare = F.btrim(token, F.lit(PUNCTUATION))
        return F.when(whole(token, bare), token).otherwise(bare)

    def whole(token: Column, bare: Column) -> Column:
        return (F.length(bare) <= 2) & (F.length(token) > F.length(bare)) & known(F.lower(token)).isNotNull()

    return F.filter(F.transform(_split(text), clean), lambda token: F.length(token) > 1)


def _is_caps(token: Column) -> Column:
    return (F.upper(token) == token) & (F.lower(token) != token)


def _caps_differ(words: Column) -> Column:
    """Some but not all tokens are upper case."""
    return F.exists(words, _is_caps) & F.exists(words, lambda token: ~_is_caps(token))


def _away_from_zero(value: Column, amount: Column) -> Column:
    return F.when(value > 0, value + amount).otherwise(value - amount)


def _phrase(words: Column, start: Column, length: int) -> Column:
    return F.lower(F.array_join(F.slice(words, start + 1, length), " "))


def _token_valence(words: Column, hit: Column, caps: Column, known: Callable[[Column], Column], lexicon: Lexicon) -> Column:
    """Valence of one lexicon token from the up to three tokens before it."""
    place = hit["place"]
    token = F.get(words, place)
    valence = F.when(caps & _is_caps(token), _away_from_zero(hit["valence"], F.lit(lx.CAPS))).otherwise(hit["valence"])
    before = [F.lower(F.get(words, place - k)) for k in range(1, CONTEXT + 1)]
    negations, stronger, weaker = _texts(lexicon.negations), _texts(lexicon.stronger), _texts(lexicon.weaker)
    emphatic = _texts(["so", "this"])

    def negated(word: Column) -> Column:
        return F.array_contains(negations, word) | word.contains("n't")

    def after(value: Column, k: int) -> Column:
        """Effect of the k-th token before, on the value so far."""
        word, original = before[k - 1], F.get(words, place - k)
        strength = F.when(F.array_contains(stronger, word), F.lit(lx.BOOST)).when(
            F.array_contains(weaker, word), F.lit(-lx.BOOST)
        )
        loud = F.when(caps & _is_caps(original), F.lit(lx.CAPS)).otherwise(F.lit(0.0))
        step = F.coalesce((strength + loud) * lx.DISTANCE_DAMPING[k - 1], F.lit(0.0))
        boosted = F.when(value < 0, value - step).otherwise(value + step)

        def turn(current: Column) -> Column:
            plain = F.when(negated(word), current * lx.NEGATION).otherwise(current)
            if k == 1:
                return plain
            nearer = reduce(lambda a, b: a | b, [F.array_contains(emphatic, w) for w in before[: k - 1]])
            return F.when((word == "never") & nearer, current * lx.NEVER_SO[k - 2]).otherwise(plain)

        changed = let(boosted, turn)
        if k == CONTEXT:
            changed = let(changed, lambda v: _idiom(words, place, v, lexicon))
        return F.when(word.isNull() | known(word).isNotNull(), value).otherwise(changed)

    def least(value: Column) -> Column:
        applies = (before[0] == "least") & known(before[0]).isNull()
        spared = F.coalesce(before[1].isin("at", "very"), F.lit(False))
        return F.when(applies & ~spared, value * lx.NEGATION).otherwise(value)

    return let(
        valence, lambda v0: let(after(v0, 1), lambda v1: let(after(v1, 2), lambda v2: let(after(v2, 3), least)))
    )


def _idiom(words: Column, place: Column, value: Column, lexicon: Lexicon) -> Column:
    """Phrases around a token replace its valence; two-word weakeners before it lower it."""
    # (start relative to the token, length), tried in this order; the last two look ahead and win.
    behind = [(-1, 2), (-2, 3), (-2, 2), (-3, 3), (-3, 2)]
    ahead = [(0, 2), (0, 3)]
    lengths = {len(phrase.split()) for phrase in lexicon.idioms}

    def valence_of(start: int, length: int) -> Column:
        numbers = {phrase: float(number) for phrase, number in lexicon.idioms.items() if len(phrase.split()) == length}
        return F.try_element_at(F.from_json(F.lit(json.dumps(numbers)), "map<string,double>"), _phrase(words, place + start, length))

    candidates = [valence_of(s, n) for s, n in ahead[::-1] + behind if n in lengths]
    replaced = F.coalesce(*candidates, value) if candidates else value
    phrases = _texts(lexicon.weaker_phrases)
    weak = reduce(
        lambda a, b: a | b, [F.array_contains(phrases, _phrase(words, place + start, 2)) for start in (-3, -2)]
    )
    return replaced + F.when(weak, F.lit(-lx.BOOST)).otherwise(F.lit(0.0))


def _emphasis(text: Column) -> Column:
    exclamations = F.least(F.regexp_count(text, F.lit("!")), F.lit(lx.MAX_EXCLAMATIONS)) * lx.EXCLAMATION
    questions = F.regexp_count(text, F.lit(r"\?"))
    return exclamations + F.when(questions > 3, F.lit(lx.MANY_QUESTIONS)).when(
        questions > 1, questions * lx.QUESTION
    ).otherwise(F.lit(0.0))


def sentiment(text: Column | str, lexicon: Lexicon | None = None) -> Column:
    """Compound sentiment in [-1, 1], rounded to 4 digits; 0.0 for empty or null text."""
    lexicon = lexicon or starter_lexicon()
    if isinstance(text, str):
        return _of_column(text, lexicon, id(SparkContext._active_spark_context))
    return _scorer(text, lexicon)


@lru_cache(maxsize=32)
def _of_column(name: str, lexicon: Lexicon, context: int) -> Column:
    """The expression is large; building it once per column, lexicon and context is enough."""
    return _scorer(F.col(name), lexicon)


def _scorer(text: Column, lexicon: Lexicon) -> Column:
    text = F.coalesce(text, F.lit(""))
    lookup, listed = LookupTable(lexicon.valences), list(lexicon.valences)
    boosters = _texts(lexicon.stronger + lexicon.weaker)

    def scored(table: Column) -> Column:
        def known(word: Column) -> Column:
            return lookup.get(table, word)

        found = let(quick_tokens(text, listed, known), lambda words: of_words(words, known))
        return F.when(may_score(text, listed), found).otherwise(F.lit(0.0))

    def of_words(words: Column, known: Callable[[Column], Column]) -> Column:
        def hit(token: Column, place: Column) -> Column:
            valence = known(F.lower(token))
            return F.when(valence.isNotNull(), F.struct(place.alias("place"), valence.alias("valence")))

        hits = F.array_compact(F.transform(words, hit))
        # A booster carries no valence of its own, nor does "kind" in "kind of".
        hits = F.filter(
            hits,
            lambda h: ~F.array_contains(boosters, F.lower(F.get(words, h["place"])))
            & (_phrase(words, h["place"], 2) != "kind of"),
        )
        return let(hits, lambda found: F.when(F.size(found) == 0, F.lit(0.0)).otherwise(total(words, found, known)))

    def total(words: Column, found: Column, known: Callable[[Column], Column]) -> Column:
        # Whole-text passes only where they can matter.
        but = F.when(
            F.lower(text).contains("but"), F.array_position(F.transform(words, F.lower), F.lit("but")) - 1
        ).otherwise(F.lit(-1).cast("bigint"))
        near = F.exists(
            found, lambda h: F.exists(F.slice(words, F.greatest(h["place"] - CONTEXT + 1, F.lit(1)), CONTEXT + 1), _is_caps)
        )
        caps_matter = F.when(near, _caps_differ(words)).otherwise(F.lit(False))

        def valence(caps: Column, but_place: Column) -> Column:
            def one(h: Column) -> Column:
                own = _token_valence(words, h, caps, known, lexicon)
                side = (
                    F.when((but_place < 0) | (h["place"] == but_place), F.lit(1.0))
                    .when(h["place"] < but_place, F.lit(lx.BEFORE_BUT))
                    .otherwise(F.lit(lx.AFTER_BUT))
                )
                return own * side

            return F.aggregate(F.transform(found, one), F.lit(0.0), lambda a, b: a + b)

        summed = let(caps_matter, lambda caps: let(but, lambda b: valence(caps, b)))
        return let(summed, compound)

    def compound(raw: Column) -> Column:
        emphasis = _emphasis(text)
        total_ = F.when(raw > 0, raw + emphasis).when(raw < 0, raw - emphasis).otherwise(raw)
        return let(total_, lambda s: F.round(F.least(F.greatest(s / F.sqrt(s * s + lx.NORMALISATION), F.lit(-1.0)), F.lit(1.0)), 4))

    return let(lookup.bind(), scored)
