"""Word lists of the sentiment scorer."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

MAX_ENTRIES = 50_000

# Fixed values of the published scoring rules.
BOOST = 0.293
CAPS = 0.733
NEGATION = -0.74
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
NEVER_SO = (1.5, 1.25)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
NORMALISATION = 15.0

# Words that strengthen the word after them.
STRONGER = """
absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely especially
exceptionally extremely fabulously flippin flipping frickin fricking friggin frigging fucking fully greatly hella
highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially
thoroughly totally tremendously uber unbelievably unusually utterly very
""".split()

# Words that weaken the word after them.
WEAKER = """
almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely slightly somewhat
sorta sortof sort-of
""".split()

# Two-word weakeners.
WEAKER_PHRASES = ["just enough", "kind of", "sort of"]

# Negations.
NEGATIONS = """
aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt
hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never
none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't
weren't without wont wouldnt won't wouldn't rarely seldom despite
""".split()

# Phrases with a valence of their own.
IDIOMS = {
    "the shit": 3.0,
    "the bomb": 3.0,
    "bad ass": 1.5,
    "yeah right": -2.0,
    "cut the mustard": 2.0,
    "kiss of death": -1.5,
    "hand to mouth": -2.0,
}

# A small hand-written English list on the scale -4 .. 4.  Use ``read_lexicon``
# for a full one.
STARTER = {
    "amazing": 2.8, "awesome": 3.1, "beautiful": 2.9, "best": 3.2, "better": 1.9, "brilliant": 2.8, "bullish": 1.8,
    "calm": 1.3, "cheer": 2.3, "confident": 2.2, "cool": 1.3, "delight": 2.9, "easy": 1.9, "enjoy": 2.2,
    "excellent": 2.7, "excited": 1.4, "fair": 1.3, "fantastic": 2.6, "favorite": 2.0, "fine": 0.8, "free": 2.3,
    "fun": 2.3, "gain": 2.4, "gains": 1.4, "glad": 2.0, "good": 1.9, "great": 3.1, "growth": 1.6, "happy": 2.7,
    "help": 1.7, "hope": 1.9, "interesting": 1.7, "joy": 2.8, "kind": 2.4, "like": 1.5, "love": 3.2, "lucky": 1.8,
    "nice": 1.8, "perfect": 2.7, "please": 1.3, "pretty": 2.2, "profit": 1.9, "proud": 2.1, "rich": 2.6, "safe": 1.9,
    "smart": 1.7, "solid": 0.6, "strong": 2.3, "success": 2.7, "super": 2.9, "thanks": 1.9, "trust": 2.3,
    "value": 1.4, "win": 2.8, "winner": 2.8, "wonderful": 2.7, "worth": 0.9, "wow": 2.8, "yes": 1.7,
    "afraid": -1.7, "anger": -2.7, "awful": -2.0, "bad": -2.5, "bearish": -1.8, "crap": -1.6, "crash": -1.7,
    "crisis": -3.1, "cry": -2.1, "danger": -2.4, "dead": -3.3, "debt": -1.5, "die": -2.9, "disappointed": -2.1,
    "disgusting": -2.4, "doubt": -1.5, "dumb": -2.3, "fail": -2.5, "failure": -2.3, "fear": -2.2, "fool": -1.9,
    "fraud": -2.8, "garbage": -1.6, "greed": -1.7, "guilty": -1.8, "hate": -2.7, "horrible": -2.5, "hurt": -2.4,
    "idiot": -2.3, "kill": -3.7, "lie": -1.6, "liar": -2.3, "lose": -1.7, "loser": -2.4, "loss": -1.3, "mad": -2.2,
    "mess": -1.5, "moron": -2.2, "no": -1.2, "pain": -2.3, "panic": -2.3, "pathetic": -2.7, "poor": -2.1,
    "problem": -1.7, "risk": -1.1, "sad": -2.1, "scam": -2.7, "scared": -1.9, "scum": -2.6, "shame": -2.1,
    "stupid": -2.4, "terrible": -2.1, "trash": -2.0, "ugly": -2.3, "useless": -1.8, "vile": -3.1, "war": -2.9,
    "weak": -1.9, "worse": -2.1, "worst": -3.1, "worthless": -1.9, "wrong": -2.1,
    ":)": 2.0, ":-)": 1.3, ":d": 2.3, ";)": 0.9, ":(": -1.9, ":-(": -1.5, ":/": -1.2, "<3": 1.9,
}


@dataclass(frozen=True, eq=False)
class Lexicon:
    """Valences by lower-case token, with the modifiers around them.

    A lexicon is configuration of bounded size; ``MAX_ENTRIES`` is checked
    because it travels inside the plan to every task.
    """

    valences: dict[str, float]
    stronger: list[str] = field(default_factory=lambda: STRONGER)
    weaker: list[str] = field(default_factory=lambda: WEAKER)
    negations: list[str] = field(default_factory=lambda: NEGATIONS)
    idioms: dict[str, float] = field(default_factory=lambda: IDIOMS)
    weaker_phrases: list[str] = field(default_factory=lambda: WEAKER_PHRASES)

    def __post_init__(self) -> None:
        if len(self.valences) > MAX_ENTRIES:
            raise ValueError(f"a lexicon may have at most {MAX_ENTRIES} entries")


@cache
def starter_lexicon() -> Lexicon:
    return Lexicon(STARTER)


def read_lexicon(path: str) -> Lexicon:
    """Lexicon from a tab-separated file: token, mean valence, further columns ignored."""
    valences: dict[str, float] = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            parts = line.rstrip("\n").split("\t")
            if len(parts) >= 2 and parts[0]:
                valences[parts[0].lower()] = float(parts[1])
    return Lexicon(valences)
