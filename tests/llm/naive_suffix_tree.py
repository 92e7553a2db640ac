"""A suffix-tree language model in plain Python dictionaries, to compare with."""

import math
from collections import Counter, defaultdict

DEPTH, LEAST_COUNT, SHORT, DIVERGENCE, PRIOR = 6, 2, 2, 3.0, 4.0
BLANKS = b" \t\n\r\x0b\x0c"


def symbols(text):
    """The start mark, then words in lower case, each closed by a blank, then the end."""
    words = []
    for byte in (text or "").encode():
        if byte in BLANKS:
            words.append(b"")
        else:
            words = words or [b""]
            words[-1] += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    return b"\n" + b"".join(word + b" " for word in words if word) + b"\n"


class Naive:
    def __init__(self, texts):
        counts = defaultdict(Counter)  # context (bytes, nearest last) -> next symbols
        for text in texts:
            held = symbols(text)
            for place in range(1, len(held)):
                for size in range(0, min(DEPTH, place) + 1):
                    counts[held[place - size : place]][held[place]] += 1
        total = sum(counts[b""].values())
        self.root = {symbol: (counts[b""][symbol] + 0.01) / (total + 2.56) for symbol in range(256)}
        self.counts = {context: found for context, found in counts.items() if context and (len(context) <= SHORT or sum(found.values()) >= LEAST_COUNT)}
        self.p = {}
        kept = set()
        for context in sorted(self.counts, key=len):
            found, gain = self.counts[context], 0.0
            total = sum(found.values())
            for symbol, n in found.items():
                before = self.chained(context[1:], symbol, self.counts)
                self.p[context, symbol] = (n + PRIOR * before) / (total + PRIOR)
                gain += n * math.log(self.p[context, symbol] / before)
            if gain > DIVERGENCE or len(context) <= SHORT:
                kept.add(context)
        for context in sorted(kept, key=len, reverse=True):
            while len(context) > 1:
                context = context[1:]
                kept.add(context)
        self.kept = kept

    def chained(self, context, symbol, known):
        """Probability in the longest known suffix of the context, backing off while the symbol was not seen."""
        share = 1.0
        while context:
            if context in known:
                if (context, symbol) in self.p:
                    return share * self.p[context, symbol]
                share *= PRIOR / (sum(self.counts[context].values()) + PRIOR)
            context = context[1:]
        return share * self.root[symbol]

    def score(self, text):
        held = symbols(text)
        return sum(math.log10(self.chained(held[max(0, place - DEPTH) : place], held[place], self.kept)) for place in range(1, len(held)))
