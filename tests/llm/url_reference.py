"""A naive Bayes classifier of urls in memory, the reference for the one that is made of joins."""

import math
from collections import Counter
from dataclasses import dataclass

from labelmill.llm.urlfilter import Unigrams, parts


class Splitter:
    """Words of hosts and paths, remembered by token."""

    def __init__(self, unigrams: Unigrams):
        self.unigrams, self.known = unigrams, {}

    def words(self, host: str, path: str) -> list[str]:
        """h:WORD of the host and p:WORD of the path; digits of any number become one word."""
        out = []
        for mark, token in parts(host, path):
            if token not in self.known:
                self.known[token] = [token] if token == "0" else self.unigrams.split(token)
            out += [mark + w for w in self.known[token]]
        return out


@dataclass(frozen=True)
class Bayes:
    weight: dict[str, float]  # log odds of block
    prior: float

    def score(self, words: list[str]) -> float:
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)


def fit(judged, unigrams: Unigrams) -> Bayes:
    """Multinomial naive Bayes on all (host, path, verdict) rows with a verdict, add-one smoothed."""
    splitter, count, seen = Splitter(unigrams), {"block": Counter(), "allow": Counter()}, Counter()
    for r in judged.filter("verdict is not null").collect():
        seen[r["verdict"]] += 1
        count[r["verdict"]].update(splitter.words(r["host"], r["path"]))
    words = set(count["block"]) | set(count["allow"])
    whole = {v: sum(c.values()) + len(words) for v, c in count.items()}
    odds = {w: math.log((count["block"][w] + 1) / whole["block"]) - math.log((count["allow"][w] + 1) / whole["allow"]) for w in words}
    return Bayes(odds, math.log((seen["block"] + 1) / (seen["allow"] + 1)))
