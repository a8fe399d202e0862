"""The Kneser-Ney models against probabilities written out from their definition."""

import math
import random
from collections import Counter

import pytest

from gatewise.llm import toxicity
from gatewise.llm.toxicity import BEGIN, DISCOUNT, END, LETTERS, ORDER


def corpus(seed):
    rng = random.Random(seed)
    ordinary = ["".join(rng.choices("abcde", k=rng.randrange(1, 7))) for _ in range(60)]
    toxic = ["".join(rng.choices("abcxy", k=rng.randrange(1, 7))) for _ in range(40)]
    return ordinary, toxic


def counted(words):
    out = Counter()
    for w in words:
        out.update(toxicity.grams(w))
    return out


class Plain:
    """Interpolated Kneser-Ney by its formula: class counts on top, numbers of distinct letters before below."""

    def __init__(self, own, kinds):
        self.own, self.kinds = own, kinds

    def shared(self, context, letter):
        """After ``context``: how many kinds of letters stand before the sequence, if it does not begin a word."""
        lower = self.shared(context[1:], letter) if context else 1 / LETTERS
        return self.discounted(self.continuations(len(context) + 1), context, letter, lower)

    def continuations(self, k):
        """Sequences of k letters: distinct letters before each; those at a word's start stand for themselves, but lower orders keep those longer than one."""
        found = Counter()
        longer = set(g for g in self.kinds if len(g) == k + 1)
        if k + 1 < ORDER:  # sequences that shorten to this length on the way down
            for j in range(k + 2, ORDER + 1):
                longer |= {g[j - k - 1 :] for g in self.kinds if len(g) == j}
        for g in longer:
            found[g[1:]] += 1
        return found

    def discounted(self, counts, context, letter, lower):
        here = {g: n for g, n in counts.items() if g[:-1] == context}
        total = sum(here.values())
        if not total:
            return lower
        return (max(here.get(context + letter, 0) - DISCOUNT, 0) + DISCOUNT * len(here) * lower) / total

    def probability(self, gram, c):
        context, letter = gram[:-1], gram[-1]
        return self.discounted(self.own[c], context, letter, self.shared(context[1:], letter) if context[1:] or len(gram) > 1 else 1 / LETTERS)


def test_differences_are_those_of_the_formula():
    ordinary, toxic = corpus(3)
    own = (counted(ordinary), counted(toxic))
    model = toxicity.KneserNey({g: (own[0][g], own[1][g]) for g in own[0] | own[1]})
    plain = Plain(own, set(own[0] | own[1]))
    for word in ["abc", "xyx", "a", "abcde", "zzz", "ayz", "bad"] + ordinary[:5] + toxic[:5]:
        want = sum(math.log(plain.probability(g, 1) / plain.probability(g, 0)) for g in toxicity.grams(word))
        assert model.of_word(word) == pytest.approx(want, abs=1e-9), word
    words = ["abc", "xyx", "zzz"]
    total = sum(map(model.of_word, words)) / sum(len(w) + 1 for w in words)
    assert model.difference("  ABC xyx\n zzz") == pytest.approx(total) and model.difference(None) == model.difference(" ") == 0


def test_class_models_are_distributions():
    ordinary, toxic = corpus(5)
    own = (counted(ordinary), counted(toxic))
    plain = Plain(own, set(own[0] | own[1]))
    letters = sorted({g[-1] for g in own[0] | own[1]})
    contexts = {g[:-1] for g in own[0]}
    for context in sorted(contexts)[:40]:
        seen = sum(plain.probability(context + x, 0) for x in letters)
        unseen = plain.probability(context + "☃", 0) * (LETTERS - len(letters))
        assert seen + unseen == pytest.approx(1)


def test_grams():
    assert toxicity.grams("ab") == [BEGIN + "a", BEGIN + "ab", (BEGIN + "ab" + END)[-ORDER:]]
    assert toxicity.grams("") == [BEGIN + END]
