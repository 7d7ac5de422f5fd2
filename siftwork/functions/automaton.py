"""Many phrases in one pass over a text: an Aho-Corasick automaton, built once a worker, over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick

#: White space of the regular expressions elsewhere.
_SPACE = re.compile("[ \t\n\x0b\f\r]+")


def flat(text: str) -> str:
    """Single spaces for white space; the case is the caller's."""
    return _SPACE.sub(" ", text)


def no_letter(c: str) -> bool:
    return not c.isalpha()


def no_term_before(c: str) -> bool:
    return not (c.isalpha() or c.isnumeric() or c in "#+.")


def no_term_after(c: str) -> bool:
    return not (c.isalpha() or c.isnumeric() or c in "#+")


#: Distinct words that a worker remembers.
WORDS = 200_000


class _Words(dict):
    """A word of a text -> the phrases that stand in it as a whole."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.phrases.whole(word))
        # Long words are hardly ever met again.
        if len(word) <= 40:
            self[word] = found
        return found


class Phrases:
    """Phrases of lower case as they stand in a lower-case text, where the characters around them pass ``before`` and ``after``."""

    def __init__(self, phrases: list[str], before: Callable[[str], bool] = no_letter, after: Callable[[str], bool] = no_letter):
        self.phrases, self.before, self.after = [flat(p) for p in phrases], before, after
        self._automaton = self._words = self._rest = None

    def __getstate__(self):
        # Workers build their own automata from the phrases.
        return self.__dict__ | {"_automaton": None, "_words": None, "_rest": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for i, p in enumerate(self.phrases):
                if p:
                    made.add_word(p, (*made.get(p, ()), i))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def inside(self, text: str) -> list[int]:
        """Places in the list of the phrases that occur at all, in list order; text has single spaces."""
        return sorted({i for _, places in self.automaton.iter(text) for i in places}) if len(self.automaton) else []

    def _stands(self, text: str, start: int, end: int) -> bool:
        return (start == 0 or self.before(text[start - 1])) and (end == len(text) or self.after(text[end]))

    def whole(self, text: str) -> set[int]:
        """Places in the list of the phrases that stand as a whole."""
        hits = self.automaton.iter(text) if len(self.automaton) else ()
        return {i for last, places in hits for i in places if self._stands(text, last + 1 - len(self.phrases[i]), last + 1)}

    def spans(self, text: str, i: int) -> Iterator[tuple[int, int]]:
        """Leftmost spans of one phrase, which do not overlap."""
        phrase, at = self.phrases[i], 0
        while (at := text.find(phrase, at)) >= 0:
            if self._stands(text, at, at + len(phrase)):
                yield at, at + len(phrase)
                at += len(phrase)
            else:
                at += 1

    def likely(self, text: str) -> set[int]:
        """Phrases that may stand in a text, or in what is left of it when others are taken out.

        A phrase without spaces, whose ends are letters or digits where those may not stand beside a phrase, stands in a text only if it
        stands in one of its words: taking others out never changes what is beside it.  What each word holds is remembered; the few
        other phrases are looked for in the whole text.
        """
        if self._rest is None:
            ends = lambda p: p and " " not in p and not any(f(c) for f in (self.before, self.after) for c in (p[0], p[-1]))
            own = [p if ends(p) else "" for p in self.phrases]
            self._rest = Phrases([p if not q else "" for p, q in zip(self.phrases, own, strict=True)], self.before, self.after)
            self._words = _Words(Phrases(own, self.before, self.after))
        found = set(self._rest.inside(text))
        if len(self._words) > WORDS:
            self._words.clear()
        return found.union(*map(self._words.__getitem__, set(text.split(" "))))

    def taken(self, text: str) -> list[int]:
        """Phrases in list order, each taken out of the text before the next is looked for."""
        rest, found = text, []
        for i in sorted(self.likely(text)):
            cut, last = [], 0
            for start, end in self.spans(rest, i):
                cut.append(rest[last:start])
                last = end
            if last:
                found.append(i)
                rest = flat(" ".join([*cut, rest[last:]]))
        return found
