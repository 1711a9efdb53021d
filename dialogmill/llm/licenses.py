"""Licence notices in texts: a generalised suffix automaton of the notices' words, matching statistics, and chains of long matches.

One automaton holds every run of words of every notice. A text streams through it word by word; the state tells the longest run of words that
ends here and stands in some notice (the matching statistics). A run that can't grow and has ``least`` words is a
long match, and so is a whole notice: it ends where its state is the present one or lies on its suffix links, however long the run around
it. Long matches of one notice that stand in the same order in the text, with at most ``gap`` words between them, chain into a span, so a
reworded or interrupted notice is still found. A span counts from ``enough`` of the notice's words; a notice of fewer than ``whole`` words
must be whole. The phrases are lists of the same automaton, found as whole notices are.

Each text is scanned alone and whole, so nothing is shuffled. Words come from a vectorised scan, and only runs of the vocabulary's words
are streamed; in other words the automaton would be at its start. The automaton's size depends on the notices alone.

Words are looked up by 64-bit hashes (by chance one of 10^14 words may be taken for another).

Defined cases: null and empty texts have no words, no places, empty labels and score 0; a null id is kept; repeated rows give a row each; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .license_rules import NOTICES, PHRASES
from .runtime import blocks, string_buffers
from .textscan import NOT_ALNUM, Vocabulary, Words

#: Words of a long match, words that may stand between two of a chain, the share of a notice from which its label is given, and the words
#: from which a notice may be in part.
LEAST, GAP, ENOUGH, WHOLE = 3, 12, 0.8, 10


class SuffixAutomaton:
    """The runs of words of several word lists: state 0 is the empty run; ``step`` follows one word."""

    def __init__(self, lists: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (list, words up to and with the last one) where a state's runs end
        for number, words in enumerate(lists):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((number, at + 1))
        self.children_first = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in self.children_first:
            self.ends[self.link[s]] += self.ends[s]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of ``q`` for its runs of at most one word more than ``p``'s."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # an earlier list has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def step(self, state: int, held: int, word: int) -> tuple[int, int]:
        """State and length of the longest run that ends with ``word``."""
        while state and word not in self.next[state]:
            state = self.link[state]
            held = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, held + 1)


class Scanner:
    """Notices and phrases as an automaton over the numbers of their words."""

    def __init__(self, notices: list[tuple[str, str]], phrases: list[tuple[str, str]], least: int = LEAST, gap: int = GAP, enough: float = ENOUGH, whole: int = WHOLE):
        self.labels = [label for label, _ in notices]
        self.phrases = [label for _, label in phrases]
        self.least, self.gap = least, gap
        spelt = [text.split() for _, text in notices] + [text.split() for text, _ in phrases]
        names = sorted({w for words in spelt for w in words})
        number = {w: i for i, w in enumerate(names)}
        self.vocabulary = Vocabulary(names)
        self.sizes = [len(words) for words in spelt]
        self.automaton = SuffixAutomaton([[number[w] for w in words] for words in spelt])
        self.needed = [n if n < whole else enough * n for n in self.sizes]
        # whole lists that end in a state or on its links
        self.whole_at: list[list[int]] = [[] for _ in self.automaton.link]
        for s in reversed(self.automaton.children_first):  # short runs first
            shorter, longest = self.automaton.length[self.automaton.link[s]], self.automaton.length[s]
            own = [i for i, end in self.automaton.ends[s] if end == self.sizes[i] and shorter < end <= longest]
            self.whole_at[s] = self.whole_at[self.automaton.link[s]] + own

    def stream(self, words: list[int], at: int, wholes: list[tuple[int, int]], runs: list[tuple[int, int, int]]) -> None:
        """A run of the vocabulary's words that begins at word ``at`` of its text: whole lists (start, list), and runs that can't grow
        (start, words, state)."""
        step, state, held = self.automaton.step, 0, 0
        for i, word in enumerate(words):
            to, n = step(state, held, word)
            if n <= held:
                runs.append((at + i - held, held, state))
            state, held = to, n
            for number in self.whole_at[state]:
                if self.sizes[number] <= held:
                    wholes.append((at + i + 1 - self.sizes[number], number))
        if held:
            runs.append((at + len(words) - held, held, state))

    def spans(self, wholes: list[tuple[int, int]], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(notice, first word, end word, words of the notice covered) of the chains of long matches; of a notice's chains that share words of
        the text the best, and its best one if none covers what is needed."""
        matches: dict[int, set[tuple[int, int, int]]] = {}
        for start, number in wholes:
            if number < len(self.labels):
                matches.setdefault(number, set()).add((start, 0, self.sizes[number]))
        for start, n, state in runs:
            if n >= self.least:
                for number, end in self.automaton.ends[state]:
                    if number < len(self.labels):
                        matches.setdefault(number, set()).add((start, end - n, n))
        found = []
        for number, own in matches.items():
            chains: list[tuple[int, int, int]] = []  # covered, first word, end word
            rows, near = sorted(own), 0
            for i, (a, t, n) in enumerate(rows):
                covered, first = n, a
                while rows[near][0] + self.sizes[number] + self.gap < a:
                    near += 1
                for (b, u, m), (held, begun, _) in zip(rows[near:i], chains[near:i]):
                    over = max(0, b + m - a, u + m - t)  # words that both cover
                    if b < a and u < t and a - b - m <= self.gap and over < n and held + n - over > covered:
                        covered, first = held + n - over, begun
                chains.append((covered, first, a + n))
            taken: list[tuple[int, int]] = []
            for covered, first, end in sorted(chains, key=lambda c: (-c[0], c[1], c[2])):
                if covered < self.needed[number] and taken:
                    break
                if all(end <= a or first >= b for a, b in taken):
                    taken.append((first, end))
                    found.append((number, first, end, min(covered, self.sizes[number])))
        return sorted(found, key=lambda s: (s[1], s[2], s[0]))

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrase places and spans of a text, given the number of each of its words (-1 for words of no notice)."""
        wholes: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []
        inside = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a > 1:  # no phrase or notice is one word
                self.stream(ids[a:b].tolist(), a, wholes, runs)
        return [(s, n - len(self.labels)) for s, n in wholes if n >= len(self.labels)], self.spans(wholes, runs)


@functools.cache
def scanner(notices: tuple, phrases: tuple, least: int, gap: int, enough: float, whole: int) -> Scanner:
    return Scanner(list(notices), list(phrases), least, gap, enough, whole)


_FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,covered:double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())]))
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), _SPAN]


def scan_licenses(documents: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: list[tuple[str, str]] = PHRASES, least: int = LEAST, gap: int = GAP, enough: float = ENOUGH, whole: int = WHOLE) -> DataFrame:
    """Per document: n_words; n_base, first_word, last_word, base_labels of the phrases; labels (of phrases, and of notices covered as
    far as needed); score, the greatest covered share of a notice or phrase; and those notices' spans, in words from 0."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(tuple(notices), tuple(phrases), least, gap, enough, whole)
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            doc_ids, rows = batch.column(0).to_pylist(), []
            for a, b in blocks(offsets):
                words = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_ALNUM)
                ids = own.vocabulary.ids(words.hashes(fold=True))
                for d in range(b - a):
                    i, j = int(words.first[d]), int(words.first[d + 1])
                    places, spans = own.scan(ids[i:j])
                    base = sorted({own.phrases[p] for _, p in places})
                    full = [(own.labels[n], s, e, c / own.sizes[n]) for n, s, e, c in spans if c >= own.needed[n]]
                    starts = [s for s, _ in places]
                    score = max([c / own.sizes[n] for n, _, _, c in spans] + [1.0] * bool(places), default=0.0)
                    first, last = (min(starts), max(starts)) if starts else (None, None)
                    rows.append((doc_ids[a + d], j - i, len(places), first, last, ",".join(base), ",".join(sorted({*base, *(s[0] for s in full)})), score, [dict(zip(("label", "first_word", "end_word", "covered"), s)) for s in full]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(found, _FOUND)
