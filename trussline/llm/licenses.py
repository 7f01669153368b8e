"""Licence scans with a generalised suffix automaton over licence words.

The templates of `notices` are inserted, word by word, into one suffix automaton.  A text is streamed
through it: after each word the automaton's state and the matched length are the longest stretch
ending there that occurs in some template (matching statistics).  From them:

* base phrases: each is a template too; it stands wherever the matched length covers it and its
  state is the current one or a suffix of it, so every place is counted, inside longer matches too;
* template labels: for each template the stretches of at least `LONG` words that stand in it and can be
  made no longer in it, inside longer stretches of other templates too, are chained in template order with gaps of
  at most `GAP` words; a template whose chain covers `COVERED` of its words gives its label and the span from the chain's first
  word to its last.  Spans of one template do not overlap: the chain that covers most comes first.

Defined cases: null, empty and wordless texts have no words, no labels and score 0; repeated rows
are scanned alike; texts are streamed, so their length bounds memory only through their own words.
"""

from __future__ import annotations

from bisect import bisect
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, table
from .notices import NOTICES

#: Base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
LONG = 3
GAP = 3
COVERED = 0.75


class SuffixAutomaton:
    """Generalised suffix automaton over integer words of several sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: One (sequence, end) where the state's longest string ends, per sequence and end.
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, word in enumerate(seq):
                last = self._extend(last, word)
                self.ends[last].add((k, i))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state reached from p by word, made to have exactly p's length plus one."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        self.link[new] = 0 if p == -1 else self._split(p, word)
        return new


class LicenseScanner:
    def __init__(self, templates=NOTICES, phrases=None):
        phrases = PHRASES if phrases is None else phrases
        self.templates = [(label, text.encode().translate(ALNUM).split()) for label, text in templates]
        named = [(label, text.encode().split()) for text, label in phrases.items()]
        self.number = {w: n for n, w in enumerate(sorted({w for _, words in [*self.templates, *named] for w in words}))}
        coded = [[self.number[w] for w in words] for _, words in [*self.templates, *named]]
        self.coded, self.last_of = coded, {}
        self.automaton = SuffixAutomaton(coded)
        phrase_at = {}
        for (label, _), seq in zip(named, coded[len(self.templates) :], strict=True):
            state = 0
            for word in seq:
                state = self.automaton.next[state][word]
            phrase_at.setdefault(state, []).append((len(seq), label))
        #: For each state the phrases that are suffixes of its longest string.
        self.phrases: list[tuple] = []
        for state in range(len(self.automaton.next)):
            found, at = [], state
            while at > 0:
                found += phrase_at.get(at, ())
                at = self.automaton.link[at]
            self.phrases.append(tuple(found))

    def scan(self, text: bytes | None):
        """(n_words, phrase places as (start, end, label), template hits as (label, start, end, coverage))."""
        words = text.translate(ALNUM).split() if text else []
        step, link, length, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        get, state, size = self.number.get, 0, 0
        places, stretches = [], []
        for i, w in enumerate(map(get, words)):
            if w is None or w not in step[state]:
                if size >= LONG:
                    stretches += self._ending(i, state, size, w)
                if w is None:
                    state = size = 0
                    continue
                while state and w not in step[state]:
                    state = link[state]
                    size = length[state]
                if w not in step[state]:
                    state = size = 0
                    continue
            elif size >= LONG:
                stretches += self._ending(i, state, size, w)
            state = step[state][w]
            size += 1
            for need, label in phrases[state]:
                if need <= size:
                    places.append((i + 1 - need, i + 1, label))
        if size >= LONG:
            stretches += self._ending(len(words), state, size, None)
        return len(words), places, self._chain(stretches) if stretches else []

    def _ending(self, end: int, state: int, size: int, after: int | None):
        """(template, start, end, template start, template end) of the stretches that end before word
        `end`, at the places where the template does not go on with the word `after`."""
        last_of = self.last_of.get((state, after))
        if last_of is None:
            last_of = self.last_of[state, after] = self._places(state, after)
        return [(k, end - n, end, t1 - n, t1) for k, t1, most in last_of if (n := min(most, size)) >= LONG]

    def _places(self, state: int, after: int | None):
        """(template, end in it, words that agree) of the places of a state's longest string and of its suffixes."""
        found, at = {}, state
        while at > 0 and self.automaton.length[at] >= LONG:
            for k, last in self.automaton.ends[at]:
                if k < len(self.templates) and (last + 1 == len(self.coded[k]) or self.coded[k][last + 1] != after):
                    found.setdefault((k, last + 1), self.automaton.length[at])
            at = self.automaton.link[at]
        return tuple((k, t1, most) for (k, t1), most in sorted(found.items()))

    def _chain(self, stretches):
        """Best chain a template of stretches in template order, gaps of at most GAP words."""
        per: dict[int, list] = {}
        for k, *part in stretches:
            per.setdefault(k, []).append(tuple(part))
        hits = []
        for k, parts in sorted(per.items()):
            total = len(self.templates[k][1])
            chains: list[tuple[int, int, int, int]] = []  # covered, first word, last word, template end
            parts.sort()
            begin = 0  # a predecessor ends at most GAP words before
            for start, end, t0, t1 in parts:
                best = (t1 - t0, start, end, t1)
                while begin < len(chains) and chains[begin][2] + GAP < start:
                    begin += 1
                for covered, first, last, t in chains[begin:]:
                    over = max(0, t - t0)
                    if last - over <= start <= last + GAP and t <= t1 and t0 - t <= GAP + (start - last):
                        best = max(best, (covered + t1 - t0 - over, first, end, t1))
                chains.append(best)
            # chains that cover enough, the best first, each on words of its own
            taken: list[tuple[int, int]] = []
            for covered, first, last, _ in sorted((c for c in chains if c[0] >= COVERED * total), key=lambda c: (-c[0], c[2] - c[1], c[1])):
                at = bisect(taken, (first, last))
                if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or last <= taken[at][0]):
                    taken.insert(at, (first, last))
                    hits.append((self.templates[k][0], first, last, covered / total))
        return hits


@lru_cache(maxsize=1)
def scanner() -> LicenseScanner:
    return LicenseScanner()


_ADDED = [
    T.StructField("_n_words", T.LongType()),
    T.StructField("_n_base", T.LongType()),
    T.StructField("_first_word", T.LongType()),
    T.StructField("_last_word", T.LongType()),
    T.StructField("_base_labels", T.StringType()),
    T.StructField("_labels", T.StringType()),
    T.StructField("_score", T.DoubleType()),
    T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("coverage", T.DoubleType())]))),
]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with word and phrase counts, labels, the best coverage as score, and template spans
    in words; earlier columns of these names are replaced."""
    docs = docs.drop(*(f.name for f in _ADDED))
    at = docs.columns.index(text)

    def batches(it):
        scan_one = scanner().scan
        spans_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans_type]
        for batch in it:
            rows = []
            for t in batch.column(at).cast(pa.binary()).to_pylist():
                n, places, hits = scan_one(t)
                base = {label for _, _, label in places}
                starts = [s for s, _, _ in places]
                rows.append(
                    (
                        n,
                        len(places),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | {h[0] for h in hits})),
                        max([1.0] * bool(places) + [min(1.0, h[3]) for h in hits], default=0.0),
                        [{"label": a, "start": s, "end": e, "coverage": c} for a, s, e, c in hits],
                    )
                )
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(f.name for f in _ADDED)])

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *_ADDED]))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")))
