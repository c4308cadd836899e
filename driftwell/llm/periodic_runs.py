"""Periodic runs of words, found online by catchers over completed power-of-two blocks.

A run is a longest stretch of consecutive words with smallest period q and at least two periods: words q apart are identical.

The words of a text are numbered from 0. For every power of two h, a catcher stands over each block [y, y + h) of h words, y being a
multiple of h; once the block is complete it watches the words at y + h + 1 to y + 2 h, so a word that is appended meets one catcher a
level, and that one stands for the period p = (place of the word) - y, which is between h + 1 and 2 h (period 1 has a level of its own). If the
word equals the one at y, the common suffix of the text up to here and the text up to y says since when words p apart have been
equal, and each word appended later carries the comparison on until one differs. As soon as p words in a row were equal a square is there. A
square of period p has p equal pairs in a row, so one of them begins at a multiple of h, and its catcher sees it: no square is missed.
Squares of a period that share their first word are the same run, and of periods that give the same stretch the least is the run's own.

``Catchers`` is that state for a tape of texts: it takes any number of words at a time, one by one or whole texts, and says what it
knows after each call. Comparisons of many catchers are made at once: four words one by one, which ends nearly all, then prefix
hashes by two primes, so that an append takes O(log n) steps a level however long a run is.

Words are what white space parts, compared by 64-bit hashes. Texts that are null or without words have no runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import slices, small_batches, word_hashes

RUNS = "array<struct<start: long, length: long, period: long>>"
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASE = 1_000_003
_DIRECT = 4


def _powers(n: int, prime: int) -> np.ndarray:
    """The first ``n`` powers of the base, doubled up."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * (int(out[-1]) * _BASE % prime) % prime])
    return out[:n]


class _Tape:
    """Words with prefix hashes, and how far two places of the same text agree."""

    def __init__(self, words: np.ndarray):
        self.words, self.sums = words, None

    def _hashes(self) -> None:
        self.sums = []
        for prime in _PRIMES:
            power = _powers(len(self.words) + 1, prime)
            terms = (self.words % np.uint64(prime)).astype(np.int64) * power[:-1] % prime
            self.sums.append((np.concatenate([[0], np.cumsum(terms) % prime]), power, prime))

    def _same(self, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        """Whether the ``n`` words from x and those from y > x are the same."""
        same = np.ones(len(x), bool)
        for s, power, prime in self.sums:
            same &= (s[x + n] - s[x]) % prime * power[y - x] % prime == (s[y + n] - s[y]) % prime
        return same

    def agree(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many words agree from x and from y > x on, or (way -1) before them, ``most`` at most."""
        out, alive = np.zeros(len(x), np.int64), np.flatnonzero(most > 0)
        for k in range(_DIRECT):
            step = k if way > 0 else -1 - k
            alive = alive[self.words[x[alive] + step] == self.words[y[alive] + step]]
            out[alive] += 1
            alive = alive[most[alive] > k + 1]
            if not len(alive):
                return out
        if self.sums is None:
            self._hashes()
        for bit in range(int(most[alive].max()).bit_length() - 1, -1, -1):
            n = 1 << bit
            fits = alive[out[alive] + n <= most[alive]]
            back = out[fits] if way > 0 else -out[fits] - n
            out[fits[self._same(x[fits] + back, y[fits] + back, n)]] += n
        return out


class Catchers:
    """The state of a tape of texts. ``append`` takes words and tells which of them begin a text; ``runs`` of the texts seen are ready at any time.

    Of texts that have ended only their runs are kept; of the last one, its words and the comparisons that no word has ended yet.
    """

    def __init__(self, least: int = 12):
        self.least, self.text = least, -1
        self.words = np.zeros(0, np.uint64)
        self.live = np.zeros((2, 0), np.int64)  # first place and period of what has agreed up to the last word
        self.found: dict[tuple[int, int, int], int] = {}  # (text, start, period): length

    def append(self, words: np.ndarray, begins: np.ndarray) -> None:
        if not len(words):
            return
        if self.text < 0 and not begins[0]:
            raise ValueError("the first word begins a text")
        if begins[0]:
            self.words, self.live = self.words[:0], self.live[:, :0]
        before = len(self.words)
        tape = _Tape(np.concatenate([self.words, words]))
        text_of = np.concatenate([np.zeros(before, np.int64), np.cumsum(begins)]) + self.text
        starts = np.concatenate([[0] if before else [], np.flatnonzero(begins) + before]).astype(np.int64)
        ends = np.append(starts[1:], len(tape.words))
        which = np.repeat(np.arange(len(starts)), ends - starts)
        start, end = starts[which], ends[which]
        place = np.arange(len(tape.words)) - start

        caught = [self._carried(tape, before, int(ends[0]))]
        new = np.arange(before, len(tape.words))
        caught.append(self._met(tape, new[place[new] > 0], lambda at: at - 1, 1, start, end))
        h = 1
        while h < int(place.max(initial=0)):
            new = new[place[new] > h]
            caught.append(self._met(tape, new, lambda at, h=h: at - ((place[at] - 1) % h + 1 + h), h, start, end))
            h *= 2
        first, last, period = (np.concatenate(x) for x in zip(*caught))
        self._report(text_of[first], first - start[first], last - first, period)

        # what agrees up to the end of the tape may go on
        on = last + period == len(tape.words)
        tail = int(starts[-1])
        pairs = np.unique(np.stack([first[on] - tail, period[on]]), axis=1) if on.any() else np.zeros((2, 0), np.int64)
        self.words, self.live, self.text = tape.words[tail:], pairs, int(text_of[-1])

    @staticmethod
    def _met(tape: _Tape, at: np.ndarray, catcher, h: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, period) of the stretches whose words equal those a period later, of appended words that equal their catcher's.

        Where the common suffix reaches the catcher before, that one has the stretch already.
        """
        y = catcher(at)
        hit = tape.words[at] == tape.words[y]
        at, y = at[hit], y[hit]
        back = tape.agree(y, at, np.minimum(y - start[y], h), -1)
        first = back < h
        at, y, back = at[first], y[first], back[first]
        on = tape.agree(y, at, end[at] - at, 1)
        return y - back, y + on, at - y

    def _carried(self, tape: _Tape, before: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The comparisons that were alive before, carried on."""
        first, period = self.live
        on = tape.agree(np.full(len(first), before) - period, np.full(len(first), before), np.full(len(first), end - before), 1)
        return first, before - period + on, period

    def _report(self, text: np.ndarray, first: np.ndarray, same: np.ndarray, period: np.ndarray) -> None:
        length = same + period
        full = (same >= period) & (length >= self.least)
        text, first, length, period = (x[full] for x in (text, first, length, period))
        order = np.lexsort((period, length, first, text))
        text, first, length, period = (x[order] for x in (text, first, length, period))
        new = np.ones(len(text), bool)  # of the periods of one stretch, the least
        new[1:] = (text[1:] != text[:-1]) | (first[1:] != first[:-1]) | (length[1:] != length[:-1])
        for t, a, n, p in zip(*(x[new].tolist() for x in (text, first, length, period))):
            if self.found.get((t, a, p), 0) < n:
                self.found[t, a, p] = n

    def runs(self) -> dict[int, list[tuple[int, int, int]]]:
        """(start, length, period) of each text with runs, by start and period."""
        own: dict[tuple[int, int, int], int] = {}
        for (t, a, p), n in self.found.items():
            own[t, a, n] = min(p, own.get((t, a, n), p))
        out: dict[int, list[tuple[int, int, int]]] = {}
        for (t, a, n), p in own.items():
            out.setdefault(t, []).append((a, n, p))
        return {t: sorted(x, key=lambda r: (r[0], r[2])) for t, x in out.items()}


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay when each run leaves its first period, joined by a space."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for a, n, p in runs:
            edge[a + p] += 1
            edge[a + n] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
    return b" ".join(words)


def _runs_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            rest = [k for k, name in enumerate(batch.schema.names) if name != "_text"]
            for a, b in slices(texts):
                some = texts.slice(a, b - a)
                hashes, first = word_hashes(some, lower=False)
                begins = np.zeros(len(hashes), bool)
                full = np.flatnonzero(np.diff(first))
                begins[first[full]] = True
                catchers = Catchers(least)
                catchers.append(hashes, begins)
                found = catchers.runs()
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(b - a)]
                for t, x in found.items():
                    runs[full[t]] = x
                kept = [_collapsed((text or "").encode().split(), x).decode() for text, x in zip(some.to_pylist(), runs)]
                value = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] for x in runs], kind)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in rest), pa.array(np.diff(first), pa.int64()), value, pa.array(kept, pa.string())],
                    names=[*(batch.schema.names[k] for k in rest), "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words, by start and period) of ``least`` words or more, and collapsed
    instead of the text: its words, without those that a run has after its first period, joined by one space.

    Columns of ``docs`` keep their names and order; one that is called like a new one gives way to the new one. Each row is judged by
    its own text, so ids may be null, repeated or of any type; null texts and texts without words have no runs and collapse to an empty text.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed", text)]
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = dict(keyed.dtypes)
    own = ", ".join(f"c{k} {kinds[f'c{k}']}" for k in range(len(names)))
    done = keyed.mapInArrow(_runs_of(least), f"{own}{', ' if own else ''}n_words long, runs {RUNS}, collapsed string")
    return done.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), "n_words", "runs", "collapsed")


def longest(runs: str = "runs") -> F.Column:
    """The run of greatest length; ties go to the least start, then the least period. Null where there is none."""
    before = "CASE WHEN x.length <> y.length THEN sign(y.length - x.length) WHEN x.start <> y.start THEN sign(x.start - y.start) ELSE sign(x.period - y.period) END"
    return F.expr(f"get(array_sort({runs}, (x, y) -> cast({before} as int)), 0)")


def with_planted_run(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where a tenth of the texts, by the crc32 h of the id, repeat themselves from word a = g % n on with period 1 + floor((n - a) / (3 + g % 8)); g = floor(h / 10).

    Words of a changed text are joined by one space. Rows whose id or text is null stay as they are.
    """
    h = F.crc32(F.col(id).cast("string").cast("binary"))
    ink = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    w = F.split(ink, r"[\x20\x09-\x0D]+")
    n, g = F.size(w), F.floor(h / 10)
    # once a row: words, where the repeats begin, and their period
    at = F.transform(F.array(F.struct(w.alias("w"), (g % n).cast("int").alias("a"), g.alias("g"))), lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"), (1 + F.floor((F.size(s["w"]) - s["a"]) / (3 + s["g"] % 8))).cast("int").alias("p")))
    said = F.transform(at, lambda s: F.array_join(F.transform(s["w"], lambda x, i: F.when(i >= s["a"], F.get(s["w"], s["a"] + (i - s["a"]) % s["p"])).otherwise(x)), " "))
    return docs.withColumn(text, F.when((h % 10 == 0) & (ink != ""), said[0]).otherwise(F.col(text)))
