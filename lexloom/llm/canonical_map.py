"""Free-entered values to a canonical list (problem 1).

An automaton over all names and aliases, written without spaces, finds the mentions that stand in a value letter for
letter, however its words are joined, split or cased; the longest non-overlapping ones win. What is left of the value
goes to token-set similarity: its words, alone and joined with their neighbours, are looked up among the words of the
names with up to two wrong letters. The most specific entry all of whose words were found is the value's canonical.

The list travels with the function, in parts of a bounded number of entries; the values stay where they are. A list of
one part needs no shuffle; of several parts each value's best entry over the parts is kept.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.lookalike import fold_python
from lexloom.session import cut

#: Entries that are taken along at once (about 2 KB an entry with its word index); longer lists are matched in parts.
PART_ENTRIES = 200_000
#: Words of fewer letters (edition words) and numbers must be right.
FUZZY_LETTERS = 6
MOST_EDITS = 2
#: Results kept for values and words seen again.
MEMORY = 100_000
PARTS = re.compile(r"[^\W\d_]+|\d+")
# Words after which, or before which, a number is an amount and not part of a name.
CURRENCY = frozenset("€ $ £ usd eur gbp dollar dollars euro euros pound pounds inch inches cm mm pack pcs".split())
ABOUT = frozenset("about under over below around".split())


def osa(a: str, b: str, most: int = MOST_EDITS) -> int:
    """Edit distance with exchanged neighbours as one edit; ``most + 1`` stands for anything larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


def shortened(word: str, edits: int) -> set[str]:
    """The word and what is left of it without up to ``edits`` letters."""
    out = layer = {word}
    for _ in range(edits):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out = out | layer
    return out


class Automaton:
    """All places of many names in one pass over a text (goto, fail and output tables)."""

    def __init__(self):
        self.goto: list[dict[str, int]] = [{}]
        self.out: list[list] = [[]]
        self.fail = [0]

    def __len__(self) -> int:
        return len(self.goto) - 1

    def add_word(self, word: str, value) -> None:
        at = 0
        for c in word:
            if c not in self.goto[at]:
                self.goto[at][c] = len(self.goto)
                self.goto.append({})
                self.out.append([])
                self.fail.append(0)
            at = self.goto[at][c]
        self.out[at] = [value]

    def make_automaton(self) -> None:
        todo = deque(self.goto[0].values())
        while todo:
            at = todo.popleft()
            for c, to in self.goto[at].items():
                f = self.fail[at]
                while f and c not in self.goto[f]:
                    f = self.fail[f]
                self.fail[to] = self.goto[f].get(c, 0)
                self.out[to] = self.out[to] + self.out[self.fail[to]]
                todo.append(to)

    def iter(self, text: str) -> Iterator[tuple]:
        """``(end, value)`` of every name that ends at a place, the longest first."""
        at = 0
        for end, c in enumerate(text):
            while at and c not in self.goto[at]:
                at = self.fail[at]
            at = self.goto[at].get(c, 0)
            for value in self.out[at]:
                yield end, value


class CanonicalIndex:
    """The list prepared for matching: automaton, word index and the entries by their words."""

    def __init__(self, entries: list[tuple[str, list[str]]]):
        self.patterns: dict[tuple[str, ...], tuple[str, int]] = {}
        by_squash: dict[str, tuple[str, ...]] = {}
        for canonical, aliases in entries:
            own = tuple(PARTS.findall(fold_python(canonical)))
            squashed = "".join(own)
            for name in [canonical, *aliases]:
                words = tuple(PARTS.findall(fold_python(name)))
                if "".join(words) == squashed:
                    words = own
                if not words:
                    continue
                # an alias of several entries belongs to the least specific one, then to the first by name
                rank = (len(own), canonical)
                if words not in self.patterns or rank < (self.patterns[words][1], self.patterns[words][0]):
                    self.patterns[words] = (canonical, len(own))
                by_squash.setdefault("".join(words), words)
        self.automaton = Automaton()
        for s, words in by_squash.items():
            self.automaton.add_word(s, words)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.words = {w for p in self.patterns for w in p}
        self.fuzzy = {w for w in self.words if w.isalpha() and len(w) >= FUZZY_LETTERS}
        self.exact = self.words - self.fuzzy
        self.by_word: dict[str, list[tuple[frozenset, tuple[str, int]]]] = {}
        for p, target in self.patterns.items():
            anchor = max(p, key=lambda w: (w in self.fuzzy, len(w), w))
            self.by_word.setdefault(anchor, []).append((frozenset(p), target))
        self.deletes: dict[str, list[str]] = {}
        for w in self.fuzzy:
            for s in shortened(w, MOST_EDITS):
                self.deletes.setdefault(s, []).append(w)
        self.longest = max(map(len, self.fuzzy), default=0) + MOST_EDITS
        self.known: dict[str, tuple[int, str] | None] = {}
        self.values: dict[str, tuple[str | None, str | None, tuple | None]] = {}

    def closest(self, s: str) -> tuple[int, str] | None:
        """The name word within ``MOST_EDITS`` of ``s``, the closest and then the first, with its distance."""
        if not FUZZY_LETTERS - MOST_EDITS <= len(s) <= self.longest:
            return None
        if s in self.fuzzy:
            return 0, s
        if s not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            near = {w for k in shortened(s, MOST_EDITS) for w in self.deletes.get(k, ())}
            best = min(((osa(s, w), w) for w in near), default=None)
            self.known[s] = best if best and best[0] <= MOST_EDITS else None
        return self.known[s]

    def find(self, value: str) -> tuple[str | None, str | None, tuple | None]:
        """``(canonical, method, rank)`` of a value; all None if it names no entry. Lower ranks are better."""
        if value not in self.values:
            if len(self.values) >= MEMORY:
                self.values.clear()
            self.values[value] = self._find(value)
        return self.values[value]

    def _find(self, value: str) -> tuple[str | None, str | None, tuple | None]:
        folded = fold_python(value)
        tokens = [m for m in re.finditer(r"[^\W\d_]+|\d+|[€$£]", folded)]
        parts = [m[0] for m in tokens]
        found: set[str] = set()
        covered = self._embedded(parts, found)
        mentioned = set(found)
        run: list[str] = []
        for i, p in enumerate(parts):
            rest = covered.get(i, p)
            if p.isdigit():
                if rest and p in self.exact and not self._amount(parts, tokens, i):
                    found.add(p)
                continue
            if i in covered:
                self._similar(run, found)
                run = []
                if rest:
                    self._similar([rest], found)
            elif p.isalpha():
                run.append(p)
        self._similar(run, found)
        return self._resolve(found, mentioned)

    def _embedded(self, parts: list[str], found: set[str]) -> dict[int, str]:
        """Mentions the automaton finds, longest first and without overlap; returns what they leave of each part they touch."""
        text, owner = [], []
        for i, p in enumerate(parts):
            if i and p.isdigit() and parts[i - 1].isdigit():
                text.append("\0")
                owner.append(-1)
            text.append(p)
            owner.extend([i] * len(p))
        flat = "".join(text)
        hits = []
        for end, words in self.automaton.iter(flat) if len(self.automaton) else ():
            start = end + 1 - sum(map(len, words))
            whole_start = not flat[start].isdigit() or start == 0 or not flat[start - 1].isdigit()
            whole_end = not flat[end].isdigit() or end + 1 == len(flat) or not flat[end + 1].isdigit()
            if end + 1 - start < FUZZY_LETTERS:  # a short name stands alone, not inside a word
                whole_start &= start == 0 or owner[start - 1] != owner[start]
                whole_end &= end + 1 == len(flat) or owner[end + 1] != owner[end]
            if whole_start and whole_end:
                hits.append((start - end - 1, start, end + 1, words))
        taken = bytearray(len(flat))
        touched: dict[int, str] = {}
        for _, start, end, words in sorted(hits):
            if any(taken[start:end]):
                continue
            taken[start:end] = b"\1" * (end - start)
            found.update(words)
            touched.update((owner[k], "") for k in range(start, end))
        for i in touched:
            touched[i] = "".join(c for k, c in enumerate(flat) if owner[k] == i and not taken[k])
        return touched

    def _amount(self, parts: list[str], tokens: list, i: int) -> bool:
        """A number that states a price or a size; one written onto a code of a few letters is no name's number either."""
        if i and (parts[i - 1] in ABOUT or parts[i - 1] in "€$£"):
            return True
        if i + 1 < len(parts) and parts[i + 1] in CURRENCY:
            return True
        return bool(i) and tokens[i - 1].end() == tokens[i].start() and len(parts[i - 1]) < 3

    def _similar(self, run: list[str], found: set[str]) -> None:
        """Name words among neighbouring parts, alone or joined, closest first."""
        spans = []
        for i in range(len(run)):
            if run[i] in self.exact:
                found.add(run[i])
            for j in range(i + 1, min(i + 3, len(run)) + 1):
                s = "".join(run[i:j])
                if j > i + 1 and s in self.exact and len(s) > 2:
                    found.add(s)
                near = self.closest(s)
                if near:
                    spans.append((near[0], j - i, i, j, near[1]))
        used = [False] * len(run)
        for _, _, i, j, w in sorted(spans):
            if not any(used[i:j]):
                used[i:j] = [True] * (j - i)
                found.add(w)
        for i, p in enumerate(run):
            if not used[i] and len(p) >= 2 * FUZZY_LETTERS - 2:
                self._inside(p, found)

    def _inside(self, s: str, found: set[str]) -> None:
        """Name words in a part that joins several words: the best cut at which one side is a name word."""
        best = None
        for k in range(2, len(s) - 1):
            for near, rest in ((self.closest(s[:k]), s[k:]), (self.closest(s[k:]), s[:k])):
                if near:
                    other = self.closest(rest)
                    rank = (other is None, near[0] + (other[0] if other else 0), near[1])
                    if best is None or rank < best[0]:
                        best = (rank, near[1], other[1] if other else None, rest)
        if best:
            found.add(best[1])
            if best[2]:
                found.add(best[2])
            elif best[3] in self.exact:
                found.add(best[3])
            elif len(best[3]) >= 2 * FUZZY_LETTERS - 2:
                self._inside(best[3], found)

    def _resolve(self, found: set[str], mentioned: set[str]) -> tuple[str | None, str | None, tuple | None]:
        """The entry with most of its words found; then the one named in more words, the shorter, the first.

        The method is ``mention`` where the automaton found all words of the name, else ``similar``.
        """
        best = None
        for w in found:
            for words, (canonical, size) in self.by_word.get(w, ()):
                if words <= found:
                    own = sum(x in found for x in PARTS.findall(fold_python(canonical)))
                    rank = (-own, -len(words), size, canonical)
                    if best is None or rank < best[0]:
                        best = (rank, canonical, "mention" if words <= mentioned else "similar")
        return (best[1], best[2], best[0]) if best else (None, None, None)


def read_entries(catalog: DataFrame, part: int, parts: int) -> list[tuple[str, list[str]]]:
    """The names and aliases of one part of the list. A NULL alias list is the name alone; NULL aliases and names are left out."""
    own = catalog.select("canonical", "exact_aliases").filter(F.col("canonical").isNotNull() & (F.pmod(F.xxhash64("canonical"), F.lit(parts)) == part))
    return sorted((r["canonical"], sorted({a for a in r["exact_aliases"] or [] if a})) for r in own.collect())


FOUND = "canonical string, method string, own int, words int, size int"


def _matched(rows: DataFrame, entries: list[tuple[str, list[str]]]) -> DataFrame:
    """The rows with the best entry of one part of the list, and its rank."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CanonicalIndex(entries)
        for pdf in batches:
            got = [index.find(v) if isinstance(v, str) else (None, None, None) for v in pdf["value"]]
            ranks = pd.DataFrame([g[2][:3] if g[2] else (None, None, None) for g in got], columns=["own", "words", "size"], dtype="Int32", index=pdf.index)
            yield pdf.assign(canonical=[g[0] for g in got], method=[g[1] for g in got], own=ranks["own"], words=ranks["words"], size=ranks["size"])[[*names, "canonical", "method", "own", "words", "size"]]

    types = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in names) + ", " + FOUND)


def map_to_canonical(values: DataFrame, catalog: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """``id, value, canonical, method``: one row for each row of ``values``.

    ``method`` is ``mention`` where the automaton found all words of the name, ``similar`` where token-set similarity
    found some of them. NULL, blank and unreadable values and values that name no entry have a NULL canonical: they are
    the unmatched. A list of more than ``PART_ENTRIES`` entries is matched in parts, and the best entry of all parts, by
    the same order, is kept; a value whose words belong to entries of several parts is compared by each part's own.
    """
    parts = max(1, -(-catalog.count() // PART_ENTRIES))
    rows = values.select(F.col(id_col).alias("id"), F.col(value_col).alias("value"))
    if parts == 1:
        return _matched(rows, read_entries(catalog, 0, 1)).select("id", "value", "canonical", "method")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    best = None
    for part in range(parts):
        one = _matched(rows, read_entries(catalog, part, parts)).filter(F.col("canonical").isNotNull()).select("row", F.struct("own", "words", "size", "canonical", "method").alias("m"))
        best = one if best is None else best.unionByName(one)
    best = best.groupBy("row").agg(F.min("m").alias("m"))
    return rows.join(best, "row", "left").select("id", "value", F.col("m.canonical").alias("canonical"), F.col("m.method").alias("method"))
