"""Typo operators: a word or query in, a misspelled one or NULL (declined) out.

Every random choice is a function of ``(seed, row id, slot)``, so a row gets the same typo wherever it is computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import rng, let, rng_below, tokens

# Neighbours on a QWERTY keyboard, digits included.
KEYBOARD = {
    "q": "wa12", "w": "qeas23", "e": "wrsd34", "r": "etdf45", "t": "ryfg56", "y": "tugh67", "u": "yihj78", "i": "uojk89",
    "o": "ipkl90", "p": "ol0", "a": "qwsz", "s": "awedxz", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb",
    "j": "huiknm", "k": "jiolm", "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
    "1": "q2", "2": "1w3", "3": "2e4", "4": "3r5", "5": "4t6", "6": "5y7", "7": "6u8", "8": "7i9", "9": "8o0", "0": "9p",
}
# Sounds that are taken for one another.
PHONETIC = {
    "a": ["e", "u"], "e": ["a", "i"], "i": ["e", "y"], "o": ["u", "a"], "u": ["o", "a"], "c": ["k", "s"], "k": ["c"],
    "s": ["z", "c"], "z": ["s"], "f": ["ph", "v"], "ph": ["f"], "th": ["t"], "ck": ["k", "c"], "ee": ["ea", "ie"],
    "ea": ["ee"], "ou": ["ow", "u"], "oo": ["u"], "ie": ["ei"], "ei": ["ie"],
}
DIGRAPHS = [k for k in PHONETIC if len(k) == 2]
#: Weights of the single-typo operators, in percent.
WEIGHTS = {"keyboard": 25, "delete": 15, "swap": 15, "phonetic": 20, "double": 8, "insert": 7, "omit": 10}


def _part(w: Column, start: Column | int, length: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(w, lit(start), lit(length))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def keyboard(w: Column, seed: int, row: Column) -> Column:
    """One letter becomes a neighbouring key; words of letters get letters only."""
    i = rng_below(F.length(w), seed, row, "k.at")
    ch = F.lower(_part(w, i + 1, 1))
    letters = {k: "".join(c for c in v if c.isalpha()) for k, v in KEYBOARD.items()}
    near = F.when(w.rlike("^[A-Za-z]+$"), F.element_at(_map(letters), ch)).otherwise(F.element_at(_map(KEYBOARD), ch))
    new = _part(near, rng_below(F.length(near), seed, row, "k.key") + 1, 1)
    return F.when((F.length(w) >= 2) & (F.length(near) > 0), F.concat(_part(w, 1, i), new, _part(w, i + 2, F.length(w))))


def delete(w: Column, seed: int, row: Column) -> Column:
    """One inner letter is missing."""
    i = rng_below(F.greatest(F.length(w) - 2, F.lit(1)), seed, row, "d.at") + 1
    return F.when(F.length(w) >= 4, F.concat(_part(w, 1, i), _part(w, i + 2, F.length(w))))


def swap(w: Column, seed: int, row: Column) -> Column:
    """Two neighbours change places."""
    i = rng_below(F.greatest(F.length(w) - 1, F.lit(1)), seed, row, "s.at")
    return F.when(F.length(w) >= 3, F.concat(_part(w, 1, i), _part(w, i + 2, 1), _part(w, i + 1, 1), _part(w, i + 3, F.length(w))))


def insert(w: Column, seed: int, row: Column) -> Column:
    """One letter too many."""
    i = rng_below(F.length(w) + 1, seed, row, "i.at")
    ch = _part(F.lit("abcdefghijklmnopqrstuvwxyz"), rng_below(26, seed, row, "i.key") + 1, 1)
    return F.when(F.length(w) >= 2, F.concat(_part(w, 1, i), ch, _part(w, i + 1, F.length(w))))


def double(w: Column, seed: int, row: Column) -> Column:
    """One letter twice."""
    i = rng_below(F.greatest(F.length(w), F.lit(1)), seed, row, "2.at")
    return F.when(F.length(w) >= 3, F.concat(_part(w, 1, i + 1), _part(w, i + 1, F.length(w))))


def omit(w: Column) -> Column:
    """The first doubled letter once."""
    at = F.length(F.regexp_extract(w, r"^(.*?)(.)\2", 1))
    return F.when((F.length(w) >= 4) & w.rlike(r"(.)\1"), F.concat(_part(w, 1, at), _part(w, at + 2, F.length(w))))


def phonetic(w: Column, seed: int, row: Column) -> Column:
    """A letter pair that sounds like another where the word has one, else a single letter.

    The pair, the position and the sound are chosen by the row's numbers; a pair changes at its first occurrence.
    """
    low = F.lower(w)
    sounds = _map({k: "|".join(v) for k, v in PHONETIC.items()})

    def one_of(a: Column, slot: str) -> Column:
        return F.get(a, rng_below(F.greatest(F.size(a), F.lit(1)), seed, row, slot))

    def changed(at: Column, length: int) -> Column:
        sound = let(F.split(F.element_at(sounds, F.substring(low, at, F.lit(length))), r"\|"), lambda o: one_of(o, "p.sound"))
        return F.concat(_part(w, 1, at - 1), sound, _part(w, at + length, F.length(w)))

    pairs = F.filter(F.array(*[F.lit(d) for d in DIGRAPHS]), lambda d: low.contains(d))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.substring(low, i, F.lit(1)).isin([k for k in PHONETIC if len(k) == 1]))
    by_pair = let(let(pairs, lambda p: F.position(one_of(p, "p.pair"), low)), lambda at: changed(at, 2))
    by_letter = let(let(places, lambda p: one_of(p, "p.at")), lambda at: changed(at, 1))
    return F.when(F.length(w) >= 3, F.coalesce(by_pair, by_letter))


def space(q: Column, seed: int, row: Column) -> Column:
    """Two neighbouring words joined, or a word of six letters or more split; half and half."""
    words = tokens(q)
    n = F.size(words)
    i = rng_below(F.greatest(n - 1, F.lit(1)), seed, row, "b.join") + 1
    joined = F.array_join(F.concat(F.slice(words, F.lit(1), i - 1), F.array(F.concat(F.get(words, i - 1), F.get(words, i))), F.slice(words, i + 2, n)), " ")
    long = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.length(F.get(words, k - 1)) >= 6)
    k = F.element_at(long, rng_below(F.greatest(F.size(long), F.lit(1)), seed, row, "b.word") + 1)
    word = F.get(words, k - 1)
    at = rng_below(F.greatest(F.length(word) - 3, F.lit(1)), seed, row, "b.cut") + 2
    halves = F.concat(_part(word, 1, at), F.lit(" "), _part(word, at + 1, F.length(word)))
    cut = F.array_join(F.concat(F.slice(words, F.lit(1), k - 1), F.array(halves), F.slice(words, k + 1, n)), " ")
    join = rng_below(2, seed, row, "b.mode") == 0
    return F.when(n < 2, None).when(join, joined).when(F.size(long) > 0, cut)


def single(w: Column, seed: int, row: Column) -> Column:
    """One typo by the operators' weights: seven weighted draws, the first operator that gives a different word."""
    made = {
        "keyboard": keyboard(w, seed, row), "delete": delete(w, seed, row), "swap": swap(w, seed, row), "phonetic": phonetic(w, seed, row),
        "double": double(w, seed, row), "insert": insert(w, seed, row), "omit": omit(w),
    }
    limits, upto = [], 0
    for v in WEIGHTS.values():
        upto += v
        limits.append(upto)

    def drawn(all_typos: Column) -> Column:
        def draw(k: Column) -> Column:
            r = rng_below(100, seed, row, F.concat(F.lit("1."), k.cast("string")))
            return F.get(all_typos, F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x <= r)))

        hits = F.transform(F.sequence(F.lit(0), F.lit(6)), draw)
        return F.get(F.filter(hits, lambda t: t.isNotNull() & (t != w) & (F.length(t) >= 2)), F.lit(0))

    return let(F.array(*made.values()), drawn)


def compound(w: Column, seed: int, row: Column) -> Column:
    """Two typos one after the other; the first alone where the second declines."""

    return F.when(F.length(w) >= 4, let(single(w, seed, row), lambda first: F.coalesce(single(first, seed + 1, row), first)))


def query(q: Column, seed: int, row: Column, n_errors: Column | int = 1) -> Column:
    """``n_errors`` words of letters, three or longer, misspelled, one in four of them twice; NULL where nothing changed."""
    n = n_errors if isinstance(n_errors, Column) else F.lit(n_errors)
    place = lambda i: F.concat_ws(".", row.cast("string"), i.cast("string"))

    def with_words(words: Column) -> Column:
        fit = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.get(words, i - 1).rlike("^[A-Za-z]{3,}$"))
        drawn = F.slice(F.array_sort(F.transform(fit, lambda i: F.struct(rng(seed, place(i), "q.word").alias("r"), i.alias("i")))), F.lit(1), n)

        def with_places(places: Column) -> Column:
            def typo(x: Column, k: Column) -> Column:
                at = place(k + 1)
                twice = rng_below(4, seed, at, "q.twice") == 0
                return F.coalesce(F.when(twice, compound(x, seed, at)).otherwise(single(x, seed, at)), x)

            made = F.transform(words, lambda x, k: F.when(F.array_contains(places, k + 1), typo(x, k)).otherwise(x))
            return F.when(F.size(places) > 0, F.array_join(made, " "))

        return let(F.transform(drawn, lambda s: s["i"]), with_places)

    return let(let(tokens(q), with_words), lambda out: F.when(out != q, out))


# Weights of the simpler mix of operators.
SIMPLE_WEIGHTS = {"keyboard": 3, "swap": 2, "delete": 2, "double": 1, "insert": 1}


def keyboard_letters(w: Column, seed: int, row: Column, inner: bool = False) -> Column:
    """Like `keyboard` with letter keys only; with ``inner`` the first and last letter stay, from three letters on."""
    first = 1 if inner else 0
    n = F.greatest(F.length(w) - 2 * first, F.lit(1))
    i = rng_below(n, seed, row, "k.at") + first
    near = F.element_at(_map({k: "".join(c for c in v if c.isalpha()) for k, v in KEYBOARD.items()}), F.lower(_part(w, i + 1, 1)))
    new = _part(near, rng_below(F.length(near), seed, row, "k.key") + 1, 1)
    return F.when((F.length(w) >= (3 if inner else 2)) & (F.length(near) > 0), F.concat(_part(w, 1, i), new, _part(w, i + 2, F.length(w))))


def delete_doubled(w: Column, seed: int, row: Column) -> Column:
    """The first doubled letter once, else one inner letter missing."""
    return F.when(F.length(w) >= 4, F.coalesce(omit(w), delete(w, seed, row)))


def single_simple(w: Column, seed: int, row: Column) -> Column:
    """One weighted draw among the simple operators; the keyboard's where that declines."""
    made = {"keyboard": keyboard_letters(w, seed, row), "swap": swap(w, seed, row), "delete": delete(w, seed, row), "double": double(w, seed, row), "insert": insert(w, seed, row)}
    r, upto, out = rng_below(sum(SIMPLE_WEIGHTS.values()), seed, row, "e"), sum(SIMPLE_WEIGHTS.values()), F.lit(None).cast("string")
    for k in reversed(SIMPLE_WEIGHTS):
        out = F.when(r < upto, made[k]).otherwise(out)
        upto -= SIMPLE_WEIGHTS[k]
    return F.coalesce(out, made["keyboard"])


OPERATORS = {"keyboard": keyboard, "delete": delete, "swap": swap, "insert": insert, "double": double, "phonetic": phonetic, "space": space, "single": single, "compound": compound, "query": query,
             "keyboard_letters": keyboard_letters, "delete_doubled": delete_doubled, "single_simple": single_simple}
