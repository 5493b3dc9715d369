"""A sample that matches target category proportions (problem 3), by swap repair over category signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexloom.session import cut

#: Buckets of the draw's hash: only the bucket at the cut is ordered row by row.
DRAW_BUCKETS = 65536
OTHER, SEPARATOR = "\0other", "\x1f"


def category_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def signature(c: Column, names: list[str], many: bool) -> Column:
    """The planned categories of a row in order, joined; '' for a row of none. A row may have several (an array column)."""
    listed = F.transform(c, category_key) if many else F.array(category_key(c))
    own = F.array_sort(F.array_distinct(F.filter(listed, lambda x: x.isin(names))))
    return F.coalesce(F.array_join(own, SEPARATOR), F.lit(""))


def row_hash(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))


def signature_counts(df: DataFrame, id_col: str, sig: Column, share: float, seed: int) -> dict[str, tuple[int, int]]:
    """Per signature: its rows, and those that a random sample of ``share`` of all rows draws. Signatures are bounded by the plan."""
    drawn = F.pmod(F.xxhash64(F.lit("start"), row_hash(id_col, seed)), F.lit(2**31)) < int(share * 2**31)
    return {r["sig"]: (r["n"], r["k"]) for r in df.groupBy(sig.alias("sig")).agg(F.count(F.lit(1)).alias("n"), F.count_if(drawn).alias("k")).collect()}


def read_plan(plan: DataFrame) -> dict[str, tuple[float, int]]:
    """``{category: (share, floor)}``; categories are compared trimmed and in lower case, NULL ones are left out."""
    out: dict[str, tuple[float, int]] = {}
    for r in plan.select("category", "target_share", "min_rows").collect():
        if r["category"] is not None:
            share, floor = out.get(r["category"].strip().lower(), (0.0, 0))
            out[r["category"].strip().lower()] = (share + float(r["target_share"] or 0), max(floor, int(r["min_rows"] or 0)))
    return out


def parts_of(sig: str) -> frozenset[str]:
    return frozenset(sig.split(SEPARATOR)) if sig else frozenset()


def shared_out(n: int, room: dict[str, int]) -> dict[str, int]:
    """``n`` rows over signatures in proportion to their room, in whole numbers, the largest remainders first."""
    whole = sum(room.values())
    n = min(n, whole)
    out = {s: n * r // whole if whole else 0 for s, r in room.items()}
    left = sorted(room, key=lambda s: (-(n * room[s] % whole if whole else 0), s))
    for s in left[: n - sum(out.values())]:
        out[s] += 1
    return out


def feasible_floors(floors: dict[str, int], available: dict[str, int], size: int) -> dict[str, int]:
    """Floors as far as rows and sample allow: none above its category's rows, all scaled down where they exceed the sample."""
    have = {c: sum(n for s, n in available.items() if c in parts_of(s)) for c in floors}
    can = {c: min(f, have[c]) for c, f in floors.items()}
    return can if sum(can.values()) <= size else shared_out(size, can)


def random_start(available: dict[str, int], drawn: dict[str, int], floors: dict[str, int], size: int) -> dict[str, int]:
    """The random sample's signature counts, mended until every floor holds and they sum to ``size``.

    What a category lacks is taken from its signatures with rows left, what the sample has too many of is given back by
    signatures that are above all their floors, each in proportion.
    """
    take = {s: min(drawn.get(s, 0), n) for s, n in available.items()}
    for c in sorted(floors):
        lack = floors[c] - sum(k for s, k in take.items() if c in parts_of(s))
        if lack > 0:
            for s, k in shared_out(lack, {s: n - take[s] for s, n in available.items() if c in parts_of(s)}).items():
                take[s] += k
    if sum(take.values()) < size:
        for s, k in shared_out(size - sum(take.values()), {s: n - take[s] for s, n in available.items()}).items():
            take[s] += k
    while sum(take.values()) > size:
        have = {c: sum(k for s, k in take.items() if c in parts_of(s)) for c in floors}
        spare = {s: max(0, min([k, *[have[c] - floors[c] for c in parts_of(s) if c in floors]])) for s, k in take.items()}
        most = max(sorted(spare), key=lambda s: spare[s])
        if not spare[most]:
            break
        take[most] -= max(1, min(spare[most], (sum(take.values()) - size) * spare[most] // sum(spare.values())))
    return take


def swap_repair(take: dict[str, int], available: dict[str, int], share: dict[str, float], floors: dict[str, int], size: int) -> dict[str, int]:
    """Exchange counts between two signatures while that lowers the squared deviation of the categories from their targets.

    Rows of no planned category deviate from none. The exchange with the best improvement is made at its best width, so
    the number of steps does not grow with the rows. It ends where no exchange of one row improves; floors hold at every
    step.
    """
    take = dict(take)
    parts = {s: parts_of(s) or frozenset([OTHER]) for s in available}
    aim = {c: share.get(c, 0.0) * size for p in parts.values() for c in p}
    while True:
        have = {c: sum(k for s, k in take.items() if c in parts[s]) for c in aim}
        off = {c: have[c] - aim[c] for c in aim}
        best, move = 1e-9, None
        for a in sorted(take):
            if not take[a]:
                continue
            for b in sorted(take):
                gone, come = parts[a] - parts[b], parts[b] - parts[a]
                give = min([take[a], available[b] - take[b], *[have[c] - floors.get(c, 0) for c in gone]])
                if a == b or give <= 0 or not gone | come:
                    continue
                slope, width = sum(off[c] for c in gone) - sum(off[c] for c in come), len(gone) + len(come)
                k = min(give, max(1, round(slope / width)))
                gain = 2 * k * slope - k * k * width
                if gain > best:
                    best, move = gain, (a, b, k)
        if move is None:
            return take
        a, b, k = move
        take[a] -= k
        take[b] += k


def draw(df: DataFrame, id_col: str, sig: Column, take: dict[str, int], seed: int) -> DataFrame:
    """Exactly ``take[s]`` rows of each signature, at random: ``example_id, sig``.

    A histogram of each row's hash finds the bucket in which the count is reached; buckets below are taken whole and
    only that one is ordered. So a signature that holds most rows never meets in one task.
    """
    hashed = df.select(F.col(id_col).alias("example_id"), sig.alias("sig"), row_hash(id_col, seed).alias("h"))
    hashed = hashed.withColumn("b", F.pmod("h", F.lit(DRAW_BUCKETS)).cast("int"))
    quota = df.sparkSession.createDataFrame([(s, int(n)) for s, n in take.items()] or [("", 0)], "sig string, k bigint")
    hist = hashed.groupBy("sig", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("sig").orderBy("b")
    upto = hist.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(quota), "sig")
    edge = cut(upto.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select("sig", F.col("b").alias("edge"), (F.col("k") - F.col("upto") + F.col("n")).alias("more")))
    # one edge bucket for each signature: bounded by the plan
    marked = hashed.join(F.broadcast(edge), "sig")
    below = marked.filter(F.col("b") < F.col("edge")).select("example_id", "sig")
    at = marked.filter(F.col("b") == F.col("edge")).withColumn("r", F.row_number().over(Window.partitionBy("sig").orderBy("h", "example_id")))
    return below.unionByName(at.filter(F.col("r") <= F.col("more")).select("example_id", "sig"))


def quota_sample(df: DataFrame, id_col: str, category_col: str, plan: DataFrame, fraction: tuple[int, int] = (1, 5), seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)``: the drawn rows, and per planned category what was wanted, available and taken.

    ``category_col`` may be an array: a row then counts for each of its planned categories, and rows of equal categories
    are one signature. ``sample`` is ``example_id, category``, with the categories of a row of several joined by
    ``' | '`` and NULL for a row of none. ``report`` is ``category, available, wanted, floor, taken, short``; ``short``
    where the finished sample holds all rows there are and still lacks some of the larger of floor and share. Rows
    whose category is NULL or not planned are used only where the planned ones run out. Floors that do not fit into the
    sample together are scaled down. An empty table gives an empty sample and a report in which every category with a
    wish is short. Repeated ids are separate rows of the population; two rows of one id fall together as ties of the
    draw's order.
    """
    wanted = read_plan(plan)
    names = sorted(wanted)
    sig = signature(F.col(category_col), names, dict(df.dtypes)[category_col].startswith("array"))
    counts = signature_counts(df, id_col, sig, fraction[0] / fraction[1], seed)
    available = dict.fromkeys(names, 0) | {s: n for s, (n, _) in counts.items()}
    size = sum(available.values()) * fraction[0] // fraction[1]
    if "" in available:  # only what the planned categories cannot give
        available[""] = max(0, min(available[""], size - sum(n for s, n in available.items() if s)))
    share, floors = {c: v[0] for c, v in wanted.items()}, {c: v[1] for c, v in wanted.items()}
    least = feasible_floors(floors, available, size)
    start = random_start(available, {s: k for s, (_, k) in counts.items()}, least, size)
    take = swap_repair(start, available, share, least, size)
    of = lambda c, by: sum(n for s, n in by.items() if c in parts_of(s))
    report = []
    for c in names:
        quota, have, got = max(floors[c], share[c] * size), of(c, available), of(c, take)
        report.append((c, have, share[c] * size, floors[c], got, got < quota and got == min(have, size)))
    rep = df.sparkSession.createDataFrame(report, "category string, available bigint, wanted double, floor bigint, taken bigint, short boolean")
    drawn = draw(df, id_col, sig, take, seed)
    return drawn.select("example_id", F.when(F.col("sig") != "", F.replace("sig", F.lit(SEPARATOR), F.lit(" | "))).alias("category")), rep
