"""Splits that keep related records together (problem 2), by grouped iterative stratification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.lookalike import words_of
from lexloom.operators.skew import join_back
from lexloom.session import cut, cut_table, drop_table

#: A component with at least one row in this many is placed before all others; there can be at most this many.
GIANT_SHARE = 2000
#: Components per task of the second step.
SHARD_COMPONENTS = 20_000


def target_key(target: Column) -> Column:
    """The key of a target text: its words in order. NULL where there is no word to compare."""
    words = words_of(target)
    return F.when(F.size(words) > 0, F.unhex(F.md5(F.array_join(words, " "))))


def alone_key(id_col: str) -> Column:
    """The key of a row that shares nothing with another row."""
    return F.unhex(F.md5(F.concat_ws("|", F.lit("alone"), F.col(id_col).cast("string"))))


def linked(nodes: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's component, given rows of nodes that belong together (``nodes array<binary>``).

    Labels are spread along the links and then jump to the label of their label, so the rounds grow with the logarithm of
    a component's width; each round is cut. A node of many links is counted down before the shuffle and its label comes
    back by a join safe from hot keys. Only numbers reach the driver.
    """
    first = F.get("nodes", F.lit(0))
    links = nodes.select(first.alias("a"), F.explode("nodes").alias("b")).distinct()
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = links.count()
    labels = cut_table(links.groupBy("a").agg(F.min("b").alias("label"), F.count(F.lit(1)).alias("n")).withColumn("label", F.least("a", "label")))
    while True:
        reached = join_back(links, labels, "a", "n", total, ["label"]).groupBy(F.col("b").alias("a")).agg(F.min("label").alias("near"))
        new = labels.join(reached, "a").select("a", "n", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        of_label = new.groupBy(F.col("label").alias("at")).agg(F.count(F.lit(1)).alias("m")).join(new.select(F.col("a").alias("at"), F.col("label").alias("further")), "at")
        new = cut_table(join_back(new.withColumn("at", F.col("label")), of_label, "at", "m", total, ["further"]).select("a", "n", "old", F.coalesce("further", "label").alias("label")))
        moved = new.filter("label <> old").count()
        drop_table(labels)
        labels = new.select("a", "n", "label")
        if not moved:
            return labels.select(F.col("a").alias("node"), "label", "n")


def components(df: DataFrame, id_col: str, keys: list[Column], label_col: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, comps)``: rows as ``id, key, label``; comps as ``key, first_id, n, labels map<string,bigint>``.

    Rows that share any of the keys (binary) are one component. A row all of whose keys are NULL shares nothing and is a
    component of its own. Counts are combined per key and label before the shuffle, so a key that holds a third of all
    rows arrives as one row per label. A row's label is its trimmed lower-case category; a NULL label counts as ``''``.
    """
    label = F.coalesce(F.lower(F.trim(F.col(label_col))), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(keys[0], alone_key(id_col)).alias("key"), label.alias("label"))
    if len(keys) > 1:
        tagged = [F.when(k.isNotNull(), F.unhex(F.md5(F.concat_ws("|", F.lit(str(i)), F.hex(k))))) for i, k in enumerate(keys)]
        own = F.filter(F.array(*tagged), lambda x: x.isNotNull())
        rows = df.select(F.col(id_col).alias("id"), F.when(F.size(own) > 0, own).otherwise(F.array(alone_key(id_col))).alias("nodes"), label.alias("label"))
        rows = cut(rows.withColumn("node", F.get("nodes", F.lit(0))))
        of = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m")).join(linked(rows.select("nodes").distinct()).select("node", F.col("label").alias("key")), "node")
        rows = cut(join_back(rows.select("id", "label", "node"), cut(of), "node", "m", rows.count(), ["key"]).select("id", "key", "label"))
    per_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    comps = per_label.groupBy("key").agg(
        F.min("first_id").alias("first_id"), F.sum("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels"),
    )
    return rows, comps


def stratify(comps: pd.DataFrame, targets: dict[tuple[str, str], float], splits: list[str]) -> list[str]:
    """Place components: the rarest outstanding label first, into the split that needs it most.

    ``comps`` has ``key`` and ``labels`` (label, count pairs). ``targets`` holds the rows of each label each split
    still wants and is used up. Ties go to the split that wants most rows in all, then to the earlier one.
    """
    vectors = [[(str(a), int(b)) for a, b in dict(v).items()] for v in comps["labels"]]
    keys = [bytes(k) for k in comps["key"]]
    want = {s: sum(v for (_, t), v in targets.items() if t == s) for s in splits}
    by_label: dict[str, list[int]] = {}
    left: dict[str, int] = {}
    for i, vec in enumerate(vectors):
        for label, n in vec:
            by_label.setdefault(label, []).append(i)
            left[label] = left.get(label, 0) + n
    size = [sum(n for _, n in vec) for vec in vectors]
    out: list[str | None] = [None] * len(vectors)
    while left:
        label = min(left, key=lambda x: (left[x], x))
        own = dict((i, n) for i in by_label[label] if out[i] is None for lab, n in vectors[i] if lab == label)
        for i in sorted(own, key=lambda i: (-own[i], -size[i], keys[i])):
            best = max(range(len(splits)), key=lambda k: (targets.get((label, splits[k]), 0.0), want[splits[k]], -k))
            s = splits[best]
            out[i] = s
            for lab, n in vectors[i]:
                targets[lab, s] = targets.get((lab, s), 0.0) - n
                left[lab] = left.get(lab, 0) - n
            want[s] -= size[i]
        left = {k: v for k, v in left.items() if v > 0 and k != label}
    return [s if s is not None else splits[0] for s in out]


def place(comps: pd.DataFrame, wants: pd.DataFrame, splits: list[str]) -> pd.DataFrame:
    """The split of each component of one task, by what the splits want there."""
    comps = comps.sort_values("key", key=lambda c: c.map(bytes))
    targets = {(r.label, r.split): float(r.want) for r in wants.itertuples()}
    return pd.DataFrame({"key": comps["key"], "split": stratify(comps, targets, splits)})


def grouped_split(df: DataFrame, id_col: str, keys: list[Column], label_col: str, plan: DataFrame) -> DataFrame:
    """``example_id, first_id, n_component, split``: every row's split, whole components together.

    Step one places the components of at least one row in ``GIANT_SHARE`` (at most that many) in one task. Step two
    deals the other components evenly over tasks of about ``SHARD_COMPONENTS`` and gives each task a whole-number part
    of what the splits still want of each label: running totals over the tasks are rounded, so that the parts add up to
    the whole and a label too rare for one task still reaches every split. What is wanted meets its task as a table; the
    driver sees the plan and three numbers. Shares of ``plan`` are scaled to sum 1; the plan must be a small table of
    named splits. An empty table gives an empty result.
    """
    wanted = sorted(((r["split_name"], float(r["target_share"] or 0)) for r in plan.select("split_name", "target_share").collect()), key=lambda x: (-x[1], x[0]))
    whole = sum(s for _, s in wanted) or 1.0
    splits = [s for s, _ in wanted]
    rows, comps = components(df, id_col, keys, label_col)
    comps = cut(comps)
    facts = comps.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("comps")).first()
    total, n_comps = int(facts["rows"] or 0), int(facts["comps"] or 0)
    giant_at = max(2, total // GIANT_SHARE)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(v / whole).alias("share")) for s, v in wanted]))
    per_label = comps.select(F.explode("labels").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))
    wants = cut(per_label.select("label", "n", each.alias("s")).select("label", F.col("s.split").alias("split"), (F.col("n") * F.col("s.share")).alias("want")))

    def place_group(comps: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        return place(comps, wants, splits) if len(comps) else pd.DataFrame({"key": [], "split": []})

    giants = cut(comps.filter(F.col("n") > giant_at).withColumn("task", F.lit(0)))
    of_giants = wants.join(giants.select(F.explode(F.map_keys("labels")).alias("label")).distinct(), "label", "left_semi").withColumn("of_task", F.lit(0))
    placed = cut(giants.groupBy("task").cogroup(of_giants.groupBy("of_task")).applyInPandas(place_group, "key binary, split string"))
    used = placed.join(giants.select("key", "labels"), "key").select("split", F.explode("labels").alias("label", "n")).groupBy("label", "split").agg(F.sum("n").alias("used"))
    need = wants.join(used, ["label", "split"], "left").select("label", "split", F.greatest(F.col("want") - F.coalesce("used", F.lit(0)), F.lit(0.0)).alias("need"))
    shards = max(1, -(-n_comps // SHARD_COMPONENTS))
    rest = comps.filter(F.col("n") <= giant_at).withColumn("task", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    load = rest.select("task", F.explode("labels").alias("label", "n")).groupBy("task", "label").agg(F.sum("n").alias("n"))
    # one row for each task, label and split: as many tasks as there are, whatever a label's rows
    by_task = Window.partitionBy("label", "split").orderBy("task")
    parts = load.join(need, "label").withColumn("seen", F.sum("n").over(by_task.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("all", F.sum("need").over(Window.partitionBy("label", "task")))
    parts = parts.withColumn("upto", F.when(F.col("all") > 0, F.round(F.col("need") * F.col("seen") / F.col("all"))).otherwise(F.lit(0.0)))
    parts = parts.select(F.col("task").alias("of_task"), "label", "split", (F.col("upto") - F.lag("upto", 1, 0.0).over(by_task)).alias("want"))
    small = rest.select("task", "key", "labels").groupBy("task").cogroup(parts.groupBy("of_task")).applyInPandas(place_group, "key binary, split string")
    assigned = cut(comps.select("key", "first_id", "n").join(placed.unionByName(small), "key"))
    out = join_back(rows.select("id", "key"), assigned, "key", "n", total, ["first_id", "n", "split"])
    return out.select(F.col("id").alias("example_id"), "first_id", F.col("n").alias("n_component"), "split")
