"""Best representative of each group of duplicate records.

Token-level consensus. In each text column the distinct values of a group are aligned
progressively: the heaviest value is the spine, every value's tokens are placed on its slots,
with new slots behind a spine token for what the spine lacks; each value votes with its weight
for its token in each slot, or for leaving the slot empty. The winning tokens are the next
round's spine, on which the values are aligned once more; the tokens that win there are the
consensus, and the existing value with the fewest token edits to it comes out. The weight of a
value is the summed trust of its records (credibility, recency, confidence, completeness).

The measures (credibility_score, published_at, confidence_score and the number of website,
role and location that are filled) are columns of one token each, in which the better token
outvotes the others. The group's base record is the existing record closest to the consensus:
the fewest measures missed, then the better credibility, date, confidence and completeness,
then the fewest token edits of its texts, then the smaller record_id. It leads where it misses
no measure and no other record does so.

Every value is aligned with the spine alone, so votes add up in any order and any dealing: a
group of up to ``WHOLE`` records is worked out in one call, a larger one by aggregates per
slot over all tasks, with the same outcome.

Defined results: records without job or key belong to no group; groups of one record have no
survivor row; null and blank values cast no vote and come out only where no member has a
value; equal distances go to the heavier value, then to the smaller string; a row that
repeats a record_id counts as a record of its own in the votes, while a tie for the
leading place with itself is still a tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blank, durable, narrow

TEXT_COLUMNS = ("company", "website", "role", "location")
MEASURES = ("cred", "pub", "conf", "filled")
#: Records of a group that one call may hold.
WHOLE = 1_000
ROUNDS = 2
GAP = ""
SURVIVOR = "job_id bigint, key string, record_id bigint, leads boolean, members bigint, " + ", ".join(f"{c} string" for c in TEXT_COLUMNS)


def tokens_of(value: str) -> list[str]:
    return value.lower().split()


def align(spine: list[str], tokens: list[str]) -> list[tuple[int, int, str]]:
    """Global alignment of a value with the spine: (slot, place, token) of what it votes for.

    Slot k is the spine's token k, place 0 that token itself (``GAP`` where the value lacks
    it); places from 1 on are tokens behind it that the spine lacks, slot -1 being before the first.
    """
    n, m = len(spine), len(tokens)
    score = [[-0.5 * (i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        above, here, word = score[i - 1], score[i], spine[i - 1]
        for j in range(1, m + 1):
            here[j] = max(above[j - 1] + (1.0 if word == tokens[j - 1] else -0.6), above[j] - 0.5, here[j - 1] - 0.5)
    steps, i, j = [], n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + (1.0 if spine[i - 1] == tokens[j - 1] else -0.6):
            i, j = i - 1, j - 1
            steps.append((i, tokens[j]))
        elif i and score[i][j] == score[i - 1][j] - 0.5:
            i -= 1
            steps.append((i, GAP))
        else:
            j -= 1
            steps.append((-1, tokens[j]))
    out, slot, place = [], -1, 0
    for at, token in reversed(steps):
        slot, place = (at, 0) if at >= 0 else (slot, place + 1)
        out.append((slot, place, token))
    return out


def consensus(values: list[tuple[str, int]]) -> list[str]:
    """Winning tokens of weighted values."""
    total = sum(w for _, w in values)
    spine = tokens_of(min(values, key=lambda v: (-v[1], v[0]))[0])
    if 2 * max(w for _, w in values) > total:
        return spine  # more than half of all weight wins every slot, in every round
    split = [(tokens_of(v), w) for v, w in values]
    for _ in range(ROUNDS):
        votes: dict[tuple[int, int], dict[str, int]] = {}
        for tokens, weight in split:
            for slot, place, token in align(spine, tokens):
                ballot = votes.setdefault((slot, place), {})
                ballot[token] = ballot.get(token, 0) + weight
        spine = []
        for at in sorted(votes):
            ballot = votes[at]
            ballot[GAP] = ballot.get(GAP, 0) + total - sum(ballot.values())
            winner = min(ballot, key=lambda t: (-ballot[t], t))
            if winner != GAP:
                spine.append(winner)
    return spine


def token_distance(left: list[str], right: list[str]) -> int:
    """Edits between two token lists."""
    if left == right:
        return 0
    row = list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        diagonal, row[0] = row[0], i
        for j, b in enumerate(right, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (a != b))
    return row[-1]


def closest(values: list[tuple[str, int]]) -> tuple[str, list[str]]:
    """The existing value with the fewest token edits to the consensus, and the consensus."""
    goal = consensus(values)
    return min(values, key=lambda v: (token_distance(tokens_of(v[0]), goal), -v[1], v[0]))[0], goal


def survivor(rows: list[tuple]) -> tuple:
    """(record_id, leads, members, texts ...) of one group; rows are (record_id, weight, measures ..., texts ...)."""
    first = 2 + len(MEASURES)
    texts, goals = [], []
    for k in range(first, first + len(TEXT_COLUMNS)):
        weights: dict[str, int] = {}
        for r in rows:
            if r[k] is not None:
                weights[r[k]] = weights.get(r[k], 0) + r[1]
        if not weights:
            texts.append(None)
            goals.append([])
        elif len(weights) == 1:
            value = next(iter(weights))
            texts.append(value)
            goals.append(tokens_of(value))
        else:
            value, goal = closest(list(weights.items()))
            texts.append(value)
            goals.append(goal)
    best = [max((r[k] for r in rows if r[k] is not None), default=None) for k in range(2, first)]
    missed = [sum(r[k] != b for k, b in enumerate(best, 2)) for r in rows]
    fewest = min(missed)
    near = [r for r, n in zip(rows, missed, strict=True) if n == fewest]

    def order(r: tuple) -> tuple:
        # null is worst; the greater measure comes first
        measures = tuple((r[k] is None, -r[k] if r[k] is not None else 0) for k in range(2, first))
        return measures, sum(token_distance(tokens_of(v or ""), goal) for v, goal in zip(r[first:], goals, strict=True)), r[0]

    base = near[0] if len(near) == 1 else min(near, key=order)
    return (base[0], fewest == 0 and len(near) == 1, len(rows), *texts)


def measured(df: DataFrame) -> DataFrame:
    """The records of groups with measures and weight under fixed names; better is larger, null is worst, blank texts are null."""
    base = narrow(
        df, job_id="job_id", key="deduplication_key", record_id="record_id", company="company", website="website", role="role", location="location",
        cred="credibility_score", pub="published_at", conf="confidence_score",
    ).where("job_id IS NOT NULL AND key IS NOT NULL AND record_id IS NOT NULL")
    clean = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    filled = base.withColumns({c: F.when(~blank(F.col(c)), F.col(c)) for c in TEXT_COLUMNS} | {"cred": clean("cred"), "conf": clean("conf"), "pub": F.unix_micros(F.col("pub").cast("timestamp"))})
    filled = filled.withColumn("filled", sum(F.col(c).isNotNull().cast("int") for c in ("website", "role", "location")))
    trust = 0.2 + F.coalesce("cred", F.lit(0.0)) + F.coalesce("conf", F.lit(0.0)) / 2 + F.col("filled") * 0.1 + F.when(F.col("pub").isNotNull(), 0.2).otherwise(0.0)
    # a later record weighs a little more: one part in ten for each thousand days; whole millionths add up exactly
    recency = F.coalesce(F.col("pub") / F.lit(86_400_000_000.0 * 1000), F.lit(0.0)) * 0.1
    return filled.withColumn("w", F.greatest(F.lit(1), F.round((trust + recency) * 1_000_000)).cast("bigint"))


def whole_groups(records: DataFrame, groups: DataFrame) -> DataFrame:
    """The survivors of groups that one call holds."""
    columns = ("record_id", "w", *MEASURES, *TEXT_COLUMNS)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            rows = list(zip(*(flat.field(k).to_pylist() for k in range(len(columns))), strict=True))
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            found = [survivor(rows[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            columns_out = list(zip(*found, strict=True)) or [()] * (3 + len(TEXT_COLUMNS))
            types = [pa.int64(), pa.bool_(), pa.int64()] + [pa.string()] * len(TEXT_COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns_out, types, strict=True))], ["job_id", "key", "record_id", "leads", "members", *TEXT_COLUMNS]
            )

    joined = records.join(groups.where(F.col("members") <= WHOLE).select("job_id", "key"), ["job_id", "key"])
    return joined.groupBy("job_id", "key").agg(F.collect_list(F.struct(*columns)).alias("rows")).mapInArrow(decide, SURVIVOR)


def consensus_of_large(values: DataFrame) -> DataFrame:
    """(job_id, key, field, goal) from (job_id, key, field, value, weight): the consensus tokens, aligned and voted over all tasks."""
    group = ["job_id", "key", "field"]

    @F.arrow_udf("array<struct<slot:int,place:int,token:string>>")
    def placed(value: pa.Array, spine: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("place", pa.int32()), ("token", pa.string())]))
        rows = [[{"slot": a, "place": b, "token": t} for a, b, t in align(tokens_of(s), tokens_of(v))] for v, s in zip(value.to_pylist(), spine.to_pylist(), strict=True)]
        return pa.array(rows, kind)

    spine = values.groupBy(*group).agg(F.sum("weight").alias("total"), F.min(F.struct((-F.col("weight")).alias("w"), "value")).alias("top")).select(*group, "total", F.col("top.value").alias("goal"))
    for _ in range(ROUNDS):
        votes = values.join(spine, group).select(*group, "total", "weight", F.explode(placed("value", "goal")).alias("v"))
        ballots = votes.groupBy(*group, "v.slot", "v.place", "v.token").agg(F.sum("weight").alias("weight"), F.first("total").alias("total"))
        # what the voters for tokens leave is for the empty slot
        counted = ballots.groupBy(*group, "slot", "place").agg(
            F.first("total").alias("total"), (F.first("total") - F.sum(F.when(F.col("token") != GAP, F.col("weight")).otherwise(0))).alias("empty"),
            F.min(F.when(F.col("token") != GAP, F.struct((-F.col("weight")).alias("w"), "token"))).alias("top"),
        )
        won = F.when(-F.col("top.w") > F.col("empty"), F.struct("slot", "place", F.col("top.token").alias("token")))
        # as many slots as the texts have tokens
        spine = durable(counted.groupBy(*group).agg(F.first("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(won)), lambda s: s["token"]), " ").alias("goal")))
    return spine.select(*group, "goal")


def large_groups(records: DataFrame, groups: DataFrame) -> DataFrame:
    """The survivors of groups of any size: votes, distances and best records by aggregates that add up map-side."""
    pair = ["job_id", "key"]
    large = durable(records.join(groups.where(F.col("members") > WHOLE), pair))

    @F.arrow_udf("int")
    def edits(value: pa.Array, goal: pa.Array) -> pa.Array:
        return pa.array([token_distance(tokens_of(v or ""), tokens_of(g or "")) for v, g in zip(value.to_pylist(), goal.to_pylist(), strict=True)], pa.int32())

    stacked = F.expr("stack(4, " + ", ".join(f"'{c}', {c}" for c in TEXT_COLUMNS) + ") AS (field, value)")
    values = durable(large.select(*pair, "w", stacked).where("value IS NOT NULL").groupBy(*pair, "field", "value").agg(F.sum("w").alias("weight")))
    goals = consensus_of_large(values)
    nearest = values.join(goals, [*pair, "field"]).groupBy(*pair, "field").agg(
        F.min(F.struct(edits("value", "goal").alias("d"), (-F.col("weight")).alias("w"), "value")).alias("top"), F.first("goal").alias("goal")
    )
    of = lambda c, what: F.max(F.when(F.col("field") == c, F.col(what)))
    texts = nearest.groupBy(*pair).agg(*[of(c, "top.value").alias(f"chosen_{c}") for c in TEXT_COLUMNS], *[of(c, "goal").alias(f"goal_{c}") for c in TEXT_COLUMNS])
    best = large.groupBy(*pair).agg(F.max("members").alias("members"), *[F.max(c).alias(f"best_{c}") for c in MEASURES])
    goal = best.join(texts, pair, "left")
    kinds = large.groupBy(*pair, *MEASURES, *TEXT_COLUMNS).agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("n")).join(goal, pair)
    missed = sum((~F.col(c).eqNullSafe(F.col(f"best_{c}"))).cast("int") for c in MEASURES)
    apart = sum(edits(c, f"goal_{c}") for c in TEXT_COLUMNS)
    order = F.struct(
        missed.alias("missed"), *[x for c in MEASURES for x in (F.col(c).isNull().alias(f"no_{c}"), (-F.col(c)).alias(c))], apart.alias("apart"), "record_id"
    )
    chosen = kinds.groupBy(*pair).agg(
        F.first("members").alias("members"), F.min(order).alias("o"), F.sum(F.when(missed == 0, F.col("n")).otherwise(0)).alias("perfect"), *[F.first(f"chosen_{c}").alias(c) for c in TEXT_COLUMNS]
    )
    leads = (F.col("o.missed") == 0) & (F.col("perfect") == 1)
    return chosen.select(*pair, F.col("o.record_id").alias("record_id"), leads.alias("leads"), "members", *TEXT_COLUMNS)


def survivors(df: DataFrame) -> DataFrame:
    """One surviving record per group: the base record, whether it leads in every measure, and the consensus values."""
    records = measured(df)
    groups = durable(records.groupBy("job_id", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    found = whole_groups(records, groups)
    if not groups.where(F.col("members") > WHOLE).isEmpty():
        found = found.unionByName(large_groups(records, groups))
    return found.withColumnRenamed("key", "deduplication_key")


def dominant_records(df: DataFrame) -> DataFrame:
    """(record_id) of the survivors' base records that lead their group in every measure."""
    return survivors(df).where("leads").select("record_id").distinct()
