"""Selection of items with an exact or closest total of marks, many requests at once.

Reachable sums form a bit set; an item adds the set shifted by its marks, and each sum remembers the first item that reached it.
Random order is a hash of item and seed, so a selection can be derived again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .library import preset_pool

# The caps of the reference, for callers who want its very results; without them any total is solved.
CAP_EXACT, CAP_CLOSEST = 200, 220
# What a request is told where too few questions are unattempted.
UNATTEMPTED_FEW, UNATTEMPTED_NONE = "Unattempted-only mode (supplemented with attempted questions)", "Unattempted-only mode (no unattempted questions remaining)"
#: Rows of one request that one task takes as they are; larger requests are first cut to the rows that they can use.
MOST_ROWS = 200_000
#: Presets are a list that people keep.
MOST_PRESETS = 10_000


def _reach(marks: list[int], most: int, stop_at: int | None = None) -> tuple[int, dict[int, int]]:
    first: dict[int, int] = {}
    open_, every = 1, (1 << most + 1) - 1
    for i, m in enumerate(marks):
        if 0 < m <= most:
            new = open_ << m & every & ~open_
            open_ |= new
            while new:
                top = new.bit_length() - 1
                first[top] = i
                new ^= 1 << top
            if open_ == every or stop_at is not None and open_ >> stop_at & 1:
                break
    return open_, first


def _walk(marks: list[int], first: dict[int, int], total: int) -> list[int]:
    out = []
    while total > 0:
        i = first[total]
        out.append(i)
        total -= marks[i]
    return out[::-1]


def exact_subset(marks: list[int], target: int, cap: int | None = None) -> list[int] | None:
    """Places of items that add up to ``target`` exactly, each used once; None if there are none. Targets above ``cap``, where
    one is given, count as it."""
    if target == 0:
        return []
    most = target if cap is None else min(cap, target)
    if most <= 0 or not marks:
        return None
    open_, first = _reach(marks, most, most)
    return _walk(marks, first, most) if open_ >> most & 1 else None


def closest_subset(marks: list[int], target: int, cap: int | None = None, cap_exact: int | None = None) -> list[int]:
    """Exact if it can be; else the nearest sum up to target + 12 (and ``cap``), the lower of two; everything if that is too little; the
    first item if nothing is in reach."""
    if target <= 0 or not marks:
        return []
    found = exact_subset(marks, target, cap_exact)
    if found is not None:
        return found
    usable = [i for i, m in enumerate(marks) if m > 0]
    if not usable:
        return []
    values = [marks[i] for i in usable]
    if sum(values) <= target:
        return usable
    _, first = _reach(values, target + 12 if cap is None else min(cap, target + 12))
    if not first:
        return [usable[0]]
    best = min(first, key=lambda s: (abs(s - target), s))
    return [usable[i] for i in _walk(values, first, best)]


def assemble(pool: pd.DataFrame | dict[str, list], target: int, mcq_share: float) -> tuple[list[int], list[str]]:
    """An authentic paper from a pool with columns id, marks, kind, topic, paper, priority, order: choice items by topic in turn up to
    their share, then theory items up to a buffer below the target, then the closest fill; a global exact selection if that misses."""
    log: list[str] = []
    usage: Counter = Counter()
    chosen: list[int] = []
    marks = [int(m) for m in pool["marks"]]
    kinds, topics, paper, priority, order = (list(pool[c]) for c in ("kind", "topic", "paper", "priority", "order"))

    def deal(places: list[int], limit: float, goal: float) -> int:
        buckets: dict[str, list[int]] = {}
        for i in sorted(places, key=lambda i: (-priority[i], order[i])):
            buckets.setdefault(topics[i], []).append(i)
        turn, total, picked = sorted(buckets, key=lambda b: order[buckets[b][0]]), 0, True
        while picked and total < goal:
            picked = False
            for b in turn:
                if total >= goal:
                    break
                fits = [i for i in buckets[b] if total + marks[i] <= limit]
                if fits:
                    i = min(fits, key=lambda i: usage[paper[i]])
                    buckets[b].remove(i)
                    chosen.append(i)
                    usage[paper[i]] += 1
                    total += marks[i]
                    picked = True
        return total

    choice = [i for i in range(len(marks)) if kinds[i] == "mcq" and marks[i] > 0]
    theory = [i for i in range(len(marks)) if kinds[i] != "mcq" and marks[i] > 0]
    share = round(target * mcq_share)
    done = deal(choice, share, share) if share else 0
    wanted = target - done
    buffer = min(18, max(6, wanted // 4))
    done += deal(theory, wanted - 4, wanted - buffer)
    if done < target:
        taken = set(chosen)
        rest = sorted((i for i in theory if i not in taken), key=lambda i: (usage[paper[i]], order[i]))
        chosen += [rest[j] for j in closest_subset([marks[i] for i in rest], target - done)]
    total = sum(marks[i] for i in chosen)
    if total != target:
        every = sorted(range(len(marks)), key=lambda i: order[i])
        exact = exact_subset([marks[i] for i in every], target)
        if exact is not None:
            chosen = [every[j] for j in exact]
            log.append("exact repair")
    total = sum(marks[i] for i in chosen)
    if total < target:
        log.append("below target")
    return chosen, log


def _first_rows(df: DataFrame, by: list[str], order: list[str], many: Column, most: int | None = None) -> DataFrame:
    """The first rows of each group, so that no task reads a large group whole: where ``most`` is known as their largest number, Spark
    cuts groups to it before rows move; else of 64 parts of a group first."""
    for keys in ([*by, "__part"], by) if most is None else (by,):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        df = df.withColumn("__place", place).where((F.col("__place") <= many) & (F.lit(True) if most is None else F.col("__place") <= most))
    return df.drop("__place")


def _first_papers(df: DataFrame, by: list[str], order: list[str], many: Column) -> DataFrame:
    """The first rows of the first papers of each group, papers in order of their first row."""
    w = Window.partitionBy(*by, "paper").orderBy(*order, "__copy")
    df = df.withColumn("__place", F.row_number().over(w)).withColumn("__head", F.first(F.struct(*order, "paper")).over(w)).where(F.col("__place") <= many)
    df = df.withColumn("__part", F.pmod(F.xxhash64("paper"), F.lit(64)))
    for keys in ([*by, "__part"], by):
        df = df.withColumn("__place", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__head"))).where(F.col("__place") <= many)
    return df.drop("__place", "__head")


def bounded_pool(pool: DataFrame, target: str = "target", dealt: bool = False, most: int | None = None) -> DataFrame:
    """The rows of a pool that a selection can use at all, so that a request's rows have a bound set by its target alone.

    Sums up to ``limit = target + 12`` are reached first by the first rows in order: of equal marks ``limit / marks`` rows, since with
    one more an earlier one is free for the same sum. A dealt paper also takes, in each topic, first rows of papers least used; it
    uses at most ``target`` papers, so the first ``limit + 1`` papers, and as many rows of each, hold every row that it can take.
    Selections are those of the whole pool; rows without marks above zero are never selected. ``most`` is the largest target, where
    it is known.
    """
    limit = F.col(target) + 12
    rows = pool.where("marks > 0").where(limit > 0)
    used, known = F.floor(limit / F.col("marks")) + 1, None if most is None else most + 13
    if not dealt:
        return _first_rows(rows.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(64))), ["request", "marks"], ["order", "id"], used, known).drop("__part")
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least("__n", (limit + 1).cast("long")).cast("int")))).drop("__n")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("id", "__copy"), F.lit(64)))
    out = _first_rows(rows, ["request", "marks"], ["order", "id", "__copy"], used, known).drop("__part")
    rows = rows.withColumn("__mcq", F.coalesce(F.col("kind") == "mcq", F.lit(False))).withColumn("__rank", -F.col("priority"))
    topics = _first_papers(rows, ["request", "__mcq", "topic", "marks"], ["__rank", "order", "id"], limit + 1)
    fill = _first_papers(rows.where("not __mcq"), ["request", "marks"], ["order", "id"], 2 * limit + 1)
    return out.unionByName(topics.select(*out.columns)).unionByName(fill.select(*out.columns)).distinct().drop("__copy")


def _large_cut(pool: DataFrame, dealt: bool, most_rows: int, made: dict[str, Column]) -> DataFrame:
    """The pool with requests above ``most_rows`` rows cut by ``bounded_pool``; the driver sees these requests' names."""
    sizes = pool.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.max("target").alias("most"))
    large = F.when(F.col("n") > most_rows, F.struct("request", "most"))
    seen = sizes.agg(F.collect_list(large).alias("large"), F.count(F.lit(1)).alias("every")).first()
    if not seen["large"]:
        return pool
    names, most = [r["request"] for r in seen["large"]], max(r["most"] for r in seen["large"])
    if len(names) == seen["every"]:
        return bounded_pool(pool.withColumns(made), dealt=dealt, most=most).select(*pool.columns)
    is_large = F.coalesce(F.col("request").isin([n for n in names if n is not None]), F.lit(None in names))
    return pool.where(~is_large).unionByName(bounded_pool(pool.where(is_large).withColumns(made), dealt=dealt, most=most).select(*pool.columns))


def _whole_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Each request's rows as one batch, together with those of its neighbours: rows come sorted by request."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            ends = pc.run_end_encode(batch.column("request")).run_ends.to_pylist()
            last = ends[-2] if len(ends) > 1 else 0
            if last or held and held[-1].column("request")[-1].as_py() != batch.column("request")[0].as_py():
                yield pa.concat_batches([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _selections(rows: pa.RecordBatch, mcq_share: float = 0.0, closest: bool = True) -> pa.RecordBatch:
    """The selections of whole requests, whose rows stand together and in order."""
    targets, marks = (rows.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("target", "marks"))
    begin, taken, totals, logs = 0, [], [], []
    for end in pc.run_end_encode(rows.column("request")).run_ends.to_pylist():
        mine, log = marks[begin:end], []
        if mcq_share:
            part = rows.slice(begin, end - begin)
            places, log = assemble({c: part.column(c).to_pylist() for c in part.schema.names}, targets[begin], mcq_share)
        else:
            places = closest_subset(mine, targets[begin]) if closest else exact_subset(mine, targets[begin]) or []
        taken += [begin + i for i in places]
        totals += [sum([mine[i] for i in places])] * len(places)
        logs += ["; ".join(log)] * len(places)
        begin = end
    got = rows.select(["request", "id", "marks", "target"]).take(pa.array(taken, pa.int64()))
    columns = [got.column(c) for c in ("request", "id", "marks")] + [pa.array(totals, pa.int32()), got.column("target"), pa.array(logs, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["request", "id", "marks", "total", "target", "log"])


def select_exams(pool: DataFrame, target: str = "target", mcq_share: float = 0.0, closest: bool = True, most_rows: int = MOST_ROWS, made: dict[str, Column] | None = None) -> DataFrame:
    """Solve one selection a request: ``pool`` has (request, target, id, marks, order) and, for papers dealt with a share of choice
    items, (kind, topic, paper, priority). Gives (request, id, marks, total, target, log). ``order`` is text or, in fewer bytes, binary.

    Rows move once, to their request, and are read there in order, many requests in one batch. Requests of more than ``most_rows`` rows,
    which are counted first, are cut by ``bounded_pool`` before, so that the rows of one request have a bound however large its pool.

    ``made`` may give ``id`` and ``order`` as expressions of the pool's other columns: these move in their place, and are the fewer bytes
    where they are numbers. Requests that are whole numbers move and are sorted as such.
    """
    dealt, types = bool(mcq_share), dict(pool.dtypes)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_requests(batches):
            yield _selections(rows, mcq_share, closest)

    kinds = {"request": types["request"] if types["request"] in ("int", "bigint") else "string", "target": "int", "id": "string", "marks": "int", "order": "binary" if types.get("order") == "binary" else "string"} | ({"kind": "string", "topic": "string", "paper": "string", "priority": "int"} if dealt else {})
    made = {c: x.cast("string") if c == "id" else x for c, x in (made or {}).items()}
    others = [c for c in pool.columns if c not in kinds and c != target] if made else []
    rows = pool.withColumn("target", F.col(target)).select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items() if c not in made), *others).where("marks > 0 and target > -12")
    rows = _large_cut(rows, dealt, most_rows, made).repartition("request").withColumns(made).select(*kinds)
    rows = rows.sortWithinPartitions("request", F.asc_nulls_last("order"), F.asc_nulls_last("id"), *(c for c in kinds if c not in ("request", "order", "id")))
    # rows are in order: where no paper is dealt, tasks need not see what they were ordered by
    chosen = (rows if dealt else rows.drop("order")).mapInArrow(solved, f"request {kinds['request']}, id string, marks int, total int, target int, log string")
    return chosen.withColumn("request", F.col("request").cast("string"))


def seeded_order(key: Column, seed: str) -> Column:
    """A shuffle that any engine can repeat."""
    return F.md5(F.concat(key, F.lit(seed)))


def soft_filter(df: DataFrame, by: list[str], wanted: Column, note: str = "") -> DataFrame:
    """Keep a group's wanted rows; a group without any keeps all of its rows, and where the rows have a list ``relaxed``, ``note`` is
    added to it. One flag a group is aggregated and joined back; no group's rows meet in one task."""
    some = df.where(wanted).select(*(F.col(c).alias(f"__{c}") for c in by)).distinct().withColumn("__some", F.lit(True))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    out = df.join(some, same, "left").where(F.col("__some").isNull() | wanted)
    if note and "relaxed" in df.columns:
        out = out.withColumn("relaxed", F.when(F.col("__some").isNull(), F.array_append("relaxed", F.lit(note))).otherwise(F.col("relaxed")))
    return out.select(*df.columns)


def prepare_pool(df: DataFrame, *, mode: str = "balanced", structure: str = "authentic", units: list[str] | None = None, subtopics: list[str] | None = None, seed: str = "1") -> DataFrame:
    """A request's questions with priority and order: rows (request, target, id, marks, kind, topic, subtopic, unit, paper, status,
    is_bookmarked).

    Unit, type and subtopic are soft constraints. Unattempted-only is used where it leaves enough marks. Priorities: 50; review
    first 300 for bookmarked or wrong, 100 unattempted, else 20; unattempted only 250 or 40; 150 more for a chosen subtopic; up to 40
    by the seeded hash. ``relaxed`` lists the constraints of a request that its questions could not meet.
    """
    df = df.where("marks > 0").withColumn("relaxed", F.array().cast("array<string>"))
    if units:
        df = soft_filter(df, ["request"], F.col("unit").isin(units), f"Unit filter ({', '.join(units)})")
    if structure in ("theory_only", "mcq_sprint"):
        df = soft_filter(df, ["request"], F.col("kind") == ("mcq" if structure == "mcq_sprint" else "theory"), "MCQ-only filter" if structure == "mcq_sprint" else "Theory-only filter")
    if subtopics:
        df = soft_filter(df, ["request"], F.col("subtopic").isin(subtopics), "Selected topic/subtopic filter")
    status = F.coalesce("status", F.lit("unattempted"))
    if mode == "unattempted_only":
        fresh = status == "unattempted"
        sums = df.groupBy(F.col("request").alias("__request")).agg(F.sum(F.when(fresh, F.col("marks")).otherwise(0)).alias("__marks"), F.sum(fresh.cast("long")).alias("__fresh"), F.count(F.lit(1)).alias("__all"))
        both = df.join(sums, F.col("request").eqNullSafe(F.col("__request")))
        enough = (F.col("__fresh") > 0) & (F.col("__marks") >= F.col("target"))
        note = F.when(enough, None).when(F.col("__fresh") == 0, UNATTEMPTED_NONE).when(F.col("__fresh") < F.col("__all"), UNATTEMPTED_FEW)
        both = both.withColumn("relaxed", F.when(note.isNotNull(), F.array_append("relaxed", note)).otherwise(F.col("relaxed")))
        df = both.where(~enough | fresh).select(*df.columns)
        base = F.when(fresh, 250).otherwise(40)
    elif mode == "review_first":
        base = F.when(F.coalesce("is_bookmarked", F.lit(False)) | status.isin("review", "incorrect"), 300).when(status == "unattempted", 100).otherwise(20)
    else:
        base = F.lit(50)
    chosen = F.when(F.col("subtopic").isin(subtopics), 150).otherwise(0) if subtopics else F.lit(0)
    jitter = F.conv(F.substring(seeded_order(F.col("id"), seed), 1, 4), 16, 10).cast("int") % 41
    return df.withColumn("priority", base + chosen + jitter).withColumn("order", seeded_order(F.col("id"), seed))


def remaining(pool: DataFrame, cart: DataFrame) -> DataFrame:
    """The pool without what a cart (request, id, marks) holds, and targets less its marks: what is left to fill."""
    held = cart.groupBy("request").agg(F.sum("marks").cast("int").alias("__held"))
    rest = pool.join(cart.select("request", "id"), ["request", "id"], "left_anti").join(held, "request", "left")
    return rest.withColumn("target", F.greatest(F.lit(0), F.col("target") - F.coalesce("__held", F.lit(0)))).drop("__held").where("target > 0")


def preset_requests(questions: DataFrame, presets: DataFrame, families: list[str]) -> DataFrame:
    """Pools of presets (preset, unit_code, target, kind): the questions of its unit, or all for a preset of ``all`` units and one
    whose unit has none; of these the kind that it asks for, where the pool has any. Questions have (unit, unit_code, kind); rows get
    (request, target). Presets are a short list and are broadcast: a few names would bring all questions to a few tasks."""
    held = presets.limit(MOST_PRESETS + 1).collect()
    if len(held) > MOST_PRESETS:
        raise ValueError(f"more than {MOST_PRESETS} presets")
    presets = F.broadcast(presets.sparkSession.createDataFrame(held, presets.schema))
    named = preset_pool(questions, presets.where("lower(unit_code) <> 'all'"), families)
    wanted = presets.select("preset", "target", F.col("kind").alias("__kind"))
    fits = F.coalesce(F.col("kind") == F.col("__kind"), F.lit(False))
    asked = {r["preset"]: r["some"] for r in named.join(wanted, "preset").groupBy("preset").agg(F.max(fits).alias("some")).collect()}
    names = sorted({r["preset"] for r in held} - set(asked) - {None})
    kinds = {r["kind"] for r in questions.where(F.col("kind").isin(sorted({r["kind"] for r in held} - {None}))).select("kind").distinct().collect()}
    some = {name for name, found in asked.items() if found} | {r["preset"] for r in held if r["preset"] in names and r["kind"] in kinds}
    every = questions.withColumn("preset", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    pool = named.unionByName(every).join(wanted, "preset").withColumnRenamed("preset", "request")
    return pool.where(~F.col("request").isin(sorted(some)) | fits).drop("__kind")


class BuildExam:
    """One selection for each request of a table argument with the columns request, target, id, marks, order, read in Arrow batches:

        SELECT * FROM build_exam(TABLE(pool) PARTITION BY request ORDER BY (`order`, id))

    Many small requests cost less together, as parts of a hash, in order of their request:

        SELECT * FROM build_exam(TABLE(pool) PARTITION BY pmod(hash(request), 4096) ORDER BY (request, `order`, id))

    Rows above what a request can use are not kept: of equal marks ``(target + 12) / marks + 1``, so a partition needs little memory.
    """

    def __init__(self):
        self.rows: list[pa.RecordBatch] = []
        self.held: Counter = Counter()

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        columns = [batch.column("request").cast(pa.string()), batch.column("target").cast(pa.int32()), batch.column("id").cast(pa.string()), batch.column("marks").cast(pa.int32()), batch.column("order")]
        batch = pa.RecordBatch.from_arrays(columns, ["request", "target", "id", "marks", "order"])
        batch = batch.filter(pc.greater(batch.column("marks"), 0))
        if not batch.num_rows:
            return
        ends = pc.run_end_encode(batch.column("request")).run_ends.to_pylist()
        last = ends[-2] if len(ends) > 1 else 0
        if last or self.rows and self.rows[-1].column("request")[-1].as_py() != batch.column("request")[0].as_py():
            yield self._solved(batch.slice(0, last))
        open_, used = batch.slice(last), []
        for target, marks in zip(*(open_.column(c).to_numpy().tolist() for c in ("target", "marks")), strict=True):
            used.append(self.held[marks] <= (target + 12) // marks)
            self.held[marks] += used[-1]
        if any(used):
            self.rows.append(open_.filter(pa.array(used)))

    def terminate(self) -> Iterator[pa.Table]:
        if self.rows:
            yield self._solved(self.rows[0].slice(0, 0))

    def _solved(self, more: pa.RecordBatch) -> pa.Table:
        """The selections of the rows that are held, and of ``more``; nothing is held then."""
        rows = pa.concat_batches([*self.rows, more])
        self.rows, self.held = [], Counter()
        rows = rows.sort_by([(c, "ascending") for c in ("request", "order", "id", "marks")])
        return pa.Table.from_batches([_selections(rows).select(["request", "id", "marks", "total", "target"])])


def register_build_exam(spark) -> None:
    """``build_exam`` for SQL."""
    from pyspark.sql.functions import arrow_udtf

    spark.udtf.register("build_exam", arrow_udtf(BuildExam, returnType="request string, id string, marks int, total int, target int"))
