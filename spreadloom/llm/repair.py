"""Repair of conversations by the cheapest edits, found by iterative-deepening A*.

Rows of a conversation are kept, given another role, deleted or inserted until their roles read (s?(ua)+)?. A depth-first
search tries edits in the order of their letters (D, I, K, R) under a cost bound, which rises to the least cost that
exceeded it until a path is accepted; the first one found is the least by letters among the cheapest. What a row costs
in any case is the lower bound of what is to come, and states that failed are remembered with the budget they failed with.

Conversations of bounded size are searched where their rows meet. Longer ones are sorted in ranges over all tasks, equal
rows as one; a range is a segment, and costs between the states at its ends are products of the costs of its rows, least
for sum and sum for product. A few numbers per segment give the cost still to come at every end; each segment is then
searched, in blocks, from each state it may begin in, and what begins where is read off in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spreadloom.llm.common import drop, is_empty, prepare, save

#: Rows and bytes up to which a conversation is searched as a whole, and rows of a block of a longer one.
WHOLE_ROWS, WHOLE_BYTES, BLOCK = 256, 4 << 20, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a; the last letter of the roles so far.
START, ACCEPTING = "-", ("-", "a")
STATES = "-sua"
#: Where a role leads from a state, and the role that a row which gets a new one, or is new, must have there.
NEXT = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FREE = {"-": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 40

#: A row as the search sees it: "D" must go; else the initial of its role, in upper case if its text is truncated.
Row = str


def moves(row: Row | None, state: str) -> list[tuple[str, str, int]]:
    """(letter, state, cost) of the edits from `state`, in the order of their letters; no row at the end."""
    out = [("D", state, DELETE)] if row is not None else []
    out.append(("I", FREE[state], INSERT))
    if row is not None and row != "D":
        cut = TRUNCATED if row.isupper() else 0
        kept = NEXT.get((state, row.lower()))
        out += [("K", kept, KEEP + cut)] if kept else []
        out.append(("R", FREE[state], REROLE + cut))
    return out


def least_costs(rows: list[Row]) -> list[int]:
    """What rows from each place on cost whatever is done."""
    out = [0]
    for r in reversed(rows):
        out.append(out[-1] + (DELETE if r == "D" else TRUNCATED if r.isupper() else 0))
    return out[::-1]


def search(rows: list[Row], state: str = START, to_come: dict[str, int] | None = None) -> tuple[int, str, str]:
    """(cost, letters, last state) of the cheapest edits, least by letters. `to_come` has the states in which rows may
    end and what each costs after them; the cost holds it."""
    ends = to_come or dict.fromkeys(ACCEPTING, 0)
    n, least, last = len(rows), least_costs(rows), min(ends.values())
    failed: dict[tuple[int, str], int] = {}
    bound = least[0] + last
    while True:
        over, path = ends.get(state, FAR) if not n else FAR, []
        # a frame: place, state, cost so far, edits yet to be tried
        stack = [(0, state, 0, iter(moves(rows[0] if n else None, state)))]
        if not n and ends.get(state, FAR) <= bound:
            return ends[state], "", state
        while stack:
            at, here, spent, todo = stack[-1]
            step = next(todo, None)
            if step is None:
                stack.pop()
                if path:
                    path.pop()
                failed[at, here] = max(failed.get((at, here), -1), bound - spent)
                continue
            letter, then, cost = step
            place, total = at + (letter != "I"), spent + cost
            # a state that failed with a budget needs more than that
            need = max(least[place] + last, failed.get((place, then), -1) + 1)
            if total + need > bound:
                over = min(over, total + need)
                continue
            if place == n and then in ends:
                if ends[then] + total <= bound:
                    return ends[then] + total, "".join(path) + letter, then
                over = min(over, ends[then] + total)
            path.append(letter)
            stack.append((place, then, total, iter(moves(rows[place] if place < n else None, then))))
        bound = over


# rows are read from a stream of (conv_id, turn, role, text, ...) in order


def seen_as(role: str, text: str, again: bool) -> tuple[str | None, Row]:
    """(first fault, the row as the search sees it)."""
    own = text.rstrip(SPACE)
    if not own:
        return "blank", "D"
    if again:
        return "duplicate", "D"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return ("truncated", initial.upper()) if own[-1] not in ".!?" else (None, initial)


EDITS = "step long, edit string, turn long, was string, role string, text string, fault string"
EDIT_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())


def applied(audit: str, rows: Iterator[tuple], state: str) -> Iterator[tuple]:
    """(edit, turn, was, role, text, fault) of every edit; `rows` has (turn, role, text, fault) of what is edited."""
    rows = iter(rows)
    for letter in audit:
        free = FREE[state]
        if letter == "I":
            state = free
            yield letter, None, None, ROLES[free], "", None
            continue
        turn, role, text, fault = next(rows)
        if letter == "D":
            yield letter, turn, role, None, text, fault
        elif letter == "R":
            state = free
            yield letter, turn, role, ROLES[free], text, fault
        else:
            state = NEXT[state, role[:1]]
            yield letter, turn, role, role, text, fault


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def grouped_lazily(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    return groupby(rows, key=itemgetter(0))


def grouped(rows: Iterator[tuple]) -> Iterator[tuple[object, list[tuple]]]:
    return ((k, list(of)) for k, of in grouped_lazily(rows))


def out_batches(rows: Iterator[tuple], types: tuple, schema: str, most: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of rows (conv_id and what `schema` names)."""
    names = ["conv_id", *(c.split(" ")[0] for c in schema.split(", "))]
    rows = iter(rows)
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def kinds(df: DataFrame) -> tuple[str, pa.DataType]:
    """The type of conv_id in Spark and in Arrow."""
    return dict(df.dtypes)["conv_id"], to_arrow_type(df.schema["conv_id"].dataType)


def cleaned(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


ORDER = ("turn", "role", "text")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that are searched as a whole, and those of longer ones, if there are any."""
    prepare(rows.sparkSession)
    own = cleaned(rows)
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = save(sizes.where((F.col("n") > WHOLE_ROWS) | (F.col("bytes") > WHOLE_BYTES)).select("conv_id"), "long")
    if is_empty(long):
        drop(long)
        return own, None
    match = own.conv_id.eqNullSafe(long.conv_id)
    return own.join(long, match, "left_anti"), own.join(long, match, "left_semi")


def repair(rows: DataFrame) -> DataFrame:
    """One row per edit of every conversation: conv_id, step (from 0), edit (D, I, K or R), turn and was (role before) of
    the row edited, role (after; null where deleted), text, fault (the first of blank, duplicate, truncated).

    `rows` has conv_id, turn, role, text. Rows stand by turn, nulls first; rows of one turn by the bytes of role and text.
    A null role or text is one space, a null conv_id a conversation of its own. Blank rows and those whose role and text
    stood before must go; keeping is free, another role costs 2, deleting 3, inserting an empty row 2, and a truncated row
    that stays 1. Conversations and texts may be of any length. Other columns are not looked at; no rows give no rows.
    """
    whole, long = split(rows)
    out = repaired_whole(whole)
    return out if long is None else out.union(repaired_long(long))


def repaired_whole(own: DataFrame) -> DataFrame:
    """`repair` of conversations of bounded size; the edits of one come in order, within one partition."""
    kind, arrow = kinds(own)

    def edits(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, of in grouped(rows):
            before: set[tuple[str, str]] = set()
            kept, told = [], []
            for _, turn, role, text in of:
                fault, row = seen_as(role, text, (role, text) in before)
                before.add((role, text))
                kept.append(row)
                told.append((turn, role, text, fault))
            for k, e in enumerate(applied(search(kept)[1], told, START)):
                yield conv, k, *e

    met = own.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return met.mapInArrow(lambda b: out_batches(edits(streamed(b)), (arrow, *EDIT_TYPES), EDITS), f"conv_id {kind}, {EDITS}")


# long conversations


def products(rows: list[Row]) -> list[np.ndarray]:
    """Costs between the states at the ends of each block of `rows`, and of all of them, last."""
    between = {}
    for row in set(rows):
        m = np.full((4, 4), FAR)
        for a in STATES:
            # at most two inserts before a row: more only go round in a circle
            for before, cost in ((a, 0), (FREE[a], INSERT), (FREE[FREE[a]], 2 * INSERT)):
                for letter, then, more in moves(row, before):
                    if letter != "I":
                        i, j = STATES.index(a), STATES.index(then)
                        m[i, j] = min(m[i, j], cost + more)
        between[row] = m
    times = lambda a, b: np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)
    out, whole = [], None
    for k in range(0, len(rows), BLOCK):
        block = None
        for row in rows[k : k + BLOCK]:
            block = between[row] if block is None else times(block, between[row])
        out.append(block)
        whole = block if whole is None else times(whole, block)
    return [*out, whole]


def closing() -> dict[str, int]:
    """Costs of the states after the last row: inserts that lead to an accepted one."""
    return {a: min(INSERT * k for k, s in enumerate((a, FREE[a], FREE[FREE[a]])) if s in ACCEPTING) for a in STATES}


def last_letters(state: str) -> str:
    return "I" * (closing()[state] // INSERT)


def before_segment(whole: np.ndarray, after: dict[str, int]) -> dict[str, int]:
    return {a: int(min(whole[i, j] + after[b] for j, b in enumerate(STATES))) for i, a in enumerate(STATES)}


def segment_paths(rows: list[Row], after: dict[str, int]) -> dict[str, tuple[str, str]]:
    """From each state that a segment may begin in: its letters and its last state."""
    blocks = products(rows)[:-1]
    ends = [after]
    for m in reversed(blocks):
        ends.append(before_segment(m, ends[-1]))
    ends = ends[::-1]
    out = {a: ("", a) for a in STATES}
    for k in range(len(blocks)):
        part = rows[k * BLOCK : (k + 1) * BLOCK]
        ways = {s: search(part, s, ends[k + 1])[1:] for s in {s for _, s in out.values()}}
        out = {a: (done + ways[s][0], ways[s][1]) for a, (done, s) in out.items()}
    return out


def repaired_long(own: DataFrame) -> DataFrame:
    """`repair` of conversations of any size."""
    kind, arrow = kinds(own)
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    # equal rows stand together and all but the first are duplicates: they travel as one
    once = own.groupBy("conv_id", *ORDER).agg(F.count("*").alias("times")).withColumn("key", key)
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = once.groupBy("conv_id", "key").agg(F.min(when).alias("first")).withColumnsRenamed({"conv_id": "c", "key": "k"})
    once = once.join(first, once.conv_id.eqNullSafe(F.col("c")) & (once.key == F.col("k"))).withColumn("again", when != F.col("first"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *ORDER)]
    dealt = once.select("conv_id", *ORDER, "times", "again").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = save(dealt.withColumn("part", F.spark_partition_id()), "ordered")

    def seen(rows: Iterator[tuple]) -> Iterator[tuple]:
        """(part, conv_id), (turn, role, text, fault) and what the search sees of every row, repeats too."""
        for conv, turn, role, text, times, again, part in rows:
            fault, row = seen_as(role, text, again)
            yield (part, conv), (turn, role, text, fault), row
            for _ in range(times - 1):
                yield (part, conv), (turn, role, text, "blank" if fault == "blank" else "duplicate"), "D"

    def flags(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (part, conv), of in grouped((k, row) for k, _, row in seen(rows)):
            row = [r for _, r in of]
            yield conv, part, "".join(row), products(row)[-1].ravel().tolist()

    def backwards(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, of in grouped(rows):
            after = closing()
            for k, (_, part, costs) in enumerate(of):
                yield conv, part, k == 0, [after[s] for s in STATES]
                after = before_segment(np.array(costs).reshape(4, 4), after)

    def paths(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, row, last, after in rows:
            ways = segment_paths(list(row), dict(zip(STATES, after, strict=True)))
            yield conv, part, [ways[s][0] + (last_letters(ways[s][1]) if last else "") for s in STATES], [ways[s][1] for s in STATES]

    def forwards(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, of in grouped(rows):
            state, step = START, 0
            for _, part, ends, sizes in of:
                way = STATES.index(state)
                yield conv, part, way, step
                state, step = ends[way], step + sizes[way]

    def edits(rows: Iterator[tuple]) -> Iterator[tuple]:
        # the letters of a segment come before its rows
        for (_, conv), of in grouped_lazily(((r[0], r[1]), *r[2:]) for r in rows):
            _, *_, audit, way, step = next(of)
            told = (t for _, t, _ in seen((conv, *r[1:6], None) for r in of))
            for k, e in enumerate(applied(audit, told, STATES[way])):
                yield conv, step + k, *e

    def through(df: DataFrame, of, types: tuple, schema: str, most: int = 500) -> DataFrame:  # noqa: ANN001
        return df.mapInArrow(lambda b: out_batches(of(streamed(b)), (arrow, *types), schema, most), f"conv_id {kind}, {schema}")

    def with_segment(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"conv_id": "c", "part": "p"})
        return left.join(right, left.conv_id.eqNullSafe(F.col("c")) & (left.part == F.col("p"))).drop("c", "p")

    number, numbers, letters = pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())
    sorted_ = dealt.repartition("part").sortWithinPartitions("part", *order)
    segments = save(through(sorted_, flags, (number, pa.string(), numbers), "part int, rows string, costs array<long>", 1), "segments")
    # a row per segment of a conversation: at most as many as there are partitions
    ends = segments.select("conv_id", "part", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"))
    ends = through(ends, backwards, (number, pa.bool_(), numbers), "part int, last boolean, after array<long>")
    both = with_segment(segments, ends).select("conv_id", "part", "rows", "last", "after")
    found = save(through(both, paths, (number, letters, letters), "part int, audits array<string>, ends array<string>", 1), "paths")
    ways = found.select("conv_id", "part", "ends", F.transform("audits", F.length).alias("sizes")).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    ways = through(ways, forwards, (number, number, pa.int64()), "part int, way int, step long")
    audits = with_segment(found, ways).select("conv_id", "part", F.element_at("audits", F.col("way") + 1).alias("audit"), "way", "step")
    none = lambda **cols: [F.lit(None).cast(t).alias(c) for c, t in cols.items()]
    told = audits.select("part", "conv_id", *none(turn="long", role="string", text="string", times="long", again="boolean"), "audit", "way", "step")
    rows = dealt.select("part", "conv_id", *ORDER, "times", "again", *none(audit="string", way="int", step="long"))
    met = told.union(rows).repartition("part").sortWithinPartitions("part", order[0], F.col("audit").isNull(), *order[1:])
    return through(met, edits, EDIT_TYPES, EDITS)


class Tally:
    """What a conversation's edits come to, as they pass by in order."""

    def __init__(self):
        self.low, self.high, self.turns, self.before, self.illegal, self.cost = None, None, 0, None, 0, 0
        self.faults, self.letters, self.sha, self.begun = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], hashlib.sha256(), False

    def add(self, edit: str, turn: int | None, was: str | None, role: str | None, text: str, fault: str | None) -> None:
        self.letters.append(edit)
        self.cost += COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + was[:1] not in LEGAL
            self.before = was[:1]
            if turn is not None:
                self.turns += turn != self.high
                self.low, self.high = (turn if self.low is None else self.low), turn
        if edit != "D":
            self.sha.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest()


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


LEGAL = ("su", "ua", "au")


def summary(edits: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of `edits`,
    whose rows come in order within one partition. A task keeps the letters and a running digest of one at a time."""
    kind, arrow = kinds(edits)

    def folded(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, of in grouped_lazily(rows):
            tally = Tally()
            for r in of:
                tally.add(*r[2:])
            yield conv, *tally.row()

    types = (arrow, *[pa.int64()] * 6, pa.string(), pa.string())
    return edits.mapInArrow(lambda b: out_batches(folded(streamed(b)), types, SUMMARY), f"conv_id {kind}, {SUMMARY}")


def summarise(rows: DataFrame) -> DataFrame:
    """`summary` of the repair of `rows`."""
    whole, long = split(rows)
    out = summary(repaired_whole(whole))
    if long is None:
        return out
    return out.union(summary(repaired_long(long).repartition("conv_id").sortWithinPartitions("conv_id", "step")))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a checksum of conv_id and turn chooses: a row is dropped, emptied,
    loses its stops, stands twice, or becomes the user's. Nulls count as one space."""
    own = cleaned(rows)
    said: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    own = own.withColumn("fate", fate).where("fate <> 0")
    own = own.withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    own = own.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return own.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("copy", "fate")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = summarise(damaged(rows)).withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.lit(hashlib.sha256().hexdigest())
    return every.join(found, every.conv_id.eqNullSafe(found.c), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
