"""Repair of the structure of conversations by square-root checkpointed dynamic programming.

The rows of a conversation, in order, are edited so that the initials of their
roles spell (s?(ua)+)?: nothing, or an optional system row and then pairs of user
and assistant. Edits of a row are Keep (cost 0), Rerole to user or assistant (2)
and Delete (3); Insert (2) puts in a user or assistant row without text. Blank rows
and duplicates must be deleted; a truncated row that stays adds 1. Of the cheapest
edits those whose initials are ASCII-least are made.

    blank      no character other than blanks and 0x09-0x0D
    duplicate  role and text were seen earlier in the conversation
    truncated  the last such character is none of . ! ?

The first fault that a row has counts.

The automaton of the pattern has four states, so a row is a table of costs from
state to state. Backward costs of a state are what the rest of the rows costs at
least. They are computed from the end, and kept only at checkpoints, every
sqrt(n) rows of a stretch; the walk forward makes those of one block again from the
checkpoint behind it, and takes at each step the least letter among the tight
edits, those that lose no cost. So n rows take sqrt(n) memory beyond one byte for
each row, and time n.

Stretches. Faults need no text once its digest is known, so texts stay where they
are: rows become (conversation, turn, role, digest, code), equal rows one with a
count, sorted over all tasks by the first four; a conversation of any size is thus
cut into stretches, one in each task. Only the first and the last stretch of a task
can be part of a longer conversation. Each of these gives the least costs from
state to state across it. From these (at most two rows for each task) the driver
tells each stretch the costs behind it; the stretch is walked from each state, and
which of the walks counts follows from the stretches before it. Conversations in
one task, nearly all, are walked once. Only the digest of a repaired conversation
reads its texts in order, streamed through one task, as a digest must.

Order: by turn (null first), then role and digest of role and text, so equal rows
are neighbours. Only the first letter of a role counts in the pattern; an empty role
has none and can't be kept. Defined cases: null turns sort first and count for no
gap; a null id is a conversation of its own; null roles and texts are one blank;
empty and very long texts are texts like any other; repeated rows are duplicates;
conversations without rows have no edits; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, durable, table

INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
#: States of the pattern: nothing yet, after system, after user, after assistant; it may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: Where user or assistant leads; where a kept initial leads, by code.
_TURN = (USER, USER, ASSISTANT, USER)
_KEEP = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
#: Codes of rows: 3 * initial (s, u, a, other) + 0 as it is, 1 truncated, 2 to be deleted.
INITIALS = ("s", "u", "a")
NAMES = {USER: "user", ASSISTANT: "assistant"}


def _steps(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row of this code: (letter, cost, next state), letters ascending."""
    initial, fault = divmod(code, 3)
    out = []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if fault != 2:
            cut = CUT if fault == 1 else 0
            if initial < 3 and (to := _KEEP[INITIALS[initial]][state]) >= 0:
                edits.append(("K", cut, to))
            edits.append(("R", REROLE + cut, _TURN[state]))
        out.append(edits)
    return out


STEPS = [_steps(code) for code in range(12)]


def _settled(costs: list[int]) -> list[int]:
    """Costs of the states before a row when rows may be inserted there; costs are those with the next row taken first."""
    out = list(costs)
    for _ in range(3):  # an insertion leads on, so three more settle all
        for state in range(4):
            out[state] = min(out[state], INSERT + out[_TURN[state]])
    return out


def before(code: int, after: list[int], times: int = 1) -> list[int]:
    """Backward costs before a row (or a run of equal rows that are all deleted)."""
    if times > 1:  # deletions leave the state: rows to insert may as well come behind them
        return [min(c + DELETE * times, FAR) for c in after]
    return _settled([min(min(cost + after[to], FAR) for _, cost, to in edits) for edits in STEPS[code]])


def ending() -> list[int]:
    """Backward costs behind the last row."""
    return _settled([0, FAR, FAR, 0])


class Stretch:
    """The rows of a conversation that stand in one task: codes and, for the first of each run of equal rows, how often it is there."""

    def __init__(self, codes: bytes, times: list[int]):
        self.codes, self.times = codes, times

    def runs(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(row, code, times) from row a to b: a run is its first row and then the rest, which are deleted."""
        for k in range(a, b):
            yield k, self.codes[k], 1
            if self.times[k] > 1:
                yield k, self.codes[k] // 3 * 3 + 2, self.times[k] - 1

    def costs(self, after: list[int], a: int, b: int) -> list[int]:
        """Backward costs before row a from those behind row b - 1."""
        for _, code, times in reversed(list(self.runs(a, b))):
            after = before(code, after, times)
        return after

    def across(self) -> list[list[int]]:
        """Least costs from each state before the stretch to each behind it."""
        to = [self.costs([0 if s == t else FAR for s in range(4)], 0, len(self.codes)) for t in range(4)]
        return [[to[t][s] for t in range(4)] for s in range(4)]

    def checkpoints(self, after: list[int]) -> tuple[list[int], list[list[int]]]:
        """Rows where blocks of about sqrt(n) rows begin, and the costs behind each block."""
        n = len(self.codes)
        size = max(1, math.isqrt(n))
        places = [*range(0, n, size), n]
        kept = []
        for a, b in reversed(list(pairwise(places))):
            kept.append(after)
            after = self.costs(after, a, b)
        kept.reverse()
        return places, kept

    def walk(self, state: int, after: list[int], last: bool) -> tuple[str, int, list[tuple[str, str]]]:
        """Letters of the edits, the state behind them, and for each row (roles inserted before it, its edit); if last, rows inserted at the end follow as a row of their own."""
        places, kept = self.checkpoints(after)
        letters: list[str] = []
        edits: list[tuple[str, str]] = []
        for (a, b), behind in zip(pairwise(places), kept, strict=True):
            todo = list(self.runs(a, b))
            costs = [behind]
            for _, code, times in reversed(todo):
                costs.append(before(code, costs[-1], times))
            costs.reverse()
            for at, (row, code, times) in enumerate(todo):
                inserted = ""
                if times > 1 or (at and todo[at - 1][0] == row):
                    letters.append("D" * times)
                    continue
                while True:
                    least = costs[at][state]
                    tight = [e for e in STEPS[code][state] if e[1] + costs[at + 1][e[2]] == least]
                    if tight and tight[0][0] == "D":
                        edit = tight[0]
                        break
                    if INSERT + costs[at][_TURN[state]] == least:
                        state = _TURN[state]
                        letters.append("I")
                        inserted += "u" if state == USER else "a"
                        continue
                    edit = tight[0]
                    break
                letters.append(edit[0])
                state = edit[2]
                edits.append((inserted, edit[0] if edit[0] != "R" else "u" if state == USER else "a"))
        inserted = ""
        while last and state not in (START, ASSISTANT):
            state = _TURN[state]
            letters.append("I")
            inserted += "u" if state == USER else "a"
        if last:
            edits.append((inserted, "D"))
        return "".join(letters), state, edits


# --------------------------------------------------------------------- rows without texts

KEY = ["turn", "role", "digest"]


def codes_of(role: Column, text: Column) -> dict[str, Column]:
    """Whether a text is blank and whether it is cut, and the place of the role's initial."""
    final = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    place = F.lit(len(INITIALS))
    for k, letter in enumerate(INITIALS):
        place = F.when(F.substring(role, 1, 1) == letter, k).otherwise(place)
    return {"blank": final == "", "cut": ~final.isin(".", "!", "?"), "initial": place}


def digest_of() -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", "role", "text"), 256))


def in_order(rows: DataFrame) -> DataFrame:
    """Distinct (conv, turn, role, digest) sorted over all partitions, with code, faults and number; kept, so that partitions stay as they are."""
    coded = rows.withColumns(codes_of(F.col("role"), F.col("text"))).withColumn("digest", digest_of())
    light = durable(coded.groupBy("conv", *KEY, "blank", "cut", "initial").agg(F.sum("copies").cast("long").alias("copies")))
    # the first of each role and text: one row for each, so the join has unique keys however often a text is there
    first = light.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("t"))
    first = first.select("c", "r", "d", F.col("t.turn").alias("t"), F.lit(True).alias("new"))
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    judged = light.join(first, same, "left").withColumn("new", F.coalesce("new", F.lit(False)))
    fault = F.when(F.col("blank") | ~F.col("new"), 2).when(F.col("cut"), 1).otherwise(0)
    dealt = judged.select("conv", *KEY, (3 * F.col("initial") + fault).cast("int").alias("code"), "blank", "new", "copies")
    return durable(dealt.repartitionByRange("conv", *KEY).sortWithinPartitions("conv", *KEY))


class Seen:
    """The rows of a stretch and what is counted along them."""

    def __init__(self):
        self.codes, self.times, self.keys = bytearray(), [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = -1

    def add(self, turn, role, digest, code, blank, new, copies) -> None:
        self.codes.append(code)
        self.times.append(copies)
        self.keys.append((turn, role, digest))
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - new
            self.truncated += code % 3 == 1
        initial = code // 3
        if self.last_initial >= 0:
            self.illegal += not legal(self.last_initial, initial)
        else:
            self.first_initial = initial
        self.illegal += copies - 1  # no initial may follow itself
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def join(self, other: Seen) -> None:
        """Counts the rows of the next stretch of the conversation too."""
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.illegal += not legal(self.last_initial, other.first_initial)
        self.last_initial = other.last_initial
        if other.turns:
            self.turns += other.turns - (other.first_turn == self.last_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn

    def counts(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal)

    ENDS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial")

    def ends(self) -> tuple:
        return tuple(getattr(self, name) for name in self.ENDS)

    @classmethod
    def of(cls, row) -> Seen:
        out = cls()
        for name in cls.ENDS:
            setattr(out, name, row[name])
        return out


def legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def by_stretch(ordered: DataFrame, ddl: str, work: Callable, ends_only: bool = False) -> DataFrame:
    """conv, part and the columns of ddl: what work(conv, part, Seen) yields for each stretch, or for the first and last of each task only."""
    kind = T.StructType([ordered.schema["conv"], T.StructField("part", T.IntegerType()), *T.StructType.fromDDL(ddl)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        part, types = TaskContext.get().partitionId(), [to_arrow_type(f.dataType) for f in kind]

        def found() -> Iterator[tuple]:
            seen, now, n = None, None, 0
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE_ROWS):
                    for conv, *row in zip(*[c.to_pylist() for c in whole.slice(at, SLICE_ROWS).columns], strict=True):
                        if seen is None or conv != now:
                            if seen is not None and not (ends_only and n > 1):
                                yield from work(now, part, seen)
                            seen, now, n = Seen(), conv, n + 1
                        seen.add(*row)
            if seen is not None:
                yield from work(now, part, seen)

        out: list[tuple] = []
        for k, row in enumerate(found(), 1):
            out.append((row[0], part, *row[1:]))
            if k % SLICE_ROWS == 0:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], kind.names)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], kind.names)

    return ordered.mapInArrow(run, kind)


def behind(tables: list[list[list[int]]]) -> list[list[int]]:
    """For stretches with these costs across, in order, the backward costs behind each; and those before the first as one more."""
    after, out = ending(), []
    for across in reversed(tables):
        out.append(after)
        after = [min(min(across[s][t] + after[t], FAR) for t in range(4)) for s in range(4)]
    return [*reversed(out), after]


WALK = "state int, to int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, ord long, turn long, role string, digest binary, before string, edit string"


def edited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations (conv, gaps, blank, duplicate, truncated, illegal, cost, audit) and of edits (conv, part, ord, turn, role, digest, before, edit).

    rows: conv, turn (long), role, text (not null), copies. Edits are rows that stay
    (edit K, u or a: kept, or rerole) and rows with insertions before them (before:
    a letter for each); what is inserted at the end has no role and digest. They
    stand in the order of part and ord.
    """
    spark = rows.sparkSession
    ordered = in_order(rows)

    def across(conv, part, seen):
        yield (conv, *seen.ends(), [c for line in Stretch(bytes(seen.codes), seen.times).across() for c in line])

    ends: dict = {}  # at most two rows for each task
    for r in by_stretch(ordered, ", ".join(f"{name} long" for name in Seen.ENDS) + ", across array<long>", across, ends_only=True).toLocalIterator():
        ends.setdefault(r.conv, []).append(r)
    cut = {c: sorted(of, key=lambda r: r.part) for c, of in ends.items() if len(of) > 1}
    ahead, totals = {}, {}
    for conv, of in cut.items():
        costs = behind([[r.across[4 * s : 4 * s + 4] for s in range(4)] for r in of])
        total = Seen.of(of[0])
        for r in of[1:]:
            total.join(Seen.of(r))
        totals[conv] = (*total.counts(), costs[-1][START])
        for k, r in enumerate(of):
            ahead[conv, r.part] = (costs[k], k == len(of) - 1)
    sent = spark.sparkContext.broadcast(ahead)

    def walk(conv, part, seen):
        stretch, some = Stretch(bytes(seen.codes), seen.times), sent.value.get((conv, part))
        after, last = some or (ending(), True)
        costs = stretch.costs(after, 0, len(seen.codes))
        for state in range(4) if some else (START,):
            if costs[state] >= FAR:
                continue
            audit, to, edits = stretch.walk(state, after, last)
            yield (conv, state, to, *seen.counts(), costs[state], audit, -1, None, None, None, None, None)
            for at, ((turn, role, digest), (inserted, edit)) in enumerate(zip([*seen.keys, (None, None, None)], edits, strict=False)):
                if inserted or edit != "D":
                    yield (conv, state, to, *[None] * 7, at, turn, role, digest, inserted, edit)

    walks = durable(by_stretch(ordered, WALK, walk))
    kept = ["conv", "part", "ord", *KEY, "before", "edit"]
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    if not cut:
        return walks.where("ord < 0").select("conv", *counts, "audit"), walks.where("ord >= 0").select(*kept)
    # which walk of each stretch of a cut conversation counts: again a row for each stretch and state
    stretches = spark.createDataFrame([(c, r.part) for c, of in cut.items() for r in of], T.StructType([T.StructField("c", ordered.schema["conv"].dataType), T.StructField("p", T.IntegerType())]))
    this = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    leads = {(r.conv, r.part, r.state): r.to for r in walks.where("ord < 0").join(F.broadcast(stretches), this, "left_semi").select("conv", "part", "state", "to").toLocalIterator()}
    chosen = []
    for conv, of in cut.items():
        state = START
        for r in of:
            chosen.append((conv, r.part, state))
            state = leads[conv, r.part, state]
    schema = T.StructType([*stretches.schema, T.StructField("s", T.IntegerType())])
    used = walks.join(F.broadcast(spark.createDataFrame(chosen, schema)), this, "left").where("p is null or s = state")
    alone = used.where("ord < 0 and p is null").select("conv", *counts, "audit")
    parts = used.where("ord < 0 and p is not null").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "audit"))).alias("a"))  # a row for each stretch
    whole = spark.createDataFrame([(c, *t) for c, t in totals.items()], T.StructType([ordered.schema["conv"], *T.StructType.fromDDL(", ".join(f"{c} long" for c in counts))]))
    whole = whole.withColumnRenamed("conv", "c").join(parts, F.col("c").eqNullSafe(F.col("conv"))).select("conv", *counts, F.array_join("a.audit", "").alias("audit"))
    return alone.unionByName(whole), used.where("ord >= 0").select(*kept)


# --------------------------------------------------------------------- repaired texts


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, part, ord, sub, role, text, edit): the rows of the repaired conversations, in the order of part, ord and sub; edit is K, R or I."""
    texts = rows.withColumn("digest", digest_of()).select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"), "text").dropDuplicates(["c", "t", "r", "d"])
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    names = F.create_map(F.lit("u"), F.lit(NAMES[USER]), F.lit("a"), F.lit(NAMES[ASSISTANT]))
    inserted = F.transform(F.split("before", ""), lambda x: F.struct(names[x].alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    inserted = F.when(F.col("before") == "", F.array().cast(inserted_type())).otherwise(inserted)
    own = F.struct(F.when(F.col("edit") == "K", F.col("role")).otherwise(names[F.col("edit")]).alias("role"), F.col("text"), F.when(F.col("edit") == "K", "K").otherwise("R").alias("edit"))
    own = F.when(F.col("edit") == "D", F.array().cast(inserted_type())).otherwise(F.array(own))
    joined = edits.join(texts, same, "left")
    return joined.select("conv", "part", "ord", F.posexplode(F.concat(inserted, own)).alias("sub", "x")).select("conv", "part", "ord", "sub", "x.role", "x.text", "x.edit")


def inserted_type() -> str:
    return "array<struct<role:string,text:string,edit:string>>"


def text_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the repaired `role:text`, joined by newlines, for every conversation in rows.

    Edits and texts of a conversation are streamed in order through one task; an
    edit stands before the texts of its row. Memory does not grow with them.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    told = edits.select("conv", F.col("digest").isNull().alias("tail"), *KEY, F.lit(0).alias("kind"), "before", "edit", none("string", "text"))
    read = rows.withColumn("digest", digest_of()).select("conv", F.lit(False).alias("tail"), *KEY, F.lit(1).alias("kind"), none("string", "before"), none("string", "edit"), "text")
    order = ["conv", "tail", *KEY, "kind"]
    dealt = told.unionByName(read).repartition("conv").sortWithinPartitions(*order).drop("tail", "kind")
    kind = T.StructType([dealt.schema["conv"], T.StructField("repaired_sha256", T.StringType())])
    names = {"u": NAMES[USER], "a": NAMES[ASSISTANT]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            sha = now = wanted = None
            empty = True

            def feed(role: str, text: str) -> None:
                nonlocal empty
                sha.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False

            for whole in batches:
                for at in range(0, whole.num_rows, SLICE_ROWS):
                    for conv, turn, role, digest, inserted, edit, text in zip(*[c.to_pylist() for c in whole.slice(at, SLICE_ROWS).columns], strict=True):
                        if sha is None or conv != now:
                            if sha is not None:
                                yield now, sha.hexdigest()
                            sha, now, wanted, empty = hashlib.sha256(), conv, None, True
                        if edit is None:  # a text; of equal ones the first
                            if wanted is not None and wanted[0] == (turn, role, digest):
                                feed(wanted[1], text)
                                wanted = None
                            continue
                        for letter in inserted:
                            feed(names[letter], "")
                        wanted = None if edit == "D" else ((turn, role, digest), names.get(edit, role))
            if sha is not None:
                yield now, sha.hexdigest()

        ids, shas = [], []
        from pyspark.sql.pandas.types import to_arrow_type

        id_type = to_arrow_type(kind["conv"].dataType)
        for conv, sha in found():
            ids.append(conv)
            shas.append(sha)
            if len(ids) == SLICE_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(shas)], kind.names)
                ids, shas = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(shas)], kind.names)

    return dealt.mapInArrow(run, kind)


def plain_rows(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and copies (1) of a table of conversations; null roles and texts are one blank."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    return table.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """One row in four with a fault: dropped, without text, without its final marks, twice, or with role user, by crc32 of `conv:turn` (nulls: one blank)."""
    named = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hurt = rows.withColumn("how", F.crc32(named.cast("binary")) % 20).where("how <> 0")
    return hurt.withColumns(
        {
            "text": F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "copies": F.when(F.col("how") == 3, 2 * F.col("copies")).otherwise(F.col("copies")),
            "role": F.when(F.col("how") == 4, NAMES[USER]).otherwise(F.col("role")),
        }
    ).drop("how")


def repair(every: DataFrame, rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for each conv of every; rows are their rows."""
    of, edits = edited(rows)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    shas = text_digests(rows, edits)
    parts = [
        every.select("conv", *[F.lit(None).cast("long").alias(c) for c in counts], F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256")),
        of.withColumn("repaired_sha256", F.lit(None).cast("string")),
        shas.select("conv", *[F.lit(None).cast("long").alias(c) for c in counts], F.lit(None).cast("string").alias("audit"), "repaired_sha256"),
    ]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("conv").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], *[F.max(c).alias(c) for c in ("audit", "repaired_sha256")])
    return one.withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain_rows(table(spark, sf_dir, "conversations"))
    return repair(rows, damaged(rows)).withColumnRenamed("conv", "conv_id")
