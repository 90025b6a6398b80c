"""Conversation structure repair: the cheapest edits that turn a dialogue into ``(s?(ua)+)?``.

Turns are read in order (null turns first, then role, then content). Each turn is kept (0), given the
role the place needs (2) or deleted (3); an empty turn may be inserted anywhere (2). Blank turns and turns
whose role and text stood before must go; a truncated turn that stays costs 1 more.

The search is a depth-first branch and bound over (turns read, grammar state): an explicit stack, a
suffix lower bound, the incumbent (cost, audit) per end, and a table of the best prefix per node that
cuts worse ones. It ends when the stack is empty, so the result is proved
cheapest and, among equals, the one with the ASCII-least audit.

A long conversation is searched in segments: per state at a segment's end the best prefix is carried
on, with its running digest, so memory holds one segment whatever the length. The digest of a
conversation is one sequential hash; its turns therefore pass through one task, as a sorted stream.
Blank turns and turns known to repeat an earlier one travel without their text.

Nulls in role or text count as one space, a null conversation is a conversation, ties of turn are
read by role and content, repeated rows are duplicates, extra columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.llm.common import small_batches
from likeness.session import spread

WHITE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SEGMENT_ROWS = 256
SEGMENT_BYTES = 4 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by a hash of conversation and turn: dropped, emptied, cut, repeated or given to the user."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
                                (F.crc32(key) % 20).alias("_fault")).where("_fault > 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def marked(turns: DataFrame) -> DataFrame:
    """Turns with their initial, the flags that need no neighbours, and a digest of role and text."""
    last = F.rtrim("text", F.lit(WHITE))
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.select("*", F.substring("role", 1, 1).alias("_first"), (last == "").alias("_blank"),
                       (~F.right(last, F.lit(1)).isin(".", "!", "?")).alias("_cut"),
                       F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("_digest"))
    when = F.struct(F.col("turn").isNotNull(), "turn")
    again = rows.where("not _blank").groupBy("conv_id", "_digest").agg(
        F.count("*").alias("_n"), F.min(when).alias("_since")).where("_n > 1").select(
        F.col("conv_id").alias("_c"), F.col("_digest").alias("_d"), "_since")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_digest") == F.col("_d")), "left")
    later = F.coalesce((F.col("_since") < when), F.lit(False))
    gone = later | F.col("_blank")
    return rows.select("conv_id", "turn", "role", F.when(~gone, F.col("text")).alias("text"), "_first", "_blank", "_cut",
                       later.alias("_later"), "_digest")


# Search ---------------------------------------------------------------------------------------
def _needed(state: int) -> tuple[str, int]:
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def suffix_bounds(rows: list[tuple[str, bool, bool]], last: bool) -> list[list[tuple]]:
    """Per turn and state, the least cost from there to every end: one end for the last segment, else the four states.

    The bound leaves out the audits, which is what the search then settles. ``rows`` hold initial, must
    go, truncated. Before the last segment ends nothing is inserted behind its last turn: the next one
    can do that as well.
    """
    never = 1 << 40
    if last:
        bounds = [[(0,), (2 * INSERT,), (INSERT,), (0,)]]
    else:
        bounds = [[tuple(0 if e == q else never for e in range(4)) for q in range(4)]]
    for first, gone, cut in reversed(rows):
        after, here = bounds[-1], []
        more = TRUNCATED if cut else 0
        for q in range(4):
            ways = [[DELETE + c for c in after[q]]]
            if not gone:
                ways.append([ROLE + more + c for c in after[_needed(q)[1]]])
                if (q, first) in STEP:
                    ways.append([more + c for c in after[STEP[q, first]]])
            here.append([min(w) for w in zip(*ways)])
        for _ in range(3):      # an insertion moves on to the next state
            here = [[min(c, INSERT + d) for c, d in zip(here[q], here[_needed(q)[1]])] for q in range(4)]
        bounds.append([tuple(h) for h in here])
    return bounds[::-1]


def search(rows: list[tuple[str, bool, bool]], entries: dict[int, tuple[int, int]], last: bool) -> dict[int, tuple[int, int, str]]:
    """Best (cost, rank of the entry, audit) per state after ``rows``; the last segment has one state, the end.

    ``entries`` are the states to begin in, with cost so far and rank of their audits.
    """
    n = len(rows)
    bounds = suffix_bounds(rows, last)
    table: dict[tuple[int, int], tuple[int, int, str]] = {}
    best: dict[int, tuple[int, int, str]] = {}

    def hopeless(i, state, cost, rank, audit):
        """No end can still be reached at less cost, or at equal cost with an audit that may be less."""
        for end, rest in enumerate(bounds[i][state]):
            if rest < 1 << 30:
                now = best.get(end)
                if now is None or (cost + rest, rank, audit) <= (now[0], now[1], now[2][:len(audit)]):
                    return False
        return True

    stack = [(0, state, cost, rank, "") for state, (cost, rank) in
             sorted(entries.items(), key=lambda e: (-e[1][0], -e[1][1]))]
    while stack:
        i, state, cost, rank, audit = stack.pop()
        label = (cost, rank, audit)
        if table.get((i, state), label) < label or hopeless(i, state, cost, rank, audit):
            continue
        table[i, state] = label
        if i == n and (not last or state in ENDS):
            end = 0 if last else state
            best[end] = min(best.get(end, label), label)
            continue
        role, to = _needed(state)
        moves = [(INSERT, "I", i, to)]
        if i < n:
            first, gone, cut = rows[i]
            moves.append((DELETE, "D", i + 1, state))
            if not gone:
                more = TRUNCATED if cut else 0
                moves.append((ROLE + more, "R", i + 1, to))
                if (state, first) in STEP:
                    moves.append((more, "K", i + 1, STEP[state, first]))
        # The most promising move is popped first, the least letter among equals.
        moves.sort(key=lambda m: (m[0] + min(bounds[m[2]][m[3]]), m[1]), reverse=True)
        for price, letter, j, q in moves:
            new = (cost + price, rank, audit + letter)
            if table.get((j, q), new) >= new:
                stack.append((j, q, *new))
    return best


class _Conversation:
    """Counts and the live prefixes of one conversation while its turns stream by."""

    def __init__(self, conv):
        self.conv, self.rows, self.texts, self.bytes = conv, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.turn = self.first = self.digest = None
        # state -> cost, rank, (earlier audit, audit) chain, digest so far, anything hashed yet
        self.live = {START: (0, 0, None, hashlib.sha256(), False)}
        self.any = False

    def add(self, turn, role, text, first, blank, cut, later, digest):
        same = self.any and self.turn == turn and self.digest == digest
        duplicate = not blank and (later or same)
        cut = cut and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut
        self.illegal += self.any and self.first + first not in ("su", "ua", "au")
        if turn is not None:
            self.turns += not self.any or self.turn != turn
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.any, self.turn, self.first, self.digest = True, turn, first, digest
        self.rows.append((first, blank or duplicate, cut))
        self.texts.append((role, text))
        self.bytes += len(text or "")
        if len(self.rows) >= SEGMENT_ROWS or self.bytes >= SEGMENT_BYTES:
            self.close(last=False)

    def close(self, last):
        by_rank = {v[1]: (k, v) for k, v in self.live.items()}
        found = search(self.rows, {k: v[:2] for k, v in self.live.items()}, last)
        ranked = sorted(found.items(), key=lambda e: e[1][1:])
        live = {}
        for new_rank, (state, (cost, rank, audit)) in enumerate(ranked):
            before, (_, _, chain, digest, started) = by_rank[rank]
            digest, started = self.write(digest.copy(), started, before, audit)
            live[state] = (cost, new_rank, (chain, audit), digest, started)
        self.live, self.rows, self.texts, self.bytes = live, [], [], 0

    def write(self, digest, started, state, audit):
        turn = 0
        for edit in audit:
            if edit != "I":
                role, text = self.texts[turn]
                first = self.rows[turn][0]
                turn += 1
                if edit == "D":
                    continue
            if edit == "K":
                state = STEP[state, first]
            else:
                role, state = _needed(state)
            text = "" if edit == "I" else text
            digest.update((("\n" if started else "") + f"{role}:{text}").encode())
            started = True
        return digest, started

    def result(self):
        self.close(last=True)
        cost, _, chain, digest, _ = self.live[0]
        parts = []
        while chain is not None:
            chain, part = chain
            parts.append(part)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
                "".join(reversed(parts)), digest.hexdigest())


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``: faults, cost, audit and the digest of the repaired text."""
    small_batches(turns.sparkSession)
    conv = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv), *[T.StructField(c, T.LongType()) for c in NUMBERS],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        pack = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        now, done = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv, *row in zip(*columns):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv)
                now.add(*row)
            if len(done) > 1000:
                yield pack(done)
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield pack(done)

    rows = spread(marked(turns).select("conv_id", "turn", "role", "text", "_first", "_blank", "_cut", "_later", "_digest"),
                  ["conv_id"])
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "_digest").mapInArrow(run, schema)


def repair_all(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """``repair`` of ``turns``, with a row also for conversations of which no turn is left."""
    found = repair(turns).withColumnRenamed("conv_id", "_c")
    ids = conversations.select("conv_id").distinct()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``conv_id, position, turn, role, text, edit``.

    Edits are dealt to the turns by their running number; roles that were changed or inserted follow
    from the place, since user and assistant alternate after an opening system turn.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "_digest")
    rows = marked(turns).withColumn("_i", F.row_number().over(order)).select(
        F.col("conv_id").alias("_c"), "_i", "turn", "role", "text")
    upto = W.partitionBy("conv_id").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    edits = found.where("audit <> ''").select("conv_id", F.posexplode(F.split("audit", "")).alias("_pos", "edit")).where("edit <> ''")
    edits = edits.select("conv_id", "_pos", "edit", F.sum((F.col("edit") != "I").cast("int")).over(upto).alias("_n"),
                         F.sum((F.col("edit") != "D").cast("int")).over(upto).alias("position")).where("edit <> 'D'")
    joined = edits.join(rows, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_n") == F.col("_i")) & (F.col("edit") != "I"), "left")
    opening = F.max(F.when((F.col("position") == 1) & (F.col("edit") == "K") & (F.substring("role", 1, 1) == "s"), 1).otherwise(0)).over(
        W.partitionBy("conv_id"))
    place = F.when((F.col("position") - opening) % 2 == 1, "user").otherwise("assistant")
    return joined.select("conv_id", "position", "turn", F.when(F.col("edit") == "K", F.col("role")).otherwise(place).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"), "edit")
