"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, ending with the assistant. Dynamic programming over that automaton picks
for every turn to keep it, merge it into the turn before, relabel it, or put an empty
turn before it, at the least total cost; the repaired turns are then rendered.

Costs of a stretch of turns form a small matrix from entry to exit state, and matrices
of neighbouring stretches combine. So turns are sorted by range over all tasks and cut
into bounded stretches; only matrices of conversations with several stretches meet, and
every stretch is then repaired on its own between its two states. A conversation of any
length is never held by one task.

Defined results: turns are ordered by turn, role and text, nulls first; roles are
compared in lower case without outer spaces, a null or unknown role fits any place at
the cost of a relabel; null text is empty; rows without conv_id are one conversation;
repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import own_columns, to_batch, width
from talentloom.session import materialise

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 10**9
ENDING = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}  # empty turns to a legal end


def role_state(role: str | None) -> int:
    """The state a turn of this role leads to; START for an unknown role."""
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else START


def moves(role: int) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """For each state before and after a turn of `role`: cost, action, inserted states.

    The cheapest way between two states; ties go to keep, merge, insert, relabel.
    """
    table = [[(FAR, "", ())] * 4 for _ in range(4)]

    def offer(before: int, after: int, cost: int, action: str, inserted: tuple[int, ...] = ()) -> None:
        if cost < table[before][after][0]:
            table[before][after] = (cost, action, inserted)

    for before in range(4):
        for after in LEGAL[before]:
            if after == role:
                offer(before, after, 0, "keep")
        if before != START:
            offer(before, before, MERGE + (RELABEL if before != role else 0), "merge")
        for step in LEGAL[before]:
            for after in LEGAL[step]:
                offer(before, after, INSERT + (RELABEL if after != role else 0), "insert", (step,))
        for after in LEGAL[before]:
            offer(before, after, RELABEL, "relabel")
    return table


MOVES = [moves(role) for role in range(4)]
COSTS = np.array([[[cell[0] for cell in row] for row in table] for table in MOVES])


def stretch_matrix(roles: list[int]) -> np.ndarray:
    """Least cost from every entry to every exit state over the turns."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in roles:
        total = np.minimum((total[:, :, None] + COSTS[role][None]).min(axis=1), FAR)
    return total


def best_exits(matrices: list[np.ndarray]) -> list[int]:
    """The exit state of every stretch on the cheapest way through all of them."""
    reach, back = np.where(np.arange(4) == START, 0, FAR), []
    for m in matrices:
        ways = reach[:, None] + m
        back.append(ways.argmin(axis=0))
        reach = np.minimum(ways.min(axis=0), FAR)
    state = int((reach + [ENDING[s] for s in range(4)]).argmin())
    exits = []
    for source in reversed(back):
        exits.append(state)
        state = int(source[state])
    return exits[::-1]


def repair_stretch(roles: list[int], entry: int, leave: int) -> list[tuple[int, int]]:
    """(state before, state after) of every turn on the cheapest way from entry to leave."""
    reach, back = np.where(np.arange(4) == entry, 0, FAR), []
    for role in roles:
        ways = reach[:, None] + COSTS[role]
        back.append(ways.argmin(axis=0))
        reach = np.minimum(ways.min(axis=0), FAR)
    path, state = [], leave
    for source in reversed(back):
        path.append((int(source[state]), state))
        state = int(source[state])
    return path[::-1]


def opening(before: int, state: int) -> str:
    return ("" if before == START else "<|end|>\n") + f"<|{ROLES[state - 1]}|>\n"


def rendered_turns(turns: list, roles: list[int], texts: list[str], entry: int, leave: int, last: bool) -> Iterator[tuple]:
    """(turn, step, action, role, cost, rendered) of a stretch; step 0 comes before the
    turn itself, 1 is the turn, 2 and up close the conversation."""
    for turn, role, text, (before, after) in zip(turns, roles, texts, repair_stretch(roles, entry, leave), strict=True):
        cost, action, inserted = MOVES[role][before][after]
        for state in inserted:
            yield turn, 0, "insert", ROLES[state - 1], INSERT, opening(before, state)
            before = state
        own = cost - INSERT * len(inserted)
        if action == "merge":
            yield turn, 1, "merge", ROLES[after - 1], own, "\n" + text
        else:
            yield turn, 1, "relabel" if own else "keep", ROLES[after - 1], own, opening(before, after) + text
    if last:
        step, state = 2, leave
        while state != ASSISTANT:
            following = USER if state == SYSTEM else ASSISTANT
            yield turns[-1], step, "insert", ROLES[following - 1], INSERT, opening(state, following)
            step, state = step + 1, following
        yield turns[-1], step, "close", "assistant", 0, "<|end|>\n"


STRETCHES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.int32())),
     ("texts", pa.list_(pa.string())), ("matrix", pa.list_(pa.int64()))]
)


def stretches(conversations: DataFrame, most_turns: int = 256, most_chars: int = 1 << 20) -> DataFrame:
    """Sorted turns in bounded stretches of one conversation, ordered by (part, seq)."""
    order = ["conv_id", "turn", "role", "text"]
    ranged = conversations.repartitionByRange(width(conversations), "conv_id", "turn", "role", F.xxhash64("text"))
    sorted_turns = ranged.sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"), "text").select(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, []
        key, turns, roles, texts, chars = None, [], [], [], 0

        def close() -> None:
            nonlocal seq
            out.append((key, part, seq, turns, roles, texts, stretch_matrix(roles).ravel().tolist()))
            seq += 1

        for batch in batches:
            for i in range(batch.num_rows):
                conv, turn, role, text = (c[i].as_py() for c in batch.columns)
                if turns and (conv != key or len(turns) >= most_turns or chars >= most_chars):
                    close()
                    turns, roles, texts, chars = [], [], [], 0
                key = conv
                turns.append(turn)
                roles.append(role_state(role))
                texts.append(text or "")
                chars += len(texts[-1])
            if out:
                yield to_batch(out, STRETCHES)
                out = []
        if turns:
            close()
            yield to_batch(out, STRETCHES)

    return sorted_turns.mapInArrow(
        run, "conv_id long, part int, seq int, turns array<long>, roles array<int>, texts array<string>, matrix array<long>"
    )


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit of each stretch of one conversation; `group` holds matrices only."""
    group = group.sort_values(["part", "seq"])
    exits = best_exits([np.asarray(m).reshape(4, 4) for m in group["matrix"]])
    last = [False] * (len(exits) - 1) + [True]
    return group[["name", "part", "seq"]].assign(entry=[START, *exits[:-1]], leave=exits, last=last)


REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("step", pa.int32()), ("action", pa.string()), ("role", pa.string()), ("cost", pa.int32()), ("rendered", pa.string())]
)


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, step, action, role, cost, rendered): what becomes of every turn.

    In order of turn and step, the `rendered` pieces of a conversation put one after
    another are its repaired and formatted sequence.
    """
    own = own_columns(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    cut = materialise(stretches(own))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    slim = cut.select(name.alias("name"), "part", "seq", "matrix")
    several = slim.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ends = (
        slim.join(several, "name").groupBy("name").applyInPandas(_exits, "name string, part int, seq int, entry int, leave int, last boolean")
    )
    joined = cut.withColumn("name", name).join(ends, ["name", "part", "seq"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["leave"] is None:  # the conversation's only stretch
                    alone = np.asarray(row["matrix"]).reshape(4, 4)
                    row |= {"entry": START, "leave": best_exits([alone])[0], "last": True}
                pieces = rendered_turns(row["turns"], row["roles"], row["texts"], row["entry"], row["leave"], row["last"])
                yield to_batch([(row["conv_id"], *piece) for piece in pieces], REPAIRED)

    return joined.drop("name", "part", "seq").mapInArrow(
        run, "conv_id long, turn long, step int, action string, role string, cost int, rendered string"
    )
