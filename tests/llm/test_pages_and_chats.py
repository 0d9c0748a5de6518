"""WARC round trips and role repair against exhaustive search."""

import hashlib
import itertools
from collections import defaultdict

import pytest

from talentloom.llm import chat, warc


def test_warc_round_trip(spark):
    big, other = "<p>é</p>" * 300, "x" * 1000
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (5, "u", big), (3, "u", other), (4, "u", other), (6, "u", "small"), (7, "u", "small"),
            (8, "u", None), (9, "u", ""), (5, "u", big), (10, "u", "\r\n\r\n" * 400), (11, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, offset long")
    archive = warc.write_archive(pages, file_bytes=3000)
    got = warc.read_records(archive.index, most=5000).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", 0))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and last[h] != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None, None if revisit else raw))
    key = lambda r: tuple(map(str, r))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%20b%0D%0AX:%20y"} and {r.url for r in got if r.page_id == 2} == {None}
    few = warc.read_records(archive.index.where("page_id IN (3, 11)")).collect()
    assert sorted(r.page_id for r in few) == [3, 11]


def test_warc_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archive(pages).index).count() == 0


def cheapest(roles):
    """Least cost by trying every action and role for every turn."""
    best = {chat.START: 0}
    for role in roles:
        after = defaultdict(lambda: chat.FAR)
        for state, cost in best.items():
            if state != chat.START:
                after[state] = min(after[state], cost + chat.MERGE + (chat.RELABEL if state != role else 0))
            for gap in (0, 1):
                for steps in itertools.product((1, 2, 3), repeat=gap + 1):
                    s, legal = state, True
                    for step in steps:
                        legal &= step in chat.LEGAL[s]
                        s = step
                    if legal:
                        after[s] = min(after[s], cost + gap * chat.INSERT + (chat.RELABEL if s != role else 0))
        best = after
    return min(cost + chat.ENDING[s] for s, cost in best.items())


@pytest.mark.parametrize("length", (1, 2, 3, 4, 5))
def test_repair_is_cheapest_and_legal(length):
    for roles in itertools.product(range(4), repeat=length):
        leave = chat.best_exits([chat.stretch_matrix(list(roles))])[0]
        pieces = list(chat.rendered_turns(list(range(length)), list(roles), ["t"] * length, chat.START, leave, True))
        assert sum(p[4] for p in pieces) == cheapest(roles)
        turns = [p[3] for p in pieces if p[2] in ("keep", "relabel", "insert")]
        body = turns[1:] if turns[0] == "system" else turns
        assert body == ["user", "assistant"] * (len(body) // 2) and body
        assert "".join(p[5] for p in pieces).count("<|end|>\n") == len(turns)


def test_stretches_combine_to_the_whole():
    roles = [1, 2, 2, 3, 0, 3, 1, 2, 3, 3, 2, 1] * 5
    whole = chat.best_exits([chat.stretch_matrix(roles)])[-1]
    parts = [roles[i : i + 7] for i in range(0, len(roles), 7)]
    exits = chat.best_exits([chat.stretch_matrix(p) for p in parts])
    cost = sum(
        chat.MOVES[r][a][b][0] for p, e, x in zip(parts, [chat.START, *exits], exits) for r, (a, b) in zip(p, chat.repair_stretch(p, e, x))
    )
    assert cost + chat.ENDING[exits[-1]] == cheapest(roles) and chat.ENDING[whole] == chat.ENDING[exits[-1]]


def test_repair_on_awkward_rows(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(700)]
    rows += [(2, 0, None, None), (2, 1, " USER ", ""), (2, 1, " USER ", ""), (3, 0, "tool", "x" * 2_000_000), (None, None, "user", "hi"), (None, 0, "assistant", "yo")]
    talks = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, part int, name string")
    got = chat.repair(talks).collect()
    one = sorted((r.turn, r.step, r.rendered) for r in got if r.conv_id == 1)
    assert "".join(p for *_, p in one) == "".join(f"<|{r}|>\n{t}<|end|>\n" for _, _, r, t in rows[:700])
    own = [r for r in got if r.action not in ("insert", "close")]
    assert len(own) == len(rows) and {r.conv_id for r in got} == {1, 2, 3, None}
    assert sum(r.cost for r in got if r.conv_id == 3) == chat.RELABEL + chat.INSERT
    assert chat.repair(talks.limit(0)).count() == 0
