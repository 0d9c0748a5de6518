"""Quality rules as a short-circuit cascade.

Each rule looks at one text. A sample gives every rule's mean cost and the share of
texts it rejects; rules then run in order of rejection per cost, and a text leaves
the cascade at the first rule that rejects it. The verdict does not depend on the
order, only the work does.

Defined results: null text counts as empty; an empty text has no words and is
rejected by the word-count rule; repeated rows are judged alike; other columns are
carried through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import SEPARATORS, own_columns, per_row, utf8, words

SYMBOLS = b"#*$%&|<>"


class Text:
    """Measures of one text, each worked out when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return utf8(self.text)

    @cached_property
    def words(self) -> list[bytes]:
        return words(self.raw)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.raw.count, (bytes([c]) for c in SEPARATORS)))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.raw.count, (bytes([c]) for c in SYMBOLS)))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip(SEPARATORS)]

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside any three-word window that the text holds more than once."""
        n = self.n_words
        if n < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, n)
        _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
        _, back, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= twice
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


# Base rules of the contract, then limits that clean prose stays far away from.
RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 14 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("shouting", lambda t: 5 * t.n_upper > 2 * max(t.n_letters, 1)),
    Rule("few_letters", lambda t: 10 * t.n_letters < 3 * len(t.text)),
)
BASE_RULES = ("few_words", "repeated_windows")


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000) -> dict[str, tuple[float, float]]:
    """(seconds per text, share rejected) of every rule on about `sample_rows` texts.

    Only sums per rule reach the driver. On an empty table every rule costs nothing.
    """
    rows = docs.count()
    if not rows:
        return {r.name: (0.0, 0.0) for r in rules}
    schema = pa.schema([("rule", pa.int32()), ("seconds", pa.float64()), ("rejected", pa.int32())])

    def start():
        def handle(value):
            out = []
            for i, rule in enumerate(rules):
                began = time.thread_time()
                rejected = rule.rejects(Text(value))
                out.append((i, time.thread_time() - began, int(rejected)))
            return out

        return handle

    sample = own_columns(docs, text=text).sample(min(1.0, sample_rows / rows), seed=7)
    found = sample.mapInArrow(per_row(start, schema), "rule int, seconds double, rejected int")
    sums = found.groupBy("rule").agg(F.avg("seconds"), F.avg("rejected")).collect()
    return {r.name: (0.0, 0.0) for r in rules} | {rules[i].name: (cost, share) for i, cost, share in sums}


def order_rules(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """By rejection per cost, highest first; ties keep the given order."""
    return tuple(sorted(rules, key=lambda r: -measured[r.name][1] / (measured[r.name][0] + 1e-9)))


def first_rejection(text: Text, rules: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in rules if r.rejects(text)), None)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000, kept_only: bool = False) -> DataFrame:
    """All columns of `docs`; `rejected_by` is added: the first rule of the cascade that
    rejects the text, null for a kept one. With `kept_only`, kept rows alone, unchanged.
    """
    ordered = order_rules(rules, measure(docs, rules, text, sample_rows))
    place = docs.columns.index(text)
    arrow = docs.limit(0).toArrow().schema
    out = arrow if kept_only else arrow.append(pa.field("rejected_by", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            verdicts = [first_rejection(Text(column[i].as_py()), ordered) for i in range(batch.num_rows)]
            if kept_only:
                yield batch.filter(pa.array([v is None for v in verdicts], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.string())], schema=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, fields if kept_only else f"{fields}, rejected_by string")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """Base measures of every text and the verdict of the cascade, one row per document."""
    ordered = order_rules(rules, measure(docs, rules, text, sample_rows))
    base = [r for r in rules if r.name in BASE_RULES]
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    )

    def start():
        def handle(key, value):
            t = Text(value)
            failed = first_rejection(t, base) is not None
            kept = not failed and first_rejection(t, ordered) is None
            return key, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept

        return handle

    return own_columns(docs, doc_id=doc_id, text=text).mapInArrow(
        per_row(start, schema),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean",
    )
