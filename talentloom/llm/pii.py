"""Personal data by a character-level bidirectional LSTM with CRF transitions.

The base patterns find emails, IP addresses, card and phone numbers. Their spans on a
bounded sample of documents, together with looser spellings made from them, are the
labelled spans on which the tagger is trained in numpy. The tagger then reads
overlapping windows of every text around digits and @ signs (a span without either
cannot be personal data of these kinds), a Viterbi pass labels each window, and the
spans of all windows of a text are reconciled together: base spans stay, of the others
the set with the largest total score is chosen that overlaps nothing chosen. A span
that fails the arithmetic of its kind is no candidate.

Defined results: null text is empty and has no spans; places are code points, ends
exclusive; repeated rows have equal results; a text of any length is read whole. With
no labelled span in the sample there is no tagger and the base spans are all.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import own_columns, per_row

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind

# --- Base patterns ----------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
# A match can only start where a run of digits starts.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def ip_ok(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts)


def card_ok(s: str) -> bool:
    return 12 <= len(d := digits(s)) <= 19 and luhn(d)


def phone_ok(s: str) -> bool:
    return 9 <= len(digits(s)) <= 15


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping: from each @, the local part to the left up to the last
    match, and the domain to the right."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end(), 0))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """All base spans, by start, then kind."""
    found = emails(text)
    if re.search("[0-9]", text):
        for kind, pattern, good in ((1, IP, ip_ok), (2, CARD, card_ok), (3, PHONE, phone_ok)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if good(m[0])]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


# --- Tagger -----------------------------------------------------------------------

CLASSES = "aA9\n @.-_+%()/:=\"'<>,"  # letters and digits stand for their kind; the rest for themselves
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, STEP, MARGIN = 64, 32, 24


def classes(text: str) -> np.ndarray:
    out = np.full(len(text), len(CLASSES), np.int64)
    for i, c in enumerate(text):
        if c.isascii() and c.isalnum():
            out[i] = 2 if c.isdigit() else 1 if c.isupper() else 0
        elif (place := CLASSES.find(c, 3)) >= 0:
            out[i] = place
    return out


@dataclass
class Tagger:
    """Weights of both directions stacked on the first axis, emissions and transitions."""

    table: np.ndarray  # (2, classes, 4 hidden): input part of the gates
    turn: np.ndarray  # (2, hidden, 4 hidden)
    emit: np.ndarray  # (2 hidden + 1, tags)
    follow: np.ndarray  # (tags, tags)

    @classmethod
    def new(cls, hidden: int, seed: int) -> Tagger:
        source = np.random.default_rng(seed)
        table = source.normal(0, 0.3, (2, len(CLASSES) + 1, 4 * hidden))
        table[:, :, hidden : 2 * hidden] += 1.0  # forget gates start open
        turn = source.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden))
        return cls(table, turn, source.normal(0, 0.3, (2 * hidden + 1, TAGS)), np.zeros((TAGS, TAGS)))

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.turn, self.emit, self.follow]

    def run(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (2, batch, time, hidden) and what the gradient needs. The second
        direction reads the windows backwards."""
        batch, time = x.shape
        hidden = self.turn.shape[1]
        both = np.stack([x, x[:, ::-1]])
        h, c = np.zeros((2, batch, hidden)), np.zeros((2, batch, hidden))
        states, kept = np.empty((2, batch, time, hidden)), []
        for t in range(time):
            inputs = np.stack([self.table[d][both[d, :, t]] for d in (0, 1)])
            gates = inputs + h @ self.turn
            i, f, o = (1 / (1 + np.exp(-gates[:, :, k * hidden : (k + 1) * hidden])) for k in range(3))
            g = np.tanh(gates[:, :, 3 * hidden :])
            before, c = c, f * c + i * g
            kept.append((h, before, i, f, o, g, np.tanh(c)))
            h = o * kept[-1][-1]
            states[:, :, t] = h
        return states, kept

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        states, kept = self.run(x)
        features = np.concatenate([states[0], states[1][:, ::-1], np.ones((*x.shape, 1))], axis=2)
        return features @ self.emit, features, kept

    def backward(self, x: np.ndarray, d_states: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        batch, time = x.shape
        hidden = self.turn.shape[1]
        both = np.stack([x, x[:, ::-1]])
        d_table, d_turn = np.zeros_like(self.table), np.zeros_like(self.turn)
        dh, dc = np.zeros((2, batch, hidden)), np.zeros((2, batch, hidden))
        for t in range(time - 1, -1, -1):
            h, before, i, f, o, g, tc = kept[t]
            dh = dh + d_states[:, :, t]
            dc = dc + dh * o * (1 - tc**2)
            d_gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=2)
            for d in (0, 1):
                np.add.at(d_table[d], both[d, :, t], d_gates[d])
            d_turn += h.transpose(0, 2, 1) @ d_gates
            dh, dc = d_gates @ self.turn.transpose(0, 2, 1), dc * f
        return d_table, d_turn

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences and its gradients."""
        emissions, features, kept = self.scores(x)
        batch, time = x.shape
        alpha = np.empty_like(emissions)
        alpha[:, 0] = emissions[:, 0]
        for t in range(1, time):
            alpha[:, t] = emissions[:, t] + _log_sum(alpha[:, t - 1][:, :, None] + self.follow[None])
        beta = np.zeros_like(emissions)
        for t in range(time - 2, -1, -1):
            beta[:, t] = _log_sum((self.follow[None] + (emissions[:, t + 1] + beta[:, t + 1])[:, None, :]).transpose(0, 2, 1))
        norm = _log_sum(alpha[:, -1][:, :, None])[:, 0]
        rows = np.arange(batch)
        d_emit = np.exp(alpha + beta - norm[:, None, None])
        d_follow, gold = np.zeros_like(self.follow), np.zeros(batch)
        for t in range(time):
            d_emit[rows, t, y[:, t]] -= 1
            gold += emissions[rows, t, y[:, t]]
            if t:
                pair = alpha[:, t - 1][:, :, None] + self.follow[None] + (emissions[:, t] + beta[:, t])[:, None, :]
                d_follow += np.exp(pair - norm[:, None, None]).sum(axis=0)
                np.add.at(d_follow, (y[:, t - 1], y[:, t]), -1)
                gold += self.follow[y[:, t - 1], y[:, t]]
        hidden = self.turn.shape[1]
        back = d_emit @ self.emit.T
        d_states = np.stack([back[:, :, :hidden], back[:, ::-1, hidden : 2 * hidden]])
        d_table, d_turn = self.backward(x, d_states, kept)
        d_weight = np.einsum("btf,btk->fk", features, d_emit)
        return float((norm - gold).mean()), [g / batch for g in (d_table, d_turn, d_weight, d_follow)]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequence of every window."""
        emissions, _, _ = self.scores(x)
        batch, time = x.shape
        reach, back = emissions[:, 0], np.empty((time, batch, TAGS), np.int64)
        for t in range(1, time):
            ways = reach[:, :, None] + self.follow[None]
            back[t] = ways.argmax(axis=1)
            reach = ways.max(axis=1) + emissions[:, t]
        tags = np.empty((batch, time), np.int64)
        tags[:, -1] = reach.argmax(axis=1)
        for t in range(time - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(batch), tags[:, t]]
        return tags


def _log_sum(a: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the middle axis."""
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def train(windows: list[tuple[str, list[Span]]], hidden: int = 12, epochs: int = 6, least_steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Tagger:
    """Adam over padded windows, for `epochs` passes but `least_steps` batches at least;
    order and weights come from the seed alone."""
    x = np.stack([classes(text.ljust(WINDOW)[:WINDOW]) for text, _ in windows])
    y = np.stack([tags_of(spans, 0, WINDOW) for _, spans in windows])
    model, source = Tagger.new(hidden, seed), np.random.default_rng(seed)
    moments, step = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()], 0
    batches = max(1, len(x) // batch)
    for _ in range(max(epochs, -(-least_steps // batches))):
        for rows in np.array_split(source.permutation(len(x)), batches):
            _, found = model.gradients(x[rows], y[rows])
            step += 1
            size = np.sqrt(sum((g**2).sum() for g in found))
            for w, g, (m, v) in zip(model.weights(), found, moments, strict=True):
                g = g * min(1.0, 5.0 / (size + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def tags_of(spans: list[Span], start: int, length: int) -> np.ndarray:
    """Tags of a window; a span that the window cuts is tagged as far as it shows."""
    tags = np.zeros(length, np.int64)
    for a, b, kind in spans:
        lo, hi = max(a - start, 0), min(b - start, length)
        if lo < hi:
            tags[lo:hi] = 2 + 2 * kind
            if a >= start:
                tags[lo] = 1 + 2 * kind
    return tags


def tagged_spans(tags: np.ndarray) -> list[Span]:
    spans, open_ = [], None
    for i, tag in enumerate([*tags.tolist(), 0]):
        if open_ and tag != 2 + 2 * open_[1]:
            spans.append((open_[0], i, open_[1]))
            open_ = None
        if tag % 2:
            open_ = (i, (tag - 1) // 2)
    return spans


# --- Windows of a text ------------------------------------------------------------


def window_starts(text: str) -> list[int]:
    """Overlapping windows that cover every digit and @ with a margin."""
    starts, reached = [], -1
    for m in TRIGGER.finditer(text):
        if m.start() < reached - MARGIN:
            continue
        start = max(m.start() - MARGIN, 0) if m.start() >= reached else starts[-1] + STEP
        starts.append(start)
        reached = start + WINDOW
    return starts


def possible(piece: str, kind: int) -> bool:
    """Whether a tagged string can be of its kind at all."""
    if kind == 0:
        local, at, domain = piece.partition("@")
        return bool(at and local.strip() and "." in domain.strip() and not re.search(r"\s\S*\s", piece))
    return (ip_ok, card_ok, phone_ok)[kind - 1](piece) and not piece[-1].isspace() and not piece[0].isspace()


def reconcile(base: list[Span], votes: dict[Span, int]) -> list[Span]:
    """Base spans and, of the tagged ones clear of them, the non-overlapping choice with
    the most votes (weighted by length); ties go to the earlier span."""
    taken = [(a, b) for a, b, _ in base]
    free = sorted((s for s in votes if all(s[1] <= a or s[0] >= b for a, b in taken)), key=lambda s: (s[1], s[0], s[2]))
    best: list[tuple[int, tuple]] = [(0, ())]
    for i, (a, b, kind) in enumerate(free):
        j = i
        while j and free[j - 1][1] > a:
            j -= 1
        with_it = best[j][0] + votes[(a, b, kind)] * (b - a)
        best.append((with_it, (*best[j][1], (a, b, kind))) if with_it > best[i][0] else best[i])
    return sorted([*base, *best[-1][1]], key=lambda s: (s[0], s[2], s[1]))


def find_spans(texts: list[str], base: list[list[Span]], model: Tagger | None, group: int = 1024) -> list[list[Span]]:
    """All spans of every text; windows of many texts are decoded together."""
    if model is None:
        return base
    places = [(i, s) for i, text in enumerate(texts) for s in window_starts(text)]
    votes: list[dict[Span, int]] = [{} for _ in texts]
    for k in range(0, len(places), group):
        part = places[k : k + group]
        tags = model.decode(np.stack([classes(texts[i][s : s + WINDOW].ljust(WINDOW)) for i, s in part]))
        for (i, s), row in zip(part, tags, strict=True):
            for a, b, kind in tagged_spans(row):
                cut = (a == 0 and s > 0) or (b == WINDOW and s + WINDOW < len(texts[i]))
                end = min(s + b, len(texts[i]))
                if not cut and s + a < end and possible(texts[i][s + a : end], kind):
                    span = (s + a, end, kind)
                    votes[i][span] = votes[i].get(span, 0) + 1
    return [reconcile(own, found) for own, found in zip(base, votes, strict=True)]


# --- Spark ------------------------------------------------------------------------


def looser(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """Other spellings of the same data, as further labelled windows: phone numbers
    without country code, with points or without any separator."""
    out = []
    for a, b, kind in spans:
        if kind == 3 and (m := re.match(r"\+[0-9]+[ .-]*", text[a:b])) and phone_ok(rest := text[a + m.end() : b]):
            for form in (rest, re.sub(r"[ ()-]+", ".", rest).strip("."), re.sub(r"[() ]+", "-", rest).strip("-")):
                left = text[:a] + form
                later = len(left) - b
                moved = [(x, y, k) if y <= a else (x + later, y + later, k) for x, y, k in spans if (x, y, k) != (a, b, kind)]
                out.append((left + text[b:], [*[s for s in moved if s[1] <= a], (a, len(left), 3), *[s for s in moved if s[0] >= len(left)]]))
    return out


def labelled_windows(docs: DataFrame, sample_docs: int, most: int) -> list[tuple[str, list[Span]]]:
    """Windows around triggers in about `sample_docs` documents, at most `most` of them,
    with the base spans they hold whole."""
    rows = docs.count()
    schema = pa.schema([("window", pa.string()), ("spans", pa.string())])

    def start():
        def handle(_, text):
            text = text or ""
            spans = base_spans(text)
            out = []
            for s in window_starts(text):
                own = [(a - s, b - s, k) for a, b, k in spans if a >= s and b <= s + WINDOW]
                out.append((text[s : s + WINDOW], ";".join(f"{a} {b} {k}" for a, b, k in own)))
            return out

        return handle

    every = max(1, rows // sample_docs)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(every)) == 0)
    found = sample.mapInArrow(per_row(start, schema), "window string, spans string").distinct()
    picked = found.orderBy(F.xxhash64("window"), "window", "spans").limit(most).collect()
    return [(w, [tuple(map(int, s.split())) for s in spans.split(";") if s]) for w, spans in picked]


def fit(docs: DataFrame, sample_docs: int = 20_000, most_windows: int = 3000, doc_id: str = "doc_id", text: str = "text") -> Tagger | None:
    """A tagger fitted on a bounded sample; None if the sample holds no labelled span."""
    windows = labelled_windows(own_columns(docs, doc_id=doc_id, text=text), sample_docs, most_windows)
    more = [w for text, spans in windows for w in looser(text, spans)]
    return train([*windows, *more]) if any(spans for _, spans in windows) else None


def personal_data(docs: DataFrame, model: Tagger | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document.
    Counts are of all spans; base_sha256 is of the base spans alone."""
    own = own_columns(docs, doc_id=doc_id, text=text)
    model = fit(own) if model is None else model
    schema = pa.schema(
        [("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                found = find_spans(texts, base, model)
                counts = [[sum(k == kind for _, _, k in spans) for spans in found] for kind in range(len(KINDS))]
                shas = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
                columns = [part.column(0).cast(pa.int64()), *map(pa.array, counts), pa.array(shas), pa.array([written(s) for s in found])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return own.mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )
