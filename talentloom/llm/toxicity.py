"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon comes first: a fixed list of insults, and words and word beginnings that occur
far more often in texts labelled toxic, counted by Spark over a bounded sample of labelled
texts. Every text then becomes a short vector: how dense lexicon words are and how
telling, how near they stand to the second person, how much is in capitals, how much is
punctuation, and how often words are disguised. Boosted trees over these vectors are
trained in numpy; isotonic regression turns their margins into probabilities.

The sample is split in two halves. A half's vectors use the lexicon of the other half, and
the margins that isotonic regression reads come from trees of the other half, so no label
speaks for its own text. The final trees read both halves.

What is bounded, by parameters: `sample_rows` labelled texts (chosen by hash of the id),
`terms` lexicon entries of each kind of lexicon, and the trees. All texts are scored whole.

Defined results: a null text is empty, and an empty text has a score like any other; an id
that several label rows name is toxic if one of them says so; a null label is none; a
labelled id with several texts is learnt from its smallest; rows without doc_id have no
label and count as held out; repeated rows have equal scores; without labels of both kinds
the score is the share of toxic labels (0 without any); an empty table gives no rows; other
columns than id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import own_columns
from talentloom.session import materialise

# Common insults of four languages, and words for the second person.
INSULTS = frozenset(
    "idiot idiots idiotic stupid moron morons moronic imbecile imbeciles dumb dumbass fool fools loser losers clown clowns trash "
    "garbage scum scumbag vermin worthless pathetic disgusting disgrace filthy filth jerk creep pig pigs rat rats coward cowards "
    "bastard bastards bitch whore slut retard retarded asshole crap shit fuck fucking bullshit damn dummkopf trottel depp blöd blödmann dumm "
    "arschloch abschaum versager widerlich erbärmlich scheiße dreck imbécile crétin abruti débile minable connard salaud ordure merde "
    "idiota imbécil estúpido estúpida tonto basura payaso perdedor patético asqueroso inútil mierda cabrón".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner euch euer eure tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro vuestra".split()
)
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l",
                          "*": None, ".": None, "-": None, "_": None, "+": "t", "#": None})

WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W_])")
PUNCTUATION = re.compile(r"[!?]{2,}")
PREFIXES = (4, 5)
NEAR = 5
FEATURES = (
    "words", "insult_share", "insults", "learnt_share", "learnt_weight", "learnt_most", "learnt_distinct", "beginning_share",
    "beginning_weight", "beginning_most", "beginning_distinct", "near_second_person", "capital_letters", "capital_words", "exclamations",
    "questions", "repeated_marks", "disguised_words", "disguised_hits", "spaced_hits", "word_length", "other_letters",
)


@dataclass
class Lexicon:
    """Weights of words, and of word beginnings (with their length in letters)."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.strong = INSULTS | {w for w, x in self.words.items() if x >= 2 and len(w) > 3}
        self.masked = {w[:i] + "*" + w[i + 1 :] for w in self.strong for i in range(1, len(w))}


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The vector of a whole text, in the order of FEATURES."""
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    counts = Counter(words)
    n = len(words) or 1
    insults = learnt = begun = 0
    learnt_weight = learnt_most = begun_weight = begun_most = 0.0
    learnt_kinds, begun_kinds, hits = 0, set(), set()
    for word, times in counts.items():
        if word in INSULTS:
            insults += times
            hits.add(word)
        weight = lexicon.words.get(word)
        if weight is not None:
            learnt += times
            learnt_kinds += 1
            learnt_weight += weight
            learnt_most = max(learnt_most, weight)
            if weight >= 2:
                hits.add(word)
        if len(word) > PREFIXES[0]:
            for size in PREFIXES:
                weight = lexicon.beginnings.get(word[:size])
                if weight is not None:
                    begun += times
                    begun_kinds.add(word[:size])
                    begun_weight += weight
                    begun_most = max(begun_most, weight)
    near = 0
    if hits and not SECOND_PERSON.isdisjoint(counts):
        last_hit = last_person = -NEAR - 1
        for i, word in enumerate(words):
            if word in hits:
                near += i - last_person <= NEAR
                last_hit = i
            elif word in SECOND_PERSON:
                near += i - last_hit <= NEAR
                last_person = i
    capital_words = disguised = disguised_hits = 0
    for word, times in Counter(text.split()).items():
        if word.isalpha():
            capital_words += times * (len(word) > 2 and word.isupper())
            continue
        core = word.strip(".,;:!?\"'()[]{}<>|«»“”").lower()
        if len(core) < 3 or core.isalpha() or core.isdigit() or not any(c.isalpha() for c in core):
            continue
        disguised += times
        if core in lexicon.masked or core.translate(DISGUISE) in lexicon.strong:
            disguised_hits += times
    spaced = sum(joined(m[0].lower()) in lexicon.strong for m in SPACED.finditer(text))
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return [
        math.log1p(len(words)), insults / n, math.log1p(insults), learnt / n, math.log1p(learnt_weight), learnt_most, math.log1p(learnt_kinds), begun / n,
        math.log1p(begun_weight), begun_most, math.log1p(len(begun_kinds)), near / n, upper / (letters or 1), capital_words / n, text.count("!") / n,
        text.count("?") / n, len(PUNCTUATION.findall(text)) / n, disguised / n, math.log1p(disguised_hits), math.log1p(spaced), letters / n,
        1 - len(text.encode("ascii", "ignore")) / (len(text) or 1),
    ]


def joined(spaced: str) -> str:
    return "".join(c for c in spaced if c.isalpha())


# --- lexicon ----------------------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, half, toxic, text) of about `sample_rows` ids at most that may be learnt from,
    written. Which ones depends on the id alone."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold != 0)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).withColumn("half", (fold > 2).cast("int"))
    rows = known.count()
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, sample_rows / max(rows, 1)) * (1 << 30))
    ids = materialise(known.where(chosen))
    # No more than about sample_rows ids, so a broadcast is bounded.
    texts = docs.where("doc_id IS NOT NULL").join(F.broadcast(ids), "doc_id").select("doc_id", "half", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    return materialise(texts.groupBy("doc_id", "half", "toxic").agg(F.min("text").alias("text")))


def weight(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """Log odds of a term in toxic against clean texts; 0 for a term never seen."""
    share = toxic / (toxic + clean)
    return F.log((a + share) / toxic) - F.log((b + 1 - share) / clean)


def lexicons(sample: DataFrame, terms: int) -> dict[int, Lexicon]:
    """The lexicons of half 0, of half 1, and of both (key 2), each of at most `terms` words
    and as many beginnings, the most telling ones first."""
    sizes = {(r.half, r.toxic): r.n for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    longer = F.filter("words", lambda w: F.length(w) > PREFIXES[0])
    begun = F.array_distinct(F.flatten(F.array(*[F.transform(longer, lambda w, p=p: F.concat(F.lit("^"), F.substring(w, 1, p))) for p in PREFIXES])))
    each = sample.select("half", "toxic", words.alias("words")).select("half", "toxic", F.explode(F.concat("words", begun)).alias("term"))
    sums = {f"{kind}{half}": F.sum(((F.col("half") == half) & (F.col("toxic") == kind)).cast("long")) for half in (0, 1) for kind in (0, 1)}
    counts = each.groupBy("term").agg(*[c.alias(name) for name, c in sums.items()])
    counts = materialise(counts.where("`10` + `11` > 2"))
    found = {}
    for key, halves in ((0, (0,)), (1, (1,)), (2, (0, 1))):
        toxic, clean = (sum(sizes.get((h, kind), 0) for h in halves) for kind in (1, 0))
        if not toxic or not clean:
            found[key] = Lexicon()
            continue
        a, b = (sum((F.col(f"`{kind}{h}`") for h in halves), F.lit(0)) for kind in (1, 0))
        scored = counts.select("term", a.alias("a"), weight(a, b, toxic, clean).alias("w")).where("a > 1 AND w > 1")
        kinds = []
        for beginning in (False, True):
            rows = scored.where(F.col("term").startswith("^") == beginning).orderBy(F.desc(F.col("a") * F.col("w")), "term").limit(terms)
            kinds.append({r.term.lstrip("^"): r.w for r in rows.collect()})
        found[key] = Lexicon(*kinds)
    return found


# --- boosted trees and calibration ------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees over binned features."""

    edges: list[np.ndarray]
    base: float
    depth: int
    splits: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # feature and bin of every inner node
    leaves: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for (feature, cut), values in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += values[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order leaf values."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins)[1:-1])) for column in x.T]
    share = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees(edges, math.log(share / (1 - share)), depth)
    b = trees.binned(x)
    margin, slots = np.full(len(y), trees.base), bins + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-9)
            for f in range(x.shape[1]):
                place = (node - first) * slots + b[:, f]
                gs = np.bincount(place, g, many * slots).reshape(many, slots).cumsum(axis=1)
                hs = np.bincount(place, h, many * slots).reshape(many, slots).cumsum(axis=1)
                all_g, all_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (all_g - gs) ** 2 / (all_h - hs + ridge) - all_g**2 / (all_h + ridge)
                at = gain.argmax(axis=1)
                top = gain[np.arange(many), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + many][better], cut[first : first + many][better] = f, at[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        values = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        trees.splits.append((feature, cut))
        trees.leaves.append(values)
        margin = margin + values[leaf]
    return trees


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing function of least squares, by pooling neighbours."""
    places, back = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # mean, weight, number of places
    for total, n in zip(np.bincount(back, y), np.bincount(back), strict=True):
        blocks.append([total / n, n, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, c = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + c]
    return places, np.repeat([m for m, _, _ in blocks], [c for _, _, c in blocks])


@dataclass
class Model:
    """Lexicon, trees and calibration; without trees, one score for all."""

    lexicon: Lexicon
    trees: Trees | None
    points: tuple[np.ndarray, np.ndarray] | None
    share: float

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(vectors), self.share)
        return np.clip(np.interp(self.trees.margin(vectors), *self.points), 0.0, 1.0)


def _vectors(sample: DataFrame, books: dict[int, Lexicon]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, toxic, half) of the sample, each text under the lexicon of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, toxic = batch.column("half").to_pylist(), batch.column("toxic").to_pylist()
            rows = [features(batch.column("text")[i].as_py(), books[1 - half[i]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(half, pa.int32()), pa.array(toxic, pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                                             names=["doc_id", "half", "toxic", "v"])

    got = sample.mapInArrow(run, "doc_id long, half int, toxic int, v array<double>").orderBy("doc_id").collect()
    x = np.array([r.v for r in got]).reshape(-1, len(FEATURES))
    return x, np.array([r.toxic for r in got], float), np.array([r.half for r in got])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, terms: int = 4096, rounds: int = 80) -> Model:
    """Learn from labelled texts (doc_id, text; doc_id, toxic) whose ids are not held out."""
    sample = labelled(docs, labels, sample_rows)
    books = lexicons(sample, terms)
    x, y, half = _vectors(sample, books)
    share = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return Model(Lexicon(), None, None, share)
    margins = np.zeros(len(y))
    for h in (0, 1):
        mine, others = half == h, half != h
        if mine.any():
            margins[mine] = boost(x[others], y[others], rounds).margin(x[mine]) if others.any() else math.log((share + 1e-9) / (1 - share + 1e-9))
    return Model(books[2], boost(x, y, rounds), isotonic(margins, y), share)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, terms: int = 4096, doc_id: str = "doc_id", text: str = "text",
             toxic: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, insults, near_second_person, disguised) per document."""
    own = own_columns(docs, doc_id=doc_id, text=text)
    own = own.select(F.col("doc_id").cast("long"), "text")
    marks = own_columns(labels, doc_id=doc_id, toxic=toxic).select(F.col("doc_id").cast("long"), "toxic")
    model = fit(own, marks, sample_rows, terms)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    shown = [FEATURES.index(f) for f in ("insults", "near_second_person", "disguised_words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([features(batch.column("text")[i].as_py(), model.lexicon) for i in range(batch.num_rows)])
            scores = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), *[pa.array(x[:, i]) for i in shown]],
                names=["doc_id", "held_out", "score", "predicted", "insults", "near_second_person", "disguised"],
            )

    return own.select("doc_id", (fold == 0).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, insults double, near_second_person double, disguised double"
    )
