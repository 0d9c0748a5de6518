"""Best-fit packing of documents into fixed-length token sequences.

Only lengths matter for a packing, and there are at most `limit` of them. So the plan
is made from the histogram of piece lengths: an index of single, pair and triple
length sums finds combinations that fill a gap exactly, as often as all their lengths
are available; what is left goes best-fit, longest first. The plan is a list of
patterns with multiplicities, bounded by `limit` and not by the data. Pieces then find
their slot by their rank among the pieces of their length.

Defined results: null text counts as empty and is one end token; repeated rows are
packed each; an empty table gives no rows; long texts are cut into whole pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import own_columns
from talentloom.session import materialise



class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary given as ranked byte strings."""

    def __init__(self, ranks_path: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """Strings of special tokens count as these tokens."""
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def token_pieces(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    special: dict[str, int] | None = None,
    end_id: int = 2,
    limit: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32): whole documents as pieces of at
    most `limit` ids. A longer document is cut so that only its first piece is shorter.
    """
    special = {"<|endoftext|>": 50256} if special is None else special
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(public_tokenizers.path(vocabulary), special)
        rows, held = [], []

        def flush():
            ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).astype(np.int32)))
            keys, numbers, starts, lengths, sums = zip(*rows, strict=True)
            columns = [pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), ids, pa.array(sums, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                key, value = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = np.append(encoder.ids(value or ""), np.uint32(end_id))
                head = (len(ids) - 1) % limit + 1
                for number, start in enumerate((0, *range(head, len(ids), limit))):
                    own = ids[start : head if number == 0 else start + limit]
                    rows.append((key, number, start, len(own), zlib.crc32(own.astype("<u4").tobytes())))
                    held.append(own)
                size += len(ids)
                if size > 1_000_000:
                    yield flush()
                    rows, held, size = [], [], 0
        if rows:
            yield flush()

    return own_columns(docs, doc_id=doc_id, text=text).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long"
    )


Pattern = tuple[tuple[int, int], ...]  # (length, copies) in order of placing


def _pairs(have: np.ndarray, total: int) -> Iterator[tuple[int, int]]:
    """Available pairs with this sum, the longer part descending."""
    longer = np.arange(total - 1, (total + 1) // 2 - 1, -1)
    for a in longer[have[longer] & have[total - longer]] if total > 1 else ():
        yield int(a), int(total - a)


def exact_fill(left: np.ndarray, length: int, limit: int) -> Counter | None:
    """Lengths, `length` among them, that sum to `limit` and are all available:
    the first of the single, pair and triple complements, longest parts first."""

    def fits(*others: int) -> Counter | None:
        need = Counter((length, *others))
        return need if all(left[x] >= n for x, n in need.items()) else None

    gap, have = limit - length, left > 0
    if not gap:
        return fits()
    if have[gap] and (found := fits(gap)):
        return found
    for pair in _pairs(have, gap):
        if found := fits(*pair):
            return found
    for a in np.flatnonzero(have[:gap])[::-1]:
        if 3 * a < gap:
            break
        for b, c in _pairs(have, gap - int(a)):
            if b <= a and (found := fits(int(a), b, c)):
                return found
    return None


def plan_packing(counts: dict[int, int], limit: int = 1024) -> list[tuple[Pattern, int]]:
    """Patterns of lengths and how many sequences follow each."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[Pattern, int]] = []
    for length in range(limit, 0, -1):
        while left[length] and (need := exact_fill(left, length, limit)):
            times = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= times * n
            plan.append((tuple(sorted(need.items(), reverse=True)), times))
    open_bins: dict[int, list[tuple[Counter, int]]] = {}
    for length in range(limit, 0, -1):
        rest = int(left[length])
        while rest and (gap := min((g for g, bins in open_bins.items() if g >= length and bins), default=0)):
            held, n = open_bins[gap].pop()
            times = min(n, rest)
            if n > times:
                open_bins[gap].append((held, n - times))
            open_bins.setdefault(gap - length, []).append((held + Counter([length]), times))
            rest -= times
        each = limit // length
        for copies, n in ((each, rest // each), (rest % each, 1)):
            if copies and n:
                open_bins.setdefault(limit - copies * length, []).append((Counter({length: copies}), n))
    return plan + [(tuple(sorted(held.items(), reverse=True)), n) for bins in open_bins.values() for held, n in bins]


def slots(plan: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset, copies): which
    ranks among the pieces of a length go to which sequences, at which place."""
    out, used, sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for length, copies in pattern:
            out.append((length, used[length], used[length] + times * copies, sequence, offset, copies))
            used[length] += times * copies
            offset += length * copies
        sequence += times
    return out


def pack(pieces: DataFrame, limit: int = 1024, bucket_rows: int = 5000) -> DataFrame:
    """`pieces` (doc_id, piece, length and any others) with sequence_id and offset.

    The rank of a piece among those of its length comes from counts per hash bucket and
    a window inside each bucket, so one very frequent length is spread over many tasks.
    """
    spark = pieces.sparkSession
    counts = {row[0]: row[1] for row in pieces.groupBy("length").count().collect()}  # at most `limit` rows
    buckets = sum(counts.values()) // bucket_rows + 16
    placed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = placed.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    # The slots are bounded by the number of lengths, whatever the number of pieces.
    names = "_length long, _first long, _last long, _sequence long, _offset long, _copies long"
    place = F.broadcast(spark.createDataFrame(slots(plan_packing(counts, limit)), names))
    inside_run = F.col("_rank") - F.col("_first")
    return (
        ranked.join(place, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last")))
        .withColumn("sequence_id", F.col("_sequence") + F.floor(inside_run / F.col("_copies")))
        .withColumn("offset", F.col("_offset") + F.pmod(inside_run, F.col("_copies")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its ids and its place. The pieces are written once, as lengths
    are counted before they can be placed; placing reads the lengths, not the ids."""
    return pack(materialise(token_pieces(docs, limit=limit, doc_id=doc_id, text=text)), limit)
