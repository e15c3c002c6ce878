"""Exact dedup with counting quotient filters.

Each partition turns the 64-bit fingerprints of its normalised texts into counting
quotient filters: a block of the fingerprint space keeps, for each quotient, the sorted
run of its remainders and their counts. Filters of one block merge without loss, as all
are sorted by remainder. Only fingerprints counted more than once go on to the
verification, which groups by the bytes of the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, documents, staged

#: Characters that the normalisation deletes.
SPACES = " \t\n\x0b\x0c\r"
#: Fingerprints that one merged block holds on average.
BLOCK_ENTRIES = 50_000
#: Up to so many repeated fingerprints (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18

FILTER_SCHEMA = "block long, quotient_bits int, occupied binary, run_ends binary, remainders binary, counts binary"


def filter_block(fingerprints: np.ndarray, counts: np.ndarray, block_bits: int) -> tuple[int, bytes, bytes, bytes, bytes]:
    """The filter of sorted distinct fingerprints that share their first `block_bits` bits.

    About as many quotients as entries; the quotients in use are a bitmap, the last entry
    of each run is a bit, and what is left of each fingerprint is its remainder, in as many
    bytes as it has. A count is a byte; one of 255 and more follows in 64 bits, in order.
    """
    quotient_bits = max(3, int(len(fingerprints)).bit_length())
    rest = 64 - block_bits - quotient_bits
    quotients = ((fingerprints << np.uint64(block_bits)) >> np.uint64(64 - quotient_bits)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    ends = np.append(quotients[1:] != quotients[:-1], True)
    remainders = (fingerprints & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-rest // 8)]
    large = counts >= 255
    packed = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()
    return quotient_bits, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders.tobytes(), packed


def filter_entries(block: int, block_bits: int, quotient_bits: int, occupied: bytes, run_ends: bytes, remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts of a filter: the inverse of filter_block."""
    width = -(-(64 - block_bits - quotient_bits) // 8)
    padded = np.zeros((len(remainders) // width, 8), np.uint8)
    padded[:, :width] = np.frombuffer(remainders, np.uint8).reshape(-1, width)
    rest = padded.view("<u8").ravel()
    short = np.frombuffer(counts, np.uint8, len(rest)).astype(np.int64)
    short[short == 255] = np.frombuffer(counts, "<i8", offset=len(rest))
    used = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(run_ends, np.uint8), count=len(rest)))
    quotients = np.repeat(used, np.diff(ends, prepend=-1)).astype(np.uint64)
    high = np.uint64(block << (64 - block_bits)) if block_bits else np.uint64(0)
    return high | (quotients << np.uint64(64 - block_bits - quotient_bits)) | rest, short


def merged(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of (fingerprints, counts) as one: each entry's place is its own and that in the other run."""
    (a, m), (b, n) = left, right
    fingerprints, counts = np.zeros(len(a) + len(b), np.uint64), np.zeros(len(a) + len(b), np.int64)
    for own, other, side, count in ((a, b, "left", m), (b, a, "right", n)):
        at = np.arange(len(own)) + np.searchsorted(other, own, side)
        fingerprints[at], counts[at] = own, count
    return _summed(fingerprints, counts)


def _summed(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1])[: len(fingerprints)])
    return fingerprints[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of each fingerprint that occurs n > 1 times in the column `fp` of so many rows."""
    block_bits = max(0, (rows // BLOCK_ENTRIES).bit_length())

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b["fp"].to_numpy(np.int64).view(np.uint64) for b in batches]
        fps = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        fps, counts = _summed(np.sort(fps), np.ones(len(fps), np.int64))
        blocks = (fps >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(fps), np.int64)
        cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])[: len(blocks)]).tolist() + [len(fps)]
        out = [(int(blocks[i]), *filter_block(fps[i:j], counts[i:j], block_bits)) for i, j in zip(cuts, cuts[1:])]
        yield pd.DataFrame(out, columns=["block", "quotient_bits", "occupied", "run_ends", "remainders", "counts"])

    def merge(filters: pd.DataFrame) -> pd.DataFrame:
        parts = [filter_entries(r.block, block_bits, r.quotient_bits, r.occupied, r.run_ends, r.remainders, r.counts) for r in filters.itertuples()]
        while len(parts) > 1:  # neighbours first, so that an entry moves as often as the runs double
            parts = [merged(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        fps, counts = parts[0]
        more = counts > 1
        return pd.DataFrame({"fp": fps[more].view(np.int64), "n": counts[more]})

    return fingerprints.select("fp").mapInPandas(build, FILTER_SCHEMA).groupBy("block").applyInPandas(merge, "fp long, n long")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept and text_sha256 of the normalised text.

    Texts are equal when they are identical without the characters of SPACES. The row
    with the most code points in its original text stays, then the smallest id (a null id
    comes last), and of rows repeated with id and text just one. A null text counts as
    empty, so that empty, null and blank texts are one group. An empty table gives an
    empty result.
    """
    texts = documents(docs, id_col, text_col)
    normal = F.translate("text", SPACES, "")
    digests = staged(
        texts.select("doc_id", F.length("text").cast("long").alias("points"), F.xxhash64(normal).alias("fp"), F.sha2(normal, 256).alias("sha"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    repeated = staged(repeated_fingerprints(digests, digests.count()), "repeated")
    routed = texts.select(F.xxhash64(normal).alias("fp"), normal.alias("normal")).join(broadcast_if(repeated.select("fp"), repeated.count(), BROADCAST_ROWS), "fp", "left_semi")
    same = routed.groupBy("fp", "normal").agg(F.count("*").alias("group_size")).where("group_size > 1")
    verified = same.select("fp", F.sha2("normal", 256).alias("sha"), "group_size")
    stays = F.min(F.struct((-F.col("points")).alias("points"), F.isnull("doc_id").alias("none"), "doc_id", "row"))
    groups = digests.groupBy("fp", "sha").agg(stays.alias("stays"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = groups.join(verified, ["fp", "sha", "group_size"]).select("fp", "sha", "group_size", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row").alias("keep_row"))
    alone = F.isnull("group_size")
    return digests.join(groups, ["fp", "sha"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
