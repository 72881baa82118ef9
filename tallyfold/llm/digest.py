"""Document fingerprints by a quartile bucket digest.

All byte triplets of a window of five bytes are hashed into 256 buckets. A
bucket's code is the quartile of its count among all buckets; the digest is
the codes and a logarithmic length. Two digests differ by a bounded score:
steps between the codes, and between the lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.hashing import U, mix
from tallyfold.llm.tables import bounded_batches, text_of

BUCKETS = 256
# Offsets of the triplets within a window of five bytes that start at its first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
# Score of a difference of 0..3 quartiles; three is a contradiction.
STEP = np.array([0, 1, 2, 6], np.int64)
# Score of a step of length (a tenth), beyond the first; and the score from which two texts count as unlike.
LENGTH_STEP = 12
BOUND = 416

_TABLES = [(mix(np.arange(256, dtype=U) + U(1000 * (k + 1))) >> U(56)).astype(np.uint8) for k in range(3)]
_SALTS = (mix(np.arange(1, 7, dtype=U)) >> U(56)).astype(np.uint8)


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """Triplets of the bytes by bucket; fewer than five bytes still have the
    triplets that fit."""
    counts = np.zeros(BUCKETS, np.int64)
    n = len(data)
    a, b, c = (t[data] for t in _TABLES)
    for (second, third), own_salt in zip(TRIPLETS, _SALTS, strict=True):
        if n > third:
            m = n - third
            counts += np.bincount(a[:m] ^ b[second : second + m] ^ c[third : third + m] ^ own_salt, minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """Length in steps of a tenth; 0 for an empty text."""
    return 0 if n == 0 else min(255, 1 + int(np.log(n) / np.log(1.1)))


def digest(text: bytes) -> bytes:
    """65 bytes: length code, then four bucket codes a byte."""
    data = np.frombuffer(text, np.uint8)
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    codes = sum((counts > ordered[k * BUCKETS // 4 - 1]).astype(np.uint8) for k in (1, 2, 3))
    quads = codes.reshape(-1, 4)
    packed = quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]
    return bytes([length_code(len(text))]) + packed.astype(np.uint8).tobytes()


_PAIR = np.zeros((256, 256), np.int64)
for _shift in (0, 2, 4, 6):
    _codes = (np.arange(256) >> _shift) & 3
    _PAIR += STEP[np.abs(_codes[:, None] - _codes[None, :])]
_PAIR = _PAIR.astype(np.uint8)


def likeness(one: bytes, two: bytes) -> float:
    """1 for equal digests, 0 from a difference of ``BOUND`` on."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    score = int(_PAIR[a[1:], b[1:]].sum()) + LENGTH_STEP * max(0, abs(int(a[0]) - int(b[0])) - 1)
    return 1.0 - min(score, BOUND) / BOUND


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """Hex digest of a text; null counts as empty."""
    return text.map(lambda t: digest((t or "").encode()).hex())


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, own ones first and in order, then the guests. Each
    own row meets the row after it."""
    before = None
    for batch in batches:
        rows = []
        for bucket, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            if before and before[0] == bucket and not before[1]:
                old, old_text, old_digest = before[2:]
                half = len(old_text) // 2
                edited = (old_text[: len(old_text) - half] + text[:half]).encode()
                own = digest(raw)
                new = digest(edited)
                rows.append(
                    (old, len(old_text), hashlib.sha256(edited).hexdigest(), old_digest.hex(), new.hex(), likeness(old_digest, new), likeness(old_digest, own))
                )
                before = (bucket, guest, doc, text, own)
            else:
                before = (bucket, guest, doc, text, None if guest else digest(raw))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


# Rows of a bucket, about, and the most buckets; a bucket is streamed, so its size is not a question of memory.
BUCKET_ROWS, MOST_BUCKETS = 500, 10_000


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last half is
    replaced by as much of the next document's beginning, with the likeness to
    the edited text and to the next document.

    The order is by id, nulls first, then text; after the last comes the
    first. It is made without a global sort: ids are cut at quantiles into
    buckets, each sorted and streamed by itself, and the first row of a bucket
    is also sent to the bucket before as a guest. Null text counts as empty;
    rows that share an id follow each other; a single row follows itself; an
    empty table gives no rows. Other columns are ignored.
    """
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    spark = docs.sparkSession
    least = -(2**63)
    ids = F.col(id_col).cast("long")
    keys = docs.select(F.coalesce(ids, F.lit(least)).alias("k"))
    total = keys.count()
    if not total:
        return spark.createDataFrame([], out)
    buckets = int(min(MOST_BUCKETS, max(1, total // BUCKET_ROWS)))
    cuts = np.zeros(0, np.int64)
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        cuts = np.unique(keys.agg(F.percentile_approx("k", shares, 20 * MOST_BUCKETS)).first()[0])

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    # One row a bucket: their number is bounded, whatever the table's size.
    firsts = sorted((b, k) for b, k in keys.groupBy(bucket_of("k").alias("b")).agg(F.min("k")).collect())
    host = {k: firsts[n - 1][0] for n, (_, k) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, k.to_numpy(), side="right")
        return pd.Series([[b, host[x]] if x in host else [b] for x, b in zip(k.tolist(), own.tolist(), strict=True)])

    rows = bounded_batches(docs).select(ids.alias("doc_id"), text_of(text_col).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(least)))
    dealt = rows.select("doc_id", "k", "text", F.posexplode(places("k")).alias("guest", "bucket"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", "k", "text")
    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(_edited, out)
