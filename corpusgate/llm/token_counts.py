"""Operator 1: token counts by a map-side two-tier look-up.

Tier one is a compact table of the lengths (in tokens) of the `TABLE` most
frequent pre-tokens, broadcast to every worker: its size is bounded. Tier two is
each worker's own cache: a pre-token that the table lacks is encoded once by the
tokenizer and remembered. No pre-token is ever shuffled.

The frequent pre-tokens are found over the whole corpus: each task keeps a
Misra-Gries summary of at most `TABLE` pre-tokens, and the summaries (one row
each, of bounded size) are merged in a tree of `FAN` until one is left. The
table changes only where a length is looked up, never the length.

Cases: a null or empty text has 0 tokens; repeated rows each give their own
row; an empty table gives no row; texts of any length are counted whole.
"""
from __future__ import annotations

import json
import uuid
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, spare, staged, table, texts_of, with_columns, with_field, worker_cache
from corpusgate.llm.tokens import LONG, Pieces

TOKENIZER = "byte_bpe_50k.json"
TABLE = 1 << 16
FAN = 32
LIMIT = 1024
GROUP = 64        # texts encoded together
CACHE = 1_600_000  # lengths remembered by one worker: about 170 bytes each


def trim(counts: Counter, keep: int) -> None:
    """Misra-Gries: take the (keep + 1)-th count off every count, drop what is left with none."""
    if len(counts) > keep:
        less = sorted(counts.values(), reverse=True)[keep]
        for word in [w for w, n in counts.items() if n <= less]:
            del counts[word]
        for word in counts:
            counts[word] -= less


def pack(counts: Counter) -> bytes:
    """Counts of str, or of bytes (kept as latin-1), as compressed JSON."""
    rows = sorted((w.decode("latin-1") if isinstance(w, bytes) else w, n) for w, n in counts.items())
    return zlib.compress(json.dumps(rows).encode(), 1)


def unpack(blob: bytes) -> Counter:
    return Counter(dict(json.loads(zlib.decompress(blob))))


def pieces_of(text: str) -> list[str]:
    return text.replace("\n", " \n").split(" ")


def frequent(docs: DataFrame, keep: int = TABLE, fan: int = FAN,
             cut: Callable[[str], list] = pieces_of, least: int = 1) -> list[str]:
    """What the corpus-wide Misra-Gries summary of all `cut(text)` holds at least `least` times,
    most frequent first."""
    def summarise(batches: Batches) -> Batches:
        counts: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                counts.update(cut(text))
                if len(counts) > 8 * keep:
                    trim(counts, keep)
        for word in [w for w in counts if not w or len(w) > LONG]:
            del counts[word]
        trim(counts, keep)
        yield pa.RecordBatch.from_pydict({"summary": pa.array([pack(counts)], pa.binary())})

    def merge(batches: Batches) -> Batches:
        counts: Counter = Counter()
        for batch in batches:
            for blob in batch.column("summary").to_pylist():
                counts.update(unpack(blob))
                trim(counts, keep)
        yield pa.RecordBatch.from_pydict({"summary": pa.array([pack(counts)], pa.binary())})

    level = staged(docs.select("text").mapInArrow(summarise, "summary binary"), "pretoken-summaries")
    while (n := level.count()) > 1:
        groups = max(1, -(-n // fan))
        level = staged(level.repartition(groups).mapInArrow(merge, "summary binary"), "pretoken-summaries")
        if groups == 1:
            break
    row = level.first()
    if row is None:
        return []
    found = unpack(bytes(row.summary))
    return [w for w, n in sorted(found.items(), key=lambda x: (-x[1], x[0])) if n >= least]


def count(docs: DataFrame, path: str, keep: int = TABLE, out: str = "token_count") -> DataFrame:
    """`docs` with a struct column `out`: n_bytes (UTF-8) and n_tokens of the whole text."""
    spark = docs.sparkSession
    out = spare(docs, out)
    words = frequent(docs, keep)
    pieces = Pieces(path, lengths_only=True)
    pieces.learn(set(words))
    lengths = bytes(min(255, pieces.cache.get(w, 255)) for w in words)
    shared = spark.sparkContext.broadcast(("\0".join(words), lengths))
    kind = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def tiers():
        names, sizes = shared.value
        # a word with a NUL or a length beyond a byte is left to tier two
        split = names.split("\0")
        first = {w: n for w, n in zip(split, sizes) if n < 255} if len(split) == len(sizes) else {}
        return first, Pieces(path, lengths_only=True, limit=CACHE)

    key = f"token_counts_{uuid.uuid4().hex}"

    def run(batches: Batches) -> Batches:
        first, second = worker_cache(key, tiers)
        for batch in batches:
            texts = texts_of(batch)
            counts = []
            for a in range(0, len(texts), GROUP):
                counts += map(sum, second.encode(texts[a:a + GROUP], first))
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield with_columns(batch, **{out: pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], fields=list(kind))})

    return docs.mapInArrow(run, with_field(docs, out, "struct<n_bytes: bigint, n_tokens: bigint>"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.col("token_count")
    return count(docs, tokenizer_path()).select(
        "doc_id", n["n_bytes"].alias("n_bytes"), n["n_tokens"].alias("n_tokens"),
        (n["n_tokens"] > LIMIT).alias("over_limit"))
