"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are encoded by the tokenizer library in batches of about ``BATCH_BYTES``, whatever the
number of rows in an Arrow batch, and only the number of tokens leaves the worker.  A text of
more than ``long_bytes`` would hold its task: distinct long texts are split into parts that are
dealt over the cluster and counted like short texts, and the parts' counts are added up.

Parts end at *safe boundaries*: between two characters that stand next to each other in no
piece of the vocabulary.  A token that spanned such a border would be a piece holding both, so
the tokens of the parts are the tokens of the text.  The library puts a word mark before every
text; a part that is not the first gets a newline in front (a piece of its own, and safe on
both sides), and the two tokens that this costs are taken off again.

Defined cases: a null or empty text has 0 bytes and 0 tokens; strings of special tokens inside
a text are ordinary text, as the library has it by default; a stretch of any length without a
safe boundary is one part; equal texts give equal counts, repeated rows stay rows; columns of
the output's names are replaced, all others pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.shared import small_side, stored

BATCH_BYTES = 2 << 20
LONG_BYTES = 64 << 10
MARK, GUARD = "▁", "\n"


class Counter:
    """A sentencepiece model ready to count; ``model`` is the content of the file."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.library.get_piece_size())
        pieces = [self.library.id_to_piece(i) for i in ids if not self.library.is_byte(i) and not self.library.is_control(i)]
        self.inside = {piece[k:k + 2] for piece in pieces for k in range(len(piece) - 1)}
        probe = "a  bé ①ﬁ\nÁ"
        plain = self.library.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.can_split = plain and self.library.encode(GUARD, out_type=str)[0] == MARK and not any(GUARD in piece for piece in pieces)

    def lengths(self, texts: Sequence[str]) -> list[int]:
        return [len(x) for x in self.library.encode(list(texts), num_threads=1)]

    def safe(self, text: str, at: int) -> bool:
        """Whether no token spans the border before character ``at``."""
        return text[at - 1:at + 1].replace(" ", MARK) not in self.inside

    def parts(self, text: str, size: int) -> Iterator[str]:
        """Parts of ``size`` characters or more, up to the next safe boundary; all but the first begin with the guard."""
        at, guard = 0, ""
        while self.can_split and len(text) - at > size:
            cut = next((k for k in range(at + size, len(text)) if self.safe(text, k)), len(text))
            yield guard + text[at:cut]
            at, guard = cut, GUARD
        if at < len(text):
            yield guard + text[at:]


@lru_cache(maxsize=2)
def _counter(model: bytes) -> Counter:
    return Counter(model)


def read_model(path: str, max_bytes: int = 64 << 20) -> bytes:
    """The model file, small by nature; it goes to the workers as a broadcast."""
    with open(path, "rb") as f:
        model = f.read(max_bytes + 1)
    if len(model) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    return model


def _balanced(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each, a longer row alone."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def _counted(df: DataFrame, model, text: str, name: str) -> DataFrame:
    """``df`` without ``text`` and with the tokens of its texts."""
    carried = [f for f in df.schema.fields if f.name not in (text, name)]
    names = [f.name for f in carried]

    def run(batches):
        counter = _counter(model.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "")
            for lo, hi in _balanced(np.asarray(pc.binary_length(texts), np.int64), BATCH_BYTES):
                n = pa.array(counter.lengths(texts.slice(lo, hi - lo).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), n], [*names, name])

    return df.mapInArrow(run, T.StructType([*carried, T.StructField(name, T.LongType())]))


def _long_counts(texts: DataFrame, model, size: int) -> DataFrame:
    """(digest, tokens) of distinct long texts (digest, body), counted part by part."""
    def split(batches):
        counter = _counter(model.value)
        for batch in batches:
            for digest, body in zip(batch.column("digest"), batch.column("body"), strict=True):
                for k, part in enumerate(counter.parts(body.as_py(), size)):
                    yield pa.RecordBatch.from_pydict({"digest": pa.array([digest.as_py()], pa.binary()), "part": pa.array([k], pa.int32()), "body": pa.array([part], pa.string())})

    parts = texts.mapInArrow(split, "digest binary, part int, body string").repartition("digest", "part")
    counted = _counted(parts, model, "body", "tokens")
    own = F.col("tokens") - F.when(F.col("part") > 0, 2).otherwise(0)
    return counted.groupBy("digest").agg(F.sum(own).alias("tokens"))


def count(df: DataFrame, model: bytes, text: str = "text", name: str = "n_tokens", keep: Sequence[str] | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """``df`` without its texts, with ``n_bytes`` and ``name``; ``keep`` are the columns to carry (all if not given)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (df.columns if keep is None else keep) if c not in (text, name, "n_bytes")]
    rows = df.select(F.struct(*kept).alias("row"), F.col(text).alias("body"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    short = _counted(rows.where(F.col("n_bytes") <= long_bytes), shared, "body", "tokens")
    long = rows.where(F.col("n_bytes") > long_bytes).withColumn("digest", F.unhex(F.sha2("body", 256)))
    bodies = long.groupBy("digest").agg(F.any_value("body").alias("body"))
    counts = stored(_long_counts(bodies, shared, long_bytes), "long_counts")
    joined = long.select("row", "n_bytes", "digest").join(small_side(counts), "digest").select("row", "n_bytes", "tokens")
    return short.unionByName(joined).select("row.*", "n_bytes", F.col("tokens").alias(name))
