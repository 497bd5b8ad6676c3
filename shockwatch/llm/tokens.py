"""Token counts of whole texts with a sentencepiece model, in Arrow batches that return lengths only.

The splits of a text are safe by construction: the pairs of neighbouring characters inside the
pieces of the vocabulary are listed once, and a text is cut only between a non-space and a space,
a pair that no piece contains. A merge can then never reach over a cut, so the counts of the parts
add up to the count of the text, for a text of any length. (The constructor refuses a model for
which that does not hold: another normaliser than identity, no dummy prefix, or a piece with a
space after another character.)

Equal parts are encoded once per worker: texts are gathered to batches of about BATCH_BYTES, the
parts a worker has not seen are encoded in one call, and every text gets the sum of its parts. The
memory of parts holds MEMORY entries at most; beyond it parts are encoded without being remembered.

Defined cases: a null text is empty and has 0 tokens and 0 bytes; rows are independent, so ties,
repeated rows and null ids need nothing; an empty table gives an empty result; only doc_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

BATCH_BYTES = 1 << 20
MEMORY = 500_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class Counter:
    """Counts of one sentencepiece model."""

    spaced = re.compile(r" +[^ ]*")

    def __init__(self, model_path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        inside = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        safe = not any(b == "▁" and a != "▁" for a, b in inside)
        probe = " a  \uff21\ufb01\u3000\t\n b "
        if not safe or self.model.normalize(probe) != "▁" + probe.replace(" ", "▁"):
            raise ValueError(f"{model_path}: texts cannot be cut at spaces for this model")
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> list[str]:
        """Parts that stand after a space each; their counts add up to the text's."""
        words = text.split(" ")
        if "" in words:  # runs of spaces, or one at an end: a part keeps all its spaces but the first
            words = [part[1:] for part in self.spaced.findall(" " + text)] if text else []
        return words

    def lengths(self, texts: list[str]) -> list[int]:
        """Token counts of a batch: parts not seen yet are encoded together."""
        split = [self.parts(text) for text in texts]
        new = list({part for parts in split for part in parts if part not in self.known})
        # an empty part is a lone space, which the library would take for an empty text
        counts = {part: len(ids) if part else 1
                  for part, ids in zip(new, self.model.encode(new, num_threads=1), strict=True)} if new else {}
        if len(self.known) + len(counts) <= MEMORY:
            self.known.update(counts)
            return [sum(map(self.known.__getitem__, parts)) for parts in split]
        known = self.known
        return [sum(known[p] if p in known else counts[p] for p in parts) for parts in split]


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive batches of about the same number of characters; a longer text stands alone."""
    batch, held = [], 0
    for text in texts:
        if batch and held + len(text) > limit:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += len(text)
    if batch:
        yield batch


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path)
        for batch in batches:
            lengths = [n for part in by_bytes(batch.column("text").to_pylist()) for n in counter.lengths(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(lengths, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                       F.octet_length(text_of()).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
