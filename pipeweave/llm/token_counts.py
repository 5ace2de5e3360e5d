"""Token counts by a tokenizer file, lengths only.

Batch encoding runs inside an Arrow function. A text is split at safe
boundaries (a single space between two characters that are not white space:
pre-tokenisation never crosses it, and no special token holds a space). The
distinct pieces of a task are encoded once, in batches balanced by bytes, and
a text's count is the sum over its pieces; ids never leave the function.

Defined results: a null text is empty (0 bytes, 0 tokens); repeated rows are
counted each for itself; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import common

#: Bytes of pieces that one call of the tokenizer gets.
BATCH_BYTES = 1 << 18
#: Pieces remembered by a task; beyond it the memory starts anew.
MEMORY_PIECES = 1_000_000


def piece_counter(encode_lengths, batch_bytes: int, memory: int):
    """A function texts -> token counts with a bounded piece memory.

    ``encode_lengths`` maps a list of strings to their token counts.
    """
    import re

    safe = re.compile(r"(?<=\S) (?=\S)")
    known: dict[str, int] = {}

    def pieces(text: str) -> list[str]:
        parts = text.split(" ")
        for i in range(1, len(parts)):
            parts[i] = " " + parts[i]
        return parts

    def clean(parts: list[str]) -> bool:
        return all(known.get(p, -1) >= 0 for p in parts)

    def learn(new: list[str]) -> None:
        batch: list[str] = []
        size = 0
        for p in new:
            batch.append(p)
            size += len(p) * 2 + 8
            if size >= batch_bytes:
                known.update(zip(batch, encode_lengths(batch), strict=True))
                batch, size = [], 0
        if batch:
            known.update(zip(batch, encode_lengths(batch), strict=True))

    def unsafe(p: str) -> bool:
        body = p[1:] if p[:1] == " " else p
        return not body or body[0].isspace() or body[-1].isspace()

    def count(texts: list[str]) -> list[int]:
        if len(known) > memory:
            known.clear()
        split = [pieces(t) for t in texts]
        for i, parts in enumerate(split):
            if any(unsafe(p) for p in parts if p not in known):
                split[i] = [p if k == 0 else " " + p for k, p in enumerate(safe.split(texts[i]))]
        learn(list({p for parts in split for p in parts if p not in known}))
        get = known.__getitem__
        return [sum(map(get, parts)) for parts in split]

    return count


def counts(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES, memory: int = MEMORY_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every text by the library for the file.

    ``tokenizer_path`` ends in .json (tokenizers) or .model (sentencepiece);
    the file must be on every machine, as the tokenizer package is. A
    sentencepiece model may cross spaces, so there whole texts are encoded.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa

        if tokenizer_path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)

            def count(texts):
                return [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer_path)
            model.no_truncation()
            model.no_padding()

            def lengths(batch):
                return [len(x) for x in model.encode_batch_fast(batch, add_special_tokens=False)]

            count = piece_counter(lengths, batch_bytes, memory)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
