"""Encoders from text to token ids, as column expressions where they can be."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END_ID = 2

Encoder = Callable[[Column], Column]


def code_points(text: Column) -> Column:
    """One id per character, its code point; an empty or null text has none."""
    empty = F.array().cast("array<int>")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, empty).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def code_point_count(text: Column) -> Column:
    """size(code_points(text)) without making the ids."""
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def code_point_span(text: Column, begin: Column, length: Column, end_id: int = END_ID) -> Column:
    """slice(with_end(code_points(text)), begin + 1, length) of a span inside the text, closing id
    included, without making the ids outside of it."""
    part = F.coalesce(F.substr(text, (begin + 1).cast("int"), length.cast("int")), F.lit(""))
    return F.when(F.length(part) < length, with_end(code_points(part), end_id)).otherwise(code_points(part))


def span_text(text: Column, begin: Column, length: Column, end_id: int = END_ID) -> Column:
    """The text whose code points are code_point_span's ids: the closing id is a character too."""
    part = F.coalesce(F.substr(text, (begin + 1).cast("int"), length.cast("int")), F.lit(""))
    return F.when(F.length(part) < length, F.concat(part, F.lit(chr(end_id)))).otherwise(part)


def repeated_id(text: Column) -> Column:
    """`ID:N` as ID, N times."""
    part = lambda k: F.split_part(text, F.lit(":"), F.lit(k)).cast("int")
    return F.array_repeat(part(1), part(2))


def with_end(ids: Column, end_id: int = END_ID) -> Column:
    return F.concat(ids, F.array(F.lit(end_id)))


def decode(ids: Column, skip: tuple[int, ...] = (END_ID,)) -> Column:
    """Text of code-point ids, without the special ones and outer white space."""
    kept = ids
    for x in skip:
        kept = F.array_remove(kept, x)
    # A text is decoded as a whole. Its byte-order mark is written out, as the first one is taken for that.
    units = F.array_join(F.transform(kept, lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.btrim(F.decode(F.unhex(F.concat(F.lit("0000FEFF"), units)), "UTF-32"), F.lit(" \t\n\r\x0b\x0c"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def vocabulary(docs: DataFrame, size: int, first_id: int = 3) -> DataFrame:
    """(word, id) of the `size` commonest words; ids follow frequency, then the word."""
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").count()
    top = counts.orderBy(F.desc("count"), "word").limit(size)
    # At most `size` rows are numbered in one task.
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "word"))
    return top.select("word", (rank + (first_id - 1)).cast("int").alias("id"))


#: Words that a vocabulary may have; it is sent to every executor.
MOST_WORDS = 1_000_000


def dictionary_ids(docs: DataFrame, vocab: DataFrame, unknown_id: int = 0) -> DataFrame:
    """(doc_id, ids): the vocabulary ids of each document's words, in order.

    No word is moved: the vocabulary (at most MOST_WORDS words, else an error) goes to the
    documents, and a batch's words are looked up as one array.
    """
    known = vocab.limit(MOST_WORDS + 1).collect()
    if len(known) > MOST_WORDS:
        raise ValueError(f"a vocabulary of more than {MOST_WORDS} words")
    shared = docs.sparkSession.sparkContext.broadcast(([r["word"] for r in known], [r["id"] for r in known]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        words_, ids = shared.value
        held, number = pa.array(words_, pa.string()), np.array([*ids, unknown_id], dtype=np.int32)
        for batch in batches:
            parts = pc.split_pattern_regex(batch.column("text").fill_null(""), "[ \\t\\n\\x0B\\f\\r]+")
            flat = parts.flatten()
            real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(flat, value_set=held), len(words_)).to_numpy()
            before = np.concatenate([[0], np.cumsum(real)])
            offsets = before[parts.offsets.to_numpy() - parts.offsets[0].as_py()].astype(np.int32) if len(parts) else np.zeros(1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[at[real]]))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


#: Bytes of texts that a task tokenises at once; one longer text is alone.
AT_ONCE = 1 << 18


def slices(texts: pa.Array, most: int) -> Iterator[slice]:
    """Runs of rows that hold `most` bytes, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield slice(low, high)
        low = high


def tokenizer_ids(path: str) -> Callable[[DataFrame], DataFrame]:
    """A step that adds `ids` by a `tokenizers` vocabulary file, in Arrow batches. What the tokenizer
    holds of a text is a hundred times its ids, so it gets AT_ONCE bytes at a time."""

    def step(docs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(path)
            for batch in batches:
                for part in slices(batch.column("text"), AT_ONCE):
                    some = batch.slice(part.start, part.stop - part.start)
                    texts = [t or "" for t in some.column("text").to_pylist()]
                    ids = [e.ids for e in encoder.encode_batch(texts, add_special_tokens=False)]
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")

    return step
