"""Token ids in ORC files.

Texts are dealt out by document id, or by a given column such as the position
in a mix (range partitions, sorted inside), encoded
with a public tokenizer and written as ORC: integer run-length encoded ids,
row indexes, and Bloom filters on the document id, so readers take stripes in
parallel and skip stripes by id. Each file carries its block number and each
row its offset inside the block, so a reader needs only one total per block to
place a document in the whole token stream.

Words between ASCII white space are encoded once per worker and remembered
(bounded cache): the tokenizer's pre-tokens never cross white space, so the
ids of a text are those of its words in order, gathered for a portion of texts
at once. A very long text is a portion of its own.

Defined cases: null text is empty and gives the end id alone; null ids come
first; rows that share an id are ordered by text and all written; an empty
table gives no rows. Extra input columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.llm.common import shared_path, table

END_ID = 1
#: Columns of the files.
STORED = "block int, block_start long, n_ids int, doc_id long, ids array<int>"
#: Words remembered per worker; the cache starts anew when it is full.
CACHE_WORDS = 800_000
#: Words encoded in one call.
GROUP = 64

_ENCODERS: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str) -> tuple:
    """The tokenizer, the words it has encoded, and a special token that marks off words (text, id) or None."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        marks = [(t.content, i) for i, t in sorted(tokenizer.get_added_tokens_decoder().items())
                 if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word) and t.content.startswith("<|")]
        _ENCODERS[path] = (tokenizer, {}, marks[0] if marks else None)
    return _ENCODERS[path]


def _encoded(words: list[str], path: str) -> list[bytes]:
    """The ids of words, as packed 32-bit integers; GROUP words at a time, with the
    start token between them, which has an id of its own."""
    tokenizer, _, mark = _encoder(path)
    out: list[bytes] = []
    groups = [words[i:i + GROUP] for i in range(0, len(words), GROUP)]
    if mark is None:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    for group, e in zip(groups, tokenizer.encode_batch_fast([mark[0].join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.uint32)
        cuts = np.flatnonzero(ids == mark[1])
        if len(cuts) == len(group) - 1:
            packed, ends = ids.tobytes(), [-1, *cuts.tolist(), len(ids)]
            out += [packed[4 * a + 4:4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        else:                       # a word holds the mark itself
            out += [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(group, add_special_tokens=False)]
    return out


def _ids_of(words: list[str], path: str) -> list[bytes]:
    """The ids of each of some different words, remembered."""
    cache = _encoder(path)[1]
    new = [w for w in words if w not in cache]
    if len(cache) + len(new) > CACHE_WORDS:
        cache.clear()
        new = words
    cache.update(zip(new, _encoded(new, path), strict=True))
    return [cache[w] for w in words]


def _words(texts: pa.Array) -> pa.Array:
    """Lists of the words between white space (and empty strings). Without special
    tokens in sight, A-Z is lower-cased, as the tokenizer does, and punctuation after
    a letter, where it always cuts, is parted from the word: fewer different words."""
    plain = pc.fill_null(texts, "").cast(pa.large_string())
    for gap in "\t\n\x0b\x0c\r":
        plain = pc.replace_substring(plain, gap, " ")
    if not pc.any(pc.match_substring(plain, "<|")).as_py():
        plain = pc.ascii_lower(pc.replace_substring_regex(plain, r"([a-zA-Z])([,.!?;:])", r"\1 \2"))
    return pc.split_pattern(plain, " ")


def encode_portion(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by the end id, and where each text ends."""
    lists = _words(texts)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    edges = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    words = flat.filter(real).dictionary_encode()           # each different word once
    packed = _ids_of(words.dictionary.to_pylist(), path)
    pool = np.frombuffer(b"".join(packed), np.uint32).view(np.int32)
    size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    at = words.indices.to_numpy()
    first, n = (np.cumsum(size) - size)[at], size[at]
    total = np.concatenate([[0], np.cumsum(n)])
    ids = pool[np.repeat(first - total[:-1], n) + np.arange(total[-1])]
    counts = np.diff(total[edges])
    out = np.full(len(ids) + len(texts), END_ID, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), counts)] = ids
    return out, np.cumsum(counts + 1)


def encode_texts(texts: Iterable[str | None], path: str) -> Iterator[np.ndarray]:
    """The ids of each text followed by the end id."""
    ids, ends = encode_portion(pa.array(list(texts), pa.string()), path)
    yield from np.split(ids, ends[:-1])


def _portions(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of about ``most`` bytes together, with the number of the first."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + size[j] <= most):
            held += size[j]
            j += 1
        yield i, texts.slice(i, j - i)
        i = j


def _encode_batches(path: str):
    schema = pa.schema([("block", pa.int32()), ("block_start", pa.int64()), ("n_ids", pa.int32()),
                        ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            for i, texts in _portions(batch.column(2)):
                ids, ends = encode_portion(texts, path)
                begin = np.concatenate([[0], ends[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(start + begin), pa.array(np.diff(ends, prepend=0).astype(np.int32)),
                     batch.column(1).slice(i, n), lists],
                    schema=schema)
                start += len(ids)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, by: str | None = None) -> None:
    """Write the ids of every document to ORC files in ascending order of ids, or of the column ``by``."""
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    if by:
        order = [F.col(by).asc_nulls_first(), *order]
    dealt = (docs.select("doc_id", "text", *([by] if by else [])).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
             .select(F.spark_partition_id().alias("block"), F.col("doc_id").cast("long"), "text"))
    encoded = dealt.mapInArrow(_encode_batches(tokenizer or default_tokenizer()),
                               STORED)
    (encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true")
     .option("orc.row.index.stride", "1000").option("compression", "zstd").orc(path))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        ends = ids.offsets.to_numpy()
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)),
             pa.array(crc, pa.int64())], names=["block", "block_start", "doc_id", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Block, offset in the block, document id and ids of every written row."""
    return spark.read.schema(STORED).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read back from the files: start in the whole
    stream, length and checksum. Only block totals (one row per file) meet in
    one window; documents are not shuffled."""
    rows = read_tokens(spark, path).select("block", "block_start", "doc_id", "ids").mapInArrow(
        _digest, "block int, block_start long, doc_id long, n_tokens long, ids_crc32 long")
    totals = read_tokens(spark, path).groupBy(F.col("block").alias("of")).agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    before = totals.select("of", (F.sum("n").over(Window.orderBy("of")) - F.col("n")).alias("before"))
    return (rows.join(F.broadcast(before), rows["block"] == before["of"], "left")
            .select("doc_id", (F.col("before") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def encode_documents(docs: DataFrame, by: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, by=by)
    return token_index(spark, path)
