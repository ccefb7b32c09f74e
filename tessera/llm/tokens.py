"""Token counts: pieces counted once per distinct pre-token, times the pre-tokens' frequencies per document."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The byte-level pre-token pattern, with Unicode White_Space written out, and the vocabulary's one
#: special string.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
SPECIAL = "<|endoftext|>"
LIMIT = 1024
#: Texts are gathered to blocks of about so many bytes, of at most 65535 documents.
BLOCK_BYTES = 12 << 20
#: Texts whose pre-tokens a bucket holds.
BUCKET_BYTES = 128 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


_ROWS = "at int, block long, kind int, a binary, b binary, c binary, d binary, e binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _ROWS.split(", ")])


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), as the
    byte-level BPE of the tokenizer file at path gives them.

    A block of documents sends its distinct pre-tokens, each with the documents that hold it and how often, to the
    pre-token's bucket. A bucket counts the pieces of each of its distinct pre-tokens once for the whole corpus and
    sends a partial sum per document back to the block. No ids are kept. A very frequent pre-token costs its bucket
    one entry per block and document, packed to three bytes.

    Null and empty texts have 0 bytes and 0 tokens; a special string in a text is one token, as is the library's
    default; repeated rows and null doc_ids stay as they are. The order of rows within input partitions must not
    change when a task runs again (a table that is read from files)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    _, buckets = C.fan_out(spark, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BLOCK_BYTES, BUCKET_BYTES)

    def block_rows(block: int, ids: list, sizes: list, special: list, token_ids: list, index: dict):
        """The block's header and its pre-tokens by bucket."""
        table = pa.table({"doc_id": pa.concat_arrays(ids), "n_bytes": np.concatenate(sizes), "special": np.array(special)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        rows = [(block % buckets, block, 0, sink.getvalue().to_pybytes(), None, None, None, None)]
        words = [w.encode() for w in index]
        if words:
            key = np.concatenate([(x.astype(np.uint64) << np.uint64(32)) | np.uint64(d) for d, x in enumerate(token_ids) if len(x)])
            key, often = np.unique(key, return_counts=True)
            word, doc = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint16)
            bucket = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(bucket[word], kind="stable")  # still by pre-token within a bucket
            word, doc, often = word[order], doc[order], often[order]
            edges = np.searchsorted(bucket[word], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                i, j = edges[b], edges[b + 1]
                mine, n_docs = np.unique(word[i:j], return_counts=True)
                names = [words[w] for w in mine.tolist()]
                times = often[i:j].astype("<u4")
                big = np.flatnonzero(times > 255)
                extra = np.stack([big, times[big]], 1).astype("<u4") if len(big) else np.zeros((0, 2), "<u4")
                rows.append((int(b), block, 1, b"".join(names), np.fromiter(map(len, names), "<u4", len(names)).tobytes() + n_docs.astype("<u4").tobytes(), doc[i:j].astype("<u2").tobytes(), np.minimum(times, 255).astype(np.uint8).tobytes(), extra.tobytes()))
        return _rows(rows)

    def split(batches):
        find = regex.compile(PRE_TOKEN).findall
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, sizes, special, token_ids, held, count = [], [], [], [], 0, 0
        index: dict = defaultdict()
        index.default_factory = index.__len__
        for batch in batches:
            _, at = C.utf8(batch.column("text"))
            size = np.diff(at)
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                parts = text.split(SPECIAL)
                special.append(len(parts) - 1)
                token_ids.append(np.fromiter((index[w] for part in parts for w in find(part)), np.uint32))
                ids.append(doc_ids[i : i + 1])
                sizes.append(size[i : i + 1])
                held, count = held + int(size[i]), count + 1
                if held >= BLOCK_BYTES or count == 65535:
                    yield block_rows(base + n, ids, sizes, special, token_ids, index)
                    n += 1
                    ids, sizes, special, token_ids, held, count = [], [], [], [], 0, 0
                    index.clear()
        if count:
            yield block_rows(base + n, ids, sizes, special, token_ids, index)

    def weigh(batches):
        """For whole buckets: headers pass; pre-tokens become partial sums per document of their block."""
        counts: dict[bytes, int] = {}
        tok = tokenizer(path)
        for batch in batches:
            for at, block, kind, a, b, c, d, e in zip(*(x.to_pylist() for x in batch.columns)):
                if kind == 0:
                    yield _rows([(at, block, 0, a, None, None, None, None)])
                    continue
                shape = np.frombuffer(b, "<u4").reshape(2, -1).astype(np.int64)
                ends = np.cumsum(shape[0]).tolist()
                words = [a[i:j] for i, j in zip([0, *ends], ends)]
                new = [w for w in words if w not in counts]
                for i in range(0, len(new), 4096):
                    part = new[i : i + 4096]
                    for w, x in zip(part, tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                        counts[w] = len(x)
                pieces = np.fromiter((counts[w] for w in words), np.int64, len(words))
                times = np.frombuffer(d, np.uint8).astype(np.int64)
                extra = np.frombuffer(e, "<u4").reshape(-1, 2)
                times[extra[:, 0]] = extra[:, 1]
                sums = np.bincount(np.frombuffer(c, "<u2"), weights=np.repeat(pieces, shape[1]) * times).astype("<u4")
                doc = np.flatnonzero(sums)
                yield _rows([(0, block, 1, doc.astype("<u2").tobytes(), sums[doc].tobytes(), None, None, None)])

    def total(part: pa.Table) -> pa.Table:
        kinds = part["kind"].to_numpy()
        head = pa.ipc.open_stream(part["a"][int(np.flatnonzero(kinds == 0)[0])].as_py()).read_all()
        sums = head["special"].to_numpy().astype(np.int64).copy()
        for i in np.flatnonzero(kinds == 1).tolist():
            doc = np.frombuffer(part["a"][i].as_py(), "<u2")
            sums[doc] += np.frombuffer(part["b"][i].as_py(), "<u4")
        return pa.table({"doc_id": head["doc_id"], "n_bytes": head["n_bytes"].cast(pa.int64()), "n_tokens": sums, "over_limit": sums > limit})

    pieces = docs.select("doc_id", "text").mapInArrow(split, _ROWS).repartitionById(C.n_parts(spark), F.pmod(F.col("at"), F.lit(C.n_parts(spark))).cast("int")).mapInArrow(weigh, _ROWS)
    return pieces.groupBy("block").applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(C.table(spark, sf_dir, "documents"))
