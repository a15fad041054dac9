"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece holds a white-space marker after another character, no merge crosses into the next marked
word; when no piece holds a line feed, none crosses that either.  A text then falls into chunks (markers
with the word behind them, or a line feed with what follows it) that are segmented independently.  Each task
segments each distinct chunk once and joins ids and decoded text back by position.  Models whose pieces do
cross markers, other normalisers and other model types are encoded whole by the library.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.runtime import by_value

by_value(__name__)

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
#: Chunks kept in a task's table, and characters of the longest one kept.
MOST_KEPT, LONGEST_KEPT = 400_000, 64


class ChunkCodec:
    """Encodes and decodes as the sentencepiece library does, without begin or end ids and without sampling."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        normal = [p.piece for p in proto.pieces if p.type == 1]
        self.plain = (
            train.model_type == 2
            and train.byte_fallback
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
            and not norm.precompiled_charsmap
            and not train.treat_whitespace_as_suffix
            and not any(p.type in (4, 5) for p in proto.pieces)
            and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in normal)
        )
        self.mark_id = self.whole.piece_to_id(MARK)
        self.table: dict[str, tuple[int, str, str]] = {}

    def segment(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal, and the decoded text of one chunk."""
        if chunk == MARK:
            ids, text = [self.mark_id], " "
        elif chunk[0] == MARK:
            ids = self.whole.encode(chunk[1:])  # the library puts the first marker back
            text = " " + self.whole.decode(ids)
        else:
            ids = self.whole.encode(chunk)[1:]  # without the marker that stands before the line feed
            text = self.whole.decode(ids)
        return len(ids), ",".join(map(str, ids)), text

    def apply(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, and decoded text of a whole text."""
        if not text:
            return 0, "", ""
        if not self.plain:
            ids = self.whole.encode(text)
            return len(ids), ",".join(map(str, ids)), self.whole.decode(ids)
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        table = self.table
        n, ids, texts = 0, [], []
        for chunk in chunks:
            got = table.get(chunk)
            if got is None:
                got = self.segment(chunk)
                if len(chunk) <= LONGEST_KEPT:
                    table[chunk] = got
            n += got[0]
            ids.append(got[1])
            texts.append(got[2])
        if len(table) > MOST_KEPT:
            table.clear()
        return n, ",".join(ids), "".join(texts)[1:]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """For every row of ``docs``: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, or with
    ``digests=False`` the ids and texts themselves, ``(doc_id, n_tokens, ids array<int>, decoded string)``.

    ``model_path`` is a model file that the driver can read; its content (a file of fixed size) is broadcast.
    Null and empty texts have no ids and decode to the empty text; repeated rows come out repeated; an empty
    table gives no rows.  Other columns are not read.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = ChunkCodec(model.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids, texts = [], [], []
                for text in part.column(1).to_pylist():
                    k, a, b = codec.apply(text)
                    n.append(k)
                    ids.append(sha(a) if digests else [int(x) for x in a.split(",") if x])
                    texts.append(sha(b) if digests else b)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, kinds[0]), pa.array(texts, kinds[1])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"],
                )

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, n_tokens long, ids array<int>, decoded string"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, out)
