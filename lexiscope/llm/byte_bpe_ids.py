"""Byte-level BPE encoding and decoding through a sentencepiece model made from the rank file.

The vocabulary is written as a sentencepiece BPE model without any training: the bytes of a token become characters
(byte b is U+0100 + b, so that none is white space), its score is its negative rank, and normalisation is the
identity.  Merging the best-scored pair first is then merging the lowest rank first, and a piece's id is its rank.
Texts are cut into pre-tokens by the pattern, and each pre-token is encoded by itself; decoding maps ids back to
pieces and their characters back to bytes.  Documents are independent of each other: nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.runtime import by_value

by_value(__name__)

#: Characters outside these ranges may be classed by another Unicode version in the tiktoken library.
UNSURE = r"[^\u0000-\u052f\u2000-\u206f\u20a0-\ua7cd]"
#: Pre-tokens kept in a task's table, and characters of the longest one kept.
MOST_KEPT, LONGEST_KEPT = 300_000, 64


def to_characters(token: bytes) -> str:
    """One character for each byte."""
    return "".join(chr(0x100 + b) for b in token)


def to_bytes(piece: str) -> bytes:
    """The inverse of ``to_characters``."""
    return bytes(ord(c) - 0x100 for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of this vocabulary, in which ids are ranks; ranks that no token has are unused pieces,
    and the unknown piece that every model must have stands behind them all."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, by_rank = pb.ModelProto(), {rank: token for token, rank in ranks.items()}
    if len(by_rank) != len(ranks) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("two tokens share a rank, or a byte has no token")
    for rank in range(max(by_rank) + 1):
        token = by_rank.get(rank)
        kind = pb.ModelProto.SentencePiece.UNUSED if token is None else pb.ModelProto.SentencePiece.NORMAL
        model.pieces.add(piece=f"<unused {rank}>" if token is None else to_characters(token), score=-float(rank), type=kind)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Cutter:
    """Cuts texts into the matches of a pattern as the tiktoken library does.

    Unsure characters are first replaced by one of the same class (letter, number or neither), as the library itself
    classes them; the matches are then taken from the text at the same places.
    """

    def __init__(self, pattern: str):
        import tiktoken

        alphabet = {bytes([b]): b for b in range(256)}
        self.classes = [(stand_in, tiktoken.Encoding(name, pat_str=name, mergeable_ranks=alphabet, special_tokens={})) for name, stand_in in ((r"\p{L}", "\u00e9"), (r"\p{N}", "1"), (r"\s", "\u3000"))]
        self.cut, self.unsure, self.known = regex.compile(pattern), regex.compile(UNSURE), {}

    def stand_in(self, match) -> str:
        character = match[0]
        if character not in self.known:
            self.known[character] = next((s for s, library in self.classes if library.encode_ordinary(character)), "!")
        return self.known[character]

    def __call__(self, text: str) -> list[str]:
        if not self.unsure.search(text):
            return self.cut.findall(text)
        return [text[m.start() : m.end()] for m in self.cut.finditer(self.unsure.sub(self.stand_in, text))]


class RankCodec:
    """Encodes texts and decodes ids with a model of ``sentencepiece_model``."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.pieces.unk_id()
        self.cut = Cutter(pattern)
        self.table: dict[str, tuple[int, str, bytes]] = {}

    def encode(self, pretokens: list[str]) -> list[list[int]]:
        """The ids of each pre-token: the token's own if it is one, else what the merges leave."""
        texts = [to_characters(p.encode("utf-8")) for p in pretokens]
        own = [self.pieces.piece_to_id(t) for t in texts]
        merged = iter(self.pieces.encode([t for t, i in zip(texts, own, strict=True) if i == self.unknown], num_threads=1))
        return [next(merged) if i == self.unknown else [i] for i in own]

    def decode(self, ids: list[int]) -> bytes:
        return to_bytes("".join(map(self.pieces.id_to_piece, ids)))

    def apply(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal joined by one space, and the bytes that they decode to."""
        if not text:
            return 0, "", b""
        cut, table = self.cut(text), self.table
        new = [p for p in dict.fromkeys(cut) if p not in table]
        for pretoken, ids in zip(new, self.encode(new), strict=True):
            table[pretoken] = len(ids), " ".join(map(str, ids)), self.decode(ids)
        found = [table[p] for p in cut]
        for pretoken in new:
            if len(pretoken) > LONGEST_KEPT:
                del table[pretoken]
        if len(table) > MOST_KEPT:
            table.clear()
        return sum(x[0] for x in found), " ".join([x[1] for x in found]), b"".join([x[2] for x in found])


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """For every row of ``docs``: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, or with ``digests=False`` the ids
    and bytes themselves, ``(doc_id, n_tokens, ids array<int>, decoded binary)``.

    ``ranks_path`` is a rank file that the driver can read; the model made from it (of fixed size) is broadcast.  Null
    and empty texts have no ids and decode to nothing; special strings are ordinary text; repeated rows come out
    repeated; an empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks_path)))

    def run(batches):
        codec = RankCodec(model.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids, decoded = [], [], []
                for text in part.column(1).to_pylist():
                    k, a, b = codec.apply(text)
                    n.append(k)
                    ids.append(hashlib.sha256(a.encode()).hexdigest() if digests else [int(x) for x in a.split()])
                    decoded.append(hashlib.sha256(b).hexdigest() if digests else b)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, kinds[0]), pa.array(decoded, kinds[1])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"],
                )

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, n_tokens long, ids array<int>, decoded binary"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, out)
