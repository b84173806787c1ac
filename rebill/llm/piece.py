"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For each prefix the table holds its unique last token: the piece ending there (found by an Aho-Corasick
automaton) that is compatible with the last token of the prefix before it. Ids are then recovered backwards.
Texts fall into chunks where a space starts, since no piece crosses from a letter into a space; what a chunk
encodes to and decodes to is kept in a bounded table. Null and empty texts have no ids and decode to the empty
text. Every row is returned, repeated ones too; columns but doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebill.llm.common import read, sliced

MODEL = "piece_bpe_32k.model"
KEEP = 300_000  # chunks, and pairs of pieces, kept by a worker; longer chunks than LONG are not kept
LONG = 64
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PrefixTable:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {sp.id_to_piece(i): i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.raw = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.auto = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str] | None] = {}  # what the last merge of a piece joins; None for a letter
        for p in self.ids:
            # Pieces that merging never makes are no last tokens.
            if len(p) == 1:
                self.halves[p] = None
                self.auto.add_word(p, p)
            elif halves := self._halves(p):
                self.halves[p] = halves
                self.auto.add_word(p, p)
        self.auto.make_automaton()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces cross from letters into spaces")
        self.kept: dict[str, tuple[int, str, bytes]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _halves(self, s: str) -> tuple[str, str] | None:
        """The last two parts that plain merging of a piece joins; None where it doesn't make the piece."""
        parts, score = list(s), self.score
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b leaves a and b: their merges are undone, latest first, and none may cross before."""
        score, halves = self.score, self.halves
        after, equal = -float("inf"), False  # merges across count if they score over ``after``, or as much if ``equal``
        x, y = score.get(a, 0.0), score.get(b, 0.0)
        while True:
            v = score.get(a + b)
            if v is not None and (v > after or equal and v == after):
                return False
            p, q = halves.get(a), halves.get(b)
            if p is None and q is None:
                return True
            # Of equal merges the left one is made first, so the right one is undone first.
            if q is None or p is not None and x < y:
                after, equal, a = x, False, p[1]
                x = score.get(a, 0.0)
            else:
                after, equal, b = y, True, q[0]
                y = score.get(b, 0.0)

    def chunk(self, s: str) -> list[int]:
        n, pairs = len(s), self.pairs
        last: list[str | None] = [None] * n
        todo = -1
        for end, piece in self.auto.iter(s):
            while todo < end - 1:  # letters that no piece ends at stand alone
                todo += 1
                if last[todo] is None:
                    last[todo] = s[todo]
            if last[end] is None:
                start = end - len(piece)
                if start < 0:
                    last[end] = piece
                    continue
                fits = pairs.get(pair := (last[start], piece))
                if fits is None:
                    if len(pairs) >= KEEP:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(*pair)
                if fits:
                    last[end] = piece
        out: list[int] = []
        at = n - 1
        while at >= 0:
            p = last[at] or s[at]
            i = self.ids.get(p)
            out.extend([i] if i is not None else [self.bytes[b] for b in reversed(p.encode("utf-8", "surrogatepass"))])
            at -= len(p)
        out.reverse()
        return out

    def coded(self, c: str) -> tuple[int, str, bytes]:
        """How many ids a chunk has, the ids joined by commas and what they decode to."""
        ids = self.chunk(c)
        out = len(ids), ",".join(map(str, ids)), b"".join([self.raw[i] for i in ids])
        if len(c) <= LONG:
            if len(self.kept) >= KEEP:
                self.kept.clear()
            self.kept[c] = out
        return out

    def parts(self, text: str | None) -> list[tuple[int, str, bytes]]:
        if not text:
            return []
        get, coded = self.kept.get, self.coded
        return [get(c) or coded(c) for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split(",")]

    def decode(self, parts: list[tuple[int, str, bytes]]) -> bytes:
        """UTF-8 of the text that the ids of ``parts`` decode to: the space put before the text is taken away."""
        return b"".join([p[2] for p in parts])[1:]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@lru_cache(1)
def table(path: str) -> PrefixTable:
    return PrefixTable(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text)."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in sliced(batches):
            rows = []
            for text in b["text"].to_pylist():
                parts = t.parts(text)
                ids = ",".join([p[1] for p in parts])
                rows.append((sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(t.decode(parts)).hexdigest()))
            n, ids, decoded = zip(*rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        t.kept.clear()  # workers live on; what was kept goes with the task
        t.pairs.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
