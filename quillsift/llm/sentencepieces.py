"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

Adjacent symbols are merged from an agenda ordered by piece score, then by place. A text is first cut where no piece
of the vocabulary can span: the kinds of neighbouring characters are compared with every piece when the model is
loaded, and a vocabulary with a piece across such a cut is encoded without cutting. Chunks repeat, so a task keeps
those it has met. In each Arrow batch some whole texts are compared with the sentencepiece library, ids and decoded
text both; a difference raises.

Null text counts as empty. Empty text gives the begin and end ids alone and decodes to "". Repeated rows and ties give
one result row each; other columns are not read, so their names can't clash. A very long text is one row; its cut parts are merged one by one, in time
n log n of the longest, and its ids are held once. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import sliced, small_batches, table

SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
MODEL = "piece_bpe_32k.model"
#: Chunks and words that a task keeps at most, and the longest that it keeps: about 100 MB.
KEPT_CHUNKS, KEPT_WORDS, KEPT_LENGTH = 200_000, 80_000, 48
#: Of so many texts in a slice of an Arrow batch, one is compared with the library, the slice's first one among them.
COMPARE_EVERY = 200


class Agenda:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.piece.items()}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.value = {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        letter = re.compile(f"[{LETTERS}]")
        kind = lambda c: 0 if c == SPACE else 1 if letter.match(c) else 2
        self.whole = whole = any(kind(a) != kind(b) and a != SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.chunks = re.compile("(?s).+" if whole else f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{SPACE}{LETTERS}]+|{SPACE}+").findall
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, s: str) -> list[int]:
        """Ids of a chunk: pop the best pair, merge it, offer the pairs with the new neighbours.

        An entry of the agenda is one integer: rank, place and joint width, each in its own bits.
        """
        n, rank = len(s), self.rank.get
        bits = n.bit_length()
        mask, up = (1 << bits) - 1, 2 * bits
        size, before = [1] * n, list(range(-1, n))
        agenda = [r << up | i << bits | 2 for i in range(n - 1) if (r := rank(s[i : i + 2])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            entry = pop(agenda)
            i, width = entry >> bits & mask, entry & mask
            left = size[i]
            j = i + left
            if not left or j >= n or left + size[j] != width:
                continue  # one of the two was merged elsewhere meanwhile
            size[i], size[j] = width, 0
            j = i + width
            if i and (r := rank(s[(p := before[i]) : j])) is not None:
                push(agenda, r << up | p << bits | j - p)
            if j < n:
                before[j] = i
                if (r := rank(s[i : (k := j + size[j])])) is not None:
                    push(agenda, r << up | i << bits | k - i)
        out, i = [], 0
        while i < n:
            j = i + size[i]
            if (found := self.ids.get(s[i:j])) is not None:
                out.append(found)
            else:
                out += [self.byte[b] for b in s[i:j].encode()]
            i = j
        return out

    def surface(self, ids: list[int]) -> bytes:
        """What ids stand for, in UTF-8, with the dummy space before the text still there."""
        return b"".join(self.value[i] if i in self.value else self.piece[i].replace(SPACE, " ").encode() for i in ids)

    def chunk(self, s: str) -> tuple[bytes, bytes]:
        ids = self.merge(s)
        found = struct.pack(f"<{len(ids)}I", *ids), self.surface(ids)
        if len(self.known) < KEPT_CHUNKS and len(s) <= KEPT_LENGTH:
            self.known[s] = found
        return found

    def spaced(self, s: str) -> tuple[bytes, bytes]:
        """A word and the space before it; or any text, spaces as SPACE."""
        known, chunk = self.known.get, self.chunk
        found = [known(c) or chunk(c) for c in self.chunks(s)]
        found = found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), b"".join([f[1] for f in found]))
        if len(self.words) < KEPT_WORDS and len(s) <= KEPT_LENGTH:
            self.words[s[1:]] = found
        return found

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers with begin and end ids, and the decoded text in UTF-8."""
        if not text:
            found = []
        elif self.whole or "  " in text or text[0] == " " or text[-1] == " ":
            found = [self.spaced(SPACE + text.replace(" ", SPACE))]
        else:
            known, spaced = self.words.get, self.spaced
            found = [known(w) or spaced(SPACE + w) for w in text.split(" ")]
        ids = b"".join([struct.pack("<I", self.begin), *[f[0] for f in found], struct.pack("<I", self.end)])
        return ids, b"".join([f[1] for f in found])[1:]

    def forget(self) -> None:
        """Drop the chunks of a task, so that a worker is small when other work comes."""
        self.known.clear()
        self.words.clear()

    def compare(self, text: str, ids: bytes, decoded: bytes) -> None:
        theirs = self.library.encode(text, add_bos=True, add_eos=True)
        if struct.pack(f"<{len(theirs)}I", *theirs) != ids or self.library.decode(theirs).encode() != decoded:
            raise ValueError(f"the agenda and the sentencepiece library differ on a text of {len(text)} characters")


_loaded: dict[str, Agenda] = {}


def agenda(path: str) -> Agenda:
    """The worker's encoder of this model."""
    if path not in _loaded:
        _loaded[path] = Agenda(path)
    return _loaded[path]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; extra may name token_ids and decoded_text.

    The library's own files must be at `path` on every executor, as the installed tokenizers are.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    more = {"token_ids": "array<int>", "decoded_text": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = agenda(path)
        for batch in sliced(batches):
            ids, decoded = [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                found = own.encode(text)
                if k % COMPARE_EVERY == 0:
                    own.compare(text, *found)
                ids.append(found[0])
                decoded.append(found[1])
            lengths = np.array([len(x) // 4 for x in ids])
            columns = [pa.array(lengths, pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in c]) for c in (ids, decoded))]
            if "token_ids" in extra:
                ends = pa.array(np.concatenate([[0], lengths.cumsum()]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            if "decoded_text" in extra:
                columns.append(pa.array([d.decode() for d in decoded]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(n for n in more if n in extra)])
        own.forget()

    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = "".join(f", {n} {t}" for n, t in more.items() if n in extra)
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{schema}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), model_path())
