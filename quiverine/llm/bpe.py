"""Byte-level BPE encoding and decoding in linear time.

A vocabulary of ranks gives each token's last merge. Bytes are mapped to
Latin-1 characters, and the tokens make a pyahocorasick trie. At each position
that the encoder comes to, one walk down the trie bounds the longest token
there; links of failure are of no use, since the next position is the end of a
token that stays. The encoder takes the longest match, tests it against the token before it, tries the next shorter
token where the pair can't stand side by side, and steps back where none is
left; a position that failed is not tried again, so the work is linear. Whether
two tokens can stand side by side in the result of the merges is decided from
their last merges and memoised. The result is that of applying the merges by
rank.

Defined results: null text counts as empty; an empty text has no ids and the
digests of the empty string. Ids that decode to cut characters decode to their
bytes. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverine.llm.common import arrow_map, read
from quiverine.llm.pieces import Memo, parts

#: Parts of a text that are joined at once: what a very long text holds in memory.
SLICE = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encodes and decodes pieces of bytes by a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.side_by_side: dict[tuple[int, int], bool] = {}
        self.by_text: dict[str, int] = {}
        automaton = ahocorasick.Automaton()
        # In order of rank, so that the merges of what a token consists of are known before its own.
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            made = self._last_merge(token, rank)
            if made is None:
                continue  # no row of merges gives it; only a whole piece can be it
            self.split[rank] = made
            if len(token) > 1:
                self.pairs[made] = rank
            self.by_text[token.decode("latin-1")] = rank
            automaton.add_word(token.decode("latin-1"), rank)
        self.trie = automaton
        self.deepest = max(map(len, self.by_text))
        self.lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self.shorter: dict[int, int | None] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one; itself twice for a byte."""
        if len(token) == 1:
            return rank, rank
        row = [self.ranks[token[k : k + 1]] for k in range(len(token))]
        while len(row) > 2:
            best, at = rank, -1
            for k in range(len(row) - 1):
                made = self.pairs.get((row[k], row[k + 1]), rank)
                if made < best:
                    best, at = made, k
            if at < 0:
                return None
            row[at : at + 2] = [best]
        return row[0], row[1]

    def _next_shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if rank not in self.shorter:
            token, found = self.tokens[rank], None
            for end in range(len(token) - 1, 0, -1):
                prefix = self.ranks.get(token[:end])
                if prefix is not None and prefix in self.split:
                    found = prefix
                    break
            self.shorter[rank] = found
        return self.shorter[rank]

    def _can_stand(self, pair: tuple[int, int]) -> bool:
        """Whether the merges leave these two neighbours as they are.

        Undoes the later of the two last merges at the border, again and
        again: the pair falls if some merge across the border comes before the
        merge that hides it.
        """
        left, right = pair
        hidden_at = 1 << 62
        result = True
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across < hidden_at:
                result = False
                break
            if left > right:
                hidden_at, inner = left, self.split[left][1]
                if inner != left:
                    left = inner
                    continue
                hidden_at, inner = right + 1, self.split[right][0]
                if inner == right:
                    break
                right = inner
            else:
                hidden_at, inner = right + 1, self.split[right][0]
                if inner != right:
                    right = inner
                    continue
                hidden_at, inner = left, self.split[left][1]
                if inner == left:
                    break
                left = inner
        if len(self.side_by_side) >= 1_000_000:
            self.side_by_side.clear()
        self.side_by_side[pair] = result
        return result

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, as its merges by rank give them."""
        text = piece.decode("latin-1")
        whole = self.by_text.get(text)
        if whole is None:
            whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, deepest, lengths, side_by_side, shorter = len(text), self.deepest, self.lengths, self.side_by_side, self.shorter
        by_text, longest_prefix = self.by_text.get, self.trie.longest_prefix
        failed: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, -1
        while at < size:
            if token == -1:  # a new position
                end = at + longest_prefix(text[at : at + deepest])
                while (token := by_text(text[at:end])) is None:
                    end -= 1
            while token is not None:
                end = at + lengths[token]
                if end not in failed:
                    if last >= 0:
                        can = side_by_side.get((last, token))
                        if can is None:
                            can = self._can_stand((last, token))
                    else:
                        can = True
                    if can:
                        out.append(token)
                        at, last, token = end, token, -1
                        break
                token = shorter[token] if token in shorter else self._next_shorter(token)
            else:
                failed.add(at)  # nothing fits here: step back
                if not out:
                    raise ValueError("a piece has no encoding")
                back = out.pop()
                at -= lengths[back]
                token = self._next_shorter(back)
                last = out[-1] if out else -1
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextBpe:
    """Whole texts: the pattern's matches are encoded one by one, and kept by part of the text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.bpe = ByteBpe(ranks)
        self.matches = regex.compile(pattern).findall
        self.piece = Memo(lambda piece: self.bpe.encode_piece(piece.encode("utf-8")), most=250_000)
        self.first = Memo(self._encode, most=50_000)
        self.rest = Memo(lambda part: self._encode(" " + part), most=400_000)

    def _encode(self, part: str) -> tuple[int, ...]:
        word = part[1:] if part[:1] == " " else part
        if word.isalpha():  # letters alone are one match
            return tuple(self.piece[part])
        return tuple(i for piece in self.matches(part) for i in self.piece[piece])

    def encode(self, text: str) -> Iterable[list[int]]:
        """The ids of a whole text, in slices."""
        cut = parts(text)
        yield list(self.first[cut[0]])
        for at in range(1, len(cut), SLICE):
            yield [i for ids in map(self.rest.__getitem__, cut[at : at + SLICE]) for i in ids]


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``.

    The rank table is broadcast; a vocabulary is bounded (here 50,256 tokens).
    """
    if len(ranks) > 2_000_000:
        raise ValueError("a vocabulary of over two million tokens isn't broadcast")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    kept: dict = {}

    def digest(text: str) -> tuple[int, str, str]:
        names, decode = kept["names"], kept["bpe"].bpe.decode
        ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        for ids in kept["bpe"].encode(text):
            if ids:
                ids_hash.update((("," if n else "") + ",".join(map(names.__getitem__, ids))).encode())
                text_hash.update(decode(ids))
                n += len(ids)
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept["bpe"] = TextBpe(shared.value, pattern)
            kept["names"] = {rank: str(rank) for rank in shared.value.values()}
        rows = [digest(t or "") for t in batch.column(1).to_pylist()]
        n, ids, text = ([r[k] for r in rows] for k in range(3))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's vocabulary over every whole text of ``documents``."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_and_decode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
