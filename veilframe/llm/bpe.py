"""Byte-level BPE over Arrow batches: encoding by published ranks, offsets, and decoding.

The ranks are turned into the vocabulary and merges of a byte-level tokenizer: each byte is a printable character, and a rank's
merge is the pair that its bytes come down to under the lower ranks. Texts are split by the pattern in Python, whose regex engine
gives the matches that the ranks' own encoder gives, and each distinct match goes through the tokenizers library once a worker; offsets
follow from the bytes of the ids. Defined results: a null text is empty; an empty text has no ids; special tokens in a text are ordinary text; repeated and equal rows get
equal ids; very long texts are encoded whole; an empty table gives no rows; further columns stay, but for those that the result's
names replace.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .textkit import chunks


#: Matches whose ids a worker keeps.
CACHE = 150_000
#: Matches given to the tokenizer in one call.
TOGETHER = 1000


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair behind every token of more than one byte, by rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                low = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank) if ranks.get(parts[i] + parts[i + 1], rank) < rank else 1 << 40)
                parts[low : low + 2] = [parts[low] + parts[low + 1]]
            out.append((parts[0], parts[1]))
    return out


def build_tokenizer(data: bytes, pattern: str | None):
    """A tokenizers.Tokenizer whose ids are the ranks; every match of the pattern is merged by itself (None: texts are single matches)."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(data)
    char = byte_characters()
    name = lambda b: "".join(char[x] for x in b)
    model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=[(name(a), name(b)) for a, b in merges_of(ranks)], cache_capacity=0)
    tok = Tokenizer(model)
    bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.pre_tokenizer = bytewise if pattern is None else pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), bytewise])
    return tok


class _Tools:
    """What a worker process builds once: the tokenizer, the bytes of every id, and the matches met so far.

    The ids of all matches lie one behind the other in `flat`; `at` has a match's number, `first` where it begins there.
    """

    def __init__(self, ranks: bytes, pattern: str):
        self.tok = build_tokenizer(ranks, None)
        self.find = regex.compile(pattern).findall
        by_rank = {r: t for t, r in read_ranks(ranks).items()}
        self.token = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
        self.width = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.name = [str(i) for i in range(len(self.token))]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1, np.int64)
        self.uses = np.zeros(1, np.int64)

    def thin(self, kept: int) -> None:
        """Forget all but the matches met most often; what they were met counts half from here on."""
        n = len(self.at)
        if n <= kept:
            return
        stay = np.sort(np.argpartition(-self.uses[:n], kept)[:kept])
        size = self.first[stay + 1] - self.first[stay]
        behind = np.concatenate([[0], np.cumsum(size)])
        names = list(self.at)
        self.at = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.flat = self.flat[np.arange(behind[-1]) + np.repeat(self.first[stay] - behind[:-1], size)]
        self.first, self.uses = behind, self.uses[stay] >> 1

    def met(self, number: np.ndarray) -> None:
        n = len(self.at)
        self.uses = np.bincount(number, minlength=n) + np.pad(self.uses[:n], (0, max(0, n - len(self.uses))))

    def learn(self, new: list[str]) -> None:
        """Each match is merged by itself; as an id's bytes are known, the ids of many come back in one piece and are parted by bytes."""
        for i in range(0, len(new), TOGETHER):
            part = new[i : i + TOGETHER]
            ids = np.array(self.tok.encode(part, is_pretokenized=True, add_special_tokens=False).ids, np.int32)
            stops = np.cumsum([len(p.encode()) for p in part])
            begin = int(self.first[len(self.at)])
            total = begin + len(ids)
            n = len(self.at)
            if total > len(self.flat):
                self.flat = np.pad(self.flat, (0, total))
            if n + len(part) >= len(self.first):
                self.first = np.pad(self.first, (0, n + len(part)))
            self.flat[begin:total] = ids
            self.first[n + 1 : n + 1 + len(part)] = begin + 1 + np.searchsorted(np.cumsum(self.width[ids]), stops)
            self.at.update(zip(part, range(n, n + len(part))))


class Encoded(NamedTuple):
    """A text's ids and the code-point offsets of each: [start, end), where tokens that share a character's bytes share its place."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    said: str  # the ids in decimal, with spaces


class ByteBpe:
    """Ranks and pattern, sent to the workers as bytes; each worker process builds its tools once."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.key = hashlib.sha256(ranks + pattern.encode()).hexdigest()

    @property
    def tools(self) -> _Tools:
        if self.key not in _BUILT:
            _BUILT[self.key] = _Tools(self.ranks, self.pattern)
        return _BUILT[self.key]

    def encode_all(self, texts: list[str | None]) -> Iterator[Encoded]:
        """Each text encoded. Matches of the pattern repeat, so the tokenizer is given each new match once: its answers are kept for
        CACHE matches, then for the half of them met most often."""
        t = self.tools
        for _, held in chunks(texts, 1 << 19):
            split = [t.find(x) for x in held]
            new = list({p for pieces in split for p in pieces if p not in t.at})
            if len(t.at) + len(new) > CACHE:
                t.thin(CACHE // 2)
                new = list({p for pieces in split for p in pieces if p not in t.at})
            t.learn(new)
            number = np.fromiter(map(t.at.__getitem__, chain.from_iterable(split)), np.int64)
            t.met(number)
            many = t.first[number + 1] - t.first[number]
            behind = np.concatenate([[0], np.cumsum(many)])
            ids = t.flat[np.arange(behind[-1]) + np.repeat(t.first[number] - behind[:-1], many)]
            data = [x.encode() for x in held]
            stop = np.cumsum(t.width[ids])
            last = behind[np.cumsum([0, *map(len, split)])]
            if not np.array_equal(np.concatenate([[0], stop])[last], np.cumsum([0, *map(len, data)])):
                raise ValueError("the pattern leaves parts of a text unmatched")
            starts, ends = _characters(b"".join(data), stop - t.width[ids], stop)
            base = 0
            for text, i, j in zip(held, last[:-1].tolist(), last[1:].tolist()):
                own = ids[i:j]
                yield Encoded(own, starts[i:j] - base, ends[i:j] - base, " ".join(map(t.name.__getitem__, own.tolist())))
                base += len(text)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [e.ids.tolist() for e in self.encode_all(texts)]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of the ids, joined. Only then is there text again, so a character split between tokens is whole."""
        return b"".join(map(self.tools.token.__getitem__, ids))

    def decode_text(self, ids: Sequence[int]) -> str:
        return self.decode(ids).decode("utf-8", "replace")


def _characters(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of byte ranges of UTF-8: that of the first byte, and the one behind that of the last."""
    if data.isascii():
        return starts, stops
    of_byte = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return of_byte[starts], of_byte[stops - 1] + 1


_BUILT: dict[str, tuple] = {}


@lru_cache(maxsize=4)
def load_bpe(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as f:
        return ByteBpe(f.read(), pattern)


def _quiet() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def encode_documents(spark: SparkSession, docs: DataFrame, bpe: ByteBpe, *, text: str = "text") -> DataFrame:
    """All columns of docs, and ids: array<int>, offsets: array<struct<start,end>> in code points; own columns of these names give way."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(bpe)

    @F.pandas_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        _quiet()
        for s in batches:
            got = list(sent.value.encode_all(s.tolist()))
            yield pd.DataFrame({"ids": [e.ids for e in got], "starts": [e.starts for e in got], "ends": [e.ends for e in got]})

    rows = docs.withColumn("__bpe", encoded.asNondeterministic()(F.col(text)))
    offsets = F.arrays_zip(F.col("__bpe.starts").alias("start"), F.col("__bpe.ends").alias("end"))
    return rows.withColumn("ids", F.col("__bpe.ids")).withColumn("offsets", offsets.cast("array<struct<start:int,end:int>>")).drop("__bpe")


def decode_documents(spark: SparkSession, encoded: DataFrame, bpe: ByteBpe) -> DataFrame:
    """All columns of encoded and decoded: binary, in place of any column of that name."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(bpe)

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([sent.value.decode(list(x)) for x in s], dtype=object)

    return encoded.withColumn("decoded", decoded(F.col("ids")))


def token_digests(spark: SparkSession, docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256, spanned): encode, decode and digest in one pass, so that ids
    never travel.

    offsets_sha256 is of all starts, then all ends, as little-endian 32-bit numbers; spanned tells that the offsets begin at 0, end at
    the text's length, and leave nothing out between tokens.
    """
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _quiet()
        own = sent.value
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            rows = []
            texts = b["text"].tolist()
            for text, e in zip(texts, own.encode_all(texts)):
                rows.append((len(e.ids), sha(e.said.encode()), sha(own.decode(e.ids.tolist())), sha(np.stack([e.starts, e.ends]).astype("<i4").tobytes()), spans(e, len(text) if isinstance(text, str) else 0)))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "spanned"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, spanned boolean")


def spans(e: Encoded, size: int) -> bool:
    """Whether a text's offsets begin at 0, end at its length, and leave no code point out."""
    if not len(e.ids):
        return size == 0
    return bool(e.starts[0] == 0 and e.ends[-1] == size and (e.starts[1:] <= e.ends[:-1]).all() and (e.ends[1:] >= e.ends[:-1]).all())
