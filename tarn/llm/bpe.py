"""Byte-level BPE: ranked merges over the distinct words of texts, and decoding by concatenation.

``encode_decode`` is the operator: each worker splits its texts by the
vocabulary's pattern, folds the ranked merges once per distinct word it meets
and keeps the word's ids as bytes; a text's ids are its words' ids in order,
and decoding concatenates the pieces.  Nothing is shuffled.

``fold_words`` is the same fold as Spark higher-order functions with the rank
map as a literal, for a table of distinct words, and ``encode_by_join`` joins
its result back to whole texts.  That needs every word of every text in a
shuffle, which does not fit the limits (see the README), hence the form above
for large tables.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import held, map_texts, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of words and ids a worker keeps, and what an entry costs beside them.
CACHE_BYTES = 64_000_000
ENTRY_BYTES = 180
LONG_WORD = 128
#: Buckets of the literal rank map: element access is by position, so a lookup scans one bucket only.
BUCKETS = 1 << 14
NEVER = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: always the pair of the least rank, leftmost first."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = NEVER, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], NEVER)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Codec(dict):
    """Word -> ids as little-endian bytes, filled on demand and bounded."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        self.ranks = read_ranks(path)
        self.pieces = {i: b for b, i in self.ranks.items()}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.odd = re.compile(_disputed())
        self.kept = 0

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        if self.kept >= CACHE_BYTES:
            self.clear()
            self.kept = 0
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        elif len(raw) <= LONG_WORD:
            ids = merge(raw, self.ranks)
        else:
            ids = self.library._encode_single_piece(raw)  # the same merges with a heap
        made = np.array(ids, dtype="<u4").tobytes()
        if len(raw) <= LONG_WORD:
            self[word] = made
            self.kept += ENTRY_BYTES + len(raw) + len(made)
        return made

    def encode(self, text: str) -> bytes:
        if self.odd.search(text):
            return np.array(self.library.encode_ordinary(text), dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _disputed() -> str:
    """A class of the characters that this Python's tables and the library's may class differently.

    Characters assigned by Unicode 3.2 are letters, numbers or white space in
    both or in neither.  Texts with later ones, or with the separators U+001C
    to U+001F, are split by the library itself.
    """
    known = unicodedata.ucd_3_2_0.category
    later = [known(chr(c)) == "Cn" or 0x1C <= c < 0x20 for c in range(0x110000)]
    edges = [c for c in range(0x110000) if later[c] != (c > 0 and later[c - 1])] + [0x110000]
    return "[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=False)) + "]"


def _codec(path: str, pattern: str) -> Codec:
    return held(f"bpe {path} {pattern}", lambda: Codec(path, pattern))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, ids: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) per row; a null text counts as empty.

    Texts are taken whole and each by itself: repeated rows give repeated rows.
    ``ids="array"`` adds the ids as integers, ``ids="packed"`` as little-endian
    unsigned 32-bit bytes, which take no conversion per id on the way to a file.
    """
    path, pattern = tokenizer_path(vocabulary), _pattern()

    def work(texts: list[str | None]) -> dict:
        codec = _codec(path, pattern)
        made = [codec.encode(t or "") for t in texts]
        back = [codec.decode(m) for m in made]
        out = {
            "n_tokens": [len(m) // 4 for m in made],
            "ids_sha256": [hashlib.sha256(m).hexdigest() for m in made],
            "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back],
        }
        if ids == "packed":
            out["ids"] = made
        elif ids:
            ends = np.cumsum([0, *out["n_tokens"]]).astype(np.int32)
            flat = np.frombuffer(b"".join(made), dtype="<u4").astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return out

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + {None: "", "array": ", ids array<int>", "packed": ", ids binary"}[ids]
    return map_texts(df, [key], text, schema, work)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of (key, ids), JVM-side: each id's piece by position in a literal, concatenated.  Null ids give null."""
    pieces = {i: b for b, i in read_ranks(tokenizer_path(vocabulary)).items()}
    listed = [pieces.get(i, b"").hex() for i in range(max(pieces) + 1)]
    table = F.from_json(F.lit(json.dumps(listed)), "array<string>")
    joined = F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.element_at(table, i + 1)), "")
    return df.select(F.col(f"`{key}`"), F.decode(F.unhex(joined), "UTF-8").alias("text"))


def _rank_literal(ranks: dict[bytes, int]):
    """The rank map as one literal: an array of small maps, a piece in the bucket of its checksum."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % BUCKETS][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def fold_words(words: DataFrame, word: str = "word", vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, ids) for a table of distinct words (strings), by DataFrame functions only.

    A word's bytes become an array of one-byte pieces (in hex); each fold step
    ranks all neighbours and merges the first pair of the least rank.  A null
    word has null ids, an empty one an empty array.
    """
    table = _rank_literal(read_ranks(tokenizer_path(vocabulary)))

    def rank(piece):
        at = (F.pmod(F.crc32(F.unhex(piece)), F.lit(BUCKETS)) + 1).cast("int")
        return F.coalesce(F.try_element_at(F.element_at(table, at), piece), F.lit(NEVER))

    raw = F.hex(F.encode(F.col(f"`{word}`"), "UTF-8"))
    n = (F.length(raw) / 2).cast("int")
    letters = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(raw, i * 2 - 1, F.lit(2))))

    def step(parts, _):
        k = F.size(parts)
        pairs = F.zip_with(F.slice(parts, F.lit(1), F.greatest(k - 1, F.lit(0))), F.slice(parts, F.lit(2), F.greatest(k - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        scored = F.transform(pairs, lambda p: F.struct(rank(p).alias("r"), p.alias("p")))
        # the least rank first, and of equal ranks (equal pieces) the first place
        best = F.array_min(F.transform(scored, lambda x, i: F.struct(x["r"].alias("r"), i.alias("i"), x["p"].alias("p"))))
        merged = F.concat(F.slice(parts, F.lit(1), best["i"]), F.array(best["p"]), F.slice(parts, best["i"] + 3, k))
        return F.when((k < 2) | (best["r"] == NEVER), parts).otherwise(merged)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), letters, step)
    return words.select(F.col(f"`{word}`"), F.when(F.col(f"`{word}`").isNotNull(), F.transform(folded, rank)).alias("ids"))


def encode_by_join(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row as ``encode_decode`` gives them, by DataFrame functions only.

    Texts are cut into words by position, distinct words are folded once, ids
    and words meet in a join, and a text's ids are put together in order.
    Rows need keys of their own; white space beyond ASCII is cut as Java does.
    """
    import public_tokenizers

    rows = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    words = rows.select("k", F.posexplode(F.regexp_extract_all("t", F.lit(f"({public_tokenizers.PATTERN})"), F.lit(1))).alias("at", "word"))
    folded = fold_words(words.select("word").distinct(), "word", vocabulary)
    pieces = {i: b for b, i in read_ranks(tokenizer_path(vocabulary)).items()}
    table = F.from_json(F.lit(json.dumps([pieces.get(i, b"").hex() for i in range(max(pieces) + 1)])), "array<string>")

    def little(i):
        wide = F.lpad(F.hex(i.cast("long")), 8, "0")
        return F.concat(*[F.substring(wide, p, 2) for p in (7, 5, 3, 1)])

    whole = words.join(folded, "word").groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    every = rows.select("k").join(whole, "k", "left").select("k", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return every.select(
        F.col("k").alias(key),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.unhex(F.array_join(F.transform("ids", little), "")), 256).alias("ids_sha256"),
        F.sha2(F.unhex(F.array_join(F.transform("ids", lambda i: F.element_at(table, i + 1)), "")), 256).alias("decoded_sha256"),
    )
