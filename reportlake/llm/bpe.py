"""Byte-level BPE encoding and decoding with a compiled lexicon of the corpus's frequent words.

Words (pre-tokens) are counted over all documents; the most frequent ones, a number fixed by a parameter, are encoded
once and compiled into a minimal acyclic transducer, which executors memory-map. A word outside it is merged exactly.
The result is the same for any lexicon. Ids travel as packed little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import most_frequent, text_or_empty, written
from .lexicon import Lexicon, compile_words

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = regex.compile(r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Up to here this pattern's character classes are the same in every Unicode version at hand; other texts are cut by
#: the tokenizers library itself.
PLAIN = regex.compile(r"[\x00-ԯ]*")
MEMO_BYTES = 24_000_000
ID_BITS = 24
NEVER = 1 << 62


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def load_tables(path: str) -> dict:
    """What encoding needs of a tokenizer file: single bytes' ids, merges by id pair, tokens' bytes, added tokens.

    The size is bounded by the vocabulary, so the tables may be broadcast.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, symbol = spec["model"]["vocab"], byte_symbols()
    back = {c: b for b, c in symbol.items()}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[(vocab[a], vocab[b])] = rank << ID_BITS | vocab[a + b]
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    tokens: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for t, i in vocab.items():
        tokens[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    for t, i in added.items():
        tokens[i] = t.encode()
    return {"bytes": [vocab.get(symbol[b], -1) for b in range(256)], "merges": merges, "tokens": tokens, "added": added}


def merged(word: bytes, tables: dict) -> bytes:
    """Packed ids of one word by exact merging: the lowest rank first, the leftmost among equals."""
    one, get, mask = tables["bytes"], tables["merges"].get, (1 << ID_BITS) - 1
    ids = [one[b] for b in word]
    if len(ids) <= 64:
        ranks = [get(pair, NEVER) for pair in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) != NEVER:
            k = ranks.index(best)
            ids[k] = best & mask
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), NEVER)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), NEVER)
    else:  # linked list and heap: long words stay near-linear
        n = len(ids)
        left, right = [*range(-1, n - 1)], [*range(1, n), -1]
        heap = [(m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, k, a, b = heapq.heappop(heap)
            r = right[k]
            if ids[k] != a or r < 0 or ids[r] != b:
                continue
            ids[k], ids[r], right[k] = m & mask, -1, right[r]
            if right[k] >= 0:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (m := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        ids = [x for x in ids if x >= 0]
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(x.to_bytes(4, "little") for x in ids)


def cut(text: str) -> list[str]:
    """Pre-tokens of a text without added tokens."""
    if PLAIN.fullmatch(text):
        return PATTERN.findall(text)
    from tokenizers.pre_tokenizers import ByteLevel

    return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]


def between_added(text: str, added: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """(plain stretch, id of the added token after it or None)."""
    if not any(t in text for t in added):
        yield text, None
        return
    longest_first = "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))
    at = 0
    for m in regex.finditer(longest_first, text):
        yield text[at : m.start()], added[m.group()]
        at = m.end()
    yield text[at:], None


class Memo(dict):
    """Word to packed ids: recent words (two generations of at most MEMO_BYTES each), then the lexicon, then merging."""

    def __init__(self, tables: dict, lexicon: Lexicon | None):
        self.tables, self.lexicon, self.older, self.held = tables, lexicon, {}, 0

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            raw = word.encode()
            found = self.lexicon.get(raw) if self.lexicon else None
            if found is None:
                found = merged(raw, self.tables)
        if len(word) <= 64:
            if self.held >= MEMO_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self[word] = found
            self.held += 200 + len(word) + len(found)  # a dict entry with a str and a bytes object
        return found


def encode_text(text: str, memo: Memo) -> bytes:
    out = []
    for plain, special in between_added(text, memo.tables["added"]):
        out += [memo[w] for w in cut(plain)]
        if special is not None:
            out.append(special.to_bytes(4, "little"))
    return b"".join(out)


def decode_ids(packed: bytes, tokens: list[bytes]) -> str:
    return b"".join([tokens[i] for i in memoryview(packed).cast("I")]).decode("utf-8", "replace")


def word_counts(docs: DataFrame, text: str = "text", added: dict[str, int] | None = None, max_bytes: int = 64, flush: int = 200_000) -> DataFrame:
    """(word, n) of the words of up to `max_bytes` bytes in the whole texts of all documents. Tasks sum up what they hold
    before anything is shuffled."""
    added = added or {}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                for plain, _ in between_added(t, added):
                    seen.update(cut(plain))
                if len(seen) > flush:
                    yield framed(seen)
                    seen.clear()
        yield framed(seen)

    def framed(seen: Counter) -> pd.DataFrame:
        short = [w for w in seen if len(w) <= max_bytes]
        return pd.DataFrame({"word": pd.Series(short, dtype=object), "n": pd.Series([seen[w] for w in short], dtype="int64")})

    partial = docs.select(text_or_empty(F.col(text)).alias("t")).mapInPandas(count, "word string, n long")
    return partial.where(F.octet_length("word") <= max_bytes).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tables: dict, text: str = "text", max_words: int = 50_000, max_bytes: int = 64) -> bytes:
    """The compiled lexicon of about `max_words` frequent words of up to `max_bytes` bytes (bounds of what reaches the driver
    and is broadcast)."""
    counts = written(word_counts(docs, text, tables["added"], max_bytes), "words")
    return compile_words([(w, merged(w, tables)) for w in (r["word"].encode() for r in most_frequent(counts, "word", max_words).select("word").collect())])


def codec(spark: SparkSession, tables: dict, lexicon: bytes | None) -> Broadcast:
    return spark.sparkContext.broadcast((tables, lexicon))


def _coded(shared: Broadcast, texts: Iterator[pd.Series], each) -> Iterator:
    """Batches through each(memo, batch); a worker keeps no memo once its task is over."""
    tables, lexicon = shared.value
    memo = Memo(tables, Lexicon(lexicon) if lexicon else None)
    try:
        for batch in texts:
            yield each(memo, batch)
    finally:
        memo.clear()
        memo.older = {}


def encode(docs: DataFrame, shared: Broadcast, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the packed ids of `text` (null: empty). Other columns stay; `out` is replaced if it exists."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _coded(shared, batches, lambda memo, texts: pd.Series([encode_text(t, memo) for t in texts], dtype=object))

    return docs.withColumn(out, packed(text_or_empty(F.col(text))))


def decode(docs: DataFrame, shared: Broadcast, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the text of packed ids, special tokens included; null ids give the empty text. `out` is replaced if it
    exists."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = shared.value[0]["tokens"]
        for packed in batches:
            yield pd.Series([decode_ids(b, tokens) for b in packed], dtype=object)

    return docs.withColumn(out, texts(F.coalesce(F.col(ids), F.lit(b""))))


def bpe_round_trip(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """docs with `ids` (packed) and `decoded`, read back from the ids, of every row; columns of these names are replaced.

    Null texts count as empty: no ids and an empty text. Repeated rows are each coded; an empty table stays empty. One
    Python pass does both, so that texts and ids travel once.
    """
    spark, tables = docs.sparkSession, load_tables(tokenizer or default_tokenizer())
    shared = codec(spark, tables, build_lexicon(docs, tables, text))

    def both(memo: Memo, texts: pd.Series) -> pd.DataFrame:
        ids = [encode_text(t, memo) for t in texts]
        tokens = memo.tables["tokens"]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([decode_ids(b, tokens) for b in ids], dtype=object)})

    @F.pandas_udf("ids binary, decoded string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _coded(shared, batches, both)

    out = docs.drop("ids", "decoded", "_coded").withColumn("_coded", coded(text_or_empty(F.col(text))))
    return out.select(*[c for c in out.columns if c != "_coded"], "_coded.ids", "_coded.decoded")
