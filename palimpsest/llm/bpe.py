"""Byte-level BPE: batched merge rounds in numpy over the symbols of many words at once.

A round finds every word's pair of the lowest rank by binary search over the sorted pair keys and merges it wherever it
stands; words without such a pair leave. Merging other pairs in the same round would not be right: a pair of a higher
rank may lose a symbol to a merge that the round only makes possible.
"""

from __future__ import annotations

import hashlib
import json
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, short_batches

#: Words whose ids a task remembers, of so many characters at most; beyond that it forgets all and starts anew.
REMEMBERED, SHORT = 200_000, 64
#: Bytes of a word beyond which it is merged by itself with a heap: rounds would cost its length times its different merges.
LONG = 1024
#: Words that are merged at once.
AT_ONCE = 50_000

# The split of the byte-level pre-tokenizer (public_tokenizers.PATTERN).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encodes as the tokenizers library does with a byte-level BPE file (no prefix space), and decodes."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without a normalizer or prefix space are read")
        to_byte, vocab = byte_symbols(), model["vocab"]
        self.bytes = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.byte_ids[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else lambda t: [t]
        self.known: dict[str, tuple[int, ...]] = {}
        self.rule: dict[int, tuple[int, int]] = {}

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Merges all words at once: in each round every word merges its pair of the lowest rank, wherever it stands; finished words leave."""
        raw = [w.encode() for w in words]
        out = {w: tuple(self._long(r)) for w, r in zip(words, raw) if len(r) > LONG}
        words, raw = ([x for x, r in zip(xs, raw) if len(r) <= LONG] for xs in (words, raw))
        if not raw:
            return out
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        done = np.int64(len(self.pairs))
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            # which symbols begin a pair that can merge, and its rank
            key = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), done - 1)
            rank = np.append(np.where((self.pairs[at] == key) & (word[:-1] == word[1:]), self.ranks[at], done), done)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            going = least < done
            if np.count_nonzero(going) < 0.9 * len(going):
                finished.append((word[~going], symbols[~going]))
                symbols, word, rank, least = symbols[going], word[going], rank[going], least[going]
                if not len(symbols):
                    break
            pick = np.flatnonzero((rank == least) & (rank < done))
            # of overlapping equal pairs (a a a) the leftmost merge: every other one of a stretch
            stretch = np.cumsum(np.append(True, np.diff(pick) > 1)) - 1
            begin = np.searchsorted(stretch, stretch)
            pick = pick[(np.arange(len(pick)) - begin) % 2 == 0]
            symbols[pick] = self.merged[rank[pick]]
            keep = np.ones(len(symbols), bool)
            keep[pick + 1] = False
            symbols, word = symbols[keep], word[keep]
        word, symbols = (np.concatenate(x) for x in zip(*finished))
        order = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[order], np.arange(len(raw) + 1)).tolist()
        ids = symbols[order].tolist()
        out.update((w, tuple(ids[s:e])) for w, s, e in zip(words, ends, ends[1:]))
        return out

    def _long(self, raw: bytes) -> list[int]:
        """The same merges for one long word: the pair of the lowest rank, of equals the leftmost, from a heap."""
        if not self.rule:
            self.rule = {p: (r, m) for p, r, m in zip(self.pairs.tolist(), self.ranks.tolist(), self.merged[self.ranks].tolist())}
        rule, ids = self.rule, self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rule[p][0], i) for i in range(n - 1) if (p := ids[i] << 32 | ids[i + 1]) in rule]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = right[i]
            if ids[i] < 0 or j == n or (found := rule.get(ids[i] << 32 | ids[j])) is None or found[0] != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j], k = found[1], -1, right[j]
            right[i] = k
            if k < n:
                left[k] = i
                if (p := ids[i] << 32 | ids[k]) in rule:
                    heappush(heap, (rule[p][0], i))
            if (h := left[i]) >= 0 and (p := ids[h] << 32 | ids[i]) in rule:
                heappush(heap, (rule[p][0], h))
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        cut = [[(p, None) if p in self.added else (p, self.split(p)) for p in self.cut(t) if p] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        here: dict[str, tuple[int, ...]] = {}
        new = list({w for parts in cut for _, words in parts if words for w in words if w not in self.known})
        for lo in range(0, len(new), AT_ONCE):
            here |= self._learn(new[lo : lo + AT_ONCE])
        self.known.update((w, ids) for w, ids in here.items() if len(w) <= SHORT)
        known = ChainMap(self.known, here) if any(len(w) > SHORT for w in here) else self.known
        for parts in cut:
            out: list[int] = []
            for p, words in parts:
                if words is None:
                    out.append(self.added[p])
                else:
                    for w in words:
                        out.extend(known[w])
            yield out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def _coded(batches: Iterator[pa.RecordBatch], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    coder = load(path)
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        for lo in range(0, len(texts), 64):
            part = b.slice(lo, 64)
            out = []
            for ids in coder.encode([t or "" for t in texts[lo : lo + 64]]):
                text = coder.decode(ids)
                out.append((ids if full else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text if full else None))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string(), pa.string()))]
            columns = columns if full else columns[1:4]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(b.num_columns - 1)), *columns], names=[str(i) for i in range(b.num_columns - 1 + len(columns))])


def _run(df: DataFrame, text: str, carry: list[str], path: str, full: bool) -> DataFrame:
    short_batches(df.sparkSession)
    types = dict(df.dtypes)
    schema = [f"c{i} {types[c]}" for i, c in enumerate(carry)] + ["n long", "s1 string", "s2 string"]
    if full:
        schema[len(carry) : len(carry)] = ["ids array<int>"]
        schema.append("decoded string")
    read = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("text"))
    return read.mapInArrow(partial(_coded, path=path, full=full), ", ".join(schema))


def bpe_encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds to each row, under names that df doesn't have: token_ids, n_tokens, ids_sha256, decoded_sha256, decoded.

    A null text counts as empty and has no tokens. The strings of added tokens in a text become their ids. No shuffle;
    memory is bounded by 64 texts and REMEMBERED words. Repeated rows stay. An empty table gives an empty one.
    """
    names = fresh(df, "token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "decoded")
    read = df.withColumn(fresh(df, "text_to_code")[0], F.col(text))
    return _run(read, read.columns[-1], df.columns, path, True).toDF(*df.columns, *names)


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row per row of df: id_col, n_tokens, ids_sha256, decoded_sha256; with ids, also token_ids."""
    out = _run(df, text, [id_col], path, ids)
    if ids:
        return out.toDF(id_col, "token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "decoded").drop("decoded")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
