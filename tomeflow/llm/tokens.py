"""Encoding of texts with a public tokenizer: exact, in arrays, with a bounded table of known pieces."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import load_words, mix
from .common import bound_batches, tidy

#: Pieces kept between calls, and the bytes that a piece may have to be kept.
CACHE_PIECES, KEY_BYTES = 300_000, 24
#: Pieces that are encoded as one text.
JOINED = 512
#: Bytes of text that are cut into pieces together; longer texts are cut at white space first.
GROUP_BYTES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: No cut is made after these: white space, and control characters that some call white space.
_NO_CUT = _SPACE.copy()
_NO_CUT[0x1C:0x20] = True
#: Letters, and marks that never are of one token with a letter before them.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True
#: White space outside ASCII, as UTF-8.
_WIDE = tuple(c.encode() for c in "\x85\xa0                　")
_CUT = re.compile(rb"[!-~](?=[ \n\t])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """encode(texts) gives the ids of each as little-endian uint32 bytes, equal to the tokenizer's own.

    Byte-level BPE never makes a token of a character that isn't white space and white space after it, nor of a
    letter and a mark after it. Texts are cut there, so a piece is white space and a word, or marks; equal pieces
    have equal ids and are encoded once in a call. Pieces are compared byte by byte where they are looked up by hash. Texts of other
    kinds of tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cuts = self.cuts and not any(re.search(r"\s|[A-Za-z][.,;:!?]", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made.get("added_tokens", []))
        # Bytes of each token: a byte-level vocabulary writes a character for each.
        vocab = self.tokenizer.get_vocab(True)
        self.sizes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.sizes[list(vocab.values())] = list(map(len, vocab))
        # Known pieces in order of their hash: key columns, place in the pool of ids, whether used since the last clearing.
        self.hash, self.key = np.zeros(0, np.uint64), np.zeros((4, 0), np.uint64)
        self.at, self.n, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool = np.zeros(0, "<u4")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each). Pieces that may stand in a row are encoded so."""
        n, ids = np.zeros(len(pieces), np.int64), [b""] * len(pieces)
        inner = np.array([bool(_SPACE[p[0]] and not _NO_CUT[p[-1]] and (p[-1] < 0x80 or not p.endswith(_WIDE))) for p in pieces], bool)
        alone = np.flatnonzero(~inner).tolist()
        inner = np.flatnonzero(inner).tolist()
        for k in range(0, len(inner), JOINED):
            part = inner[k : k + JOINED]
            raw = self._ids([b"".join([pieces[i] for i in part]).decode()])[0]
            have = np.cumsum(self.sizes[np.frombuffer(raw, "<u4")])
            ends = np.cumsum([len(pieces[i]) for i in part])
            at = np.searchsorted(have, ends)
            if not len(have) or have[-1] != ends[-1] or (have[at] != ends).any():  # tokens that are not of their bytes
                alone += part
                continue
            begin = 0
            for i, end in zip(part, (4 * at + 4).tolist(), strict=True):
                ids[i] = raw[begin:end]
                begin = end
        for k in range(0, len(alone), JOINED):
            part = alone[k : k + JOINED]
            for i, x in zip(part, self._ids([pieces[i].decode() for i in part]), strict=True):
                ids[i] = x
        n[:] = [len(x) // 4 for x in ids]
        return np.frombuffer(b"".join(ids), "<u4"), n

    def _keep(self, h: np.ndarray, key: np.ndarray, at: np.ndarray, n: np.ndarray, pool: np.ndarray) -> None:
        """Add pieces that were not known; when there are too many, those not used since the last time go first."""
        used = np.concatenate([self.used, np.zeros(len(h), bool)])
        all_h, all_key = np.concatenate([self.hash, h]), np.concatenate([self.key, key], 1)
        all_at, all_n = np.concatenate([self.at, at + len(self.pool)]), np.concatenate([self.n, n])
        all_pool = np.concatenate([self.pool, pool])
        if len(all_h) > CACHE_PIECES:
            order = np.argsort(~used, kind="stable")[: CACHE_PIECES // 2]
            used = np.zeros(len(order), bool)
            all_h, all_key, all_at, all_n = all_h[order], all_key[:, order], all_at[order], all_n[order]
            all_pool = all_pool[_ranges(all_at, all_n)]
            all_at = np.cumsum(all_n) - all_n
        order = np.argsort(all_h)
        self.hash, self.key, self.at, self.n, self.used, self.pool = all_h[order], all_key[:, order], all_at[order], all_n[order], used[order], all_pool

    def _group(self, rows: list[bytes]) -> list[bytes]:
        """encode() of some texts, given as UTF-8."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        data = b"".join(rows)
        if not data:
            return [b""] * len(rows)
        buf = np.frombuffer(data + bytes(KEY_BYTES + 8), np.uint8)[: len(data)]
        ends = np.cumsum(lengths)
        cut = np.zeros(len(buf) + 1, bool)
        cut[1 : len(buf)] = (_SPACE[buf[1:]] & ~_NO_CUT[buf[:-1]]) | (_MARK[buf[1:]] & _LETTER[buf[:-1]])
        high = np.flatnonzero(cut[1:-1] & (buf[:-1] >= 0x80))  # the byte before a cut
        for wide in _WIDE:
            same = high >= len(wide) - 1
            for k, b in enumerate(reversed(wide)):
                same &= buf[np.maximum(high - k, 0)] == b
            cut[high[same] + 1] = False
        cut[(ends - lengths)[lengths > 0]] = True
        a = np.flatnonzero(cut[:-1])
        size = np.diff(a, append=len(buf))
        key = np.stack([*load_words(data + bytes(KEY_BYTES + 8), a, size, KEY_BYTES // 8), size.astype(np.uint64)])
        h = mix(key[0] ^ mix(key[1] ^ mix(key[2] ^ mix(key[3]))))
        own = size > KEY_BYTES  # encoded where they stand
        h[own] = np.arange(own.sum(), dtype=np.uint64)
        order = np.argsort(h)
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        first = order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        if ((key[:, first][:, which] != key) & ~own).any():  # equal hashes of different pieces
            return self._ids([r.decode() for r in rows])
        spot = np.minimum(np.searchsorted(self.hash, h[first]), max(len(self.hash) - 1, 0))
        known = (self.hash[spot] == h[first]) & (self.key[:, spot] == key[:, first]).all(0) & ~own[first] if len(self.hash) else np.zeros(len(first), bool)
        self.used[spot[known]] = True
        lack = np.flatnonzero(~known)
        begin, stop = a[first[lack]].tolist(), (a + size)[first[lack]].tolist()
        made, n_made = self._learn([data[i:j] for i, j in zip(begin, stop, strict=True)])
        at, n = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        at[known], n[known] = self.at[spot[known]], self.n[spot[known]]
        at_made = np.cumsum(n_made) - n_made
        at[lack], n[lack] = at_made + len(self.pool), n_made
        pool = np.concatenate([self.pool, made])
        n_of = n[which]
        out = pool[_ranges(at[which], n_of)].tobytes()
        tokens = np.concatenate([[0], np.cumsum(n_of)])[np.searchsorted(a, ends)] * 4
        keep = ~own[first[lack]]
        self._keep(h[first[lack]][keep], key[:, first[lack]][:, keep], at_made[keep], n_made[keep], made)
        return [out[i:j] for i, j in zip([0, *tokens[:-1].tolist()], tokens.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._ids(texts)
        parts: list[bytes] = []
        owner: list[int] = []
        out: list[list[bytes]] = [[] for _ in texts]
        n = 0

        def flush() -> None:
            for i, ids in zip(owner, self._group(parts), strict=True):
                out[i].append(ids)
            parts.clear()
            owner.clear()

        for i, text in enumerate(texts):
            raw = text.encode()
            begin = 0
            while begin < len(raw):
                end = len(raw)
                if end - begin > GROUP_BYTES and (m := _CUT.search(raw, begin + GROUP_BYTES)):
                    end = m.end()
                parts.append(raw[begin:end])
                owner.append(i)
                n, begin = n + end - begin, end
                if n >= GROUP_BYTES:
                    flush()
                    n = 0
        if parts:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... n[0] of them, then those of at[1], ..."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def groups(texts: list[str], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(df: DataFrame, key: str, text: str, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """(key, ids): the token ids of each row's whole text and the end id, as little-endian uint32 bytes.

    A null text counts as empty: just the end id. Extra columns are left out.
    """
    path = tokenizer or default_tokenizer()
    kind = df.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for f in frames:
            texts = f["t"].tolist()
            for a, b in groups(texts):
                yield pd.DataFrame({"k": f["k"].iloc[a:b].array, "ids": [x + end for x in enc.encode(texts[a:b])]})

    bound_batches(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return src.mapInPandas(tidy(run), f"k {kind}, ids binary").select(F.col("k").alias(key), "ids")
