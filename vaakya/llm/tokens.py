"""Token ids of whole texts by a public byte-level BPE vocabulary.

``Encoder.encode`` gives the same ids as encoding the whole text: a text is
cut at single spaces, which always begin a new pre-token of this vocabulary,
and each distinct piece is encoded once by the tokenizers library and kept in
a bounded table. Pieces of plain characters are made up of pre-tokens, which
are kept in that table, too; what is new among them is encoded many at a time.
Texts where the cut at spaces could differ (doubled or trailing spaces, a
special token's string) are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import regex

VOCAB = "byte_bpe_50k.json"
#: The vocabulary's only special token.
SPECIAL = "<|endoftext|>"
#: Pieces kept by a worker, in a young and an old table of half as many each.
MAX_PIECES = 1_000_000
#: Characters that are cut at once; a longer text is cut by itself.
CHUNK = 4_000_000
#: The vocabulary's pattern of pre-tokens (a fixed value).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces that every version of Unicode cuts alike: no control but the newline, Latin letters only.
PLAIN = regex.compile("[\n!-~\u00a1-\u024f]*")
BEYOND_PLAIN = "\u0250"


def byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary: bytes
    that print stand for themselves, the others follow from U+0100 on."""
    own = [33 <= b < 127 or 161 <= b < 256 and b != 173 for b in range(256)]
    return np.array([b if own[b] else 256 + b - sum(own[:b]) for b in range(256)], "<u4")


def vocab_path(name: str = VOCAB) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None = None, max_pieces: int = MAX_PIECES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from tokenizers import pre_tokenizers

        self.tok = Tokenizer.from_file(path or vocab_path())
        # For pre-tokens in byte letters, the letter of a zero byte between them;
        # nothing is left to cut, and no cache stands below ours.
        model = Tokenizer.from_file(path or vocab_path()).model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)
        self.letters = byte_letters()
        zero = chr(self.letters[0])
        self.bare = Tokenizer(model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(zero, "isolated")
        self.between = self.bare.token_to_id(zero)
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in batch(texts, add_special_tokens=False)]

    def _bare(self, tokens: list[str]) -> list[bytes]:
        """Ids of each of some pre-tokens without zero bytes."""
        raw = np.frombuffer("\0".join(tokens).encode(), np.uint8)
        batch = getattr(self.bare, "encode_batch_fast", self.bare.encode_batch)
        ids = np.array(batch([self.letters[raw].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
        out, at, data = [], 0, ids.tobytes()
        for end in (4 * np.flatnonzero(ids == self.between)).tolist():
            out.append(data[at:end])
            at = end + 4
        return [*out, data[at:]]

    @staticmethod
    def cuts(text: str) -> bool:
        """Whether the text may be encoded in parts, between single spaces."""
        return not ("  " in text or text[-1:] == " " or SPECIAL in text)

    def _recall(self, keys: Iterable[str]) -> list[str]:
        """Those keys that are not known. What is met again comes over from
        the old table; what is not, goes with it."""
        known, old = self.known, self.old
        new = []
        for k in keys:
            if k not in known:
                if k in old:
                    known[k] = old[k]
                else:
                    new.append(k)
        return new

    def _learn(self, new: list[str]) -> None:
        """Adds pieces, each as it stands after a space. A pre-token that
        begins with a space has the rest as its key, any other has itself and
        a space behind, which no piece has."""
        known, parts, odd = self.known, {}, []
        words = set()
        for p in new:
            if p.isalpha():
                words.add(p) if p.isascii() or max(p) < BEYOND_PLAIN else odd.append(p)
                continue
            stem = p.rstrip(".,")
            if stem.isalpha() and (stem.isascii() or max(stem) < BEYOND_PLAIN):
                parts[p] = (stem, p[len(stem) :] + " ")
            elif PLAIN.fullmatch(p):
                parts[p] = [t[1:] if t[0] == " " else t + " " for t in PRE_TOKEN.findall(" " + p)]
            else:
                odd.append(p)
        # A piece of one pre-token is its own part.
        words.update(self._recall(set().union(*parts.values())))
        todo = list(words)
        for i in range(0, len(todo), 2_000):
            keys = todo[i : i + 2_000]
            known.update(zip(keys, self._bare([k[:-1] if k[-1:] == " " else " " + k for k in keys]), strict=True))
        for i in range(0, len(odd), 2_000):
            keys = odd[i : i + 2_000]
            known.update(zip(keys, self._whole([" " + p for p in keys]), strict=True))
        get = known.__getitem__
        for p, keys in parts.items():
            known[p] = b"".join(map(get, keys))

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut: each distinct piece is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if 2 * len(self.known) > self.max_pieces:
            self.known, self.old = {}, self.known
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy().astype(np.int64)
        # What begins a text stands after no space, so it goes behind the others.
        heads: dict[str, int] = {}
        first = bounds[:-1]
        at[first] = [heads.setdefault(pieces[i], len(pieces) + len(heads)) for i in at[first].tolist()]
        used = np.bincount(at, minlength=len(pieces) + len(heads))[: len(pieces)].astype(bool).tolist()
        self._learn(self._recall(compress(pieces, used)))
        get = self.known.__getitem__
        ids = [get(p) if u else b"" for p, u in zip(pieces, used, strict=True)] + self._whole(list(heads))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        start = np.cumsum(size) - size
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        data = flat[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        marks = (4 * ends[bounds]).tolist()
        return [data[i:j] for i, j in pairwise(marks)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null is empty."""
        out = [b""] * len(texts)
        group: list[int] = []
        chars = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuts(text):
                out[i] = self._whole([text])[0]
                continue
            if group and chars + len(text) > CHUNK:
                self._fill(out, texts, group)
                group, chars = [], 0
            group.append(i)
            chars += len(text)
        if group:
            self._fill(out, texts, group)
        return out

    def _fill(self, out: list[bytes], texts: list[str | None], rows: list[int]) -> None:
        for i, ids in zip(rows, self._cut([texts[i] for i in rows]), strict=True):
            out[i] = ids


@lru_cache(1)
def worker_encoder() -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    return Encoder()
