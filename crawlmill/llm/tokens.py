"""Token ids of whole texts by a public tokenizer file, word by word with a memo."""

from __future__ import annotations

import gc
from itertools import chain, pairwise

from .common import text_bytes, worker_memo

MEMO_WORDS = 600_000  # words (and as many word pieces) one worker remembers; a full memo starts anew


class _Memo(dict):
    """Little-endian 32-bit ids by word. New words are cut into the tokenizer's pieces, new pieces encoded together."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import numpy as np
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        # fixed value: the piece pattern of the tokenizer file
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]

    def _one(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, pieces: list[str]) -> None:
        import numpy as np

        ids = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids
        flat = np.array(ids, "<u4")
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) == len(pieces) and (not len(ends) or ends[-1] == len(flat)):
            data, at = flat.tobytes(), 0
            for piece, end in zip(pieces, (4 * ends).tolist(), strict=True):
                self.pieces[piece] = data[at:end]
                at = end
        else:
            self.pieces.update((p, self._one(p)) for p in pieces)

    def fill(self, words: list[bytes]) -> None:
        joined = b" ".join(words).decode()
        # white space beyond ASCII and the file's own added tokens take the tokenizer's own way
        if len(joined.split()) != len(words) or any(a in joined for a in self.added):
            odd = {w for w in words if len(w.decode().split()) != 1 or any(a in w.decode() for a in self.added)}
            self.update((w, self._one(w.decode())) for w in odd)
            words = [w for w in words if w not in odd]
            joined = b" ".join(words).decode()
        normal = self.tokenizer.normalizer.normalize_str(joined).split(" ") if words else []
        if len(normal) != len(words):
            self.update((w, self._one(w.decode())) for w in words)
            return
        find, pieces = self.pattern.findall, self.pieces
        cut = [n if n.isalpha() else find(n) for n in normal]  # a text: one piece
        new = {n for n, c in zip(normal, cut, strict=True) if c is n}
        new.update(*(c for n, c in zip(normal, cut, strict=True) if c is not n))
        new = [p for p in new if p not in pieces]
        if len(pieces) + len(new) > MEMO_WORDS:
            keep = {p: pieces[p] for c in cut for p in ((c,) if isinstance(c, str) else c) if p in pieces}
            pieces.clear()
            pieces.update(keep)
        for at in range(0, len(new), 5000):
            self._encode(new[at : at + 5000])
        self.update(
            zip(words, [pieces[c] if isinstance(c, str) else b"".join([pieces[p] for p in c]) for c in cut], strict=True)
        )


def encoder(path: str, end_id: int):
    """A function from a list of texts (None: empty) to each text's ids as little-endian 32-bit bytes, ``end_id`` last.

    The tokenizer removes white space and its pieces never cross it, so a text's ids are its words' ids in
    line. Words repeat, so most are looked up.
    """
    memo = worker_memo(f"tokens_{path}", lambda: _Memo(path))
    end = end_id.to_bytes(4, "little")

    def encode(texts: list[str | None]) -> list[bytes]:
        # nothing here makes cycles, and collections over millions of words are slow
        gc.disable()
        try:
            split = [t.encode().split() if t else [] for t in texts]
            new = set(chain.from_iterable(split)).difference(memo)
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = set(chain.from_iterable(split))
            memo.fill(list(new))
            return [b"".join(map(memo.__getitem__, ws)) + end for ws in split]
        finally:
            gc.enable()

    return encode


def column_encoder(path: str, end_id: int):
    """A function from an Arrow column of texts (null: empty) to all its ids in line, ``end_id`` after each text's, and
    where each text's ids start and the last end.

    Words are cut and numbered by Arrow; only a column's different words meet the memo, and their ids are placed by number.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    memo = worker_memo(f"tokens_{path}", lambda: _Memo(path))

    def encode(column: pa.Array):
        gc.disable()
        try:
            lists = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
            coded = lists.flatten().cast(pa.large_binary()).dictionary_encode()
            data, bounds = text_bytes(coded.dictionary.cast(pa.large_string()))
            raw, bounds = data.tobytes(), bounds.tolist()
            different = [raw[a:b] for a, b in pairwise(bounds)]
            new = [w for w in different if w and w not in memo]
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = [w for w in different if w]
            memo.fill(new)
            ids = [memo[w] if w else b"" for w in different]
        finally:
            gc.enable()
        known = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        start = np.cumsum(size, dtype=np.int64) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        kind = np.int32 if max(len(known), ends[-1]) < 1 << 31 else np.int64
        place = np.repeat((start[at] - ends[:-1]).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        texts = ends[offsets - offsets[0]]
        return np.insert(known[place], texts[1:], np.uint32(end_id)), texts + np.arange(len(texts))

    return encode
