"""Public tokenizer files, opened once in each Python process."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

ROW = 64  # words of a row


@lru_cache(maxsize=2)
def word_tokenizer(path: str):
    """A ``tokenizers`` file; one thread, as Spark runs a task for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def _last_pieces(path: str) -> frozenset[int]:
    """Ids of pieces that end a word, where the model marks them; else none."""
    t = word_tokenizer(path)
    mark = getattr(t.model, "end_of_word_suffix", None)
    return frozenset(i for piece, i in t.get_vocab(with_added_tokens=False).items() if piece.endswith(mark)) if mark else frozenset()


def encode_words(path: str, words: list[bytes]) -> list[list[int]]:
    """Ids of each word. Words of letters alone go through the library in rows, as a call costs more than a word.

    Such a word is at least one pre-token. A row whose pieces end as many words as it has is thus parted
    where they end; any other row is encoded word by word.
    """
    t, last = word_tokenizer(path), _last_pieces(path)
    texts = [w.decode("utf-8", "replace").strip(" \t\r\n\x0b\x0c") for w in words]
    out: list[list[int]] = [[] for _ in texts]
    plain = [i for i, x in enumerate(texts) if last and x.isalpha()]
    single = [i for i, x in enumerate(texts) if not (last and x.isalpha())]
    rows = [plain[i : i + ROW] for i in range(0, len(plain), ROW)]
    for a in range(0, len(rows), 256):
        part = rows[a : a + 256]
        for row, e in zip(part, t.encode_batch_fast([" ".join([texts[i] for i in row]) for row in part], add_special_tokens=False), strict=True):
            ends = [k + 1 for k, i in enumerate(e.ids) if i in last]
            if len(ends) == len(row) and ends[-1] == len(e.ids):
                ids = e.ids
                for i, x, y in zip(row, [0, *ends[:-1]], ends, strict=True):
                    out[i] = ids[x:y]
            else:
                single += row
    for a in range(0, len(single), 4096):
        part = single[a : a + 4096]
        for i, e in zip(part, t.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = e.ids
    return out


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
