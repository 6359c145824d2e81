"""Fast exact token ids of a public byte-level BPE.

The pre-tokenizer of a byte-level BPE cuts a text by a fixed pattern and encodes each cut on its own,
so the ids of a cut can be kept and used again. A bounded memo of cuts makes most of a corpus a table
lookup. Cuts are made here only for texts of plain scripts, where character classes cannot differ
between libraries; their ids come from the same vocabulary as ranks. Any other text, and one that
holds the text of a special token, goes to the ``tokenizers`` library whole. A vocabulary without a
file of ranks beside it goes there always.
"""

from __future__ import annotations

import base64
import os
import re
from pathlib import Path

import numpy as np

from sonarlake.llm.session import KEPT

DEFAULT = "byte_bpe_50k.json"
#: Texts of other characters are left to the library; their letters and numbers.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u017f\u2010-\u2027\u20ac]*")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The public pre-tokenizer's pattern, with these letters and numbers.
_CUTS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


class _Memo(dict):
    """Cut to the bytes of its ids; emptied at its limit."""

    LIMIT = 500_000

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe

    def __missing__(self, cut: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        self[cut] = out = np.array(self.core.encode_single_piece(cut.encode()), np.uint32).tobytes()
        return out


class Encoder:
    """ids(texts) for one vocabulary file; one instance per worker and stage."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path(DEFAULT)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = Path(path).with_suffix(".tiktoken")
        self.memo = _Memo(str(ranks)) if ranks.exists() else None

    def library(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 64):  # encodings are large objects
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts[at : at + 64], add_special_tokens=False)]
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        get = self.memo.__getitem__ if self.memo is not None else None
        out = []
        for t in texts:
            t = t or ""
            if get and _PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                out.append(np.frombuffer(b"".join(map(get, _CUTS.findall(t))), np.uint32))
            else:
                out += self.library([t])
        return out


_ENCODERS: dict[str | None, Encoder] = {}
KEPT.append(_ENCODERS.clear)


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
