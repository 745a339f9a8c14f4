"""Words of texts and the tokenizer file behind BPE encoding and token counts.

A word is a maximal run without space, tab, line feed or carriage return.
The tokenizer drops white space and never merges over it, so a text's ids are
those of its words in order.
"""

from __future__ import annotations

import json
from functools import lru_cache

DEFAULT_TOKENIZER = "word_bpe_49k.json"
BLANKS = str.maketrans("\t\n\r", "   ")


def blank(text: str) -> str:
    """text.translate(BLANKS), which takes several times as long where a text is not ASCII."""
    return text.replace("\t", " ").replace("\n", " ").replace("\r", " ")


def tokenizer_path(name_or_path: str = DEFAULT_TOKENIZER) -> str:
    """A path, or a file name of the installed vocabulary package."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


@lru_cache(maxsize=2)
def load(name_or_path: str = DEFAULT_TOKENIZER):
    """The library's tokenizer, without truncation or padding, once a process."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name_or_path))
    tok.no_truncation()
    tok.no_padding()
    return tok


def spec(name_or_path: str = DEFAULT_TOKENIZER) -> dict:
    """The tokenizer's file. It is large, so whoever reads it keeps what they need."""
    with open(tokenizer_path(name_or_path), encoding="utf-8") as f:
        return json.load(f)


def words_of(text: str | None) -> list[str]:
    """Words of a text in order; null has none."""
    return [w for w in (text or "").translate(BLANKS).split(" ") if w]
