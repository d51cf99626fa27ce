"""Byte-pair ids of whole texts, the same as those of the byte-level tokenizer file."""

from __future__ import annotations

import base64
import re
from array import array

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
VOCABULARY = "byte_bpe_50k"

# Letters and marks beyond these go to the tokenizer file itself, since the two
# libraries may follow different Unicode versions there.
_OTHER = re.compile("[^\x00-ɏ‐-‧€]")


class BytePairs:
    """Encodes with the rank table of the vocabulary; its ids are those of the tokenizer file.

    The string of the special token gives its id wherever it stands, as the
    file's library does by default. One object lives in each Python worker.
    """

    _shared: dict[str, BytePairs] = {}

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self._ranks = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={SPECIAL: SPECIAL_ID})
        self._file = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))

    @classmethod
    def shared(cls, vocabulary: str = VOCABULARY) -> BytePairs:
        if vocabulary not in cls._shared:
            cls._shared[vocabulary] = cls(vocabulary)
        return cls._shared[vocabulary]

    def ids(self, text: str) -> list[int]:
        if _OTHER.search(text):
            return self._file.encode(text, add_special_tokens=False).ids
        if SPECIAL in text:
            return self._ranks.encode(text, allowed_special="all")
        return self._ranks.encode_ordinary(text)


def little_endian(ids: list[int]) -> bytes:
    """The ids as unsigned 32-bit integers, lowest byte first."""
    packed = array("I", ids)
    if packed.itemsize != 4 or array("H", [1]).tobytes() != b"\x01\x00":
        return b"".join(i.to_bytes(4, "little") for i in ids)
    return packed.tobytes()
