"""Token ids of whole texts by the tokenizers library, remembering the ids of pre-tokens.

Byte-level BPE works inside pre-tokens, and most pre-tokens recur, so each worker asks the library once for each pre-token and
keeps the answer (two generations of ``keep`` entries and those of one text: what is met again moves to the new one, and ids are the same
for any ``keep``; an entry takes some 300 bytes). Texts are split by the tokenizer's published pattern
only where every character is one whose class is the same in all Unicode versions; any other text, and one with an added token such as <|endoftext|>, goes to the
library whole, so ids are those of the library's own call.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import give_back, only

#: Latin letters and numerals as the published patterns' \p{L} and \p{N} have them below U+0250.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Anything but plain white space, printable ASCII and Latin; U+0130 changes its length in lower case.
_OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-įı-ɏ]")
KEEP = 400_000


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers. ``lower`` tells whether the file lower-cases."""

    def __init__(self, path: str, keep: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        self.whole = Tokenizer.from_str(text)
        #: Contents of added tokens, which the library takes out before it splits.
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or ()) or r"(?!)").search
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        self.lower = spec.get("normalizer") is not None
        self.split = None
        if steps[0]["type"] == "ByteLevel" and not self.lower:
            self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+").findall
        elif steps[0]["type"] == "Split" and self.lower:
            self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+").findall
        self.piece = Tokenizer.from_str(text)
        self.piece.encode_special_tokens = True
        self.piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if self.lower:
            from tokenizers import normalizers

            self.piece.normalizer = normalizers.Sequence([])
        self.keep = KEEP if keep is None else keep
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.split is None or _OTHER.search(text):
            return self.encode_whole(text)
        normal = text.lower() if self.lower else text
        if self.added(text) or (self.lower and self.added(normal)):
            return self.encode_whole(text)
        known = self.known
        pieces = self.split(normal)
        new = list(set(pieces).difference(known))
        if new:
            if len(known) > self.keep:
                self.old, self.known = known, {}
                give_back()
                known, new = self.known, list(set(pieces))
            if self.old:
                old = self.old
                known.update((p, old[p]) for p in new if p in old)
                new = [p for p in new if p not in old]
            for piece, found in zip(new, self.piece.encode_batch_fast(new, add_special_tokens=False)):
                known[piece] = array("I", found.ids).tobytes()
        return b"".join(map(known.__getitem__, pieces))


def encoder(path: str, keep: int | None = None) -> Encoder:
    """One encoder a worker."""
    return only(f"encoder {path} {keep}", lambda: Encoder(path, keep))
