"""Units: parts of a text that byte-level and piece tokenizers never look across, each encoded once while a table of them lasts.

A text is cut before every space that follows something other than white space. The byte-level pattern matches no run that goes from
another character into a space, and looks ahead only from white space to what follows it; no piece of a vocabulary of word pieces holds a space
after another character. So the ids of a text are those of its units, one after the other, and the library's answer for a unit can be kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from quire.llm.byte_bpe import ranges
from quire.llm.common import Index
from quire.llm.pretokens import segment_sums

#: White space of Unicode: what Python has less four separators that only Python counts.
SPACE, OTHER, NOT_BLANK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]", r"[^\S \x1c-\x1f]"
UNIT = re.compile(rf"{SPACE}*{OTHER}+(?:{NOT_BLANK}{SPACE}*{OTHER}+)*(?:{NOT_BLANK}{SPACE}*\Z)?|{SPACE}+")
#: Units and characters after which a table starts anew, and units that a library gets at a time.
CARRY, CARRY_CHARS, BATCH = 500_000, 32 << 20, 10_000


@lru_cache(maxsize=4)
def load_tokenizer(path: str, plain: bool):
    """The library's tokenizer of a .json file; `plain` takes the strings of special tokens as ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = plain
    return t


def flat_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one list after the other, and how many each has."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter((i for x in lists for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes


def json_ids(path: str, plain: bool) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encodes units: those of plain characters by the rank-based library where it splits alike, others by the tokenizer itself."""
    t, ranks = load_tokenizer(path, plain), rank_encoder(path)
    by_ranks = ranks and (ranks.encode_ordinary if plain else lambda u: ranks.encode(u, allowed_special="all"))

    def batch(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        easy = [by_ranks is not None and PLAIN.fullmatch(u) is not None for u in units]
        rest = iter(t.encode_batch_fast([u for u, e in zip(units, easy) if not e], add_special_tokens=False))
        return flat_ids([by_ranks(u) if e else next(rest).ids for u, e in zip(units, easy)])

    return in_batches(batch)


def in_batches(encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A library's answers are large objects; so only those of a batch are held at a time."""

    def run(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [encode(units[a : a + BATCH]) for a in range(0, len(units), BATCH)] or [flat_ids([])]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    return run


def numbers(texts: list[str], index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Unit numbers of all texts, one after the other, and how many each has; `index` gets the new units."""
    flat: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        units = UNIT.findall(t)
        flat += map(index.__getitem__, units)
        sizes[i] = len(units)
    return np.array(flat, dtype=np.int64), sizes


class UnitEncoder:
    """Ids of texts from the ids of their units."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.index, self.chars = Index(), 0
        self.ids, self.sizes, self.starts = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.index) > CARRY or self.chars > CARRY_CHARS:
            self.clear()
        flat, units = numbers(texts, self.index)
        if len(self.index) > len(self.sizes):
            new = list(self.index)[len(self.sizes) :]
            self.chars += sum(map(len, new))
            ids, sizes = self.encode(new)
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        each = self.sizes[flat]
        return self.ids[ranges(self.starts[flat], each)], segment_sums(each, units)


#: Texts whose characters every version of Unicode puts in the same classes: printable ASCII, tabs and line ends, Latin letters, common dashes and quotes.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u017f\\u2013\\u2014\\u2018-\\u201e\\u2020-\\u2022\\u2026\\u20ac]*")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where Latin-1 prints it, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def rank_encoder(path: str):
    """The rank-based library's encoder for a byte-level .json file whose merges are in the order of its ids, special tokens as they are there;
    None for any other file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    letters, added = byte_letters(), {x["content"]: x["id"] for x in told["added_tokens"]}
    names = {n: i for n, i in model["vocab"].items() if n not in added}
    usual = model["type"] == "BPE" and not told.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    usual = usual and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not usual or [names.get(m) for m in merges] != list(range(256, 256 + len(merges))) or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"]):
        return None
    ranks = {bytes(letters[c] for c in n): i for n, i in names.items()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


class TextEncoder:
    """Ids of texts: whole plain texts by the rank-based library, which is the faster one and splits them alike, others by their units."""

    def __init__(self, path: str):
        self.units, self.ranks = UnitEncoder(json_ids(path, False)), rank_encoder(path)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if self.ranks is None:
            return self.units(texts)
        plain = [PLAIN.fullmatch(t) is not None for t in texts]
        flat, sizes = self.units([t for t, p in zip(texts, plain) if not p])
        rest = iter(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else ())
        ids = [self.ranks.encode_to_numpy(t, allowed_special="all") if p else next(rest) for t, p in zip(texts, plain)]
        return np.concatenate([np.empty(0, dtype=np.uint32), *ids]), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> TextEncoder:
    """One for each worker process, so that what a task has encoded serves the next."""
    return TextEncoder(path)
