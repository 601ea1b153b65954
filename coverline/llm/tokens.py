"""Tokenizer files as functions from a text to its ids."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

#: The pattern by which byte-level BPE files of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_table() -> dict[str, int]:
    """Of byte-level vocabularies: the byte that each character stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}


def follows_merges(model: dict, special: set[str]) -> bool:
    """Whether ids alone tell which merge comes first: every merge makes a token of its own, ids rise in the order of the
    merges, and every token is a byte or made by a merge."""
    vocab, made = model["vocab"], set()
    before = -1
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        token = left + right
        if token in made or vocab.get(token, -1) <= before:
            return False
        made.add(token)
        before = vocab[token]
    return all(token in made or token in special or len(token) == 1 for token in vocab)


@functools.cache
def encoder(path: str | None = None, specials: bool = True) -> Callable[[str], list[int]]:
    """The ids of a text under a tokenizer file; none are added. Without ``specials`` the strings of special tokens in a text are plain text.

    A plain byte-level BPE file whose ids follow its merges is run by the faster of two libraries, which then give the same
    ids; any other file by the one that owns the format.
    """
    from tokenizers import Tokenizer

    path = path or default_tokenizer()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not specials
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def plain(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    model, words = spec["model"], spec.get("pre_tokenizer") or {}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    simple = model.get("type") == "BPE" and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and not spec.get("normalizer")
    if odd or not simple or not follows_merges(model, set(special)):
        return plain
    import tiktoken

    byte_of = byte_table()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
    if not specials:
        return fast.encode_ordinary
    return lambda text: plain(text) if any(s in text for s in special) else fast.encode_ordinary(text)
