"""Operator 11: tokens of two tokenizers aligned over the bytes of each document.

A is a byte-level BPE file and reads a space and the text, B a piece file that adds that space itself; both spell the same bytes.
Documents are taken in blocks of about ``BLOCK`` bytes. In a block, ``pandas.merge_asof``, keyed by document, finds for each token's
start the other side's token that covers it; both directions together are all overlaps. Where tokens of both sides end at
the same byte a group ends.

How many documents hold a pair of ids linked is counted over the corpus. Each block counts its own pairs first, so what is
shuffled is a row for each block and pair, and a pair that every document holds has no more rows than there are blocks. Counts
go back to the blocks the same way. The best count of each A id is a row for each entry of A's vocabulary, which bounds it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep
from .textkit import buffers, slices
from .tokens import byte_table, default_tokenizer, encoder

#: Bytes of text a block; a longer text is a block of its own.
BLOCK = 1 << 20


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def _sides(a: str, b: str):
    """How each side encodes a text, and the bytes of each of its ids."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_of, own = byte_table(), Tokenizer.from_file(a)
    a_bytes = [b""] * own.get_vocab_size()
    for token, i in own.get_vocab().items():
        a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    pieces = sentencepiece.SentencePieceProcessor(model_file=b)
    b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.vocab_size())]
    return encoder(a, specials=False), pieces.encode, a_bytes, b_bytes


def _tokens(texts: list[str], encode, table: list[bytes], before: str) -> list[tuple[np.ndarray, bytes]]:
    return [(np.array(ids, np.int64), b"".join([table[i] for i in ids])) for ids in (encode(before + t) if t else [] for t in texts)]


class Side:
    """The tokens of one side in one block: document, id, start and end byte, documents end to end."""

    def __init__(self, ids: list[np.ndarray], table: list[bytes]):
        sizes = np.array([len(t) for t in table], np.int64)
        self.counts = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([*ids, np.empty(0, np.int64)])
        self.doc = np.repeat(np.arange(len(ids)), self.counts)
        self.end = np.cumsum(sizes[self.ids])
        self.start = self.end - sizes[self.ids]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"at": self.start, "doc": self.doc, "token": np.arange(len(self.ids))})


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token whose bytes overlap: each start meets the token that covers it, equal starts once."""
    if not len(a.ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = a.frame(), b.frame()
    forth = pd.merge_asof(left, right, on="at", by="doc", suffixes=("_a", "_b"))
    back = pd.merge_asof(right, left, on="at", by="doc", suffixes=("_b", "_a"))
    i, j = back["token_a"].to_numpy(np.int64), back["token_b"].to_numpy(np.int64)
    new = a.start[i] != b.start[j]
    return np.concatenate([forth["token_a"].to_numpy(np.int64), i[new]]), np.concatenate([forth["token_b"].to_numpy(np.int64), j[new]])


def groups(a: Side, b: Side, ends: np.ndarray) -> list[str]:
    """Each document's groups as `a1,a2|b1;a3|b2`: ids in order, a bar between the sides, a semicolon between groups.

    ``ends`` are the bytes where tokens of both sides end."""
    at_a, at_b = np.searchsorted(ends, a.end), np.searchsorted(ends, b.end)
    in_a, in_b = np.bincount(at_a, minlength=len(ends)), np.bincount(at_b, minlength=len(ends))
    place_a = np.arange(len(at_a)) + (np.cumsum(in_b) - in_b)[at_a]
    place_b = np.arange(len(at_b)) + np.cumsum(in_a)[at_b]
    out = np.empty(len(at_a) + len(at_b), object)
    for side, place, mark in ((a, place_a, "|"), (b, place_b, ";")):
        last = np.isin(side.end, ends)
        ids, back = np.unique(side.ids, return_inverse=True)
        names = np.array([[f"{i}," for i in ids.tolist()], [f"{i}{mark}" for i in ids.tolist()]], object)
        out[place] = names[last.astype(int), back]
    cuts = np.cumsum(a.counts + b.counts)
    return ["".join(out[n - m : n].tolist())[:-1] for n, m in zip(cuts.tolist(), (a.counts + b.counts).tolist())]


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, encode_b, bytes_a, bytes_b = _sides(a_path, b_path)
        width, block = len(bytes_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            _, starts, ends = buffers(batch.column(1))
            for rows in slices(starts, ends, BLOCK):
                texts = [t or "" for t in batch.column(1)[rows].to_pylist()]
                both = list(zip(_tokens(texts, encode_a, bytes_a, " "), _tokens(texts, encode_b, bytes_b, ""), texts))
                none = np.empty(0, np.int64)
                same = [bool(t) and x[1] == y[1] == b" " + t.encode() for x, y, t in both]
                a = Side([x[0] if ok else none for (x, _, _), ok in zip(both, same)], bytes_a)
                b = Side([y[0] if ok else none for (_, y, _), ok in zip(both, same)], bytes_b)
                del both
                i, j = overlaps(a, b)
                end = np.intersect1d(a.end, b.end, assume_unique=True)  # every token has bytes, so ends rise
                n = len(texts)
                # the pairs of each document, once each, and how often it has them
                linked, times = np.unique(a.doc[i] * (len(bytes_a) * width) + a.ids[i] * width + b.ids[j], return_counts=True)
                doc, pair = np.divmod(linked, len(bytes_a) * width)
                cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                pairs, held = np.unique(pair, return_counts=True)
                alone = pa.array([0] + [len(pairs)] * n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows], pa.array(np.full(n, block)), pa.array(a.counts), pa.array(b.counts), pa.array(np.bincount(a.doc[np.searchsorted(a.end, end)], minlength=n)), pa.array(np.bincount(a.doc[i], minlength=n)),
                        pa.array(groups(a, b, end), pa.string()), pa.ListArray.from_arrays(cuts, pa.array(pair)), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                        pa.ListArray.from_arrays(alone, pa.array(pairs)), pa.ListArray.from_arrays(alone, pa.array(held)),
                    ],
                    names=["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "block_pairs", "block_docs"],
                )
                block += 1

    return run


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Tokens, groups and linked ids of every row of ``docs`` (doc_id, text) under the files ``a`` and ``b``.

    ``groups`` holds both sides' ids; ``pairs`` the linked ids, an A id times B's vocabulary size plus a B id, once each, and
    ``times`` how often. ``block_pairs`` and ``block_docs``, on a block's first row, count the block's documents by pair. Texts
    that are null or empty, or that either side does not spell byte for byte (B turns U+2581 into a space), have no tokens. Repeated rows and null
    ids are rows like others; an empty table gives none; other columns are not read. A text is encoded whole, so a task
    holds the tokens of its longest text.
    """
    schema = "doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>, block_pairs array<long>, block_docs array<long>"
    return docs.select("doc_id", "text").mapInArrow(_aligned(a or default_tokenizer(), b or default_pieces()), schema)


def _answers(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block with the counts of its pairs."""
    order = np.argsort(counts.column("pair").to_numpy())
    known, count, best = (counts.column(c).to_numpy()[order] for c in ("pair", "count", "best"))
    pairs, times = rows.column("pairs").combine_chunks(), rows.column("times").combine_chunks()
    doc = np.repeat(np.arange(len(rows)), np.asarray(pairs.value_lengths()))
    at, often = np.searchsorted(known, np.asarray(pairs.flatten())), np.asarray(times.flatten()).astype(np.int64)
    sums = [np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)]
    for total, weight in zip(sums, (best, count)):
        np.add.at(total, doc, often * weight[at].astype(np.int64))
    return rows.drop_columns(["block", "pairs", "times"]).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))


def count_links(aligned: DataFrame, width: int, **shown: Column) -> DataFrame:
    """``align``'s rows with ``n_best`` (links whose pair is held by as many documents as any of its A id) and ``count_sum`` (their counts together).

    ``aligned`` is read once and written to the shared folder, with the ``shown`` columns; ``width`` is B's vocabulary size.
    """
    sizes = ["n_a", "n_b", "n_groups", "n_links"]
    rows = keep(aligned.select("doc_id", *sizes, *(c.alias(name) for name, c in shown.items()), "block", "pairs", "times", "block_pairs", "block_docs"), "aligned")
    asked = rows.where(F.size("block_pairs") > 0).select("block", F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("x")).select("block", F.col("x.block_pairs").alias("pair"), F.col("x.block_docs").alias("docs"))
    counts = keep(asked.groupBy("pair").agg(F.sum("docs").alias("count")), "pairs")
    first = F.expr(f"pair div {width}").alias("first")
    most = F.broadcast(counts.groupBy(first).agg(F.max("count").alias("most")))  # at most A's vocabulary
    told = asked.select("block", "pair").join(counts.hint("shuffle_merge"), "pair").withColumn("first", first).join(most, "first").select(F.col("block").alias("asking"), "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    schema = ", ".join(["doc_id long", *(f"{s} long" for s in sizes), *(f"{name} string" for name in shown), "n_best long, count_sum long"])
    found = keep(rows.drop("block_pairs", "block_docs").groupBy("block").cogroup(told.groupBy("asking")).applyInArrow(_answers, schema), "links")
    drop(rows, counts)
    return found


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the SHA-256 of the groups ('' without tokens) of every document."""
    import sentencepiece

    a, b = a or default_tokenizer(), b or default_pieces()
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256))
    return count_links(align(docs, a, b), sentencepiece.SentencePieceProcessor(model_file=b).vocab_size(), groups_sha256=digest)
