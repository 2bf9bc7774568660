"""Retrieval packing: documents fill fixed windows after a seed's nearest texts.

Documents are tokenized once into shared scratch. They are dealt to shards by a minimum hash
of their tokens, copies next to each other, ties by id. Each shard indexes its documents with
BM25, by document frequencies and the mean length of the whole corpus; every window starts
with a seed (the rest of the document cut before, or the next unused one) and takes the seed's
best unused neighbours until it is full; the last one is cut and leads the next window. The
rest of a shard is cut into sequences of a power of two, so no sequence has padding.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialise, mix64, released, signed, slices

WINDOW = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 2_000_000
K1, B = 1.2, 0.75
# Words of which a task remembers the ids; two generations of this size are kept.
CACHE_WORDS = 450_000
# Neighbours of a seed that are sorted at once.
HEAD = 64
# Words encoded as one text.
GROUP_WORDS = 200

# A word of Latin letters and then these marks: its ids are those of both parts, and case goes.
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_LATIN_START = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+"
_LATIN = _LATIN_START + r"\z"


class WordIds:
    """Ids of texts, word by word: white space ends every token of this vocabulary, so a text's
    ids are those of its words in order. A slice's distinct words are found by Arrow, and only
    those not met before are encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 65,535 do not fit")
        self.bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.new[word] = array("H", found.ids).tobytes()

    def _encode_letters(self, words: list[str]) -> None:
        """As ``_encode`` for words of letters, many in one text with bars between, which stay ids of their own."""
        groups = [words[k : k + GROUP_WORDS] for k in range(0, len(words), GROUP_WORDS)]
        encoded = self.tokenizer.encode_batch_fast([" | ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, encoded, strict=True):
            ids = np.array(found.ids + self.bar, np.uint16)
            ends = np.flatnonzero(ids == self.bar[0])
            if len(self.bar) != 1 or len(ends) != len(group):
                self._encode(group)
                continue
            raw, low = ids.tobytes(), 0
            for word, high in zip(group, (ends * 2).tolist(), strict=True):
                self.new[word] = raw[low:high]
                low = high + 2

    def _absent(self, words: Iterable[str]) -> list[str]:
        """Words to encode; those of the old generation move to the new one."""
        new, old, out = self.new, self.old, []
        for word in words:
            if word not in new:
                found = old.get(word)
                if found is None:
                    out.append(word)
                else:
                    new[word] = found
        return out

    def _ids(self, words: pa.Array, letters: bool) -> list[bytes]:
        # by way of numpy: a list of Arrow's values makes an object of each first
        words = words.to_numpy(zero_copy_only=False).tolist()
        absent = self._absent(words)
        (self._encode_letters if letters else self._encode)(absent)
        return list(map(self.new.__getitem__, words))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and the place after each text's last one."""
        spaced = pc.replace_substring(pc.replace_substring(column, "\n", " "), "\t", " ")
        split = pc.split_pattern(spaced, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        # a word is two parts: letters in small case and the marks after them, or all of it and nothing
        cores = pc.utf8_rtrim(words, _MARKS)
        plain = pc.match_substring_regex(cores, _LATIN)
        marks = pc.replace_substring_regex(pc.if_else(plain, words, ""), _LATIN_START, "").dictionary_encode()
        cores = pc.utf8_lower(pc.if_else(plain, cores, "")).dictionary_encode()
        others = pc.if_else(plain, "", words).dictionary_encode()
        parts, known, at = [], [], 0
        for part, letters in ((cores, True), (others, False), (marks, False)):
            # the empty text stands where a part is absent, and has no ids
            found = self._ids(part.dictionary, letters)
            known += found
            parts.append(part.indices.to_numpy() + at)
            at += len(found)
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        flat = np.frombuffer(b"".join(known), np.uint16)
        by_word, ends = _runs(flat, sizes, np.stack(parts, axis=1).ravel())
        word_ends = ends[len(parts) - 1 :: len(parts)]
        ids, ends = _runs(by_word, np.diff(word_ends, prepend=0), coded.indices.to_numpy())
        places = np.cumsum(pc.list_value_length(split).to_numpy())
        return ids, np.append(0, ends)[places]


def _runs(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values``, one after the other, in the order of ``which``; and where each ends."""
    first, lengths = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - ends + lengths, lengths)
    return values[at], ends


_WORD_IDS: dict[str, WordIds] = {}


def word_ids_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return path


def word_ids(path: str | None) -> WordIds:
    path = word_ids_path(path)
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def forget_word_ids() -> None:
    """Drop what this worker remembers. Called by name: a function inside another travels with copies of the globals it names."""
    _WORD_IDS.clear()


def _lexical_keys(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text the least hash of three consecutive ids; of what there is, for shorter texts."""
    flat = ids.astype(np.uint64)
    x = flat.copy()
    x[1:] |= flat[:-1] << np.uint64(16)
    x[2:] |= flat[:-2] << np.uint64(32)
    h = mix64(x)
    lengths = np.diff(ends, prepend=0)
    starts = ends - lengths
    for k in (0, 1):  # threes that reach into the text before do not count
        at = starts[lengths > 2] + k
        h[at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    short = starts[lengths <= 2]
    h[short] = mix64(flat[short])
    for at in starts[lengths == 2] + 1:
        h[at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return signed(np.minimum.reduceat(h, starts))


def tokenized(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n, key, ids): little-endian 16-bit ids with the end id; a null text has only that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                ids, ends = words.texts(part.column("text"))
                ids, ends = np.insert(ids, ends, END_ID), ends + np.arange(1, len(ends) + 1)
                offsets = pa.py_buffer(np.append(0, ends * 2).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(np.diff(ends, prepend=0)), pa.array(_lexical_keys(ids, ends)),
                        pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(ids)]),
                    ],
                    names=["doc_id", "n", "key", "ids"],
                )

    chosen = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n long, key long, ids binary")


class Corpus(NamedTuple):
    """What BM25 takes from all documents: how many there are, their mean length, and how many hold each id."""

    rows: int
    mean_length: float
    frequency: np.ndarray


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """How many rows of ``tokens`` hold each id; at most 65,536 sums, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_word_ids()  # they have served
        found = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 22):
                sizes = pc.binary_length(part.column("ids")).to_numpy() // 2
                ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), np.uint16).astype(np.int64)
                pairs = np.sort((np.repeat(np.arange(len(sizes)), sizes) << 16) | ids)
                first = np.append(True, pairs[1:] != pairs[:-1])
                found += np.bincount(pairs[first] & 0xFFFF, minlength=1 << 16)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], names=["id", "df"])

    sums = tokens.select("ids").mapInArrow(released(run), "id long, df long").groupBy("id").agg(F.sum("df").alias("df"))
    out = np.zeros(1 << 16, np.int64)
    for row in sums.collect():
        out[row.id] = row.df
    return out


class Shard:
    """BM25 over the documents of one shard, weighed by the whole corpus (or by the shard, where
    none is given); ``order()`` is the order in which they are packed."""

    def __init__(self, ids: list[np.ndarray], corpus: Corpus | None = None):
        self.lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64)
        pairs = np.sort((np.repeat(np.arange(len(ids)), self.lengths) << 16) | flat)
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        tf = np.diff(np.append(first, len(pairs)))
        self.row, self.term = pairs[first] >> 16, pairs[first] & 0xFFFF
        df = np.bincount(self.term, minlength=1 << 16)
        corpus = corpus or Corpus(len(ids), self.lengths.mean(), df)
        idf = np.log1p((corpus.rows - corpus.frequency + 0.5) / (corpus.frequency + 0.5))
        length = self.lengths[self.row] / corpus.mean_length
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        self.shared = df[self.term] > 1
        self.first_term = np.searchsorted(self.row, np.arange(len(ids) + 1))
        # an id that at least a quarter of the documents hold has a whole row of weights, any other a list
        whole = np.flatnonzero(4 * df >= len(ids))
        self.whole = np.full(1 << 16, -1)
        self.whole[whole] = np.arange(len(whole))
        at = self.whole[self.term]
        self.rows = np.zeros((len(whole), len(ids)))
        self.rows[at[at >= 0], self.row[at >= 0]] = self.weight[at >= 0]
        by_term = np.argsort(self.term, kind="stable")
        self.posted, self.posted_weight = self.row[by_term], self.weight[by_term]
        self.first_post = np.searchsorted(self.term[by_term], np.arange((1 << 16) + 1))
        self.used = np.zeros(len(ids), bool)

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share any term of the seed, best first; the rest is sorted when it is asked for."""
        low, high = self.first_term[seed], self.first_term[seed + 1]
        terms = self.term[low:high][self.shared[low:high]]
        dense = self.whole[terms]
        terms = terms[dense < 0]
        starts = self.first_post[terms]
        counts = self.first_post[terms + 1] - starts
        ends = np.cumsum(counts)
        at = np.arange(counts.sum()) + np.repeat(starts - ends + counts, counts)
        scores = self.rows[dense[dense >= 0]].sum(axis=0)
        scores += np.bincount(self.posted[at], self.posted_weight[at], len(self.used))
        scores[self.used] = 0.0
        found = np.flatnonzero(scores)
        while len(found) > HEAD:
            edge = np.partition(scores[found], -HEAD)[-HEAD]
            best = scores[found] >= edge
            head, found = found[best], found[~best]
            yield from head[np.argsort(-scores[head], kind="stable")].tolist()
        yield from found[np.argsort(-scores[found], kind="stable")].tolist()

    def order(self, window: int = WINDOW) -> list[int]:
        out: list[int] = []
        filled, seed, waiting, upcoming = 0, None, iter(()), 0
        while len(out) < len(self.used):
            chosen = None
            if seed is not None:
                if waiting is None:
                    waiting = self.neighbours(seed)
                chosen = next((d for d in waiting if not self.used[d]), None)
            if chosen is None:
                while self.used[upcoming]:
                    upcoming += 1
                chosen = upcoming
                if seed is None:
                    seed, waiting = chosen, None
            self.used[chosen] = True
            out.append(int(chosen))
            filled += int(self.lengths[chosen])
            if filled >= window:
                filled %= window
                seed, waiting = (chosen, None) if filled else (None, None)
        return out


def cuts(total: int, window: int = WINDOW) -> np.ndarray:
    """Places where sequences end: full windows, then powers of two for what is left."""
    ends = list(range(window, total + 1, window))
    at = total - total % window
    for k in range(window.bit_length() - 1, -1, -1):
        if (total - at) & (1 << k):
            at += 1 << k
            ends.append(at)
    return np.array(ends, np.int64)


def _pack(window: int, with_ids: bool, corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_word_ids()  # they have served
        doc_ids, ids = [], []
        for batch in batches:
            doc_ids += batch.column("doc_id").to_pylist()
            ids += [np.frombuffer(b, np.uint16).copy() for b in batch.column("ids").to_pylist()]
        if not ids:
            return
        shard = Shard(ids, corpus)
        order = np.array(shard.order(window))
        starts = np.append(0, np.cumsum(shard.lengths[order]))
        ends = cuts(int(starts[-1]), window)
        edges = np.unique(np.concatenate([starts, ends]))
        begin, length = edges[:-1], np.diff(edges)
        place = np.searchsorted(starts, begin, "right") - 1
        sequence = np.searchsorted(ends, begin, "right")
        offset = begin - np.append(0, ends)[sequence]
        docs = order[place]
        start = begin - starts[place]
        base = TaskContext.get().partitionId() << 40
        pieces = [ids[d][s : s + n].astype("<u4") for d, s, n in zip(docs, start, length, strict=True)]
        columns = {
            "doc_id": pa.array([doc_ids[d] for d in docs], pa.int64()),
            "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
            "doc_tokens": pa.array(shard.lengths[docs], pa.int64()),
            "sequence_id": pa.array(base + sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(columns)

    return run


def pack(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    with_ids: bool = True, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    Every id of every row lies in one piece; repeated rows are packed as often as they occur.
    Documents without an id keep a null one; a null text counts as empty and has the end id only.
    A text of any length is tokenized whole and cut where windows end; ties of score go to the
    document first by hash. An empty table gives no pieces. Columns other than the two named are
    not read. ``window`` must be a power of two. ``tokenizer`` is the path of a vocabulary of at
    most 65,536 ids whose tokens end at white space and case-folded words of letters.
    """
    tokens = materialise(tokenized(documents, doc_id, text, tokenizer), "packing-tokens")
    total, rows = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(1, min(rows, -(-total // shard_tokens)))
    corpus = Corpus(rows, total / max(1, rows), document_frequencies(tokens))
    dealt = tokens.withColumn("tie", F.xxhash64("doc_id")).repartitionByRange(shards, "key", "tie")
    ordered = dealt.sortWithinPartitions("key", "tie", "doc_id", "n").select("doc_id", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ordered.mapInArrow(_pack(window, with_ids, corpus), schema + (", ids array<int>" if with_ids else ""))
