"""LM scoring by a subword lattice: a text's probability is the sum over all its segmentations.

The pieces and their first scores are those of an existing vocabulary. Rounds of expected
counts over all training words fit the scores to the corpus. A word's log probability comes
from a forward recursion in log space over every way to cut it into pieces; a text's is the
sum over its words and one end. Lattices are solved once per distinct word, for all words of
a length at once.

Word values reach the texts in two ways. Words at least as frequent as one in FREQUENT of all
tokens, so at most FREQUENT of them, are broadcast; occurrences of all others are exchanged
and joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Words, materialise, mix64, signed, slices, words_of

PIECES = "piece_bpe_32k.model"
FREQUENT = 1_000_000
PRIOR = 0.1
ROUNDS = 2
UPPER, LOWER_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START = "▁"  # the sign of a word's start in the vocabulary
_BASE = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 200_000  # cells of a group of words solved together


class Pieces:
    """Pieces with log weights, found by a hash of their code points."""

    def __init__(self, pieces: list[str], weights: np.ndarray):
        self.bytes = np.full(256, -1)
        texts, places = [], []
        for k, piece in enumerate(pieces):
            if len(piece) == 6 and piece.startswith("<0x"):
                self.bytes[int(piece[3:5], 16)] = k
            elif piece and not (piece.startswith("<") and piece.endswith(">") and len(piece) > 2):
                texts.append(piece)
                places.append(k)
        hashes = np.array([self.hash(t) for t in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], np.array(places)[order]
        self.longest = max(map(len, texts))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.log = weights

    @staticmethod
    def hash(text: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = h * _BASE + np.uint64(ord(c) + 1)
        return mix64(h)[0]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each piece, -1 for what is none."""
        out = np.full(hashes.shape, -1, np.int64)
        maybe = self.sieve[(hashes >> np.uint64(44)).astype(np.int64)]
        wanted = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == wanted, self.places[at], -1)
        return out

    def edges(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per piece length: (place, log weight) of every substring of ``codes`` [words, length].

        A character that is no piece stands for its UTF-8 bytes: place -1, weight of the bytes.
        """
        out, h = [], np.zeros(codes.shape, np.uint64)
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            if length > 1:
                h = h[:, :-1]
            h = h * _BASE + (codes[:, length - 1 :] + np.uint64(1))
            place = self.find(mix64(h))
            weight = np.where(place >= 0, self.log[place], -np.inf)
            if length == 1 and (place < 0).any():
                lost = np.unique(codes[place < 0])
                cost = np.array([sum(self.log[self.bytes[b]] for b in chr(int(c)).encode("utf-8", "surrogatepass")) for c in lost])
                weight[place < 0] = cost[np.searchsorted(lost, codes[place < 0])]
            out.append((place, weight))
        return out

    def forward(self, edges, size: int, rows: int) -> np.ndarray:
        """Log probability of every prefix [rows, size + 1], over all segmentations."""
        alpha = np.full((rows, size + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, size + 1):
            terms = np.stack([alpha[:, j - n] + edges[n - 1][1][:, j - n] for n in range(1, min(len(edges), j) + 1)])
            top = terms.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha

    def backward(self, edges, size: int, rows: int) -> np.ndarray:
        beta = np.full((rows, size + 1), -np.inf)
        beta[:, size] = 0.0
        for i in range(size - 1, -1, -1):
            terms = np.stack([beta[:, i + n] + edges[n - 1][1][:, i] for n in range(1, min(len(edges), size - i) + 1)])
            top = terms.max(axis=0)
            beta[:, i] = top + np.log(np.exp(terms - top).sum(axis=0))
        return beta


def _groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length together: (indices, code points [words, length])."""
    marked = [START + w for w in words]
    lengths = np.array([len(w) for w in marked])
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, edges):
        if not len(same):
            continue
        length = int(lengths[same[0]])
        step = max(1, _CHUNK // length)
        for low in range(0, len(same), step):
            part = same[low : low + step]
            flat = "".join(marked[i] for i in part).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(flat, np.uint32).reshape(len(part), length).astype(np.uint64)


def word_scores(words: list[str], pieces: Pieces) -> np.ndarray:
    """Log probability of each word over all its segmentations."""
    out = np.empty(len(words))
    for at, codes in _groups(words):
        out[at] = pieces.forward(pieces.edges(codes), codes.shape[1], len(at))[:, -1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected occurrences of each piece in words that occur ``counts`` times."""
    out = np.zeros(len(pieces.log))
    for at, codes in _groups(words):
        rows, size = codes.shape
        edges = pieces.edges(codes)
        alpha, beta = pieces.forward(edges, size, rows), pieces.backward(edges, size, rows)
        for n, (place, weight) in enumerate(edges, 1):
            share = np.exp(alpha[:, : size - n + 1] + weight + beta[:, n:] - alpha[:, -1:]) * counts[at][:, None]
            known = place >= 0
            out += np.bincount(place[known], weights=share[known], minlength=len(out))
            if n == 1 and not known.all():
                for code, amount in zip(codes[~known], share[~known], strict=True):
                    for b in chr(int(code)).encode("utf-8", "surrogatepass"):
                        out[pieces.bytes[b]] += amount
    return out


def vocabulary(path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Pieces of the existing vocabulary and log weights from its scores.

    The file's scores are minus the rank of a piece; weights fall with the rank as word
    frequencies do. Byte pieces, which have no rank, weigh like the last one.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    rank = np.array([-model.get_score(k) for k in range(len(pieces))])
    unranked = np.array([p.startswith("<") and p.endswith(">") and len(p) > 2 for p in pieces])
    weight = 1.0 / (np.where(unranked, len(pieces), np.minimum(rank, len(pieces))) + 10.0)
    return pieces, np.log(weight / weight.sum())


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER_)


def word_counts(documents: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """(word, n, c): occurrences of each word in all texts and in training texts."""
    words = documents.select(training.cast("int").alias("t"), F.explode(words_of(lowered(F.col(text)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.sum("t").alias("c"))


def fit(counts: DataFrame, ends: int, path: str | None = None) -> tuple[list[str], np.ndarray, float]:
    """Pieces, fitted log weights and the log probability of the end, from training counts.

    What comes to the driver has one row per piece of the vocabulary.
    """
    pieces, weights = vocabulary(path)
    end = 0.0
    for _ in range(ROUNDS):

        def run(batches, weights=weights):
            table, total = Pieces(pieces, weights), np.zeros(len(pieces))
            for batch in batches:
                total += expected_counts(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float), table)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int32()), "amount": pa.array(total[at])})

        found = counts.where("c > 0").select("word", "c").mapInArrow(run, "piece int, amount double")
        rows = found.groupBy("piece").agg(F.sum("amount").alias("amount")).toPandas()
        amount = np.full(len(pieces), PRIOR)
        amount[rows["piece"].to_numpy()] += rows["amount"].to_numpy()
        whole = amount.sum() + max(ends, PRIOR)
        weights, end = np.log(amount / whole), math.log(max(ends, PRIOR) / whole)
    return pieces, weights, end


def score_texts(documents: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    ``training`` marks the documents to learn from. Null texts are empty: one end token.
    Repeated rows are scored and counted as often as they occur. Without training documents
    all words are unknown and pieces keep their prior.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), training.alias("training"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = materialise(word_counts(docs, F.col("training")), "lattice-counts")
    ends = docs.where("training").count()
    n, c, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    train_tokens, v = c + ends, types + (ends > 0)
    floor = math.log10(train_tokens + 0.5 * (v + 1))
    pieces, weights, end = fit(counts, ends, vocabulary_path)
    fitted = spark.sparkContext.broadcast((pieces, weights))

    def solve(batches):
        table = Pieces(*fitted.value)
        for batch in batches:
            words, known = batch.column("word"), batch.column("c").to_numpy()
            hashes = Words(words).hashes()
            yield pa.RecordBatch.from_pydict(
                {"h": pa.array(signed(hashes)), "n": batch.column("n"), "known": pa.array((known > 0).astype(np.int64)),
                 "base": pa.array(np.log10(known + 0.5) - floor), "lattice": pa.array(word_scores(words.to_pylist(), table) / math.log(10))}
            )

    values = materialise(counts.mapInArrow(solve, "h long, n long, known long, base double, lattice double"), "lattice-words")
    least = max(1, -(-n // FREQUENT))
    common = values.where(F.col("n") >= least).select("h", "known", "base", "lattice").toPandas().sort_values("h")  # FREQUENT rows at most
    shared = spark.sparkContext.broadcast([common[c].to_numpy() for c in ("h", "known", "base", "lattice")])
    end_base, end_lattice, end_known = math.log10(ends + 0.5) - floor, end / math.log(10), int(ends > 0)

    def look_up(batches):
        h, known, base, lattice = shared.value
        names = ["row", "doc_id", "held_out", "whole", "h", "n_tokens", "n_known", "base", "lattice"]
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows = Words(part.column("text"), lower=True), part.num_rows
                hashes = signed(words.hashes())
                at = np.minimum(np.searchsorted(h, hashes), max(len(h) - 1, 0))
                hit = h[at] == hashes if len(h) else np.zeros(len(hashes), bool)
                total = lambda v: np.bincount(words.row[hit], weights=v[at[hit]], minlength=rows)  # noqa: E731, B023
                ids = part.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(~np.array(part.column("training").to_pylist(), bool)), pa.array(np.ones(rows, bool)),
                     pa.array(signed(mix64(ids.view(np.uint64)))), pa.array(np.diff(words.first) + 1), pa.array(total(known).astype(np.int64) + end_known),
                     pa.array(total(base) + end_base), pa.array(total(lattice) + end_lattice)],
                    names=names,
                )
                rest, count = words.row[~hit], int((~hit).sum())
                if count:
                    zero = pa.array(np.zeros(count, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[rest]), pa.nulls(count, part.column("doc_id").type), pa.nulls(count, pa.bool_()), pa.array(np.zeros(count, bool)),
                         pa.array(hashes[~hit]), zero, zero, pa.array(np.zeros(count)), pa.array(np.zeros(count))],
                        names=names,
                    )

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = numbered.select("row", "doc_id", "training", "text").mapInArrow(
        look_up, f"row long, doc_id {kind}, held_out boolean, whole boolean, h long, n_tokens long, n_known long, base double, lattice double"
    )
    rare = values.where(F.col("n") < least).select(F.col("h").alias("wh"), "known", F.col("base").alias("wb"), F.col("lattice").alias("wl"))
    # rows of whole texts travel under a hash of their own and match no word
    met = parts.join(rare, (parts["h"] == rare["wh"]) & ~parts["whole"], "left")
    return met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + F.coalesce("wb", F.lit(0.0))).alias("base_score"),
        F.sum(F.col("lattice") + F.coalesce("wl", F.lit(0.0))).alias("score"),
    ).drop("row")
