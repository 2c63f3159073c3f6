"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide link counts.

Tokenizer A is a byte-level BPE file, tokenizer B a sentencepiece file. Both end tokens at byte
offsets of a blank and the text; offsets where both end cut the tokens into groups, and the A and
the B token that end a group are linked. Groups of one token on each side whose identifiers an
identity map pairs (A identifier to the B identifier of the same bytes, computed once) are counted in
vectors as long as the vocabulary. Only the links of all other groups are counted as pairs by a
shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import pair, ship
from barloom.llm.word_bpe import Numbered
from barloom.session import materialize

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
BITS = 15
MASK = (1 << BITS) - 1
REMEMBERED_BYTES = 200 << 20
STEP = 1 << 20
COMMON_PAIRS = 50_000

CALL_BYTES = 1 << 16

# Neither tokenizer has a token over a place between a character that is no white space and a blank
# or line end; bytes C3 to DF begin no white space. A part runs to the first such place.
_SAFE = rb"(?:[\x21-\x7e]|[\xc3-\xdf][\x80-\xbf])"
_PART = re.compile(rb"[ \n]*[^ \n]*" + _SAFE + rb"(?=[ \n]|\Z)|[\x00-\xff]*?" + _SAFE + rb"(?=[ \n])|[\x00-\xff]+")


def _ends_safe(part: bytes) -> bool:
    return 0x21 <= part[-1] <= 0x7E or (len(part) > 1 and 0x80 <= part[-1] <= 0xBF and 0xC3 <= part[-2] <= 0xDF)


def _byte_of() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, the bytes of their identifiers and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(b_path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        # The blank is part of the parts that are encoded, so the model adds none.
        model.normalizer_spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        byte_of = _byte_of()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values(), default=0) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > MASK + 1 or len(self.a_bytes) > 1 << (31 - BITS):
            raise ValueError("the vocabularies do not fit a pair's 31 bits")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        # Where a piece could lie over a cut, texts are encoded whole.
        self.separable = not any(re.search("[^▁]▁|\n", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        own: dict[bytes, int] = {}
        for i, x in enumerate(self.b_bytes):
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (x not in own or self.b.is_byte(own[x])):
                own[x] = i
        self.same = np.array([own.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_names = [np.array([f"{i}{s}".encode() for i in range(len(self.a_bytes))], object) for s in ",|"]
        self.b_names = [np.array([f"{i}{s}".encode() for i in range(len(self.b_bytes))], object) for s in ",;"]


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


class Aligned:
    """Aligned parts of texts; parts met before are looked up, and a bounded number of bytes of them is remembered."""

    def __init__(self, v: Vocabularies, remembered: int = REMEMBERED_BYTES):
        self.v, self.remembered = v, remembered
        self._forget()

    def _forget(self) -> None:
        self.known = Numbered()
        self.held = 0
        self.text: list[bytes | None] = []
        self.sizes = np.zeros((1 << 12, 3), np.int64)  # tokens of A, tokens of B, links
        self.first = np.zeros(1 << 12, np.int64)
        self.links = np.zeros(1 << 14, np.int64)
        self.n_links = 0

    def parts(self, text: str) -> list[bytes]:
        data = (" " + text).encode()
        return _PART.findall(data) if self.v.separable else [data]

    def _encoded_a(self, parts: list[bytes], joined: int) -> np.ndarray:
        """A's identifiers of all parts one after another; the first ``joined`` parts go together in calls of some size."""
        calls, at, size = [], 0, 0
        for k in range(joined):
            size += len(parts[k])
            if size >= CALL_BYTES or k == joined - 1:
                calls.append(b"".join(parts[at : k + 1]).decode())
                at, size = k + 1, 0
        calls += [p.decode() for p in parts[joined:]]
        found = [e.ids for e in self.v.a.encode_batch_fast(calls, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))

    def learn(self, new: list[bytes]) -> None:
        """Align parts that were numbered just now, in the order of their numbers."""
        v = self.v
        base = len(self.text)
        safe = [self.v.separable and _ends_safe(p) for p in new]
        order = [k for k, yes in enumerate(safe) if yes] + [k for k, yes in enumerate(safe) if not yes]
        joined = sum(safe)
        parts = [new[k] for k in order]
        length = np.array([len(p) for p in parts], np.int64)
        part_end = np.cumsum(length)
        ids_a = self._encoded_a(parts, joined)
        end_a = np.cumsum(v.a_len[ids_a])
        whole = b"".join(parts)
        found = v.b.encode([p.decode() for p in parts], num_threads=1)
        nb = np.array([len(x) for x in found], np.int64)
        ids_b = np.fromiter(chain.from_iterable(found), np.int64, int(nb.sum()))
        bytes_b = np.add.reduceat(np.append(v.b_len[ids_b], 0), np.cumsum(nb) - nb) if len(nb) else nb
        good = (bytes_b == length) & (nb > 0)
        if b"".join(map(v.b_bytes.__getitem__, ids_b.tolist())) != whole:
            good &= np.array([b"".join(map(v.b_bytes.__getitem__, x)) == p for p, x in zip(parts, found, strict=True)], bool)
        if b"".join(map(v.a_bytes.__getitem__, ids_a.tolist())) != whole:
            one = [e.ids for e in v.a.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
            good &= np.array([b"".join(map(v.a_bytes.__getitem__, x)) == p for p, x in zip(parts, one, strict=True)], bool)
            na = np.array([len(x) for x in one], np.int64)
            ids_a = np.fromiter(chain.from_iterable(one), np.int64, int(na.sum()))
        else:
            na = np.diff(np.searchsorted(end_a, part_end, side="right"), prepend=0)
        # Only good parts from here on.
        ids_a, ids_b = ids_a[np.repeat(good, na)], ids_b[np.repeat(good, nb)]
        at = np.flatnonzero(good)
        na, nb, part_end = na[at], nb[at], np.cumsum(length[at])
        end_a, end_b = np.cumsum(v.a_len[ids_a]), np.cumsum(v.b_len[ids_b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        links = ids_a[last_a] << BITS | ids_b[last_b]
        # Both sides' names in the order of groups, A before B.
        names = np.empty(len(ids_a) + len(ids_b), object)
        in_a, in_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        before_b = np.cumsum(in_b) - in_b
        names_a, names_b = v.a_names[0][ids_a], v.b_names[0][ids_b]
        names_a[last_a] = v.a_names[1][ids_a[last_a]]
        names_b[last_b] = v.b_names[1][ids_b[last_b]]
        names[np.arange(len(ids_a)) + before_b[group_a]] = names_a
        names[np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]] = names_b
        names = names.tolist()
        ends = np.cumsum(na + nb).tolist()
        # Groups of a part: its own ends among the common ones.
        n_links = np.diff(np.searchsorted(both, part_end, side="right"), prepend=0)
        while len(self.sizes) < base + len(new):
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        while len(self.links) < self.n_links + len(links):
            self.links = np.concatenate((self.links, np.zeros_like(self.links)))
        self.links[self.n_links : self.n_links + len(links)] = links
        rows = base + np.array(order, np.int64)[at]
        self.sizes[base : base + len(new)] = 0
        self.sizes[rows] = np.column_stack((na, nb, n_links))
        self.first[rows] = self.n_links + np.cumsum(n_links) - n_links
        self.n_links += len(links)
        self.text += [None] * len(new)
        start = 0
        for row, end in zip(rows.tolist(), ends, strict=True):
            self.text[row] = b"".join(names[start:end])
            start = end
        self.held += 2 * len(whole) + 8 * len(links) + 12 * len(names) + 200 * len(new)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Sizes and group digests of each text; document, link and occurrences of each distinct link."""
        if self.held > self.remembered:
            self._forget()
        split = [self.parts(t) if t else [] for t in texts]
        lengths = np.array([len(p) for p in split], np.int64)
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        new, self.known.new = self.known.new, []
        if new:
            self.learn(new)
        doc = np.repeat(np.arange(len(texts)), lengths)
        digests, at = [], 0
        good = np.zeros(len(texts), bool)
        for k, n in enumerate(lengths.tolist()):
            own = [self.text[c] for c in codes[at : at + n].tolist()]
            at += n
            good[k] = n > 0 and None not in own
            digests.append(hashlib.sha256(b"".join(own)[:-1]).hexdigest() if good[k] else "")
        keep = good[doc]
        codes, doc = codes[keep], doc[keep]
        sizes = np.zeros((len(texts), 3), np.int64)
        for j in range(3):
            sizes[:, j] = np.bincount(doc, self.sizes[codes, j], len(texts)).astype(np.int64)
        n = self.sizes[codes, 2]
        spot = np.repeat(self.first[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, times = np.unique(np.repeat(doc, n) << 31 | self.links[spot], return_counts=True)
        return sizes, digests, key >> 31, key & ((1 << 31) - 1), times


def _lists(doc: np.ndarray, values: np.ndarray, n: int, kind) -> pa.Array:
    """A list for each of ``n`` documents from values in the order of documents."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


@lru_cache(maxsize=1)
def _worker(a_path: str, b_path: str) -> Aligned:
    return Aligned(vocabularies(a_path, b_path))


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, same, same_n, odd, odd_n) of every whole text.

    ``same`` holds A identifiers of links of the identity map and ``odd`` all other links as
    A identifier * 2**15 + B identifier, each once with its occurrences in the document. ``row`` tells
    repeated rows apart. Null and empty texts, and texts whose tokens do not give back a blank and the
    text, have no tokens: zeros, empty lists and an empty digest.
    """
    a_path = a_path or public_tokenizers.path(A_FILE)
    b_path = b_path or public_tokenizers.path(B_FILE)
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(a_path, b_path)
        for b in batches:
            sizes_of = np.diff(np.frombuffer(b.column("text").buffers()[1], np.int32)[b.column("text").offset :][: len(b) + 1]) if len(b) else np.zeros(0, np.int32)
            step = np.cumsum(sizes_of, dtype=np.int64) // STEP
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(b)] if len(b) else []
            for at, end in zip(edges, edges[1:]):
                part = b.slice(at, end - at)
                sizes, digests, doc, link, times = worker.batch(part.column("text").to_pylist())
                own_a = link >> BITS
                same = worker.v.same[own_a] == (link & MASK)
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), *(pa.array(sizes[:, j]) for j in (0, 1, 2, 2)), pa.array(digests, pa.string()),
                        _lists(doc[same], own_a[same], n, pa.int32()), _lists(doc[same], times[same], n, pa.int64()),
                        _lists(doc[~same], link[~same], n, pa.int32()), _lists(doc[~same], times[~same], n, pa.int64()),
                    ],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "odd", "odd_n"],
                )

    rows = pair(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(
        run,
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "same array<int>, same_n array<long>, odd array<int>, odd_n array<long>",
    )


def identity_counts(table: DataFrame, size: int) -> np.ndarray:
    """Corpus-wide occurrences of each A identifier's identity link, summed as vectors on the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            at = b.column("same").flatten().to_numpy()
            np.add.at(total, at, b.column("same_n").flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["a", "n"])

    found = table.select("same", "same_n").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("a").to_numpy()] = found.column("n").to_numpy()
    return out


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, common: int = COMMON_PAIRS) -> DataFrame:
    """Per row of ``docs``: its token, group and link numbers, group digest, and its links' corpus-wide counts.

    ``n_best`` are links whose count is the highest of any link of their B identifier, ties included;
    ``count_sum`` adds the counts of all links. The ``common`` most frequent irregular pairs are looked
    up from a broadcast table of that many rows; all rarer ones, none of which can be a hot key, are
    joined by a shuffle. Repeated rows are documents of their own and an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    a_path = a_path or public_tokenizers.path(A_FILE)
    b_path = b_path or public_tokenizers.path(B_FILE)
    spark = docs.sparkSession
    v = vocabularies(a_path, b_path)
    table = materialize(aligned(docs, a_path, b_path), "aligned")
    regular = identity_counts(table, len(v.a_bytes))
    odd = table.select(F.explode(F.arrays_zip("odd", "odd_n")).alias("p")).select(F.col("p.odd").alias("pair"), F.col("p.odd_n").alias("n"))
    pairs = materialize(odd.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")
    # At most one row for each B identifier.
    most = pairs.groupBy(F.col("pair").bitwiseAND(F.lit(MASK)).alias("b")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(len(v.b_bytes), np.int64)
    best[most.column("b").to_numpy()] = most.column("n").to_numpy()
    mapped = v.same >= 0
    np.maximum.at(best, v.same[mapped], regular[mapped])
    top = pairs.orderBy(F.desc("n"), "pair").limit(common).toArrow()
    order = np.argsort(top.column("pair").to_numpy(), kind="stable")
    top_pair, top_n = (top.column(c).to_numpy()[order].astype(np.int64) for c in ("pair", "n"))
    held = spark.sparkContext.broadcast((regular, regular > 0, v.same, best, top_pair, top_n))

    def lookup(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = held.value[4], held.value[5]
        if not len(keys):
            return np.zeros(len(link), bool), np.zeros(len(link), np.int64)
        at = np.minimum(np.searchsorted(keys, link), len(keys) - 1)
        found = keys[at] == link
        return found, np.where(found, counts[at], 0)

    def flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, times = (b.column(c).flatten().to_numpy().astype(np.int64) for c in (name, f"{name}_n"))
        return np.repeat(np.arange(len(b)), b.column(name).value_lengths().to_numpy()), values, times

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regular, _, same, best, _, _ = held.value
        for b in batches:
            doc, a, times = flat(b, "same")
            n = np.zeros((2, len(b)), np.int64)
            np.add.at(n[1], doc, times * regular[a])
            np.add.at(n[0], doc, times * (regular[a] == best[same[a]]))
            doc, link, times = flat(b, "odd")
            found, count = lookup(link)
            np.add.at(n[1], doc, times * count)
            np.add.at(n[0], doc, times * (found & (count == best[link & MASK])))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), pa.array(n[0]), pa.array(n[1])],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"],
            )

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, link, times = flat(b, "odd")
            rest = ~lookup(link)[0]
            rows = b.column("row").to_numpy()[doc[rest]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(link[rest], pa.int32()), pa.array(times[rest])], names=["row", "pair", "times"]
            )

    base = table.mapInArrow(
        known,
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long",
    )
    # One row for each B identifier at most.
    highest = spark.createDataFrame(pa.table({"b": pa.array(np.flatnonzero(best).astype(np.int32)), "highest": pa.array(best[best > 0])})) if best.any() else spark.createDataFrame([], "b int, highest long")
    counted = pairs.join(F.broadcast(highest), F.col("pair").bitwiseAND(F.lit(MASK)) == F.col("b"))
    counted = counted.select("pair", "n", (F.col("n") == F.col("highest")).alias("is_best"))
    rest = table.select("row", "odd", "odd_n").mapInArrow(rare, "row long, pair int, times long").join(counted, "pair")
    rest = rest.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    out = base.join(rest, F.col("row") == F.col("_row"), "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
