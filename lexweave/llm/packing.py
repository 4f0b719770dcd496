"""Packing by lexical retrieval.

A document's ids are cut into full windows, which need no company, and a remainder. Remainders are
dealt to shards of bounded size by content: a tree, learned from a bounded sample of remainders, splits
them along the direction in which their weighted ids differ most, so lexical neighbours tend
to fall into one leaf. Leaves that hold more than a shard are split again. Each shard keeps a BM25 inverted index over all ids of its
remainders but the end id; ids that many remainders hold are kept as dense rows. The longest unused
remainder opens a sequence and queries the index; its unused neighbours fill the window greedily, best
score first, and what is left open goes to the largest remainders that still fit.

Tokenising runs once: texts are split at ASCII white space, which no pre-token crosses, and each
distinct chunk is encoded once and kept in a bounded cache. A chunk's pre-tokens go through a byte-pair
encoder with the vocabulary's merges as ranks, a zero byte standing for the word end; rare characters
take the tokenizer file's own path.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

WINDOW, END_ID, SHARD_ROWS = 4096, 2, 4096
_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """The ids of chunks without white space, as little-endian 32-bit bytes."""

    #: The pre-token pattern of the vocabulary file (a fixed value).
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, most_cached: int = 800_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

        def raw(token: str) -> bytes:
            body, end = (token[:-4], b"\0") if token.endswith("</w>") else (token, b"")
            return bytes(byte_of[c] for c in body) + end

        vocab, ranks, ids = model["vocab"], {}, []
        by_bytes = {}
        for token, k in vocab.items():
            if not token.startswith("<|") and "\0" not in (b := raw(token).decode("latin-1"))[:-1]:
                by_bytes.setdefault(b.encode("latin-1"), k)

        def add(b: bytes) -> None:
            if b not in ranks:
                ranks[b] = len(ids)
                ids.append(by_bytes.get(b, -1))

        for b in range(256):
            add(bytes([b]))
        for b in range(1, 256):
            add(bytes([b, 0]))
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if left + right in vocab and 0 not in (b := raw(left + right))[:-1]:
                add(b)
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.id_of = np.array(ids, np.int64)
        self.gap = ranks[b"\x01\0"]
        self.find = regex.compile(self.PIECES).findall
        self.odd = regex.compile(r"[\x00\x01ɐ-\U0010FFFF\x1c-\x1f\x85\xa0]|<\|").search
        self.cache: dict[bytes, bytes] = {}
        self.most_cached = most_cached

    def learn(self, chunks: list[bytes]) -> None:
        """Encode chunks that the cache lacks: all in one string, a lone \\x01 between them."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        if self.odd("".join(texts)):
            odd = [k for k, s in enumerate(texts) if self.odd(s)]
            for k, found in zip(odd, self.slow.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False), strict=True):
                self.cache[chunks[k]] = np.array(found.ids, "<u4").tobytes()
                texts[k] = ""
            chunks = [c for c, s in zip(chunks, texts, strict=True) if s]
            texts = [s for s in texts if s]
        if not texts:
            return
        # a chunk of letters is one piece; the others are cut by the pattern
        texts = " \x01 ".join(texts).lower().split(" \x01 ")
        letters = [s.isalpha() for s in texts]
        other = [s for s, plain in zip(texts, letters, strict=True) if not plain]
        chunks = [*compress(chunks, letters), *(c for c, plain in zip(chunks, letters, strict=True) if not plain)]
        pieces = [x for s in compress(texts, letters) for x in (s, "\x01")]
        pieces = pieces + self.find(" \x01 ".join(other)) if other else pieces[:-1]
        ranks = np.array(self.fast.encode_ordinary("\0".join(pieces) + "\0"), np.int64)
        gaps = 4 * np.flatnonzero(ranks == self.gap)
        body = self.id_of[ranks].astype("<u4").tobytes()
        starts, ends = [0, *(gaps + 4).tolist()], [*gaps.tolist(), len(body)]
        self.cache.update(zip(chunks, [body[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each text. Its chunks are numbered once for all texts, so the cache is asked for distinct
        ones only, and ids are gathered by number."""
        if not raws:
            return []
        if len(self.cache) > self.most_cached:
            self.cache.clear()
        self.cache[b""] = b""  # white space at either end
        lowered = pa.array([r.lower() if b"<|" not in r else r for r in raws], pa.large_binary())
        words = pc.ascii_split_whitespace(pc.cast(lowered, pa.large_string(), safe=False))
        coded = words.flatten().dictionary_encode()
        chunks = pc.cast(coded.dictionary, pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, chunks))
        if None in found:
            self.learn([c for c, ids in zip(chunks, found, strict=True) if ids is None])
            found = list(map(self.cache.__getitem__, chunks))
        flat, size = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) >> 2 for x in found], np.int64)
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - (ends - n), n) + np.arange(int(n.sum()))]
        cut = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


_PIECE = pa.struct([("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64())])
_CUT = "doc_id long, doc_tokens long, full array<struct<start:long,length:int,crc:long>>, start long, length int, crc long, terms binary"


def _cut(path: str, window: int, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            raws, out, lo = texts_of(batch.column(1)), [], 0
            while lo < len(raws):  # about four megabytes of text at a time
                hi, size = lo, 0
                while hi < len(raws) and (hi == lo or size + len(raws[hi]) < 1 << 22):
                    size += len(raws[hi])
                    hi += 1
                for body in known.encode(raws[lo:hi]):
                    body += tail
                    n = len(body) // 4
                    whole = n // window * window
                    full = [{"start": s, "length": window, "crc": zlib.crc32(body[4 * s : 4 * (s + window)])} for s in range(0, whole, window)]
                    rest = body[4 * whole :]
                    ids, tf = np.unique(np.frombuffer(rest, "<u4")[:-1], return_counts=True)
                    terms = np.stack([ids, tf]).astype("<u4").tobytes() if n > whole else None
                    out.append((n, full, whole if n > whole else None, n - whole if n > whole else None, zlib.crc32(rest) if n > whole else None, terms))
                lo = hi
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.list_(_PIECE), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "doc_tokens", "full", "start", "length", "crc", "terms"])

    return mapped


def _flat(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and count of every posting."""
    own = [np.frombuffer(t, "<u4").reshape(2, -1) for t in terms]
    row = np.repeat(np.arange(len(own)), [o.shape[1] for o in own])
    return row, np.concatenate([np.zeros(0, np.uint32), *[o[0] for o in own]]).astype(np.int64), np.concatenate([np.zeros(0, np.uint32), *[o[1] for o in own]]).astype(np.float64)


class Router:
    """A binary tree over remainders. Ids are weighted by inverse document frequency in the sample and
    hashed to `DIMS` places. A node is a direction, the one its sample rows differ most in, and the cut along
    it that leaves the two sides least spread; neither side gets under a tenth of the rows."""

    DIMS = 2048

    def __init__(self, terms: list[bytes], share: float, least: int = 32):
        """Nodes are split while they hold more than `share` of the sample, and twice `least` rows."""
        self.child: list[tuple[int, int] | None] = [None]
        self.direction, self.cut = np.zeros((1, self.DIMS), np.float32), [0.0]
        row, ids, tf = _flat(terms)
        self.known, inverse = np.unique(ids, return_inverse=True)
        self.idf = np.log((len(terms) + 1) / (np.bincount(inverse) + 0.5)) if len(ids) else np.zeros(0)
        self.rare = float(np.log(2 * (len(terms) + 1)))
        place, weight = self._weighted(row, ids, tf, len(terms))
        x = np.zeros((len(terms), self.DIMS), np.float32)
        np.add.at(x, (row, place), weight)
        directions, rng, todo = [self.direction[0]], np.random.default_rng(1), [(0, np.arange(len(terms)))]
        while todo:
            k, own = todo.pop()
            if len(own) <= max(share * len(terms), 2 * least):
                continue
            here = x[own] - x[own].mean(0)
            v = rng.normal(size=self.DIMS).astype(np.float32)
            for _ in range(12):
                v = here.T @ (here @ v)
                v /= np.linalg.norm(v) + 1e-12
            along = np.sort(x[own] @ v)
            low, high = max(1, len(own) // 10), len(own) - max(1, len(own) // 10)
            ahead = np.cumsum(along)
            i = np.arange(low, high + 1)
            between = (ahead[i - 1] / i - (ahead[-1] - ahead[i - 1]) / (len(own) - i)) ** 2 * i * (len(own) - i)
            between[along[i] == along[i - 1]] = -1  # equal rows stay together
            if between.max() <= 0:
                continue
            at = i[between.argmax()]
            directions[k], self.cut[k] = v, float(along[at - 1] + along[at]) / 2
            right = x[own] @ v > self.cut[k]
            self.child[k] = (len(self.child), len(self.child) + 1)
            todo += [(len(self.child), own[~right]), (len(self.child) + 1, own[right])]
            self.child += [None, None]
            self.cut += [0.0, 0.0]
            directions += [self.direction[0]] * 2
        self.direction = np.array(directions)

    def _weighted(self, row: np.ndarray, ids: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)
        weight = np.where(self.known[at] == ids, self.idf[at], self.rare) * (1 + np.log(tf)) if len(self.known) else tf
        norm = np.sqrt(np.bincount(row, weight**2, n)) + 1e-12
        return (ids * 2654435761 >> 7) % self.DIMS, weight / norm[row]

    def order(self) -> list[int]:
        """The leaves, neighbours in the tree side by side."""
        out, todo = [], [0]
        while todo:
            k = todo.pop()
            if self.child[k] is None:
                out.append(k)
            else:
                todo += reversed(self.child[k])
        return out

    def leaves(self, terms: list[bytes]) -> np.ndarray:
        node, inner = np.zeros(len(terms), np.int64), np.array([c is not None for c in self.child])
        left = np.array([c[0] if c else 0 for c in self.child])
        row, ids, tf = _flat(terms)
        place, weight = self._weighted(row, ids, tf, len(terms))
        while len(row):
            live = inner[node[row]]
            row, place, weight = row[live], place[live], weight[live]
            along = np.bincount(row, self.direction[node[row], place] * weight, len(terms))
            move = np.flatnonzero(inner[node])
            node[move] = left[node[move]] + (along[move] > np.array(self.cut)[node[move]])
            live = inner[node[row]]
            row, place, weight = row[live], place[live], weight[live]
        while inner[node].any():  # rows without ids
            move = np.flatnonzero(inner[node])
            node[move] = left[node[move]] + (0 > np.array(self.cut)[node[move]])
        return node


class Bm25:
    """Inverted index of one shard: postings by term, with finished weights."""

    def __init__(self, terms: list[bytes], lengths: np.ndarray, k1: float = 1.2, b: float = 0.75):
        own = [np.frombuffer(t, "<u4").reshape(2, -1) for t in terms]
        self.n = len(own)
        size = np.array([o.shape[1] for o in own], np.int64)
        term = np.concatenate([o[0] for o in own]) if own else np.zeros(0, np.uint32)
        tf = np.concatenate([o[1] for o in own]).astype(np.float64) if own else np.zeros(0)
        doc = np.repeat(np.arange(self.n), size)
        self.vocab, term = np.unique(term, return_inverse=True)
        df = np.bincount(term, minlength=len(self.vocab))
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / max(1.0, lengths.mean() if self.n else 1.0)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.own = np.split(term, np.cumsum(size)[:-1]) if self.n else []
        self.df = df
        common = np.flatnonzero(4 * df > self.n)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        here = self.row[term] >= 0
        self.dense[self.row[term[here]], doc[here]] = weight[here]
        self.live = np.arange(self.n)

    def keep(self, wanted: np.ndarray) -> None:
        """Only these remainders are scored from now on; weights stay as they are."""
        stays, place = wanted[self.live], np.cumsum(wanted[self.live]) - 1
        held = stays[self.doc]
        self.at = np.concatenate([[0], np.cumsum(held)])[self.at]
        self.doc, self.weight = place[self.doc[held]], self.weight[held]
        self.dense, self.live = self.dense[:, stays], self.live[stays]

    def scores(self, seed: int) -> np.ndarray:
        """Of the live remainders for the seed's terms; terms of one remainder only find nobody."""
        terms = self.own[seed][self.df[self.own[seed]] > 1]
        rows = self.row[terms]
        rare = terms[rows < 0]
        size = self.at[rare + 1] - self.at[rare]
        ends = np.cumsum(size)
        postings = np.repeat(self.at[rare] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.dense[rows[rows >= 0]].sum(0) + np.bincount(self.doc[postings], self.weight[postings], len(self.live))


def fill(lengths: np.ndarray, index: Bm25, window: int) -> list[list[int]]:
    """Sequences of remainders: each seed, its neighbours by score, then the largest that fit."""
    by_length = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    open_ = [(int(lengths[i]), i) for i in by_length]
    unused = np.ones(len(lengths), bool)
    out = []

    def take(i: int) -> None:
        unused[i] = False
        del open_[bisect.bisect_left(open_, (int(lengths[i]), i))]

    while open_:
        seed = open_[-1][1]
        take(seed)
        row, room = [seed], window - int(lengths[seed])
        if open_ and open_[0][0] <= room:
            if len(index.live) > 2 * len(open_):  # most have their place: the others' postings are enough
                index.keep(unused)
            scores, live = index.scores(seed), index.live
            near = np.flatnonzero((scores > 0) & unused[live] & (lengths[live] <= room))
            for i in live[near[np.lexsort((near, -scores[near]))]].tolist():
                size = int(lengths[i])
                # a neighbour may not close the window to all others, unless it fills it
                if size <= room and (size == room or room - size >= open_[0][0]):
                    take(i)
                    row.append(i)
                    room -= size
                    if not room or not open_ or open_[0][0] > room:
                        break
            while room and open_ and open_[0][0] <= room:
                i = open_[bisect.bisect_right(open_, (room, len(lengths))) - 1][1]
                take(i)
                row.append(i)
                room -= int(lengths[i])
        out.append(row)
    return out


_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(window: int):
    def mapped(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("crc", "ascending")]).to_pylist()
        rest = [r for r in rows if r["terms"] is not None]
        lengths = np.array([r["length"] for r in rest], np.int64)
        base, out = key[0].as_py() << 32, []
        sequences = fill(lengths, Bm25([r["terms"] for r in rest], lengths), window)
        for k, row in enumerate(sequences):
            at = 0
            for i in row:
                r = rest[i]
                out.append((r["doc_id"], r["start"], r["length"], r["crc"], r["doc_tokens"], base + k, at))
                at += r["length"]
        k = len(sequences)
        for r in rows:
            for p in r["full"]:
                out.append((r["doc_id"], p["start"], p["length"], p["crc"], r["doc_tokens"], base + k, 0))
                k += 1
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.table([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return mapped


def _routed(router: Router, names: list[str]):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("terms")
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                leaf = router.leaves([t or b"" for t in some.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(leaf, pa.int64())], [*names, "leaf"])

    return mapped


def sharded(cut: DataFrame, shard_rows: int, sample_rows: int) -> DataFrame:
    """The table with `shard` beside its columns: a leaf of the router and, where a leaf holds more than
    `shard_rows` rows, a part of it by row number. cut: a written table."""
    n = cut.count()
    share = int(min(1.0, sample_rows / max(1, n)) * (2**62 - 1))
    picked = cut.where(F.shiftrightunsigned(F.xxhash64("row"), 2) <= share).where("terms is not null")
    sample = [bytes(r["terms"]) for r in picked.select("terms", "row").orderBy("row").toLocalIterator()] if n > shard_rows else []
    router = Router(sample, shard_rows / max(1, n))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    routed = written(cut.mapInArrow(_routed(router, cut.columns), f"{fields}, leaf long"))
    sizes = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a leaf, at most sample_rows / 32
    base, rows, room = -1, [], 0
    for leaf in router.order():
        size = sizes.get(leaf, 0)
        if size > shard_rows:
            parts = -(-size // shard_rows)
            rows.append((leaf, base + 1, parts))
            base, room = base + parts, 0
        elif size:  # small leaves share a shard with their neighbours
            if size > room:
                base, room = base + 1, shard_rows
            rows.append((leaf, base, 1))
            room -= size
    place = cut.sparkSession.createDataFrame(rows, "leaf long, base long, parts long")
    return routed.join(F.broadcast(place), "leaf").withColumn("shard", F.col("base") + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("leaf", "base", "parts", "row")


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = END_ID, shard_rows: int = SHARD_ROWS, sample_rows: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed one by one. A null doc_id stays
    null. An empty table gives no rows; other columns are ignored. A shard holds about `shard_rows`
    remainders, so memory doesn't grow with the table. The tree that deals them is learned from about
    `sample_rows` remainders, those with the smallest hash, and has at most a leaf for 32 of these; every
    row is dealt, all of them from one written table, so a task run again deals alike. `tokenizer` is the
    path of the vocabulary file, which every worker can read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = written(rows.mapInArrow(_cut(tokenizer, window, end_id), _CUT).withColumn("row", F.monotonically_increasing_id()))
    return sharded(cut, shard_rows, sample_rows).groupBy("shard").applyInArrow(_packed(window), _PACKED)
