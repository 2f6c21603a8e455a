"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, decoding by concatenation.

The vocabulary file (a tokenizers JSON of byte-level BPE) is read in the tasks; its path is a parameter. Texts are cut before single
spaces and line ends, where no pre-token can straddle the cut, so that repeated words are looked up. New words are merged many at
once: each has a queue, links and symbols of its own in a column of a matrix. The tables of known words are bounded; they change
the speed only.

Nulls: a null text counts as empty (no ids, empty decoded text); a null id stays. Special tokens in a text become their id, as in
the tokenizers library. Very long texts and words are encoded whole, in n log n. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.llm import common

#: Fixed value: how byte-level BPE cuts a text into pre-tokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
VOCABULARY = "byte_bpe_50k.json"
KNOWN_WORDS, KNOWN_TOKENS, LONG, TABLE_BITS = 400_000, 100_000, 48, 18
WIDTHS = (4, 8, 10, 12, 16, 24, 40, 63)  # bytes; longer tokens are merged one by one
_CLEAN_CUT = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def clean(word: str) -> bool:
    """Does the word have something else than white space first, after a line end at most?"""
    body = word[1:] if word[:1] == "\n" else word
    return bool(body) and not body[0].isspace()


def spaced(word: str) -> str:
    return word if word[0] == "\n" else " " + word


class WordTable:
    """Ids of texts by their words, which `find` encodes when they are met first.

    find(words as an Arrow array) gives the ids of words that follow a space or line end: all ids, one word after another in any
    order, and where each word's begin and how many they are (-1: a word that is empty or begins with white space, where a
    pre-token may straddle the cut). whole(strings) gives bytes of ids. The table is bounded; the words not met for longest go.
    """

    def __init__(self, find, whole, special: list[str]):
        self.find, self.whole, self.special = find, whole, special
        self.words, self.pool = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.start, self.size, self.used, self.tick = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def trim(self) -> None:
        """The half of a full table that was used last stays."""
        if len(self.words) > KNOWN_WORDS:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: KNOWN_WORDS // 2])
            n = np.maximum(self.size[keep], 0)
            self.pool, self.words = self.pool[spread(self.start[keep], n)], self.words.take(pa.array(keep))
            self.start, self.size, self.used = np.cumsum(n) - n, self.size[keep], self.used[keep]

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Where distinct words are in the table."""
        self.trim()
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.nonzero(at < 0)[0]
        if len(new):
            fresh = words.take(pa.array(new))
            pool, start, size = self.find(fresh)
            at[new] = len(self.words) + np.arange(len(new))
            self.start, self.size = np.append(self.start, start + len(self.pool)), np.append(self.size, size)
            self.words, self.pool = pa.concat_arrays([self.words, fresh]), np.append(self.pool, pool)
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.tick += 1
        self.used[at] = self.tick
        return at

    def rough(self, text: str) -> bytes:
        """Ids of a text in which white space meets white space: cut at single spaces alone."""
        first, *rest = _CLEAN_CUT.split(text)
        coded = pa.array(rest, pa.string()).dictionary_encode()
        at = self.lookup(coded.dictionary)[coded.indices.to_numpy()]
        return self.whole([first])[0] + self.pool[spread(self.start[at], self.size[at])].tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one text after another; where each text begins, and the end)."""
        texts = texts.fill_null("")
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), "\n", " \n"), " ")
        begin, flat = parts.offsets.to_numpy()[:-1], parts.flatten()
        rest = np.ones(len(flat), bool)
        rest[begin] = False
        coded = flat.filter(pa.array(rest)).dictionary_encode()
        at = self.lookup(coded.dictionary)[coded.indices.to_numpy()]
        start, size = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        start[rest], size[rest] = self.start[at], self.size[at]
        uneven = np.minimum.reduceat(size, begin) < 0 if len(begin) else odd
        if uneven.any():
            size[np.repeat(uneven, np.diff(np.append(begin, len(flat))))] = 0
        pool = self.pool
        heads = self.whole(flat.take(pa.array(begin)).to_pylist())
        for i in np.nonzero(odd)[0]:
            (heads[i],) = self.whole([texts[i].as_py()])
        for i in np.nonzero(uneven)[0]:
            heads[i] = self.rough(texts[i].as_py())
        size[begin] = np.fromiter(map(len, heads), np.int64, len(heads)) // 4
        start[begin] = len(pool) + np.cumsum(size[begin]) - size[begin]
        ends = np.append(0, np.cumsum(size))
        return np.append(pool, np.frombuffer(b"".join(heads), "<u4"))[spread(start, size)], ends[np.append(begin, len(flat))]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each row, as many as its size."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def slots_of(key: np.ndarray) -> list[np.ndarray]:
    """The two places of each key in a table of 2 ** TABLE_BITS."""
    return [((key.view(np.uint64) * m) >> np.uint64(64 - TABLE_BITS)).astype(np.int64) for m in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))]


def placed(rank: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their values, each at one of its two places (cuckoo hashing); free places hold -1."""
    keys, values = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS, np.int32)
    spots = dict(zip(rank, zip(*(x.tolist() for x in slots_of(np.array([*rank], np.int64))), strict=True), strict=True))
    held: dict[int, int] = {}
    for k in rank:
        at = spots[k][0]
        for _ in range(500):
            k, held[at] = held.get(at), k
            if k is None:
                break
            at = spots[k][1] if at == spots[k][0] else spots[k][0]
        else:
            raise ValueError("more merges than the table can place")
    at = np.array([*held], np.int64)
    keys[at], values[at] = [*held.values()], [rank[k] for k in held.values()]
    return keys, values


class Codec:
    def __init__(self, path: str | None = None):
        with open(vocabulary_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_id = [vocab[c] for c in letters]
        self.rank, self.left, self.right, self.merged = {}, [], [], []
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = vocab[a], vocab[b]
            self.rank[x << 32 | y] = n
            self.left.append(x)
            self.right.append(y)
            self.merged.append(vocab[a + b])
        value = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(value[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pretoken = regex.compile(PRETOKEN)
        self.pairs, self.ranks = placed(self.rank)
        self.sides = np.array([self.left, self.right, self.merged], np.int32).reshape(3, -1)
        self.of_byte = np.array(self.byte_id, np.int32)
        self.tokens: dict[str, bytes] = {}
        self.table = WordTable(self.find, self.whole, [*self.special])

    def merge(self, token: str) -> bytes:
        """The lowest rank is merged first, the leftmost of equals. Queue entries whose symbols have changed meanwhile are skipped."""
        ids = [self.byte_id[b] for b in token.encode()]
        n, rank = len(ids), self.rank
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [r << 32 | i for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            e = heapq.heappop(queue)
            r, i = e >> 32, e & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] != self.left[r] or ids[j] != self.right[r]:
                continue
            x = ids[i] = self.merged[r]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (q := rank.get(x << 32 | ids[k])) is not None:
                    heapq.heappush(queue, q << 32 | i)
            if (h := before[i]) >= 0 and (q := rank.get(ids[h] << 32 | x)) is not None:
                heapq.heappush(queue, q << 32 | h)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs; pairs that do not merge have the number of merges."""
        key = left.astype(np.int64) << 32 | right  # negative where either is missing
        out = np.full(key.shape, len(self.rank), np.int32)
        for at in slots_of(key):
            hit = self.pairs[at] == key
            out[hit] = self.ranks[at[hit]]
        return out

    def merge_all(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() for many tokens at once: a column of data is a token's bytes, with a queue, links and symbols of its own. Gives the
        ids of all, and how many each has.

        A queue entry is a rank and a place; the least of each column is popped, and stale ones are skipped, until all are empty.
        The last row stands for what is beyond either end.
        """
        (wide, n), none = data.shape, len(self.rank)
        place = np.arange(wide + 1)[:, None]
        ids = np.full((wide + 1, n), -1, np.int32)
        ids[:-1] = np.where(place[:-1] < size, self.of_byte[data], -1)
        after = np.where(place + 1 < size, place + 1, wide).astype(np.int32)
        before = np.repeat(np.where(place > 0, place - 1, wide), n, axis=1).astype(np.int32)
        empty = none << 6
        queue = np.full((wide + 1, n), empty, np.int32)
        queue[:-1] = (self.ranks_of(ids[:-1], ids[1:]).astype(np.int32) << 6) | place[:-1]
        queue[queue >= empty] = empty
        flat_ids, flat_after, flat_before, flat_queue = (x.reshape(-1) for x in (ids, after, before, queue))
        left, right, merged = self.sides
        while True:
            e = queue[:-1].min(0)
            col = np.nonzero(e < empty)[0]
            if not len(col):
                break
            e = e[col]
            r, at = e >> 6, (e & 63) * n + col
            flat_queue[at] = empty
            to = flat_after[at] * n + col
            sound = (flat_ids[at] == left[r]) & (flat_ids[to] == right[r])
            col, r, at, to = col[sound], r[sound], at[sound], to[sound]
            here, x = (at - col) // n, merged[r]
            flat_ids[at], flat_ids[to] = x, -1
            k = flat_after[to]
            flat_after[at] = k
            flat_before[k * n + col] = here
            h = flat_before[at]
            for i, q in ((here, self.ranks_of(x, flat_ids[k * n + col])), (h, self.ranks_of(flat_ids[h * n + col], x))):
                new = np.nonzero(q < none)[0]
                flat_queue[i[new] * n + col[new]] = (q[new] << 6) | i[new]
        ids = ids.T
        keep = ids >= 0
        return ids[keep].astype("<u4"), keep.sum(1)

    def merged_tokens(self, tokens: pa.Array, mark: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of tokens, each with the mark before it, those of similar length together: all ids, and where each token's begin
        and how many they are."""
        tokens = tokens.cast(pa.large_string())
        bounds, data = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :][: len(tokens) + 1], np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
        size = np.diff(bounds) + len(mark)
        group = np.searchsorted(WIDTHS, size)
        pools, start, count, base = [np.zeros(0, "<u4")], np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64), 0
        for g in np.unique(group):
            rows = np.nonzero(group == g)[0]
            for at in (rows[i : i + 50_000] for i in range(0, len(rows), 50_000)):
                if g < len(WIDTHS):
                    body = data[np.minimum(bounds[at] + np.arange(WIDTHS[g] - len(mark))[:, None], len(data) - 1)]
                    pool, n = self.merge_all(np.vstack([np.repeat(np.frombuffer(mark, np.uint8)[:, None], len(at), axis=1), body]), size[at])
                else:
                    found = [self.merge(mark.decode() + t) for t in tokens.take(pa.array(at)).to_pylist()]
                    pool, n = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found])
                pools.append(pool)
                start[at], count[at] = base + np.cumsum(n) - n, n
                base += len(pool)
        return np.concatenate(pools), start, count

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For WordTable. Words of letters alone are a pre-token with their space."""
        letters = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        start, size = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        pool, start[letters], size[letters] = self.merged_tokens(words.filter(pa.array(letters)), b" ")
        others = np.nonzero(~letters)[0]
        text = words.take(pa.array(others)).to_pylist()
        sound = np.array([bool(w[:1].strip()) or clean(w) for w in text], bool)
        blobs = self.words([spaced(w) for w, ok in zip(text, sound.tolist(), strict=True) if ok])
        n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        start[others[sound]], size[others[sound]] = len(pool) + np.cumsum(n) - n, n
        return np.append(pool, np.frombuffer(b"".join(blobs), "<u4")), start, size

    def pretokens(self, word: str) -> list[str]:
        """Letters, or letters and one other sign, after a space are told without the pattern."""
        if word[:1] == " ":
            if word[1:].isalpha():
                return [word]
            if word[1:-1].isalpha() and not (word[-1].isalnum() or word[-1].isspace()):
                return [word[:-1], word[-1]]
        return self.pretoken.findall(word)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of strings without special tokens."""
        cuts = [*map(self.pretokens, words)]
        if len(self.tokens) > KNOWN_TOKENS:
            self.tokens.clear()
        known = self.tokens
        new = [*{*itertools.chain.from_iterable(cuts)}.difference(known)]
        pool, start, size = self.merged_tokens(pa.array(new, pa.string()))
        data = pool.tobytes()
        known.update(zip(new, [data[a:b] for a, b in zip((4 * start).tolist(), (4 * (start + size)).tolist(), strict=True)], strict=True))
        found = [known[c[0]] if len(c) == 1 else b"".join(map(known.__getitem__, c)) for c in cuts]
        for t in new:
            if len(t) > LONG:
                del known[t]
        return found

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of whole strings; special tokens in them become their ids."""
        if self.at_special is None or not any(s in t for t in texts for s in self.special):
            return self.words(texts)
        return [b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.words([x])[0] for x in self.at_special.split(t) if x) for t in texts]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        return self.table.encode(pa.array([text]))[0].astype("<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, ids array<int>, decoded string): each text's ids, and the text that those ids give back."""
    common.small_batches(docs.sparkSession)
    docs = common.pick(docs, id_col, text_col)

    def run(batches):
        c = common.kept(("bpe", path), lambda: Codec(path))
        for b in common.slices(common.gathered(batches), text_col, 8 << 20):
            ids, ends = c.table.encode(b.column(1))
            decoded = pa.array([c.decode(ids[x:y].tolist()) for x, y in zip(ends, ends[1:], strict=False)], pa.string())
            found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), found, decoded], [id_col, "ids", "decoded"])

    return docs.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
