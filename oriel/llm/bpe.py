"""Byte-level BPE by a pair occurrence index.

``PairIndex`` merges all of a partition's unseen pretokens together.  The index
maps every mergeable pair, named by its rank, to the list of all positions where
it stands, and a heap holds the active ranks.  The least rank is taken off the
heap and merged at all its positions (by arrays while positions are many, then
one by one); each merge unlinks one position and enters the two pairs it makes
into their lists.  Work is in proportion to merges, never to ranks times
positions.  A rank that a merge makes active is a later one, since
a token exists only once its own merge has run (checked when rules are read), so
every pretoken sees its ranks in ascending order.
"""

from __future__ import annotations

import gc
import json
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunks, text_or_empty, tidy, utf8_list

#: The pretoken pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: About the most bytes of encoded words in each of four dictionaries, kept for a Python worker's next task; bytes of unseen pretokens merged together.
CACHED, TOGETHER = 64 << 20, 1 << 20
#: Pairs of fewer positions than this are merged at one after the other, others at all of them by arrays.
MANY = 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 is itself, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PairIndex:
    """Merge rules, and the merging of a list of byte strings by their occurrence index."""

    def __init__(self, vocab: dict[str, int], merges: list):
        letters = byte_letters()
        self.text_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.byte_id = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.parts: list[tuple[int, int]] = []
        self.made: list[int] = []
        for pair in merges:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.parts.append((vocab[a], vocab[b]))
            self.made.append(vocab[a + b])
        made_by = {t: r for r, t in enumerate(self.made)}
        if any(made_by.get(t, -1) >= r for r, ab in enumerate(self.parts) for t in ab):
            raise ValueError("a merge must come after those that make its parts")
        self.rank_of = {a << 32 | b: r for r, (a, b) in enumerate(self.parts)}
        keys, ranks = np.array(list(self.rank_of), np.int64), np.array(list(self.rank_of.values()), np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], ranks[order]

    def _first(self, ids: np.ndarray, inner: np.ndarray) -> dict[int, list[int]]:
        """The index before any merge: rank of a pair -> positions of its left part, ascending."""
        if not len(self.keys) or not len(inner):
            return {}
        rank = self._ranks(ids[inner], ids[inner + 1])
        rank, place = rank[rank >= 0], inner[rank >= 0]
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        heads = rank[np.concatenate(([0], cut))].tolist() if len(rank) else []
        return dict(zip(heads, (x.tolist() for x in np.split(place, cut)), strict=False))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where there is no such rule."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)

    def encode(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte strings that lie end to end in ``data``, and each one's number of ids."""
        ids = self.byte_id[np.frombuffer(data, np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        linked = word[:-1] == word[1:]
        index = self._first(ids, np.flatnonzero(linked))
        # links between neighbours of one string; -1 at its ends, id -1 for positions merged away
        here = np.arange(len(ids))
        after = np.where(np.append(linked, False), here + 1, -1)[: len(ids)]
        before = np.where(np.insert(linked, 0, False), here - 1, -1)[: len(ids)]
        active = sorted(index)
        self._merge_many(index, active, ids, after, before)
        ids = self._merge_few(index, active, ids.tolist(), after.tolist(), before.tolist())
        stay = ids >= 0
        return ids[stay].astype("<u4"), np.bincount(word[stay], minlength=len(sizes))

    def _merge_many(self, index: dict[int, list[int]], active: list[int], ids: np.ndarray, after: np.ndarray, before: np.ndarray) -> None:
        """Takes ranks off the heap, each merged at all its positions by arrays, until eight in a row have few positions."""
        few = 0
        while active and few < 8:
            rank = heappop(active)
            left, right = self.parts[rank]
            at = np.array(index.pop(rank))
            few = few + 1 if len(at) < MANY else 0
            at.sort()
            if len(at) > 1:
                at = at[np.append(True, at[1:] != at[:-1])]
            gone = after[at]
            good = (gone >= 0) & (ids[at] == left) & (ids[gone] == right)
            at, gone = at[good], gone[good]
            if left == right and len(at) > 1:  # x x x merges from the left: every other one of a chain
                fresh = np.append(True, gone[:-1] != at[1:])
                nth = np.arange(len(at))
                odd = (nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0
                at, gone = at[odd], gone[odd]
            ids[at], ids[gone] = self.made[rank], -1
            far, near = after[gone], before[at]
            after[at] = far
            follows, leads = far >= 0, near >= 0
            before[far[follows]] = at[follows]
            both = np.concatenate((at[follows], near[leads]))
            new = self._ranks(ids[both], ids[after[both]])
            both, new = both[new >= 0], new[new >= 0]
            order = np.argsort(new, kind="stable")
            new, places = new[order], both[order].tolist()
            cut = [*np.flatnonzero(np.diff(new, prepend=-1)).tolist(), len(places)]
            for r, lo, hi in zip(new[cut[:-1]].tolist(), cut, cut[1:], strict=False):
                if r in index:
                    index[r] += places[lo:hi]
                else:
                    index[r] = places[lo:hi]
                    heappush(active, r)

    def _merge_few(self, index: dict[int, list[int]], active: list[int], ids: list[int], after: list[int], before: list[int]) -> np.ndarray:
        """Takes the other ranks off the heap, each merged at one position after the other."""
        rank_at, parts, made_of = self.rank_of.get, self.parts, self.made
        while active:
            rank = heappop(active)
            left, right = parts[rank]
            made = made_of[rank]
            places = index.pop(rank)
            if len(places) > 1:
                places.sort()  # x x x merges from the left
            for at in places:
                gone = after[at]
                if gone < 0 or ids[at] != left or ids[gone] != right:
                    continue  # another merge took a part of it
                ids[at], ids[gone] = made, -1
                far, near = after[gone], before[at]
                after[at] = far
                if far >= 0:
                    before[far] = at
                    new = rank_at(made << 32 | ids[far])
                    if new is not None:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heappush(active, new)
                if near >= 0:
                    new = rank_at(ids[near] << 32 | made)
                    if new is not None:
                        if new in index:
                            index[new].append(near)
                        else:
                            index[new] = [near]
                            heappush(active, new)
        return np.array(ids, np.int64)


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit values, and back."""

    def __init__(self, path: str | None = None, specials: bool = True):
        import regex

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pairs = PairIndex(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = self.pairs.text_of | {i: s.encode() for s, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.named = self.special if specials else {}  # special tokens that texts may name
        self._pretokens = regex.compile(PRETOKEN).findall
        self._two_spaces = regex.compile(r"\s\s").search
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.named, key=len, reverse=True))) + ")").split if self.named else None
        # encoded words as they stand, and after one space: the young and the old generation of each
        self.plain: tuple[dict[str, bytes], dict[str, bytes]]
        self.spaced: tuple[dict[str, bytes], dict[str, bytes]]
        self.forget()

    def forget(self) -> None:
        """Drops the encoded words."""
        self.plain, self.spaced, self.kept = ({}, {}), ({}, {}), [0, 0]

    def _merged(self, raw: list[bytes]) -> tuple[bytes, np.ndarray]:
        """Ids of pretokens and each one's number, some ``TOGETHER`` bytes at a time."""
        flat, counts = [], []
        for lo, hi in chunks(raw, TOGETHER, len(raw) or 1):
            ids, count = self.pairs.encode(b"".join(raw[lo:hi]), np.fromiter(map(len, raw[lo:hi]), np.int64, hi - lo))
            flat.append(ids.tobytes())
            counts.append(count)
        return b"".join(flat), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _ready(self, which: int, words: set[str], before: str) -> tuple[dict, dict]:
        """Makes all of ``words`` young: kept, promoted from the old generation, or encoded now."""
        young, old = (self.plain, self.spaced)[which]
        missing = words.difference(young)
        if self.kept[which] > CACHED:
            young, old = {}, young
            missing, self.kept[which] = words, 0
        new = []
        for w in missing:
            known = old.get(w)
            if known is None:
                new.append(w)
            else:
                young[w] = known
        if new:
            easy = [w for w in new if w and "\n" not in w and not w[0].isspace() and not w[-1].isspace()]
            pieces = self._pretokens("\n".join([before + w for w in easy])) if easy else []
            cut = np.fromiter((p == "\n" for p in pieces), bool, len(pieces))
            owner = np.cumsum(cut)[~cut]
            pieces = [p for p in pieces if p != "\n"]
            if len(easy) < len(new):
                taken = set(easy)
                rest = [w for w in new if w not in taken]
                more = [self._pretokens(before + w) for w in rest]
                owner = np.concatenate((owner, np.repeat(np.arange(len(easy), len(new)), [len(x) for x in more])))
                pieces += [p for x in more for p in x]
                easy += rest
            # a pretoken that several words share is merged once
            number = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
            flat, size = self._merged([p.encode() for p in number])
            which_of = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
            count = size[which_of]
            begin = (np.cumsum(size) - size)[which_of] - (np.cumsum(count) - count)
            flat = np.frombuffer(flat, "<u4")[np.repeat(begin, count) + np.arange(int(count.sum()))].tobytes()
            end = (4 * np.cumsum(np.bincount(owner, count, len(new)).astype(np.int64))).tolist()
            lo = 0
            for w, hi in zip(easy, end, strict=True):
                young[w] = flat[lo:hi]
                lo = hi
        self.kept[which] += sum(200 + len(w) for w in missing)
        return young, old

    def encode(self, texts: list[str]) -> list[bytes]:
        """Words that single spaces or line feeds part are looked up whole; texts with longer white space go by pretokens."""
        jobs: list[list] = []
        plain: set[str] = {"\n"}
        spaced: set[str] = set()
        for text in texts:
            parts = self._split(text) if self._split and any(s in text for s in self.named) else [text]
            job: list = []
            for part in parts:
                if part in self.named:
                    job.append(self.named[part])
                elif self._two_spaces(part):
                    own = self._pretokens(part)
                    plain.update(own)
                    job.append(own)
                elif part:
                    lines = []
                    for line in part.split("\n"):
                        words = line.split(" ")
                        head = words[0]
                        plain.add(head)
                        del words[0]
                        spaced.update(words)
                        lines.append((head, words))
                    job.append(lines)
            jobs.append(job)
        self.plain = self._ready(0, plain, "")
        self.spaced = self._ready(1, spaced, " ")
        one, two = self.plain[0], self.spaced[0]
        feed = one["\n"]
        out = []
        for job in jobs:
            got: list[bytes] = []
            for x in job:
                if isinstance(x, int):
                    got.append(x.to_bytes(4, "little"))
                elif isinstance(x[0], str):
                    got.extend([one[p] for p in x])
                else:
                    for k, (head, words) in enumerate(x):
                        if k:
                            got.append(feed)
                        got.append(one[head])
                        got.extend(map(two.__getitem__, words))
            out.append(b"".join(got))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[tuple[str | None, bool], Encoder] = {}


def encoder(path: str | None = None, specials: bool = True) -> Encoder:
    """The one encoder of this Python worker; a worker never keeps two."""
    if (path, specials) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, specials] = Encoder(path, specials)
    return _ENCODERS[path, specials]


def encoded(enc: Encoder, texts: pa.Array, most: int = 1 << 22):
    """(index, ids) of each text of an Arrow column, in order; null is empty."""
    raw = utf8_list(texts)
    for lo, hi in chunks(raw, most):
        gc.disable()  # nothing in an encoding refers back to itself, and millions of its lists and strings are young
        try:
            found = enc.encode([t.decode("utf-8", "replace") for t in raw[lo:hi]])
        finally:
            gc.enable()
        for i, ids in enumerate(found):
            yield lo + i, ids


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns one row per input row: key, ids (binary, little-endian unsigned
    32-bit), n_tokens and decoded; other columns are left out, whatever their
    names.  Null texts are empty; an empty text has no ids and decodes to the
    empty text; repeated rows and null keys stay.  A text of any length is
    encoded whole.  An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            keys, ids, back = [], [], []
            size = 0
            for i, x in encoded(enc, batch.column(1)):
                keys.append(i)
                ids.append(x)
                back.append(enc.decode(np.frombuffer(x, "<u4").tolist()))
                size += 2 * len(x)
                if size > 16 << 20:
                    yield result(batch, keys, ids, back)
                    keys, ids, back, size = [], [], [], 0
            yield result(batch, keys, ids, back)

    def result(batch, at, ids, back):
        n = pa.array([len(x) // 4 for x in ids], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.binary()), n, pa.array(back, pa.string())], ["k", "ids", "n_tokens", "decoded"])

    out = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(tidy(run), f"k {kind}, ids binary, n_tokens long, decoded string")
    return out.withColumnRenamed("k", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of what ``encode_decode`` gives.

    Made in the same worker, so that ids and texts never leave it.  Null texts
    are empty, repeated rows and null keys keep a row each, other columns are
    left out; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            n, one, two = [], [], []
            for _, x in encoded(enc, batch.column(1)):
                ids = np.frombuffer(x, "<u4").tolist()
                n.append(len(ids))
                one.append(sha256(",".join(map(enc.decimal.__getitem__, ids)).encode()).hexdigest())
                two.append(sha256(enc.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(tidy(run), f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("k", key)
