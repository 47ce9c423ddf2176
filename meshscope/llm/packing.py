"""Best-fit packing of tokenised documents by swap-based local search.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt by a
hash into groups of about ``GROUP_PIECES``; each group is packed on its own, so
no task grows with the corpus and a very long document is spread over groups.
Inside a group best-fit decreasing makes a first packing; the local search then
takes the emptiest bin and moves or exchanges pieces (one for one, two for one,
one for two) with other underfull bins.  Every step increases the sum of the
squared fills, so it ends; bins that become empty disappear.

Defined results: a null text is an empty one, an empty text is the end id alone
(one piece of length 1); equal documents are packed as separate pieces; an
empty table gives an empty table.  Texts are tokenised whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshscope.llm.common import Remembered, append, struct
from meshscope.plans.iterate import Workspace

GROUP_PIECES = 8192
CAPACITY = 2048

# ---- tokens ------------------------------------------------------------------

# Fixed values of the public vocabulary file: its split pattern and special strings.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_COMMON = re.compile(r"[\x21-\x7e\xa1-\xac\xae-ɏ‘’“”–—…]+")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that stands for it in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, remembering words already seen.

    The vocabulary's normaliser (NFC, one kind of space, lower case) and split
    never look across white space, so the ids of a text are those of its words.
    Unusual words are given to the tokenizer itself.
    """

    REMEMBER = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts = Remembered(self._part, self.REMEMBER)
        self.words = Remembered(self._word, self.REMEMBER)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one part
            return self.parts[word]
        if not _COMMON.fullmatch(word):
            return self._whole(word)
        return b"".join(map(self.parts.__getitem__, _SPLIT.findall(word)))

    @staticmethod
    def _normal(text: str) -> list[str]:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split()

    @staticmethod
    def _unusual(text: str) -> bool:
        return any(s in text for s in _SPECIAL) or bool(_ODD_SPACE.search(text))

    def encode(self, text: str) -> bytes:
        if self._unusual(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, self._normal(text)))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process (its remembered words serve later tasks too)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = T.ArrayType(
    struct(
        piece=T.IntegerType(),
        start=T.LongType(),
        length=T.LongType(),
        ids_crc32=T.LongType(),
        ids=T.BinaryType(),
    )
)


def pieces(
    docs: DataFrame,
    path: str | None = None,
    text_col: str = "text",
    keep: list[str] | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: struct ``row`` of the kept columns, and the fields of ``PIECES``.

    ``ids`` (little-endian 32-bit) is null unless asked for.
    """
    path = path or tokenizer_path()
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(texts):
        out = []
        for text in texts:
            ids = encoder(path).encode(text or "") + end
            parts = [ids[i : i + width] for i in range(0, len(ids), width)]
            out.append(
                [
                    {
                        "piece": k,
                        "start": k * capacity,
                        "length": len(p) // 4,
                        "ids_crc32": zlib.crc32(p),
                        "ids": p if with_ids else None,
                    }
                    for k, p in enumerate(parts)
                ]
            )
        return [out]

    cut_docs = append(docs, text_col, struct(pieces=PIECES), cut, keep)
    return cut_docs.select("row", F.inline("pieces"))


# ---- one group ---------------------------------------------------------------


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, into the fullest bin that still has room."""
    bins = np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by their free space
    free = 0  # bit g is set if some bin has g free
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        fits = free >> need
        if fits:
            gap = need + (fits & -fits).bit_length() - 1
            b = room[gap].pop()
            if not room[gap]:
                free ^= 1 << gap
        else:
            b, gap = made, capacity
            made += 1
        bins[i] = b
        if gap - need:
            room[gap - need].append(b)
            free |= 1 << (gap - need)
    return bins


class LocalSearch:
    """Moves and exchanges between the underfull bins of one packing."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.lengths, self.bins, self.capacity = lengths.astype(np.int64), bins.copy(), capacity
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)
        self.members: list[list[int]] = [[] for _ in range(len(self.fill))]
        for i, b in enumerate(bins):
            self.members[b].append(i)

    def _move(self, items: list[int], to: int) -> None:
        for i in items:
            source = int(self.bins[i])
            self.members[source].remove(i)
            self.members[to].append(i)
            self.fill[source] -= self.lengths[i]
            self.fill[to] += self.lengths[i]
            self.bins[i] = to

    def _targets(self, donor: int) -> np.ndarray:
        """Pieces of the other underfull bins that are at least as full as the donor."""
        open_ = (self.fill < self.capacity) & (self.fill >= self.fill[donor])
        open_[donor] = False
        return np.flatnonzero(open_[self.bins])

    def improve(self, donor: int) -> bool:
        """The step that fills another bin most at the donor's cost; False if there is none."""
        own = self.members[donor]
        gap = self.capacity - self.fill
        bins = np.flatnonzero((gap > 0) & (self.fill >= self.fill[donor]) & (self.fill > 0))
        bins = bins[bins != donor]
        if not len(bins):
            return False
        for i in sorted(own, key=lambda i: -self.lengths[i]):  # move
            fits = bins[gap[bins] >= self.lengths[i]]
            if len(fits):
                self._move([i], int(fits[np.argmin(gap[fits])]))
                return True
        items = self._targets(donor)
        lens, room = self.lengths[items], gap[self.bins[items]]
        best = (0, None, None)
        give = [[i] for i in own]
        if len(own) <= 40:
            give += [[a, b] for k, a in enumerate(own) for b in own[k + 1 :]]
        for mine in give:  # one or two of the donor's for one of the other bin
            gain = self.lengths[mine].sum() - lens
            gain[gain > room] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (int(gain[k]), mine, [int(items[k])])
        if best[1] is None:  # one of the donor's for two of one other bin
            order = items[np.argsort(self.bins[items], kind="stable")]
            for step in range(1, 8):
                a, b = order[:-step], order[step:]
                same = self.bins[a] == self.bins[b]
                if not same.any():
                    break
                a, b = a[same], b[same]
                pair, room = self.lengths[a] + self.lengths[b], gap[self.bins[a]]
                for i in own:
                    gain = self.lengths[i] - pair
                    gain[gain > room] = 0
                    if gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (int(gain[k]), [i], [int(a[k]), int(b[k])])
        if best[1] is None:
            return False
        to = int(self.bins[best[2][0]])
        self._move(best[2], donor)
        self._move(best[1], to)
        return True

    def run(self) -> np.ndarray:
        least = -(-int(self.lengths.sum()) // self.capacity)  # no packing has fewer bins
        stuck: set[int] = set()
        while (self.fill > 0).sum() > least:
            open_ = [b for b in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)) if b not in stuck]
            if len(open_) < 2:
                break
            donor = int(min(open_, key=lambda b: self.fill[b]))
            while self.members[donor] and self.improve(donor):
                pass
            if self.members[donor]:
                stuck.add(donor)
        return self.bins


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each piece of one group, numbered from 0 without gaps."""
    lengths = np.asarray(lengths, dtype=np.int64)
    bins = np.empty(len(lengths), dtype=np.int64)
    full = lengths == capacity
    bins[full] = np.arange(full.sum())
    if (~full).any():
        part = lengths[~full]
        found = LocalSearch(part, best_fit_decreasing(part, capacity), capacity).run()
        bins[~full] = np.unique(found, return_inverse=True)[1] + full.sum()
    return bins


# ---- all groups --------------------------------------------------------------


def pack(
    docs: DataFrame,
    path: str | None = None,
    text_col: str = "text",
    keep: list[str] | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece with its place: ``row``, the piece's fields, ``sequence_id``, ``offset``."""
    space = Workspace(docs.sparkSession, "packing")
    cut = space.materialize(pieces(docs, path, text_col, keep, capacity, end_id, with_ids), "pieces")
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    dealt = cut.withColumn(
        "_group", F.pmod(F.xxhash64("row", "piece", "ids_crc32"), F.lit(groups))
    )
    out = T.StructType(
        [
            *cut.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "start"], ascending=False, kind="stable")
        bins = pack_group(group["length"].to_numpy(), capacity)
        group = group.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + bins)
        before = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.assign(offset=before)

    return dealt.groupBy("_group").applyInPandas(place, out)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its token ids (array), from ``pack(..., with_ids=True)``.

    A sequence has at most ``capacity`` tokens, so a group here is bounded.
    """
    ordered = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )

    def decode(parts):
        return [[np.frombuffer(b"".join(p["ids"] for p in row), dtype="<u4").tolist() for row in parts]]

    return append(
        ordered, "parts", struct(ids=T.ArrayType(T.LongType())), decode, ["sequence_id"]
    ).select("row.sequence_id", "ids")
