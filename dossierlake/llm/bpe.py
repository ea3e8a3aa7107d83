"""BPE encoding and decoding by speculation and verification.

Each task keeps a bounded cache of the words it has met. Words that are new in a batch are cut greedily, longest token
first, all in one pass of an automaton. The merges a cut implies are right exactly when every two neighbouring tokens are
what merging their own text gives, so only distinct new neighbours are checked, all at once with numpy. The words that hold
a refuted pair, and only they, go through exact merging. Documents never move: encoding is one pass over the rows.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers

from dossierlake.llm.common import pieces, table, with_text

#: Words and pairs a task remembers; beyond them it forgets most, which costs time and changes no result.
CACHED_WORDS, CACHED_PAIRS = 250_000, 300_000
#: Words longer than this (they are nearly always unique) are encoded but not remembered.
CACHED_LENGTH = 64
#: Characters of text whose new words are learned together.
GROUP = 500_000
#: Words up to this many bytes are merged by searching the lowest rank in a list, all words of a call at once.
SHORT = 48
MOST = 1 << 40
#: Fixed value: the words of the usual vocabulary file, and the same for lower-case ASCII, where the faster module will do.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"
#: Fixed value: the characters beyond the first 65,536, which sets of the faster module are slow with.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_NEVER = np.int64(MOST)


def _set(class_: str) -> str:
    """The characters of a class up to U+FFFF, as the inside of a set of the faster module."""
    plane = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(f"{class_}+", plane))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 letters for themselves, the rest from U+0100 upwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file of word-end BPE, as its text."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("the vocabulary is not word-end BPE without a decoder")
        self.normalizer = Tokenizer.from_str(vocabulary).normalizer or normalizers.Sequence([])
        steps = [(n["type"], n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.plain = steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
        # White space means the Unicode property to the library; \\s of this module means a little more.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.ascii_words = re.compile(ASCII_WORDS) if pattern == WORDS and self.plain else None
        if self.ascii_words:
            letters, numbers, white = map(_set, (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
            self.plane_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = dict(enumerate(_byte_letters()))
        self.vocab, end = model["vocab"], model["end_of_word_suffix"]
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        # A merge is looked up by its two parts; its place in the list is its rank. A token is made by its first merge.
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank_by_key: dict[int, int] = {}
        self.whole_by_rank: list[int] = []
        made, left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for rank, (a, b) in enumerate(merges):
            x, y, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank_by_key.setdefault(x << 20 | y, rank)
            self.whole_by_rank.append(whole)
            if made[whole] < 0:
                made[whole], left[whole], right[whole] = rank, x, y
        self.made, self.left, self.right = made, left, right
        keys, ranks = np.array([*self.rank_by_key], np.int64), np.array([*self.rank_by_key.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        whole = self._whole()
        self.end = " "  # no byte letter is a space, so it may stand for the end of a word
        self.automaton = ahocorasick.Automaton()
        self.ends = {}
        for content, i in self.vocab.items():
            body, ended = (content[: -len(end)], self.end) if content.endswith(end) else (content, "")
            if body and whole[i]:
                self.automaton.add_word(body + ended, i << 12 | len(body + ended))
            if ended and len(body) == 1:
                self.ends[body] = i
        self.automaton.make_automaton()
        self.wholes = np.array(self.whole_by_rank, np.int64)
        # Ids of the byte letters by code point, inside a word and at its end.
        self.inner_letters, self.last_letters = np.zeros(0x200, np.int64), np.zeros(0x200, np.int64)
        for letter in self.letters.values():
            self.inner_letters[ord(letter)], self.last_letters[ord(letter)] = self.vocab[letter], self.ends[letter]
        self.cache: dict[str | int, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _whole(self) -> np.ndarray:
        """Whether merging a token's own text gives that token by its first merge, for each token."""
        merged = np.flatnonzero(self.made >= 0)
        seam = np.ones(len(self.made), bool)
        seam[merged] = self.compatible(self.left[merged], self.right[merged], self.made[merged])
        whole = self.made < 0
        for i in merged[np.argsort(self.made[merged], kind="stable")].tolist():
            whole[i] = seam[i] and whole[self.left[i]] and whole[self.right[i]]
        return whole

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 20 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the text of x and y gives x and y again, for each pair of tokens, or does so up to rank ``until``.

        The last merges of both are undone step by step, the later one first. A pair is refuted by a merge across the seam
        that comes before the merges undone so far on either side; of equal ranks the one on the left comes first.
        """
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        a, b = x.astype(np.int64), y.astype(np.int64)
        # What stands at the seam exists until the merge with this rank takes it up; infinite for the whole tokens.
        until_a = np.full(len(a), _NEVER) if until is None else until
        until_b = until_a if until is None else until - 1  # the merge that makes a token of x and y is not against it
        while len(live):
            across = self._rank(a, b)
            # Both parts exist from their own merge on; the seam's merge comes before the left part's at an equal rank no
            # sooner than the left part is taken, and before the right part's at an equal rank, as it stands further left.
            bad = (across < until_a) & (across <= until_b) & (across < _NEVER)
            good[live[bad]] = False
            keep = ~bad
            live, a, b, until_a, until_b = live[keep], a[keep], b[keep], until_a[keep], until_b[keep]
            made_a, made_b = self.made[a], self.made[b]
            more = (made_a >= 0) | (made_b >= 0)
            live, a, b, until_a, until_b, made_a, made_b = (v[more] for v in (live, a, b, until_a, until_b, made_a, made_b))
            undo_a = made_a > made_b
            # At equal ranks the merge further right comes later and is undone first.
            until_a, until_b = np.where(undo_a, made_a, until_a), np.where(undo_a, until_b, made_b)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def merged_all(self, spelled: list[str]) -> list[bytes]:
        """Exact merging of many words in byte letters; packed ids of each.

        In each round every word that is not finished merges its pair of lowest rank, of equal ranks the leftmost.
        """
        out = [b""] * len(spelled)
        left = []
        for i, letters in enumerate(spelled):
            if len(letters) > SHORT:
                out[i] = np.array(self.merged(letters), "<u4").tobytes()
            else:
                left.append(i)
        if not left:
            return out
        size = np.fromiter((len(spelled[i]) for i in left), np.int64, len(left))
        starts = np.cumsum(size) - size
        letter = np.frombuffer("".join([spelled[i] for i in left]).encode("utf-16-le"), "<u2")
        ids = self.inner_letters[letter]
        last = starts + size - 1
        ids[last] = self.last_letters[letter[last]]
        word, who = np.repeat(np.arange(len(left)), size), np.array(left)
        rank = np.full(len(ids), _NEVER)
        rank[:-1] = self._rank(ids[:-1], ids[1:])
        rank[last] = _NEVER
        while len(who):
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < _NEVER
            if not going.all():
                ends = np.append(starts[1:], len(ids))
                packed = ids.astype("<u4").tobytes()
                for at in np.flatnonzero(~going).tolist():
                    out[who[at]] = packed[4 * starts[at] : 4 * ends[at]]
                stay = going[word]
                ids, rank = ids[stay], rank[stay]
                who, lowest, size = who[going], lowest[going], (ends - starts)[going]
                if not len(who):
                    break
                word, starts = np.repeat(np.arange(len(who)), size), np.cumsum(size) - size
            hit = np.flatnonzero(rank == lowest[word])
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]  # the leftmost of each word
            ids[hit] = self.wholes[lowest]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            ids, rank, word = ids[stay], rank[stay], word[stay]
            at = hit - np.arange(len(hit))
            starts = starts - np.arange(len(starts))
            closing = np.append(word[1:] != word[:-1], True)
            following = np.minimum(at + 1, len(ids) - 1)
            rank[at] = np.where(closing[at], _NEVER, self._rank(ids[at], ids[following]))
            before = at[at > starts]
            rank[before - 1] = self._rank(ids[before - 1], ids[before])
        return out

    def merged(self, letters: str) -> list[int]:
        """Exact merging of one word in byte letters: the lowest rank first, of equal ranks the leftmost."""
        ids = [self.vocab[c] for c in letters[:-1]]
        ids.append(self.ends[letters[-1]])
        if len(ids) > SHORT:
            return self._merged_long(ids)
        rank, whole = self.rank_by_key.get, self.whole_by_rank
        ranks = [rank(x << 20 | y, MOST) for x, y in zip(ids, ids[1:], strict=False)]
        while ranks and (lowest := min(ranks)) < MOST:
            i = ranks.index(lowest)
            ids[i] = whole[lowest]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], MOST)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], MOST)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, for words whose pairs are too many to search for the lowest each time."""
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.rank_by_key.get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (found, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while heap:
            lowest, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = self.whole_by_rank[lowest], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [i for i in ids if i >= 0]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Token ids of each word, as little-endian 32-bit numbers."""
        table = self.letters
        spelled = [w.encode().decode("latin-1").translate(table) for w in words]
        text = self.end.join(spelled) + self.end
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(text)), np.int64)
        last, ids, width = found[::2], found[1::2] >> 12, found[1::2] & 0xFFF
        stops = np.cumsum([len(s) + 1 for s in spelled]) - 1  # where each word's end stands
        starts = np.searchsorted(last, stops, side="right")  # tokens up to each word's end
        begins = np.concatenate(([0], starts[:-1]))
        covered = np.add.reduceat(width, np.minimum(begins, len(width) - 1)) if len(width) else np.zeros(len(words))
        good = (begins < starts) & (covered == np.diff(np.concatenate(([-1], stops))))
        inner = np.ones(max(len(ids) - 1, 0), bool)
        closing = starts[:-1] - 1
        inner[closing[(closing >= 0) & (closing < len(inner))]] = False
        seams = np.flatnonzero(inner)
        keys, where = np.unique(ids[seams] << 20 | ids[seams + 1], return_inverse=True)
        known = np.fromiter((self.pairs.get(k, 2) for k in keys.tolist()), np.int8, len(keys))
        new = np.flatnonzero(known == 2)
        if len(new):
            known[new] = self.compatible(keys[new] >> 20, keys[new] & 0xFFFFF)
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            self.pairs.update(zip(keys[new].tolist(), known[new].tolist(), strict=True))
        refuted = seams[known[where] == 0]
        good[np.searchsorted(starts, refuted, side="right")] = False
        flat = ids.astype("<u4").tobytes()
        out = {word: flat[4 * a : 4 * b] for word, a, b in zip(words, begins.tolist(), starts.tolist(), strict=True)}
        refuted_words = np.flatnonzero(~good).tolist()
        out.update(zip([words[i] for i in refuted_words], self.merged_all([spelled[i] for i in refuted_words]), strict=True))
        return out

    def normal(self, text: str) -> str:
        """A text as its words are looked for. White space is left alone, as no word holds any."""
        if not self.plain:
            return self.normalizer.normalize_str(text)
        # Letters are lowered one by one, so a capital sigma does not depend on its place.
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def cut(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        normal = self.normal(text)
        if not self.ascii_words:
            return self.words.findall(normal)
        words = self.ascii_words if normal.isascii() else self.words if ASTRAL.search(normal) else self.plane_words
        return words.findall(normal)

    def split(self, text: str) -> list[str | int]:
        """Words of a text; special tokens as their ids."""
        if self.specials is None or not self.specials.search(text):
            return self.cut(text)
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self.cut(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.cut(text[at:])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Token ids of each text, as little-endian 32-bit numbers. New words are learned for GROUP characters at a time."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= GROUP):
                size += len(texts[stop])
                stop += 1
            split = [self.split(text) for text in texts[at:stop]]
            at = stop
            if len(self.cache) > CACHED_WORDS:
                # The words in hand are mostly the frequent ones; the others are learned again when they come back.
                self.cache = {word: self.cache[word] for words in split for word in words if word in self.cache}
            cache = self.cache
            new = set().union(*split).difference(cache)
            for i in [x for x in new if isinstance(x, int)]:
                new.discard(i)
                cache[i] = i.to_bytes(4, "little")
            if new:
                cache.update(self.learn(list(new)))
            for words in split:
                yield b"".join(map(cache.__getitem__, words))
            for word in new:
                if len(word) > CACHED_LENGTH:
                    del cache[word]


class Decoder:
    """Decoder of a vocabulary without one of its own: tokens are joined by single spaces, unknown ids give nothing."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        if spec["decoder"]:
            raise ValueError("the vocabulary has a decoder of its own")
        named = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max(named.values()) + 1)
        for content, i in named.items():
            self.pieces[i] = content

    def decode(self, ids: np.ndarray) -> str:
        known = ids[ids < len(self.pieces)].tolist()
        return " ".join(map(self.pieces.__getitem__, known))


_HELD: dict[type, tuple[int, Codec | Decoder]] = {}


def _held(kind: type, vocabulary):
    """One codec or decoder for a worker process; the cache in it outlives tasks."""
    key = hash(vocabulary.value)
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD[kind] = (key, kind(vocabulary.value))
    return _HELD[kind][1]


def share_vocabulary(spark: SparkSession, path: str):
    """Read a vocabulary file on the driver and broadcast it. Its size is checked: 16 MB at most."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    if len(content) > 16 << 20:
        raise ValueError("the vocabulary file is larger than 16 MB")
    return spark.sparkContext.broadcast(content)


def encode(docs: DataFrame, vocabulary, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, or all), ``n_tokens`` and ``ids`` of each row.

    ``ids`` holds the token ids as little-endian unsigned 32-bit numbers. Null texts count as empty and have no tokens.
    Whole texts are encoded, and special tokens in them are recognised, as the tokenizers library does.
    """
    rows, text = with_text(docs, text_col, keep)
    return rows.mapInArrow(lambda batches: _encoded(batches, vocabulary, text), _coded_schema(rows))


def _coded_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary, text: str) -> Iterator[pa.RecordBatch]:
    codec = _held(Codec, vocabulary)
    for piece, texts in pieces(batches, text):
        ids = list(codec.encode(texts))
        yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["row", "n_tokens", "ids"])


def token_ids(packed: bytes | None) -> list[int]:
    """The ids of one packed value, as Python numbers."""
    return np.frombuffer(packed or b"", "<u4").tolist()


def decode(coded: DataFrame, vocabulary) -> DataFrame:
    """``coded`` with a column ``decoded``: the text of its column ``ids`` (null: empty)."""
    schema = T.StructType([*coded.schema, T.StructField("decoded", T.StringType())])
    return coded.mapInArrow(lambda batches: _decoded(batches, vocabulary), schema)


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    decoder = _held(Decoder, vocabulary)
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            piece = batch.slice(begin, 256)
            texts = [decoder.decode(np.frombuffer(x or b"", "<u4")) for x in piece.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [*piece.schema.names, "decoded"])


def encode_and_decode(docs: DataFrame, vocabulary, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """What ``decode`` makes of what ``encode`` makes, in one Python worker a task, where the two after each other take two."""
    rows, text = with_text(docs, text_col, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decoded(_encoded(batches, vocabulary, text), vocabulary)
        # The worker serves other stages next.
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, T.StructType([*_coded_schema(rows), T.StructField("decoded", T.StringType())]))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = share_vocabulary(spark, vocabulary_path())
    coded = decode(encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"]), vocabulary)
    return coded.select(
        F.col("row.doc_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
