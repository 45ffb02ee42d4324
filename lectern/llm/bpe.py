"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes tokens for every new word. A sequence of tokens is the exact
encoding if and only if every adjacent pair is: for that, the pair's two tokens must be what
merging gives for their joined text. All pairs of a batch are tested together in numpy;
only words with a failing pair are merged rank by rank.

Vocabulary files are read by path in each Python worker; nothing is trained or copied.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .workers import hold, mapped

#: Words whose encodings a worker keeps; beyond it the store is emptied and filled anew.
CACHED_WORDS = 200_000
#: Letters of a word from which it is merged alone.
LONG_WORD = 256

#: White space of the tokenizer's pattern language.
_SPACE = "\t-\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Letters beyond the Latin and general blocks, whose classes differ between versions of Unicode.
_RARE = regex.compile("[^\x00-\u02ff\u0370-\u03ff\u0400-\u045f\u2000-\u206f\u20a0-\u20bf\u2100-\u22ff\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")
_ASCII_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others take code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str, shows: bool = True):
        self.shows = shows
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        steps = [normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]
        self.library = normalizers.Sequence(steps), pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        letters = byte_letters()
        self.letter_of = {b: letters[b] for b in range(256)}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        self.ranks = {(ids[a], ids[b]): k for k, (a, b) in enumerate(merges)}
        made = {ids[a + b]: (ids[a], ids[b], k) for k, (a, b) in reversed(list(enumerate(merges)))}
        n = max([*ids.values(), *self.special.values()]) + 1
        # Halves and rank of the merge that makes each token; single letters have none.
        self.left, self.right, self.rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for t, (a, b, k) in made.items():
            self.left[t], self.right[t], self.rank[t] = a, b, k
        order = sorted((a * n + b, k, ids[merges[k][0] + merges[k][1]]) for (a, b), k in self.ranks.items())
        self.pair_keys = np.array([x[0] for x in order], np.int64)
        self.pair_ranks = np.array([x[1] for x in order], np.int64)
        self.made_by_rank = np.array([ids[a + b] for a, b in merges], np.int64)
        self.n = n
        self.text_of = [""] * n
        for s, t in (ids | self.special).items():
            self.text_of[t] = s
        # Longest token by its first two letters.
        self.reach: dict[str, int] = {}
        for x in ids:
            self.reach[x[:2]] = max(self.reach.get(x[:2], 1), len(x))
        self.ids_of: dict[str, bytes] = {}
        self.shown_of: dict[str, bytes] = {}

    # proposing, verifying, merging

    def propose(self, letters: str) -> list[int]:
        """Longest matches from the left. The last token carries the end-of-word suffix; a match that leaves no room for it is shortened."""
        vocab, reach, suffix, out, at, end = self.vocab, self.reach, self.suffix, [], 0, len(letters)
        while at < end:
            far = at + reach.get(letters[at : at + 2], 1)
            if (end - at < 2 or far >= end + len(suffix)) and (whole := vocab.get(letters[at:] + suffix)) is not None:
                return [*out, whole]
            for stop in range(min(end - 1, far), at, -1):
                if (t := vocab.get(letters[at:stop])) is not None:
                    out.append(t)
                    at = stop
                    break
            else:  # no token fits: leave the word to exact merging
                return []
        return out

    def rank_of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, a huge value where there is none."""
        keys = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does merging their joined text end with the two tokens?

        Undo the merges of both sides from the last to the first. Whenever the inner halves that
        touch could merge earlier than the merge just undone, the border would have been crossed.
        """
        inner_a, inner_b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        # The ranks from which on each side's inner half is part of something larger.
        limit = np.full(len(a), 1 << 39, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = inner_a[live], inner_b[live]
            crossed = self.rank_of_pair(x, y)
            # At equal rank the merge further left comes first; limit is stored doubled, odd where the left side was undone last.
            bad = 2 * crossed + 1 <= limit[live]
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            done = bad | ((rx < 0) & (ry < 0))
            left_last = rx >= ry
            nxt_a = np.where(left_last, self.right[x], x)
            nxt_b = np.where(left_last, y, self.left[y])
            inner_a[live] = np.where(done, x, nxt_a)
            inner_b[live] = np.where(done, y, nxt_b)
            # A merge of equal rank at the border is later than one to its left and earlier than one to its right.
            limit[live] = np.where(done, limit[live], np.where(left_last, 2 * rx, 2 * ry + 1))
            live = live[~done]
        return good

    def merge(self, words: list[str]) -> list[list[int]]:
        """Exact merging of several words: in each round every word merges its pair of lowest rank, leftmost first, until it has none."""
        vocab, suffix = self.vocab, self.suffix
        parts = [[vocab[c] for c in w[:-1] if c in vocab] + [vocab[w[-1] + suffix]] * (w[-1:] + suffix in vocab) for w in words]
        long = {k: self._merge_long(x) for k, x in enumerate(parts) if len(x) > LONG_WORD}
        parts = [[] if k in long else x for k, x in enumerate(parts)]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        tokens = np.fromiter((t for x in parts for t in x), np.int64, int(lengths.sum()))
        out: list[list[int]] = [long.get(k, []) for k in range(len(words))]
        owner = np.repeat(np.arange(len(words)), lengths)
        none = np.int64(1 << 40)
        ranks = np.full(len(tokens), none)
        if len(tokens) > 1:
            ranks[:-1] = np.where(owner[:-1] == owner[1:], self.rank_of_pair(tokens[:-1], tokens[1:]), none)
        while len(tokens):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(ranks, starts)
            over = least == none
            if over.any():
                ends = np.append(starts[1:], len(tokens))
                for k, i, j in zip(owner[starts[over]].tolist(), starts[over].tolist(), ends[over].tolist(), strict=True):
                    out[k] = tokens[i:j].tolist()
                stay = np.repeat(~over, np.diff(np.append(starts, len(tokens))))
                tokens, owner, ranks = tokens[stay], owner[stay], ranks[stay]
                continue
            sizes = np.diff(np.append(starts, len(tokens)))
            hit = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            tokens[at] = self.made_by_rank[ranks[at]]
            stay = np.ones(len(tokens), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # where they stand once the right halves are gone
            tokens, owner, ranks = tokens[stay], owner[stay], ranks[stay]
            for left in (at, at - 1):  # the pairs that begin and end with a new token
                left = left[(left >= 0) & (left < len(tokens) - 1)]
                ranks[left] = np.where(owner[left] == owner[left + 1], self.rank_of_pair(tokens[left], tokens[left + 1]), none)
            ranks[-1] = none
            ends = np.flatnonzero(owner[:-1] != owner[1:])
            ranks[ends] = none
        return out

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """Exact merging of one word, its pairs in a heap by rank and place: n log n steps."""
        tokens = tokens[:]
        end = len(tokens)
        before, after = [*range(-1, end - 1)], [*range(1, end + 1)]
        ranks, made = self.ranks, self.made_by_rank
        pairs = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(tokens, tokens[1:], strict=False)) if pair in ranks]
        heapify(pairs)
        while pairs:
            rank, i, a, b = heappop(pairs)
            j = after[i]
            if tokens[i] != a or j >= end or tokens[j] != b:
                continue  # one of the two has been merged
            tokens[i], tokens[j] = int(made[rank]), -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
                if (pair := (tokens[i], tokens[after[i]])) in ranks:
                    heappush(pairs, (ranks[pair], i, *pair))
            if before[i] >= 0 and (pair := (tokens[before[i]], tokens[i])) in ranks:
                heappush(pairs, (ranks[pair], before[i], *pair))
        return [t for t in tokens if t >= 0]

    def learn(self, words: Iterable[str]) -> None:
        """Encode new words and store their ids and shown tokens."""
        new = list(words)
        if len(self.ids_of) + len(new) > CACHED_WORDS:
            self.ids_of.clear()
            self.shown_of.clear()
        letter_of = self.letter_of
        spelled = [w if w.isascii() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letter_of) for w in new]
        spelled = [s if s.isprintable() else s.translate(letter_of) for s in spelled]
        found = [self.propose(s) for s in spelled]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for x in found for t in x), np.int64, int(lengths.sum()))
        failing = np.zeros(0, np.int64)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(found)), lengths)
            at = np.flatnonzero(owner[:-1] == owner[1:])
            pairs, back = np.unique(flat[at] * self.n + flat[at + 1], return_inverse=True)
            good = self.compatible(pairs // self.n, pairs % self.n)
            failing = np.unique(owner[at[~good[back]]])
        again = [*failing.tolist(), *np.flatnonzero(lengths == 0).tolist()]
        for k, x in zip(again, self.merge([spelled[k] for k in again]), strict=True):
            found[k] = x
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        packed = np.fromiter((t for x in found for t in x), "<u4", int(lengths.sum())).tobytes()
        ends = (4 * np.cumsum(lengths)).tolist()
        self.ids_of.update(zip(new, [packed[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        if self.shows:
            shown = self.text_of
            self.shown_of.update(zip(new, [" ".join([shown[t] for t in x]).encode() for x in found], strict=True))

    def _learn_special(self, words: set[str]) -> set[str]:
        """Store the special strings among ``words`` and return the rest."""
        for w in [w for w in words if w.startswith("\0S")]:
            t = self.special[w[2:]]
            self.ids_of[w], self.shown_of[w] = np.array([t], "<u4").tobytes(), self.text_of[t].encode()
            words.discard(w)
        return words

    # texts

    def words(self, text: str) -> list[str]:
        """The text's words after normalisation; special strings stand as themselves, marked by a leading NUL and S."""
        if self.special_split is None or "<|" not in text:
            return self._plain_words(text)
        out: list[str] = []
        for k, piece in enumerate(self.special_split.split(text)):
            if k % 2:
                out.append("\0S" + piece)
            elif piece:
                out += self._plain_words(piece)
        return out

    def _plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORD.findall(text.lower())
        if _RARE.search(text):
            # Newer letters and marks: the library's own tables tell how they are composed, lowered and classed.
            normal, split = self.library
            return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]
        # One letter at a time, as the tokenizer lowers: no special form for a final sigma.
        return _WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids as little-endian 32-bit integers and, if ``shows``, its decoded text: the tokens' strings joined by spaces."""
        for at in range(0, len(texts), 256):
            for part in _groups([self.words(t) for t in texts[at : at + 256]], 100_000):
                if new := set().union(*part) - self.ids_of.keys():
                    size = len(self.ids_of)
                    self.learn(self._learn_special(new))
                    if len(self.ids_of) < size and (again := set().union(*part) - self.ids_of.keys()):  # the store was emptied
                        self.learn(self._learn_special(again))
                ids, shown = self.ids_of.__getitem__, self.shown_of.__getitem__
                for words in part:
                    yield b"".join(map(ids, words)), b" ".join([s for s in map(shown, words) if s]) if self.shows else b""

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) // 4 for ids, _ in self.encode(texts)]


def _groups(split: list[list[str]], most: int) -> Iterator[list[list[str]]]:
    """Consecutive texts with at most ``most`` words together, or one longer text."""
    part: list[list[str]] = []
    n = 0
    for words in split:
        if part and n + len(words) > most:
            yield part
            part, n = [], 0
        part.append(words)
        n += len(words)
    if part:
        yield part


def decode(ids: bytes, vocabulary: WordBpe) -> str:
    """Ids back to the tokens' strings, joined by spaces; no special token is skipped."""
    return " ".join([vocabulary.text_of[t] for t in np.frombuffer(ids, "<u4").tolist() if t < vocabulary.n and vocabulary.text_of[t]])


def vocabulary(path: str, shows: bool = True) -> WordBpe:
    """One vocabulary for each worker. Without ``shows`` it only encodes."""
    return hold("bpe", (path, shows), lambda: WordBpe(path, shows))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``n_tokens``, ``ids`` (array of ints), ``decoded``, ``ids_sha256``, ``decoded_sha256``.

    Nulls and empty texts have no tokens and decode to an empty string. Rows are independent:
    repeated rows and keys keep a row each; other columns are left out, whatever their names.
    With ``with_ids`` False the two long columns are left out.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else [])
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 256):
                rows += [(i, d) if with_ids else (len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in bpe.encode([x or "" for x in batch.column(1).slice(at, 256).to_pylist()])]
            if not with_ids:
                columns = [[r[k] for r in rows] for k in range(3)]
            else:
                columns = [[len(i) // 4 for i, _ in rows], [hashlib.sha256(i).hexdigest() for i, _ in rows], [hashlib.sha256(d).hexdigest() for _, d in rows]]
                columns += [[np.frombuffer(i, "<u4").astype(np.int32) for i, _ in rows], [d.decode() for _, d in rows]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]], [key, *[n for n, _ in fields]])

    return mapped(docs.select(F.col(key), F.col(text).cast("string")), run, schema, "bpe")
