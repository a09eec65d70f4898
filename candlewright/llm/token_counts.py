"""Exact token counts of every prefix of a text, by prefix dynamic programming over a BPE vocabulary with word ends.

A sequence of tokens is what the merges give exactly if no two neighbours would have been merged across their border, and
that depends on the two tokens alone.  So the last token of a prefix is the one token that ends it and stands apart from the
last token of the prefix before it: one count and one last token for each prefix, in one pass, give the encoding of all
of them.  A prefix that ends inside a word has a word end there, so each place has two values: the open one, from which the
pass goes on, and the closed one, which is the answer.

Tasks take blocks of texts as arrays of code points.  Words (matches of PATTERN) are found and hashed in whole blocks;
the pass runs over all new words of a block at once, position by position, with substrings looked up by rolling hash;
words that a task has met are remembered up to a bound.  Words that are met again are compared byte by byte.  Words
of more than LONG bytes go through the same pass one by one, in time linear in their length.

The store has for each text the differences of its counts, a byte a code point before compression.  It answers any question
about prefixes without the tokenizer: the count of the whole text or of a prefix, the longest prefix within a budget.
Counts do not always rise with the prefix: a word may have fewer tokens than its beginning.

Special strings inside a text are one token each, as is the library's default; prefixes that end inside one are plain text.
Null texts are empty and have no tokens; repeated rows and null identifiers count as they are; an empty table gives an
empty result; extra columns are ignored.  A text of any length is whole; one of more than CHUNK code points is cut at white
space for the pass, which changes no count.  Texts that are not in normal form C go through the pass by character.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: How the vocabulary file's words are cut; the block form below follows it, so other files are refused.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHUNK = 1 << 19  # code points in a block
LONG = 48  # bytes of a word that goes through the pass in blocks
KNOWN = 1 << 19  # words that a task remembers
FAR = 1 << 40  # later than any merge
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)

_PRIME = 0x9E3779B97F4A7C15
_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_cached: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and their inverses modulo 2**64, n of each at least."""
    if len(_cached.get("powers", ((),))[0]) < n:
        n = max(n, 5 * CHUNK)
        base, inverse = np.uint64(_PRIME), np.uint64(pow(_PRIME, -1, 1 << 64))
        one = np.ones(1, np.uint64)
        _cached["powers"] = tuple(np.concatenate([one, np.cumprod(np.full(n, x, np.uint64), dtype=np.uint64)]) for x in (base, inverse))
    return _cached["powers"]


def hash_of(data: bytes) -> int:
    v = np.frombuffer(data, np.uint8)
    return int((_CODE[v] * powers(len(v))[0][: len(v)]).sum(dtype=np.uint64))


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Vocabulary:
    """Tables of a BPE vocabulary: tokens are numbered by merge, 0-255 open bytes, 256-511 bytes that end a word."""

    def __init__(self, spec: str) -> None:
        found = json.loads(spec)
        model, steps = found["model"], found["pre_tokenizer"].get("pretokenizers", [{}])
        if model.get("end_of_word_suffix") != "</w>" or steps[0].get("pattern", {}).get("Regex") != PATTERN:
            raise ValueError("the vocabulary file must hold a BPE with word ends and the words of PATTERN")
        self.spec = spec
        self.special = sorted((x["content"] for x in found["added_tokens"]), key=len, reverse=True)
        symbols = byte_symbols()
        number = {s: b for b, s in enumerate(symbols)} | {s + "</w>": 256 + b for b, s in enumerate(symbols)}
        self.bytes = [bytes([b]) for b in range(256)] * 2
        self.open = [True] * 256 + [False] * 256
        parts = [(i, i) for i in range(512)]
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = number[a], number[b]
            number[a + b] = len(parts)
            parts.append((x, y))
            self.bytes.append(self.bytes[x] + self.bytes[y])
            self.open.append(self.open[y])
        self.left, self.right = (np.array(x, np.int64) for x in zip(*parts))
        key = (self.left[512:] << 32) | self.right[512:]
        order = np.argsort(key)
        self.pair, self.merged = key[order], order + 512
        self.pairs_sieve = self.sieve(self.mixed(self.pair))
        self.longest = max(map(len, self.bytes))
        self.whole = self._whole()
        kept = [i for i in range(len(parts)) if self.whole[i]]
        size = np.array([len(self.bytes[i]) for i in kept])
        hashes = np.array([hash_of(self.bytes[i]) for i in kept], np.uint64)
        self.hashes, at = np.unique(hashes, return_inverse=True)
        self.size, self.token = np.zeros(len(self.hashes), np.int64), np.full((2, len(self.hashes)), -1, np.int64)
        self.token_sieve = self.sieve(self.hashes)
        self.size[at] = size
        self.token[[0 if self.open[i] else 1 for i in kept], at] = kept

    @staticmethod
    def mixed(key: np.ndarray) -> np.ndarray:
        return key.view(np.uint64) * np.uint64(_PRIME)

    @staticmethod
    def sieve(hashes: np.ndarray) -> np.ndarray:
        """What a table may hold, by the top bits: most lookups miss and need not search it."""
        out = np.zeros(1 << 20, bool)
        out[hashes >> np.uint64(44)] = True
        return out

    def _whole(self) -> np.ndarray:
        """Tokens that the merges give for their own bytes: the only ones that occur."""
        whole = np.ones(len(self.left), bool)
        for i in range(512, len(whole)):
            a, b = self.left[i], self.right[i]
            whole[i] = whole[a] and whole[b]
        rest = np.flatnonzero(whole[512:]) + 512
        whole[rest] &= self.apart(self.left[rest], self.right[rest], rest)
        for i in range(512, len(whole)):
            whole[i] &= whole[self.left[i]] and whole[self.right[i]]
        return whole

    def apart(self, a: np.ndarray, b: np.ndarray, limit=None) -> np.ndarray:
        """Whether neighbours a and b stay two tokens: no merge across their border comes before those inside them.

        The merges inside are undone from the last; at each state the border's two tokens must not have a merge that is
        earlier than the one undone (the left one goes first among equals).  limit: merges before it count only.
        """
        out, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), FAR) if limit is None else np.asarray(limit, np.int64)
        while len(live):
            key = (a << 32) | b
            near = np.flatnonzero(self.pairs_sieve[self.mixed(key) >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.pair, key[near]), len(self.pair) - 1)
            near = near[(self.pair[at] == key[near]) & (self.merged[at] < limit[near])]
            out[live[near]] = False
            go = np.maximum(a, b) >= 512
            go[near] = False
            live, a, b = live[go], a[go], b[go]
            first = a > b
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def look(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in hashes, open tokens, closed tokens) of substrings of a size that are tokens; -1: not that kind."""
        near = np.flatnonzero(self.token_sieve[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        same = (self.hashes[at] == hashes[near]) & (self.size[at] == size)
        at = at[same]
        return near[same], self.token[0, at], self.token[1, at]


def word_counts(vocabulary: Vocabulary, sums: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Closed counts (word, 1..size) of words at byte places of a block with running hash sums; size: at most LONG."""
    inverse = powers(len(sums))[1]
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    most = int(size[0]) if len(size) else 0
    count, last, closed = (np.zeros((len(size), most + 1), np.int32) for _ in range(3))
    for i in range(1, most + 1):
        n = int(np.searchsorted(-size, -i, "right"))
        rows, tokens, sizes = ([], []), ([], []), ([], [])
        for length in range(1, min(i, vocabulary.longest) + 1):
            at = begin[:n] + i - length
            hit, *kinds = vocabulary.look((sums[at + length] - sums[at]) * inverse[at], length)
            for k in (0, 1):
                own = kinds[k] >= 0
                rows[k].append(hit[own])
                tokens[k].append(kinds[k][own])
                sizes[k].append(np.full(int(own.sum()), length))
        for k, value in ((0, count), (1, closed)):
            r, t, s = np.concatenate(rows[k]), np.concatenate(tokens[k]), np.concatenate(sizes[k])
            fits = s == i
            rest = np.flatnonzero(~fits)
            fits[rest] = vocabulary.apart(last[r[rest], i - s[rest]].astype(np.int64), t[rest])
            r, t, s = r[fits], t[fits], s[fits]
            value[r, i] = count[r, i - s] + 1
            if k == 0:
                last[r, i] = t
    out = np.empty_like(closed)
    out[order] = closed
    return out


class Walker:
    """The pass byte by byte, for long words and for texts whose prefixes are not prefixes of their normal form."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        if "dicts" not in vocabulary.__dict__:
            vocabulary.dicts = tuple({vocabulary.bytes[i]: i for i in np.flatnonzero(vocabulary.whole) if vocabulary.open[i] == kind} for kind in (True, False))
            vocabulary.pairs, vocabulary.lefts, vocabulary.rights = {}, vocabulary.left.tolist(), vocabulary.right.tolist()
            vocabulary.merges = {(a, b): 512 + i for i, (a, b) in enumerate(zip(vocabulary.lefts[512:], vocabulary.rights[512:]))}
        self.count, self.last, self.word = [0], [-1], bytearray()

    def fits(self, before: int, token: int) -> bool:
        known, key = self.v.pairs, (before, token)
        if key not in known:
            if len(known) >= KNOWN:
                known.clear()
            known[key] = before < 0 or self.apart(before, token)
        return known[key]

    def apart(self, a: int, b: int) -> bool:
        """As the vocabulary's, for one pair."""
        limit, left, right, merged = FAR, self.v.lefts, self.v.rights, self.v.merges
        while True:
            if merged.get((a, b), FAR) < limit:
                return False
            if max(a, b) < 512:
                return True
            if a > b:
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def end(self, kind: int) -> tuple[int, int]:
        """(count, last token) of the word so far, left open (0) or closed (1)."""
        n = len(self.word)
        for size in range(1, min(n, self.v.longest) + 1):
            token = self.v.dicts[kind].get(bytes(self.word[n - size :]))
            if token is not None and self.fits(self.last[n - size], token):
                return self.count[n - size] + 1, token
        raise AssertionError("every word has an encoding")

    def push(self, data: bytes) -> None:
        for b in data:
            self.word.append(b)
            n, token = self.end(0)
            self.count.append(n)
            self.last.append(token)

    def cut(self, n: int) -> None:
        del self.word[n:], self.count[n + 1 :], self.last[n + 1 :]

    def closed(self) -> int:
        return self.end(1)[0] if self.word else 0


class Counter:
    """Counts of all prefixes of texts, with the words that the task has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.special = re.compile("|".join(map(re.escape, vocabulary.special))) if vocabulary.special else None
        if "classes" not in vocabulary.__dict__:
            from tokenizers import Tokenizer

            vocabulary.cutter = Tokenizer.from_str(vocabulary.spec).pre_tokenizer
            vocabulary.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.data, self.begin, self.size = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        self.counts, self.at, self.total = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point, as the library's expressions see it."""
        table = self.v.classes
        found = table[points]
        if (found == UNKNOWN).any():
            cut = self.v.cutter.pre_tokenize_str
            for point in np.unique(points[found == UNKNOWN]).tolist():
                x = chr(point)
                if len(cut(x)) == 0:
                    table[point] = SPACE
                elif len(cut("a" + x)) == 1:
                    table[point] = LETTER
                else:
                    table[point] = OTHER if len(cut("!" + x)) == 1 else NUMBER
            found = table[points]
        return found

    def block(self, texts: list[str]) -> np.ndarray:
        """Counts after each code point of lower-cased texts in normal form, one after another, each from zero."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return np.empty(0, np.int32)
        kind = self.classes(points)
        edge = np.cumsum([0, *map(len, texts)])
        first = np.zeros(n + 4, bool)
        first[edge[:-1]] = True
        before = np.concatenate([[UNKNOWN], kind[:-1]])
        before[first[:n]] = UNKNOWN
        start = (kind == NUMBER) | (((kind == LETTER) | (kind == OTHER)) & (kind != before))
        marks = np.flatnonzero((points == 39) & start)
        if len(marks):  # contractions
            ahead = np.concatenate([points, np.zeros(4, np.uint32)])
            one, two = ahead[marks + 1], ahead[marks + 2]
            inside, more = ~first[marks + 1], ~first[marks + 1] & ~first[marks + 2]
            short = inside & np.isin(one, [ord(x) for x in "stmd"])
            long = more & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            for at, step in ((marks[short], 2), (marks[long], 3)):
                start[at + 1] = False
                after = at + step
                after = after[after < n]
                after = after[(kind[after] == LETTER) & ~first[after]]
                start[after] = True
        of = np.cumsum(start) - 1
        begin = np.flatnonzero(start)
        solid = kind != SPACE
        length = np.bincount(of[solid], minlength=len(begin))
        data = np.frombuffer(joined.encode(), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        b, size = place[begin], place[begin + length] - place[begin]
        power, inverse = powers(len(data) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODE[data] * power[: len(data)], dtype=np.uint64)])
        hashes = (sums[b + size] - sums[b]) * inverse[b]
        slot = self.slots(hashes, data, b, size, sums)
        total = np.concatenate([[0], np.cumsum(self.total[slot])])
        out = total[of + 1]
        inside = np.flatnonzero(solid)
        word = of[inside]
        out[inside] = total[word] + self.counts[self.at[slot[word]] + inside - begin[word]]
        self.begins, self.solid = begin, solid
        base = np.concatenate([total, total[-1:]])[np.concatenate([np.cumsum(start) - start, [len(begin)]])[edge[:-1]]]
        return (out - np.repeat(base, np.diff(edge))).astype(np.int32)

    def slots(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Where the words' counts are kept; counts of new words are made."""
        if len(self.hashes) > KNOWN:
            self.forget()
        if not len(hashes):
            return np.empty(0, np.int64)
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        found = np.empty(len(distinct), np.int64)
        found[known] = self.slot[at[known]]
        found[new] = len(self.begin) + np.arange(len(new))
        if len(new):
            self.learn(data, begin[one[new]], size[one[new]], sums)
            keys, slots = np.concatenate([self.hashes, distinct[new]]), np.concatenate([self.slot, found[new]])
            order = np.argsort(keys)
            self.hashes, self.slot = keys[order], slots[order]
        slot = found[which]
        odd = size != self.size[slot]  # words that share a hash with another: compared whole, and learnt by themselves
        same = np.flatnonzero(~odd)
        gap = np.repeat(self.begin[slot[same]] - begin[same], size[same])
        where = np.repeat(begin[same] - np.concatenate([[0], np.cumsum(size[same])[:-1]]), size[same]) + np.arange(int(size[same].sum()))
        if len(where):
            equal = np.logical_and.reduceat(self.data[where + gap] == data[where], np.concatenate([[0], np.cumsum(size[same])[:-1]]))
            odd[same[~equal]] = True
        for i in np.flatnonzero(odd):
            slot[i] = len(self.begin)
            self.learn(data, begin[i : i + 1], size[i : i + 1], sums)
        return slot

    def learn(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, sums: np.ndarray) -> None:
        short = size <= LONG
        table = np.zeros((len(size), LONG + 1), np.int32)
        if short.any():
            found = word_counts(self.v, sums, begin[short], size[short])
            table[np.flatnonzero(short)[:, None], np.arange(found.shape[1])] = found
        # bytes of the words, one after another
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        flat = data[np.repeat(begin - starts, size) + np.arange(int(size.sum()))]
        inner = np.arange(len(flat)) - np.repeat(starts, size)
        ends = np.concatenate([(flat[1:] & 0xC0) != 0x80, [True]])  # the last byte of a code point
        row = np.repeat(np.arange(len(size)), size)
        counts = np.zeros(len(flat), np.int32)
        fast = np.repeat(short, size)
        counts[fast] = table[row[fast], inner[fast] + 1]
        for i in np.flatnonzero(~short):
            walk, text = Walker(self.v), flat[starts[i] : starts[i] + size[i]].tobytes()
            stops = np.flatnonzero(ends[starts[i] : starts[i] + size[i]]).tolist()
            at = 0
            for stop in stops:
                walk.push(text[at : stop + 1])
                counts[starts[i] + stop] = walk.closed()
                at = stop + 1
        # a contraction of three is two words until it is whole
        three = np.flatnonzero(size == 3)
        three = three[(flat[starts[three]] == 39) & (flat[starts[three] + 1] >= 97) & (flat[starts[three] + 1] <= 122)]
        counts[starts[three] + 1] = 2
        points = np.add.reduceat(ends.astype(np.int64), starts)
        self.at = np.concatenate([self.at, len(self.counts) + np.concatenate([[0], np.cumsum(points)[:-1]])])
        self.counts = np.concatenate([self.counts, counts[ends]])
        self.total = np.concatenate([self.total, counts[starts + size - 1]])
        self.begin = np.concatenate([self.begin, len(self.data) + starts])
        self.size = np.concatenate([self.size, size])
        self.data = np.concatenate([self.data, flat])

    def pieces(self, text: str) -> list[str]:
        """The lower-cased normal form in parts that end at white space, CHUNK code points or more each but for the last."""
        out = []
        while len(text) > CHUNK:
            found = _WHITE.search(text, CHUNK)
            if not found:
                break
            out.append(text[: found.end()])
            text = text[found.end() :]
        return [*out, text]

    def several(self, texts: list[str]) -> list[np.ndarray]:
        """Counts after each code point of lower-cased texts in normal form, about CHUNK code points a block."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            own = self.pieces(text) if len(text) > CHUNK else [text]
            parts += own
            owner += [i] * len(own)
        counts, held, size = [], [], 0
        for part in parts:
            if held and size + len(part) > CHUNK:
                counts += np.split(self.block(held), np.cumsum([len(x) for x in held])[:-1])
                held, size = [], 0
            held.append(part)
            size += len(part)
        if held:
            counts += np.split(self.block(held), np.cumsum([len(x) for x in held])[:-1])
        if len(parts) == len(texts):
            return counts
        out: list[list] = [[] for _ in texts]
        for i, x in zip(owner, counts):
            out[i].append(x + out[i][-1][-1] if out[i] and len(out[i][-1]) else x)
        return [np.concatenate(x) for x in out]

    def by_character(self, text: str) -> np.ndarray:
        """Counts after each code point of a text that is not in normal form: some prefixes have one of their own."""
        if "seconds" not in _cached:
            pairs = (unicodedata.decomposition(chr(x)).split() for x in range(0x110000))
            _cached["seconds"] = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"} | {chr(x) for x in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
        joins = _cached["seconds"]
        edge = [i for i, x in enumerate(text) if not i or not (unicodedata.combining(x) or x in joins)] + [len(text)]
        parts = [lower(unicodedata.normalize("NFC", text[a:b])) for a, b in zip(edge, edge[1:])]
        whole = "".join(parts)
        ends = np.cumsum([len(x) for x in parts])
        counts = np.empty(len(text), np.int32)
        out = self.block([whole])
        begin, solid = self.begins, self.solid
        counts[np.array(edge[1:]) - 1] = out[ends - 1]
        # prefixes that end inside a part: its beginning follows the word before it
        where, tails, bases, walk, at = [], [], [], None, -1
        for k, (a, b) in enumerate(zip(edge, edge[1:])):
            if b - a == 1:
                continue
            end = int(ends[k]) - len(parts[k])
            first = int(begin[np.searchsorted(begin, end - 1, "right") - 1]) if end and solid[end - 1] else end
            if 0 < first and end - first < 3 and solid[first - 1]:  # the apostrophe of a contraction may be a word before
                first = int(begin[np.searchsorted(begin, first - 1, "right") - 1])
            base, head = int(out[first - 1]) if first else 0, whole[first:end]
            long = len(head) > LONG
            if long:
                if at != first:
                    walk, at, pushed = Walker(self.v), first, first
                walk.push(whole[pushed:end].encode())
                pushed = end
                same = self.classes(np.array([ord(head[-1])], np.uint32))[0]
            for stop in range(a + 1, b):
                tail = lower(unicodedata.normalize("NFC", text[a:stop]))
                if not long:
                    where.append(stop - 1)
                    bases.append(base)
                    tails.append(head + tail)
                    continue
                kinds = self.classes(np.array([ord(x) for x in tail], np.uint32))
                n = int(np.argmin(np.append(kinds == same, False)))
                held = len(walk.word)
                walk.push(tail[:n].encode())
                where.append(stop - 1)
                bases.append(base + walk.closed())
                tails.append(tail[n:])
                walk.cut(held)
        for i, base, x in zip(where, bases, self.several(tails)):
            counts[i] = base + (x[-1] if len(x) else 0)
        return counts

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """Counts after each code point of any texts, special strings included."""
        plain, jobs = [], []
        for text in texts:
            own, at = [], 0
            cuts = [x.span() for x in self.special.finditer(text)] if self.special and "<" in text else []
            for a, b in [*cuts, (len(text), len(text) + 1)]:
                part = text[at : b - 1]  # up to the last character of a special string, as plain text
                if not unicodedata.is_normalized("NFC", part):
                    own.append((part, self.by_character(part), a - at))
                else:
                    own.append((part, len(plain), a - at))
                    plain.append(lower(part))
                at = b
            jobs.append(own)
        found = self.several(plain)
        out = []
        for own in jobs:
            base, parts = 0, []
            for k, (part, x, n) in enumerate(own):
                if isinstance(x, int):
                    x = found[x]
                    if len(x) != len(part):  # a character whose lower case is two
                        x = x[np.cumsum([len(lower(y)) for y in part]) - 1]
                parts.append(x + base if base else x)
                if k + 1 < len(own):
                    base += (int(x[n - 1]) if n else 0) + 1
                    parts.append(np.array([base], np.int32))
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        return out


_WHITE = re.compile(r"[ \n\t\r]")


def lower(text: str) -> str:
    """Lower case by character: a sigma at a word's end is as any other."""
    return text.lower() if "\u03a3" not in text else text.replace("\u03a3", "\u03c3").lower()


def packed(counts: np.ndarray) -> bytes:
    steps = np.diff(counts, prepend=np.int32(0))
    small = not len(steps) or (steps.min() >= -128 and steps.max() < 128)
    return (b"1" if small else b"4") + zstandard.ZstdCompressor(level=1).compress(steps.astype(np.int8 if small else np.int32).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    """Counts after each code point."""
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.cumsum(np.frombuffer(raw, np.int8 if data[:1] == b"1" else np.int32), dtype=np.int32)


def vocabulary_of(spec: str) -> Vocabulary:
    if ("vocabulary", spec) not in _cached:
        _cached[("vocabulary", spec)] = Vocabulary(spec)
    return _cached[("vocabulary", spec)]


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_chars, prefix): the count of every prefix of every text.  path: a vocabulary file, read by the driver."""
    spark = docs.sparkSession
    c.prepare(spark)
    with open(path, encoding="utf-8") as f:
        spread = spark.sparkContext.broadcast(f.read())  # the vocabulary file
    rows = c.columns(docs, id=id_col, text=text_col)

    def task(batches):
        counter = Counter(vocabulary_of(spread.value))
        for batch in batches:
            texts, at = batch.column("text").fill_null("").to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size += len(texts[to])
                    to += 1
                found = counter.prefixes(texts[at:to])
                n_bytes = [len(x.encode()) for x in texts[at:to]]
                yield pa.record_batch([batch.column("id").slice(at, to - at), pa.array(n_bytes, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([packed(x) for x in found], pa.binary())], ["id", "n_bytes", "n_chars", "prefix"])
                at = to

    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_chars long, prefix binary")


def _answered(stored: DataFrame, names: list[str], answer) -> DataFrame:
    """The columns of stored but the store, and an answer's columns from each row's counts."""
    kept = [x for x in stored.columns if x != "prefix"]

    def task(batches):
        for batch in batches:
            found = [answer(unpacked(x), row) for x, row in zip(batch.column("prefix").to_pylist(), range(batch.num_rows))]
            yield pa.record_batch([*(batch.column(x) for x in kept), *(pa.array([x[i] for x in found], pa.int64()) for i in range(len(names)))], [*kept, *names])

    kinds = [f"`{x}` {stored.schema[x].dataType.simpleString()}" for x in kept]
    return stored.mapInArrow(task, ", ".join([*kinds, *(f"{x} long" for x in names)]))


def totals(stored: DataFrame, limits: tuple[int, ...] = ()) -> DataFrame:
    """n_tokens of the whole text, and for each limit `fits_<limit>`, the code points of its longest prefix within it."""

    def answer(counts: np.ndarray, _) -> list[int]:
        out = [int(counts[-1]) if len(counts) else 0]
        for limit in limits:
            within = np.flatnonzero(counts <= limit)
            out.append(int(within[-1]) + 1 if len(within) else 0)
        return out

    return _answered(stored, ["n_tokens", *(f"fits_{x}" for x in limits)], answer)


def tokens_at(stored: DataFrame, *places: int) -> DataFrame:
    """For each place `tokens_<place>`: the count of the text's first so many code points (all, where it has fewer)."""

    def answer(counts: np.ndarray, _) -> list[int]:
        return [int(counts[min(p, len(counts)) - 1]) if p and len(counts) else 0 for p in places]

    return _answered(stored, [f"tokens_{p}" for p in places], answer)


def truncated(docs: DataFrame, path: str, limit: int, text_col: str = "text") -> DataFrame:
    """docs with each text cut to its longest prefix of at most `limit` tokens; null texts stay null."""
    rows = docs.select(F.struct(*(docs[f"`{x}`"] for x in docs.columns)).alias("row"), docs[f"`{text_col}`"].alias("text"))
    found = totals(prefix_counts(rows, path, "row"), (limit,))
    cut = F.substring(F.col(f"id.`{text_col}`"), F.lit(1), F.col(f"fits_{limit}").cast("int"))
    return found.select(*((cut if x == text_col else F.col(f"id.`{x}`")).alias(x) for x in docs.columns))
