"""SentencePiece encoding and decoding: the n best segmentations over the lattice of pieces.

The vocabulary file gives pieces and their scores; a segmentation's score is the sum of its pieces' scores. Those of a
unigram model are log probabilities, and the best path is the library's. Those of a byte-pair model are ranks of merges
and no likelihoods: a piece's log probability is taken from its rank then (``likelihoods``), and as the likeliest path
needn't be what the merges give, the library's identifiers are reported beside it.

Forward Viterbi gives the best score of every prefix of a lattice, which is the exact heuristic for an A-star search from
the end backward: complete paths leave the queue in order of score. Characters without a piece become their UTF-8 bytes'
pieces at one penalty a character.

No piece goes on past a letter into a blank (checked when the file is read), so a text's lattice falls apart at blanks.
A text's best path is the chain of its words' best paths, and its n best paths deviate from that only in the n - 1 words
whose second path costs least. Words are searched once and remembered with the identifiers of all their n best paths,
within ``MEMORY`` bytes a worker. New words are searched side by side: each step of the two passes is one of arrays that
hold a place of every word. Words of more than ``SHORT`` characters are searched one by one; those fall apart between
characters that no piece has side by side.

Decoding maps pieces to bytes, byte pieces to themselves, and takes away the blank put before the text. What can't come
back (a text that holds the blank's sign itself) has ``exact`` false. Null and empty texts have no pieces and score 0.
Repeated rows and null ids stay, extra columns are ignored, texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import chain as chained

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, picked, remembered
from .words import slices, sums

BLANK = "▁"
#: Bytes of remembered words in a worker process, and of an entry besides its strings.
MEMORY, ENTRY = 160 << 20, 200
#: Words of so many characters at most are searched side by side.
SHORT = 48
#: As many words as are searched side by side.
LANES = 4000
#: What a second path costs where there is none.
NONE = float("inf")
#: Remembered parts of words, of some 700 bytes each.
ATOMS = 60_000
#: Length, score and identifier of a piece.
ONE_ID = (1, 0.0, 0)
#: From so many characters on, a lattice's edges aren't kept.
LONG = 4096
#: The rank at which Zipf's law begins, for models that state an order of merges alone.
ZIPF = 10.0
#: What a character without a piece costs beyond the lowest score, and scores that stand for no rank or probability.
UNKNOWN, NEVER = 10.0, -1e8
#: A word and the blanks before it, or blanks at the end.
WORD = re.compile(r" *[^ ]+| +")

Path = tuple[float, tuple[int, ...]]


class Trie:
    """Where ``pieces`` occur in a text, told from all its places at once. Steps on from the root are looked up by character,
    those from other nodes by a hash of node and character in an open table."""

    ODD, BITS = np.uint64(0x9E3779B97F4A7C15), 21

    def __init__(self, pieces: list[str]) -> None:
        steps: dict[tuple[int, str], int] = {}
        number = {}
        for k, p in enumerate(pieces):
            node = 0
            for c in p:
                node = steps.setdefault((node, c), len(steps) + 1)
            number[node] = k
        self.longest = max(map(len, pieces))
        self.width = (self.longest - 1).bit_length(), (len(pieces) - 1).bit_length()
        self.number = np.full(len(steps) + 1, -1, np.int64)
        self.number[[*number]] = [*number.values()]
        self.root = np.zeros(0x110000, np.int32)
        for (node, c), to in steps.items():
            if not node:
                self.root[ord(c)] = to
        keys = np.array([(node << self.BITS) + ord(c) for node, c in steps if node], np.int64)
        to = np.array([x for (node, _), x in steps.items() if node], np.int32)
        size = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - size), (1 << size) - 1
        self.keys, self.to = np.full(1 << size, -1, np.int64), np.zeros(1 << size, np.int32)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.to[slot[free]] = keys[free], to[free]  # of equal slots one stays
            rest = self.keys[slot] != keys
            keys, to, slot = keys[rest], to[rest], (slot[rest] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.ODD) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that follow, 0 for none."""
        keys = (node.astype(np.int64) << self.BITS) + char
        slot = self.slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.to[slot], 0)
        live = np.flatnonzero((seen != keys) & (seen >= 0))
        slot, keys = slot[live], keys[live]
        while len(live):
            slot = (slot + 1) & self.mask
            seen = self.keys[slot]
            out[live] = np.where(seen == keys, self.to[slot], 0)
            more = (seen != keys) & (seen >= 0)
            live, slot, keys = live[more], slot[more], keys[more]
        return out

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends, lengths and numbers of all pieces in ``text``, in order of end, longer ones first."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
        node = self.root[chars]
        at = np.flatnonzero(node)
        node, out, (by_length, by_piece) = node[at], [], self.width
        for length in range(1, self.longest + 1):
            piece = self.number[node]
            some = piece >= 0
            out.append((((at[some] + length) << by_length) + self.longest - length << by_piece) + piece[some])
            inside = at + length < len(chars)
            at, node = at[inside], node[inside]
            node = self.step(node, chars[at + length])
            on = np.flatnonzero(node)
            at, node = at[on], node[on]
            if not len(at):
                break
        told = np.sort(np.concatenate(out))
        return told >> by_length + by_piece, self.longest - (told >> by_piece & (1 << by_length) - 1), told & (1 << by_piece) - 1


class Lattice:
    """n best segmentations by the vocabulary file at ``path`` (a SentencePiece model)."""

    def __init__(self, path: str, n: int) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("a  b", " a ", "ﬁ\tＡ\n", "Aéé"):
            if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
                raise ValueError("a model that leaves texts as they are, but for blanks, is needed")
        self.n, self.bytes, self.out = n, [0] * 256, []
        scores: dict[str, tuple[float, int]] = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.out.append(b"")
            else:
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError("a piece goes on past a letter into a blank")
                scores[piece] = (model.get_score(k), k)
                self.out.append(piece.replace(BLANK, " ").encode())
        self.pieces = {p: (len(p), s, k) for p, (s, k) in likelihoods(scores).items()}
        #: Two characters between which no piece ends and begins anew are those that some piece has side by side.
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        automaton = ahocorasick.Automaton()
        for p, told in self.pieces.items():
            automaton.add_word(p, told)
        automaton.make_automaton()
        self.found, self.longest = automaton.iter, max(map(len, self.pieces))
        self.trie = Trie([*self.pieces])
        #: Score and identifier of the numbered pieces.
        self.score, self.id = np.array([s for _, s, _ in self.pieces.values()]), np.array([k for _, _, k in self.pieces.values()])
        letters = {c for p in self.pieces for c in p}
        #: A character of no piece, which keeps words apart.
        self.apart = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in letters)
        self.penalty = min(s for _, s, _ in self.pieces.values() if s > NEVER) - UNKNOWN
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.atom: dict[str, list[Path]] = {}
        self.held = 0
        self.starts = np.concatenate([[0], np.cumsum([*map(len, self.out)])])
        self.joined = np.frombuffer(b"".join(self.out), np.uint8)

    def search(self, text: str, n: int) -> list[Path]:
        """The n best (score, identifiers) of the lattice of ``text``, whose characters are all pieces; best first.

        Forward, the best score of every prefix and the piece it ends with. Backward, an entry of the queue is a place
        reached from the end and what the best way through it costs more than the best of all. The way on from it at no
        further cost is the one that the forward pass kept, and needs no queue: only turns off it are pushed. Pieces that
        end at a place of a long text are looked up again there, so its lattice takes a number and a reference a character."""
        size = len(text)
        best, last = [0.0] * (size + 1), [ONE_ID] * (size + 1)
        into: list[list] = [[] for _ in range(size + 1)] if size < LONG else []
        at = 0
        for end, told in self.found(text):
            end += 1
            total = best[end - told[0]] + told[1]
            if into:
                into[end].append(told)
            if end > at:  # the first piece that ends here
                at = end
                best[at], last[at] = total, told
            elif total > best[at]:
                best[at], last[at] = total, told
        found: list[Path] = []
        queue: list[tuple] = []  # by cost, as many as are still asked for
        cost, at, chain, pushed = 0.0, size, None, 0
        while True:
            more = n - len(found) - 1
            limit = queue[more - 1][0] if 0 < more <= len(queue) else NONE
            while at:
                own = last[at]
                if more:
                    so_far = cost + best[at]
                    for edge in into[at] if into else self.ending(text, at):
                        if edge is not own and (turn := so_far - best[at - edge[0]] - edge[1]) < limit:
                            pushed += 1
                            insort(queue, (turn, pushed, at - edge[0], (edge[2], chain)))
                            if len(queue) >= more:
                                del queue[more:]
                                limit = queue[-1][0]
                at, chain = at - own[0], (own[2], chain)
            ids = []
            while chain is not None:
                ids.append(chain[0])
                chain = chain[1]
            found.append((best[size] - cost, tuple(ids)))
            if not more or not queue:
                return found
            cost, _, at, chain = queue.pop(0)

    def ending(self, text: str, at: int) -> list[tuple[int, float, int]]:
        return [told for k in range(max(0, at - self.longest), at) if (told := self.pieces.get(text[k:at])) is not None]

    def atoms(self, text: str) -> list[str]:
        """``text`` cut where no piece goes across."""
        pairs = self.pairs
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in pairs]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if cuts else [text]

    def paths(self, atom: str) -> list[Path]:
        if len(atom) == 1 and atom not in self.pieces:
            return [(self.penalty, tuple([self.bytes[b] for b in atom.encode(errors="replace")]))]
        return self.search(atom, self.n)

    def again(self, atom: str) -> list[Path]:
        """``paths`` of a part of a word; such parts are few, and short ones are remembered."""
        found = self.atom.get(atom)
        if found is None:
            found = self.paths(atom)
            if len(atom) < 32:
                if len(self.atom) == ATOMS:
                    self.atom.clear()
                self.atom[atom] = found
        return found

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n best paths of each of ``words``, by the passes of ``search`` over all of them at once: scores (a row a word, minus
        infinity where there is no path), numbers of identifiers (likewise), and the identifiers of all in a row.

        A place is one between two characters of the words put in a row. Forward, the places at one distance from their
        words' beginnings are told together. Backward, each round takes the first of every word's queue, and goes all
        their ways to the beginning a piece at a time; then the turns seen join the queues."""
        n, size = self.n, np.fromiter(map(len, words), np.int64, len(words))
        text = self.apart + self.apart.join(words) + self.apart
        ends = np.cumsum(size + 1)
        begins, places = ends - size, len(text) + 1
        end, length, piece = self.trie.found(text)
        start, cost, name = end - length, self.score[piece], self.id[piece]
        foreign = np.ones(places, bool)
        foreign[end[length == 1]] = False
        foreign[[0, 1, *(ends + 1)]] = False
        if foreign.any():  # a character without a piece: an edge that stands for its bytes
            more = np.flatnonzero(foreign)
            end, start = np.concatenate([end, more]), np.concatenate([start, more - 1])
            order = np.argsort(end, kind="stable")
            end, start = end[order], start[order]
            cost = np.concatenate([cost, np.full(len(more), self.penalty)])[order]
            name = np.concatenate([name, -np.array([ord(text[k - 1]) for k in more.tolist()])])[order]
        into = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=places))])

        best, last = np.full(places, -NONE), np.zeros(places, np.int64)
        best[begins] = 0.0
        far = (end - np.repeat(begins, into[ends + 1] - into[begins])).astype(np.int16)
        order = np.argsort(far, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(far))]).tolist()
        for a, b in zip(bounds, bounds[1:]):
            if a < b:
                mine = order[a:b]
                at, total = end[mine], best[start[mine]] + cost[mine]
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                top = np.maximum.reduceat(total, first)
                best[at[first]] = top
                won = np.flatnonzero(total == np.repeat(top, np.diff(first, append=len(at))))[::-1]
                last[at[won]] = mine[won]  # of equals, the first

        scores, final = np.full((len(words), n), -NONE), np.full((len(words), n), -1)
        edges, behind, made = [], [], 0  # chains of edges, each with the one behind it

        def linked(edge: np.ndarray, after: np.ndarray) -> np.ndarray:
            nonlocal made
            edges.append(edge)
            behind.append(after)
            made += len(edge)
            return np.arange(made - len(edge), made)

        word, worse, at, link = np.arange(len(words)), np.zeros(len(words)), ends, np.full(len(words), -1)
        queue = [np.zeros(0, kind) for kind in (np.int64, np.float64, np.int64, np.int64)]  # word, cost, edge, the link behind it
        for r in range(n):
            scores[word, r] = best[ends[word]] - worse
            turns = [queue]
            while len(word):
                done = at == begins[word]
                if done.any():
                    final[word[done], r] = link[done]
                    word, worse, at, link = word[~done], worse[~done], at[~done], link[~done]
                own = last[at]
                if r < n - 1:
                    count = into[at + 1] - into[at]
                    which = np.repeat(np.arange(len(at)), count)
                    edge = np.arange(len(which)) + np.repeat(into[at] - np.cumsum(count) + count, count)
                    turn = edge != own[which]
                    which, edge = which[turn], edge[turn]
                    turns.append([word[which], (worse + best[at])[which] - best[start[edge]] - cost[edge], edge, link[which]])
                link, at = linked(own, link), start[own]
            if r < n - 1:
                queue = [np.concatenate(x) for x in zip(*turns)]
                order = np.lexsort(queue[1::-1])
                queue = [x[order] for x in queue]
                first = np.concatenate([[True], queue[0][1:] != queue[0][:-1]])[: len(order)]
                rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                word, worse, edge, link = (x[first] for x in queue)
                queue = [x[~first & (rank < n - 1 - r)] for x in queue]
                link, at = linked(edge, link), start[edge]

        edge, behind = np.concatenate(edges), np.concatenate(behind)
        slot = np.flatnonzero(final.ravel() >= 0)
        link, slots, names = final.ravel()[slot], [], []
        while len(link):
            slots.append(slot)
            names.append(name[edge[link]])
            link = behind[link]
            slot, link = slot[link >= 0], link[link >= 0]
        slots, names = np.concatenate(slots), np.concatenate(names)
        order = np.argsort(slots, kind="stable")
        slots, names = slots[order], names[order]
        if (odd := np.flatnonzero(names < 0)).size:
            held = [[self.bytes[b] for b in chr(-c).encode(errors="replace")] for c in names[odd].tolist()]
            count = np.ones(len(names), np.int64)
            count[odd] = [*map(len, held)]
            slots, names = np.repeat(slots, count), np.repeat(names, count)
            names[names < 0] = [*chained.from_iterable(held)]
        return scores, np.bincount(slots, minlength=final.size).reshape(final.shape), names.astype("<i4")

    def word(self, word: str) -> tuple[list[float], list[int], bytes]:
        """What ``together`` tells, of one word of any length."""
        found = self.chain([*map(self.again, self.atoms(word))])
        none = self.n - len(found)
        return [s for s, _ in found] + [-NONE] * none, [len(ids) for _, ids in found] + [0] * none, b"".join(array("i", ids).tobytes() for _, ids in found)

    def told(self, words: list[str]) -> Iterator[bytes]:
        """``told_together``, some words at a time."""
        for k in range(0, len(words), LANES):
            yield from self.told_together(words[k : k + LANES])

    def told_together(self, words: list[str]) -> Iterator[bytes]:
        """Of a blank and each word: the score, what the next paths cost more, numbers of identifiers of the n best paths and of
        the library's (0, if it is the best path), and all these identifiers."""
        with_blanks = [BLANK + w.replace(" ", BLANK) for w in words]
        short = [k for k, w in enumerate(with_blanks) if len(w) <= SHORT]
        scores, counts, parts = np.full((len(words), self.n), -NONE), np.zeros((len(words), self.n + 1), "<i4"), [b""] * len(words)
        if short:
            scores[short], counts[short, : self.n], ids = self.together([with_blanks[k] for k in short])
            data, at = ids.tobytes(), 0
            for k, m in zip(short, counts[short].sum(axis=1).tolist()):
                parts[k] = data[at : at + 4 * m]
                at += 4 * m
        for k, w in enumerate(with_blanks):
            if len(w) > SHORT:
                scores[k], counts[k, : self.n], parts[k] = self.word(w)
        costs = scores[:, :1] - scores
        costs[:, 0] = scores[:, 0]
        first = (4 * counts[:, 0]).tolist()
        for k, own in enumerate(self.model.encode(words, num_threads=1)):
            library = array("i", own).tobytes()
            if parts[k][: first[k]] != library:
                parts[k] += library
                counts[k, self.n] = len(own)
        head = np.concatenate([costs.astype("<f8").view("<i4"), counts], axis=1)
        data, width = head.tobytes(), 4 * head.shape[1]
        return (data[k * width : (k + 1) * width] + part for k, part in enumerate(parts))

    def learned(self, words: list[str]) -> dict[str, bytes]:
        """What ``told`` gives for each. What hasn't been asked for since half of the memory was filled is forgotten."""
        fresh = {w: self.old.get(w) for w in words}
        new = [w for w, told in fresh.items() if told is None]
        if new:
            fresh.update(zip(new, self.told(new)))
        for w, told in fresh.items():
            if len(w) < 64:
                self.held += ENTRY + len(told)
                if self.held > MEMORY // 2:
                    self.old, self.memo, self.held = self.memo, {}, 0
                self.memo[w] = told
        return fresh

    @staticmethod
    def parts(text: str) -> list[str]:
        """A text as words, each without the blank before it (the first has the blank that encoding puts there)."""
        if not text:
            return []
        return [w[1:] for w in WORD.findall(" " + text)] if "  " in text or text[0] == " " or text[-1] == " " else text.split(" ")

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, list[float], bytes]]:
        """Of each text: number of pieces and identifiers (little-endian 32-bit) of the best segmentation, scores of the n
        best, and the identifiers that the library gives."""
        return [told[:4] for told in self.encode_all(texts)]

    def encode_all(self, texts: list[str]) -> list[tuple[int, bytes, list[float], bytes, list[bytes]]]:
        """What ``encode`` gives, and the identifiers of the next segmentations after the best."""
        parts = [*map(self.parts, texts)]
        words = [*chained.from_iterable(parts)]
        told = [*map(self.memo.get, words)]
        if None in told:
            fresh = self.learned([w for w, x in zip(words, told) if x is None])
            told = [fresh[w] if x is None else x for w, x in zip(words, told)]
        bounds = np.concatenate([[0], np.cumsum([*map(len, parts)])]).astype(np.int64)
        data, n = np.frombuffer(b"".join(told), "<i4"), self.n
        start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, told), np.int64, len(told)) // 4)])[:-1]
        costs = data[start[:, None] + np.arange(2 * n)].view("<f8")
        counts = data[start[:, None] + np.arange(2 * n, 3 * n + 1)].astype(np.int64)
        begins = (start + 3 * n + 1)[:, None] + np.cumsum(counts, axis=1) - counts
        best, of, place = ranges(data, begins[:, 0], counts[:, 0], bounds)
        m = (counts[:, n] > 0).astype(np.int64) * n
        each = np.arange(len(words))
        own, by, _ = ranges(data, begins[each, m], counts[each, m], bounds)
        score = sums(costs[:, 0], bounds).tolist()
        cheap = cheapest(costs[:, 1], bounds, n - 1) if n > 1 else [[] for _ in texts]
        out = []
        for t in range(len(texts)):
            ways: list[tuple[float, tuple]] = [(0.0, ())]
            for k in cheap[t]:
                deviations = [(c, ((k, v),)) for v, c in enumerate(costs[k, 1:].tolist(), 1) if c < NONE]
                ways = sorted(((c + d, (*way, *turn)) for c, way in ways for d, turn in [(0.0, ()), *deviations]), key=lambda x: x[0])[:n]
            others = []
            for _, way in ways[1:]:
                ids, at = [], of[t]
                for k, v in sorted(way):
                    ids += [best[at : place[k]], data[begins[k, v] : begins[k, v] + counts[k, v]]]
                    at = place[k + 1]
                others.append(b"".join(x.tobytes() for x in [*ids, best[at : of[t + 1]]]))
            out.append((of[t + 1] - of[t], best[of[t] : of[t + 1]].tobytes(), [score[t] - c for c, _ in ways], own[by[t] : by[t + 1]].tobytes(), others))
        return out

    def segmentations(self, text: str) -> list[Path]:
        """The n best segmentations of a whole text, with identifiers."""
        return self.chain([self.paths(a) for w in self.parts(text) for a in self.atoms(BLANK + w.replace(" ", BLANK))])

    def chain(self, found: list[list[Path]]) -> list[Path]:
        """The n best paths through lattices one after another, of which ``found`` has the n best of each."""
        second = [(f[0][0] - f[1][0], k) for k, f in enumerate(found) if len(f) > 1]
        cheap = sorted(k for _, k in heapq.nsmallest(self.n - 1, second))
        ways: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for k in cheap:
            ways = sorted(((c + found[k][0][0] - s, (*way, v)) for c, way in ways for v, (s, _) in enumerate(found[k])), key=lambda x: x[0])[: self.n]
        score, out = sum(f[0][0] for f in found), []
        for cost, way in ways:
            chosen = dict(zip(cheap, way))
            out.append((score - cost, tuple(i for k, f in enumerate(found) for i in f[chosen.get(k, 0)][1])))
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts whose identifiers lie between ``bounds``."""
        size = np.diff(self.starts)[ids]
        ends = np.cumsum(size)
        place = np.repeat(self.starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        data, at = self.joined[place].tobytes(), np.concatenate([[0], ends])[bounds].tolist()
        return [data[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(at, at[1:])]


def ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """What lies at ``start`` in ``data``, ``size`` each, in a row; where in that each of ``bounds`` falls, and where each begins."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends[bounds].tolist(), ends


def cheapest(costs: np.ndarray, bounds: np.ndarray, most: int) -> list[list[int]]:
    """Places of the ``most`` smallest finite ``costs`` between consecutive bounds, the first of equals, in order of cost."""
    left, out = costs.copy(), [[] for _ in bounds[1:]]
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    size = np.diff(bounds)[some]
    for _ in range(most if len(some) else 0):
        least = np.minimum.reduceat(left, bounds[:-1][some])
        at = np.flatnonzero((left == np.repeat(least, size)) & (left < NONE))
        text = np.searchsorted(bounds, at, side="right") - 1
        first = np.concatenate([[True], text[1:] != text[:-1]])[: len(at)]
        for t, k in zip(text[first].tolist(), at[first].tolist()):
            out[t].append(k)
        left[at[first]] = NONE
    return out


def likelihoods(scores: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    """Scores whose sum ranks segmentations. Those of a unigram model are logs of probabilities and stay. Those of a
    byte-pair model are minus the order of its merges, a rank of frequency; a piece's log probability then follows
    from Zipf's law, which loses nothing of their order. Pieces without a rank come last."""
    ranks = [-s for s, _ in scores.values() if s > NEVER]
    if len(set(ranks)) < len(ranks) or any(r < 0 or r % 1 for r in ranks):
        return scores
    rank = {p: -s if s > NEVER else max(ranks) + 1 for p, (s, _) in scores.items()}
    norm = math.log(sum(1 / (r + ZIPF) for r in rank.values()))
    return {p: (-math.log(rank[p] + ZIPF) - norm, k) for p, (_, k) in scores.items()}


def lattice(path: str, n: int) -> Lattice:
    """One lattice a worker process, with its memory."""
    return remembered("pieces", (path, n), lambda: Lattice(path, n))


def encode_texts(docs: DataFrame, model: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_pieces, ids (binary: little-endian 32-bit identifiers of the best segmentation), scores
    (of the n best, best first), decoded (the text of ids), exact (decoded is the text), library_ids (the library's own
    segmentation, which for a byte-pair model need not be the likeliest) and next_ids (identifiers of the n best but the
    first). Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        nbest = lattice(model, n)
        for b in batches:
            for part in slices(b, 1 << 20):
                texts = part.column("text").to_pylist()
                count, ids, scores, own, others = zip(*nbest.encode_all(texts))
                decoded = nbest.decode(np.frombuffer(b"".join(ids), "<i4"), np.concatenate([[0], np.cumsum(count)]))
                yield {"doc_id": part.column("doc_id"), "n_pieces": count, "ids": ids, "scores": scores, "decoded": decoded, "exact": [a == b for a, b in zip(decoded, texts)], "library_ids": own, "next_ids": others}

    return arrow_map(picked(docs, id_col, text_col), run, "n_pieces long, ids binary, scores array<double>, decoded string, exact boolean, library_ids binary, next_ids array<binary>", ("doc_id",), "pieces")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, best_score, next_score, ids_sha256, decoded_sha256, exact, n_library, library_sha256, next_sha256 (of
    the second best segmentation's identifiers, null where there is none)."""
    score = lambda k: F.get("scores", F.lit(k))
    return encoded.select(
        "doc_id", "n_pieces", score(0).alias("best_score"), score(1).alias("next_score"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "exact",
        (F.octet_length("library_ids") / 4).cast("long").alias("n_library"), F.sha2("library_ids", 256).alias("library_sha256"),
        F.sha2(F.get("next_ids", F.lit(0)), 256).alias("next_sha256"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")))
